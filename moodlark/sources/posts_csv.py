"""Post CSVs: training form, dashboard form, replay pool."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from moodlark.schemas import CORRUPT_RECORD, DASHBOARD_NAMES, POST
from moodlark.sources.quoted_csv import records
from moodlark.workspace import written

TEXT_COLUMNS = ("source", "target", "tweet")


# How fields are written: quotes are doubled inside quoted fields, which keep their line breaks.
_FIELDS = {"escape": '"', "multiLine": "true"}


def _parsed(fields: list[StructField]) -> Column:
    """The fields of the record in column ``value``."""
    names = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in fields)
    return F.from_csv("value", names, {**_FIELDS, "columnNameOfCorruptRecord": CORRUPT_RECORD})


def read_posts(
    spark: SparkSession, path: str | list[str], schema: StructType = POST, compat: bool = False, line_breaks: bool = False
) -> DataFrame:
    """Headerless post CSV. Bad ids become null, missing columns null, extra ones go.

    Quotes are doubled inside quoted fields. A line is a row; say
    ``line_breaks`` if quoted fields hold line breaks. Files are read in splits
    in both cases, but twice in the latter. ``compat`` keeps Spark's own CSV
    defaults, in which a backslash escapes quotes.
    """
    if line_breaks:
        return records(spark, path).select(_parsed(schema.fields).alias("post")).select("post.*")
    reader = spark.read.schema(schema).option("header", False)
    return (reader if compat else reader.option("escape", '"')).csv(path)


def _below_headers(found: DataFrame, names: Sequence[str]) -> DataFrame:
    """Records without the first one of each file, which must be the header."""
    header = _parsed([*[StructField(f"h{i}", StringType()) for i in range(len(names))], StructField(CORRUPT_RECORD, StringType())])
    same = header[CORRUPT_RECORD].isNull()
    for i, name in enumerate(names):
        same = same & header[f"h{i}"].eqNullSafe(F.lit(name))
    wrong = F.raise_error(F.concat(F.lit("a post file has another header: "), "value")).cast("boolean")
    first = (F.col("start") == 0) & (F.col("row") == 0)
    return found.where(F.when(first, F.when(same, False).otherwise(wrong)).otherwise(True))


def _dashboard_rows(
    spark: SparkSession, path: str | list[str], schema: StructType, header: Sequence[str], line_breaks: bool
) -> DataFrame:
    """The rows below the header, which every file must have: a file without one fails the job."""
    if line_breaks:
        below = _below_headers(records(spark, path), header)
        parsed = _parsed([*schema.fields, StructField(CORRUPT_RECORD, StringType())])
        return below.select(parsed.alias("post")).select("post.*")
    named = [StructField(name, field.dataType) for name, field in zip(header, schema.fields, strict=True)]
    rows = (
        spark.read.schema(StructType([*named, StructField(CORRUPT_RECORD, StringType())]))
        .option("header", True)
        .option("enforceSchema", False)
        .option("columnPruning", False)
        .option("escape", '"')
        .option("columnNameOfCorruptRecord", CORRUPT_RECORD)
        .csv(path)
    )
    return rows.toDF(*schema.names, CORRUPT_RECORD)


# Every use names the id next to the raw record, so the id is parsed and the
# fields are counted even when a query needs neither.
def _is_malformed():
    return F.col("id").isNull() | F.col(CORRUPT_RECORD).isNotNull()


def _as_posts(rows: DataFrame) -> DataFrame:
    texts = [F.coalesce(name, F.lit("")).alias(name) for name in TEXT_COLUMNS]
    return rows.select("id", *texts)


def read_dashboard_posts(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType = POST,
    header: Sequence[str] = tuple(DASHBOARD_NAMES.values()),
    line_breaks: bool = False,
) -> DataFrame:
    """Post CSV under a header; any malformed row, and any file without the header, fails the job.

    Malformed is a row without exactly four fields or with an id that is not
    a whole number. Empty text fields stay empty strings. For ``line_breaks``
    see ``read_posts``.
    """
    rows = _dashboard_rows(spark, path, schema, header, line_breaks)
    message = F.concat(F.lit("malformed post row: "), F.coalesce(CORRUPT_RECORD, F.lit("no id")))
    checked = rows.where(F.when(_is_malformed(), F.raise_error(message).cast("boolean")).otherwise(True))
    return _as_posts(checked)


def quarantine_dashboard_posts(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType = POST,
    header: Sequence[str] = tuple(DASHBOARD_NAMES.values()),
    line_breaks: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The well-formed posts and, apart from them, the malformed rows; the files are parsed once."""
    rows = written(_dashboard_rows(spark, path, schema, header, line_breaks), "dashboard-rows")
    return _as_posts(rows.where(~_is_malformed())), rows.where(_is_malformed())


def _numbered(tagged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number rows by ``_file, _start, _row``, from 0 and without gaps.

    One row per block (a summary of about 128 MB of input) is summed up to the
    block's offset; Catalyst broadcasts the offsets if their stored size allows
    it and shuffles otherwise.
    """
    block = ["_file", "_start"]
    blocks = written(
        tagged.groupBy(block).agg(F.count("*").alias("_size"), F.min("_row").alias("_first")), "block-sizes"
    )
    before = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    position = F.col("_before") + F.col("_row") - F.col("_first")
    return tagged.join(offsets, block).select(position.alias("idx"), *columns)


def with_position(scan: DataFrame) -> DataFrame:
    """Number the rows of a file scan from 0, in file order, without gaps.

    The rows are written once with the file block they came from and their
    order in it, so that both steps see the same rows even if executors come
    and go.
    """
    tagged = scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return _numbered(written(tagged, "positioned-rows"), scan.columns)


def read_replay_pool(
    spark: SparkSession, path: str | list[str], schema: StructType = POST, line_breaks: bool = False
) -> DataFrame:
    """Headerless post CSV with the position of each row in column ``idx``."""
    if not line_breaks:
        return with_position(read_posts(spark, path, schema))
    tags = [F.col("file_path").alias("_file"), F.col("start").alias("_start"), F.col("row").alias("_row")]
    tagged = records(spark, path).select(*tags, _parsed(schema.fields).alias("post")).select("_file", "_start", "_row", "post.*")
    return _numbered(written(tagged, "positioned-rows"), schema.names)


def write_posts(posts: DataFrame, path: str, header: bool = False) -> None:
    """Write posts in the CSV form that the readers above expect, with the dashboard's header if asked."""
    (
        (posts.withColumnsRenamed(DASHBOARD_NAMES) if header else posts)
        .write.option("header", header)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
