"""What the dashboard shows of a growing predictions table.

After each scored batch a summary row is written: how many predictions are
stored in all, and the newest ones. It is made from the summary before it and
the batch alone, so neither a batch nor a refresh gets slower as the table
grows. Two places take turns: while one is written, the other stays whole.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from moodlark.operators.feed import newest_first, newest_predictions
from moodlark.schemas import PREDICTION
from moodlark.sources import published

SHOWN = 5
PLACES = (0, 1)

SUMMARY = StructType(
    [
        StructField("n", LongType()),
        StructField("newest", ArrayType(PREDICTION)),
        StructField("batch_id", LongType()),
        StructField("place", LongType()),
    ]
)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """The summaries in place: none, one or two rows. The one of the last batch holds."""
    try:
        return spark.read.schema(SUMMARY).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SUMMARY)


def append_summary(
    spark: SparkSession, predictions_path: str, summaries_path: str, batch_id: int, shown: int = SHOWN
) -> None:
    """Bring the summary up to date with the stored rows of one batch.

    A batch that comes again starts from the summary before it, so it is
    counted once. The five rows of a summary are all that passes the driver.
    """
    before = read_summaries(spark, summaries_path).where(F.col("batch_id") < batch_id)
    last = before.orderBy(F.desc("batch_id")).first()
    batch = published.read_batch(spark, predictions_path, batch_id, PREDICTION)
    newest = batch.select(*PREDICTION.names).orderBy(F.desc("seq")).limit(shown)
    count = batch.agg(F.count("*")).scalar()
    if last:
        newest = newest.union(spark.createDataFrame(last["newest"], PREDICTION)).orderBy(*newest_first()).limit(shown)
        count = count + F.lit(last["n"])
    rows = newest.agg(F.collect_list(F.struct(*PREDICTION.names)).alias("newest"))
    summary = rows.select(count.alias("n"), "newest", F.lit(batch_id).cast("long").alias("batch_id"))
    place = next(p for p in PLACES if not last or p != last["place"])
    summary.write.mode("overwrite").parquet(f"{summaries_path}/place={place}")


def _current(summaries: DataFrame) -> DataFrame:
    return summaries.orderBy(F.desc("batch_id")).limit(1)


def shown_count(summaries: DataFrame) -> DataFrame:
    """Number of stored predictions."""
    return _current(summaries).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("predictions"))


def shown_newest(summaries: DataFrame, n: int = SHOWN) -> DataFrame:
    """The newest predictions (as many as were asked for when written), numbered down from the number stored."""
    rows = _current(summaries).select(F.explode("newest").alias("row")).select("row.*")
    return newest_predictions(rows, n, total=shown_count(summaries).scalar())
