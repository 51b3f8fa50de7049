"""CSV files whose quoted fields hold line breaks, read in splits.

Whether a line begins a record depends on all quotes before it in its file. A
first pass finds, for each file block, in which state it ends if it begins
outside of a quoted field, and if it begins inside of one. Chained over the
blocks of a file, these give the state in which each block really begins. A
second pass cuts the blocks into records; the few records that lie across
block ends are put together from their pieces. Texts are not shuffled, and a
file of any size is read by as many tasks as it has blocks.

The functions that run in the tasks are complete in themselves, so executors
need not have this package.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodlark.workspace import written

# Blocks up to which their states are sent to all tasks: one row for each 128 MB of input or so.
SENT_BLOCKS = 1 << 18


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every line with its file and block, in file order within a task."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.xxhash64(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("value"),
    )


def _block_ends(lines: DataFrame) -> DataFrame:
    """By block: whether it ends inside a quoted field if it begins outside or inside, and whether the latter is ever closed."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def ends_inside(line: bytes, inside: bool) -> bool:
            for field in line.split(b","):
                if inside or field[:1] == b'"':
                    inside = inside != (field.count(b'"') % 2 == 1)
            return inside

        schema = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_()), ("closes", pa.bool_())])
        block, outside, inside, closes = None, False, True, False
        for batch in batches:
            quoted = pc.match_substring(batch.column(2), '"').to_pylist()
            for file, start, line, has in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), quoted, strict=True):
                if block != (file, start):
                    if block:
                        yield pa.record_batch([[x] for x in (*block, outside, inside, closes)], schema=schema)
                    block, outside, inside, closes = (file, start), False, True, False
                if has:
                    text = line.as_py()
                    outside, inside = ends_inside(text, outside), ends_inside(text, inside)
                    closes = closes or not inside
        if block:
            yield pa.record_batch([[x] for x in (*block, outside, inside, closes)], schema=schema)

    return lines.mapInArrow(run, "file long, start long, outside boolean, inside boolean, closes boolean")


def _block_states(ends: DataFrame) -> DataFrame:
    """``file, start, begins_inside, opens, origin`` of each block.

    ``opens``: a record begins in the block and is not ended there. ``origin``:
    the block where the record began that is open at the beginning.
    """
    of_file = Window.partitionBy("file").orderBy("start")
    before = of_file.rowsBetween(Window.unboundedPreceding, -1)
    # A block forgets the state, keeps it or turns it round. It is that of the last block that
    # forgets, turned round as often as blocks after it do.
    turns = F.when(F.col("outside") & ~F.col("inside"), 1).otherwise(0)
    counted = ends.withColumn("turns", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    forgets = F.when(F.col("outside") == F.col("inside"), F.struct("outside", "turns"))
    counted = counted.withColumn("last", F.last(forgets, ignorenulls=True).over(before))
    odd = (F.col("turns") - F.coalesce("last.turns", F.lit(0))) % 2 == 1
    states = counted.withColumn("begins_inside", F.coalesce("last.outside", F.lit(False)) != odd)
    end = F.when(F.col("begins_inside"), F.col("inside")).otherwise(F.col("outside"))
    states = states.withColumn("opens", end & (~F.col("begins_inside") | F.col("closes")))
    origin = F.last(F.when(F.col("opens"), F.col("start")), ignorenulls=True).over(before)
    return states.select("file", "start", "begins_inside", "opens", F.when(F.col("begins_inside"), origin).alias("origin"))


def _cut(lines: DataFrame, pieces: bool) -> DataFrame:
    """The records that lie within one block or, if ``pieces``, the parts of those that do not.

    ``lines`` come with ``begins_inside, origin``. A record is named by the
    block it begins in and its number there; of a part that does not begin its
    record the number is not known.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def ends_inside(line: bytes, inside: bool) -> bool:
            for field in line.split(b","):
                if inside or field[:1] == b'"':
                    inside = inside != (field.count(b'"') % 2 == 1)
            return inside

        schema = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("row", pa.int64()), ("part", pa.int64()), ("value", pa.binary())])
        out: list[tuple] = []
        block = origin = None
        held: list[bytes] = []
        row, inside, crossing = 0, False, False

        def left_open() -> None:
            if pieces and held:
                out.append((block[0], origin if crossing else block[1], None if crossing else row, block[1], b"\n".join(held)))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            out.clear()
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            quoted = pc.match_substring(batch.column(2), '"').to_pylist()
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for file, start, line, begins_inside, came_from, has in zip(*columns, quoted, strict=True):
                if block != (file, start):
                    left_open()
                    block, origin, held, row, inside, crossing = (file, start), came_from, [], 0, begins_inside, begins_inside
                if has:
                    was, inside = inside, ends_inside(line, inside)
                else:
                    was = inside
                if was or inside:
                    held.append(line)
                if inside:
                    continue
                whole = b"\n".join(held) if was else line
                whole = whole.removesuffix(b"\r")
                if crossing:
                    if pieces:
                        out.append((file, origin, None, start, whole))
                elif whole:
                    if not pieces:
                        out.append((file, start, row, start, whole))
                    row += 1
                held, crossing = [], False
            yield batch_of()
        left_open()
        yield batch_of()

    columns = lines.select("file", "start", "value", "begins_inside", "origin")
    return columns.mapInArrow(run, "file long, start long, row long, part long, value binary")


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file_path, start, row, value``: every record, with its file, its block and its number there.

    A field is quoted if a quote begins it; quotes inside are doubled. Records
    end at line feeds, also with a carriage return before, outside of quoted
    fields; blank lines are no records. A quote that is never closed makes one
    record of the rest of the file. Files may be empty. Texts are not decoded here.
    """
    lines = _lines(spark, path)
    states = written(_block_states(_block_ends(lines)), "csv-blocks")
    found = states.agg(F.count("*").alias("n"), F.count_if("begins_inside").alias("inside")).first()
    # The number of blocks is known: few are sent to all tasks, else lines meet them in a shuffle.
    sent = F.broadcast if found["n"] <= SENT_BLOCKS else lambda frame: frame
    placed = lines.join(sent(states), ["file", "start"])
    cut = _cut(placed, pieces=False).drop("part")
    if found["inside"] or states.where("opens").limit(1).count():
        parts = written(_cut(placed.where("begins_inside OR opens"), pieces=True), "csv-pieces")
        joined = F.array_sort(F.collect_list(F.struct("part", F.col("value").cast("string").alias("value"))))
        whole = parts.groupBy("file", "start").agg(F.max("row").alias("row"), F.array_join(joined["value"], "\n").cast("binary").alias("value"))
        cut = cut.unionByName(whole)
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file_path"))
    files = written(files.withColumn("file", F.xxhash64("file_path")), "csv-files")
    sent_files = F.broadcast if files.count() <= SENT_BLOCKS else lambda frame: frame
    return cut.join(sent_files(files), "file").select("file_path", "start", "row", F.col("value").cast("string").alias("value"))
