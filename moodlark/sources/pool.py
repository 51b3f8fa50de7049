"""The replay pool stored by position, so that a draw reads little of it.

Rows lie in ranges of positions, each a folder with one file, sorted by
position. A few draws are looked up: only the folders of their ranges are
opened, and Parquet's statistics skip pages without a drawn position. What one
draw costs does not depend on the size of the pool.
"""

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS_IN_RANGE = 10_000
RANGES_IN_FOLDER = 1000
# Up to this many draws, or ranges, of one batch are named to the reader; beyond, the pool is read whole.
NAMED = 1000


@dataclass(frozen=True)
class Pool:
    path: str
    rows: int
    rows_in_range: int
    schema: StructType

    def folder(self, at: int) -> str:
        return f"{self.path}/rows/part={at // RANGES_IN_FOLDER}/range={at}"

    def read(self, spark: SparkSession, ranges: list[int] | None = None) -> DataFrame:
        """The rows of some ranges of positions, or all."""
        reader = spark.read.schema(self.schema)
        if ranges is None:
            return reader.parquet(f"{self.path}/rows").select(*self.schema.names)
        held = [self.folder(at) for at in sorted(ranges) if 0 <= at * self.rows_in_range < self.rows]
        return reader.parquet(*held) if held else spark.createDataFrame([], self.schema)

    def first(self, spark: SparkSession, n: int) -> DataFrame:
        """The rows at positions below ``n``."""
        ranges = list(range(-(-n // self.rows_in_range)))
        return self.read(spark, ranges if len(ranges) <= NAMED else None).where(F.col("idx") < n)

    def drawn(self, draws: DataFrame) -> DataFrame:
        """The rows that the draws in column ``draw`` select, each once; draw d is the row at position d - 1."""
        spark, position = draws.sparkSession, F.col("draw") - 1
        found = draws.select(position.alias("idx")).distinct().limit(NAMED + 1).collect()
        if len(found) <= NAMED:
            wanted = [row["idx"] for row in found if row["idx"] is not None]
            return self.read(spark, list({at // self.rows_in_range for at in wanted})).where(F.col("idx").isin(wanted))
        at = F.floor(position / self.rows_in_range).alias("at")
        ranges = [row["at"] for row in draws.select(at).distinct().limit(NAMED + 1).collect() if row["at"] is not None]
        return self.read(spark, ranges if len(ranges) <= NAMED else None)


def store_pool(rows: DataFrame, path: str, rows_in_range: int = ROWS_IN_RANGE) -> Pool:
    """Store rows with their position ``idx`` (from 0, without gaps) and return the pool."""
    at = F.floor(F.col("idx") / rows_in_range)
    placed = rows.withColumns({"part": F.floor(at / RANGES_IN_FOLDER), "range": at})
    dealt = placed.repartition("part", "range").sortWithinPartitions("part", "range", "idx")
    dealt.write.partitionBy("part", "range").parquet(f"{path}/rows")
    spark = rows.sparkSession
    n = spark.read.schema(rows.schema).parquet(f"{path}/rows").count()
    told = [(n, rows_in_range, rows.schema.json())]
    spark.createDataFrame(told, "rows long, rows_in_range long, fields string").coalesce(1).write.parquet(f"{path}/size")
    return open_pool(spark, path)


def open_pool(spark: SparkSession, path: str) -> Pool:
    """A pool that was stored before."""
    told = spark.read.parquet(f"{path}/size").first()
    return Pool(path, told["rows"], told["rows_in_range"], StructType.fromJson(json.loads(told["fields"])))


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether a pool was stored there to its end: its size is written last."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/size/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
