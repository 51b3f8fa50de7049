"""Places in an order, without a window over a whole group."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodlark.workspace import written


def placed(rows: DataFrame, group: str, order: Sequence[str], name: str = "place") -> DataFrame:
    """``rows`` with their place in their group, from 1.

    Rows are range-partitioned, so a group of any size spreads over many tasks;
    only counts by group and task are added up.
    """
    by = [group, *order]
    tagged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    stored = written(tagged, "placed-rows").withColumn("_part", F.shiftright("_row", 33))
    parts = stored.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = stored.join(written(shifts, "place-shifts"), [group, "_part"])
    return joined.select(*rows.columns, (F.col("_row") + F.col("_shift") + 1).alias(name))
