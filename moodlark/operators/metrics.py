"""Accuracy and class-weighted F1 from one pass over the scored posts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def metrics_of(confusion: DataFrame, *by: str) -> DataFrame:
    """One row with accuracy and with F1 weighted by class size, or one for each value of ``by``.

    Works on the counted (label, prediction) pairs only, a few rows in all.
    """
    as_label = F.struct(
        F.col("label").alias("class"),
        F.col("n").alias("actual"),
        F.lit(0).cast("long").alias("predicted"),
        F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"),
    )
    as_prediction = F.struct(
        F.col("prediction").alias("class"),
        F.lit(0).cast("long").alias("actual"),
        F.col("n").alias("predicted"),
        F.lit(0).cast("long").alias("hit"),
    )
    by_class = (
        confusion.select(*by, F.explode(F.array(as_label, as_prediction)).alias("part"))
        .groupBy(*by, "part.class")
        .agg(*[F.sum(f"part.{name}").alias(name) for name in ("actual", "predicted", "hit")])
    )
    f1 = 2 * F.col("hit") / (F.col("actual") + F.col("predicted"))
    return by_class.groupBy(*by).agg(
        (F.sum("hit") / F.sum("actual")).alias("accuracy"),
        (F.sum(f1 * F.col("actual")) / F.sum("actual")).alias("f1"),
    )


def round_half_even(value: Column) -> Column:
    """Two places, as Python rounds: by the exact binary value, ties to even."""
    return F.call_function("format_number", value, F.lit("0.00")).cast("double")


def rounded(metrics: DataFrame) -> DataFrame:
    return metrics.select(*[round_half_even(F.col(name)).alias(name) for name in ("accuracy", "f1")])


def evaluate(scored: DataFrame) -> DataFrame:
    return metrics_of(confusion_counts(scored))
