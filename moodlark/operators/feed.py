"""First rows, newest predictions, latest metrics."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodlark.functions.text import display_words
from moodlark.operators.model import class_name
from moodlark.sources.pool import Pool
from moodlark.sources.stores import read_newest_predictions, stored_predictions_count, with_defaults


def feed_defaults() -> dict[str, Column]:
    """Absent texts read as empty, absent numbers stay null."""
    no_number = F.lit(None).cast("double")
    return {
        "tweet": F.lit(""),
        "target": F.lit(""),
        "label": no_number,
        "filtered_words": F.array().cast("array<string>"),
        "prediction": no_number,
    }


def metrics_defaults() -> dict[str, Column]:
    return {"accuracy": F.lit(0.0), "f1": F.lit(0.0)}


def first_rows(posts: DataFrame, position: str = "idx", n: int = 100) -> DataFrame:
    """The first ``n`` posts by position, numbered from 1.

    Each task keeps its own first ``n``; only the final ``n`` are numbered.
    """
    head = posts.orderBy(position).limit(n)
    return head.select(F.row_number().over(Window.orderBy(position)).alias("row_no"), *posts.columns)


def first_stored(spark: SparkSession, pool: Pool, n: int = 100) -> DataFrame:
    """The first ``n`` rows of a table that is stored by position: only they are read."""
    return first_rows(pool.first(spark, n), "idx", n)


def _feed_rows(predictions: DataFrame) -> DataFrame:
    order = {"batch_id": F.col("batch_id"), "seq": F.col("seq")}
    return with_defaults(predictions, {**feed_defaults(), **order})


def newest_first() -> list[Column]:
    return [F.desc("batch_id"), F.desc("seq")]


def prediction_feed(predictions: DataFrame) -> DataFrame:
    """All predictions, newest first, with every reported field present."""
    return _feed_rows(predictions).orderBy(*newest_first())


def newest_rows(predictions: DataFrame, n: int = 5) -> DataFrame:
    return predictions.orderBy(*newest_first()).limit(n)


def newest_predictions(predictions: DataFrame, n: int = 5, total: Column | None = None) -> DataFrame:
    """The newest ``n`` predictions as shown, numbered down from the total.

    The total is a scalar subquery unless the caller has it from elsewhere.
    """
    if total is None:
        total = predictions.agg(F.count("*")).scalar()
    rank = F.row_number().over(Window.orderBy(*newest_first()))
    return _feed_rows(newest_rows(predictions, n)).select(
        (total - rank + 1).alias("row_no"),
        display_words(F.col("filtered_words")).alias("features"),
        "target",
        "label",
        "prediction",
        class_name(F.col("prediction")).alias("predicted_name"),
    )


def newest_stored(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """The newest ``n`` predictions of a stored table, as shown.

    Only the last batches that hold ``n`` are read, and the total is known from
    the table's lists, so the time does not depend on the size of the table.
    """
    total = F.lit(stored_predictions_count(spark, path)).cast("long")
    return newest_predictions(read_newest_predictions(spark, path, n), n, total)


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """Accuracy and F1 of the last model that was trained; no row if there is none."""
    newest = metrics.orderBy(F.desc("trained_at"), F.desc("model_id")).limit(1)
    return with_defaults(newest, metrics_defaults())
