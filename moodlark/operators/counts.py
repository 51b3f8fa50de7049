"""Counts by entity and sentiment, shares, and the number of predictions."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodlark.functions.lexicon import CHART_COLUMNS


def count_by_entity(posts: DataFrame) -> DataFrame:
    """Posts per (source, target), spelled as they are.

    Each task counts its own rows first, so a source with a third of all
    posts sends a handful of partial counts, not its rows.
    """
    return posts.groupBy("source", "target").agg(F.count("*").alias("n"))


def chart_by_entity(posts: DataFrame) -> DataFrame:
    """One row per source with a column per charted sentiment; null where it has none."""
    counts = [
        F.nullif(F.count_if(F.col("target") == name), F.lit(0)).alias(name) for name in CHART_COLUMNS
    ]
    return posts.groupBy("source").agg(*counts)


def sentiment_shares(posts: DataFrame) -> DataFrame:
    """Percentage of each sentiment among all posts.

    The window sees the counted classes only, one row each.
    """
    counted = posts.groupBy("target").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counted.select("target", (F.col("n") / total * 100).alias("pct"))


def prediction_count(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.count("*").alias("predictions"))
