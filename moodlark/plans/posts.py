"""The labelled posts and the stored predictions, as views over the given tables.

Only the columns a query asks for are read: a count by class never touches
the text. Documents and labels meet on their unique id; the side that
Catalyst measures as small is broadcast, otherwise both are shuffled on it.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodlark.functions.lexicon import CLASS_NAMES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentiment(quality: Column, toxic: Column) -> Column:
    return (
        F.when((quality == 1) & (toxic == 0), "Positive")
        .when((quality == 0) & (toxic == 0), "Neutral")
        .when((quality == 1) & (toxic == 1), "Negative")
        .otherwise("Irrelevant")
    )


def _as_posts(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("id"),
        "source",
        F.lit(None).cast("string").alias("target"),
        F.col("text").alias("tweet"),
    )


def documents_as_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an unlabelled post."""
    return _as_posts(table(spark, sf_dir, "documents"))


def labelled_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry a label, with the label spelled as a class name."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        sentiment(F.col("quality"), F.col("toxic")).alias("target"),
    )
    joined = _as_posts(documents).drop("target").join(labels, "id")
    return joined.select("id", "source", "target", "tweet")


def class_index(target: Column) -> Column:
    """Index of a class name on the dashboard."""
    index = F.lit(None).cast("double")
    for position, name in enumerate(CLASS_NAMES):
        index = F.when(target == name, F.lit(float(position))).otherwise(index)
    return index


def stored_predictions(posts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Posts as prediction records, with a prediction made from class and id; ``keep`` names further columns."""
    label = class_index(F.col("target"))
    kept = [name for name in (*keep, "tweet", "filtered_words", "target") if name in posts.columns]
    return posts.select(
        *kept,
        label.alias("label"),
        F.pmod(label + F.pmod(F.pmod(F.col("id"), F.lit(5)), F.lit(2)), F.lit(4.0)).alias("prediction"),
        F.floor(F.col("id") / 50).alias("batch_id"),
        F.col("id").alias("seq"),
    )
