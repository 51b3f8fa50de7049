"""The two append-only result tables: predictions and model metrics."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moodlark.schemas import ARRIVAL, METRICS, PREDICTION
from moodlark.sources import published


def with_defaults(records: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Exactly the named fields; absent columns and nulls take the default."""
    present = set(records.columns)
    return records.select(
        *[
            (F.coalesce(F.col(name), default) if name in present else default).alias(name)
            for name, default in defaults.items()
        ]
    )


def arrival_order(records: DataFrame) -> list[str]:
    """The columns by which the records of one batch arrived, as far as they are there."""
    return [name for name in ARRIVAL if name in records.columns]


def append_predictions(
    scored: DataFrame, path: str, batch_id: int, seq: Column | None = None, scored_at: datetime | None = None
) -> int:
    """Store and publish one scored batch; the number of its records.

    A batch that is delivered again after a failure takes the place of its
    earlier copy in one step. ``seq`` numbers the records of the batch; without
    it they are numbered in order of arrival.
    """
    arrived = arrival_order(scored)
    if seq is None and arrived:
        scored = scored.orderBy(*arrived)
    order = F.monotonically_increasing_id() if seq is None else seq
    moment = F.current_timestamp() if scored_at is None else F.lit(scored_at)
    order_fields = ("seq", "scored_at", "batch_id")
    reported = [name for name in PREDICTION.names if name in scored.columns and name not in order_fields]
    batch = F.lit(batch_id).cast("long").alias("batch_id")
    return published.append(scored.select(*reported, order.cast("long").alias("seq"), moment.alias("scored_at"), batch), path, batch_id)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """All published predictions; none if there are none yet."""
    return published.read(spark, path, PREDICTION).select(*PREDICTION.names)


def read_newest_predictions(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The predictions of the last batches that hold ``n`` together: the others are not read."""
    return published.read(spark, path, PREDICTION, published.newest(spark, path, n)).select(*PREDICTION.names)


def stored_predictions_count(spark: SparkSession, path: str) -> int:
    """Number of published predictions, as the lists have it; no record is read."""
    return sum(entry.rows for entry in published.entries(spark, path))


def rejected_of(predictions_path: str) -> str:
    """Where the rejected posts of a predictions table are, unless the caller says otherwise."""
    return f"{predictions_path}/rejected"


def append_rejected(posts: DataFrame, path: str, batch_id: int) -> int:
    """Store and publish the posts of a batch that cannot be scored, in place of an earlier copy of it."""
    return published.append(posts, path, batch_id)


def read_rejected(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """All published rejected posts."""
    return published.read(spark, path, schema)


def append_metrics(metrics: DataFrame, path: str, model_id: str, trained_at: datetime | None = None) -> None:
    """Store one row with accuracy and F1 of a trained model."""
    moment = F.current_timestamp() if trained_at is None else F.lit(trained_at)
    row = metrics.select("accuracy", "f1", F.lit(model_id).alias("model_id"), moment.alias("trained_at"))
    row.write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).parquet(path)
