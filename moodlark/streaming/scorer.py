"""Score a stream of posts and store the results."""

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from moodlark.operators.model import score
from moodlark.operators.relational import stored_report, without_text
from moodlark.sources.stores import append_predictions, append_rejected, read_predictions, rejected_of
from moodlark.streaming.dashboard import SHOWN, append_summary

logger = logging.getLogger(__name__)

Scorer = Callable[[DataFrame], DataFrame]


def model_scorer(model, strict: bool = False) -> Scorer:
    return lambda posts: stored_report(score(model, posts, strict), *posts.columns)


def process_batch(
    posts: DataFrame,
    batch_id: int,
    scorer: Scorer,
    predictions_path: str,
    summaries_path: str | None = None,
    seq: Column | None = None,
    rejected_path: str | None = None,
    shown: int = SHOWN,
) -> None:
    """Score one micro-batch and store it under its id; skip it if it is empty.

    The source is read once: the batch is kept on the executors while it is
    counted, scored and sorted out. Executors write the rows, and the dashboard
    summary is made from the rows just written. Posts without text cannot be
    scored; they go to ``rejected_path``, by default a table beside the
    predictions, so no post is lost. A failure stops the query; after the
    restart the same batch takes the place of whatever was stored for it.
    """
    kept = posts.persist()
    try:
        found = kept.agg(F.count("*").alias("posts"), F.count("tweet").alias("texts")).first()
        if not found["posts"]:
            logger.info("batch %s is empty", batch_id)
            return
        append_predictions(scorer(kept), predictions_path, batch_id, seq)
        if found["texts"] < found["posts"]:
            append_rejected(without_text(kept), rejected_path or rejected_of(predictions_path), batch_id)
        if summaries_path is not None:
            append_summary(posts.sparkSession, predictions_path, summaries_path, batch_id, shown)
    except Exception:
        logger.exception("batch %s failed", batch_id)
        raise
    finally:
        kept.unpersist()


def start_scoring(
    posts: DataFrame,
    scorer: Scorer,
    predictions_path: str,
    checkpoint: str,
    summaries_path: str | None = None,
    seq: Column | None = None,
    output_mode: str = "update",
    trigger: dict | None = None,
    rejected_path: str | None = None,
    shown: int = SHOWN,
) -> StreamingQuery:
    """Start the scoring stream.

    The query keeps no state, so output modes ``update`` and ``append`` do the
    same. ``trigger`` takes the arguments of ``DataStreamWriter.trigger``.
    """
    writer = (
        posts.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(
            lambda batch, batch_id: process_batch(
                batch, batch_id, scorer, predictions_path, summaries_path, seq, rejected_path, shown
            )
        )
    )
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()


def score_available(
    spark: SparkSession,
    posts: DataFrame,
    scorer: Scorer,
    predictions_path: str,
    checkpoint: str,
    summaries_path: str | None = None,
    seq: Column | None = None,
    **options,
) -> DataFrame:
    """Score everything the source holds now and return the stored predictions.

    ``options`` are those of ``start_scoring``.
    """
    options = {"trigger": {"availableNow": True}, **options}
    query = start_scoring(posts, scorer, predictions_path, checkpoint, summaries_path, seq, **options)
    query.awaitTermination()
    return read_predictions(spark, predictions_path)


def _done(query: StreamingQuery) -> int:
    """Batches that the query has finished; while it idles, its progress names the next one."""
    progress = query.lastProgress
    if progress is None:
        return 0
    return progress["batchId"] + (1 if progress["numInputRows"] else 0)


def wait_for(query: StreamingQuery, batches: int, poll_seconds: float = 0.2) -> None:
    """Return when a running stream has done so many batches, or has ended."""
    while query.isActive and _done(query) < batches:
        query.awaitTermination(poll_seconds)


def stop_after(query: StreamingQuery, batches: int, poll_seconds: float = 0.2) -> None:
    """Let a running stream go on until it has done so many batches, then stop it."""
    wait_for(query, batches, poll_seconds)
    query.stop()
