"""Queries that run a stream over the given tables until it has read them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from moodlark.operators.features import TOKENS, with_filtered_words
from moodlark.operators.ranks import placed
from moodlark.plans import sql
from moodlark.plans.model_queries import SPLIT, trained
from moodlark.plans.posts import labelled_posts, stored_predictions, table
from moodlark.plans.registry import query
from moodlark.plans.report_queries import PROPS
from moodlark.plans.source_queries import replay_pool
from moodlark.schemas import POST_LONG_ID
from moodlark.sources import messages
from moodlark.sources.pool import store_pool
from moodlark.sources.stores import read_predictions, read_rejected, rejected_of
from moodlark.streaming import dashboard, replay, scorer
from moodlark.workspace import new_path

_POSTS = f"WITH {sql.POSTS}"


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    options = {"path": sf_dir, "pathGlobFilter": "events.parquet"}
    return messages.subscribe(spark, options, "parquet", schema)


def _finished(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream into a table until the source is read, and return the table."""
    path = new_path(spark, name)
    writer = messages.publish_stream(stream, {"path": path}, new_path(spark, f"{name}-log"), "parquet")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("s3_subscribed_events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def subscribed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events_stream(spark, sf_dir)
    parsed = events.select("event_id", messages.parsed(F.col("props"), PROPS)["k"].alias("k"))
    return _finished(spark, parsed, "subscribed")


def _message_stream(spark: SparkSession, posts: DataFrame) -> DataFrame:
    """Posts published as messages and read back as a stream of posts."""
    topic = new_path(spark, "topic")
    messages.publish(messages.to_messages(posts), {"path": topic}, "parquet")
    return messages.parse_messages(messages.subscribe(spark, {"path": topic}, "parquet", messages.MESSAGE), POST_LONG_ID)


@query(
    "x1_scored_stream",
    f"""{_POSTS}, {SPLIT}, {sql.tokens_cte()}
    SELECT tweet, target, label, array_to_string(words, ' : ') AS filtered_words, true AS scored
    FROM posts JOIN labels_of USING (target) JOIN filtered USING (id)""",
)
def scored_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All posts scored as a stream; the prediction itself is only checked to be a class."""
    model = trained(spark, sf_dir, TOKENS).model
    stored = scorer.score_available(
        spark,
        _message_stream(spark, labelled_posts(spark, sf_dir)),
        scorer.model_scorer(model),
        new_path(spark, "predictions"),
        new_path(spark, "scoring-log"),
    )
    return stored.select(
        "tweet",
        "target",
        "label",
        F.array_join("filtered_words", " : ").alias("filtered_words"),
        F.col("prediction").isin(0.0, 1.0, 2.0, 3.0).alias("scored"),
    )


BATCHES = 3


class _Topic:
    """A folder of messages to which the posts are sent in so many batches, by id, in files as they come.

    Messages carry their id as offset, as a broker's messages carry theirs.
    """

    def __init__(self, spark: SparkSession, posts: DataFrame) -> None:
        self.spark, self.posts, self.path = spark, posts, new_path(spark, "topic")

    def send(self, batch: int) -> None:
        body = F.to_json(F.struct("id", "source", "target", "tweet"), {"ignoreNullFields": "false"})
        sent = self.posts.where(F.pmod("id", F.lit(BATCHES)) == batch).select(body.alias("value"), F.col("id").alias("offset"))
        messages.publish_batch(sent, batch, {"path": self.path}, "parquet")

    def stream(self) -> DataFrame:
        schema = StructType([*messages.MESSAGE.fields, StructField("offset", LongType())])
        return messages.parse_messages(messages.subscribe(self.spark, {"path": self.path}, "parquet", schema), POST_LONG_ID)


def _scored_by_batches(spark: SparkSession, posts: DataFrame, scoring: scorer.Scorer, **options) -> str:
    """Send and score batch after batch under one checkpoint; the path of the predictions."""
    topic, path, log = _Topic(spark, posts), new_path(spark, "predictions"), new_path(spark, "scoring-log")
    kept = options.pop("kept", None)
    for batch in range(BATCHES):
        topic.send(batch)
        arrived = topic.stream()
        scorer.score_available(spark, arrived if kept is None else arrived.where(kept), scoring, path, log, **options)
    return path


@query(
    "x1_arrival_order",
    f"""{_POSTS}
    SELECT id % {BATCHES} AS batch, row_number() OVER (PARTITION BY id % {BATCHES} ORDER BY id)::BIGINT AS place, target
    FROM posts""",
)
def arrival_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of three batches with their place in the batch, which is the order of arrival."""
    path = _scored_by_batches(spark, labelled_posts(spark, sf_dir), _known_scorer_by_arrival)
    scored = read_predictions(spark, path).select("batch_id", "seq", "target")
    return placed(scored, "batch_id", ["seq"]).select(F.col("batch_id").alias("batch"), "place", "target")


def _known_scorer_by_arrival(posts: DataFrame) -> DataFrame:
    return stored_predictions(with_filtered_words(posts), keep=("offset",)).drop("seq", "batch_id")


@query(
    "p7_empty_batches",
    f"""{_POSTS} SELECT count(*) AS predictions, {BATCHES - 1}::BIGINT AS batches FROM posts WHERE id % {BATCHES} <> 1""",
)
def empty_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the batches is empty after a filter: it is skipped and stores nothing."""
    kept = F.pmod("id", F.lit(BATCHES)) != 1
    path = _scored_by_batches(spark, labelled_posts(spark, sf_dir), _known_scorer, seq=F.col("id"), kept=kept)
    return read_predictions(spark, path).agg(F.count("*").alias("predictions"), F.count_distinct("batch_id").alias("batches"))


@query(
    "x1_rejected_posts",
    f"""{_POSTS} SELECT target, count(*) FILTER (WHERE id % 3 <> 0) AS scored, count(*) FILTER (WHERE id % 3 = 0) AS rejected
    FROM posts GROUP BY target""",
)
def rejected_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third post has no text: it goes to the table of rejected posts."""
    posts = labelled_posts(spark, sf_dir).withColumn("tweet", F.when(F.pmod("id", F.lit(3)) != 0, F.col("tweet")))
    path = new_path(spark, "predictions")
    stored = scorer.score_available(spark, _message_stream(spark, posts), _known_scorer, path, new_path(spark, "scoring-log"), seq=F.col("id"))
    rejected = read_rejected(spark, rejected_of(path))
    both = stored.select("target", F.lit(1).alias("scored")).union(rejected.select("target", F.lit(0)))
    return both.groupBy("target").agg(F.sum("scored").alias("scored"), F.count_if(F.col("scored") == 0).alias("rejected"))


@query(
    "x4_output_modes",
    f"{_POSTS}, modes(mode) AS (VALUES ('append'), ('update')) SELECT mode, target, count(*) AS n FROM posts CROSS JOIN modes GROUP BY mode, target",
)
def output_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both output modes store the same."""
    stored = []
    for mode in ("append", "update"):
        path = _scored_by_batches(spark, labelled_posts(spark, sf_dir), _known_scorer, seq=F.col("id"), output_mode=mode)
        stored.append(read_predictions(spark, path).select(F.lit(mode).alias("mode"), "target"))
    return stored[0].union(stored[1]).groupBy("mode", "target").agg(F.count("*").alias("n"))


@query(
    "x6_stopped_stream",
    f"""{_POSTS} SELECT count(*) AS predictions, true AS stopped_between, 0::BIGINT AS twice FROM posts""",
)
def stopped_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that is stopped after its first batch and started again stores every post once."""
    topic, path, log = _Topic(spark, labelled_posts(spark, sf_dir)), new_path(spark, "predictions"), new_path(spark, "scoring-log")
    topic.send(0)
    first = scorer.start_scoring(topic.stream(), _known_scorer, path, log, seq=F.col("id"), trigger=replay.pace(0.5))
    scorer.stop_after(first, 1)
    stopped = not first.isActive
    for batch in range(1, BATCHES):
        topic.send(batch)
    stored = scorer.score_available(spark, topic.stream(), _known_scorer, path, log, seq=F.col("id"))
    by_seq = stored.groupBy("seq").agg(F.count("*").alias("n"))
    return by_seq.agg(F.sum("n").alias("predictions"), F.lit(stopped).alias("stopped_between"), F.count_if(F.col("n") > 1).alias("twice"))


PACE_SECONDS = 1.0


@query("x3_paced_batches", f"{_POSTS} SELECT count(*) AS predictions, true AS paced FROM posts")
def paced_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches start as far apart as the pace says (or more, if they take longer)."""
    topic, path = _Topic(spark, labelled_posts(spark, sf_dir)), new_path(spark, "predictions")
    topic.send(0)
    running = scorer.start_scoring(
        topic.stream(), _known_scorer, path, new_path(spark, "scoring-log"), seq=F.col("id"), trigger=replay.pace(PACE_SECONDS)
    )
    for batch in range(1, BATCHES):
        scorer.wait_for(running, batch)
        topic.send(batch)
    scorer.stop_after(running, BATCHES)
    stored = read_predictions(spark, path)
    starts = stored.groupBy("batch_id").agg(F.min("scored_at").alias("at"))
    span = F.max(F.col("at").cast("double")) - F.min(F.col("at").cast("double"))
    # A trigger fires on multiples of the pace, so the first batch may start late within its interval.
    least = (BATCHES - 2) * PACE_SECONDS
    paced = starts.agg((span >= least).alias("paced")).scalar()
    return stored.agg(F.count("*").alias("predictions")).select("predictions", paced.alias("paced"))


def _known_scorer(posts: DataFrame) -> DataFrame:
    return stored_predictions(with_filtered_words(posts)).drop("batch_id").withColumnRenamed("seq", "id")


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries that a stream with a fixed prediction leaves for the dashboard."""
    path = new_path(spark, "summaries")
    scorer.score_available(
        spark,
        _message_stream(spark, labelled_posts(spark, sf_dir)),
        _known_scorer,
        new_path(spark, "predictions"),
        new_path(spark, "scoring-log"),
        summaries_path=path,
        seq=F.col("id"),
    )
    return dashboard.read_summaries(spark, path)


@query("x7_dashboard_count", f"{_POSTS} SELECT count(*) AS predictions FROM posts")
def dashboard_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.shown_count(_summaries(spark, sf_dir))


@query(
    "x7_dashboard_newest",
    f"""{_POSTS}, {sql.PREDICTIONS}, {sql.tokens_cte()},
    ranked AS (
      SELECT *, row_number() OVER (ORDER BY seq DESC) AS place, count(*) OVER () AS total FROM predictions)
    SELECT total - place + 1 AS row_no, array_to_string(words, ' : ') AS features, target, label, prediction
    FROM ranked JOIN filtered USING (id) WHERE place <= 5""",
)
def dashboard_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.shown_newest(_summaries(spark, sf_dir)).drop("predicted_name")


SEED = 11


def _draw_sql(compat: bool) -> str:
    lowest, count = ("0", "rows + 1") if compat else ("1", "rows")
    return f"""draws AS (
  SELECT event_id, (event_id * {replay.DRAW_MULTIPLIER} + {SEED}) % ({count}) + {lowest} AS draw
  FROM events, (SELECT count(*) AS rows FROM posts)),
pool AS (SELECT row_number() OVER (ORDER BY id) AS draw, source, target, tweet FROM posts)"""


@query(
    "x2_replayed_posts",
    f"""{_POSTS}, {_draw_sql(compat=False)}
    SELECT draw AS id, source, target, {sql.cleaned("tweet")} AS tweet FROM draws JOIN pool USING (draw)""",
)
def replayed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per event, drawn from all posts: stream, join, publish, parse."""
    return _replayed(spark, sf_dir, compat=False)


_SHOWN = """shown AS (
  SELECT draw, source, target, replace(replace(replace(tweet, chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r') AS line
  FROM pool),
sent AS (
  SELECT draw, source, target, CASE WHEN length(line) >= 50 THEN left(line, 46) || '...' ELSE line END AS line
  FROM shown)"""


@query(
    "x2_replayed_posts_compat",
    f"""{_POSTS}, {_draw_sql(compat=True)}, {_SHOWN}
    SELECT draw AS id, coalesce(source, ')') AS source, coalesce(target, ')') AS target,
           coalesce({sql.cleaned("line")}, 'series') AS tweet
    FROM draws LEFT JOIN sent USING (draw)""",
)
def replayed_posts_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with shortened texts and with the record for the draw that selects no row."""
    return _replayed(spark, sf_dir, compat=True)


def _replayed(spark: SparkSession, sf_dir: str, compat: bool) -> DataFrame:
    pool = store_pool(replay_pool(spark, sf_dir), new_path(spark, "pool"))
    draw = replay.modular_draw(F.col("event_id"), SEED, pool.rows, compat)
    drawn = _events_stream(spark, sf_dir).select(draw.alias("draw"))
    topic = new_path(spark, "replayed")
    writer = replay.replay_stream(drawn, pool, {"path": topic}, new_path(spark, "replayed-log"), "parquet", compat)
    writer.trigger(availableNow=True).start().awaitTermination()
    return messages.parse_messages(spark.read.schema(messages.MESSAGE).parquet(topic), POST_LONG_ID)
