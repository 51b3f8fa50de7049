"""Queries that pass the posts through the readers and writers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodlark.operators import metrics
from moodlark.operators.features import with_filtered_words
from moodlark.plans import sql
from moodlark.plans.posts import labelled_posts, stored_predictions
from moodlark.plans.registry import query
from moodlark.schemas import POST_LONG_ID
from moodlark.sources import messages, posts_csv, published, stores
from moodlark.workspace import new_path, written

_POSTS = f"WITH {sql.POSTS}"
_ALL_POSTS = f"{_POSTS} SELECT id, source, target, tweet FROM posts"
_PREDICTIONS = f"{_POSTS}, {sql.PREDICTIONS}, {sql.tokens_cte()}"


@query("s1_csv_posts", _ALL_POSTS)
def csv_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "training-csv")
    posts_csv.write_posts(labelled_posts(spark, sf_dir), path)
    return posts_csv.read_posts(spark, path, POST_LONG_ID, line_breaks=True)


# The texts on one line each.
_FLAT = r"replace(replace(tweet, chr(10), ' '), chr(13), ' ')"


def _flat_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_posts(spark, sf_dir).withColumn("tweet", F.translate("tweet", "\n\r", "  "))


@query("s1_csv_posts_split", f"{_POSTS} SELECT id, source, target, {_FLAT} AS tweet FROM posts")
def csv_posts_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splittable form, which is the default: no line breaks in fields."""
    path = new_path(spark, "training-csv")
    posts_csv.write_posts(_flat_posts(spark, sf_dir), path)
    return posts_csv.read_posts(spark, path, POST_LONG_ID)


@query(
    "s1_csv_posts_compat",
    f"""{_POSTS} SELECT id, source, target, replace({_FLAT}, '"', '') AS tweet FROM posts""",
)
def csv_posts_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's own defaults, for texts without quotes."""
    path = new_path(spark, "training-csv")
    posts_csv.write_posts(_flat_posts(spark, sf_dir).withColumn("tweet", F.translate("tweet", '"', "")), path)
    return posts_csv.read_posts(spark, path, POST_LONG_ID, compat=True)


@query("s2_dashboard_csv_posts", _ALL_POSTS)
def dashboard_csv_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "dashboard-csv")
    posts_csv.write_posts(labelled_posts(spark, sf_dir), path, header=True)
    return posts_csv.read_dashboard_posts(spark, path, POST_LONG_ID, line_breaks=True)


@query(
    "s2_quarantined_rows",
    f"{_POSTS} SELECT target, count(*) FILTER (WHERE id % 7 <> 0) AS good, count(*) FILTER (WHERE id % 7 = 0) AS bad FROM posts GROUP BY target",
)
def quarantined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed and malformed rows by class, where every seventh post has an id that is no number."""
    path = new_path(spark, "dashboard-csv")
    broken = F.when(F.pmod("id", F.lit(7)) == 0, F.concat(F.lit("no "), "id")).otherwise(F.col("id").cast("string"))
    posts_csv.write_posts(labelled_posts(spark, sf_dir).withColumn("id", broken), path, header=True)
    good, bad = posts_csv.quarantine_dashboard_posts(spark, path, POST_LONG_ID, line_breaks=True)
    rows = good.select("target", F.lit(1).alias("good")).union(bad.select("target", F.lit(0)))
    return rows.groupBy("target").agg(F.sum("good").alias("good"), F.count_if(F.col("good") == 0).alias("bad"))


def replay_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts as a CSV in id order, read back with the position of each row."""
    path = new_path(spark, "pool-csv")
    posts_csv.write_posts(labelled_posts(spark, sf_dir).orderBy("id"), path)
    return posts_csv.read_replay_pool(spark, path, POST_LONG_ID, line_breaks=True)


@query(
    "s4_replay_pool",
    f"{_POSTS} SELECT row_number() OVER (ORDER BY id) - 1 AS idx, id, source, target, tweet FROM posts",
)
def positioned_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_pool(spark, sf_dir)


@query("s5_published_posts", _ALL_POSTS)
def published_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "topic")
    messages.publish(messages.to_messages(labelled_posts(spark, sf_dir)), {"path": path}, "parquet")
    return messages.parse_messages(spark.read.parquet(path), POST_LONG_ID)


_STORED = f"""{_PREDICTIONS}
SELECT 0::BIGINT AS batch_id, seq, tweet, array_to_string(words, ' : ') AS filtered_words, target, label, prediction
FROM predictions JOIN filtered USING (id)"""


def stored_twice(spark: SparkSession, sf_dir: str, times: int) -> DataFrame:
    posts = with_filtered_words(labelled_posts(spark, sf_dir))
    scored = stored_predictions(posts)
    path = new_path(spark, "predictions")
    for _ in range(times):
        stores.append_predictions(scored, path, batch_id=0, seq=F.col("seq"))
    stored = stores.read_predictions(spark, path).drop("scored_at")
    return stored.withColumn("filtered_words", F.array_join("filtered_words", " : "))


@query("s6_stored_predictions", _STORED)
def predictions_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_twice(spark, sf_dir, times=1)


@query("x5_replayed_batch", _STORED)
def replayed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that is delivered again leaves one copy."""
    return stored_twice(spark, sf_dir, times=2)


@query(
    "s6_merged_predictions",
    f"""{_PREDICTIONS}
    SELECT (CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE {published.BATCHES_IN_RANGE} END)::BIGINT AS batch_id, seq, tweet,
           array_to_string(words, ' : ') AS filtered_words, target, label, prediction
    FROM predictions JOIN filtered USING (id)""",
)
def merged_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, one of which comes twice; those of the finished range are merged."""
    scored = written(stored_predictions(with_filtered_words(labelled_posts(spark, sf_dir))), "scored")
    path = new_path(spark, "predictions")
    for batch_id, k in ((0, 0), (1, 1), (1, 1), (published.BATCHES_IN_RANGE, 2)):
        stores.append_predictions(scored.where(F.pmod("seq", F.lit(3)) == k), path, batch_id, F.col("seq"))
    published.merge(spark, path)
    stored = stores.read_predictions(spark, path).drop("scored_at")
    return stored.withColumn("filtered_words", F.array_join("filtered_words", " : "))


@query(
    "s7_stored_metrics",
    f"""{_POSTS}, {sql.PREDICTIONS}, {sql.F1},
    measured AS (SELECT printf('%.2f', accuracy)::DOUBLE AS accuracy, printf('%.2f', f1)::DOUBLE AS f1 FROM scores)
    SELECT *, 'first' AS model_id FROM measured UNION ALL SELECT *, 'second' AS model_id FROM measured""",
)
def metrics_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = metrics.rounded(metrics.evaluate(stored_predictions(labelled_posts(spark, sf_dir))))
    path = new_path(spark, "metrics")
    stores.append_metrics(measured, path, "first")
    # The second model's row has the values that were stored for the first: they are evaluated once.
    stores.append_metrics(stores.read_metrics(spark, path), path, "second")
    return stores.read_metrics(spark, path).select("accuracy", "f1", "model_id")
