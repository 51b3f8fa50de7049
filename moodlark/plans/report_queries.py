"""Queries behind the dashboard: counts, shares, top words, feeds, metrics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from moodlark.functions.lexicon import CLASS_NAMES, DASHBOARD_STOP_WORDS
from moodlark.functions.text import display_words
from moodlark.operators import counts, feed, metrics, relational
from moodlark.operators.features import with_filtered_words
from moodlark.operators.model import class_name
from moodlark.operators.ranks import placed
from moodlark.operators.top_words import top_words
from moodlark.plans import sql
from moodlark.plans.posts import documents_as_posts, labelled_posts, stored_predictions, table
from moodlark.plans.registry import query
from moodlark.sources import published, stores
from moodlark.sources.messages import parse_messages, parsed
from moodlark.sources.pool import store_pool
from moodlark.sources.stores import with_defaults
from moodlark.workspace import new_path, written

PROPS = StructType([StructField("k", IntegerType())])

_POSTS = f"WITH {sql.POSTS}"
_PREDICTIONS = f"{_POSTS}, {sql.PREDICTIONS}"


@query("a1_entity_counts", f"{_POSTS} SELECT source, target, count(*) AS n FROM posts GROUP BY source, target")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_by_entity(labelled_posts(spark, sf_dir))


@query(
    "a2_entity_chart",
    f"""{_POSTS} SELECT source,
      nullif(count(*) FILTER (WHERE target = 'Positive'), 0) AS "Positive",
      nullif(count(*) FILTER (WHERE target = 'Neutral'), 0) AS "Neutral",
      nullif(count(*) FILTER (WHERE target = 'Negative'), 0) AS "Negative"
    FROM posts GROUP BY source""",
)
def entity_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.chart_by_entity(labelled_posts(spark, sf_dir))


@query(
    "a3_sentiment_shares",
    f"""{_POSTS} SELECT target, round(count(*) / sum(count(*)) OVER () * 100, 6) AS pct
    FROM posts GROUP BY target""",
)
def sentiment_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = counts.sentiment_shares(labelled_posts(spark, sf_dir))
    return shares.select("target", F.round("pct", 6).alias("pct"))


@query(
    "a4_top_words",
    f"""{_POSTS},
    tokenized AS (
      SELECT id, lower(target) AS sentiment, {sql.word_tokens("tweet")} AS tokens
      FROM posts WHERE lower(target) IN ('positive', 'negative', 'neutral')),
    placed AS (
      SELECT id, sentiment, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS place FROM tokenized),
    kept AS (
      SELECT * FROM placed
      WHERE regexp_full_match(word, '[a-zA-Z]+') AND word NOT IN ({sql.listed(DASHBOARD_STOP_WORDS)})),
    {sql.lemma_cte("kept")},
    counted AS (
      SELECT sentiment, lemma AS word, count(*) AS n, min((id, place)) AS first_seen
      FROM kept JOIN lemmas USING (word) GROUP BY sentiment, lemma)
    SELECT sentiment, word, n,
           row_number() OVER (PARTITION BY sentiment ORDER BY n DESC, first_seen)::INTEGER AS rank
    FROM counted QUALIFY rank <= 10""",
)
def top_words_by_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_words(labelled_posts(spark, sf_dir))


@query("a5_prediction_count", f"{_PREDICTIONS} SELECT count(*) AS predictions FROM predictions")
def prediction_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.prediction_count(stored_predictions(labelled_posts(spark, sf_dir)))


@query(
    "l1_first_rows",
    f"""{_POSTS} SELECT row_number() OVER (ORDER BY id)::INTEGER AS row_no, id, source, target, tweet
    FROM posts QUALIFY row_no <= 100""",
)
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.first_rows(labelled_posts(spark, sf_dir), "id")


@query(
    "l1_first_stored_rows",
    f"""{_POSTS} SELECT row_number() OVER (ORDER BY id)::INTEGER AS row_no, row_number() OVER (ORDER BY id) - 1 AS idx,
           id, source, target, tweet
    FROM posts QUALIFY row_no <= 100""",
)
def first_stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts stored by position; of them, only the first range is read."""
    one = labelled_posts(spark, sf_dir).withColumn("all", F.lit(0))
    rows = placed(one, "all", ["id"]).drop("all").withColumn("idx", F.col("place") - 1).drop("place")
    return feed.first_stored(spark, store_pool(rows, new_path(spark, "pool"))).select("row_no", "idx", "id", "source", "target", "tweet")


def _predictions_with_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_predictions(with_filtered_words(labelled_posts(spark, sf_dir)))


_WORDS = f"{_PREDICTIONS}, {sql.tokens_cte()}"


@query(
    "l2_prediction_feed",
    f"""{_WORDS} SELECT tweet, target, label, array_to_string(words, ' : ') AS filtered_words, prediction,
           batch_id, seq
    FROM predictions JOIN filtered USING (id) ORDER BY batch_id DESC, seq DESC""",
)
def prediction_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words are stored with the predictions, as the stream does; sorting does not tokenize again."""
    rows = feed.prediction_feed(written(_predictions_with_words(spark, sf_dir), "predictions"))
    return rows.withColumn("filtered_words", display_words(F.col("filtered_words")))


_NAMES = " ".join(f"WHEN {index} THEN '{name}'" for index, name in enumerate(CLASS_NAMES))


@query(
    "l3_newest_predictions",
    f"""{_WORDS},
    ranked AS (
      SELECT *, row_number() OVER (ORDER BY batch_id DESC, seq DESC) AS place, count(*) OVER () AS total
      FROM predictions)
    SELECT total - place + 1 AS row_no, array_to_string(words, ' : ') AS features, target, label, prediction,
           CASE prediction::INTEGER {_NAMES} END AS predicted_name
    FROM ranked JOIN filtered USING (id) WHERE place <= 5""",
)
def newest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the newest posts are tokenized; a stored table would hold their words."""
    predictions = stored_predictions(labelled_posts(spark, sf_dir))
    newest = with_filtered_words(feed.newest_rows(predictions))
    return feed.newest_predictions(newest, total=predictions.agg(F.count("*")).scalar())


@query(
    "l3_newest_stored_predictions",
    f"""{_WORDS},
    ranked AS (SELECT *, row_number() OVER (ORDER BY seq DESC) AS place, count(*) OVER () AS total FROM predictions)
    SELECT total - place + 1 AS row_no, array_to_string(words, ' : ') AS features, target, label, prediction,
           CASE prediction::INTEGER {_NAMES} END AS predicted_name
    FROM ranked JOIN filtered USING (id) WHERE place <= 5""",
)
def newest_stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All predictions stored in four batches, the first ones merged; of them, the last batches are read."""
    predictions = written(_predictions_with_words(spark, sf_dir), "predictions")
    quarter = (predictions.agg(F.max("seq")).first()[0] or 0) // 4 + 1
    path = new_path(spark, "predictions")
    for k, batch_id in enumerate((0, 1, published.BATCHES_IN_RANGE, published.BATCHES_IN_RANGE + 1)):
        stores.append_predictions(predictions.where(F.floor(F.col("seq") / quarter) == k), path, batch_id, F.col("seq"))
    published.merge(spark, path)
    return feed.newest_stored(spark, path)


_METRICS_BY_SOURCE = """whole AS (SELECT p.source, q.* FROM posts p JOIN predictions q USING (id)),
classes AS (SELECT DISTINCT source, unnest([label, prediction]) AS class FROM whole),
per_class AS (
  SELECT c.source, class, count(*) FILTER (WHERE label = class) AS actual,
         count(*) FILTER (WHERE prediction = class) AS predicted,
         count(*) FILTER (WHERE label = class AND prediction = class) AS hit
  FROM classes c JOIN whole USING (source) GROUP BY c.source, class),
history AS (
  SELECT source AS model_id, sum(2.0::DOUBLE * hit / (actual + predicted) * actual) / sum(actual) AS f1,
         sum(hit) / sum(actual) AS accuracy
  FROM per_class GROUP BY source),
dated AS (SELECT source AS model_id, max(id) AS trained_at FROM posts GROUP BY source)"""


@query(
    "l4_latest_metrics",
    f"""{_PREDICTIONS}, {_METRICS_BY_SOURCE}
    SELECT round(accuracy, 6) AS accuracy, round(f1, 6) AS f1
    FROM history JOIN dated USING (model_id) ORDER BY trained_at DESC, model_id DESC LIMIT 1""",
)
def latest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest of one record per source, as if each had trained a model of its own."""
    scored = stored_predictions(labelled_posts(spark, sf_dir), keep=("source",))
    counted = scored.groupBy("source", "label", "prediction").agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    # Some rows for each source, read for the metrics and for the dates.
    confusion = written(counted, "confusion")
    dated = confusion.groupBy(F.col("source").alias("model_id")).agg(F.max("last").alias("trained_at"))
    measured = metrics.metrics_of(confusion, "source").withColumnRenamed("source", "model_id")
    newest = feed.latest_metrics(measured.join(dated, "model_id"))
    return newest.select(F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


_HITS = "avg((label = prediction)::INT::DOUBLE)"


@query("m10_accuracy", f"{_PREDICTIONS} SELECT round({_HITS}, 6) AS accuracy FROM predictions")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = metrics.evaluate(stored_predictions(labelled_posts(spark, sf_dir)))
    return measured.select(F.round("accuracy", 6).alias("accuracy"))


@query("m11_weighted_f1", f"{_PREDICTIONS}, {sql.F1} SELECT round(f1, 6) AS f1 FROM scores")
def weighted_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = metrics.evaluate(stored_predictions(labelled_posts(spark, sf_dir)))
    return measured.select(F.round("f1", 6).alias("f1"))


@query(
    "m12_rounded_metrics",
    f"""{_PREDICTIONS}, {sql.F1}
    SELECT printf('%.2f', accuracy)::DOUBLE AS accuracy, printf('%.2f', f1)::DOUBLE AS f1 FROM scores""",
)
def rounded_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rounded(metrics.evaluate(stored_predictions(labelled_posts(spark, sf_dir))))


@query(
    "m13_class_names",
    f"""{_PREDICTIONS}
    SELECT id, prediction, CASE prediction::INTEGER {_NAMES} END AS predicted_name FROM predictions""",
)
def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = stored_predictions(labelled_posts(spark, sf_dir))
    return predictions.select(
        F.col("seq").alias("id"), "prediction", class_name(F.col("prediction")).alias("predicted_name")
    )


@query(
    "p1_parsed_props",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
)
def parsed_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", parsed(F.col("props").cast("binary"), PROPS)["k"].alias("k"))


@query("p2_flattened_messages", "SELECT event_type, user_id, value FROM events")
def flattened_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON messages, parsed and spread over columns again."""
    events = table(spark, sf_dir, "events")
    messages = events.select(F.to_json(F.struct("event_type", "user_id", "value")).alias("value"))
    schema = events.select("event_type", "user_id", "value").schema
    return parse_messages(messages, schema)


@query(
    "p3_posts_with_text",
    """SELECT event_id AS id, props AS source, event_type AS tweet FROM events WHERE event_type <> 'error'""",
)
def posts_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts; the errors among them carry no text and are dropped."""
    text = F.nullif(F.col("event_type"), F.lit("error")).alias("tweet")
    posts = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("source"), text)
    return relational.with_text(posts)


@query(
    "p5_charted_posts",
    f"{_POSTS} SELECT id, source, target, tweet FROM posts WHERE target <> 'Irrelevant'",
)
def charted_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.charted(labelled_posts(spark, sf_dir))


@query(
    "p6_record_defaults",
    """SELECT d.doc_id AS id, coalesce(l.quality::DOUBLE, 0.0::DOUBLE) AS accuracy, 0.0::DOUBLE AS f1,
           d.source AS target, '' AS prediction
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def record_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its label if it has one; null and absent fields take defaults."""
    documents = documents_as_posts(spark, sf_dir).select("id", F.col("source").alias("target"))
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("accuracy")
    )
    defaults = {
        "id": F.col("id"),
        "target": F.lit(""),
        "prediction": F.lit(""),
        "accuracy": F.lit(0.0),
        "f1": F.lit(0.0),
    }
    return with_defaults(documents.join(labels, "id", "left"), defaults)
