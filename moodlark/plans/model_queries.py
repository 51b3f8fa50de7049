"""Queries on features, labels, the split, training and scoring."""

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodlark.operators import features, metrics, relational
from moodlark.operators import model as classifier
from moodlark.plans import sql
from moodlark.plans.posts import labelled_posts
from moodlark.plans.registry import query
from moodlark.workspace import new_path, written

_POSTS = f"WITH {sql.POSTS}"
_TOKENS = f"{_POSTS}, {sql.tokens_cte()}"
_TOKEN_COUNTS = f"""{_TOKENS},
terms AS (SELECT id, unnest(tk) AS term FROM tokens),
counts AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY id, term)"""
_BIGRAM_COUNTS = f"""{_TOKENS},
terms AS (SELECT id, unnest(ngrams) AS term FROM pairs),
counts AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY id, term)"""
_IDF = """weights AS (
  SELECT term, count(*) AS df, ln(((SELECT count(*) FROM posts) + 1)::DOUBLE / (count(*) + 1)) AS idf
  FROM counts GROUP BY term)"""


@query("m1_bigram_counts", f"{_BIGRAM_COUNTS} SELECT id, term, tf FROM counts")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.term_counts(features.with_bigrams(labelled_posts(spark, sf_dir)), features.BIGRAMS)


@query("m2_token_counts", f"{_TOKEN_COUNTS} SELECT id, term, tf FROM counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.term_counts(features.with_tokens(labelled_posts(spark, sf_dir)), features.TOKENS)


@query("m2_token_vectors", f"{_TOKEN_COUNTS} SELECT id, term, tf::DOUBLE AS tf FROM counts")
def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each post's vector of all its tokens."""
    vectors = features.term_vectors(features.with_tokens(labelled_posts(spark, sf_dir)), features.TOKENS)
    return features.opened(vectors).withColumn("tf", F.col("tf").cast("double"))


def _vocabulary_sql(size: int) -> str:
    return f"""{_TOKEN_COUNTS}, corpus AS (SELECT term, sum(tf)::BIGINT AS n FROM counts GROUP BY term)
    SELECT term, n FROM corpus ORDER BY n DESC, term LIMIT {size}"""


def _vocabulary(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    corpus = features.corpus_counts(features.with_tokens(labelled_posts(spark, sf_dir)), features.TOKENS)
    return features.capped_vocabulary(corpus, size)


@query("m3_capped_vocabulary", _vocabulary_sql(classifier.STORED_VOCABULARY))
def capped_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir, classifier.STORED_VOCABULARY)


SMALL_VOCABULARY = 1000


@query("m3_small_vocabulary", _vocabulary_sql(SMALL_VOCABULARY))
def small_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap that cuts most terms at any size of the tables."""
    return _vocabulary(spark, sf_dir, SMALL_VOCABULARY)


@query("m4_idf_weights", f"{_TOKEN_COUNTS}, {_IDF} SELECT term, df, round(idf, 6) AS idf FROM weights")
def idf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = labelled_posts(spark, sf_dir)
    counts = features.term_counts(features.with_tokens(posts), features.TOKENS)
    return features.idf_weights(counts, posts).select("term", "df", F.round("idf", 6).alias("idf"))


_WEIGHTED = f"{_TOKEN_COUNTS}, {_IDF}"


@query(
    "m4_tf_idf",
    f"{_WEIGHTED} SELECT id, term, tf, round(tf * idf, 6) AS tfidf FROM counts JOIN weights USING (term)",
)
def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = labelled_posts(spark, sf_dir)
    counts = features.term_counts(features.with_tokens(posts), features.TOKENS)
    return features.tf_idf(counts, posts).select("id", "term", "tf", F.round("tfidf", 6).alias("tfidf"))


@query(
    "m4_tf_idf_vectors",
    f"{_WEIGHTED} SELECT id, term, round(tf * idf, 6) AS tfidf FROM counts JOIN weights USING (term)",
)
def tf_idf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each post's vector of weights."""
    posts = labelled_posts(spark, sf_dir)
    counts = features.term_counts(features.with_tokens(posts), features.TOKENS)
    entries = features.opened(features.tf_idf_vectors(features.tf_idf(counts, posts)))
    return entries.select("id", "term", F.round("tfidf", 6).alias("tfidf"))


_GAPS = f"""WITH {sql.POSTS.replace("posts AS", "whole AS", 1)},
posts AS (SELECT id, source, target, CASE WHEN id % 3 <> 0 THEN tweet END AS tweet FROM whole)"""


@query(
    "m4_idf_weights_with_gaps",
    f"""{_GAPS}, {sql.tokens_cte("posts WHERE tweet IS NOT NULL")},
    terms AS (SELECT id, unnest(tk) AS term FROM tokens),
    counts AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY id, term),
    {_IDF.replace("FROM posts", "FROM posts WHERE tweet IS NOT NULL")}
    SELECT term, df, round(idf, 6) AS idf FROM weights""",
)
def idf_weights_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights where every third post has no text."""
    posts = labelled_posts(spark, sf_dir).withColumn("tweet", F.when(F.pmod("id", F.lit(3)) != 0, F.col("tweet")))
    counts = features.term_counts(features.with_tokens(posts), features.TOKENS)
    return features.idf_weights(counts, posts).select("term", "df", F.round("idf", 6).alias("idf"))


_LABELS = """labels_of AS (
  SELECT target, (row_number() OVER (ORDER BY count(*) DESC, target) - 1)::DOUBLE AS label, count(*) AS n
  FROM posts GROUP BY target)"""


@query("m5_label_index", f"{_POSTS}, {_LABELS} SELECT target, label, n FROM labels_of")
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = labelled_posts(spark, sf_dir).select("target")
    indexed = classifier.label_indexer().fit(targets).transform(targets)
    return indexed.groupBy("target", "label").agg(F.count("*").alias("n"))


@query(
    "m9_hash_split",
    f"""{_POSTS}
    SELECT id, target, (id::HUGEINT * 2654435761) % 4294967296 < 0.8 * 4294967296 AS in_training FROM posts""",
)
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = classifier.in_training_set(F.col("id")).alias("in_training")
    return labelled_posts(spark, sf_dir).select("id", "target", chosen)


@query(
    "m9_random_split",
    f"{_POSTS} SELECT count(*) AS n, count(DISTINCT id) AS ids, 0::BIGINT AS in_both, true AS near_share FROM posts",
)
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parts of the random split hold every post once; their sizes are near the shares (six deviations)."""
    posts = written(labelled_posts(spark, sf_dir).select("id", "target"), "posts")
    train, test = classifier.random_split(posts, seed=7)
    parts = train.withColumn("part", F.lit(1)).union(test.withColumn("part", F.lit(0)))
    by_id = parts.groupBy("id").agg(F.count("*").alias("n"), F.sum("part").alias("trained"))
    share = F.lit(classifier.TRAIN_SHARE)
    expected, spread = F.sum("n") * share, F.sqrt(F.sum("n") * share * (1 - share))
    both = F.count_if((F.col("trained") > 0) & (F.col("trained") < F.col("n")))
    return by_id.agg(
        F.sum("n").alias("n"),
        F.count("id").alias("ids"),
        both.alias("in_both"),
        (F.abs(F.sum("trained") - expected) <= 6 * spread).alias("near_share"),
    )


_trained: dict[tuple[str, str, str], classifier.Training] = {}


def trained(spark: SparkSession, sf_dir: str, terms: str = features.BIGRAMS) -> classifier.Training:
    """The classifier on bigrams or on tokens, fitted once for all queries of an application that use it."""
    application = spark.sparkContext.applicationId
    for stale in [key for key in _trained if key[0] != application]:
        del _trained[stale]
    key = (application, sf_dir, terms)
    if key not in _trained:
        _trained[key] = classifier.train(labelled_posts(spark, sf_dir), classifier.sentiment_pipeline(terms))
    return _trained[key]


SPLIT = """parts AS (
  SELECT *, (id::HUGEINT * 2654435761) % 4294967296 < 0.8 * 4294967296 AS in_training FROM posts),
labels_of AS (
  SELECT target, (row_number() OVER (ORDER BY count(*) DESC, target) - 1)::DOUBLE AS label, count(*) AS n
  FROM parts WHERE in_training GROUP BY target)"""


MODEL_VOCABULARY = 700


@query(
    "m3_model_vocabulary",
    f"""{_POSTS}, {SPLIT}, {sql.tokens_cte("(SELECT * FROM parts WHERE in_training)")},
    counted AS (SELECT term, count(*) AS n FROM (SELECT unnest(tk) AS term FROM tokens) GROUP BY term)
    SELECT term, row_number() OVER (ORDER BY n DESC, term) - 1 AS place FROM counted QUALIFY place < {MODEL_VOCABULARY}""",
)
def model_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of a fitted vectorizer whose cap cuts through terms of equal counts."""
    train_set, _ = classifier.hash_split(labelled_posts(spark, sf_dir))
    tokenized = written(features.with_tokens(train_set).select("id", features.TOKENS), "training-posts")
    corpus = written(features.corpus_counts(tokenized, features.TOKENS), "corpus-counts")
    fitted = classifier.fit_vocabulary(classifier.count_vectorizer(features.TOKENS, MODEL_VOCABULARY), corpus, tokenized)
    return spark.createDataFrame(list(enumerate(fitted.vocabulary)), "place long, term string")


@query(
    "m6_class_probabilities",
    f"""{_POSTS}, {SPLIT}
    SELECT label::INTEGER AS class, round(n / sum(n) OVER (), 2) AS mean_probability FROM labels_of""",
)
def class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean probability of each class on the training posts.

    A regression with intercepts and without penalty gives each class its
    share of the posts it was fitted on.
    """
    return _mean_probabilities(trained(spark, sf_dir))


@query(
    "m6_token_class_probabilities",
    f"""{_POSTS}, {SPLIT}
    SELECT label::INTEGER AS class, round(n / sum(n) OVER (), 2) AS mean_probability FROM labels_of""",
)
def token_class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the classifier on tokens."""
    return _mean_probabilities(trained(spark, sf_dir, features.TOKENS))


def _mean_probabilities(training: classifier.Training) -> DataFrame:
    chances = training.train_set.select(F.posexplode(vector_to_array("probability")).alias("class", "chance"))
    return chances.groupBy("class").agg(F.round(F.avg("chance"), 2).alias("mean_probability"))


@query(
    "m7_scored_posts",
    f"""{_POSTS}, {SPLIT}
    SELECT id, target, label, true AS most_probable, true AS named
    FROM parts JOIN labels_of USING (target) WHERE NOT in_training""",
)
def scored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test posts; each prediction is the class of the highest probability, and bears its name."""
    training = trained(spark, sf_dir)
    named = classifier.with_class_name(training.scored, training.model)
    chances = vector_to_array("probability")
    best = F.array_position(chances, F.array_max(chances)) - 1
    by_label = training.train_set.select(F.col("label").alias("prediction"), F.col("target").alias("known")).distinct()
    return named.withColumn("best", best.cast("double")).join(by_label, "prediction").select(
        "id",
        "target",
        "label",
        (F.col("prediction") == F.col("best")).alias("most_probable"),
        (F.col("predicted_name") == F.col("known")).alias("named"),
    )


_METRICS_SQL = f"""{_POSTS}, {SPLIT}
SELECT label, count(*) AS n, true AS same_accuracy, true AS same_f1
FROM parts JOIN labels_of USING (target) WHERE NOT in_training GROUP BY label"""


@query("m8_trained_metrics", _METRICS_SQL)
def trained_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test posts by label, and whether the metrics of the model are those of Spark's evaluator."""
    return _metrics_checked(trained(spark, sf_dir))


@query("m8_token_trained_metrics", _METRICS_SQL)
def token_trained_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the classifier on tokens."""
    return _metrics_checked(trained(spark, sf_dir, features.TOKENS))


def _metrics_checked(training: classifier.Training) -> DataFrame:
    confusion = metrics.confusion_counts(training.scored)
    pairs = [MulticlassClassificationEvaluator(metricName=name).evaluate(training.scored) for name in ("accuracy", "f1")]
    same = [F.abs(F.col(name) - value) < 1e-9 for name, value in zip(("accuracy", "f1"), pairs, strict=True)]
    checked = metrics.metrics_of(confusion).select(same[0].alias("same_accuracy"), same[1].alias("same_f1"))
    by_label = confusion.groupBy("label").agg(F.sum("n").alias("n"))
    return by_label.select(
        "label", "n", checked.select("same_accuracy").scalar().alias("same_accuracy"), checked.select("same_f1").scalar().alias("same_f1")
    )


@query(
    "p4_trainer_report",
    f"""{_POSTS}, {SPLIT}
    SELECT tweet, label, true AS scored FROM parts JOIN labels_of USING (target) WHERE NOT in_training""",
)
def trainer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction is only checked to be that of the highest probability by ``m7_scored_posts``."""
    report = relational.trainer_report(trained(spark, sf_dir).scored)
    return report.select("tweet", "label", F.col("prediction").isin(0.0, 1.0, 2.0, 3.0).alias("scored"))


@query(
    "p4_evaluation_report",
    f"""{_TOKENS}, {SPLIT}
    SELECT tweet, array_to_string(words, ' : ') AS filtered_words, label, true AS scored
    FROM parts JOIN labels_of USING (target) JOIN filtered USING (id) WHERE NOT in_training""",
)
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction itself is only checked to be a class."""
    report = relational.evaluation_report(trained(spark, sf_dir, features.TOKENS).scored)
    words = F.array_join("filtered_words", " : ").alias("filtered_words")
    return report.select("tweet", words, "label", F.col("prediction").isin(0.0, 1.0, 2.0, 3.0).alias("scored"))


@query("s10_saved_model", f"{_POSTS}, {SPLIT} SELECT id, true AS same FROM parts WHERE NOT in_training")
def saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a saved and reloaded model scores each test post as before."""
    training = trained(spark, sf_dir)
    path = new_path(spark, "model")
    classifier.save_model(training.model, path)
    fresh = ["label", "prediction"]
    before = training.scored.select("id", "tweet", "target", *[F.col(name).alias(f"old_{name}") for name in fresh])
    after = classifier.load_model(path).transform(before)
    same = [F.col(name) == F.col(f"old_{name}") for name in fresh]
    return after.select("id", (same[0] & same[1]).alias("same"))


# Weights of a fixed scoring table: a small number from the term's length and the class.
_INTERCEPTS = [0.5, 0.25, 0.0, -0.25]
_SQL_CLASSES = ", ".join(f"({k}, {bias}::DOUBLE)" for k, bias in enumerate(_INTERCEPTS))


@query(
    "m7_long_form_scores",
    f"""{_WEIGHTED},
    classes(class, bias) AS (VALUES {_SQL_CLASSES}),
    margins AS (
      SELECT id, class, sum(tf * idf * ((length(term) * 31 + class * 17) % 13 - 6) / 100.0::DOUBLE) + any_value(bias) AS s
      FROM counts JOIN weights USING (term) CROSS JOIN classes GROUP BY id, class),
    shares AS (
      SELECT id, class, exp(s - max(s) OVER (PARTITION BY id))
             / sum(exp(s - peak)) OVER (PARTITION BY id) AS p
      FROM (SELECT *, max(s) OVER (PARTITION BY id) AS peak FROM margins))
    SELECT id, round(max(p), 6) AS top_probability, arg_max(class, p)::DOUBLE AS prediction
    FROM shares GROUP BY id""",
)
def long_form_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = labelled_posts(spark, sf_dir)
    counts = written(features.term_counts(features.with_tokens(posts), features.TOKENS), "term-counts")
    weights = [
        (((F.length("term") * 31 + k * 17) % 13 - 6) / 100).alias(f"w_{k}") for k in range(len(_INTERCEPTS))
    ]
    # The IDF table has every term once: the class weights go with it.
    table = written(features.idf_weights(counts, posts).select("term", "idf", *weights), "term-weights")
    scores = classifier.score_long_form(counts, table, _INTERCEPTS)
    return scores.select("id", F.round(F.array_max("probability"), 6).alias("top_probability"), "prediction")
