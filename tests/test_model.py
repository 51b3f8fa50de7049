import math
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from moodlark.operators import features, metrics
from moodlark.operators import model as classifier
from moodlark.workspace import new_path

WORDS = {
    "Positive": ["love", "great", "happy", "win"],
    "Negative": ["hate", "awful", "sad", "lose"],
    "Neutral": ["table", "chair", "window", "the"],
    "Irrelevant": ["zig", "zag", "zog", "and"],
}
JOB_FAILURES = (PySparkException, Py4JJavaError)
COUNTS = {"Positive": 70, "Negative": 50, "Neutral": 40, "Irrelevant": 30}


@pytest.fixture(scope="module")
def posts(spark):
    rng = random.Random(5)
    rows = []
    for target, n in COUNTS.items():
        for _ in range(n):
            noise = rng.choice(WORDS[rng.choice(list(WORDS))])
            rows.append((len(rows), "s", target, " ".join([*rng.choices(WORDS[target], k=6), noise])))
    rows.append((len(rows), "s", "Positive", None))
    return spark.createDataFrame(rows, "id long, source string, target string, tweet string").cache()


@pytest.fixture(scope="module")
def training(posts):
    pipeline = classifier.sentiment_pipeline(features.TOKENS, vocab_size=50, max_iter=20)
    return classifier.train(posts, pipeline)


def stage_names(pipeline):
    return [type(stage).__name__ for stage in pipeline.getStages()]


def test_stages(spark):
    both = ["Tokenizer", "StopWordsRemover", "NGram", "CountVectorizer", "IDF", "StringIndexer", "LogisticRegression"]
    bigram = classifier.sentiment_pipeline()
    assert stage_names(bigram) == both
    assert bigram.getStages()[3].getInputCol() == "ngrams"
    assert bigram.getStages()[3].getVocabSize() == 262144
    token = classifier.sentiment_pipeline(features.TOKENS)
    assert stage_names(token) == both
    assert token.getStages()[3].getInputCol() == "tk"
    short = classifier.sentiment_pipeline(features.TOKENS, keep_words=False)
    assert stage_names(short) == [both[0], *both[3:]]
    regression = bigram.getStages()[6]
    assert (regression.getMaxIter(), regression.getRegParam(), regression.getTol()) == (100, 0.0, 1e-6)
    assert (regression.getFamily(), regression.getFitIntercept(), regression.getStandardization()) == ("auto", True, True)
    with pytest.raises(ValueError, match="terms"):
        classifier.sentiment_pipeline("other")


def test_hash_split(spark):
    big = [0, 1, 5, 2**31 - 1, 2**31, 2**31 + 1, 2**32 + 3, 10**15, 2**62 + 12345, -1, -(2**40) - 7]
    rows = spark.createDataFrame([(i,) for i in [*big, None]], "id long")
    train, test = classifier.hash_split(rows)
    expected = {i for i in big if i * 2654435761 % 2**32 < 0.8 * 2**32}
    assert {row.id for row in train.collect()} == expected | {None}
    assert {row.id for row in test.collect()} == set(big) - expected
    many = spark.range(10000)
    assert abs(classifier.hash_split(many)[0].count() - 8000) < 100


def test_random_split_is_repeatable(spark):
    first = classifier.random_split(spark.range(500), seed=3)
    again = classifier.random_split(spark.range(500), seed=3)
    assert first[0].collect() == again[0].collect()
    assert first[0].count() + first[1].count() == 500


def test_label_index(spark):
    rows = spark.createDataFrame([(t,) for t in "baabc"], "target string")
    fitted = classifier.label_indexer().fit(rows)
    assert fitted.labels == ["a", "b", "c"]
    for unknown in ("z", None):
        with pytest.raises(JOB_FAILURES):
            fitted.transform(spark.createDataFrame([(unknown,)], "target string")).collect()


def vector_terms(counted, vocabulary, vector="tf", value="tf"):
    """The entries of sparse vectors as (id, term, value)."""
    terms = counted.sparkSession.createDataFrame(list(enumerate(vocabulary)), "place long, term string")
    entries = counted.select("id", F.posexplode(vector_to_array(vector)).alias("place", value)).where(F.col(value) != 0)
    return entries.withColumn("place", F.col("place").cast("long")).join(terms, "place").select("id", "term", value)


def test_long_form_equals_the_vectors(posts):
    tokenized = features.with_tokens(posts)
    counts = features.term_counts(tokenized, features.TOKENS)
    counter = classifier.count_vectorizer(features.TOKENS).fit(tokenized)
    vectors = counter.transform(tokenized)
    from_vectors = vector_terms(vectors, counter.vocabulary)
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(counts.withColumn("tf", F.col("tf").cast("double"))) == as_set(from_vectors)

    fitted = IDF(inputCol="tf", outputCol="features").fit(vectors)
    expected = {
        term: (df, pytest.approx(idf)) for term, df, idf in zip(counter.vocabulary, fitted.docFreq, fitted.idf, strict=True)
    }
    weights = features.idf_weights(counts, posts)
    assert {r.term: (r.df, r.idf) for r in weights.collect()} == expected


@pytest.mark.parametrize("size", [0, 3, 9, 1000])
def test_capped_vocabulary(posts, size):
    corpus = features.corpus_counts(features.with_tokens(posts), features.TOKENS)
    top = {(r.term, r.n) for r in features.capped_vocabulary(corpus, size).collect()}
    every = sorted(((r.term, r.n) for r in corpus.collect()), key=lambda p: (-p[1], p[0]))
    assert top == set(every[:size])


def test_training_is_that_of_the_pipeline(posts, training):
    pipeline = classifier.sentiment_pipeline(features.TOKENS, vocab_size=50, max_iter=20)
    train_set, _ = classifier.hash_split(features.with_text(posts))
    plain = pipeline.fit(train_set)
    assert [type(s).__name__ for s in training.model.stages] == [type(s).__name__ for s in plain.stages]
    assert set(training.model.stages[3].vocabulary) == set(plain.stages[3].vocabulary)
    assert training.model.stages[5].labels == plain.stages[5].labels
    columns = ["id", "label", "prediction"]
    everything = features.with_text(posts)
    found = training.model.transform(everything).select(columns).orderBy("id").collect()
    assert found == plain.transform(everything).select(columns).orderBy("id").collect()


def _ends_of_tree(parts, depth):
    """Tasks whose sums go to the driver, as Spark's ``treeAggregate`` has it."""
    scale = max(math.ceil(parts ** (1 / depth)), 2)
    while parts > scale + math.ceil(parts / scale):
        parts //= scale
    return parts


def test_gradients_meet_in_one_task_however_many_terms():
    limit = classifier.TERMS_IN_TASK
    for terms in (0, 1000, 2**22, 2**22 + 1, 28 * limit, 28 * limit + 1, 10**11):
        parts, depth = classifier._summing_tree(terms)
        assert _ends_of_tree(parts, depth) == 1
        assert terms <= parts * limit
        assert parts == 1 or parts == 28 or terms > parts * limit / 4


def test_each_step_sends_one_gradient_to_the_driver(spark, posts, monkeypatch):
    """Of the many small parts of a large corpus, one job for each step, whose last stage is one task."""
    monkeypatch.setattr(classifier, "TERMS_IN_ONE_TASK", 10)
    context = spark.sparkContext
    context.setJobGroup("gradients", "gradients")
    try:
        trained = classifier.train(posts, classifier.sentiment_pipeline(features.TOKENS, vocab_size=50, max_iter=5))
        jobs = context.statusTracker().getJobIdsForGroup("gradients")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    told = [context.statusTracker().getJobInfo(job) for job in jobs]
    ends = [context.statusTracker().getStageInfo(max(job.stageIds)) for job in told if job and len(job.stageIds) >= 3]
    steps = [end for end in ends if end and "treeAggregate" in end.name]
    assert len(steps) >= 5 and {end.numTasks for end in steps} == {1}
    assert trained.model.stages[-1].getOrDefault("aggregationDepth") == 3


def test_training_tells_what_the_vocabulary_cuts(posts):
    words = {w for p in classifier.hash_split(features.with_text(posts))[0].collect() for w in p.tweet.split()}
    pipeline = classifier.sentiment_pipeline(features.TOKENS, vocab_size=5, max_iter=2)
    assert tuple(classifier.train(posts, pipeline).terms.first()) == (5, len(words) - 5)


def test_training_learns_and_metrics_equal_the_evaluator(training):
    scored = training.scored
    measured = training.metrics.first()
    for name in ("accuracy", "f1"):
        evaluator = MulticlassClassificationEvaluator(metricName=name)
        assert measured[name] == pytest.approx(evaluator.evaluate(scored))
    assert measured.accuracy > 0.9
    named = classifier.with_class_name(scored, training.model)
    assert named.where("prediction = label and predicted_name != target").count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_metrics_equal_the_evaluator_on_noise(spark, seed):
    rng = random.Random(seed)
    pairs = [(float(rng.randrange(4)), float(rng.randrange(rng.choice((2, 4, 5))))) for _ in range(60)]
    scored = spark.createDataFrame(pairs, "label double, prediction double")
    measured = metrics.evaluate(scored).first()
    for name in ("accuracy", "f1"):
        assert measured[name] == pytest.approx(MulticlassClassificationEvaluator(metricName=name).evaluate(scored))


def test_rounding_is_pythons(spark):
    rng = random.Random(9)
    values = [0.0, 1.0, 0.125, 0.375, 0.285, 0.615, 0.005, 0.015, *[rng.randrange(1001) / 1000 for _ in range(300)]]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0] for r in rows.select(metrics.round_half_even(F.col("v"))).collect()]
    assert found == [round(v, 2) for v in values]


def test_saved_model_scores_the_same(spark, training, posts):
    path = new_path(spark, "model")
    classifier.save_model(training.model, path)
    loaded = classifier.load_model(path)
    columns = ["id", "label", "prediction", "probability"]
    before = classifier.score(training.model, posts).select(columns).orderBy("id").collect()
    assert classifier.score(loaded, posts).select(columns).orderBy("id").collect() == before


def test_bad_posts(training, posts_of):
    bad = posts_of([(1, "s", "Unseen", "love"), (2, "s", None, "love"), (3, "s", "Positive", None), (4, "s", "Positive", "love")])
    scored = {r.id: r.label for r in classifier.score(training.model, bad).collect()}
    assert scored == {1: 4.0, 2: 4.0, 4: 0.0}
    for row in (1, 2, 3):
        with pytest.raises(JOB_FAILURES):
            classifier.score(training.model, bad.where(F.col("id") == row), strict=True).collect()


def test_long_form_scores_equal_the_model(spark, training, posts):
    *_, counter, idf, _, regression = training.model.stages
    scored = training.model.transform(features.with_text(posts))
    counts = vector_terms(scored, counter.vocabulary)
    matrix = regression.coefficientMatrix.toArray()
    table = [(term, float(idf.idf[i]), *map(float, matrix[:, i])) for i, term in enumerate(counter.vocabulary)]
    schema = "term string, idf double, " + ", ".join(f"w_{k} double" for k in range(len(matrix)))
    weights = spark.createDataFrame(table, schema)
    scores = classifier.score_long_form(counts, weights, list(regression.interceptVector.toArray()))
    long_form = {r.id: (r.prediction, r.probability) for r in scores.collect()}
    for row in scored.select("id", "prediction", "probability").collect():
        prediction, probability = long_form[row.id]
        assert prediction == row.prediction
        assert probability == pytest.approx(list(row.probability))
        assert math.isclose(sum(probability), 1.0)


def test_class_names(spark):
    rows = spark.createDataFrame([(0.0,), (3.0,), (4.0,), (None,)], "p double")
    assert [r[0] for r in rows.select(classifier.class_name(F.col("p"))).collect()] == ["Negative", "Irrelevant", None, None]


def test_heavy_terms_do_not_meet_in_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(features, "HEAVY_TERMS", 2)
    draw = random.Random(6)
    rows = [(i, t, draw.randrange(1, 4)) for i in range(300) for t in {"all", "most" if i % 5 else "x" * 5000, f"t{draw.randrange(40)}"}]
    counts = spark.createDataFrame(rows, "id long, term string, tf long")
    table = counts.groupBy("term").agg(F.count("*").alias("df")).withColumn("w", F.length("term")).where("term <> 't3'")
    for how in ("inner", "left"):
        joined = features.joined_by_term(counts, table.drop("df"), table.select("term", "df"), how)
        plain = counts.join(table.drop("df"), "term", how)
        assert sorted(map(str, joined.collect())) == sorted(map(str, plain.select(joined.columns).collect()))
    # One join, whose most frequent term is dealt out over several tasks.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = features.joined_by_term(counts, table.drop("df"), table.select("term", "df"))
        assert joined._jdf.queryExecution().executedPlan().toString().count("Join") == 1
        monkeypatch.setattr(features, "PIECES", 7)
        sizes = features.joined_by_term(counts, table.drop("df"), table.select("term", "df")).withColumn("at", F.spark_partition_id())
        largest = sizes.where("term = 'all'").groupBy("at").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert largest < 300


def test_vocabulary_with_ties_at_the_cap(spark):
    draw = random.Random(7)
    words = [f"w{i:02d}" for i in range(30)] * 3 + ["often"] * 9
    found = []
    for parts in (2, 5):
        draw.shuffle(words)
        posts = spark.createDataFrame([(i, words[i::8]) for i in range(8)], "id long, tk array<string>").repartition(parts)
        counter = classifier.count_vectorizer(features.TOKENS, 12)
        fitted = classifier.fit_vocabulary(counter, features.corpus_counts(posts, features.TOKENS), posts)
        found.append(fitted.vocabulary)
        kept = fitted.transform(posts).select(vector_to_array("tf").alias("tf")).collect()
        assert sum(sum(r["tf"]) for r in kept) == 9 + 11 * 3
    assert found[0] == found[1] == ["often", *(f"w{i:02d}" for i in range(11))]


def test_bounds_on_document_frequency_are_left_to_spark(spark):
    posts = spark.createDataFrame([(0, ["a", "b"]), (1, ["a"])], "id long, tk array<string>")
    counter = classifier.count_vectorizer(features.TOKENS).setMinDF(2.0)
    assert classifier.fit_vocabulary(counter, features.corpus_counts(posts, features.TOKENS), posts).vocabulary == ["a"]
