import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from moodlark.functions.lexicon import DASHBOARD_STOP_WORDS, NOUN_ENDINGS
from moodlark.operators import counts, feed, relational
from moodlark.operators.top_words import lemma_map, top_words
from tests.test_text import PIECES, python_word_tokens


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["dog", "dogs", "box", "boxes", "the", "wolf", "wolves", "city", "cities", "glasses", "glass", *PIECES]
    found = []
    for i in range(300):
        # One source holds a third of the posts.
        source = "hot" if i % 3 == 0 else f"s{rng.randrange(5)}"
        target = rng.choice(["Positive", "Negative", "Neutral", "Irrelevant", "positive"])
        found.append((i, source, target, " ".join(rng.choices(words, k=rng.randint(0, 20)))))
    return found


@pytest.fixture(scope="module")
def posts(spark, rows):
    frame = spark.createDataFrame(rows, "id long, source string, target string, tweet string")
    return frame.repartition(5).cache()


def test_counts_by_entity(posts, rows):
    expected = Counter((source, target) for _, source, target, _ in rows)
    found = {(r.source, r.target): r.n for r in counts.count_by_entity(posts).collect()}
    assert found == expected


def test_chart(posts, rows):
    expected = Counter((source, target) for _, source, target, _ in rows)
    for row in counts.chart_by_entity(posts).collect():
        for name in ("Positive", "Neutral", "Negative"):
            assert row[name] == expected.get((row.source, name))


def test_chart_leaves_missing_pairs_empty(posts_of):
    chart = counts.chart_by_entity(posts_of([(1, "a", "Irrelevant", ""), (2, "b", "Neutral", "")]))
    assert sorted(map(tuple, chart.collect()), key=str) == [("a", None, None, None), ("b", None, 1, None)]


def test_shares(posts, rows):
    expected = Counter(target for _, _, target, _ in rows)
    found = {r.target: r.pct for r in counts.sentiment_shares(posts).collect()}
    assert found == {t: pytest.approx(n / len(rows) * 100) for t, n in expected.items()}


def collected(df):
    found = {}
    for row in df.orderBy("sentiment", "rank").collect():
        found.setdefault(row.sentiment, []).append((row.word, row.n))
    return found


SHORT = [
    (1, "s", "Positive", "Dogs like boxes, and a dog likes a box."),
    (2, "s", "POSITIVE", "the box! the wolves"),
    (3, "s", "Negative", "Cities: two cities, 3 wolves"),
    (4, "s", "Irrelevant", "dog dog dog dog"),
    (5, "s", "Neutral", "of the and"),
    (6, "s", "Positive", "wolf"),
]


def test_top_words_of_a_few_posts(posts_of):
    """Counted by hand: of equal counts the word that appeared first leads."""
    found = collected(top_words(posts_of(SHORT), 10))
    assert found == {
        "positive": [("box", 3), ("dog", 2), ("like", 2), ("wolf", 2)],
        "negative": [("cities", 2), ("two", 1), ("wolf", 1)],
    }
    assert collected(top_words(posts_of(SHORT), 2)) == {k: v[:2] for k, v in found.items()}


def test_top_words_with_a_vocabulary(spark, posts_of):
    vocabulary = spark.createDataFrame([("boxes",), ("wolf",), ("city",)], "word string")
    assert collected(top_words(posts_of(SHORT), 10, vocabulary=vocabulary)) == {
        "positive": [("box", 2), ("wolf", 2), ("dogs", 1), ("like", 1), ("boxes", 1), ("dog", 1), ("likes", 1)],
        "negative": [("city", 2), ("two", 1), ("wolf", 1)],
    }


def test_first_appearance_is_exact_for_large_ids(posts_of):
    far = 2**62
    found = collected(top_words(posts_of([(far + 1, "s", "Neutral", "late"), (far, "s", "Neutral", "one two")])))
    assert found == {"neutral": [("one", 1), ("two", 1), ("late", 1)]}


def test_irregular_nouns(spark):
    words = spark.createDataFrame([(w,) for w in ("children", "women", "geese", "boss", "oxen")], "word string")
    known = spark.createDataFrame([(w,) for w in ("child", "woman", "goose", "boss", "bos", "ox", "women")], "word string")
    irregular = spark.createDataFrame(
        [("children", "child"), ("geese", "goose"), ("oxen", "ox"), ("boss", "unheard")], "word string, lemma string"
    )
    found = {r.word: r.lemma for r in lemma_map(words, known, irregular).collect()}
    assert found == {"children": "child", "geese": "goose", "oxen": "ox", "women": "women", "boss": "boss"}


def test_charted_and_text_filters(posts_of):
    posts = posts_of([(1, "s", "POSITIVE", "a"), (2, "s", "Irrelevant", "b"), (3, "s", None, "c"), (4, "s", "neutral", None)])
    assert [r.id for r in relational.charted(posts).collect()] == [1, 4]
    assert [r.id for r in relational.with_text(posts).collect()] == [1, 2, 3]


def test_first_rows(posts):
    found = feed.first_rows(posts, "id", 7).orderBy("row_no").collect()
    assert [(r.row_no, r.id) for r in found] == [(i + 1, i) for i in range(7)]
    assert feed.first_rows(posts, "id").count() == 100


@pytest.fixture(scope="module")
def predictions(spark):
    rows = [(b, s, f"t{b}{s}", ["x", "y"], "Neutral", 2.0, float(s)) for b in range(3) for s in range(3)]
    schema = "batch_id long, seq long, tweet string, filtered_words array<string>, target string, label double, prediction double"
    return spark.createDataFrame(rows, schema).repartition(4)


def test_feed_is_newest_first(predictions):
    expected = [f"t{b}{s}" for b in (2, 1, 0) for s in (2, 1, 0)]
    assert [r.tweet for r in feed.prediction_feed(predictions).collect()] == expected


def test_feed_defaults(spark):
    bare = spark.createDataFrame([(0, 0)], "batch_id long, seq long")
    row = feed.prediction_feed(bare).first()
    assert (row.tweet, row.target, row.label, row.filtered_words, row.prediction) == ("", "", None, [], None)


def test_newest(predictions):
    found = feed.newest_predictions(predictions).orderBy(F.desc("row_no")).collect()
    assert [(r.row_no, r.predicted_name) for r in found] == list(
        zip([9, 8, 7, 6, 5], ["Neutral", "Positive", "Negative", "Neutral", "Positive"], strict=True)
    )
    assert found[0].features == "x : y"
    assert feed.newest_predictions(predictions.limit(2)).count() == 2


def test_prediction_count(predictions):
    assert counts.prediction_count(predictions).first().predictions == 9


def test_latest_metrics(spark):
    schema = "accuracy double, f1 double, model_id string, trained_at timestamp"
    rows = [(0.1, None, "a", datetime(2024, 1, 1)), (0.9, None, "b", datetime(2024, 1, 3)), (0.5, 0.5, "c", datetime(2024, 1, 2))]
    history = spark.createDataFrame(rows, schema)
    assert tuple(feed.latest_metrics(history).first()) == (0.9, 0.0)
    assert feed.latest_metrics(history.limit(0)).count() == 0
