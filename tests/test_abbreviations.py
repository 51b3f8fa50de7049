import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from moodlark.functions import text
from moodlark.operators import abbreviations as ab
from tests.test_text import python_word_tokens

PROSE = [
    "Dr. Ames met Prof. Bell at 10 a.m. in the hall.",
    "The hall was cold. Prof. Ames left, e.g. early (approx. noon).",
    "They met again, e.g. at noon. It was cold in the hall, approx. as before.",
    "Dr. Bell was early. Prof. Bell was not. The noon bell rang at 10 a.m. again.",
] * 30


def plain_scores(texts):
    counts = Counter()
    for t in texts:
        for chunk in (t or "").lower().split():
            core = re.sub(r"""[\])}>"'»”’,;:!?]+$""", "", re.sub(r"""^[\[({<"'«“‘`]+""", "", chunk))
            ends = len(core) > 1 and core[-1] == "." and core[-2] != "."
            if core:
                counts[core[:-1] if ends else core, ends] += 1
    share = sum(n for (_, ends), n in counts.items() if ends) / sum(counts.values())
    out = {}
    for word in {w for w, ends in counts if ends and any(c.isalpha() for c in w)}:
        a, b = counts[word, True], counts[word, False]
        null = a * math.log(share) + (b * math.log(1 - share) if b else 0)
        likely = a * math.log(0.99) + b * math.log(0.01)
        plain, inner = len(word.replace(".", "")), word.count(".")
        out[word] = (a, b, -2 * (null - likely), -2 * (null - likely) * math.exp(-plain) * (inner + 1) * plain ** (-b))
    return out


@pytest.fixture
def texts_of(spark):
    return lambda values: spark.createDataFrame(list(enumerate(values)), "id long, tweet string").repartition(3)


def test_scores_equal_plain_python(texts_of):
    draw = random.Random(1)
    words = ["a.m.", "etc.", "(etc.)", "end.", "end", "3.", "...", "x..", "“Dr.”", "Dr.,", "é.", "", "I", ".", "z.\n"]
    values = [*PROSE, None, "", " \n", *(" ".join(draw.choices(words, k=30)) for _ in range(40))]
    scores = ab.abbreviation_scores(ab.word_counts(texts_of(values), "tweet")).collect()
    expected = plain_scores(values)
    assert {r["word"] for r in scores} == set(expected)
    for r in scores:
        assert (r["with_period"], r["without_period"]) == expected[r["word"]][:2]
        assert (r["log_likelihood"], r["score"]) == pytest.approx(expected[r["word"]][2:], rel=1e-9)


def test_words_are_cut_out_of_distinct_chunks(texts_of):
    """One explode, without a filter that splits the texts again, and the patterns above the first count."""
    plan = ab.word_counts(texts_of(PROSE), "tweet")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert above.count("Aggregate") == 2 and "regexp_replace" not in above[above.rindex("Aggregate") :] + below
    assert plan.count("split(") == 1


def test_ended_words_are_those_of_the_chunks(texts_of):
    values = ["A.b. (c.) d.” e.. f.g .h i", " Dr. Dr.\u2003Dr.) x.,", "", None, "...", "é.\n"]
    told = texts_of(values).select("id", text.ended_words(F.col("tweet")))
    assert dict(told.collect()) == {0: ["a.b", "(c", "d"], 1: ["dr"], 2: [], 3: None, 4: [], 5: ["é"]}


def test_abbreviations_are_learned(texts_of):
    found = {r["word"] for r in ab.learned_abbreviations(texts_of(PROSE), "tweet").collect()}
    assert {"dr", "prof", "a.m", "e.g"} <= found
    assert not found & {"cold", "hall", "noon", "early", "again", "before"}


def test_tokens_keep_the_period_of_learned_abbreviations(spark, texts_of):
    words = spark.createDataFrame([("dr",), ("a.m",), ("approx",)], "word string")
    values = [*PROSE[:4], None, "", "Dr.", "(Dr.) (dr. x", "dr .", "approx.) a.m.\n\nDr.\tDr..", "nothing here"]
    told = ab.with_abbreviations(texts_of(values), "tweet", "id", words)
    found = dict(told.select("id", text.word_tokens(F.col("tweet"), F.col("abbreviations"))).collect())
    assert [found[i] for i in range(len(values))] == [None if v is None else python_word_tokens(v, ("dr", "a.m", "approx")) for v in values]
    # A constant list does the same.
    listed = dict(texts_of(values).select("id", text.word_tokens(F.col("tweet"), ("dr", "a[.]m", "approx"))).collect())
    assert listed == found


def test_rows_without_id_and_empty_tables(spark, texts_of):
    words = spark.createDataFrame([("dr",)], "word string")
    rows = spark.createDataFrame([(None, "Dr. A"), (None, "no"), (1, "dr. b"), (1, "dr. b")], "id long, tweet string")
    told = ab.with_abbreviations(rows, "tweet", "id", words)
    tokens = told.select(text.word_tokens(F.col("tweet"), F.col("abbreviations"))).collect()
    assert sorted(r[0] for r in tokens) == [["dr.", "a"], ["dr.", "b"], ["dr.", "b"], ["no"]]
    assert ab.learned_abbreviations(texts_of([]), "tweet").count() == 0
    assert ab.with_abbreviations(texts_of([]), "tweet", "id", words).count() == 0


def test_top_words_take_the_table(spark, posts_of):
    from moodlark.operators.top_words import top_words

    posts = posts_of([(i, "s", "Positive", "Etc. is here. Etc. apples") for i in range(3)])
    words = spark.createDataFrame([("etc",)], "word string")
    found = top_words(posts, abbreviations=words, n=5).collect()
    assert {r["word"] for r in found} == {"apples"}
