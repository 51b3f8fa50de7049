import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moodlark.llm import decontaminate, quality
from moodlark.llm.decontaminate import Index, leaks, without_leaks
from moodlark.llm.registry import ship

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def spark(spark):
    ship(spark)
    return spark


def split(text, cut=" \t\n\x0b\x0c\r"):
    return "".join(" " if c in cut else c for c in text or "").split(" ")


def base(text):
    words = [w for w in split(text) if w]
    lines = [x for x in (text or "").split("\n") if any(split(x))]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )


def texts():
    draw = random.Random(5)
    made = ["", None, " \n\t", "a", "a b", "a b c", "a b c a b c", "x y x y x y", "re " * 80, "l one\n\nl one\n \nl one\r\n", "É#*$%&|<>\xa0é\x1c q"]
    return made + [" ".join(draw.choices("abcdefg\n", k=draw.randint(3, 90))) for _ in range(60)] + ["word " * 20_000]


def test_statistics_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([*rows, (None, "q"), (3, "a")], DOCS).withColumns({"n_words": F.lit("old"), "_words": F.lit("old")})
    found = quality.judge_quality(docs)
    assert found.columns[:2] == ["doc_id", "text"]
    by = {r["doc_id"]: r for r in found.collect() if r["doc_id"] is not None}
    for i, text in rows[:-1]:
        row = by[i]
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == base(text), repr(text)
        failed = row["n_words"] < 50 or 100 * row["n_repeat_words"] > 50 * row["n_words"]
        assert row["base_failed"] == failed
        assert row["kept"] == (not failed and row["probability"] >= 0.5)
    assert by[rows[-1][0]]["n_repeat_words"] == 20_000
    assert found.count() == len(rows) + 2
    assert quality.judge_quality(docs.limit(0)).count() == 0


def test_estimation_finds_planted_accuracies():
    draw = np.random.default_rng(3)
    good = draw.random(60_000) < 0.8
    right_good, right_bad, voting = [0.99, 0.95, 0.9, 0.97], [0.8, 0.7, 0.6, 0.3], [1.0, 0.9, 0.7, 1.0]
    votes = []
    for g, b, v in zip(right_good, right_bad, voting, strict=True):
        right = draw.random(len(good)) < np.where(good, g, b)
        votes.append(np.where(draw.random(len(good)) < v, np.where(right == good, 1, -1), 0))
    patterns, counts = np.unique(np.stack(votes, axis=1), axis=0, return_counts=True)
    trust = quality.estimate([(tuple(map(int, p)), int(n)) for p, n in zip(patterns, counts, strict=True)], steps=2000)
    assert trust.prior == pytest.approx(0.8, abs=0.02)
    assert trust.good == pytest.approx(right_good, abs=0.02)
    assert trust.bad == pytest.approx(right_bad, abs=0.05)


def test_no_documents_and_one_pattern():
    assert 0 < quality.estimate([]).prior < 1
    assert quality.estimate([((1,) * 8, 5)]).log_odds((1,) * 8) > 0


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.judge_quality(docs).join(labels, "doc_id").where("not base_failed")
    right = found.groupBy("quality").agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")).alias("right"))
    assert all(r["right"] > 0.97 for r in right.collect())


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog, and then it sleeps for a long long time under the old tree."),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon."),
    (3, "Three short words"),
    (4, ""),
    (5, None),
    (None, "an item without an id has words enough to be found in documents wherever it may stand"),
]


def documents():
    draw = random.Random(11)
    noise = lambda n: " ".join(f"n{draw.randrange(10**6)}" for _ in range(n))
    rows, expected = [], set()

    def add(text, *items):
        rows.append((len(rows), text))
        expected.update((len(rows) - 1, i) for i in items)

    for i, item in ITEMS[:2] + ITEMS[5:]:
        add(f"{noise(40)} {item} {noise(20)}", i)
        add(item.upper().replace(" ", "\n"), i)
        add(f"{noise(3)} {item} {noise(9000)} {item} {noise(2)}", i)
        add(" ".join(item.split()[:-2]), i)
        add(f"{noise(9)} {' '.join(item.split()[:7])} {noise(9)}")
    add(f"{ITEMS[0][1]} {noise(5)} {ITEMS[1][1]}", 1, 2)
    add(f"{noise(4)} three SHORT words {noise(4)}", 3)
    add("three short")
    for text in ("", None, noise(300), "the " * 500):
        add(text)
    return rows, expected


def test_leaks_are_found_and_clean_documents_left(spark):
    rows, expected = documents()
    docs = spark.createDataFrame(rows, DOCS).withColumns({"item_id": F.lit("clash"), "whole": F.lit(1)})
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = leaks(docs, benchmark)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == expected
    assert found.count() == len(expected)
    clean = without_leaks(docs, found)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in expected}


def test_several_passes_find_the_same(spark, monkeypatch):
    rows, expected = documents()
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 150)
    found = leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == expected


def test_null_and_repeated_ids_of_documents(spark):
    rows = [(None, ITEMS[0][1]), (None, "clean text"), (7, ITEMS[0][1]), (7, "also clean"), (8, ITEMS[1][1]), (8, ITEMS[1][1])]
    docs = spark.createDataFrame(rows, DOCS)
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = leaks(docs, benchmark)
    assert found.count() == 4
    assert sorted(map(str, without_leaks(docs, found).collect())) == sorted(map(str, docs.where("text like '%clean%'").collect()))


def test_empty_tables(spark):
    docs, benchmark = spark.createDataFrame([(1, "a b c d e f")], DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert leaks(docs, benchmark.limit(0)).count() == 0
    assert leaks(docs.limit(0), benchmark).count() == 0
    assert without_leaks(docs, leaks(docs, benchmark.limit(0))).count() == 1


def plain_similarity(a, b):
    from collections import Counter

    one, two = (Counter(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in (a, b))
    weigh = lambda c: sum(n * sum(map(len, g)) for g, n in c.items())
    return weigh(one & two) / weigh(one | two)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("aa b ccc d".split()), min_size=6, max_size=14), st.lists(st.sampled_from("aa b ccc d".split()), min_size=6, max_size=14))
def test_similarity_equals_brute_force(a, b):
    pair = []
    for words in (a, b):
        hashes, lengths = decontaminate.words_of(" ".join(words).encode())
        pair.append((decontaminate.shingles(hashes, 5), decontaminate.weights(lengths, 5)))
    assert decontaminate.similarity(*pair) == pytest.approx(plain_similarity(" ".join(a), " ".join(b)))


def test_blocks_find_all_within_the_radius():
    draw = random.Random(2)
    index = Index([(i, " ".join(f"w{draw.randrange(10**6)}" for _ in range(20)).encode()) for i in range(300)])
    part = index.by_length[5]
    for _ in range(50):
        wanted = int(part.prints[draw.randrange(300)]) ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(30)))
        distance = np.bitwise_count(part.prints ^ np.uint64(wanted))
        assert part.near(wanted).tolist() == np.flatnonzero(distance <= decontaminate.RADIUS).tolist()
