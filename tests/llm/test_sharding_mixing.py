import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from moodlark.llm.mixing import mix
from moodlark.llm import queries, sharding  # noqa: F401
from moodlark.llm.registry import QUERIES
from moodlark.llm.sharding import shard_by_bytes
from moodlark.llm.words import count_words

DOCS = "doc_id long, text string, source string, size long, key string"


def sharded(docs, n, **options):
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("bytes", F.octet_length(text) + 16)
    return shard_by_bytes(rows, n, F.col("bytes"), F.xxhash64(text), F.xxhash64("doc_id"), **options)


def rows_of(n, text):
    return [(i, text(i), f"s{i % 3}", -1, "k") for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        rows_of(500, lambda i: "x" * (i * 7919 % 997)),
        # A third and more of all bytes in copies of one text.
        rows_of(400, lambda i: "copy " * 50 if i % 2 else f"{i} " * (i % 40)),
        # The same row again and again.
        [(1, "same", "s", 0, "k")] * 300 + [(None, None, None, None, None)] * 20,
    ],
    ids=["spread", "copies", "repeated rows"],
)
def test_shards_have_nearly_equal_bytes(spark, rows):
    found = sharded(spark.createDataFrame(rows, DOCS), 7).collect()
    assert len(found) == len(rows)
    total, slots, sizes = 0, defaultdict(list), defaultdict(int)
    for r in found:
        sizes[r["shard"]] += r["bytes"]
        slots[r["shard"]].append(r["slot"])
        total += r["bytes"]
    largest = max(r["bytes"] for r in found)
    assert all(abs(s - total / 7) <= largest + 0.002 * total for s in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) == set(range(7))


def test_shards_keep_columns_and_agree(spark):
    docs = spark.createDataFrame(rows_of(60, lambda i: "w " * i), DOCS).withColumn("shard", F.lit("old")).withColumn("piece", F.lit(5))
    first, second = sharded(docs, 4), sharded(docs, 4)
    assert first.columns == ["doc_id", "text", "source", "size", "key", "piece", "bytes", "shard", "slot"]
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))
    assert {r["piece"] for r in first.collect()} == {5}


def by_hand(keys, pieces, slack):
    """Histogram sort in one go: boundaries at the exact row or, within ``slack``, near it."""
    keys = sorted(keys)
    total, below, bounds = sum(size for _, size in keys), 0, []
    starts = []
    for key, size in keys:
        starts.append((below, key))
        below += size
    for i in range(1, pieces):
        bounds.append(total * i // pieces)
    return total, starts, bounds


@pytest.mark.parametrize("pieces", [1, 7, 200])
def test_splitters_against_a_sorted_list(spark, pieces):
    draw = random.Random(pieces)
    keys = [(f"{draw.choice([draw.getrandbits(64), 7, 7]):016x}{draw.getrandbits(64):016x}{i:016x}", draw.choice([0, 16, 100, 5000])) for i in range(6000)]
    table = spark.createDataFrame(keys, "key string, size long")
    total, starts, bounds = by_hand(keys, pieces, 0)
    for slack in (0, total / pieces / 20):
        found = sharding._splitters(table, total, pieces, slack)
        assert len(found) == pieces - 1
        assert [s.key for s in found] == sorted(s.key for s in found)
        for splitter, bound in zip(found, bounds, strict=True):
            below = [size for key, size in keys if key < splitter.key]
            assert (splitter.rows, splitter.size) == (len(below), sum(below))
            assert abs(splitter.size - bound) <= max(slack, 5000)


def test_driver_holds_a_range_for_each_boundary(spark, monkeypatch):
    seen = []
    real = sharding._probes
    monkeypatch.setattr(sharding, "_probes", lambda *a: seen.append(a) or real(*a))
    rows = spark.range(30_000).select(F.xxhash64("id").alias("g"), F.lit(10).alias("bytes"), "id")
    found = sharding.shard_by_bytes(rows, 300, F.col("bytes"), F.col("g"), F.col("id"))
    assert {r["n"] for r in found.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {100}
    assert all(len(targets) <= 299 and len(open_ or {}) <= 299 for _, open_, _, targets in seen)


def test_query_deals_out_every_document(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = QUERIES["op3_shards"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    assert all((r["size"], r["text_crc32"]) == (len(docs[r["doc_id"]]) + 16, zlib.crc32(docs[r["doc_id"]])) for r in found)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in found:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) == set(range(40))
    even = sum(sizes.values()) / 40
    assert all(abs(s - even) <= 0.002 * even + max(r["size"] for r in found) for s in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r["law"], r["grown_shard"]) for r in found} == {("bytes", None)}


def test_no_rows_and_fewer_rows_than_shards(spark):
    docs = spark.createDataFrame(rows_of(2, str), DOCS)
    assert sharded(docs.limit(0), 4).count() == 0
    assert sorted(r["slot"] for r in sharded(docs, 40).collect()) == [0, 0]


def targets_of(sizes, weights, most=3):
    """Water filling, source by source."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    share = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        level = (total - sum(held.values())) / sum(share[s] for s in free) if free else 0
        above = [s for s in free if share[s] * level > most * sizes[s]]
        if not above:
            return held | {s: share[s] * level for s in free}
        held |= {s: most * sizes[s] for s in above}


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (i * 37 % 90), None if i % 7 == 3 else f"s{i % 5 if i % 11 else 9}", 1, "k") for i in range(900)]
    rows += [(None, None, "s1", 1, "k"), (5, "", "s2", 1, "k")]
    docs = spark.createDataFrame(rows, DOCS)
    found = mix(docs, count_words(F.col("text")), [5, 2, 1]).collect()
    assert len(found) == len(rows)
    sizes, taken, tilted = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        tilted[r["source"]].append((r["size"], r["rate"]))
        assert 0 <= r["copies"] <= 3
        assert r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
    targets = targets_of(sizes, [5, 2, 1])
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
    for source, target in targets.items():
        assert taken[source] == pytest.approx(target, abs=45)
        assert sum(s * r for s, r in tilted[source]) == pytest.approx(target, rel=1e-5, abs=1e-3)
    again = mix(docs.repartition(3), count_words(F.col("text")), [5, 2, 1])
    assert sorted(str((r["doc_id"], r["copies"])) for r in again.collect()) == sorted(str((r["doc_id"], r["copies"])) for r in found)


def test_rates_are_exponential_in_size(spark):
    rows = [(i, "w " * (1 + i % 20), "a" if i < 100 else "b", 0, "k") for i in range(400)]
    found = mix(spark.createDataFrame(rows, DOCS), count_words(F.col("text")), [1, 1])
    import math

    for source in ("a", "b"):
        at = {r["size"]: r["rate"] for r in found.where(F.col("source") == source).collect() if r["rate"] < 3}
        slopes = [math.log(rate) / size for size, rate in at.items()]
        assert max(slopes) - min(slopes) < 1e-6


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert mix(docs, count_words(F.col("text")), [5, 2, 1]).count() == 0
    empty = spark.createDataFrame([(1, "", "a", 0, "k"), (2, None, None, 0, "k")], DOCS)
    assert {r["target"] for r in mix(empty, count_words(F.col("text")), [5, 2, 1]).collect()} == {0.0}


def test_copied_rows_are_those_of_the_input(spark):
    rows = [(i, "w " * (1 + i % 20), "a" if i < 30 else "b", -5, "k") for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("copies", F.lit("mine"))
    counted = {r["doc_id"]: r["copies"] for r in mix(docs, count_words(F.col("text")), [5, 1]).collect()}
    copied = mix(docs, count_words(F.col("text")), [5, 1], copied=True)
    assert copied.columns == docs.columns
    found = defaultdict(int)
    for r in copied.collect():
        assert (r["size"], r["copies"], r["text"]) == (-5, "mine", rows[r["doc_id"]][1])
        found[r["doc_id"]] += 1
    assert {i: found[i] for i in counted} == counted


@pytest.mark.parametrize("text,n", [(None, 0), ("", 0), (" \t\n\x0b\x0c\r", 0), ("a\xa0b c", 2), ("\x1ca", 1), ("a\n\nb", 2)])
def test_words(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(count_words(F.col("t"))).first()[0] == n
