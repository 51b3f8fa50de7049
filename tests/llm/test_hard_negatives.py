import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from moodlark.llm import hard_negatives as h
from moodlark.llm import queries  # noqa: F401
from moodlark.llm.registry import ORACLES, QUERIES, ship

ROWS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def spark(spark):
    ship(spark)
    return spark


def expected(rows):
    """By all pairs, for rows of (vec_id, embedding, label)."""
    kept = []
    for vec_id, e, label in rows:
        if vec_id is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        row = (vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in e))
        if row not in kept:
            kept.append(row)
    out = []
    for a in kept:
        if a[0] % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=False)), b[0], b[1]) for b in kept if b != a)
        for p, positive, _ in [s for s in scored if s[2] == a[1]][:5]:
            inside = [s for s in scored if s[2] != a[1] and -50 * p <= -100 * s[0] <= -95 * p]
            out += [(a[0], positive, i + 1, n, -p, -s) for i, (s, n, _) in enumerate(inside[:3])]
    return sorted(out)


def found(spark, rows, tmp_path, schema=ROWS):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op11_hard_negatives"](spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def test_query_against_sql_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    tables = duckdb.connect()
    tables.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = QUERIES["op11_hard_negatives"](spark, folder).collect()
    assert sorted(tuple(r) for r in got) == sorted(tables.execute(ORACLES["op11_hard_negatives"]).fetchall())


def test_edges_ties_and_several_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(h, "BLOCK_BYTES", 64 * 8 * 12)
    draw = random.Random(4)
    vector = lambda: [round(draw.gauss(0, 1), 1) for _ in range(12)]
    common = [vector() for _ in range(4)]
    rows = [(i, draw.choice(common) if i % 3 else vector(), draw.choice([0, 0, 0, 1, 9])) for i in range(400)]
    rows += [(1000, None, 1), (1050, [None] * 12, 1), (1001, [math.nan] * 12, 1), (1002, [math.inf] * 12, 1), (1003, vector(), None), (None, vector(), 1)]
    rows += [(1100, [], 0), (1150, [0.0] * 12, 1), (1200, [0.5] * 3, 0), (1201, [0.5] * 7, 9), (1250, vector(), 7)]
    # Rows that repeat count once; those that share an id only are apart.
    rows += rows[:60] + [(3, vector(), 0)]
    assert found(spark, rows, tmp_path) == expected(rows)


def test_negative_and_unequal_scores_take_every_round(spark, tmp_path):
    draw = random.Random(9)
    rows = [(i, [draw.uniform(-1, 1) * 10 ** draw.randint(-2, 3) for _ in range(5)], i % 2) for i in range(150)]
    assert found(spark, rows, tmp_path) == expected(rows)


def test_nothing(spark, tmp_path):
    assert found(spark, [], tmp_path) == []
    assert found(spark, [(1, [0.1], 1)], tmp_path) == []
    assert found(spark, [(50, [0.1], 1)], tmp_path) == []


def test_clashing_columns(spark):
    rows = [(i, [i % 7, i % 5, 1], str(i % 2)) for i in range(60)]
    docs = spark.createDataFrame(rows, "vec_id long, vector array<bigint>, label string")
    plain = sorted(tuple(r) for r in h.hard_negatives(docs, F.col("vec_id") % 50 == 0).collect())
    more = docs.withColumns({c: F.lit("mine") for c in ("id", "row", "v", "norm", "a", "r", "t", "windows", "score", "anchor")})
    assert plain and sorted(tuple(r) for r in h.hard_negatives(more, F.col("vec_id") % 50 == 0).collect()) == plain


def test_scores_beyond_64_bits_are_refused():
    big = np.full((1, 2), 1 << 40)
    with pytest.raises(ValueError, match="64 bits"):
        list(h.pairs_over(big, np.array([1.0]), big, lambda part: np.ones((1, 1), dtype=bool)))


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9, -1.0])
def test_pruning_loses_no_pair(share):
    draw = np.random.default_rng(1)
    rows = np.round(draw.normal(size=(500, 40)) * draw.exponential(size=40) * 100).astype(np.int64)
    rows[::5, draw.integers(0, 40, 30)] = 0
    queries = rows[::4]
    scores = queries @ rows.T
    thresholds = np.floor(share * np.sqrt((queries**2).sum(1)) * np.sqrt((rows**2).sum(1).max()))
    got = {(int(i), int(j)): int(s) for a, b, c in h.pairs_over(queries, thresholds, rows, lambda part: np.ones((len(queries[part]), 500), dtype=bool)) for i, j, s in zip(a, b, c, strict=True)}
    i, j = np.nonzero(scores >= thresholds[:, None])
    assert got == {(int(a), int(b)): int(scores[a, b]) for a, b in zip(i, j, strict=True)}


def test_dimensions_are_left_out_of_the_index():
    rows = np.array([[30.0, 3, 2, 1], [1, 1, 1, 1], [0, 0, 0, 0]])
    reach = np.array([0.2, 0.1, 0.1, 0.1, 0])
    assert h.Index(rows, reach).kept.tolist() == [1, 0, 0]
