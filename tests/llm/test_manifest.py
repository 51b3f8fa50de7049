import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from moodlark.llm import manifest as m
from moodlark.llm import queries  # noqa: F401
from moodlark.llm.registry import QUERIES

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
ALPHABET = {c: c + 32 for c in range(65, 91)}


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves, fan=16):
    """The root, and the siblings of each leaf from below."""
    nodes, siblings, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fan] for i in range(0, len(nodes), fan)]
        for leaf, i in enumerate(at):
            run, k = runs[i // fan], i % fan
            siblings[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            at[leaf] = i // fan
        nodes = [sha(*run) for run in runs]
    return nodes[0], siblings


def expected(rows, fan=16):
    """By hand: doc_id, leaf, subroot, root, proof, folded root, verified."""
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        own = sorted(sources[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[name] = own, tree([leaf_of(r) for r in own], fan)
    root, upper = tree([trees[name][1][0] for name in names], fan)
    out = []
    for name, above in zip(names, upper, strict=True):
        own, (subroot, siblings) = trees[name]
        for row, steps in zip(own, siblings, strict=True):
            steps = steps + above
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            text = row[4].translate(ALPHABET) if hit and row[4] is not None else row[4]
            folded = leaf_of((*row[:4], text))
            for left, right in steps:
                folded = sha(left, folded, right)
            out.append((row[0], leaf_of(row), subroot, root, sha(*[x + y for x, y in steps]), folded, folded == root))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture
def query_over(spark, tmp_path):
    def run(rows, schema=DOCS):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return QUERIES["op13_manifest"](spark, str(tmp_path))

    return run


def test_query_against_brute_force_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*m.COLUMNS)
    got = found(QUERIES["op13_manifest"](spark, folder))
    assert got == expected([tuple(r) for r in docs.collect()])
    assert {r[-1] for r in got} == {True, False}


def test_nulls_ties_repeats_and_sizes_around_the_fan(query_over):
    draw = random.Random(2)
    rows = []
    for source, n in ((None, 1), ("", 2), ("a", 16), ("B", 17), ("é", 256), ("日本", 257), ("z", 300)):
        rows += [(draw.randrange(1000), source, draw.choice(["en", None]), draw.choice([None, 3]), draw.choice([None, "", "Ünï ABC xyz", "é" * 5])) for _ in range(n)]
    rows += [(None, "z", None, None, None), (None, None, None, None, "Q"), (7, "z", "en", 1, "Long Text " * 30_000)]
    rows += rows[:40]
    assert found(query_over(rows)) == expected(rows)


@pytest.mark.parametrize("n", [0, 1])
def test_none_or_one(query_over, n):
    rows = [(5, "s", "en", 2, "Ab")] * n
    got = found(query_over(rows))
    assert got == (expected(rows) if n else [])
    assert [r[4] for r in got] == [sha()] * n


def test_many_sources_other_fan_and_clashing_columns(spark):
    rows = [(i, f"s{i % 23}", "en", i, f"Text {i}") for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("mine") for c in ("group", "lo", "total", "digest", "carried", "id", "other", "place")})
    made = m.manifest(docs, fan=3)
    got = made.proofs().select("id", "leaf", "subroot", "root", m.proof_digest(F.col("path")), m.folded(F.col("leaf"), F.col("path")))
    assert found(got) == sorted(((*r[:5], r[3]) for r in expected(rows, 3)), key=str)
    nodes = made.nodes().collect()
    for source in ("s0", "s22"):
        own = sorted((r["level"], r["lo"], r["hi"]) for r in nodes if r["tree"] == "source" and r["source"] == source)
        n = sum(level == 0 for level, _, _ in own)
        assert own[-1][1:] == (0, n)
        assert [lo for level, lo, _ in own if level == 1] == list(range(0, n, 3))
    assert [r["digest"] for r in nodes if r["tree"] == "top"][-1] == made.root or made.root in {r["digest"] for r in nodes}
