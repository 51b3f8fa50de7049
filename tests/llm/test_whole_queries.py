"""Columns of registered queries against plain Python, over the whole smallest tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from moodlark.llm import queries
from moodlark.llm.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def rows_of(spark, name):
    rows = QUERIES[name](spark, SF_DIR).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(found) == len(rows)
    return found


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ids_of(text):
    library = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    return library.encode(text or "", add_special_tokens=False).ids


def test_op2_counts(spark, docs):
    found = rows_of(spark, "op2_token_counts")
    assert set(found) == set(docs)
    for i, r in found.items():
        n = len(ids_of(docs[i]["text"]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((docs[i]["text"] or "").encode()), n, n > 2048)


def test_op4_fingerprints_and_components(spark, docs):
    found = rows_of(spark, "op4_simhash_near_duplicates")
    prints = {}
    for i, d in docs.items():
        words = [re.sub("[A-Z]", lambda c: c[0].lower(), w) for w in words_of(d["text"])]
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        counts = np.zeros(64, dtype=int)
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            counts += np.array([h >> b & 1 for b in range(64)])
        prints[i] = sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))
    assert {i: r["fingerprint"] for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in docs:
        for j in docs:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: r["component_id"] for i, r in found.items()} == {i: find(i) for i in docs}


def test_op5_targets_and_words_taken(spark, docs):
    found = rows_of(spark, "op5_mix")
    sizes = {i: len(words_of(d["text"])) for i, d in docs.items()}
    assert {i: r["size"] for i, r in found.items()} == sizes
    of_source = defaultdict(int)
    for i, d in docs.items():
        of_source[d["source"]] += sizes[i]
    order = sorted(of_source, key=lambda s: (s is None, s or ""))
    weights = {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}
    targets, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: left * weights[s] / sum(weights[t] for t in free) for s in free}
        over = {s for s in free if share[s] > 3 * of_source[s]}
        targets |= {s: 3.0 * of_source[s] for s in over} if over else share
        left -= sum(targets[s] for s in over)
        free = free - over if over else set()
    taken = defaultdict(int)
    for i, r in found.items():
        assert r["source_size"] == of_source[docs[i]["source"]]
        assert r["target"] == pytest.approx(targets[docs[i]["source"]], rel=1e-6)
        assert r["taken"] <= 3 * r["size"] and (r["taken"] == 0 or r["taken"] % r["size"] == 0)
        taken[docs[i]["source"]] += r["taken"]
    largest = {s: max(sizes[i] for i, d in docs.items() if d["source"] == s) for s in order}
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in order)
    assert rows_of(spark, "op5_mix") == found


def test_op9_statistics(spark, docs):
    found = rows_of(spark, "op9_quality")
    for i, r in found.items():
        text = docs[i]["text"] or ""
        words = words_of(text)
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeated = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [line for line in text.split("\n") if words_of(line)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_op10_places_and_digests(spark, docs):
    found, start = rows_of(spark, "op10_token_files"), 0
    assert set(found) == set(docs)
    for i in sorted(docs):
        ids = np.array([*ids_of(docs[i]["text"]), 2], dtype="<u4")
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
