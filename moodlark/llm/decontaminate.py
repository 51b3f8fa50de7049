"""Benchmark decontamination by SimHash of item-sized windows.

A window of a document is worth a look only where it shares a shingle with
some benchmark item, since the final test asks for many in common. There, a
window of the item's size is fingerprinted; all items whose fingerprints lie
within the radius are found through tables of 8-bit blocks, and verified by
the exact similarity of their weighted shingles.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodlark.llm.tokens import as_bytes

SHINGLE = 5
SIMILARITY = 0.8
# Texts as similar as asked for differ in 10 bits on average. Of eight blocks of
# a fingerprint within this radius, one differs in at most two bits.
RADIUS = 23
_BLOCKS, _FLIPS = 8, RADIUS // 8
# Bytes of benchmark text that one broadcast index holds; larger benchmarks go in several passes.
INDEX_BYTES = 32 << 20
_WORD = re.compile(r"\w+")
_MULTIPLIERS = np.array([int.from_bytes(xxhash.xxh64_digest(bytes([i]))) | 1 for i in range(SHINGLE)], dtype=np.uint64)
# Words whose hash a worker remembers before it starts anew.
_REMEMBERED = 500_000
_hashes: dict[str, int] = {}


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and length of each word; words are runs of letters and digits in lower case."""
    words = _WORD.findall(text.decode().lower())
    if len(_hashes) > _REMEMBERED:
        _hashes.clear()
    for word in set(words).difference(_hashes):
        _hashes[word] = xxhash.xxh64_intdigest(word)
    n = len(words)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, n), np.fromiter(map(len, words), np.int64, n)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words."""
    count = max(0, len(words) - n + 1)
    mixed = np.zeros(count, dtype=np.uint64)
    for i in range(n):
        mixed += words[i : i + count] * _MULTIPLIERS[i]
    mixed ^= mixed >> np.uint64(29)
    return mixed * _MULTIPLIERS[0]


def weights(lengths: np.ndarray, n: int) -> np.ndarray:
    """A shingle weighs as many characters as its words have."""
    sums = np.concatenate(([0], np.cumsum(lengths)))
    return sums[n:] - sums[:-n] if len(lengths) >= n else np.zeros(0, dtype=np.int64)


def print_of(hashes: np.ndarray, weight: np.ndarray) -> int:
    """Weighted majority of the bits of all shingles."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * (weight @ bits) > weight.sum(), bitorder="little").view(np.uint64)[0])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weight in common over weight in either, repeats counted."""
    keys, at = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    left = np.bincount(at[: len(a[0])], a[1], len(keys))
    right = np.bincount(at[len(a[0]) :], b[1], len(keys))
    total = np.maximum(left, right).sum()
    return float(np.minimum(left, right).sum() / total) if total else 0.0


@dataclass
class Item:
    id: int | None
    size: int
    hashes: np.ndarray
    weight: np.ndarray


class Index:
    """Items by their shingles and by the blocks of their fingerprints.

    Items of fewer than five words have one shingle of all their words; they
    are kept apart by its length ``n``. Items without words match nothing.
    """

    def __init__(self, items: list[tuple[int | None, bytes]]) -> None:
        self.by_length: dict[int, _Part] = {}
        grouped: dict[int, list[Item]] = {}
        for id, text in items:
            words, lengths = words_of(text)
            if n := min(SHINGLE, len(words)):
                grouped.setdefault(n, []).append(Item(id, len(words), shingles(words, n), weights(lengths, n)))
        self.by_length = {n: _Part(n, found) for n, found in grouped.items()}

    def matches(self, text: bytes, at_least: float) -> list[tuple[int | None, float, int, int]]:
        """(item, similarity, first word, words) of the best window for each item."""
        words, lengths = words_of(text)
        return [m for part in self.by_length.values() for m in part.matches(words, lengths, at_least)]


class _Part:
    def __init__(self, n: int, items: list[Item]) -> None:
        self.n, self.items = n, items
        owner = np.repeat(np.arange(len(items)), [len(i.hashes) for i in items])
        offset = np.concatenate([np.arange(len(i.hashes)) for i in items])
        hashes = np.concatenate([i.hashes for i in items])
        order = np.argsort(hashes, kind="stable")
        self.known, first = np.unique(hashes[order], return_index=True)
        self.bounds = np.append(first, len(hashes))
        # What a shared shingle says of the window: the item's size, and words before the shingle.
        self.size = np.array([i.size for i in items])[owner[order]]
        self.before = offset[order]
        self.prints = np.array([print_of(i.hashes, i.weight) for i in items], dtype=np.uint64)
        bytes_ = self.prints.view(np.uint8).reshape(-1, 8)
        self.tables = [[np.flatnonzero(bytes_[:, b] == v) for v in range(256)] for b in range(_BLOCKS)]
        self.flips = [sum(1 << i for i in c) for k in range(_FLIPS + 1) for c in combinations(range(8), k)]

    def near(self, fingerprint: int) -> np.ndarray:
        """All items within the radius."""
        found = np.zeros(len(self.items), dtype=bool)
        for b in range(_BLOCKS):
            value = fingerprint >> (8 * b) & 0xFF
            for flip in self.flips:
                found[self.tables[b][value ^ flip]] = True
        candidates = np.flatnonzero(found)
        return candidates[np.bitwise_count(self.prints[candidates] ^ np.uint64(fingerprint)) <= RADIUS]

    def windows(self, hashes: np.ndarray, n_words: int) -> set[tuple[int, int]]:
        """(first word, words) of the item-sized windows around all shared shingles."""
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        windows: set[tuple[int, int]] = set()
        for position in np.flatnonzero(self.known[at] == hashes):
            a, b = self.bounds[at[position]], self.bounds[at[position] + 1]
            size = np.minimum(self.size[a:b], n_words)
            start = np.clip(position - self.before[a:b], 0, n_words - size)
            windows.update(zip(start.tolist(), size.tolist(), strict=True))
        return windows

    def matches(self, words: np.ndarray, lengths: np.ndarray, at_least: float) -> list[tuple[int | None, float, int, int]]:
        if len(words) < self.n:
            return []
        hashes, weight = shingles(words, self.n), weights(lengths, self.n)
        best: dict[int, tuple[float, int, int]] = {}
        for start, size in sorted(self.windows(hashes, len(words))):
            window = slice(start, start + size - self.n + 1)
            mine = hashes[window], weight[window]
            for i in self.near(print_of(np.ascontiguousarray(mine[0]), mine[1])):
                found = similarity(mine, (self.items[i].hashes, self.items[i].weight))
                if found >= at_least and found > best.get(i, (0.0, 0, 0))[0]:
                    best[int(i)] = (found, start, size)
        return [(self.items[i].id, *match) for i, match in sorted(best.items())]


def _blocks(benchmark: DataFrame, id: str, text: str) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items, fetched partition by partition, in lists of bounded size."""
    held, total = [], 0
    for row in benchmark.select(F.col(id).cast("long"), F.encode(F.coalesce(text, F.lit("")), "UTF-8")).toLocalIterator():
        held.append((row[0], bytes(row[1])))
        total += len(row[1]) + 64
        if total >= INDEX_BYTES:
            yield held
            held, total = [], 0
    if held:
        yield held


SCHEMA = "doc_id long, text_hash long, item_id long, similarity double, first_word long, n_words long"
_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()),
        ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64()),
    ]
)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    at_least: float = SIMILARITY,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Items found in documents: ``doc_id, text_hash, item_id, similarity, first_word, n_words``.

    One row per document and item of the benchmark, for its best window (the
    first, of equals) of the document, if that is at least ``at_least``
    similar. Whole texts are searched. Documents without a find have no row.
    Null texts are empty and contain nothing; null ids are carried along, and
    ``text_hash`` tells rows apart that share an id. Repeated rows, on either
    side, give repeated finds. An empty benchmark or table gives no rows.

    Documents are not moved; the benchmark is sent to all tasks in an index of
    bounded size, in as many passes over the documents as that takes.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.col(text).alias("text"))

    def searched(items: list[tuple[int | None, bytes]]) -> DataFrame:
        index = spark.sparkContext.broadcast(Index(items))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (doc, h, *match)
                    for doc, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True)
                    for match in index.value.matches(t, at_least)
                ]
                if rows:
                    yield pa.record_batch([list(c) for c in zip(*rows, strict=True)], schema=_SCHEMA)

        return read.mapInArrow(run, SCHEMA)

    found = spark.createDataFrame([], SCHEMA)
    for items in _blocks(benchmark, item_id, item_text):
        found = found.union(searched(items))
    return found


def without_leaks(docs: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that ``found`` names."""
    named = found.select("doc_id", "text_hash").distinct()
    whole = docs.select(F.struct("*").alias("whole"))
    text_hash = F.xxhash64(F.coalesce(F.col("whole")[text], F.lit("")))
    same = F.col("whole")[id].eqNullSafe(F.col("doc_id")) & (text_hash == F.col("text_hash"))
    return whole.join(named, same, "left_anti").select("whole.*")
