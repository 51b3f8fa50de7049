"""SimHash fingerprints and near-duplicate classes by pigeonring filtering.

Fingerprints that differ in at most three of 64 bits are linked. The bits are
eight segments on a ring. If the differences of two fingerprints sum up to at
most three, some segment starts a chain whose first l segments, for every l,
differ in at most 3 * l / 8 bits together: none in the first two, at most one
in the first five, at most two in the first seven. So from some start two
segments are equal and, of the next three, at least two. Fingerprints meet
under those four segments (32 bits), for each start and each choice; the whole
chain is tested before bits are counted.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodlark.llm.components import components
from moodlark.llm.tokens import as_bytes
from moodlark.workspace import written

SEED = 42
RADIUS = 3
_SEGMENTS = 8
# Bits that a chain of 1, 2, ... segments may differ in.
_BUDGET = np.array([RADIUS * length // _SEGMENTS for length in range(1, _SEGMENTS + 1)], dtype=np.uint8)
# Shingles that are hashed before their bits are added up.
_BLOCK = 1 << 15


def fingerprint(text: bytes, n: int) -> int:
    """The 64 majority bits of the hashes of all shingles of ``n`` words; 0 without words.

    Words stand between ASCII white space, A-Z in lower case.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[n - 1 :] if len(words) >= n else ends[-1:]
    spans = zip(starts[: len(last)].tolist(), last.tolist(), strict=True)
    counts, total, digest = np.zeros(64, dtype=np.int64), len(last), xxhash.xxh64_intdigest
    for _ in range(0, total, _BLOCK):
        block = [digest(joined[a:b], SEED) for _, (a, b) in zip(range(_BLOCK), spans)]
        bits = np.unpackbits(np.array(block, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id, print``: the fingerprint of each text as a signed 64-bit number. Null texts are empty."""
    schema = pa.schema([(id, pa.int64()), ("print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, n) for t in as_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], schema=schema)

    return docs.select(F.col(id).cast("long").alias(id), F.col(text).alias("text")).mapInArrow(run, f"`{id}` long, print long")


def _chains() -> list[tuple[int, tuple[int, ...]]]:
    """Every start with the four segments that are equal: the first two, and two of the next three."""
    return [
        (start, tuple(sorted(((start, (start + 1) % 8) + tuple((start + k) % 8 for k in pair)))))
        for start in range(_SEGMENTS)
        for pair in combinations((2, 3, 4), 2)
    ]


def _mask(segments: tuple[int, ...]) -> int:
    mask = sum(0xFF << (8 * s) for s in segments)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _meeting(prints: DataFrame) -> DataFrame:
    """Each fingerprint under each of its keys; the same four segments are one key."""
    masks = sorted({_mask(segments) for _, segments in _chains()})
    keys = F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.col("print").bitwiseAND(F.lit(m)).alias("key")) for m in masks]))
    return prints.select("print", keys.alias("k")).select("k.mask", "k.key", "print")


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def ring_test(differences: np.ndarray) -> np.ndarray:
    """Whether 64-bit differences have a chain within budget from some start."""
    each = _bits(np.ascontiguousarray(differences, dtype="<u8").view(np.uint8).reshape(-1, 8))
    found = np.zeros(len(each), dtype=bool)
    for start in range(_SEGMENTS):
        found |= (np.cumsum(np.roll(each, -start, axis=1), axis=1, dtype=np.uint8) <= _BUDGET).all(axis=1)
    return found


# Up to this many members, a group is compared pair by pair, row after row.
_PAIRWISE = 2048


def _near_masks(free: int) -> np.ndarray:
    """All differences of one to three bits among the bits of ``free``."""
    bits = [1 << b for b in range(64) if free >> b & 1]
    return np.array([sum(c) for n in (1, 2, 3) for c in combinations(bits, n)], dtype=np.uint64)


def _forest(members: np.ndarray, mask: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs of ``members`` (distinct, sorted) within the radius connect.

    A link that would close a circle is left out, so there are fewer than
    members. Small groups are compared row by row. In large ones each possible
    difference of the free bits is looked up, which takes time in proportion
    to the members, not to their square.
    """
    root = np.arange(len(members))
    links = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((int(members[i]), int(members[j])))

    if len(members) <= _PAIRWISE:
        for i in range(len(members) - 1):
            differences = members[i + 1 :] ^ members[i]
            near = np.flatnonzero(ring_test(differences)) if len(differences) > 8 else np.arange(len(differences))
            near = near[_bits(differences[near]) <= RADIUS]
            for j in near:
                join(i, i + 1 + int(j))
        return links
    for difference in _near_masks(~mask & (1 << 64) - 1):
        wanted = members ^ difference
        at = np.minimum(np.searchsorted(members, wanted), len(members) - 1)
        hit = np.flatnonzero((members[at] == wanted) & (members < wanted))
        hit = hit[root[hit] != root[at[hit]]]
        for i in hit:
            join(int(i), int(at[i]))
    return links


def _links(meeting: DataFrame) -> DataFrame:
    """Links (a, b) within each group of fingerprints that share a key."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [np.asarray(c) for c in batch.columns]
            if rest is not None:
                now = [np.concatenate(pair) for pair in zip(rest, now, strict=True)]
            mask, key, prints = now
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            # The last group may go on in the next batch.
            done = int(cuts[-1]) if len(cuts) else 0
            yield from _groups(now, np.concatenate(([0], cuts)))
            rest = [c[done:] for c in now]
        if rest is not None:
            yield from _groups(rest, np.array([0, len(rest[0])]))

    def _groups(columns: list[np.ndarray], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        mask, _, prints = columns
        found: list[tuple[int, int]] = []
        large = np.flatnonzero(np.diff(bounds) > 1)
        for g in large:
            members = np.unique(prints[bounds[g] : bounds[g + 1]].view(np.uint64))
            found += _forest(members, int(mask[bounds[g]]) & (1 << 64) - 1)
        if found:
            pairs = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    dealt = meeting.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 3, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id, print, component`` for every row of ``docs``.

    ``print`` is the SimHash of all shingles of ``n`` words of the whole text;
    ``component`` is the smallest id that links of at most three differing bits
    reach, itself included. Equal fingerprints are one node, so any number of
    copies costs one row. No link between different fingerprints is lost: groups
    under a key may have any size, and pass on links that connect the same.

    A null text is empty, its fingerprint is 0 and links like any other. Null
    ids are passed over when the smallest is sought (null if there is no other).
    Repeated rows are kept; an empty table gives an empty table.
    """
    printed = written(fingerprints(docs, n, text, id), "prints")
    distinct = written(printed.groupBy("print").agg(F.min(id).alias("first")), "print-firsts")
    classes = components(_links(_meeting(distinct.select("print"))))
    linked = distinct.join(classes, distinct["print"] == classes["node"], "left").select(
        "print", "first", F.coalesce("component", "print").alias("class")
    )
    firsts = linked.groupBy("class").agg(F.min("first").alias("component"))
    by_print = written(linked.join(firsts, "class").select("print", "component"), "print-classes")
    return printed.join(by_print, "print").select(id, "print", "component")


def one_of_each(docs: DataFrame, n: int = 3, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class of near duplicates, that of the smallest id.

    Of rows that share that id and fingerprint one stays. A class without any
    id keeps one row. Columns are those of ``docs``.
    """
    numbered = written(docs.select(F.struct("*").alias("whole"), F.monotonically_increasing_id().alias("row")), "numbered")
    found = near_duplicates(numbered.select("row", F.col("whole")[text].alias("text")), n, "text", "row")
    ids = found.join(numbered.select("row", F.col("whole")[id].alias("id")), "row")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    stays = ids.groupBy("component").agg(F.min_by("row", order).alias("row")).select("row")
    return numbered.join(stays, "row", "left_semi").select("whole.*")
