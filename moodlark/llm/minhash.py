"""Near duplicates by SuperMinHash signatures, bands, exact verification and union-find.

Each shingle draws a random permutation of the signature's positions; at step j
it offers j plus a fraction to the j-th position of its permutation, and a
position keeps the smallest offer. Offers of step j all lie in [j, j + 1), so
the shingles of many texts take their steps together, and a text stops as soon
as each of its positions holds an offer of an earlier step.

Equal sets are one node. Nodes that agree in all rows of a band meet. The members
of each group that meets are compared with its first two; what is not connected
then is compared within blocks of bounded size, under union-find, so that a
group of texts that are alike costs few comparisons and never a row for each
pair.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodlark.llm.components import components
from moodlark.llm.tokens import as_bytes
from moodlark.workspace import written

# A pair at 0.85 shares no band with a probability of (1 - 0.85 ** 6) ** 32 = 3e-7.
BANDS, BAND_ROWS = 32, 6
# Shingles that take their steps together; bytes of the sets of a block; words a worker remembers.
_TOGETHER, BLOCK_BYTES, _REMEMBERED = 1 << 15, 16 << 20, 1 << 20
# Bits that tell which rows are read again: 4 MB, whatever the size of the table. Beyond some ten million
# rows they let more of the others pass, which the join sorts out.
FILTER_BITS = 1 << 25
_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of a public 64-bit generator (SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def shingles(text: bytes, n: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles of ``n`` words, sorted; the whole sequence if there are fewer.

    Words stand between ASCII white space, A-Z in lower case.
    """
    words, known = text.lower().split(), _words()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(known) > _REMEMBERED:
        known.clear()
    hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(n, len(words))
    found = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        found = (found ^ hashes[k : len(words) - width + 1 + k]) * _GOLDEN
        found ^= found >> _U(29)
    return np.unique(_mixed(found))


_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """The signature of each set: by position, step and fraction of the smallest offer."""
    out = np.full((len(sets), size), _EMPTY)
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    if lengths.sum():
        elements, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
        for start in range(0, len(elements), _TOGETHER):
            _offer(out, elements[start : start + _TOGETHER], owners[start : start + _TOGETHER], size)
    return out


def _offer(out: np.ndarray, elements: np.ndarray, owners: np.ndarray, size: int) -> None:
    """Lower ``out`` (by owner and position) to the offers of ``elements``."""
    flat, places = out.reshape(-1), None
    for step in range(size):
        drawn = _mixed(elements + _U((step + 1) * int(_GOLDEN) & int(_EMPTY)))
        # The place to swap with: uniform among those not taken by earlier steps.
        other = step + (((drawn & _U(0xFFFFFFFF)) * _U(size - step)) >> _U(32)).astype(np.int64)
        rows = np.arange(len(elements))
        if places is None:
            position = other
        else:
            position = places[rows, other].astype(np.int64)
            places[rows, other] = places[:, step]
        np.minimum.at(flat, owners * size + position, (_U(step) << _U(32)) | (drawn >> _U(32)))
        # Later steps offer more than any position holds that was filled until now.
        present = owners[np.flatnonzero(np.diff(owners, prepend=-1))]
        behind = np.zeros(len(out), dtype=bool)
        behind[present] = (out[present] >> _U(32)).max(axis=1) > step
        on = behind[owners]
        if not on.any():
            return
        if places is None:
            elements, owners, other = elements[on], owners[on], other[on]
            places = np.tile(np.arange(size, dtype=np.uint16), (len(elements), 1))
            # The first swap, with place 0.
            places[np.arange(len(elements)), other] = 0
        elif not on.all():
            elements, owners, places = elements[on], owners[on], places[on]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = signature.reshape(len(signature), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        keys = _mixed((keys ^ parts[:, :, k]) * _GOLDEN)
    return keys


def _read(docs: DataFrame, text: str, id: str) -> DataFrame:
    """Id, text and its hash, by which a row is found again."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"))


_SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("keys", pa.list_(pa.int64()))]
)


def _signed(read: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """The size, the 128-bit hash and the band keys of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [shingles(t, n) for t in as_bytes(part.column(2))]
                keys = band_keys(signatures(sets, bands * rows), bands, rows).view(np.int64).reshape(-1)
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype="<i8").reshape(-1, 2)
                offsets = np.arange(len(sets) + 1, dtype=np.int32) * bands
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))
                sizes = pa.array([len(s) for s in sets], pa.int64())
                columns = [part.column(0), part.column(1), sizes, pa.array(digests[:, 0]), pa.array(digests[:, 1]), listed]
                yield pa.record_batch(columns, schema=_SIGNED)

    return read.mapInArrow(run, "doc_id long, text_hash long, n long, high long, low long, keys array<long>")


def _likely(read: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``read`` that may be ``wanted``: few texts are moved for the rest.

    Each wanted row sets one bit. The bits are put together by the executors,
    and no more than ``FILTER_BITS`` of them pass the driver.
    """
    bit = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(FILTER_BITS)).alias("bit")
    words = wanted.select(bit).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    table = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    for word, bits in words.collect():
        table[word] = bits & 0xFFFFFFFFFFFFFFFF
    sent = read.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column(3))
            passes = (sent.value[at >> 6] >> (at & 63).astype(np.uint64)) & _U(1)
            yield batch.select([0, 1, 2]).filter(pa.array(passes.astype(bool)))

    return read.select("*", bit).mapInArrow(run, "doc_id long, text_hash long, text string")


def _sets(read: DataFrame, n: int) -> DataFrame:
    """``node, n, elements`` for rows of ``read`` with their node."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("elements", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [shingles(t, n) for t in as_bytes(part.column(1))]
                yield pa.record_batch([part.column(0), pa.array([len(s) for s in sets], pa.int64()), [s.tobytes() for s in sets]], schema=schema)

    return read.select("node", "text").mapInArrow(run, "node long, n long, elements binary")


def _alike(common: np.ndarray, one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (one + other - common)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are alike."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (batch.column(k).to_pylist() for k in (2, 3))
            common = np.array([len(np.intersect1d(np.frombuffer(x, _U), np.frombuffer(y, _U), True)) for x, y in zip(one, other, strict=True)], dtype=np.int64)
            sizes = [np.array([len(x) // 8 for x in side], dtype=np.int64) for side in (one, other)]
            yield pa.record_batch(batch.columns[:2], schema=schema).filter(pa.array(_alike(common, *sizes, percent), pa.bool_()))

    second = pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("other")), "b")
    both = second.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("one")), "a")
    return both.select("a", "b", "one", "other").mapInArrow(run, "a long, b long")


def links_within(
    elements: list[np.ndarray], keys: np.ndarray, band: int, labels: np.ndarray, sides: np.ndarray, percent: int
) -> list[tuple[int, int]]:
    """Links that connect what the alike pairs of one block connect, as positions.

    Members carry a label that says what is connected already. A pair is
    compared under its first common band only, unless its labels are connected
    or its sizes too different. ``sides`` keeps apart two pieces whose members
    meet among themselves elsewhere: pairs within side 1, or within side 2, are
    passed over.
    """
    sizes = np.array([len(e) for e in elements], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    _, ids = np.unique(np.concatenate(elements), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    marked = np.zeros(len(ids) and int(ids.max()) + 1, dtype=bool)
    _, labels = np.unique(labels, return_inverse=True)
    links = []
    for at, i in enumerate(order):
        rest = order[at + 1 :]
        rest = rest[(labels[rest] != labels[i]) & (100 * sizes[rest] >= percent * sizes[i]) & ((sides[rest] != sides[i]) | (sides[i] == 0))]
        if band and len(rest):
            rest = rest[~(keys[rest, :band] == keys[i, :band]).any(axis=1)]
        if not len(rest):
            continue
        own = ids[starts[i] : starts[i] + sizes[i]]
        marked[own] = True
        for j in rest:
            if labels[j] != labels[i]:
                common = np.count_nonzero(marked[ids[starts[j] : starts[j] + sizes[j]]])
                if _alike(common, sizes[i], sizes[j], percent):
                    links.append((int(i), int(j)))
                    labels[labels == labels[j]] = labels[i]
        marked[own] = False
    return links


def _within_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of labels among ``members`` (key, band, node, label, keys), in pairs of pieces of bounded size of each key's group."""
    sized = members.join(sets, "node")
    total = F.sum(F.octet_length("elements")).over(Window.partitionBy("key"))
    sized = sized.withColumn("pieces", F.ceil(total / BLOCK_BYTES).cast("int"))
    piece = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    # Piece p meets piece q as the pair (smaller, larger); side 0 is a piece that meets itself.
    meets = F.transform(
        F.sequence(F.lit(0), F.col("pieces") - 1),
        lambda q: F.struct(
            F.least(F.col("piece"), q).alias("one"),
            F.greatest(F.col("piece"), q).alias("other"),
            F.when(F.col("piece") == q, 0).when(F.col("piece") < q, 1).otherwise(2).alias("side"),
        ),
    )
    dealt = sized.withColumn("piece", piece).withColumn("m", F.explode(meets)).select("key", "m.*", "band", "label", "keys", "elements")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(block: pa.Table) -> pa.Table:
        labels, sides = (np.asarray(block[c]) for c in ("label", "side"))
        elements = [np.frombuffer(x, _U) for x in block["elements"].to_pylist()]
        keys = np.asarray(block["keys"].combine_chunks().flatten()).reshape(len(labels), -1)
        links = links_within(elements, keys, block["band"][0].as_py(), labels, sides, percent)
        pairs = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pa.table([labels[pairs[:, 0]], labels[pairs[:, 1]]], schema=schema)

    return dealt.groupBy("key", "one", "other").applyInArrow(run, "a long, b long")


def _open(members: DataFrame) -> DataFrame:
    """Members of groups that hold more than one label."""
    group = Window.partitionBy("key")
    return members.withColumns({"_l": F.min("label").over(group), "_h": F.max("label").over(group)}).where("_l < _h").drop("_l", "_h")


def near_duplicates(
    docs: DataFrame,
    n: int = 5,
    percent: int = 80,
    text: str = "text",
    id: str = "doc_id",
    bands: int = BANDS,
    rows: int = BAND_ROWS,
) -> DataFrame:
    """``id, n_shingles, component, kept`` for every row of ``docs``.

    Two texts are linked if their sets of ``n``-word shingles have at least
    ``percent`` hundredths in common, which is confirmed on the full sets.
    ``component`` is the smallest id that links reach, itself included; ``kept``
    says that this is the row's own.

    Null texts and texts without words have an empty set and no link. Null ids
    are passed over when the smallest is sought; a class without any id has a
    null component and keeps all its rows. Rows that repeat an id are all kept
    if it is the smallest. An empty table gives an empty table; other columns
    are not read.

    Texts are read twice: for the signatures, and again for the sets of those
    that meet another. Bands decide which pairs meet; of those that do, no link
    between different sets is lost.
    """
    read = _read(docs, text, id)
    signed = written(_signed(read, n, bands, rows), "minhash-signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    grouped = signed.where("n > 0").groupBy("high", "low").agg(first, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = written(
        grouped.select("high", "low", "first.doc_id", "first.text_hash", "copies", "n", "keys", F.monotonically_increasing_id().alias("node")),
        "minhash-nodes",
    )
    group = Window.partitionBy("key").orderBy("node")
    exploded = nodes.select("node", "n", F.posexplode("keys").alias("band", "key"))
    placed = exploded.withColumns({"before": F.lag("node").over(group), "after": F.lead("node").over(group)})
    members = placed.where("before IS NOT NULL OR after IS NOT NULL").select("key", "band", "node", "n")
    members = written(members, "minhash-members")

    wanted = written(members.select("node").distinct().join(nodes.select("node", "doc_id", "text_hash"), "node"), "minhash-wanted")
    found = _likely(read, wanted).join(wanted.withColumnRenamed("doc_id", "i").withColumnRenamed("text_hash", "h"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")))
    sets = written(_sets(found, n).dropDuplicates(["node"]), "minhash-sets")

    leaders = {f"lead_{c}": F.first(c).over(group) for c in ("node", "n")} | {f"next_{c}": F.nth_value(c, 2).over(group) for c in ("node", "n")}
    led = members.withColumns(leaders)
    pairs = None
    for lead, size in (("lead_node", "lead_n"), ("next_node", "next_n")):
        apart = led.where((F.col("node") > F.col(lead)) & (100 * F.least("n", size) >= percent * F.greatest("n", size)))
        star = apart.select(F.col(lead).alias("a"), F.col("node").alias("b"))
        pairs = star if pairs is None else pairs.union(star)
    links = written(_verified(written(pairs.distinct(), "minhash-pairs"), sets, percent), "minhash-links")
    labels = written(components(links), "minhash-labels").withColumnRenamed("component", "label")
    others = led.where(F.col("node") > F.col("next_node")).select("key", "band", "node").join(labels, "node", "left")
    rest = written(_open(others.withColumn("label", F.coalesce("label", "node"))), "minhash-rest")
    joined = written(_within_blocks(rest.join(nodes.select("node", "keys"), "node"), sets, percent), "minhash-links-blocks")
    classes = components(joined).select(F.col("node").alias("label"), F.col("component").alias("class"))

    linked = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(classes, "label", "left")
    linked = linked.withColumn("class", F.coalesce("class", "label"))
    firsts = linked.groupBy("class").agg(F.min("doc_id").alias("component"), F.sum("copies").alias("members"))
    # A text alone is its own component: only the others are looked up.
    several = written(linked.join(firsts.where("members > 1"), "class").select("high", "low", "component", F.lit(True).alias("shared")), "minhash-classes")
    by_set = signed.select("doc_id", "n", "high", "low").join(several, ["high", "low"], "left")
    component = F.when((F.col("n") > 0) & F.col("shared"), F.col("component")).otherwise(F.col("doc_id"))
    out = by_set.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component"))
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component")))
    return out.withColumnRenamed("doc_id", id)
