"""Hard negatives by threshold joins over an inverted index (L2AP).

Anchors and rows are dealt out into blocks of bounded size, and each block of
anchors meets each block of rows in one task. There, rows are put into an
inverted index of dimensions. By Cauchy-Schwarz, the last dimensions of a row
whose norm is too small to reach any anchor's threshold are left out of it; so
is a row that is covered as a whole. Partial scores are accumulated dimension
by dimension, pairs are dropped as soon as the norms that remain cannot lift
them over the threshold, and what is left is scored exactly in integers.

Thresholds begin high and are lowered, for those anchors and windows only that
are not full yet, until they are full or the window's end is reached. What a
round finds for a full window is its exact top, since all that was not looked at
scores lower.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodlark.workspace import written

# Bytes of the vectors of one block.
BLOCK_BYTES = 8 << 20
# Anchors that are compared with a block together, and dimensions of one step.
_TOGETHER, _STEP = 64, 8
# Pairs are listed one by one when this share of them is left, and verified by so many.
_SPARSE, _VERIFIED = 0.1, 1 << 16
# Shares of the largest possible score at which the search for positives begins and goes on.
POSITIVE_LEVELS = (0.5, 0.3, 0.15, None)
# Shares of the positive's score down to which its window is searched, before the whole window.
NEGATIVE_LEVELS = (0.9, 0.75, None)


def quantized(vector: Column, scale: int) -> Column:
    """Each component x as the whole number floor(scale * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """List column as rows of ``width`` whole numbers; shorter lists are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths())
    values = np.asarray(column.flatten())
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _suffix_norms(rows: np.ndarray) -> np.ndarray:
    """Norm of each row from dimension 0, 1, ... on; the last column is 0."""
    squares = np.cumsum((rows * rows)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(rows), 1))], axis=1))


class Index:
    """Rows by dimension, for queries (each scaled so that its threshold is 1) that reach ``reach`` from a dimension on."""

    def __init__(self, rows: np.ndarray, reach: np.ndarray | None) -> None:
        self.norms = _suffix_norms(rows)
        width = rows.shape[1]
        # By row, how many dimensions are in the index: what follows cannot reach 1 alone.
        if reach is None:
            self.kept = np.full(len(rows), max(width, 1))
        else:
            self.kept = (self.norms[:, :width] * reach[:width] >= 1 - 1e-9).sum(axis=1)
        self.steps = []
        for start in range(0, width, _STEP):
            stop = min(start + _STEP, width)
            listed = np.flatnonzero(self.kept > start)
            inside = np.arange(start, stop) < self.kept[listed, None]
            self.steps.append((start, stop, listed, np.where(inside, rows[listed, start:stop], 0.0)))

    def remaining(self, q_norms: np.ndarray, i: np.ndarray, j: np.ndarray, done: int) -> np.ndarray:
        """The most that dimensions can add which are not accumulated after ``done``: later ones and those left out."""
        cut = np.minimum(self.kept[j], done)
        return q_norms[i, cut] * self.norms[j, cut]


def pairs_over(
    queries: np.ndarray, thresholds: np.ndarray, rows: np.ndarray, allowed: Callable[[slice], np.ndarray]
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, exact score) of all allowed pairs that score at least the query's threshold, in blocks.

    ``allowed`` gives, for a slice of the queries, which rows each may meet.
    A threshold of minus infinity lets everything pass.
    """
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if largest >= 2.0**62:
        raise ValueError("scores do not fit 64 bits")
    # The same order of dimensions for all: those with most of the queries' weight first.
    order = np.argsort(-(queries.astype(float) ** 2).sum(axis=0), kind="stable")
    q, x = queries[:, order].astype(float), rows[:, order].astype(float)
    q_norms = _suffix_norms(q)
    index = Index(x, (q_norms / thresholds[:, None]).max(axis=0) if (thresholds > 0).all() else None)
    # Sums of whole numbers are exact in doubles up to 2**53; beyond, rounding is allowed for.
    lowest = thresholds - 0.5 - largest * 1e-12
    for start in range(0, len(q), _TOGETHER):
        part = slice(start, start + _TOGETHER)
        i, j = _near(index, q[part], q_norms[part], lowest[part], x, allowed(part) & (index.kept > 0))
        for block in range(0, len(i), _VERIFIED):
            a, b = i[block : block + _VERIFIED] + start, j[block : block + _VERIFIED]
            score = (queries[a] * rows[b]).sum(axis=1)
            over = score >= thresholds[a]
            if over.any():
                yield a[over], b[over], score[over]


def _near(
    index: Index, q: np.ndarray, q_norms: np.ndarray, lowest: np.ndarray, x: np.ndarray, alive: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``alive`` that partial scores and remaining norms cannot rule out."""
    partial, pairs = np.zeros(alive.shape), None
    all_i, all_j = np.arange(len(q))[:, None], np.arange(len(x))[None, :]
    for first, last, listed, values in index.steps:
        if pairs is None:
            partial[:, listed] += q[:, first:last] @ values.T
            alive &= partial + index.remaining(q_norms, all_i, all_j, last) >= lowest[:, None]
            if np.count_nonzero(alive) <= _SPARSE * alive.size:
                pairs = np.nonzero(alive)
                score = partial[pairs]
        else:
            i, j = pairs
            inside = np.arange(first, last) < index.kept[j, None]
            score = score + np.where(inside, q[i, first:last] * x[j, first:last], 0.0).sum(axis=1)
            near = score + index.remaining(q_norms, i, j, last) >= lowest[i]
            pairs, score = (i[near], j[near]), score[near]
    return np.nonzero(alive) if pairs is None else pairs


def first_of_each(groups: np.ndarray, order: tuple[np.ndarray, ...], n: int) -> np.ndarray:
    """Positions of the first ``n`` of each group; ``order`` has its most important key first."""
    by = np.lexsort((*reversed(order), groups))
    sorted_groups = groups[by]
    new = np.flatnonzero(np.concatenate(([True], sorted_groups[1:] != sorted_groups[:-1])))
    place = np.arange(len(by)) - np.repeat(new, np.diff(np.append(new, len(by))))
    return by[place < n]


def _best(frame: DataFrame, by: list[str], n: int, id: str, row: str) -> DataFrame:
    ranked = Window.partitionBy(*by).orderBy(F.desc("score"), id, row)
    return frame.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= n)


class _Blocks:
    """Rows in blocks of bounded size, and what meets them."""

    def __init__(self, vectors: DataFrame, anchor: Column, id: str, label: str, vector: str) -> None:
        read = vectors.select(
            F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor")
        )
        read = read.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
        read = read.withColumn("row", F.xxhash64("id", F.col("label").cast("string"), "v")).dropDuplicates(["id", "row"])
        read = read.withColumn("label", F.xxhash64(F.col("label").cast("string")))
        squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
        self.rows = written(read.withColumn("norm", F.sqrt(squares)), "negatives-rows")
        sizes = self.rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max("norm").alias("norm")).first()
        self.n, self.width, self.norm = sizes["n"], sizes["width"] or 0, sizes["norm"] or 0.0
        self.block = max(BLOCK_BYTES // (8 * max(self.width, 1)), _TOGETHER)

    def meet(self, queries: DataFrame, run: Callable, schema: str) -> DataFrame:
        """``run`` for each block of ``queries`` and each block of the rows."""
        blocks, row_blocks = -(-queries.count() // self.block), -(-self.n // self.block)
        dealt = lambda of, n: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = queries.withColumn("a", dealt(("id", "row"), blocks)).withColumn("r", every(row_blocks))
        right = self.rows.select("id", "row", "label", "v", dealt(("row", "id"), row_blocks).alias("r")).withColumn("a", every(blocks))
        return left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(run, schema)


_POSITIVES = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("positive", pa.int64()), ("positive_row", pa.int64()), ("score", pa.int64())])


def _positives(blocks: _Blocks, n: int) -> DataFrame:
    """``id, row, positive, positive_row, score``: the first ``n`` other rows of each anchor's label."""
    width = blocks.width

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _POSITIVES.empty_table()
        ids, rows, labels = ([np.asarray(t[c]) for t in (left, right)] for c in ("id", "row", "label"))

        def allowed(part: slice) -> np.ndarray:
            same = labels[0][part, None] == labels[1]
            return same & ~((ids[0][part, None] == ids[1]) & (rows[0][part, None] == rows[1]))

        found = [np.empty((0, 3), dtype=np.int64)]
        for i, j, score in pairs_over(matrix(left["v"], width), np.asarray(left["t"]), matrix(right["v"], width), allowed):
            top = first_of_each(i, (-score, ids[1][j], rows[1][j]), n)
            found.append(np.stack([i[top], j[top], score[top]], axis=1))
        i, j, score = np.concatenate(found).T
        return pa.table([ids[0][i], rows[0][i], ids[1][j], rows[1][j], score], schema=_POSITIVES)

    wanted, full = blocks.rows.where("anchor").drop("anchor"), []
    for number, level in enumerate(POSITIVE_LEVELS):
        t = F.lit(float("-inf")) if level is None else F.ceil(F.lit(level * blocks.norm) * F.col("norm")).cast("double")
        queries = wanted.withColumn("t", t)
        if queries.isEmpty():
            break
        schema = "id long, row long, positive long, positive_row long, score long"
        met = blocks.meet(queries.select("id", "row", "label", "v", "t"), run, schema)
        best = written(_best(met, ["id", "row"], n, "positive", "positive_row"), f"positives-{number}")
        if level is None:
            full.append(best)
        else:
            filled = best.where(F.col("place") == n).select("id", "row")
            full.append(best.join(filled, ["id", "row"], "left_semi"))
            wanted = written(wanted.join(filled, ["id", "row"], "left_anti"), "positives-wanted")
    return _union(full)


_NEGATIVES = pa.schema(
    [("id", pa.int64()), ("row", pa.int64()), ("window", pa.int32()), ("negative", pa.int64()), ("negative_row", pa.int64()), ("score", pa.int64())]
)


def _negatives(blocks: _Blocks, windows: DataFrame, n: int) -> DataFrame:
    """``id, row, window, negative, negative_row, score, place``: the first ``n`` rows of another label in each window.

    ``windows``: id, row, window (its number), low, high, positive score.
    """
    width = blocks.width

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _NEGATIVES.empty_table()
        ids, rows, labels = ([np.asarray(t[c]) for t in (left, right)] for c in ("id", "row", "label"))
        # The windows of all queries, one after another.
        of = left["windows"].combine_chunks()
        counts, flat = np.asarray(of.value_lengths()), of.flatten()
        number, low, high = (np.asarray(flat.field(k)) for k in ("window", "from", "high"))
        first = np.cumsum(counts) - counts
        found = [np.empty((0, 4), dtype=np.int64)]
        other = lambda part: labels[0][part, None] != labels[1]
        for i, j, score in pairs_over(matrix(left["v"], width), np.asarray(left["t"]), matrix(right["v"], width), other):
            for k in range(int(counts.max(initial=0))):
                has = counts[i] > k
                w = np.where(has, first[i] + k, 0)
                inside = np.flatnonzero(has & (low[w] <= score) & (score <= high[w]))
                if len(inside):
                    top = inside[first_of_each(w[inside], (-score[inside], ids[1][j[inside]], rows[1][j[inside]]), n)]
                    found.append(np.stack([i[top], w[top], j[top], score[top]], axis=1))
        i, w, j, score = np.concatenate(found).T
        return pa.table([ids[0][i], rows[0][i], number[w], ids[1][j], rows[1][j], score], schema=_NEGATIVES)

    by, full = ["id", "row", "window"], []
    anchors = blocks.rows.where("anchor").select("id", "row", "label", "v")
    for number, level in enumerate(NEGATIVE_LEVELS):
        if windows.isEmpty():
            break
        begin = F.col("low") if level is None else F.greatest("low", F.ceil(F.lit(level) * F.col("positive_score")))
        listed = F.collect_list(F.struct("window", begin.alias("from"), "high"))
        queries = windows.groupBy("id", "row").agg(listed.alias("windows"))
        queries = queries.withColumn("t", F.array_min(F.col("windows")["from"]).cast("double"))
        queries = written(queries.join(anchors, ["id", "row"]), f"windows-{number}")
        schema = "id long, row long, window int, negative long, negative_row long, score long"
        met = blocks.meet(queries.select("id", "row", "label", "v", "t", "windows"), run, schema)
        best = written(_best(met, by, n, "negative", "negative_row"), f"negatives-{number}")
        if level is None:
            full.append(best)
        else:
            filled = best.where(F.col("place") == n).select(*by)
            full.append(best.join(filled, by, "left_semi"))
            windows = written(windows.join(filled, by, "left_anti"), "windows-wanted")
    return _union(full)


def _union(frames: list[DataFrame]) -> DataFrame | None:
    found = None
    for frame in frames:
        found = frame if found is None else found.union(frame)
    return found


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    id: str = "vec_id",
    label: str = "label",
    vector: str = "vector",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` holds vectors of whole numbers; the score of two rows is their
    inner product, which must fit 64 bits (the job fails if it might not). An
    anchor's positives are the first rows of its label, its negatives those of
    another label whose score lies between ``low`` and ``high`` hundredths of the
    positive's. Higher scores come first, ties by id.

    Rows with a null id, label or vector take no part; a null anchor flag is
    false. Rows that repeat another in all three count once; rows that share only
    the id are rows of their own. Shorter vectors are filled up with zeros. A
    positive whose window holds nothing has no row; an empty table gives an
    empty table. Other columns are not read.

    The rows travel once for each block of anchors and round, the anchors once
    for each block of rows; no task holds more than one block of each.
    """
    blocks = _Blocks(vectors, anchor, id, label, vector)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    nothing = vectors.sparkSession.createDataFrame([], schema)
    best = _positives(blocks, positives)
    if best is None:
        return nothing
    score = F.col("score")
    windows = best.select(
        "id",
        "row",
        F.col("place").alias("window"),
        "positive",
        score.alias("positive_score"),
        # Whole numbers: rounded up and down without a detour over doubles.
        (-F.floor(-score * low / F.lit(100).cast("decimal(3)"))).cast("long").alias("low"),
        F.floor(score * high / F.lit(100).cast("decimal(3)")).cast("long").alias("high"),
    )
    windows = written(windows.where("low <= high"), "windows")
    found = _negatives(blocks, windows, negatives)
    if found is None:
        return nothing
    return found.join(windows, ["id", "row", "window"]).select(
        F.col("id").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        F.col("place").alias("rank"),
        F.col("negative").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
