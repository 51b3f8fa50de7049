"""Sharding by histogram sort: shards of nearly equal bytes, cut at exact key boundaries.

Each row gets a key of fixed width. For each boundary between shards the driver
holds the key range that it falls into, no more. All tasks count the exact bytes
and rows below the parts of these ranges; running sums, which executors make,
tell the part that each boundary falls into, until that is light enough. The
rows then know their piece from the splitters and are moved once.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moodlark.workspace import written

# A key is three 64-bit numbers in hexadecimal: the hash of the group, the hash
# of the row's order columns, and a number of the row itself. Boundaries are
# refined three digits at a time; two steps more take a group of equal texts to
# its single rows.
_LENGTHS = (3, 6, 9, 19, 22, 25, 28, 35, 38, 41, 44, 48)
# Greater than any digit: a prefix with it lies behind all keys of that prefix.
_AFTER = "g"


@dataclass(frozen=True)
class _Splitter:
    """Keys below ``key`` belong to the pieces before; they are ``rows`` rows of ``size`` bytes."""

    key: str
    rows: int
    size: int


def _hex(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def _probes(keys: DataFrame, open_: dict[str, tuple[int, int]] | None, length: int, targets: list[tuple[int, int, str]]) -> DataFrame:
    """For each target the part of its range that it falls into: ``target, prefix, size, n, size_before, rows_before``.

    ``open_`` has, by prefix, the bytes and rows before the range; ``targets``
    are (number, bytes, prefix of the range).
    """
    spark = keys.sparkSession
    before = 0 if open_ is None else len(next(iter(open_)))
    rows = keys if open_ is None else keys.where(F.substring("key", 1, before).isin(list(open_)))
    parts = rows.groupBy(F.substring("key", 1, length).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    parts = parts.withColumn("range", F.substring("prefix", 1, before))
    # A range has 4,096 parts, or that many for each of the few groups that share nine digits of a hash.
    earlier = Window.partitionBy("range").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumns(
        {"size_before": F.coalesce(F.sum("size").over(earlier), F.lit(0)), "rows_before": F.coalesce(F.sum("n").over(earlier), F.lit(0))}
    )
    wanted = [(i, at - (open_ or {}).get(prefix, (0, 0))[0], prefix) for i, at, prefix in targets]
    wanted = spark.createDataFrame(wanted, "target long, at long, range string")
    inside = (F.col("size_before") <= F.col("at")) & (F.col("at") < F.col("size_before") + F.col("size"))
    return summed.join(wanted, "range").where(inside).select("target", "prefix", "size", "n", "size_before", "rows_before")


def _splitters(keys: DataFrame, total: int, pieces: int, slack: float) -> list[_Splitter]:
    """The boundaries between ``pieces`` pieces of nearly equal bytes, each off by ``slack`` bytes or by one larger row.

    The driver holds one range for each boundary, whatever the rows are.
    """
    found: dict[int, _Splitter] = {}
    at = {i: total * i // pieces for i in range(1, pieces)}
    state: dict[int, tuple[str, int, int]] = {i: ("", 0, 0) for i in at}
    for step, length in enumerate(_LENGTHS):
        if not state or not total:
            break
        open_ = None if step == 0 else {prefix: (size, rows) for prefix, size, rows in state.values()}
        targets = [(i, at[i], prefix) for i, (prefix, _, _) in state.items()]
        after: dict[int, tuple[str, int, int]] = {}
        for r in _probes(keys, open_, length, targets).collect():
            i = r["target"]
            _, size, rows = state[i]
            size, rows = size + r["size_before"], rows + r["rows_before"]
            if r["size"] > slack and r["n"] > 1 and length < _LENGTHS[-1]:
                after[i] = (r["prefix"], size, rows)
            elif 2 * (at[i] - size) <= r["size"]:
                found[i] = _Splitter(r["prefix"], rows, size)
            else:
                found[i] = _Splitter(r["prefix"] + _AFTER, rows + r["n"], size + r["size"])
        state = after
    return [found[i] for i in sorted(found)]


def shard_by_bytes(
    rows: DataFrame,
    n_shards: int,
    size: Column,
    group: Column,
    order: Column,
    tolerance: float = 0.001,
) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 in each).

    Bytes (``size``, never null or negative) are shared out evenly: a boundary
    is off by ``tolerance`` of a shard, or by one row that is larger. Rows with
    the same ``group`` (a 64-bit number, such as the hash of a text) are
    neighbours and share a shard unless a boundary falls among them; among
    them, ``order`` (another 64-bit number) decides, and rows equal in both go
    by a number of their own, so a group of any size can be cut anywhere.

    Null columns are the caller's to fill; an empty table gives an empty table;
    with fewer rows than shards some shards are empty. All columns are kept;
    columns named ``shard`` or ``slot`` are replaced.
    """
    spark = rows.sparkSession
    key = F.concat(_hex(group), _hex(order), _hex(F.monotonically_increasing_id()))
    kept = F.struct(*[c for c in rows.columns if c.lower() not in ("shard", "slot")])
    keys = written(rows.select(kept.alias("whole"), size.cast("long").alias("size"), key.alias("key")), "shard-keys")
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // n_shards)
    total = keys.agg(F.sum("size")).first()[0] or 0
    splitters = _splitters(keys, total, n_shards * width, tolerance * total / n_shards)
    # Rows of all sizes zero have no boundaries: they are one piece.
    starts = [0, *[s.rows for s in splitters]] + [0] * (n_shards * width - 1 - len(splitters))
    first = [starts[p] - starts[p // width * width] for p in range(n_shards * width)]
    # By the first digits of a key: the pieces that begin before them, and the splitters among them.
    # One row for each of 4,096 beginnings at most, and one key for each splitter.
    digits = _LENGTHS[0]
    among: dict[str, list[str]] = {}
    for s in splitters:
        among.setdefault(s.key[:digits], []).append(s.key)
    places, below = [], 0
    for beginning in (f"{i:0{digits}x}" for i in range(16**digits)):
        places.append((beginning, below, among.get(beginning, [])))
        below += len(among.get(beginning, []))
    table = spark.createDataFrame(places, "beginning string, below int, among array<string>")
    found = keys.join(F.broadcast(table), F.substring("key", 1, digits) == F.col("beginning"))
    piece = F.col("below") + F.size(F.filter("among", lambda s: s <= F.col("key")))
    dealt = found.select("whole", "key", piece.alias("piece"))
    moved = dealt.repartitionById(n_shards * width, F.col("piece"))
    order_in_piece = Window.partitionBy("piece").orderBy("key")
    at = F.get(F.array(*[F.lit(f).cast("long") for f in first]), F.col("piece"))
    slot = (at + F.row_number().over(order_in_piece) - 1).cast("long")
    shard = F.floor(F.col("piece") / width).cast("int")
    return moved.select("whole.*", shard.alias("shard"), slot.alias("slot"))
