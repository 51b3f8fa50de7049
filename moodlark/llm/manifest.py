"""Merkle manifest of a dataset, by nested-interval labels.

Every node is labelled with the interval [lo, hi) of the leaf ranks it covers.
Up to ``FAN`` consecutive nodes of a level lie in one bucket of the next, so
parents are made by grouping on (group, bucket), which never gathers more than
``FAN`` rows, however large a group is. On the way down, a run finds its parent
in the bucket of that level, by containment of intervals; within a parent, what
is left of its interval without a child's own are the child's siblings.

There is one tree per source and one over the roots of the sources.
"""

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodlark.workspace import written

FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# The digests left and right of a node, within its run.
_STEP = "struct<l:string,r:string>"


def digest(columns: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of all columns: each ``-`` if null, else its byte count, ``:`` and itself."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``lo``, their place in their group from 0, and ``total``, the group's rows.

    Rows are range-partitioned, so a group of any size spreads over many tasks;
    only counts by group and task are added up.
    """
    by = [group, *order]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = written(sorted_rows.withColumn("place", F.monotonically_increasing_id()), "manifest-places")
    part = F.shiftright("place", 33)
    parts = placed.groupBy(group, part.alias("part")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    of_group = Window.partitionBy(group)
    before = F.sum("n").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    offsets = written(
        parts.select(group, "part", (before - F.col("first")).alias("shift"), F.sum("n").over(of_group).alias("total")),
        "manifest-offsets",
    )
    joined = placed.withColumn("part", part).join(offsets, [group, "part"])
    return joined.withColumn("lo", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def _bucket(level: int, fan: int) -> Column:
    """Where the interval lies among those of ``level``."""
    return F.floor(F.col("lo") / fan**level)


@dataclass
class Tree:
    """``leaves``: group, lo, digest, carried, total; ``runs[h]``: the runs of level h, each under its parent."""

    leaves: DataFrame
    fan: int
    runs: list[DataFrame] = field(default_factory=list)

    def nodes(self, level: int) -> DataFrame:
        """``group, level, lo, hi, digest, total`` of the nodes of a level."""
        of = self.leaves.withColumn("hi", F.col("lo") + 1) if level == 0 else self.runs[level - 1]
        return of.select("group", F.lit(level).alias("level"), "lo", "hi", "digest", "total")

    def roots(self) -> DataFrame:
        """``group, digest`` of the nodes that cover their whole group."""
        tops = [self.nodes(level).where("hi - lo = total").select("group", "digest") for level in range(len(self.runs) + 1)]
        found = tops[0]
        for top in tops[1:]:
            found = found.union(top)
        return found

    def downward(self, outer: DataFrame) -> DataFrame:
        """``carried, digest, path`` and the rest of ``outer`` for every leaf.

        ``outer`` (group, path, ...) says what lies above each group's root.
        ``path`` holds the siblings to the left and right, from the leaf up.
        """
        above = None
        for level in reversed(range(len(self.runs))):
            at = self.runs[level]
            tops = at.where("hi - lo = total").join(outer, "group")
            if above is not None:
                bucket = _bucket(level + 1, self.fan)
                label = [F.col("group").alias("g"), bucket.alias("b"), F.col("lo").alias("from"), F.col("hi").alias("to")]
                held = (F.col("group") == F.col("g")) & (bucket == F.col("b")) & (F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to"))
                inner = at.where("hi - lo < total").join(above.select(*label, "path", *_rest(outer)), held)
                tops = tops.unionByName(inner.drop("g", "b", "from", "to"))
            child = tops.select("group", "children", "path", *_rest(outer), F.explode("children").alias("c"))
            path = F.concat(F.array(_step(F.col("children"), F.col("c"))), F.col("path"))
            child = child.select("group", "c.*", path.alias("path"), *_rest(outer))
            above = child if level == 0 else written(child, "manifest-paths")
        alone = self.leaves.where("total = 1").join(outer, "group").select("carried", "digest", "path", *_rest(outer))
        return alone if above is None else above.select("carried", "digest", "path", *_rest(outer)).unionByName(alone)


def _rest(outer: DataFrame) -> list[str]:
    return [c for c in outer.columns if c not in ("group", "path")]


def _step(children: Column, own: Column) -> Column:
    """The siblings: the children in the run's interval to the left and right of one's own."""
    left = F.filter(children, lambda c: c["hi"] <= own["lo"])
    right = F.filter(children, lambda c: c["lo"] >= own["hi"])
    return F.struct(F.concat_ws("", left["digest"]).alias("l"), F.concat_ws("", right["digest"]).alias("r"))


def grown(leaves: DataFrame, fan: int = FAN) -> Tree:
    """The trees over ``leaves`` (group, lo, digest, carried, total), one for each group."""
    tree = Tree(leaves, fan)
    most = leaves.agg(F.max("total")).first()[0] or 0
    while fan ** len(tree.runs) < most:
        level = len(tree.runs)
        here = tree.nodes(level).withColumn("carried", F.lit(None).cast(leaves.schema["carried"].dataType))
        if level == 0:
            here = leaves.withColumn("hi", F.col("lo") + 1)
        # Groups with one node at this level have their root already.
        several = here.where(F.col("total") > fan**level).withColumn("bucket", _bucket(level + 1, fan))
        children = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest", "carried")))
        runs = several.groupBy("group", "total", "bucket").agg(children.alias("children"))
        runs = runs.select(
            "group",
            "total",
            "children",
            F.col("children")[0]["lo"].alias("lo"),
            F.element_at("children", -1)["hi"].alias("hi"),
            F.sha2(F.concat_ws("", F.col("children")["digest"]), 256).alias("digest"),
        )
        tree.runs.append(written(runs, "manifest-runs"))
    return tree


@dataclass
class Manifest:
    """The tree of each source, the tree over their roots and its root (None for an empty table)."""

    sources: Tree
    top: Tree
    root: str | None

    def nodes(self) -> DataFrame:
        """All nodes: ``source`` (null for the null source), ``tree`` (source or top), ``level, lo, hi, digest``."""
        found = None
        for name, tree in (("source", self.sources), ("top", self.top)):
            for level in range(len(tree.runs) + 1):
                group = F.when(F.col("group") != "", F.substring("group", 2, 2**31 - 1))
                at = tree.nodes(level).select(group.alias("source"), F.lit(name).alias("tree"), "level", "lo", "hi", "digest")
                found = at if found is None else found.union(at)
        return found

    def proofs(self) -> DataFrame:
        """``id, leaf, subroot, root, path, other`` of every leaf; ``path`` holds its siblings from the leaf up."""
        start = self.top.leaves.sparkSession.createDataFrame([("", [])], f"group string, path array<{_STEP}>")
        above = self.top.downward(start).select(
            F.col("carried.other").alias("group"), F.col("path"), F.col("digest").alias("subroot")
        )
        found = self.sources.downward(written(above, "manifest-tops"))
        return found.select(
            F.col("carried.id").alias("id"),
            F.col("digest").alias("leaf"),
            "subroot",
            F.lit(self.root).cast("string").alias("root"),
            "path",
            F.col("carried.other").alias("other"),
        )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda made, step: F.sha2(F.concat(step["l"], made, step["r"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["l"], step["r"])), ""), 256)


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    id: str = "doc_id",
    source: str = "source",
    other: Column | None = None,
    fan: int = FAN,
) -> Manifest:
    """The manifest of ``docs``: a leaf for each row, over ``columns``.

    Leaves of a source stand by ``id`` (null first; rows with one id by digest, so
    repeated rows count one by one and in any order give the same). Sources
    stand by their UTF-8 bytes, null first. ``other`` is a column that travels
    with each leaf, for instance the digest of another version of the row.
    Empty texts differ from null ones. An empty table has no root and no proof.
    Columns that are not named are not read.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    other = F.lit(None).cast("string") if other is None else other.cast("string")
    read = docs.select(key.alias("group"), F.col(id).alias("id"), digest([F.col(c) for c in columns]).alias("digest"), other.alias("other"))
    leaves = ranked(written(read, "manifest-leaves"), "group", ["id", "digest"])
    leaves = leaves.select("group", "lo", "total", "digest", F.struct("id", "other").alias("carried"))
    sources = grown(written(leaves, "manifest-ranked"), fan)
    tops = sources.roots().select(F.lit("").alias("group"), F.col("group").alias("other"), "digest")
    tops = ranked(written(tops, "manifest-roots"), "group", ["other"])
    tops = tops.select("group", "lo", "total", "digest", F.struct(F.lit(None).cast("long").alias("id"), "other").alias("carried"))
    top = grown(written(tops, "manifest-ranked-roots"), fan)
    root = top.roots().first()
    return Manifest(sources, top, root["digest"] if root else None)
