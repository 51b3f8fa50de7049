"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of copies it should have. Among all
rates that give each source its target of words, those nearest to one copy
each (in relative entropy) are ``exp(lambda * size)`` with one multiplier for
each source, here held at ``most`` copies. The multipliers solve a convex dual
problem, one constraint per source; Newton steps solve it, whose sums Spark
forms over (source, size) counts that are aggregated once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moodlark.workspace import written

MOST_COPIES = 3
# Newton steps fall back on halving an interval, so this many are never needed.
_STEPS = 60
# Sizes are measured in mean sizes of their source, so that multipliers compare.
_LARGEST_EXPONENT = 700.0


def water_filled(sources: DataFrame, weights: list[int], most: int) -> DataFrame:
    """``sources`` (source, rank, source_size) with ``target``.

    All words are shared by weight; a source that would get more than ``most``
    times its size is held there and the rest shared again, until none is above.
    One row per source is all that is ever held, and each pass is an aggregate.
    """
    n = F.lit(len(weights)).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank"), n) + 1).cast("int"))
    most_words = F.col("source_size") * F.lit(float(most))
    table = sources.withColumns({"weight": weight, "held": F.lit(False)})
    while True:
        sums = table.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(F.col("held"), most_words)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~F.col("held"), F.col("weight"))), F.lit(0.0)).alias("weights"),
            F.coalesce(F.sum(F.col("held").cast("int")), F.lit(0)).alias("n_held"),
        ).first()
        level = max((sums["all"] or 0) - sums["held"], 0.0) / sums["weights"] if sums["weights"] else 0.0
        share = F.col("weight") * F.lit(level)
        now = written(table.withColumn("held", F.col("held") | (share > most_words)), "mix-sources")
        if now.where("held").count() == sums["n_held"]:
            return now.withColumn("target", F.when(F.col("held"), most_words).otherwise(share)).drop("held", "weight")
        table = now


def _rate(multiplier: Column, size: Column, mean: Column, most: int) -> Column:
    exponent = F.least(multiplier * size / mean, F.lit(_LARGEST_EXPONENT))
    return F.least(F.exp(exponent), F.lit(float(most)))


def balanced(sizes: DataFrame, targets: DataFrame, most: int, tolerance: float) -> DataFrame:
    """``targets`` with ``multiplier`` and ``mean``: the solution of the dual problem.

    ``sizes`` holds (rank, size, n): how many documents of each size a source
    has. Each step sums words and their derivative by source and makes a
    Newton step, kept inside an interval that always holds the solution. It
    ends when every source is within ``tolerance`` of its target.
    """
    mean = targets.join(
        sizes.groupBy("rank").agg(F.sum("n").alias("docs")), "rank"
    ).withColumn("mean", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9)))
    # Outside this interval all documents have no copy, or the most copies.
    far = F.col("mean") * F.lit(_LARGEST_EXPONENT)
    state = written(
        mean.withColumns({"multiplier": F.lit(0.0), "low": -far, "high": far, "error": F.lit(None).cast("double")}),
        "mix-state",
    )
    for _ in range(_STEPS):
        at = sizes.join(state, "rank")
        rate = _rate(F.col("multiplier"), F.col("size"), F.col("mean"), most)
        slope = F.when(rate < most, rate * F.col("size") * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = at.groupBy("rank").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.col("n") * slope).alias("slope")
        )
        over = F.col("got") - F.col("target")
        low = F.when(over < 0, F.greatest("low", "multiplier")).otherwise(F.col("low"))
        high = F.when(over > 0, F.least("high", "multiplier")).otherwise(F.col("high"))
        moved = state.drop("error").join(sums, "rank").withColumns({"low": low, "high": high})
        newton = F.col("multiplier") - F.try_divide(over, F.col("slope"))
        inside = F.coalesce((newton > F.col("low")) & (newton < F.col("high")), F.lit(False))
        error = F.abs(over) / F.greatest("target", F.lit(1.0))
        halved = (F.col("low") + F.col("high")) / 2
        step = F.when(error <= tolerance, F.col("multiplier")).when(inside, newton).otherwise(halved)
        next_ = moved.withColumns({"multiplier": step, "error": error}).drop("got", "slope")
        state = written(next_, "mix-state")
        if not state.where(F.col("error") > tolerance).where(F.col("low") < F.col("high")).count():
            break
    return state.select(*targets.columns, "multiplier", "mean")


# Rounding thresholds are sought among this many steps of a source's documents at a time.
_BINS = 4096


def _thresholds(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """By source, the score up to which documents are rounded up.

    Rounding the documents with the lowest scores up brings the words of a
    source nearest to its target. Scores are whole numbers; three passes
    narrow the threshold down, each by sums over bins, to a single score.
    """
    width, missing = _BINS**3, F.col("target") - F.col("floored")
    base = docs.groupBy("rank").agg(F.sum(F.col("size") * F.col("low_copies")).alias("floored"))
    state = targets.select("rank", "target").join(base, "rank").select(
        "rank", missing.alias("missing"), F.lit(0).cast("long").alias("start")
    )
    for _ in range(3):
        width //= _BINS
        state = written(state, "mix-threshold")
        at = docs.where("rounds").join(state, "rank")
        inside = (F.col("score") >= F.col("start")) & (F.col("score") < F.col("start") + width * _BINS)
        bins = (
            at.where(inside)
            .groupBy("rank", F.floor((F.col("score") - F.col("start")) / width).alias("bin"))
            .agg(F.sum("size").alias("words"))
        )
        below = F.sum("words").over(Window.partitionBy("rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        # The last bin of which the missing words reach at least the start.
        chosen = (
            bins.withColumn("below", F.coalesce(below, F.lit(0)))
            .join(state, "rank")
            .where(F.col("below") <= F.col("missing"))
            .groupBy("rank")
            .agg(F.max_by(F.struct("bin", "below", "words"), "bin").alias("at"))
        )
        state = (
            state.join(chosen, "rank", "left")
            .withColumn("at", F.coalesce("at", F.struct(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("words"))))
            .select(
                "rank",
                (F.col("missing") - F.col("at.below")).alias("missing"),
                (F.col("start") + F.col("at.bin") * width).alias("start"),
                F.col("at.words").alias("words"),
            )
            .select("rank", "missing", "start", *([] if width > 1 else ["words"]))
        )
    # The score found is itself rounded up if that comes nearer to the target.
    up = F.col("missing") * 2 >= F.col("words")
    return written(state.select("rank", F.when(up, F.col("start") + 1).otherwise(F.col("start")).alias("threshold")), "mix-threshold")


def _flips(rounded: DataFrame) -> DataFrame:
    """By source, the one row whose rounding is turned to come nearest to the target, if any does."""
    taken = F.sum(F.col("size") * (F.col("low_copies") + F.col("up").cast("long")))
    gaps = written(
        rounded.groupBy("rank").agg((F.first("target") - taken).alias("gap")), "mix-gaps"
    )
    left = F.abs(F.abs("gap") - F.col("size"))
    nearer = F.col("rounds") & (F.col("up") == (F.col("gap") < 0)) & (left < F.abs("gap"))
    return (
        rounded.join(gaps, "rank")
        .where(nearer)
        .groupBy("rank")
        .agg(F.min_by("_row", F.struct(left, F.xxhash64("_id"), F.col("_id"), F.col("_row"))).alias("flip"))
    )


def mix(
    docs: DataFrame,
    size: Column,
    weights: list[int],
    id: str = "doc_id",
    source: str = "source",
    most: int = MOST_COPIES,
    tolerance: float = 1e-6,
    copied: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``source, size, source_size, target, rate, copies``.

    Sources stand in code-point order, null (a source of its own) last, and
    take ``weights`` in turn. ``rate`` is the exponentially tilted rate, never
    above ``most``; ``copies`` is it rounded down or up. Which documents are
    rounded up is decided by how far the fraction exceeds a hash of the id, at
    a threshold for each source that brings its words to within half a
    document of the target; then one document, if it helps, is rounded the other
    way to fill what is left. Runs agree. Rows that repeat an id are rounded
    alike (up to their text). Sizes of zero, or null, take no part in the sums.

    If ``copied``, the rows of ``docs`` themselves are returned instead, each as
    often as it has copies.

    ``docs`` is read once into a narrow table. What is joined to it has one
    row per source.
    """
    narrow = docs.select(
        F.struct("*").alias("whole"),
        F.col(id).alias("_id"),
        F.col(source).alias("_source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("_row"),
    )
    whole = written(narrow if copied else narrow.drop("whole"), "mix-documents")
    narrow = whole.drop("whole")
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    sources = narrow.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))
    sources = written(sources.withColumn("rank", F.row_number().over(ranked) - 1), "mix-sources")
    targets = written(water_filled(sources, weights, most), "mix-targets")
    by_rank = targets.select(F.col("source").alias("_name"), "rank")
    sized = written(
        narrow.groupBy("_source", "size")
        .agg(F.count("*").alias("n"))
        .join(by_rank, F.col("_source").eqNullSafe(F.col("_name")))
        .where("size > 0")
        .select("rank", "size", "n"),
        "mix-sizes",
    )
    solved = written(balanced(sized, targets, most, tolerance), "mix-solved")
    at_most = F.col("target") >= F.col("source_size") * most
    rate = F.when(at_most, F.lit(float(most))).otherwise(
        F.coalesce(_rate(F.col("multiplier"), F.col("size"), F.col("mean"), most), F.lit(1.0))
    )
    # Sums of doubles depend on the order of tasks in their last places; rates do not.
    rate = F.round(rate, 9)
    # Stored, so that its size is known before documents would be dealt out by source.
    solution = targets.join(solved.select("rank", "multiplier", "mean"), "rank", "left").withColumnRenamed("source", "_name")
    joined = narrow.join(written(solution, "mix-solution"), F.col("_source").eqNullSafe(F.col("_name")))
    low = F.floor("rate")
    chance = F.pmod(F.xxhash64("_id"), F.lit(1 << 32)) / float(1 << 32)
    # From 0 (rounded up first) to 1; the hash breaks ties among equal scores.
    score = F.least(F.floor((1 - (F.col("rate") - low) + chance) / 2 * float(_BINS**3)), F.lit(_BINS**3 - 1))
    rounds = (F.col("rate") > low) & (F.col("size") > 0)
    rated = written(
        joined.withColumn("rate", rate).withColumns({"low_copies": low, "rounds": rounds, "score": score}).drop("_name", "multiplier", "mean"),
        "mix-rates",
    )
    thresholds = _thresholds(rated, targets)
    up = F.coalesce(F.col("rounds") & (F.col("score") < F.col("threshold")), F.lit(False))
    rounded = rated.join(thresholds, "rank", "left").withColumn("up", up).drop("threshold")
    turned = F.coalesce(F.col("_row") == F.col("flip"), F.lit(False))
    finished = rounded.join(written(_flips(rounded), "mix-flips"), "rank", "left").withColumn("up", F.col("up") != turned)
    copies = (F.col("low_copies") + F.col("up").cast("long")).cast("int")
    if copied:
        times = finished.select("_row", copies.alias("copies")).where("copies > 0")
        repeated = whole.select("whole", "_row").join(times, "_row")
        return repeated.select("whole", F.explode(F.sequence(F.lit(1), "copies"))).select("whole.*")
    return finished.select(
        F.col("_id").alias(id), F.col("_source").alias(source), "size", "source_size", "target", "rate", copies.alias("copies")
    )
