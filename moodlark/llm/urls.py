"""URL filters: rules by host and path, and a path-template tree for what no rule decides.

The tree is learned per host from the urls the rules decide, level by level as
deep as paths go. Segments too rare to be names become wildcards of their shape;
sibling branches whose labels do not differ significantly are merged, so that
what lies below them is one tree; and a template is rejected when its smoothed
share of allowed urls is low.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodlark.workspace import written

ALLOW, BLOCK = "allow", "block"
Rules = list[tuple[str, str]]

# Urls, and share of its parent's urls, from which a segment is a name.
MIN_SUPPORT = 5
MIN_SHARE = 0.02
# Weight of the host's purity in that of a template, and of all urls' in that of a host.
SMOOTHING = 10.0
# Normal quantile beyond which two branches differ.
DIFFERENT = 1.96
REJECT_BELOW = 0.25


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/ ? #`` or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, capitals, capitals.lower())


def path_of(url: Column) -> Column:
    """From the end of the host up to ``? #`` or the end; empty if there is no host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Rules) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null.

    A rule is a host, then the start of a path. It fits the host and all its
    subdomains. Of rules of one length a blocking one wins, then the first in
    code-point order. ``rules`` is a parameter written by hand: a short list.
    """
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    found = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0] != BLOCK, r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found, none)


def _shape(segment: Column) -> Column:
    """Runs of digits as ``#`` and of letters as ``@``."""
    return F.regexp_replace(F.regexp_replace(segment, r"[0-9]+", "#"), r"\p{L}+", "@")


def _joined(segments: Column, n: Column | int) -> Column:
    """The first ``n`` segments."""
    return F.array_join(F.slice(segments, 1, n), "/")


def _common(one: Column, other: Column) -> Column:
    """How many segments two lists begin with alike."""
    both = F.least(F.size(one), F.size(other))
    same = F.transform(F.slice(one, 1, both), lambda x, i: x == F.get(other, i))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, both.cast("long"))


def _differs(good: Column, n: Column, all_good: Column, all_n: Column) -> Column:
    """Whether a branch and the rest of its siblings have different shares of allowed urls, by a test of two proportions.

    There is no difference where one side has no labels or all are alike.
    """
    rest = all_n - n
    pooled = F.try_divide(all_good, all_n)
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), n) + F.try_divide(F.lit(1), rest)))
    z = F.try_divide(F.abs(F.try_divide(good, n) - F.try_divide(all_good - good, rest)), spread)
    return F.coalesce(z > DIFFERENT, F.lit(False))


def templates(paths: DataFrame) -> DataFrame:
    """``paths`` (host, path, n, good, bad; distinct) with ``template`` and ``branch``, the node they end in.

    Level by level, a segment stays as it is when enough urls of its node have
    it; otherwise its shape takes its place. Branches of a node that do not
    differ from their siblings are one branch, ``*``. Where all paths of a node
    go on alike, they do so in one step; where fewer than ``MIN_SUPPORT`` urls
    or a single path are left, the rest of a path is one step. So the number of
    levels is that at which paths still part, and the state shrinks with each.
    """
    state = paths.withColumns(
        {"left": F.split(F.regexp_replace("path", "^/", ""), "/"), "template": F.lit(""), "branch": F.lit("")}
    )
    done = None
    while True:
        # One row per node, so its paths stay apart from one another's counts.
        node = state.groupBy("host", "branch").agg(F.sum("n").alias("total"), F.min("left").alias("low"), F.max("left").alias("high"))
        node = node.withColumn("ends", (F.col("total") < MIN_SUPPORT) | (F.col("low") == F.col("high")))
        step = F.when(F.col("ends"), F.lit(None)).otherwise(F.greatest(_common(F.col("low"), F.col("high")), F.lit(1)))
        node = written(node.select("host", "branch", "total", step.cast("int").alias("step")), "url-nodes")
        here = state.join(node, ["host", "branch"])
        taken = F.least(F.coalesce("step", F.size("left")), F.size("left"))
        here = here.withColumns({"taken": taken, "segment": _joined(F.col("left"), taken)})
        counts = here.groupBy("host", "branch", "segment").agg(
            F.sum("n").alias("all"), F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"), F.first("total").alias("total")
        )
        named = (F.col("all") >= MIN_SUPPORT) & (F.col("all") >= MIN_SHARE * F.col("total"))
        counts = counts.withColumn("part", F.when(named, F.col("segment")).otherwise(_shape(F.col("segment"))))
        counts = written(counts, "url-segments")
        branches = counts.groupBy("host", "branch", "part").agg(F.sum("all_good").alias("g"), F.sum(F.col("all_good") + F.col("all_bad")).alias("m"))
        siblings = branches.groupBy("host", "branch").agg(F.sum("g").alias("node_g"), F.sum("m").alias("node_m"))
        judged = branches.join(siblings, ["host", "branch"])
        merged = ~_differs(F.col("g"), F.col("m"), F.col("node_g"), F.col("node_m"))
        judged = judged.withColumn("merged", merged)
        several = judged.groupBy("host", "branch").agg((F.count_if("merged") > 1).alias("several"))
        known = written(
            judged.join(several, ["host", "branch"])
            .select("host", "branch", "part", F.when(F.col("merged") & F.col("several"), "*").otherwise(F.col("part")).alias("name")),
            "url-branches",
        )
        parts = written(counts.select("host", "branch", "segment", "part").join(known, ["host", "branch", "part"]), "url-parts")
        moved = here.join(parts, ["host", "branch", "segment"])
        rest = F.slice("left", F.col("taken") + 1, F.size("left"))
        moved = moved.select(
            "host", "path", "n", "good", "bad", rest.alias("left"),
            F.concat("template", F.lit("/"), "part").alias("template"),
            F.concat("branch", F.lit("/"), "name").alias("branch"),
        )
        moved = written(moved, "url-templates")
        ended = moved.where(F.size("left") == 0).drop("left")
        done = ended if done is None else done.union(ended)
        state = moved.where(F.size("left") > 0)
        if state.isEmpty():
            return done


def _purity(good: Column, bad: Column, prior: Column, weight: float = SMOOTHING) -> Column:
    return (good + prior * weight) / (good + bad + weight)


def judged_branches(found: DataFrame) -> DataFrame:
    """``host, branch, purity``: the smoothed share of allowed urls of each branch."""
    label = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    branches = written(found.groupBy("host", "branch").agg(*label), "url-leaves")
    hosts = branches.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("bad").alias("host_bad"))
    everywhere = branches.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("g"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")).first()
    overall = F.lit((everywhere["g"] + 1.0) / (everywhere["g"] + everywhere["b"] + 2.0))
    hosts = hosts.select("host", _purity(F.col("host_good"), F.col("host_bad"), overall).alias("host_purity"))
    pure = _purity(F.col("good"), F.col("bad"), F.col("host_purity"))
    return branches.join(hosts, "host").select("host", "branch", pure.alias("purity"))


def judge_urls(pages: DataFrame, rules: Rules, url: str = "url", reject_below: float = REJECT_BELOW) -> DataFrame:
    """``pages`` with ``host, path, rule, template, purity, verdict``.

    A rule's verdict stands; other urls are allowed unless the purity of their
    template is below ``reject_below``. The urls that rules decide are the
    labelled ones. A null url, or one without ``://``, has an empty host and
    path, no rule, and the verdict of the template of empty urls. Repeated
    rows are judged alike; columns of these names are replaced; an empty table
    gives an empty table.

    Each distinct (host, path) is worked on once, with its number of urls, so
    a host or url that very many rows share is added up before it moves.
    """
    made = ["host", "path", "rule", "template", "purity", "verdict"]
    kept = F.struct(*[c for c in pages.columns if c.lower() not in made])
    parsed = pages.select(kept.alias("whole"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = matching_rule(F.col("host"), F.col("path"), rules)
    distinct = parsed.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("ruled", ruled)
    labelled = distinct.select(
        "host", "path", "n",
        F.when(F.col("ruled.verdict") == ALLOW, F.col("n")).otherwise(0).alias("good"),
        F.when(F.col("ruled.verdict") == BLOCK, F.col("n")).otherwise(0).alias("bad"),
    )
    found = templates(written(labelled, "url-paths"))
    purity = written(judged_branches(found), "url-purity")
    by_path = written(
        found.select("host", "path", "branch", "template").join(purity, ["host", "branch"]).select("host", "path", "template", "purity"),
        "url-judged",
    )
    verdict = F.when(F.col("purity") < reject_below, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    found = parsed.join(by_path, ["host", "path"]).withColumn("ruled", ruled)
    return found.select(
        "whole.*",
        "host",
        "path",
        F.col("ruled.rule").alias("rule"),
        "template",
        "purity",
        F.coalesce(F.col("ruled.verdict"), verdict).alias("verdict"),
    )
