"""Quality rules as weak supervision.

Each rule votes good or bad, or abstains. How far a vote can be trusted is
estimated without labels, by expectation-maximisation over the counts of vote
patterns (at most 3 ** rules, whatever the number of documents); the posterior
probability of good quality replaces the demand that every rule pass.
"""

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodlark.workspace import written

SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
# Frequent function words of the four languages.
FUNCTION_WORDS = (
    "the of and to in is that it for was with are on as by "
    "le la les de des et que un une pour dans est en du qui "
    "der die das und den von zu mit ist nicht ein sich für auf im "
    "el los las y por con para una se del al no lo su como"
).split()
MIN_WORDS = 50


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``STATISTICS``; a null text has no words.

    Repeated three-word windows are found within each row, by sorting the
    64-bit hashes of its windows, so nothing is exploded or shuffled. (Two
    different windows of one text share a hash with a chance below 1e-10.)
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = F.translate(whole, _BLANKS, "")
    has_word = lambda line: F.length(F.translate(line, _BLANKS, "")) > 0
    first = docs.withColumns(
        {
            "_words": F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != ""),
            "_lines": F.filter(F.split(whole, "\n"), has_word),
            "word_chars": F.length(plain).cast("long"),
            "n_symbols": (F.length(plain) - F.length(F.translate(plain, SYMBOLS, ""))).cast("long"),
            "n_capitals": F.regexp_count(whole, F.lit(r"\p{Lu}")).cast("long"),
            "n_shouts": (F.length(plain) - F.length(F.translate(plain, "!", ""))).cast("long"),
        }
    )
    n = F.size("_words")
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(window(i).alias("h"), i.alias("i")))
    function_words = F.filter("_words", lambda w: F.lower(w).isin(FUNCTION_WORDS))
    second = first.withColumns(
        {
            "n_words": n.cast("long"),
            "n_function_words": F.size(function_words).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": F.when(n >= 3, F.sort_array(hashes)),
        }
    ).drop("_words", "_lines")
    same = lambda x, i: (x["h"] == F.get("_windows", i + 1)["h"]) | (
        (i > 0) & (x["h"] == F.get("_windows", F.greatest(i - 1, F.lit(0)))["h"])
    )
    third = second.withColumn("_repeats", F.filter("_windows", same)).drop("_windows")
    starts = F.sort_array(F.transform("_repeats", lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
    )["n"]
    return third.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_repeats")


_HELPERS = ["_words", "_lines", "_windows", "_repeats", "_votes"]
STATISTICS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_capitals", "n_shouts", "n_function_words", "n_lines",
]


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    vote = F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)
    return vote.cast("tinyint")


def votes() -> dict[str, Column]:
    """The rules: 1 good, -1 bad, 0 abstains. Documents without words get no vote but that on length."""
    symbols, repeats = _ratio("n_symbols", "n_words"), _ratio("n_repeat_words", "n_words")
    capitals, shouts = _ratio("n_capitals", "word_chars"), _ratio("n_shouts", "n_words")
    length, lines = _ratio("word_chars", "n_words"), _ratio("n_dup_lines", "n_lines")
    function_words, words = _ratio("n_function_words", "n_words"), F.col("n_words")
    return {
        "symbols": _vote(symbols, symbols < 0.03, symbols > 0.1),
        "repeats": _vote(repeats, repeats < 0.2, repeats > 0.35),
        "capitals": _vote(capitals, capitals < 0.2, capitals > 0.4),
        "shouts": _vote(shouts, shouts < 0.03, shouts > 0.15),
        "lines": _vote(lines, lines < 0.2, lines > 0.4),
        "length": _vote(length, length.between(3.0, 9.0), (length < 2.5) | (length > 14)),
        "function_words": _vote(function_words, function_words > 0.12, function_words < 0.04),
        "words": _vote(words, words >= 2 * MIN_WORDS, words < MIN_WORDS),
    }


@dataclass(frozen=True)
class Trust:
    """Share of good documents; by rule, how often its votes on good and on bad ones are right."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def log_odds(self, pattern: tuple[int, ...]) -> float:
        total = log(self.prior / (1 - self.prior))
        for vote, good, bad in zip(pattern, self.good, self.bad, strict=True):
            total += (log(good / (1 - bad)) if vote > 0 else log((1 - good) / bad)) if vote else 0.0
        return total


# No rule is beyond doubt: at least this share of its votes is wrong in either class.
DOUBT = 0.002


def _share(right: float, voted: float, empty: float) -> float:
    return min(1 - DOUBT, max(DOUBT, right / voted if voted else empty))


def estimate(patterns: list[tuple[tuple[int, ...], int]], steps: int = 200, tolerance: float = 1e-7) -> Trust:
    """Expectation-maximisation over (votes, number of documents).

    It starts from the verdict of the former filter (bad if any rule says so)
    and gives up what the votes as a whole do not support: a rule that speaks
    against documents which look good otherwise loses its weight.
    """
    rules = len(patterns[0][0]) if patterns else len(votes())
    weights = [0.0 if min(pattern) < 0 else 1.0 for pattern, _ in patterns]
    trust = None
    for _ in range(steps):
        n = good_docs = 0.0
        right, voted = [[0.0] * rules, [0.0] * rules], [[0.0] * rules, [0.0] * rules]
        for (pattern, count), weight in zip(patterns, weights, strict=True):
            good = count * weight
            n, good_docs = n + count, good_docs + good
            for j, vote in enumerate(pattern):
                if vote:
                    voted[0][j] += good
                    voted[1][j] += count - good
                    right[0][j] += good * (vote > 0)
                    right[1][j] += (count - good) * (vote < 0)
        before, trust = trust, Trust(
            _share(good_docs, n, 0.5),
            tuple(_share(r, v, 1.0) for r, v in zip(right[0], voted[0], strict=True)),
            tuple(_share(r, v, 0.5) for r, v in zip(right[1], voted[1], strict=True)),
        )
        flat = lambda t: (t.prior, *t.good, *t.bad)
        if before and max(abs(a - b) for a, b in zip(flat(before), flat(trust), strict=True)) < tolerance:
            break
        weights = [1 / (1 + exp(min(700.0, -trust.log_odds(pattern)))) for pattern, _ in patterns]
    return trust


def _log_odds(trust: Trust, names: list[str]) -> Column:
    total = F.lit(log(trust.prior / (1 - trust.prior)))
    for name, good, bad in zip(names, trust.good, trust.bad, strict=True):
        vote = F.col("_votes")[name]
        up, down = log(good / (1 - bad)), log((1 - good) / bad)
        total = total + F.when(vote > 0, F.lit(up)).when(vote < 0, F.lit(down)).otherwise(0.0)
    return total


def judge_quality(docs: DataFrame, text: str = "text", threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``STATISTICS``, ``base_failed``, ``probability`` and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of the words in
    repeated windows. ``kept``: not failed, and a posterior probability of at
    least ``threshold``. Null texts are empty and fail. Rows are judged one by
    one: repeated rows alike, null ids as any other. Columns of these names
    are replaced; with ``keep_text=False`` the text is left out. An empty table
    gives an empty table.

    Text is read once; votes are stored with the columns of ``docs``.
    """
    made = {*STATISTICS, "base_failed", "probability", "kept", *_HELPERS}
    plain = docs.drop(*[c for c in docs.columns if c.lower() in made and c != text])
    rules = votes()
    read = with_statistics(plain, text).withColumn("_votes", F.struct(*[v.alias(k) for k, v in rules.items()]))
    voted = written(read if keep_text else read.drop(text), "quality-votes")
    counted = voted.groupBy(*[F.col("_votes")[k].alias(k) for k in rules]).agg(F.count("*").alias("n")).collect()
    trust = estimate(sorted((tuple(row[k] for k in rules), row["n"]) for row in counted))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    posterior = 1 / (1 + F.exp(-_log_odds(trust, list(rules))))
    return (
        voted.withColumns({"base_failed": failed, "probability": posterior})
        .withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))
        .drop("_votes")
    )
