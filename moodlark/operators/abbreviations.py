"""Abbreviations learned from a corpus, without labels or lists.

A word that nearly always has a period after it, is short and has periods
inside is an abbreviation: the log-likelihood of word and period occurring
together (against their independence), weighted by length, inner periods and
occurrences without a period (Kiss and Strunk, 2006).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodlark.functions.text import chunks_of, ended_words
from moodlark.workspace import written

# What is cut off at the ends of a chunk before its word is counted.
OPENERS, CLOSERS = r"""[\[({<"'«“‘`]+""", r"""[\])}>"'»”’,;:!?]+"""
# The probability of a period after an abbreviation, the score that tells one.
AFTER_ABBREVIATION, THRESHOLD = 0.99, 0.3


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """``word, with_period, without_period``: each word of all texts, lower case, with and without a final period.

    Equal chunks are counted before their words are cut out of them, in each
    task and after a shuffle. Null texts have no words.
    """
    chunk = texts.select(F.explode_outer(chunks_of(F.col(text))).alias("chunk")).where("chunk <> ''")
    chunk = chunk.groupBy("chunk").agg(F.count("*").alias("n"))
    core = F.regexp_replace(F.regexp_replace("chunk", rf"\A{OPENERS}", ""), rf"{CLOSERS}\z", "")
    ends = F.col("core").rlike(r"[^.]\.\z")
    # With the count in it, the optimizer leaves the test for empty words above the count.
    words = chunk.select(F.when(F.col("n") > 0, core).alias("core"), "n").where("core <> ''")
    word = F.when(ends, F.expr("left(core, length(core) - 1)")).otherwise(F.col("core"))
    counted = words.select(word.alias("word"), F.when(ends, F.col("n")).otherwise(0).alias("ended"), "n")
    return counted.groupBy("word").agg(F.sum("ended").alias("with_period"), F.sum(F.col("n") - F.col("ended")).alias("without_period"))


def _log_likelihood(share: Column) -> Column:
    """Minus twice the log-ratio of a period as likely as after any word to one that nearly always follows."""
    with_period, without = F.col("with_period"), F.col("without_period")

    def logarithm(probability: Column) -> Column:
        rest = F.when(without > 0, without * F.log(1 - probability)).otherwise(0.0)
        return with_period * F.log(probability) + rest

    return -2 * (logarithm(share) - logarithm(F.lit(AFTER_ABBREVIATION)))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """``word, with_period, without_period, log_likelihood, score`` of the words that a period ever follows.

    ``counts`` should be stored, since it is read twice. Only words with a letter are scored.
    """
    tokens = F.sum(F.col("with_period") + F.col("without_period"))
    totals = counts.agg((F.sum("with_period") / tokens).alias("share"))
    share = totals.select("share").scalar()
    scored = counts.where((F.col("with_period") > 0) & F.col("word").rlike(r"\p{L}"))
    scored = scored.withColumn("log_likelihood", _log_likelihood(share))
    plain = F.length(F.replace("word", F.lit("."), F.lit("")))
    inner = F.length("word") - plain
    weight = F.exp(-plain) * (inner + 1) * F.pow(plain.cast("double"), -F.col("without_period"))
    return scored.withColumn("score", F.col("log_likelihood") * weight)


def learned_abbreviations(texts: DataFrame, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``word``: what scores at least ``threshold`` in the corpus, stored."""
    scores = abbreviation_scores(written(word_counts(texts, text), "period-counts"))
    return written(scores.where(F.col("score") >= threshold).select("word"), "abbreviations")


def with_abbreviations(texts: DataFrame, text: str, id: str, words: DataFrame) -> DataFrame:
    """``texts`` with ``abbreviations``, those of the distinct ``words`` that a period follows in each text.

    Texts are joined to their few abbreviations by ``id``, and only those that
    have any are. Rows that share an id, or have none, share what is found.
    """
    ended = texts.select(F.col(id).alias("_id"), F.explode_outer(ended_words(F.col(text))).alias("word"))
    found = ended.join(words, "word").groupBy("_id").agg(F.collect_set("word").alias("abbreviations"))
    stored = written(found, "abbreviated")
    joined = texts.drop("abbreviations").join(stored, texts[id].eqNullSafe(stored["_id"]), "left").drop("_id")
    return joined.withColumn("abbreviations", F.coalesce("abbreviations", F.array().cast("array<string>")))
