"""Lemmas and the most frequent words of each sentiment."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodlark.functions.lexicon import DASHBOARD_STOP_WORDS
from moodlark.functions.text import has_noun_ending, is_alphabetic, lemma_forms, word_tokens
from moodlark.operators.abbreviations import with_abbreviations
from moodlark.operators.relational import charted
from moodlark.workspace import written

# Positions in one text are ints, so they fit below this step.
POSITION_STEP = 2**31


def lemma_map(
    words: DataFrame, vocabulary: DataFrame | None = None, exceptions: DataFrame | None = None
) -> DataFrame:
    """Lemma of each word for which a form is known.

    ``words`` and ``vocabulary`` hold distinct values in column ``word``;
    ``exceptions`` holds irregular nouns as (word, lemma). Of a word's forms
    that the vocabulary has, the shortest wins, the word itself before a stem
    of its length. Without a vocabulary the words themselves are it. Only
    words with a noun ending or an exception take part, and both sides of the
    join are distinct, so no key is hot.
    """
    known = words if vocabulary is None else vocabulary
    regular = words.where(has_noun_ending(F.col("word")))
    if exceptions is not None:
        regular = regular.join(exceptions, "word", "left_anti")
    forms = regular.select("word", F.explode(lemma_forms(F.col("word"))).alias("form"))
    if exceptions is not None:
        irregular = words.join(exceptions, "word").select(
            "word", F.explode(F.array("word", "lemma")).alias("form")
        )
        forms = forms.union(irregular)
    found = forms.join(known.select(F.col("word").alias("form")), "form", "left_semi")
    preference = F.struct(F.length("form"), F.col("form") != F.col("word"), "form")
    return found.groupBy("word").agg(F.min_by("form", preference).alias("lemma"))


def count_words(
    posts: DataFrame,
    position: str = "id",
    stop_words: Sequence[str] = DASHBOARD_STOP_WORDS,
    abbreviations: Sequence[str] | DataFrame = (),
) -> DataFrame:
    """Alphabetic words of the charted posts: count and first appearance per sentiment.

    ``abbreviations`` is a list or a table with distinct values in ``word``.

    First appearance is the position of the post and of the token in it, in
    one exact decimal: unlike a struct, it stays in the hash aggregate, which
    reduces each task's tokens to its distinct words before the shuffle.
    """
    shown, known = charted(posts), abbreviations
    if isinstance(abbreviations, DataFrame):
        shown, known = with_abbreviations(shown, "tweet", position, abbreviations), F.col("abbreviations")
    words = shown.select(
        F.lower("target").alias("sentiment"),
        F.col(position).cast("decimal(20,0)").alias("post"),
        F.posexplode_outer(word_tokens(F.col("tweet"), known)).alias("place", "word"),
    )
    kept = words.where(is_alphabetic(F.col("word")) & ~F.col("word").isin(*stop_words))
    first_seen = F.min(F.col("post") * F.lit(POSITION_STEP) + F.col("place"))
    return kept.groupBy("sentiment", "word").agg(F.count("*").alias("n"), first_seen.alias("first_seen"))


def top_words(
    posts: DataFrame,
    n: int = 10,
    position: str = "id",
    stop_words: Sequence[str] = DASHBOARD_STOP_WORDS,
    abbreviations: Sequence[str] | DataFrame = (),
    vocabulary: DataFrame | None = None,
    exceptions: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` most frequent lemmas of each charted sentiment.

    Equal counts rank by first appearance. Words are counted before they are
    lemmatized, so the lemma join sees distinct words, not tokens; the counts
    are stored once because the join reads them three times.
    """
    counted = written(count_words(posts, position, stop_words, abbreviations), "word-counts")
    lemmas = lemma_map(counted.select("word").distinct(), vocabulary, exceptions)
    by_lemma = (
        counted.join(lemmas, "word", "left")
        .groupBy("sentiment", F.coalesce("lemma", "word").alias("word"))
        .agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))
    )
    order = Window.partitionBy("sentiment").orderBy(F.desc("n"), F.asc("first_seen"))
    ranked = by_lemma.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n).select("sentiment", "rank", "word", "n")
