"""Tokens, bigrams, term counts and TF-IDF weights.

Two forms exist. The model uses the Spark ML stages, which keep one sparse
vector per post and broadcast a vocabulary whose size is a parameter. The
forms here, one array of (term, value) per post or one row per term, serve SQL
analysis and hold every term.
"""

from pyspark.ml.feature import NGram, StopWordsRemover, Tokenizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodlark.functions.lexicon import ML_STOP_WORDS
from moodlark.operators.relational import with_text
from moodlark.workspace import written

TOKENS = "tk"
FILTERED = "filtered_words"
BIGRAMS = "ngrams"


def tokenizer() -> Tokenizer:
    return Tokenizer(inputCol="tweet", outputCol=TOKENS)


def stop_words_remover() -> StopWordsRemover:
    return StopWordsRemover(
        inputCol=TOKENS, outputCol=FILTERED, stopWords=list(ML_STOP_WORDS), caseSensitive=False, locale="en_US"
    )


def bigrams() -> NGram:
    return NGram(inputCol=FILTERED, outputCol=BIGRAMS, n=2)


def with_tokens(posts: DataFrame) -> DataFrame:
    return tokenizer().transform(with_text(posts))


def with_filtered_words(posts: DataFrame) -> DataFrame:
    return stop_words_remover().transform(with_tokens(posts))


def with_bigrams(posts: DataFrame) -> DataFrame:
    return bigrams().transform(with_filtered_words(posts))


def exploded(tokenized: DataFrame, terms: str, *kept: str) -> DataFrame:
    """One row per term of each post.

    A plain explode makes the optimizer add filters on the term list, which
    tokenize each text again, on the wrong side of a join if there is one. The
    outer form does not; its rows for empty lists are dropped here.
    """
    rows = tokenized.select(*kept, F.explode_outer(terms).alias("term"))
    return rows.where(F.col("term").isNotNull())


def term_vectors(tokenized: DataFrame, terms: str) -> DataFrame:
    """``id, vector``: the terms of each post with their counts, as an array of (term, tf).

    A post's terms are in one row, so they are counted there: sort them, find
    where each run of equal terms starts, and take the distance to the next
    start. Nothing is shuffled, however many terms the corpus has.
    """
    runs = tokenized.select("id", F.array_sort(terms).alias("sorted"))
    is_start = lambda place: (place == 0) | (F.get("sorted", place) != F.get("sorted", place - 1))
    starts = F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), is_start)
    runs = runs.withColumn("starts", F.when(F.size("sorted") > 0, starts))
    counted = F.transform(
        "starts",
        lambda start, k: F.struct(
            F.get("sorted", start).alias("term"),
            (F.coalesce(F.get("starts", k + 1), F.size("sorted")) - start).cast("long").alias("tf"),
        ),
    )
    return runs.select("id", counted.alias("vector"))


def opened(vectors: DataFrame) -> DataFrame:
    """One row per entry of each post's vector."""
    entries = vectors.select("id", F.explode_outer("vector").alias("entry"))
    return entries.where(F.col("entry").isNotNull()).select("id", "entry.*")


def term_counts(tokenized: DataFrame, terms: str) -> DataFrame:
    """Occurrences of each term in each post."""
    return opened(term_vectors(tokenized, terms))


def tf_idf_vectors(weighted: DataFrame) -> DataFrame:
    """``id, vector``: the TF-IDF weights of each post as an array of (term, tfidf), in order of term."""
    entries = F.collect_list(F.struct("term", "tfidf"))
    return weighted.groupBy("id").agg(F.array_sort(entries).alias("vector"))


def corpus_counts(tokenized: DataFrame, terms: str) -> DataFrame:
    """Occurrences of each term in the corpus; repeats are added up before the shuffle."""
    return exploded(tokenized, terms).groupBy("term").agg(F.count("*").alias("n"))


def capped_vocabulary(corpus: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent terms; equal counts in alphabetical order.

    The terms are range-partitioned in that order, and each partition's share
    follows from the numbers of terms before it. No task sees more than its
    range, whatever ``size`` is.
    """
    order = [F.desc("n"), F.asc("term")]
    ranges = corpus.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranges.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    stored = written(numbered, "ranged-terms")
    ranges = stored.groupBy("_range").agg(F.count("*").alias("_size"), F.min("_row").alias("_first"))
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select("_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return stored.join(starts, "_range").where(F.col("_row") + F.col("_shift") < size).select("term", "n")


# The most frequent terms, how long they may be (4 MB pass the driver at most), and the pieces each is dealt out in.
HEAVY_TERMS, HEAVY_LENGTH, PIECES = 1000, 4096, 200


def joined_by_term(counts: DataFrame, table: DataFrame, frequency: DataFrame, how: str = "inner") -> DataFrame:
    """``counts`` joined to ``table`` (one row per term), however frequent a term is.

    Rows of the most frequent terms of ``frequency`` (term, df) are dealt out in
    pieces, for which the table has copies of their rows. So no key of the join
    holds more than one in ``PIECES`` of a term's rows or, for the other terms,
    one in ``HEAVY_TERMS`` of all rows, whatever the session splits by itself.
    """
    named = frequency.where(F.length("term") <= HEAVY_LENGTH).orderBy(F.desc("df"), "term").limit(HEAVY_TERMS)
    is_heavy = F.col("term").isin([row["term"] for row in named.select("term").collect()])
    piece = F.when(is_heavy, F.pmod(F.xxhash64(*counts.columns), F.lit(PIECES)).cast("int")).otherwise(0)
    pieces = F.when(is_heavy, F.sequence(F.lit(0), F.lit(PIECES - 1))).otherwise(F.array(F.lit(0)))
    dealt, copied = counts.withColumn("_piece", piece), table.withColumn("_piece", F.explode(pieces))
    return dealt.join(copied, ["term", "_piece"], how).drop("_piece")


def idf_weights(counts: DataFrame, posts: DataFrame) -> DataFrame:
    """Document frequency of each term and ln((N + 1) / (df + 1)); N counts the posts with text."""
    total = with_text(posts).agg(F.count("*")).scalar()
    frequency = counts.groupBy("term").agg(F.count("*").alias("df"))
    return frequency.select("term", "df", F.log((total + 1) / (F.col("df") + 1)).alias("idf"))


def tf_idf(counts: DataFrame, posts: DataFrame) -> DataFrame:
    """TF-IDF weight of each term in each post.

    The counts are stored because several passes read them, the weights because
    their size then decides how they are joined. Frequent terms are dealt out
    (``joined_by_term``).
    """
    stored = written(counts, "term-counts")
    weights = written(idf_weights(stored, posts), "idf-weights")
    joined = joined_by_term(stored, weights.select("term", "idf"), weights.select("term", "df"))
    return joined.select("id", "term", "tf", (F.col("tf") * F.col("idf")).alias("tfidf"))
