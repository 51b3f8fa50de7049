"""Queries on text: cleaning, tokens, stop words, bigrams, lemmas."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodlark.functions import text
from moodlark.functions.lexicon import DASHBOARD_STOP_WORDS
from moodlark.operators import abbreviations, features
from moodlark.operators.top_words import lemma_map
from moodlark.plans import sql
from moodlark.plans.posts import documents_as_posts
from moodlark.plans.registry import query
from moodlark.workspace import written

_DOCUMENTS = "docs AS (SELECT doc_id AS id, text AS tweet FROM documents)"


def _joined(name: str, words: str, separator: str = " ") -> list:
    return ["id", F.size(words).alias("n"), F.array_join(words, separator).alias(name)]


@query("t1_cleaned_text", f"SELECT doc_id AS id, {sql.cleaned('text')} AS cleaned FROM documents")
def cleaned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = documents_as_posts(spark, sf_dir)
    return posts.select("id", text.clean_text(F.col("tweet")).alias("cleaned"))


@query("t2_text_without_commas", "SELECT doc_id AS id, replace(text, ',', '') AS tweet FROM documents")
def text_without_commas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_posts(spark, sf_dir).select("id", text.drop_commas(F.col("tweet")).alias("tweet"))


@query(
    "t3_first_tokens",
    f"""SELECT doc_id AS id, nullif(regexp_extract(text, '[^{sql.BLANKS}]+'), '') AS first_token
    FROM documents""",
)
def first_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_posts(spark, sf_dir).select("id", text.first_token(F.col("tweet")).alias("first_token"))


_DISPLAY = """shown AS (
  SELECT doc_id AS id,
         replace(replace(replace(text, chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r') AS line
  FROM documents)"""


@query(
    "t4_display_text",
    f"""WITH {_DISPLAY}
    SELECT id, CASE WHEN length(line) >= 50 THEN left(line, 46) || '...' ELSE line END AS shown FROM shown""",
)
def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_posts(spark, sf_dir).select("id", text.display_text(F.col("tweet")).alias("shown"))


@query(
    "t5_tokens",
    f"""WITH {_DOCUMENTS}, {sql.tokens_cte("docs")}
    SELECT id, len(tk)::INTEGER AS n, array_to_string(tk, ' ') AS tokens FROM tokens""",
)
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_tokens(documents_as_posts(spark, sf_dir)).select(*_joined("tokens", features.TOKENS))


@query(
    "t6_filtered_words",
    f"""WITH {_DOCUMENTS}, {sql.tokens_cte("docs")}
    SELECT id, len(words)::INTEGER AS n, array_to_string(words, ' ') AS words FROM filtered""",
)
def filtered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    filtered = features.with_filtered_words(documents_as_posts(spark, sf_dir))
    return filtered.select(*_joined("words", features.FILTERED))


@query(
    "t7_bigrams",
    f"""WITH {_DOCUMENTS}, {sql.tokens_cte("docs")}
    SELECT id, len(ngrams)::INTEGER AS n, array_to_string(ngrams, '|') AS bigrams FROM pairs""",
)
def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    paired = features.with_bigrams(documents_as_posts(spark, sf_dir))
    return paired.select(*_joined("bigrams", features.BIGRAMS, "|"))


_WORDS = f"{_DOCUMENTS}, words AS (SELECT id, {sql.word_tokens('tweet')} AS tokens FROM docs)"


def _word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_posts(spark, sf_dir).select("id", text.word_tokens(F.col("tweet")).alias("tokens"))


@query(
    "t8_word_tokens",
    f"WITH {_WORDS} SELECT id, len(tokens)::INTEGER AS n, array_to_string(tokens, ' ') AS words FROM words",
)
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_tokens(spark, sf_dir).select(*_joined("words", "tokens"))


_SCORES = f"{_DOCUMENTS}, {sql.abbreviation_scores('docs', 'tweet')}"


@query(
    "t8_abbreviation_scores",
    f"""WITH {_SCORES} SELECT word, with_period, without_period, round(log_likelihood, 4) AS log_likelihood, round(score, 6) + 0.0 AS score
    FROM scores""",
)
def abbreviation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each word is an abbreviation, from the whole corpus."""
    counts = written(abbreviations.word_counts(documents_as_posts(spark, sf_dir), "tweet"), "period-counts")
    scores = abbreviations.abbreviation_scores(counts)
    return scores.withColumns({"log_likelihood": F.round("log_likelihood", 4), "score": F.round("score", 6) + 0.0})


_LEARNED = f"""{_SCORES}, learned AS (SELECT list(word) AS words FROM scores WHERE score >= 0.3),
kept AS (SELECT id, {sql.with_kept_periods("tweet", "words")} AS tweet FROM docs CROSS JOIN learned),
words AS (SELECT id, {sql.word_tokens("tweet")} AS tokens FROM kept)"""


@query(
    "t8_learned_word_tokens",
    f"WITH {_LEARNED} SELECT id, len(tokens)::INTEGER AS n, array_to_string(tokens, ' ') AS words FROM words",
)
def learned_word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word tokens, where the period stays with the abbreviations that the corpus itself shows."""
    posts = documents_as_posts(spark, sf_dir).select("id", "tweet")
    words = abbreviations.learned_abbreviations(posts, "tweet")
    told = abbreviations.with_abbreviations(posts, "tweet", "id", words)
    tokens = text.word_tokens(F.col("tweet"), F.col("abbreviations"))
    return told.select("id", tokens.alias("tokens")).select(*_joined("words", "tokens"))


_ALPHABETIC = f"""{_WORDS}, alphabetic AS (
  SELECT id, list_filter(tokens, lambda w: regexp_full_match(w, '[a-zA-Z]+')) AS tokens FROM words)"""


def _alphabetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_tokens(spark, sf_dir).select("id", text.alphabetic_tokens(F.col("tokens")).alias("tokens"))


@query(
    "t9_alphabetic_tokens",
    f"""WITH {_ALPHABETIC}
    SELECT id, len(tokens)::INTEGER AS n, array_to_string(tokens, ' ') AS words FROM alphabetic""",
)
def alphabetic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alphabetic(spark, sf_dir).select(*_joined("words", "tokens"))


@query(
    "t10_content_words",
    f"""WITH {_ALPHABETIC}, content AS (
      SELECT id, list_filter(tokens, lambda w: w NOT IN ({sql.listed(DASHBOARD_STOP_WORDS)})) AS tokens
      FROM alphabetic)
    SELECT id, len(tokens)::INTEGER AS n, array_to_string(tokens, ' ') AS words FROM content""",
)
def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = _alphabetic(spark, sf_dir).select("id", text.without_words(F.col("tokens")).alias("tokens"))
    return content.select(*_joined("words", "tokens"))


@query(
    "t11_lemmas",
    f"""WITH {_ALPHABETIC}, spoken AS (SELECT unnest(tokens) AS word FROM alphabetic), {sql.lemma_cte("spoken")}
    SELECT word, lemma FROM lemmas""",
)
def lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = features.exploded(_word_tokens(spark, sf_dir), "tokens").select(F.col("term").alias("word"))
    words = written(spoken.where(text.is_alphabetic(F.col("word"))).distinct(), "words")
    with_lemma = words.join(lemma_map(words), "word", "left")
    return with_lemma.select("word", F.coalesce("lemma", "word").alias("lemma"))


@query(
    "t12_display_words",
    f"""WITH {_DOCUMENTS}, {sql.tokens_cte("docs")}
    SELECT id, array_to_string(words, ' : ') AS features FROM filtered""",
)
def display_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    filtered = features.with_filtered_words(documents_as_posts(spark, sf_dir))
    return filtered.select("id", text.display_words(F.col(features.FILTERED)).alias("features"))
