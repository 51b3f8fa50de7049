"""Train, keep, load and apply the sentiment classifier."""

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, IndexToString, StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodlark.functions.lexicon import CLASS_NAMES
from moodlark.operators.features import (
    BIGRAMS,
    FILTERED,
    TOKENS,
    bigrams,
    capped_vocabulary,
    corpus_counts,
    joined_by_term,
    stop_words_remover,
    tokenizer,
)
from moodlark.operators.metrics import evaluate
from moodlark.operators.relational import with_text
from moodlark.workspace import written

# Vocabulary cap by default and of the stored bigram model.
DEFAULT_VOCABULARY = 262_144
STORED_VOCABULARY = 100_000

# Multiplier and modulus of the hash split.
HASH_MULTIPLIER = 2_654_435_761
HASH_MODULUS = 2**32

TRAIN_SHARE = 0.8

# Up to so many terms one task reads them all; of more, so many fall to each task at most.
TERMS_IN_ONE_TASK, TERMS_IN_TASK = 2**22, 2**25
# Parts and depth of a tree of sums that ends in one task: 28, 7, 1. Four times the parts take one step more.
TREE_PARTS, TREE_DEPTH, TREE_FACTOR = 28, 3, 4


def hash_of_id(post_id: Column) -> Column:
    """``id * multiplier mod 2^32`` without overflow, whatever the id."""
    half = 2**31
    low = F.pmod(post_id, F.lit(half)) * F.lit(HASH_MULTIPLIER)
    odd_half = F.pmod(F.shiftright(post_id, 31), F.lit(2)) * F.lit(half)
    return F.pmod(low + odd_half, F.lit(HASH_MODULUS))


def in_training_set(post_id: Column, share: float = TRAIN_SHARE) -> Column:
    """Posts without an id go to training, so that none is lost."""
    below = hash_of_id(post_id) < F.lit(math.ceil(share * HASH_MODULUS))
    return F.coalesce(below, F.lit(True))


def hash_split(posts: DataFrame, share: float = TRAIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """Training and test posts, decided row by row: no sort, no shuffle, repeatable."""
    chosen = in_training_set(F.col("id"), share)
    return posts.where(chosen), posts.where(~chosen)


def random_split(
    posts: DataFrame, share: float = TRAIN_SHARE, seed: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Spark's own random split. It sorts each partition; prefer the hash split."""
    train, test = posts.randomSplit([share, 1 - share], seed)
    return train, test


def count_vectorizer(terms: str, vocab_size: int = DEFAULT_VOCABULARY) -> CountVectorizer:
    return CountVectorizer(inputCol=terms, outputCol="tf", vocabSize=vocab_size)


def label_indexer() -> StringIndexer:
    return StringIndexer(inputCol="target", outputCol="label", stringOrderType="frequencyDesc")


def sentiment_pipeline(
    terms: str = BIGRAMS,
    vocab_size: int = DEFAULT_VOCABULARY,
    max_iter: int = 100,
    keep_words: bool = True,
) -> Pipeline:
    """The unfitted classifier on bigrams or on tokens.

    The token model needs neither stop words nor bigrams; ``keep_words=False``
    leaves those two stages out where ``filtered_words`` is not wanted.
    """
    if terms not in (BIGRAMS, TOKENS):
        raise ValueError(f"terms must be {BIGRAMS!r} or {TOKENS!r}")
    words = [stop_words_remover(), bigrams()] if keep_words or terms == BIGRAMS else []
    return Pipeline(
        stages=[
            tokenizer(),
            *words,
            count_vectorizer(terms, vocab_size),
            IDF(inputCol="tf", outputCol="features"),
            label_indexer(),
            LogisticRegression(maxIter=max_iter),
        ]
    )


@dataclass(frozen=True)
class Training:
    """``terms``: one row with the terms ``kept`` in the vocabulary and those ``cut`` from it."""

    model: PipelineModel
    train_set: DataFrame
    scored: DataFrame
    metrics: DataFrame
    terms: DataFrame


def _is_plain(counter: CountVectorizer) -> bool:
    return counter.getMinDF() == 1.0 and not counter.isSet(counter.maxDF)


def fit_vocabulary(counter: CountVectorizer, corpus: DataFrame, tokenized: DataFrame) -> CountVectorizerModel:
    """The fitted vectorizer, with an exact vocabulary: the most frequent terms, equal counts in alphabetical order.

    ``corpus`` holds the stored counts of ``tokenized``. Spark's own fit leaves
    it to chance which of the terms with the count at the cap it keeps. Only
    those that are kept pass the driver. Bounds on document frequency, which
    are off by default, are left to Spark's fit.
    """
    if not _is_plain(counter):
        return counter.fit(tokenized)
    kept = capped_vocabulary(corpus, counter.getVocabSize()).orderBy(F.desc("n"), "term")
    vocabulary = [row["term"] for row in kept.select("term").collect()]
    found = CountVectorizerModel.from_vocabulary(
        vocabulary or [""], counter.getInputCol(), counter.getOutputCol(), minTF=counter.getMinTF(), binary=counter.getBinary()
    )
    return found


def _cut_terms(corpus: DataFrame, counter: CountVectorizerModel) -> DataFrame:
    """How many terms the vocabulary cap keeps and cuts."""
    kept = len(counter.vocabulary)
    known = corpus.agg(F.count("*").alias("known"))
    return known.select(F.lit(kept).cast("long").alias("kept"), (F.col("known") - kept).alias("cut"))


def train(posts: DataFrame, pipeline: Pipeline | None = None, split=hash_split) -> Training:
    """Fit on the training posts, score and evaluate on the others.

    The stages are fitted one after another, on stored columns: texts are
    tokenized once for all of them, and the regression, which passes over its
    input for each step, reads count vectors that were dealt out evenly. The
    result is the same pipeline model that ``Pipeline.fit`` gives, but that ties
    at the vocabulary's cap are settled, so that two fits have the same terms.

    Each step adds up one gradient of the vocabulary's size for each part of
    the vectors. So their number follows the terms, not the session's shuffles,
    and the sums meet on the executors: the driver gets one for each step.
    """
    stages = (pipeline or sentiment_pipeline()).getStages()
    counter = next(stage for stage in stages if isinstance(stage, CountVectorizer))
    at = stages.index(counter)
    texts, terms = stages[:at], counter.getInputCol()
    worded = PipelineModel(texts).transform(with_text(posts).select("id", "target", "tweet"))
    columns = [c for c in ("id", "target", "tweet", FILTERED, terms) if c in worded.columns]
    stored = written(worded.select(*columns), "training-posts")
    train_set, test_set = split(stored)
    corpus = written(corpus_counts(train_set, terms), "corpus-counts")
    vocabulary = fit_vocabulary(counter, corpus, train_set)
    counted = vocabulary.transform(train_set).select("target", vocabulary.getOutputCol())
    parts, depth = _summing_tree(corpus.agg(F.sum("n")).first()[0] or 0)
    # Dealt out when read: how many tasks read stored files is the session's business.
    fitted, data = [vocabulary], written(counted, "training-counts").repartition(parts)
    for stage in stages[at + 1 :]:
        fitted.append(_with_depth(stage, depth).fit(data))
        data = fitted[-1].transform(data)
    model, later = PipelineModel([*texts, *fitted]), PipelineModel(fitted)
    scored = written(_narrow(later.transform(test_set)), "scored-posts")
    return Training(model, later.transform(train_set), scored, evaluate(scored), _cut_terms(corpus, vocabulary))


def _summing_tree(terms: int) -> tuple[int, int]:
    """How many parts vectors of so many terms are dealt out in, and the depth at which their sums end in one task."""
    if terms <= TERMS_IN_ONE_TASK:
        return 1, TREE_DEPTH
    parts, depth = TREE_PARTS, TREE_DEPTH
    while terms > parts * TERMS_IN_TASK:
        parts, depth = parts * TREE_FACTOR, depth + 1
    return parts, depth


def _with_depth(stage: Estimator, depth: int) -> Estimator:
    """A regression whose sums take so many steps, unless its depth was set."""
    plain = isinstance(stage, LogisticRegression) and not stage.isSet(stage.aggregationDepth)
    return stage.copy({stage.aggregationDepth: depth}) if plain else stage


def _narrow(scored: DataFrame) -> DataFrame:
    """Without the vectors over the vocabulary."""
    return scored.drop("tf", "features")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _indexer(model: PipelineModel) -> StringIndexerModel:
    return next(stage for stage in model.stages if isinstance(stage, StringIndexerModel))


def stream_safe(model: PipelineModel) -> PipelineModel:
    """The same model, for posts whose sentiment is unknown or missing.

    They get the index after the last class instead of failing the job.
    """
    copied = model.copy()
    _indexer(copied).setHandleInvalid("keep")
    return copied


def score(model: PipelineModel, posts: DataFrame, strict: bool = False) -> DataFrame:
    """Apply the model. ``strict`` lets a post without text or with an unknown class fail.

    Otherwise posts without text are left out; ``relational.without_text`` has
    them, and the scoring stream keeps them in a table of their own.
    """
    if strict:
        return model.transform(posts)
    return stream_safe(model).transform(with_text(posts))


def class_name(prediction: Column, names: Sequence[str] = CLASS_NAMES) -> Column:
    """Name of a class index; null where there is no such class."""
    name = F.lit(None).cast("string")
    for index, known in reversed(list(enumerate(names))):
        name = F.when(prediction == index, F.lit(known)).otherwise(name)
    return name


def with_class_name(scored: DataFrame, model: PipelineModel) -> DataFrame:
    """Add the predicted class name, decoded with the labels the model was fitted on."""
    decoder = IndexToString(inputCol="prediction", outputCol="predicted_name", labels=_indexer(model).labels)
    return decoder.transform(scored)


def score_long_form(counts: DataFrame, weights: DataFrame, intercepts: Sequence[float]) -> DataFrame:
    """Multinomial scores from (id, term, tf) and (term, idf, w_0 .. w_k).

    The weights hold one row per vocabulary term with its IDF and one column
    per class, so a post's terms are looked up once for all and summed per
    task before the shuffle on id. Terms without weights add nothing. Both
    tables should be stored; frequent terms are dealt out
    (``features.joined_by_term``).
    """
    classes = range(len(intercepts))
    frequency = written(counts.groupBy("term").agg(F.count("*").alias("df")), "term-frequency")
    joined = joined_by_term(counts, weights, frequency, "left")
    share = [F.col("tf") * F.col("idf") * F.coalesce(f"w_{k}", F.lit(0.0)) for k in classes]
    margins = joined.groupBy("id").agg(*[F.sum(F.coalesce(share[k], F.lit(0.0))).alias(f"s_{k}") for k in classes])
    raw = F.array(*[F.col(f"s_{k}") + F.lit(float(intercepts[k])) for k in classes])
    top = F.array_max("raw")
    powers = F.transform("raw", lambda margin: F.exp(margin - top))
    total = F.aggregate("powers", F.lit(0.0), lambda acc, power: acc + power)
    return (
        margins.select("id", raw.alias("raw"))
        .withColumn("powers", powers)
        .select(
            "id",
            F.transform("powers", lambda power: power / total).alias("probability"),
            (F.array_position("raw", top) - 1).cast("double").alias("prediction"),
        )
    )
