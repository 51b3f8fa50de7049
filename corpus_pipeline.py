"""A corpus made ready for training: quality, near-duplicates, benchmark leaks, mix, token files.

``STAGES`` are applied one after another, each to all that its predecessor
kept. The rows of a stage must be stored before the next one begins, as ``run``
does in the shared folder: the next one removes what the stage wrote for itself.
"""

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodlark.llm.decontaminate import leaks, without_leaks
from moodlark.llm.mixing import mix
from moodlark.llm.packs import read_token_files, write_token_files
from moodlark.llm.quality import judge_quality
from moodlark.llm.queries import END_ID, TOKENIZER, WEIGHTS
from moodlark.llm.registry import query, ship
from moodlark.llm.simhash import one_of_each
from moodlark.llm.words import count_words
from moodlark.plans.posts import table
from moodlark.workspace import group, new_path, remove_group, written

Stage = Callable[..., DataFrame]

# Words of a shingle of the near-duplicate stage.
SHINGLE_WORDS = 3

# By application, the tables of the last stage.
_last: dict[str, str] = {}


def tidy(stage: Stage) -> Stage:
    """The stage, with its tables in a group of their own; those of the stage before are removed."""

    @wraps(stage)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str, **options: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        if application in _last:
            remove_group(spark, _last.pop(application))
        with group("stage") as name:
            _last[application] = name
            return stage(spark, docs, sf_dir, **options)

    return tidied


@tidy
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null text has no words and goes. Repeated rows are judged alike and all
    stay or go; an empty table gives an empty table.
    """
    whole = docs.select(F.struct("*").alias("whole"), "text")
    return judge_quality(whole, keep_text=False).where("kept").select("whole.*")


@tidy
def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest id.

    Fingerprints of three-word shingles link at three or fewer of 64 bits, as
    the operator's contract has it. Null and empty texts have one fingerprint;
    of rows that share the smallest id one stays, a null id comes last. An empty
    table gives an empty table.
    """
    ship(spark)
    return one_of_each(docs, SHINGLE_WORDS)


@tidy
def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item.

    Null and empty texts hold none and stay, as do all rows if the benchmark is
    empty. Rows are told apart by id (null is one) and text: repeated rows go or
    stay together. An empty table gives an empty table.
    """
    ship(spark)
    found = written(leaks(docs, table(spark, sf_dir, "benchmark")), "leaks")
    return without_leaks(docs, found)


@tidy
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix has them, at most three times.

    Documents without words (null texts too) weigh nothing in the sums. A null
    source is a source of its own, the last. Repeated rows are documents of their
    own; reruns agree. An empty table gives an empty table.
    """
    return mix(docs, count_words(F.col("text")), WEIGHTS, copied=True)


@tidy
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str, folder: str | None = None) -> DataFrame:
    """What the token files hold: one row per document and copy.

    The files stay in ``folder``; without one they go with the application's
    other tables. A null text is empty and has the end id only. Equal ids keep
    a row each; null ids come first. An empty table gives no pack and no row.
    """
    ship(spark)
    folder = folder or new_path(spark, "token-files")
    write_token_files(docs, folder, public_tokenizers.path(TOKENIZER), END_ID)
    return read_token_files(spark, folder)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", good_quality),
    ("SimHash near-dedup", unique),
    ("benchmark decontamination", clean_of_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_files),
]

# Estimation, components and rounding are iterative: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``; the token files are written to ``folder`` if it is given."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return written(STAGES[-1][1](spark, docs, sf_dir, folder=folder), "rows")


query("pipeline", ORACLE_SQL)(run)
