"""Row filters and projections on posts and scored posts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodlark.functions.lexicon import CHARTED_SENTIMENTS
from moodlark.schemas import ARRIVAL


def with_text(posts: DataFrame) -> DataFrame:
    """Drop posts without text."""
    return posts.where(F.col("tweet").isNotNull())


def without_text(posts: DataFrame) -> DataFrame:
    """The posts that ``with_text`` drops."""
    return posts.where(F.col("tweet").isNull())


def charted(posts: DataFrame) -> DataFrame:
    """Keep the sentiments that are charted, in any spelling of case."""
    return posts.where(F.lower("target").isin(*CHARTED_SENTIMENTS))


def stored_report(scored: DataFrame, *order: str) -> DataFrame:
    """What the stream stores for each scored post, with the columns that give its order."""
    kept = [name for name in (*order, *ARRIVAL) if name in scored.columns]
    return scored.select("tweet", "filtered_words", "target", "label", "prediction", *dict.fromkeys(kept))


def evaluation_report(scored: DataFrame) -> DataFrame:
    """What the evaluation of the token model looks at."""
    return scored.select("tweet", "filtered_words", "label", "prediction")


def trainer_report(scored: DataFrame) -> DataFrame:
    """What the evaluation of the bigram model looks at."""
    return scored.select("tweet", "label", "prediction")
