"""Words of a text as the queries define them: runs between ASCII white space."""

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
