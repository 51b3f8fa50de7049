"""Registry of this subpackage's queries."""

import shutil
import tempfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import moodlark

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers of this application the package, once.

    The archive is made by the driver; Spark hands it to the executors.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(moodlark.__file__).parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='moodlark-ship-')}/moodlark", "zip", root.parent, root.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say the same, the SQL to compare it with."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @wraps(function)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return function(spark, sf_dir)

        QUERIES[name] = shipped
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register
