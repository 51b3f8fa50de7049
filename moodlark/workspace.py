"""Shared working folder and tables written to cut lineage.

Everything that is used more than once and is costly to recompute is written
as Parquet below the folder named by ``spark.checkpoint.dir``. A written table
survives the loss of any executor, and its file size gives the optimizer a
measured size, so ``spark.sql.autoBroadcastJoinThreshold`` decides whether a
join side is broadcast or shuffled.

Each application writes to a folder of its own, which a program removes when
its results are stored (``remove_run_folder``).
"""

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    On one machine a temporary folder will do, which goes with the process. On
    a cluster the session must name one.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="moodlark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/moodlark-{spark.sparkContext.applicationId}"


def _removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder in any store that Spark writes to; Spark's file system client does it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_run_folder(spark: SparkSession) -> None:
    """Delete what this application has written for itself; DataFrames made from it cannot be read any more."""
    _removed(spark, run_folder(spark))


_groups: list[str] = []


@contextmanager
def group(name: str) -> Iterator[str]:
    """What is written inside goes to a folder of its own, whose name ``remove_group`` takes."""
    _groups.append(f"{name}-{uuid.uuid4().hex}")
    try:
        yield "/".join(_groups)
    finally:
        _groups.pop()


def remove_group(spark: SparkSession, name: str) -> None:
    _removed(spark, f"{run_folder(spark)}/{name}")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the run folder; nothing is ever overwritten."""
    return "/".join([run_folder(spark), *_groups, f"{name}-{uuid.uuid4().hex}"])


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the stored table."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
