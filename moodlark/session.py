"""Session settings the jobs are written for."""

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan from real shuffle sizes: coalesce small partitions, split
    # skewed join partitions, switch to broadcast under the size threshold.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Training sends dense gradients of vocabulary size between executors.
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str, cores: str = "*", **overrides: str) -> SparkSession:
    """Single-machine session for tests and the benchmark.

    On a cluster use the session that spark-submit provides; nothing in the
    package depends on the settings made here.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    local = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
    }
    for key, value in {**SETTINGS, **local, **overrides}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
