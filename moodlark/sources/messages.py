"""Message streams: subscribe, parse, publish.

The format and its options are parameters. Kafka is the default; tests and
queries use file formats, because no broker is at hand.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.types import StringType, StructField, StructType

from moodlark.schemas import ARRIVAL, POST

# Format, option names and local default of the connector.
KAFKA = "kafka"

# Body of a message where the source needs a schema; Kafka brings its own.
MESSAGE = StructType([StructField("value", StringType())])


def kafka_options(bootstrap_servers: str = "localhost:9092", topic: str = "posts") -> dict[str, str]:
    return {"kafka.bootstrap.servers": bootstrap_servers, "subscribe": topic}


def kafka_sink_options(bootstrap_servers: str = "localhost:9092", topic: str = "posts") -> dict[str, str]:
    return {"kafka.bootstrap.servers": bootstrap_servers, "topic": topic}


def subscribe(
    spark: SparkSession,
    options: dict[str, str],
    source_format: str = KAFKA,
    schema: StructType | None = None,
) -> DataFrame:
    """A streaming DataFrame with the message body in column ``value``."""
    reader = spark.readStream.format(source_format).options(**options)
    return (reader.schema(schema) if schema else reader).load()


def parsed(value: Column, schema: StructType) -> Column:
    """The JSON object in a message body; fields that do not fit are null."""
    return F.from_json(value.cast("string"), schema)


def parse_messages(messages: DataFrame, schema: StructType = POST) -> DataFrame:
    """Decode ``value`` and spread its JSON fields over columns.

    Messages that are no JSON object give a row of nulls; unknown keys go. The
    columns that tell when a message arrived stay, where the source has them.
    """
    arrival = [name for name in ARRIVAL if name in messages.columns]
    return messages.select(parsed(F.col("value"), schema).alias("data"), *arrival).select("data.*", *arrival)


def to_messages(posts: DataFrame, *kept: str) -> DataFrame:
    """One JSON object per post; null fields are written as null. ``kept`` names columns that stay beside it."""
    fields = F.struct("id", "source", "target", "tweet")
    return posts.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"), *kept)


def publish(messages: DataFrame, options: dict[str, str], sink_format: str = KAFKA) -> None:
    """Send a batch of messages; executors write, nothing passes the driver."""
    messages.write.format(sink_format).options(**options).save()


def publish_batch(messages: DataFrame, batch_id: int, options: dict[str, str], sink_format: str = KAFKA) -> None:
    """Send one micro-batch. In files, a batch that comes again takes the place of its first copy; a broker may get it twice."""
    if "path" in options:
        own = {**options, "path": f"{options['path']}/batch={batch_id}"}
        messages.write.mode("overwrite").format(sink_format).options(**own).save()
    else:
        publish(messages, options, sink_format)


def publish_stream(
    messages: DataFrame, options: dict[str, str], checkpoint: str, sink_format: str = KAFKA
) -> DataStreamWriter:
    writer = messages.writeStream.format(sink_format).options(**options)
    return writer.option("checkpointLocation", checkpoint)
