"""Schemas of the records that enter and leave the jobs."""

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# Labelled post: training CSV rows and stream messages.
POST = StructType(
    [
        StructField("id", IntegerType()),
        StructField("source", StringType()),
        StructField("target", StringType()),
        StructField("tweet", StringType()),
    ]
)

# Same post where ids outgrow an int (the tables the queries run on).
POST_LONG_ID = StructType([StructField("id", LongType()), *POST.fields[1:]])

# What a message stream tells of a message's arrival.
ARRIVAL = ("timestamp", "partition", "offset")

CORRUPT_RECORD = "_corrupt_record"

# Output names of the dashboard form of a post.
DASHBOARD_NAMES = {
    "id": "Tweet ID",
    "source": "Entity",
    "target": "Sentiment",
    "tweet": "Tweet content",
}

# Stored prediction. batch_id and seq give the table the insertion order
# that a Spark table does not have by itself.
PREDICTION = StructType(
    [
        StructField("tweet", StringType()),
        StructField("filtered_words", ArrayType(StringType())),
        StructField("target", StringType()),
        StructField("label", DoubleType()),
        StructField("prediction", DoubleType()),
        StructField("seq", LongType()),
        StructField("scored_at", TimestampType()),
        StructField("batch_id", LongType()),
    ]
)

METRICS = StructType(
    [
        StructField("accuracy", DoubleType()),
        StructField("f1", DoubleType()),
        StructField("model_id", StringType()),
        StructField("trained_at", TimestampType()),
    ]
)
