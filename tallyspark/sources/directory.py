"""The bank directory: a snapshot in the store, read again when it is older than a day."""

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("country", T.StringType()), T.StructField("position", T.LongType())])


def bank_directory(spark: SparkSession, snapshot: str, taken_at: datetime | None, as_of: datetime, fetch: Callable[[], DataFrame], most_age: timedelta = timedelta(hours=24)) -> tuple[DataFrame, datetime]:
    """The directory and when it was taken; ``fetch`` is only called for a missing or old snapshot, which it replaces."""
    if taken_at is not None and as_of - taken_at < most_age:
        return spark.read.schema(SCHEMA).parquet(snapshot), taken_at
    fetch().write.mode("overwrite").parquet(snapshot)
    return spark.read.schema(SCHEMA).parquet(snapshot), as_of
