"""Report files: notices as JSON lines and one folder of path lists per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_notices(notices: DataFrame, path: str) -> None:
    """One JSON object per notice, ready for a mailer."""
    notices.write.json(path)


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("to string, subject string, message string").json(path)


def write_user_path_lists(lists: DataFrame, path: str) -> None:
    """Text files under ``username=<name>/``, one path per line, in path order.

    Range partitioning keeps a user's paths together, mostly in one file, but cuts the list
    of a user with very many paths into several.
    """
    (
        lists.select("username", F.col("path").alias("value"))
        .repartitionByRange("username", "value")
        .sortWithinPartitions("username", "value")
        .write.partitionBy("username")
        .text(path)
    )


def read_user_path_lists(spark: SparkSession, path: str) -> DataFrame:
    lists = spark.read.schema("value string, username string").text(path)
    return lists.select("username", F.col("value").alias("path"))
