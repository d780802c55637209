"""What several operators share: words, row order, range buckets."""

from __future__ import annotations

import json
import os
import string
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a regular expression class for Java, Python and RE2.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
LAST_ID = 2**63 - 1

#: Rows sampled for each range bucket, and at most in all: splitters decide how even the
#: buckets are, never what a result holds.
SAMPLE_PER_BUCKET = 40
MAX_SAMPLE = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def let_workers_import(spark: SparkSession) -> None:
    """Have Python workers look for this package where the driver found it.

    Where executors have it elsewhere (installed, or sent with the application) this changes
    nothing.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = [path for path in environment.get("PYTHONPATH", "").split(os.pathsep) if path]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def whole(column: str | Column) -> Column:
    """A text column with NULL read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The words of a text in order; NULL and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), "")


def id_order(id_column: str) -> Column:
    """An identifier to sort by, NULL last."""
    return F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def splitters(df: DataFrame, keys: Sequence[str], weight: Column, buckets: int) -> list:
    """At most ``buckets - 1`` sampled keys that cut ``df`` into ranges of similar weight.

    Only the sample reaches the driver: at most MAX_SAMPLE keys, as many as Spark's own range
    partitioning takes.
    """
    if buckets < 2:
        return []
    rows = df.count()
    wanted = min(buckets * SAMPLE_PER_BUCKET, MAX_SAMPLE)
    picked = df if rows <= wanted else df.sample(fraction=wanted / rows, seed=7)
    picked = picked.select(*keys, weight.cast("double").alias("_weight")).orderBy(*keys).collect()
    share = sum(row["_weight"] for row in picked) / buckets
    cuts, filled = [], 0.0
    for row in picked:
        key = tuple(row[k] for k in keys)
        if filled >= share * (len(cuts) + 1) and (not cuts or cuts[-1] < key):
            cuts.append(key)
        filled += row["_weight"]
    return cuts


def range_bucket(df: DataFrame, keys: Sequence[str], cuts: list) -> Column:
    """The number of ``cuts`` at or below the row's key: a binary search in one literal."""
    if not cuts:
        return F.lit(0)
    types = dict(df.dtypes)
    schema = ",".join(f"{k}:{types[k]}" for k in keys)
    literal = json.dumps([dict(zip(keys, cut)) for cut in cuts])
    found = F.from_json(F.lit(literal), f"array<struct<{schema}>>")
    size = len(cuts)
    key = F.struct(*[F.col(k) for k in keys])
    halves = F.array(*[F.lit(1 << bit) for bit in reversed(range(size.bit_length()))])

    def step(low, half):
        fits = low + half <= size
        return F.when(fits & (F.element_at(found, F.least(low + half, F.lit(size))) <= key), low + half).otherwise(low)

    return F.aggregate(halves, F.lit(0), step)
