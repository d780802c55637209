"""Joins of a large fact side to a lookup side, safe for hot keys.

Whether the lookup is broadcast is decided by the planner's estimate of its size, which for
staged and other parquet tables comes from their files; nothing is read or counted for it.
Beyond the bound the join shuffles, and every key that holds more rows than one task should
see is split into as many pieces as it needs; the matching lookup rows are repeated once per
piece. Salts are hashes of the row and its input partition, not random numbers: a re-run task
sends each row to the same place, and equal rows from different partitions still spread out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemeter.scratch import stage

# Estimated bytes. Packed files of sorted rows grow twentyfold and more in memory.
BROADCAST_BYTES = 4 * 1024**2
ROWS_PER_PIECE = 1_000_000
# Tables estimated below this are counted before hot keys are looked for: equal rows may take far
# less than a byte each in parquet, so bytes alone say nothing about rows.
COUNTED_BYTES = 1_000_000

# Bytes of a staged table that one task of a shuffle takes: about 200 MB once it is sorted in memory.
TASK_BYTES = 8 * 1024**2

UNKNOWN = object()


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate; joins and the like over unstaged tables count as huge."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size))


def is_small(df: DataFrame) -> bool:
    """True if ``df`` is certain to fit a broadcast, judged without running anything."""
    return estimated_bytes(df) <= BROADCAST_BYTES


def sized(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is small, else left to the planner."""
    return F.broadcast(df) if is_small(df) else df


def partitions_for(df: DataFrame) -> int:
    """Partitions for a shuffle of a staged table: the session's number, more if tasks would grow large."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-estimated_bytes(df) // TASK_BYTES))


def argument_table(spark: SparkSession, **columns: list) -> DataFrame:
    """A table of an argument's values (whole numbers or texts), of known size to the planner."""
    kinds = {name: pa.string() if values and isinstance(values[0], str) else pa.int64() for name, values in columns.items()}
    return spark.createDataFrame(pa.table({name: pa.array(values, kinds[name]) for name, values in columns.items()}))


def hot_keys(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of ``facts`` to split, with the number of ``pieces`` of each."""
    counts = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return limit_hot(counts, keys, "rows")


def limit_hot(counts: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """Hot keys from a table that already knows the row count of each key."""
    pieces = F.ceil(F.col(count) / ROWS_PER_PIECE).cast("int").alias("pieces")
    return counts.where(F.col(count) > ROWS_PER_PIECE).select(*keys, pieces)


def salted_join(
    facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str, hot: DataFrame
) -> DataFrame:
    """Shuffle join on ``keys`` with each hot key spread over its ``pieces``.

    ``hot`` has one narrow row for each ROWS_PER_PIECE facts at most; it is broadcast if that
    is small, else shuffled, where adaptive execution splits what is uneven.
    """
    keys = list(keys)
    hot = sized(hot)
    piece = F.pmod(F.xxhash64(*facts.columns, F.spark_partition_id()), F.col("pieces"))
    salted = (
        facts.join(hot, keys, "left")
        .withColumn("salt", F.when(F.col("pieces").isNotNull(), piece).otherwise(F.lit(0)).cast("int"))
        .drop("pieces")
    )
    repeated = (
        lookup.join(hot, keys, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
        .drop("pieces")
    )
    return salted.join(repeated, keys + ["salt"], how).drop("salt")


def find_hot_keys(facts: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The hot keys of ``facts`` as a staged table, or None if there are none."""
    if estimated_bytes(facts) <= COUNTED_BYTES and facts.count() <= ROWS_PER_PIECE:
        return None  # no key can hold more rows than there are
    hot = stage(hot_keys(facts, keys), "hot")
    return None if hot.isEmpty() else hot


def hot_values(facts: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame | None]:
    """The hot keys of ``facts`` for joins on each of ``columns`` alone, found in one scan.

    All columns are counted in one aggregation, reduced on the map side, and what is hot is
    staged once. Joins to lookups with one row a key never add rows, so the hot keys of a fact
    table hold for all joins of a star.
    """
    if estimated_bytes(facts) <= COUNTED_BYTES and facts.count() <= ROWS_PER_PIECE:
        return dict.fromkeys(columns)
    place = sum(F.when(F.grouping(c) == 0, i).otherwise(0) for i, c in enumerate(columns))
    counts = facts.select(*columns).groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns])
    counts = counts.agg(F.count(F.lit(1)).alias("rows"), place.alias("place"))
    known = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()
    staged = stage(limit_hot(counts.where(known), ["place", *columns], "rows"), "hot")
    found = {row["place"] for row in staged.select("place").distinct().collect()}
    return {c: staged.where(F.col("place") == i).select(c, "pieces") if i in found else None for i, c in enumerate(columns)}


def join_star(
    facts: DataFrame, lookups: Sequence[tuple[DataFrame, str]], small: Mapping[str, bool] | None = None
) -> DataFrame:
    """Inner joins of ``facts`` to lookups, each on a key column of its own that is unique in the lookup.

    If any lookup is too large for a broadcast, ``facts`` is scanned once more for the hot values of
    all their keys; the joins themselves are never run for it.
    """
    small = [is_small(lookup) for lookup, _ in lookups]
    large = list(dict.fromkeys(key for (_, key), fits in zip(lookups, small) if not fits))
    hot = hot_values(facts, large) if large else {}
    for (lookup, key), fits in zip(lookups, small):
        facts = join_lookup(facts, lookup, [key], hot=hot.get(key), small=fits)
    return facts


def join_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    hot: DataFrame | None | object = UNKNOWN,
    small: bool | None = None,
) -> DataFrame:
    """Join ``facts`` to ``lookup`` on equal-named ``keys`` (``how``: inner or left).

    Callers that already know pass ``hot``, the hot keys or None for none, and ``small``,
    whether the lookup may be broadcast; otherwise both are measured here.
    """
    keys = list(keys)
    if small is None:
        small = is_small(lookup)
    if small:
        return facts.join(F.broadcast(lookup), keys, how)
    if hot is UNKNOWN:
        hot = find_hot_keys(facts, keys)
    if hot is None:
        return facts.join(lookup, keys, how)
    return salted_join(facts, lookup, keys, how, hot)
