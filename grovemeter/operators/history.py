"""Snapshot summaries by age: how much each owner keeps, by time since change or access.

A bin is named by its youngest age and reaches up to the next one; the last is open. Bounds
are half-open calendar ranges before ``as_of``. Entries with a later or missing time fall in
no bin and are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovemeter.functions.times import before, epoch_timestamp


@dataclass(frozen=True)
class AgeBin:
    label: str
    months: int = 0
    days: int = 0


# Bins of the change-time history and of the access history.
CHANGE_BINS = (
    AgeBin("0 days"),
    AgeBin("1 month", months=1),
    AgeBin("6 months", months=6),
    AgeBin("1 year", months=12),
    AgeBin("3 years", months=36),
)
ACCESS_BINS = (
    AgeBin("0 days"),
    AgeBin("60 days", days=60),
    AgeBin("90 days", days=90),
)

SUMMARY_KEYS = ["root_inode", "uid", "gid"]


def age_bins(spark: SparkSession, bins: Sequence[AgeBin], as_of: Column) -> DataFrame:
    """The bins as a table: ``bin_ord, bin_label, months, days, lo, hi``; ``lo`` NULL = open.

    One row per listed bin, so its single-partition window stays as small as the list.
    Summaries join it on ``bin_ord``.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("bin_ord"),
                F.lit(b.label).alias("bin_label"),
                F.lit(b.months).alias("months"),
                F.lit(b.days).alias("days"),
                before(as_of, b.months, b.days).alias("hi"),
            )
            for n, b in enumerate(bins)
        ]
    )
    return (
        spark.range(1)
        .select(F.inline(rows))
        .select(
            "bin_ord",
            "bin_label",
            "months",
            "days",
            F.lead("hi").over(Window.orderBy("bin_ord")).alias("lo"),
            "hi",
        )
    )


def bin_ordinal(moment: Column, bins: Sequence[AgeBin], as_of: Column) -> Column:
    """The bin a time falls in, as one expression: bounds fold to constants, no range join."""
    ordinal = F.lit(None).cast("int")
    for n, b in enumerate(bins):
        ordinal = F.when(moment < before(as_of, b.months, b.days), F.lit(n)).otherwise(ordinal)
    return ordinal


def binned_summary(
    entries: DataFrame, time_column: str, bins: Sequence[AgeBin], as_of: Column | None = None
) -> DataFrame:
    """``inodes`` and ``size`` per (root_inode, uid, gid, bin), stamped with ``time``.

    Bins must be listed from young to old. The scan reads five columns and the sums are
    reduced before their only shuffle. Root inodes are not told apart by device.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    ordinal = bin_ordinal(epoch_timestamp(F.col(time_column)), bins, as_of)
    totals = (
        entries.select(*SUMMARY_KEYS, "size", ordinal.alias("bin_ord"))
        .where(F.col("bin_ord").isNotNull())
        .groupBy(*SUMMARY_KEYS, "bin_ord")
        .agg(F.count(F.lit(1)).alias("inodes"), F.sum("size").alias("size"))
    )

    def of_bin(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bin_ord") + 1)

    return totals.select(
        *SUMMARY_KEYS,
        "inodes",
        "size",
        "bin_ord",
        of_bin([b.label for b in bins]).alias("bin_label"),
        of_bin([b.months for b in bins]).alias("months"),
        of_bin([b.days for b in bins]).alias("days"),
        as_of.alias("time"),
    )


def age_history(entries: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Usage by time since last change."""
    return binned_summary(entries, "mtime", CHANGE_BINS, as_of)


def access_history(entries: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Usage by time since last access."""
    return binned_summary(entries, "atime", ACCESS_BINS, as_of)
