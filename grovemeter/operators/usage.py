"""Total size and number of entries per subtree.

Sizes are summed per directory before anything is joined, so a directory with very many
entries is reduced on the map side. A subtree is an interval of the index's ranks, so its total
is the difference of two prefix sums over the ranks: without a filter the index holds it, with
one the sums are taken range by range and every directory asked for reads two of them. Rows count once per row: hard links are not merged, and an unreadable row
counts as an entry of unknown size.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovemeter.functions.modes import is_directory
from grovemeter.functions.sizes import usage_line
from grovemeter.operators.filters import NO_FILTER, EntryFilter
from grovemeter.operators.lookup import argument_table, is_small, join_lookup, sized
from grovemeter.operators.tree import (
    KEY,
    PARENT_KEY,
    DirectoryIndex,
    Roots,
    as_roots,
    range_starts,
    rank_range,
    roots_at,
    select_roots,
    subtree_directories,
)
from grovemeter.scratch import stage_packed as stage


def _sum_or_zero(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0).cast("long")).alias(name)


def direct_totals(entries: DataFrame) -> DataFrame:
    """Number and total size of the rows directly inside each directory."""
    return (
        entries.where(F.col("parent_inode").isNotNull())
        .groupBy(*PARENT_KEY)
        .agg(F.count(F.lit(1)).alias("inodes"), F.sum("size").alias("size"))
    )


def usage_by_root(
    entries: DataFrame,
    roots: Iterable | DataFrame,
    index: DirectoryIndex,
    entry_filter: EntryFilter = NO_FILTER,
) -> DataFrame:
    """``root_id, device, inode, size, inodes``: one total per root, in one job.

    A root without matching rows, or not in the snapshot at all, reports zeros.
    """
    roots = as_roots(entries.sparkSession, roots, index)
    if roots.located is None:
        return _usage_of_many(entries, roots, index, entry_filter)
    zeros = roots.table.select(
        "root_id",
        F.lit(None).cast("long").alias("size"),
        F.lit(0).cast("long").alias("inodes"),
        *KEY,
    )
    return (
        _contributions(entries, roots, index, entry_filter)
        .unionByName(zeros, allowMissingColumns=True)
        .groupBy("root_id")
        .agg(
            F.max("device").alias("device"),
            F.max("inode").alias("inode"),
            _sum_or_zero("size"),
            _sum_or_zero("inodes"),
        )
    )


def _contributions(entries, roots: Roots, index, entry_filter) -> DataFrame:
    """``root_id, size, inodes`` rows that add up to the totals of the roots.

    The index holds every row on the key of a directory, so if every root is a directory the
    entries, ten or more times as many, need not be searched for their own rows.
    """
    holding = index.table if roots.all_directories else entries
    own = select_roots(entry_filter.apply(holding), roots).select(
        "root_id", "size", F.lit(1).cast("long").alias("inodes")
    )
    if index.single and entry_filter.is_empty:
        ranks = sorted({rank for _, rank, _ in roots.ranges})
        tops = index.table.where(F.col("rank").isin(ranks)).select(*KEY, "all_bytes", "all_entries")
        below = roots.table.join(F.broadcast(tops), KEY)  # as many as located roots
        return own.unionByName(below.select("root_id", F.col("all_bytes").alias("size"), F.col("all_entries").alias("inodes")))
    if index.laid_out is not None and roots.located is not None:
        wanted = entry_filter.apply(index.laid_out.where(roots.below("dir_rank")))
        return own.unionByName(
            wanted.select(F.explode(roots.holding("dir_rank")).alias("root_id"), "size", F.lit(1).cast("long").alias("inodes"))
        )
    below = subtree_directories(index, roots, with_path=False)
    if entry_filter.is_empty:
        inside = below.select(
            "root_id", "times", F.col("bytes").alias("size"), F.col("entries").alias("inodes")
        )
    else:
        tops = below.select("root_id", "device", F.col("inode").alias("parent_inode"), "times")
        wanted = entry_filter.apply(entries)
        tops = stage(tops, "tops")
        if is_small(tops):
            wanted = wanted.select(*PARENT_KEY, "size", F.lit(1).cast("long").alias("inodes"))
            inside = wanted.join(F.broadcast(tops), PARENT_KEY)
        else:
            # Sums per directory first: they are unique on the key, so no key is hot.
            inside = direct_totals(wanted).join(tops, PARENT_KEY)
    return own.unionByName(
        inside.select(
            "root_id",
            (F.col("size") * F.col("times")).alias("size"),
            (F.col("inodes") * F.col("times")).alias("inodes"),
        )
    )


def _usage_of_many(entries, roots: Roots, index, entry_filter) -> DataFrame:
    # The roots are the fact side: hard links may repeat one key very often.
    totals = _totals_by_key(entries, index, entry_filter, roots.table.select(*KEY).distinct())
    return _zero_filled(join_lookup(roots.table, totals, KEY, "left", small=False), "root_id", *KEY)


def _totals_by_key(entries, index: DirectoryIndex, entry_filter, keys: DataFrame) -> DataFrame:
    """``device, inode, size, inodes`` of each of ``keys``: its own rows and all below them."""
    own = entry_filter.apply(entries).where(F.col("inode").isNotNull()).select(
        *KEY, "size", F.lit(1).cast("long").alias("inodes")
    )
    if index.single:
        below = _totals_below(entries, index, entry_filter, index.table.join(keys, KEY, "left_semi"))
    else:
        below = _totals_by_level(entries, index, entry_filter).join(keys, KEY, "left_semi")
    return (
        own.join(keys, KEY, "left_semi")
        .unionByName(below)
        .groupBy(*KEY)
        .agg(_sum_or_zero("size"), _sum_or_zero("inodes"))
    )


def _zero_filled(df: DataFrame, *columns) -> DataFrame:
    zero = F.lit(0).cast("long")
    return df.select(
        *columns,
        F.coalesce("size", zero).alias("size"),
        F.coalesce("inodes", zero).alias("inodes"),
    )


def _totals_below(entries, index: DirectoryIndex, entry_filter, dirs: DataFrame) -> DataFrame:
    """``device, inode, size, inodes`` rows that add up to what is below each of ``dirs``."""
    if entry_filter.is_empty:
        return dirs.select(*KEY, F.col("all_bytes").alias("size"), F.col("all_entries").alias("inodes"))
    if index.laid_out is not None:
        rank = F.col("dir_rank").alias("rank")
        direct = entry_filter.apply(index.laid_out).groupBy(rank).agg(F.count(F.lit(1)).alias("inodes"), F.sum("size").alias("size"))
    else:
        direct = index.as_parents("rank").join(direct_totals(entry_filter.apply(entries)), PARENT_KEY).drop(*PARENT_KEY)
    direct = direct.withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
    return interval_totals(stage(direct, "direct"), dirs.select(*KEY, "rank", "last"))


def _totals_by_level(entries, index: DirectoryIndex, entry_filter) -> DataFrame:
    """``device, inode, size, inodes`` rows that add up to what searches find below every directory.

    For indexes in which a directory may have several rows. What is directly inside a
    directory goes up to its parents, once for each of its rows there, and from there on, all
    directories at once and a level a round; a round keeps one row for each directory that many
    levels above another, with the paths multiplied into its totals. Without a cycle some
    directory is the top of no longer path in each round, so fewer go on.
    """
    dirs = index.directories
    zero = F.lit(0).cast("long")
    if entry_filter.is_empty:
        level = dirs.select(*KEY, F.coalesce("bytes", zero).alias("size"), F.col("entries").alias("inodes"))
    else:
        direct = direct_totals(entry_filter.apply(entries)).withColumnRenamed("parent_inode", "inode")
        level = dirs.select(*KEY).join(direct, KEY, "left").fillna(0, ["size", "inodes"])
    parents = dirs.select("device", F.col("inode").alias("parent_inode"))
    steps = index.table.groupBy(*KEY, "parent_inode").agg(F.count(F.lit(1)).alias("times"))
    steps = stage(steps.join(parents, PARENT_KEY, "left_semi"), "steps")
    level = stage(level.select(*KEY, "size", "inodes"), "level")
    levels, active = [level], level.count()
    while active:
        up = steps.join(sized(level), KEY).groupBy(*PARENT_KEY)
        up = up.agg(F.sum(F.col("size") * F.col("times")).alias("size"), F.sum(F.col("inodes") * F.col("times")).alias("inodes"))
        level = stage(up.withColumnRenamed("parent_inode", "inode"), "level")
        before, active = active, level.count()
        if active == before:
            raise ValueError(f"directory {tuple(level.select(*KEY).first())}, or one below it, is inside itself")
        levels.append(level)
    rows = reduce(DataFrame.unionByName, levels).join(dirs.select(*KEY, "copies"), KEY)
    return rows.select(*KEY, *[(F.col(n) * F.col("copies")).alias(n) for n in ("size", "inodes")])


def interval_totals(values: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows that add up, by (device, inode), to the sums of ``values`` within each interval.

    ``values`` is a staged table of rank, size, inodes; ``intervals`` has device, inode, rank,
    last. Beginnings and ends of intervals are put among the values, each reads the running
    sum at its place, and an interval's total is what its end reads less what its beginning
    reads. Sums run within ranges of ranks and are carried over by one row a range.
    """
    nobody = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    found = values.select(
        "rank", F.lit(1).alias("turn"), nobody.alias("device"), nobody.alias("inode"), "size", "inodes"
    )
    begins = intervals.select("rank", F.lit(0).alias("turn"), *KEY, zero.alias("size"), zero.alias("inodes"))
    ends = intervals.select(F.col("last").alias("rank"), F.lit(2).alias("turn"), *KEY, zero.alias("size"), zero.alias("inodes"))
    events = found.unionByName(begins).unionByName(ends).withColumn("range", rank_range())
    # ranges without values take the start of the next one before them from the events' own ranges
    marks = intervals.select(F.explode(F.array(rank_range("rank"), rank_range("last"))).alias("range")).distinct()
    known = values.select(rank_range().alias("range"), "size", "inodes").unionByName(
        marks.select("range", zero.alias("size"), zero.alias("inodes"))
    )
    starts = range_starts(known, start_size=F.col("size"), start_inodes=F.col("inodes"))
    running = Window.partitionBy("range").orderBy("rank", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = events.withColumns({name: F.sum(name).over(running) for name in ("size", "inodes")})
    read = summed.where(F.col("turn") != 1).join(F.broadcast(starts), "range")
    sign = F.col("turn") - 1
    return read.select(*KEY, *[(sign * (F.col(n) + F.col(f"start_{n}"))).alias(n) for n in ("size", "inodes")])


def all_directory_usage(
    entries: DataFrame,
    index: DirectoryIndex,
    entry_filter: EntryFilter = NO_FILTER,
    with_path: bool = True,
) -> DataFrame:
    """``device, inode, size, inodes[, path]`` of every directory's subtree, in one pass."""
    if index.single and entry_filter.is_empty:
        size = F.coalesce("size", F.lit(0).cast("long")) + F.col("all_bytes")
        columns = [*KEY, size.alias("size"), (F.col("all_entries") + 1).alias("inodes")]
        return index.table.select(*columns, *(["path"] if with_path else []))
    below = _totals_below(entries, index, entry_filter, index.table) if index.single else _totals_by_level(entries, index, entry_filter)
    own = entry_filter.apply(index.table).select(*KEY, "size", F.lit(1).cast("long").alias("inodes"))
    totals = below.unionByName(own).groupBy(*KEY).agg(_sum_or_zero("size"), _sum_or_zero("inodes"))
    if with_path:
        totals = totals.join(index.directories.select(*KEY, "path"), KEY)
    return totals


def du(
    entries: DataFrame,
    roots: Iterable | DataFrame,
    index: DirectoryIndex,
    entry_filter: EntryFilter = NO_FILTER,
) -> DataFrame:
    """One row ``size, inodes`` over all roots together; repeated roots count again."""
    roots = as_roots(entries.sparkSession, roots, index)
    if roots.located is None:
        rows = _usage_of_many(entries, roots, index, entry_filter)
    else:
        rows = _contributions(entries, roots, index, entry_filter)
    return rows.agg(_sum_or_zero("size"), _sum_or_zero("inodes"))


def usage_report(
    entries: DataFrame,
    paths: Iterable[str],
    index: DirectoryIndex,
    entry_filter: EntryFilter = NO_FILTER,
) -> DataFrame:
    """One ``line`` of text per path, as given: size, number of entries, path."""
    paths = list(paths)
    totals = usage_by_root(entries, roots_at(entries, index, paths), index, entry_filter)
    names = argument_table(entries.sparkSession, root_id=list(range(len(paths))), name=paths)
    named = join_lookup(totals, names, ["root_id"])
    return named.select(usage_line(F.col("size"), F.col("inodes"), F.col("name")).alias("line"))


def children_usage(
    entries: DataFrame,
    directories: Iterable | DataFrame,
    index: DirectoryIndex,
    entry_filter: EntryFilter = NO_FILTER,
) -> DataFrame:
    """Subtree totals of each immediate child of the given directories.

    The listing is not filtered, only the totals are; a child without matching rows reports
    zeros.
    """
    tops = as_roots(entries.sparkSession, directories)
    literal = tops.key_filter("device", "parent_inode")
    listing = entries if literal is None else entries.where(literal)
    keys = tops.table.select("device", F.col("inode").alias("parent_inode")).distinct()
    children = join_lookup(
        listing.where(F.col("parent_inode").isNotNull()).select(
            *PARENT_KEY, "inode", "basename", "mode"
        ),
        keys,
        PARENT_KEY,
        small=tops.small or None,
        hot=index.hot,
    )
    children = stage(children, "children")  # for its size
    # Entries without an inode have no totals; as NULL keys they would share one task.
    known = children.where(F.col("inode").isNotNull())
    totals = _totals_by_key(entries, index, entry_filter, known.select(*KEY).distinct())
    listed = join_lookup(known, totals, KEY, "left", small=False).unionByName(
        children.where(F.col("inode").isNull()), allowMissingColumns=True
    )
    return _zero_filled(
        listed,
        *PARENT_KEY,
        "inode",
        "basename",
        F.coalesce(is_directory("mode"), F.lit(False)).alias("is_directory"),
    )


def sorted_children(children: DataFrame, by: str = "size", descending: bool = True) -> DataFrame:
    """Order a listing by ``size`` or ``inodes``, unknown totals counting as the largest."""
    if by not in ("size", "inodes"):
        raise ValueError(f"by must be 'size' or 'inodes', not {by!r}")
    column = F.col(by)
    return children.orderBy(
        column.desc_nulls_first() if descending else column.asc_nulls_last(), "basename"
    )


def largest_directories(usage: DataFrame, count: int) -> DataFrame:
    """The ``count`` largest directories; ties are broken by path."""
    return usage.orderBy(F.desc("size"), "path").limit(count)
