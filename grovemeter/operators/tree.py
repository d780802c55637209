"""The directory tree of a snapshot: directory index, paths, parents and subtrees.

A directory is known by (device, inode); its entries point to it with
(device, parent_inode). Directories are the small side of a snapshot, so the tree is solved
once over directories only and kept as a staged table, the *directory index*:

* every directory learns its path and its whole chain of ancestors by pointer doubling: in
  each round a directory takes over the chain of the ancestor it points at, so a tree of
  depth d needs log2(d) rounds rather than d;
* directories are ranked in preorder, siblings by name, so a subtree is an interval of ranks;
  prefix sums over the ranks give every directory the totals of all that is below it;
* the index is sorted by rank, which is nearly the order of paths, so a subtree is a contiguous
  range of row groups;
* entries can be laid out by the rank of their directory, so that a search below some
  directories is a scan of ranges and joins nothing.

Where overlapping scans left a second row for some directory there are no ranks, and searches
climb the chains. All later operators are plain scans, joins and aggregates of these tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovemeter.functions.modes import is_directory
from grovemeter.operators import lookup
from grovemeter.operators.filters import NO_FILTER, EntryFilter, check_roots
from grovemeter.operators.lookup import (
    UNKNOWN,
    argument_table,
    find_hot_keys,
    is_small,
    join_lookup,
    limit_hot,
    partitions_for,
    sized,
)
from grovemeter.schemas import ENTRY_COLUMNS
from grovemeter.scratch import stage_packed as stage

KEY = ["device", "inode"]
PARENT_KEY = ["device", "parent_inode"]
RANK_COLUMNS = ["rank", "last", "all_entries", "all_bytes"]
# Root lists up to this length reach the scans as literal filters.
MAX_LITERAL_ROOTS = 64

ROOTS_SCHEMA = T.StructType(
    [
        T.StructField("root_id", T.LongType(), False),
        T.StructField("device", T.LongType(), False),
        T.StructField("inode", T.LongType(), False),
    ]
)


@dataclass(frozen=True)
class DirectoryIndex:
    """One row per row on the key of a directory of a snapshot.

    ``table`` has the entry columns and

    * ``path``, ``depth``, ``chain`` - names and inodes from the topmost known ancestor down
      to the directory itself; a missing ancestor makes the path partial;
    * ``entries``, ``bytes`` - number and total size of the rows directly inside;
    * ``copies`` - rows sharing this (device, inode), from overlapping scans or mounts;
    * ``tainted`` - whether the directory or one above it has copies, so that several ways
      may lead to it;
    * ``preferred`` - the row of each (device, inode) that paths are built from, and its
      exact repeats;
    * ``rank``, ``last`` - the directory's place in preorder, with gaps, and the last place
      below it; NULL unless ``single``;
    * ``all_entries``, ``all_bytes`` - number and total size of all rows below it, not of
      itself; NULL unless ``single``.

    ``single`` is true if no (device, inode) has a second row. ``laid_out``, if there, holds the
    entries inside known directories, sorted by ``dir_rank``, with ``dir_path``. ``hot`` lists the directories
    with so many entries that joins to them are split, keyed like entries; None if there are
    none.
    """

    table: DataFrame
    single: bool
    hot: DataFrame | None
    laid_out: DataFrame | None = None

    @property
    def directories(self) -> DataFrame:
        """One row per (device, inode)."""
        if self.single:
            return self.table
        return self.table.where("preferred").dropDuplicates(KEY)

    def as_parents(self, *columns: str) -> DataFrame:
        """``columns`` of each directory, keyed the way its entries point at it."""
        return self.directories.select(
            "device", F.col("inode").alias("parent_inode"), *columns
        )


def directory_rows(entries: DataFrame, by: str = "key") -> DataFrame:
    """The rows that can have entries below them, and all rows that share their keys.

    ``by="key"`` is exact whatever modes say: rows with a directory's mode or none, rows
    another row points at, and other rows on the same (device, inode), as a mount point has.
    To find them the keys of all rows are compared with the keys of directories, two numbers a
    row. ``by="mode"`` trusts the directory bit and reads nothing else.
    """
    known = entries.where(F.col("inode").isNotNull())
    marked = known.where(is_directory("mode") | F.col("mode").isNull())
    if by == "mode":
        return marked
    if by != "key":
        raise ValueError(f"by must be 'mode' or 'key', not {by!r}")
    pointed_at = entries.where(F.col("parent_inode").isNotNull()).select(
        "device", F.col("parent_inode").alias("inode")
    )
    keys = pointed_at.distinct().unionByName(marked.select(*KEY)).distinct()
    others = known.where(~is_directory("mode"))
    shared = stage(others.select(*KEY).join(keys, KEY, "left_semi").distinct(), "dir-shared")
    if shared.isEmpty():
        return marked
    return marked.unionByName(others.join(sized(shared), KEY, "left_semi"))


def build_directory_index(
    entries: DataFrame, by: str = "key", path: str | None = None
) -> DirectoryIndex:
    """Solve the directory tree of ``entries`` and stage it as a :class:`DirectoryIndex`.

    With ``path`` the index is kept there, for :func:`open_directory_index` in later
    applications. Trees may be of any depth; raises ``ValueError`` for a cycle.
    """
    rows = stage(directory_rows(entries, by).select(*ENTRY_COLUMNS), "dir-rows")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    nothing = {"entries": zero, "bytes": F.lit(None).cast("long"), "copies": zero, "subdirs": zero}

    def counted(key: str, **known: Column) -> list:
        return ["device", F.col(key).alias("inode"), *[value.alias(name) for name, value in (nothing | known).items()]]

    inside = entries.where(F.col("parent_inode").isNotNull()).select(counted("parent_inode", entries=one, bytes=F.col("size")))
    above = rows.where(F.col("parent_inode").isNotNull()).select(counted("parent_inode", subdirs=one))
    totals = (
        inside.unionByName(above)
        .unionByName(rows.select(counted("inode", copies=one)))
        .groupBy(*KEY)
        .agg(*[F.sum(name).alias(name) for name in nothing])
        .where(F.col("copies") > 0)
    )
    totals = stage(totals, "dir-counts")
    single = totals.where(F.col("copies") > 1).isEmpty()
    known = totals if single else totals.join(_preferred_rows(rows, totals), KEY, "left")
    rows = join_lookup(rows, known, KEY, hot=_hot(totals, "copies"), small=False)
    chosen = F.lit(True) if single else (F.col("copies") == 1) | (_row_hash() == F.col("best_hash"))
    rows = stage(rows.withColumn("preferred", chosen).drop("best_hash"), "dir-totals")

    # Only directories that others lie in have their chains solved; all rows take over their parent's.
    # Where one of them has no name its paths skip it by its place in the chain, so all are solved.
    nodes = rows.where("preferred")
    holding = nodes.where(F.col("subdirs") > 0)
    named = holding.where(F.col("basename").isNull()).isEmpty()
    inner = (holding if named else nodes).select(*KEY, "parent_inode", "basename", "copies")
    chains = _solve_chains(stage(inner if single else inner.dropDuplicates(KEY), "dir-inner"))
    solved = ["path", "sort_key", "chain", "tainted"]
    up = chains.select("device", F.col("inode").alias("parent_inode"), *[F.col(name).alias(f"up_{name}") for name in solved])
    loose = rows if named else rows.where(~F.col("preferred"))
    # Rows without a parent meet nothing, and as NULL keys would share one task.
    tops = loose.where(F.col("parent_inode").isNull())
    table = join_lookup(loose.where(F.col("parent_inode").isNotNull()), up, PARENT_KEY, "left", _hot_parents(totals))
    table = table.unionByName(tops, allowMissingColumns=True).select(
        *rows.columns,
        _joined_path("up_path", "basename").alias("path"),
        _joined_chain("up_sort_key", _sort_key()).alias("sort_key"),
        _joined_chain("up_chain", F.array("inode")).alias("chain"),
        ((F.col("copies") > 1) | F.coalesce("up_tainted", F.lit(False))).alias("tainted"),
    )
    if not named:
        own = join_lookup(nodes, chains.select(*KEY, *solved), KEY, hot=_hot(totals, "copies"), small=False)
        table = own.select(*table.columns).unionByName(table)
    columns = [
        *ENTRY_COLUMNS,
        "path",
        (F.size("chain") - 1).alias("depth"),
        "chain",
        "entries",
        "bytes",
        "copies",
        "tainted",
        "preferred",
        *RANK_COLUMNS,
    ]
    if single:
        table = _with_ranks(table, partitions_for(rows)).select(*columns)
    else:
        table = table.withColumns({name: F.lit(None).cast("long") for name in RANK_COLUMNS}).select(*columns)
        table = table.repartitionByRange("device", "path").sortWithinPartitions("device", "path")
    if path is None:
        return _index_of(stage(table, "directory-index"), single)
    table.write.option("compression", "zstd").parquet(path)
    return open_directory_index(entries.sparkSession, path)


def open_directory_index(spark: SparkSession, path: str) -> DirectoryIndex:
    """An index built earlier with ``path``."""
    table = spark.read.parquet(path)
    return _index_of(table, table.where(F.col("copies") > 1).isEmpty())


def _hot(counts: DataFrame, count: str) -> DataFrame | None:
    """The hot keys of a table that knows the row count of each key, staged; None if there are none."""
    hot = stage(limit_hot(counts, KEY, count), "hot")
    return None if hot.isEmpty() else hot


def _hot_parents(totals: DataFrame) -> DataFrame | None:
    """The directories with so many directories inside that joins of these to them are split."""
    hot = _hot(totals, "subdirs")
    return None if hot is None else hot.withColumnRenamed("inode", "parent_inode")


def _index_of(table: DataFrame, single: bool) -> DirectoryIndex:
    hot = limit_hot(table.where("preferred"), KEY, "entries")
    hot = stage(hot.withColumnRenamed("inode", "parent_inode"), "hot-directories")
    return DirectoryIndex(table, single, None if hot.isEmpty() else hot)


def rank_range(rank: str | Column = "rank") -> Column:
    """The number of the range of ranks a rank lies in; ranges follow one another."""
    return F.shiftrightunsigned(F.col(rank) if isinstance(rank, str) else rank, 33)


def range_starts(rows: DataFrame, **totals: Column) -> DataFrame:
    """For each ``range`` of ranks in ``rows``, the sums over all ranges before it.

    One row a range; there are as many as the ranking had partitions.
    """
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("range").agg(*[F.sum(value).alias(name) for name, value in totals.items()])
    return sums.select("range", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in totals])


def _with_ranks(dirs: DataFrame, ranges: int) -> DataFrame:
    """``dirs``, directories that have one row each, with RANK_COLUMNS, in the order of ranks.

    In preorder a directory is followed by all below it. The rows above the last of them that
    do not lead to its successor end there, so a row closes as many directories as its chain
    reaches beyond the successor's parent: each directory is closed once, however deep. One without
    directories inside is closed by its own row, so only the others are looked up.
    """
    order = ["device", "sort_key"]
    placed = dirs.repartitionByRange(ranges, *order)
    # numbered as sorted: by partition, then by row
    placed = placed.sortWithinPartitions(*order).drop("sort_key").withColumn("rank", F.monotonically_increasing_id())
    placed = stage(placed, "dir-ranks")
    narrow = placed.select(
        "device", "chain", "rank", rank_range().alias("range"), "entries", F.coalesce("bytes", F.lit(0)).alias("bytes"), "subdirs"
    )
    inside = Window.partitionBy("range").orderBy("rank")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct("device", F.size("chain").alias("size"))
    first = narrow.groupBy("range").agg(F.min_by(place, "rank").alias("opening"))
    following = first.select("range", F.lead("opening").over(Window.orderBy("range")).alias("opening"))
    starts = range_starts(narrow, start_entries=F.col("entries"), start_bytes=F.col("bytes"))
    open_still = F.when(F.col("next.device") == F.col("device"), F.col("next.size") - 1).otherwise(0)
    own = F.when(F.col("subdirs") > 0, 0).otherwise(1)
    summed = (
        narrow.withColumns(
            {
                "next": F.lead(place).over(inside),
                "sum_entries": F.sum("entries").over(running),
                "sum_bytes": F.sum("bytes").over(running),
            }
        )
        .join(F.broadcast(starts), "range")
        .join(F.broadcast(following), "range", "left")
        .withColumn("next", F.coalesce("next", "opening"))
        .select(
            "device",
            "chain",
            "rank",
            "entries",
            "bytes",
            "subdirs",
            (F.col("sum_entries") + F.col("start_entries")).alias("sum_entries"),
            (F.col("sum_bytes") + F.col("start_bytes")).alias("sum_bytes"),
            (open_still + 1).alias("from"),
            (F.size("chain") - open_still - own).alias("closes"),
        )
        .where((F.col("subdirs") > 0) | (F.col("closes") > 0))
    )
    summed = stage(summed, "dir-sums")
    ends = summed.select(
        "device",
        F.explode(F.slice("chain", F.col("from"), F.col("closes"))).alias("inode"),
        F.col("rank").alias("last"),
        F.col("sum_entries").alias("end_entries"),
        F.col("sum_bytes").alias("end_bytes"),
    )
    begins = summed.where(F.col("subdirs") > 0).select(
        "device",
        F.element_at("chain", -1).alias("inode"),
        "rank",
        (F.col("sum_entries") - F.col("entries")).alias("up_to"),
        (F.col("sum_bytes") - F.col("bytes")).alias("bytes_up_to"),
    )
    below = begins.join(ends, KEY).select(
        "rank",
        "last",
        (F.col("end_entries") - F.col("up_to")).alias("all_entries"),
        (F.col("end_bytes") - F.col("bytes_up_to")).alias("all_bytes"),
    )
    inner = placed.where(F.col("subdirs") > 0).join(below, "rank")
    # the ranges of ranks are known to be even, so nothing need be sampled again
    inner = inner.repartitionById(ranges, rank_range().cast("int")).sortWithinPartitions("rank")
    outer = placed.where(F.col("subdirs") == 0).withColumns(
        {"last": F.col("rank"), "all_entries": F.col("entries"), "all_bytes": F.coalesce("bytes", F.lit(0).cast("long"))}
    )
    return inner.unionByName(outer.sortWithinPartitions("rank"))


def lay_out_entries(entries: DataFrame, index: DirectoryIndex, path: str | None = None) -> DirectoryIndex:
    """``index`` with the entries inside its directories laid out by the directories' ranks.

    Each entry gets ``dir_rank`` and ``dir_path`` of its directory; a directory with very many
    entries spreads over several files by their names. Entries whose parent is not in the
    snapshot lie below nothing and are left out. With ``path`` the layout is kept there. An index
    without ranks is returned as it is.
    """
    if not index.single:
        return index
    above = index.as_parents(F.col("rank").alias("dir_rank"), F.col("path").alias("dir_path"))
    inside = entries.where(F.col("parent_inode").isNotNull())
    laid = join_lookup(inside.select(*ENTRY_COLUMNS), above, PARENT_KEY, hot=index.hot)
    order = ["dir_rank", "basename"]
    laid = laid.repartitionByRange(*order).sortWithinPartitions(*order)
    if path is None:
        return replace(index, laid_out=stage(laid, "laid-out"))
    laid.write.option("compression", "zstd").parquet(path)
    return open_layout(index, path)


def open_layout(index: DirectoryIndex, path: str) -> DirectoryIndex:
    """``index`` with a layout written earlier with ``path``."""
    return replace(index, laid_out=index.table.sparkSession.read.parquet(path))


def _joined_path(above, below):
    above, below = F.col(above), F.col(below) if isinstance(below, str) else below
    return F.coalesce(F.concat(above, F.lit("/"), below), below)


def _joined_chain(above, below):
    return F.coalesce(F.concat(F.col(above), below), below)


def _row_hash() -> Column:
    return F.xxhash64(*ENTRY_COLUMNS)


def _preferred_rows(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """``best_hash`` of the row to prefer for each (device, inode): one whose parent exists, then a scan root.

    The choice is a minimum, so a directory with very many rows is reduced before the shuffle. Few
    keys with twins are sought out first.
    """
    twins = totals.where(F.col("copies") > 1).select(*KEY)
    if is_small(twins):
        rows = rows.join(F.broadcast(twins), KEY, "left_semi")
    parents = totals.select("device", F.col("inode").alias("parent_inode"), F.lit(True).alias("known"))
    rows = rows.select(*KEY, "parent_inode", "basename", _row_hash().alias("row_hash"))
    # Rows without a parent meet nothing, and as NULL keys would share one task.
    inside = join_lookup(rows.where(F.col("parent_inode").isNotNull()), parents, PARENT_KEY, "left", _hot_parents(totals))
    known = inside.unionByName(rows.where(F.col("parent_inode").isNull()), allowMissingColumns=True)
    rank = F.struct(
        F.coalesce(~F.col("known"), F.lit(True)).alias("orphan"),
        F.col("parent_inode").isNotNull().alias("inner"),
        F.coalesce("parent_inode", F.lit(0)).alias("parent_inode"),
        F.col("basename"),
        F.col("row_hash"),
    )
    best = known.groupBy(*KEY).agg(F.min(rank).alias("best"))
    return best.select(*KEY, F.col("best.row_hash").alias("best_hash"))


def _solve_chains(nodes: DataFrame) -> DataFrame:
    """(device, inode, path, sort_key, chain, tainted) of each of ``nodes``, by pointer doubling.

    ``up`` is the inode of the next ancestor not yet in ``chain``; NULL means the chain is
    complete. Completed rows are set aside and only serve as targets from then on. A directory
    that meets its own inode in a chain it takes over is on a cycle; as the chains of a round
    are twice those of the round before, a cycle shows as soon as chains are as long as it.
    """
    active = nodes.select(
        *KEY,
        F.col("parent_inode").alias("up"),
        F.col("basename").alias("path"),
        _sort_key().alias("sort_key"),
        F.array("inode").alias("chain"),
        (F.col("copies") > 1).alias("tainted"),
    )
    done = [active.where(F.col("up").isNull())]
    active = active.where(F.col("up").isNotNull())
    small = is_small(nodes)
    while (remaining := active.count()) > 0:
        targets = reduce(DataFrame.unionByName, done, active).select(
            "device",
            F.col("inode").alias("up"),
            F.col("up").alias("next_up"),
            F.col("path").alias("up_path"),
            F.col("sort_key").alias("up_key"),
            F.col("chain").alias("up_chain"),
            F.col("tainted").alias("up_tainted"),
        )
        hot = None if remaining <= lookup.ROWS_PER_PIECE else UNKNOWN
        solved = join_lookup(active, targets, ["device", "up"], "left", hot, small).select(
            *KEY,
            F.col("next_up").alias("up"),
            _joined_path("up_path", "path").alias("path"),
            _joined_chain("up_key", F.col("sort_key")).alias("sort_key"),
            _joined_chain("up_chain", F.col("chain")).alias("chain"),
            (F.col("tainted") | F.coalesce("up_tainted", F.lit(False))).alias("tainted"),
            F.coalesce(F.array_contains("up_chain", F.col("inode")), F.lit(False)).alias("loop"),
        )
        solved = stage(solved, "chains")
        if (loop := solved.where("loop").select(*KEY).first()) is not None:
            raise ValueError(f"directory {tuple(loop)} is inside itself")
        solved = solved.drop("loop")
        done.append(solved.where(F.col("up").isNull()))
        active = solved.where(F.col("up").isNotNull())
    return reduce(DataFrame.unionByName, done).drop("up")


def _sort_key() -> Column:
    """A directory's name and inode as text that no other such text begins with.

    One after another along a chain they sort in preorder, siblings by name: whatever begins
    with a directory's is below it. Negative inodes are but numbers that sort last.
    """
    # "\0" is the end mark, that no file system allows in names; what has no name sorts first
    name = F.translate(F.coalesce("basename", F.lit("")), "\0", "\1")
    return F.concat(name, F.lit("\0"), F.lpad(F.hex("inode"), 16, "0"))


# --- roots -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Roots:
    """Start points of a search: (root_id, device, inode), repeats kept.

    ``pairs`` holds them on the driver when they came as an argument list; ``located`` then
    holds (device, inode, path, rank, last) of those that are directories, if the list is short.
    """

    table: DataFrame
    small: bool
    pairs: tuple[tuple[int, int], ...] | None = None
    located: tuple[tuple[int, int, str, int | None, int | None], ...] | None = None

    @property
    def all_directories(self) -> bool:
        """True if every root is known to be a directory of the index."""
        if self.located is None:
            return False
        return set(self.pairs) <= {found[:2] for found in self.located}

    def key_filter(self, device: str = "device", inode: str = "inode"):
        """A filter any row on one of the roots passes, or None if the list is long."""
        if self.pairs is None or len(self.pairs) > MAX_LITERAL_ROOTS:
            return None
        inodes: dict[int, set[int]] = {}
        for d, i in self.pairs:
            inodes.setdefault(d, set()).add(i)
        return reduce(
            lambda a, b: a | b,
            ((F.col(device) == d) & F.col(inode).isin(sorted(s)) for d, s in inodes.items()),
        )

    @property
    def ranges(self) -> list[tuple[int, int, int]]:
        """(root_id, rank, last) of each root that is a directory; repeats and overlaps stay.

        Only for located roots of an index with ranks.
        """
        places = {found[:2]: found[3:] for found in self.located}
        return [(number, *places[pair]) for number, pair in enumerate(self.pairs) if pair in places]

    def below(self, rank: str) -> Column:
        """A filter on ranks that the subtrees of the roots pass: a few ranges, for a scan."""
        merged: list[list[int]] = []
        for _, low, last in sorted(self.ranges, key=lambda r: r[1:]):
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], last)  # subtrees nest or are apart
            else:
                merged.append([low, last])
        return reduce(lambda a, b: a | b, (F.col(rank).between(*ends) for ends in merged), F.lit(False))

    def holding(self, rank: str) -> Column:
        """The numbers of the roots whose subtree a rank lies in, as an array."""
        if not self.ranges:
            return F.array().cast("array<bigint>")
        ranges = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(("root_id", "low", "high"), r)]) for r in self.ranges])
        held = F.filter(ranges, lambda r: F.col(rank).between(r["low"], r["high"]))
        return F.transform(held, lambda r: r["root_id"])


def as_roots(spark: SparkSession, roots: Iterable | DataFrame, index: DirectoryIndex | None = None) -> Roots:
    """``roots`` is a list of (device, inode) pairs or a DataFrame with those columns.

    List entries are numbered in order; a DataFrame must bring its own ``root_id``.
    """
    if isinstance(roots, Roots):
        return roots
    if isinstance(roots, DataFrame):
        table = roots.select(*ROOTS_SCHEMA.fieldNames())
        return Roots(table, is_small(table))
    pairs = tuple(check_roots(roots))
    if len(pairs) > MAX_LITERAL_ROOTS:
        devices, inodes = zip(*pairs)
        table = argument_table(spark, root_id=list(range(len(pairs))), device=list(devices), inode=list(inodes))
        return Roots(table, is_small(table), pairs)
    values = ", ".join(f"({n}L, {d}L, {i}L)" for n, (d, i) in enumerate(pairs))
    table = spark.sql(f"SELECT * FROM VALUES {values} AS roots(root_id, device, inode)")
    found = Roots(table, True, pairs)
    if index is None:
        return found
    rows = index.table.where(found.key_filter()).select(*KEY, "path", "rank", "last").distinct()
    located = rows.take(MAX_LITERAL_ROOTS + 1)
    if len(located) > MAX_LITERAL_ROOTS:
        return found
    return replace(found, located=tuple(tuple(row) for row in located))


def _plain_path(path: Column) -> Column:
    """A path without repeated and trailing separators."""
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), "(?<=.)/$", "")


def roots_at(
    entries: DataFrame, index: DirectoryIndex, paths: str | Iterable[str]
) -> list[tuple[int, int]]:
    """(device, inode) of the entries at the given paths, in order.

    Separators may be repeated or trail, in arguments and in recorded scan roots. Where a path
    has several rows, a scan root there (a mount seen from inside) comes before a directory,
    and that before other entries. Raises ``LookupError`` for a path the snapshot does not
    hold, or that still names several entries.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    names = [re.sub("(?<=.)/$", "", re.sub("/+", "/", p)) for p in paths]
    wanted = sorted(set(names))
    spark = entries.sparkSession
    asked = argument_table(spark, path=wanted)
    kind = F.when(F.col("parent_inode").isNull(), 0).when(F.coalesce(is_directory("mode"), F.lit(True)), 1).otherwise(2)

    # Recorded paths are as asked for, unless a scan root was recorded with a separator too many.
    listed = index.table.select("path", *KEY, kind.alias("kind"))
    rough = index.table.where(F.col("parent_inode").isNull() & F.col("path").rlike("//|/$"))
    if not rough.isEmpty():
        listed = listed.withColumn("path", _plain_path(F.col("path")))
    elif len(wanted) <= MAX_LITERAL_ROOTS:
        listed = listed.where(F.col("path").isin(wanted))  # reaches the scan of the sorted index
    found = _best_at(listed.join(sized(asked), "path"))

    rest = [name for name in wanted if name not in found]
    if rest:
        places = [(name, *name.rpartition("/")[::2]) for name in rest]
        asked = argument_table(
            spark, path=rest, folder=[folder or "/" for _, folder, _ in places], basename=[base for _, _, base in places]
        )
        folders = index.as_parents(_plain_path(F.col("path")).alias("folder"))
        inside = stage(folders.join(sized(asked), "folder"), "folders")
        files = entries.where(F.col("inode").isNotNull())
        if len(rest) <= MAX_LITERAL_ROOTS:
            files = files.where(F.col("basename").isin([name for _, _, name in places]))
        files = files.select(*PARENT_KEY, "basename", "inode", F.lit(2).alias("kind"))
        found |= _best_at(join_lookup(files, inside, [*PARENT_KEY, "basename"]))
    missing = [p for p, name in zip(paths, names) if name not in found]
    if missing:
        raise LookupError(f"not in the snapshot: {missing}")
    return [found[name] for name in names]


def _best_at(rows: DataFrame) -> dict[str, tuple[int, int]]:
    """The key at each path from (path, device, inode, kind): the one key of the least kind."""
    kinds = rows.groupBy("path", "kind").agg(
        F.min(F.struct(*KEY)).alias("low"), F.max(F.struct(*KEY)).alias("high")
    )
    best = {}
    for r in kinds.groupBy("path").agg(F.min(F.struct("kind", "low", "high")).alias("best")).collect():
        low, high = tuple(r["best"]["low"]), tuple(r["best"]["high"])
        if low != high:
            raise LookupError(f"{r['path']} names several entries, among them {low} and {high}")
        best[r["path"]] = low
    return best


def select_roots(entries: DataFrame, roots: Iterable | DataFrame) -> DataFrame:
    """The rows each root names, once per repeat, with its ``root_id``.

    A long root table shuffles on its key. A key may hold very many rows (hard links), so
    that join is split by hot key as well.
    """
    roots = as_roots(entries.sparkSession, roots)
    literal = roots.key_filter()
    if literal is not None:
        entries = entries.where(literal)
    return join_lookup(
        entries.where(F.col("inode").isNotNull()), roots.table, KEY, small=roots.small
    )


# --- lookups ---------------------------------------------------------------------------


def with_path(entries: DataFrame, index: DirectoryIndex) -> DataFrame:
    """Add ``path``: names from the topmost known ancestor down, joined with ``/``."""
    above = index.as_parents(F.col("path").alias("up_path"))
    if is_small(entries):
        # A few entries need a few paths: cut the index down without shuffling it.
        wanted = entries.select(*PARENT_KEY).distinct()
        above = above.join(F.broadcast(wanted), PARENT_KEY, "left_semi")
    return (
        join_lookup(entries, above, PARENT_KEY, "left", hot=index.hot)
        .withColumn("path", _joined_path("up_path", "basename"))
        .drop("up_path")
    )


def with_parent(entries: DataFrame, index: DirectoryIndex) -> DataFrame:
    """Left join each entry to the row(s) of its parent directory, columns ``parent_*``."""
    parents = index.table.select(
        "device",
        F.col("inode").alias("parent_inode"),
        *[F.col(c).alias(f"parent_{c}") for c in ("basename", "mode", "uid", "gid", "size")],
    )
    return join_lookup(entries, parents, PARENT_KEY, "left", hot=index.hot)


def scan_roots(entries: DataFrame, index: DirectoryIndex) -> DataFrame:
    """Directory rows that some entry names as its scan root."""
    named = stage(
        entries.where(F.col("root_inode").isNotNull())
        .select("device", F.col("root_inode").alias("inode"))
        .distinct(),
        "root-keys",
    )
    return index.table.join(sized(named), KEY, "left_semi")


def with_root(entries: DataFrame, index: DirectoryIndex) -> DataFrame:
    """Left join each entry to the row(s) of its scan root, columns ``root_*``."""
    roots = stage(
        scan_roots(entries, index).select(
            "device",
            F.col("inode").alias("root_inode"),
            *[F.col(c).alias(f"root_{c}") for c in ("basename", "uid", "gid")],
        ),
        "scan-roots",
    )
    return join_lookup(entries, roots, ["device", "root_inode"], "left")


def path_by_aggregation(index: DirectoryIndex) -> DataFrame:
    """Each directory's path rebuilt by ordered string aggregation over its ancestors.

    A group is one directory's chain, so it holds as many names as the directory is deep.
    """
    steps = index.directories.select(*KEY, F.posexplode("chain").alias("step", "ancestor"))
    names = index.directories.select(
        "device", F.col("inode").alias("ancestor"), F.col("basename").alias("name")
    )
    named = join_lookup(steps, names, ["device", "ancestor"])
    return named.groupBy(*KEY).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("step", "name"))), lambda s: s["name"]
            ),
            "/",
        ).alias("path")
    )


def duplicate_directories(entries: DataFrame) -> DataFrame:
    """Data-quality check: (device, inode) with more than one directory row."""
    return (
        directory_rows(entries, by="mode")
        .groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


# --- subtrees --------------------------------------------------------------------------


def subtree_directories(index: DirectoryIndex, roots: Roots, with_path: bool = True) -> DataFrame:
    """The directories at or below each root.

    Columns ``root_id, device, inode[, path], entries, bytes, times``; ``times`` is how often
    the search passes through the directory, more than one only where overlapping scans left
    several rows for a directory on the way. Repeated and overlapping roots each count.
    """
    columns = [*(["path"] if with_path else []), "entries", "bytes"]
    dirs = index.table
    if index.single and roots.located is not None:
        inside = dirs.where(roots.below("rank"))
        return inside.select(F.explode(roots.holding("rank")).alias("root_id"), *KEY, *columns, F.lit(1).cast("long").alias("times"))
    spread = dirs.where(~F.col("tainted")).select(*KEY, *columns, F.explode("chain").alias("ancestor"))
    tops = roots.table.withColumnRenamed("inode", "ancestor")
    hit = join_lookup(spread, tops, ["device", "ancestor"], small=roots.small)
    clean = hit.select("root_id", *KEY, *columns, F.lit(1).cast("long").alias("times"))
    if index.single:
        return clean
    return clean.unionByName(_walk(index, roots, clean, columns))


def _walk(index: DirectoryIndex, roots: Roots, clean: DataFrame, columns: list[str]) -> DataFrame:
    """Level-by-level descent through the tainted directories only.

    It begins at tainted roots, and at the rows of tainted directories whose parent a search
    reaches through clean ones, which it does once. Equal arrivals at a level are merged into
    one row with their number, so copies multiply ``times`` instead of the rows. ``way`` holds
    the inodes passed since the start and shows a cycle.
    """
    tainted = index.table.where("tainted")
    named = F.col("basename") if "path" in columns else None
    group = ["root_id", *KEY, *columns, "way"]
    one = F.lit(1).cast("long").alias("times")
    way = F.array("inode").alias("way")
    at_roots = join_lookup(tainted, roots.table, KEY, small=roots.small).select("root_id", *KEY, *columns, way, one)
    doors = tainted.where(F.col("parent_inode").isNotNull()).select(*PARENT_KEY, F.col("inode").alias("child"), "basename", "entries", "bytes")
    reached = clean.select(
        "root_id", "device", F.col("inode").alias("parent_inode"), *([F.col("path").alias("up_path")] if "path" in columns else [])
    )
    below = [F.concat("up_path", F.lit("/"), named).alias("path")] if named is not None else []
    entered = join_lookup(reached, doors, PARENT_KEY).select(
        "root_id", "device", F.col("child").alias("inode"), *below, "entries", "bytes", F.array("child").alias("way"), one
    )
    start = at_roots.unionByName(entered)
    level = stage(start.groupBy(*group).agg(F.sum("times").alias("times")), "walk")
    hot_doors = find_hot_keys(doors, PARENT_KEY)
    levels = [level]
    while not level.isEmpty():
        frontier = level.select(
            "root_id",
            "device",
            F.col("inode").alias("parent_inode"),
            *([F.col("path").alias("up_path")] if "path" in columns else []),
            F.col("way").alias("up_way"),
            "times",
        )
        arrived = join_lookup(doors, frontier, PARENT_KEY, hot=hot_doors).select(
            "root_id",
            "device",
            F.col("child").alias("inode"),
            *below,
            "entries",
            "bytes",
            F.concat("up_way", F.array("child")).alias("way"),
            F.array_contains("up_way", F.col("child")).alias("loop"),
            "times",
        )
        level = stage(arrived.groupBy(*group, "loop").agg(F.sum("times").alias("times")), "walk")
        if (loop := level.where("loop").select(*KEY).first()) is not None:
            raise ValueError(f"directory {tuple(loop)} is inside itself")
        level = level.drop("loop")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).drop("way")


def descendants(
    entries: DataFrame,
    roots: Iterable | DataFrame,
    index: DirectoryIndex,
    entry_filter: EntryFilter = NO_FILTER,
) -> DataFrame:
    """The roots and everything below them, with ``root_id`` and ``path``.

    A filter decides which rows come out, never where the search goes, so it is applied to
    the entries before any join and can reach the scan. Rows reached by several roots, or
    through several rows of one directory, come out that many times.
    """
    roots = as_roots(entries.sparkSession, roots, index)
    wanted = entry_filter.apply(entries)
    if roots.all_directories:
        # The index has the rows of all directories, so the entries need not be searched.
        tops = select_roots(entry_filter.apply(index.table), roots)
    else:
        tops = with_path(stage(select_roots(wanted, roots), "tops"), index)
    columns = ["root_id", *ENTRY_COLUMNS, "path"]
    if index.laid_out is not None and roots.located is not None:
        inner = entry_filter.apply(index.laid_out.where(roots.below("dir_rank"))).withColumns(
            {
                "root_id": F.explode(roots.holding("dir_rank")),
                "path": F.concat("dir_path", F.lit("/"), F.col("basename")),
            }
        )
        return tops.select(*columns).unionByName(inner.select(*columns))
    below = subtree_directories(index, roots).select(
        "root_id",
        "device",
        F.col("inode").alias("parent_inode"),
        F.col("path").alias("up_path"),
        "times",
    )
    inner = join_lookup(
        wanted.where(F.col("parent_inode").isNotNull()),
        below,
        PARENT_KEY,
        hot=index.hot,
    ).withColumn("path", F.concat("up_path", F.lit("/"), F.col("basename")))
    if not index.single:
        inner = inner.withColumn(
            "nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
        )
    return tops.select(*columns).unionByName(inner.select(*columns))


def find(
    entries: DataFrame,
    roots: Iterable | DataFrame,
    index: DirectoryIndex,
    entry_filter: EntryFilter = NO_FILTER,
) -> DataFrame:
    """Paths of the entries at or below ``roots`` that pass the filter."""
    return descendants(entries, roots, index, entry_filter).select("path")
