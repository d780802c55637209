"""Snapshot entries from a flat list of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemeter.functions.modes import DIRECTORY
from grovemeter.schemas import ENTRY_COLUMNS, ENTRY_SCHEMA

# File type bits of a plain file.
PLAIN_FILE = 0o100000


def entries_from_listing(listing: DataFrame, root: Column, names: Column) -> DataFrame:
    """Entries for every listed path and every directory above it, with ``path`` and
    ``parent_path``.

    ``root`` is the name of the tree a path belongs to and ``names`` the array of names below
    it. Ids are hashes of the path, so parent and root ids need no join; the device is a
    hash of the root, so ids need to differ only within one tree. Run
    ``duplicate_directories`` on the result where 64 bits may not be enough.

    Siblings collapse to their directory before prefixes are spread out, so the spread grows
    with the directories rather than with the listed paths.
    """
    listed = listing.select(root.alias("root"), names.alias("names"))
    above = (
        listed.where(F.size("names") > 0)
        .select("root", F.slice("names", F.lit(1), F.size("names") - 1).alias("names"))
        .distinct()
    )
    directories = above.select(
        "root",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size("names")),
                lambda n: F.slice("names", F.lit(1), n),
            )
        ).alias("names"),
        F.lit(True).alias("is_directory"),
    )
    leaves = listed.select("root", "names", F.lit(False).alias("is_directory"))
    nodes = (
        directories.unionByName(leaves)
        .groupBy("root", "names")
        .agg(F.max("is_directory").alias("is_directory"))
    )
    is_root = F.size("names") == 0
    path = F.array_join(F.concat(F.array("root"), "names"), "/")
    parent = F.array_join(
        F.concat(F.array("root"), F.slice("names", F.lit(1), F.size("names") - 1)), "/"
    )
    nodes = nodes.select(
        "root",
        "is_directory",
        F.when(is_root, F.col("root")).otherwise(F.try_element_at("names", F.lit(-1))).alias("basename"),
        path.alias("path"),
        F.when(~is_root, parent).alias("parent_path"),
    )
    known = {
        "basename": F.col("basename"),
        "inode": F.xxhash64("path"),
        "device": F.xxhash64("root"),
        "mode": F.when(F.col("is_directory"), F.lit(DIRECTORY)).otherwise(F.lit(PLAIN_FILE)),
        "root_inode": F.xxhash64("root"),
        "parent_inode": F.when(F.col("parent_path").isNotNull(), F.xxhash64("parent_path")),
    }
    columns = [
        known.get(name, F.lit(None)).cast(ENTRY_SCHEMA[name].dataType).alias(name)
        for name in ENTRY_COLUMNS
    ]
    return nodes.select(*columns, "path", "parent_path")


def url_root(url: Column) -> Column:
    """Host of a URL."""
    return F.split(_bare_url(url), "/")[0]


def url_names(url: Column) -> Column:
    """Path names of a URL, without a trailing empty one."""
    parts = F.split(F.regexp_replace(_bare_url(url), "/$", ""), "/")
    return F.slice(parts, F.lit(2), F.size(parts))


def _bare_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "^[a-z]+://", ""), "[?#].*$", "")
