"""Directories holding entries that could not be read, and what to tell their owners."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovemeter.operators import filters
from grovemeter.operators.lookup import is_small, join_lookup
from grovemeter.operators.tree import (
    PARENT_KEY,
    DirectoryIndex,
    scan_roots,
)
from grovemeter.scratch import stage

# Up to four paths are listed in the message itself, and paths below a
# directory named tmp are not reported.
INLINE_PATHS = 4
EXCLUDED_PATHS = "%/tmp/%"


def unreadable_directories(entries: DataFrame, index: DirectoryIndex) -> DataFrame:
    """``uid, gid, root_gid, path`` of directories with unreadable entries.

    Owner and group are the directory's own. Unreadable entries collapse to one row per
    directory before any join. Two directories may give equal rows only through equal
    partial paths, and are kept apart.
    """
    spots = stage(
        filters.unreadable(entries)
        .where(F.col("parent_inode").isNotNull() & F.col("root_inode").isNotNull())
        .select("device", "parent_inode", "root_inode")
        .distinct(),
        "unreadable",
    )
    owners = index.table.select(
        "device",
        F.col("inode").alias("parent_inode"),
        "uid",
        "gid",
        "basename",
        F.col("parent_inode").alias("above"),
        "path",
        "preferred",
    )
    if is_small(spots):
        # Few spots: keep only their directories, without shuffling the index.
        keys = F.broadcast(spots.select(*PARENT_KEY).distinct())
        owners = owners.join(keys, PARENT_KEY, "left_semi")
    roots = stage(
        scan_roots(spots, index).select(
            "device", F.col("inode").alias("root_inode"), F.col("gid").alias("root_gid")
        ),
        "unreadable-roots",
    )
    found = join_lookup(
        join_lookup(spots, owners, PARENT_KEY), roots, ["device", "root_inode"]
    )
    return (
        found.select("uid", "gid", "root_gid", "basename", "device", "above", "path")
        .distinct()
        .where(~F.col("path").like(EXCLUDED_PATHS))
        .select("uid", "gid", "root_gid", "path")
    )


def counts_by_user(unreadable: DataFrame) -> DataFrame:
    """``uid, count``; rows without a user are left out."""
    return (
        unreadable.where(F.col("uid").isNotNull())
        .groupBy("uid")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def unreadable_by_user(unreadable: DataFrame) -> DataFrame:
    """Each user's paths, one row per path, with the user's ``count``.

    Kept in rows: an array per user would put all paths of one user in one task.
    """
    known = unreadable.where(F.col("uid").isNotNull()).select("uid", "path")
    return join_lookup(known, stage(counts_by_user(unreadable), "counts"), ["uid"])


def with_user_names(df: DataFrame, users: DataFrame) -> DataFrame:
    """Add ``username`` and ``fullname``; an unknown user goes by its number."""
    names = users.select("uid", F.col("user").alias("username"), "fullname")
    number = F.col("uid").cast("string")
    return (
        join_lookup(df, names, ["uid"], "left")
        .withColumn("fullname", F.coalesce("fullname", "username", number))
        .withColumn("username", F.coalesce("username", number))
    )


def user_path_lists(unreadable: DataFrame, users: DataFrame) -> DataFrame:
    """``username, path``: the lines of each user's path file."""
    known = unreadable.where(F.col("uid").isNotNull()).select("uid", "path")
    return with_user_names(known, users).select("username", "path")


@dataclass(frozen=True)
class NoticeText:
    """What differs between sites in a notice."""

    site: str = "the storage service"
    mail_domain: str = "example.org"
    contact: str = "storage-help@example.org"
    list_folder: str = "/data/unreadable"


def unreadable_notices(
    unreadable: DataFrame, users: DataFrame, text: NoticeText = NoticeText()
) -> DataFrame:
    """``to, subject, message``: one notice per user with unreadable directories.

    Only the first few paths of a user are gathered; users with more are pointed to their
    path file.
    """
    known = unreadable.where(F.col("uid").isNotNull()).select("uid", "path")
    # The row_number limit is applied before the shuffle as well as after it.
    first = Window.partitionBy("uid").orderBy("path")
    inline = (
        known.withColumn("nth", F.row_number().over(first))
        .where(F.col("nth") <= INLINE_PATHS)
        .groupBy("uid")
        .agg(F.sort_array(F.collect_list("path")).alias("paths"))
    )
    people = with_user_names(counts_by_user(unreadable).join(inline, "uid"), users)
    list_file = F.format_string("%s/%s.txt", F.lit(text.list_folder), F.col("username"))
    noun = F.when(F.col("count") > 1, F.lit("directories")).otherwise(F.lit("directory"))
    # The two commands.
    commands = F.array_join(
        F.transform("paths", lambda p: F.format_string('    chmod -R g+rX "%s"', p)), "\n"
    )
    advice = F.when(
        F.col("count") <= INLINE_PATHS,
        F.concat(F.lit("If nothing below needs to stay private, please run:\n"), commands),
    ).otherwise(
        F.format_string(
            "They are listed in %s. If none needs to stay private, please run:\n"
            "    xargs chmod -R g+rX < %s",
            list_file,
            list_file,
        )
    )
    message = F.concat(
        F.format_string("Hello %s,\n\n", F.col("fullname")),
        F.format_string(
            "%d %s of yours on %s cannot be read by the usage scan.\n\n",
            F.col("count"),
            noun,
            F.lit(text.site),
        ),
        advice,
        F.format_string("\n\nQuestions: %s\n", F.lit(text.contact)),
    )
    return people.select(
        F.format_string("%s <%s@%s>", "fullname", "username", F.lit(text.mail_domain)).alias("to"),
        F.format_string("Storage use on %s for %s", F.lit(text.site), F.col("username")).alias(
            "subject"
        ),
        message.alias("message"),
    )
