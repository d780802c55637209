"""Snapshot tables: full refresh that readers see all at once, and appended summaries.

Every attempt to load a snapshot writes to a folder of its own and then commits: it creates
the snapshot's commit file, which names the folder, and which the file system lets only one
attempt create. Readers follow the commit files, so a load that fails half-way is never seen
and can be run again, and of several loads of one name exactly one counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from datetime import datetime, timezone
from pathlib import Path
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovemeter.operators.lookup import estimated_bytes
from grovemeter.schemas import ENTRY_COLUMNS, ENTRY_SCHEMA

# Bytes on disk that one file of a laid-out table takes; the bound is what one driver can list.
LAYOUT_BYTES = 128 * 1024**2
MAX_LAYOUT_FILES = 1_000_000

COMMIT_SCHEMA = "snapshot string, committed timestamp, folder string"


def _commits(spark: SparkSession, base: str) -> DataFrame:
    try:
        return spark.read.schema(COMMIT_SCHEMA).json(f"{base}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.sql("SELECT '' AS snapshot, current_timestamp() AS committed, '' AS folder LIMIT 0")


def _put_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file, or find that another has: exclusive wherever the file system's create is."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getScheme() == "file":
        # Hadoop looks first and creates then; the operating system does both at once.
        local = Path(place.toUri().getPath())
        local.parent.mkdir(parents=True, exist_ok=True)
        try:
            with local.open("x", encoding="utf-8") as file:
                file.write(content)
        except FileExistsError:
            return False
        return True
    try:
        out = files.create(place, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    return True


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def layout_files(df: DataFrame) -> int:
    """Files for a range layout of a staged table: one for each LAYOUT_BYTES."""
    return max(1, min(MAX_LAYOUT_FILES, -(-estimated_bytes(df) // LAYOUT_BYTES)))


@contextmanager
def _files_apart(spark: SparkSession) -> Iterator[None]:
    """Have each file, or split of a large one, read by a task of its own."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_ranges(entries: DataFrame) -> bool:
    """True if no two tasks that read ``entries`` hold overlapping ranges of directories.

    A directory may reach from one task into others. One scan of two columns; what is shuffled and
    compared is a row for each task and device.
    """
    parent = F.coalesce("parent_inode", F.lit(-(2**63)))
    places = entries.select(F.spark_partition_id().alias("task"), "device", parent.alias("parent"))
    places = places.groupBy("task", "device").agg(F.min("parent").alias("low"), F.max("parent").alias("high"))
    ranges = places.groupBy("task").agg(
        F.min(F.struct("device", "low")).alias("first"), F.max(F.struct("device", "high")).alias("last")
    )
    before = F.lag("last").over(Window.orderBy("first", "last"))
    return ranges.select((F.col("first") < before).alias("overlaps")).where("overlaps").isEmpty()


def publish_snapshot(
    entries: DataFrame, base: str, snapshot: str, files: int | None = None, from_files: bool = False
) -> None:
    """Write ``entries`` as ``snapshot`` and make it the current one.

    Rows are laid out by parent directory and name. The name is part of the range key, so
    even a directory holding a third of all rows is spread over many files, and a search for
    a directory's entries skips most row groups. ``files`` is their number, by default that of
    the shuffle partitions; ``layout_files`` works it out for a staged table.

    ``from_files`` says that ``entries`` are read from files without a shuffle, as those of another
    snapshot are. Their ranges are then looked at first, and where the files (splits of large ones)
    hold ranges of directories already, each is sorted and written without shuffling its rows.

    Raises ``ValueError`` if a snapshot of that name is committed, by then or meanwhile; what
    this load wrote is then deleted. A commit file without content is of a load that died while
    it committed: it is never read, and must be deleted before the name can be used.
    """
    spark = entries.sparkSession
    taken = ValueError(f"snapshot {snapshot!r} is already published")
    if not _commits(spark, base).where(F.col("snapshot") == snapshot).isEmpty():
        raise taken
    name = quote(snapshot, safe="")
    folder = f"data/snapshot={name}/attempt-{uuid.uuid4().hex}"
    rows, place = entries.select(*ENTRY_COLUMNS), ["device", "parent_inode", "basename"]
    with _files_apart(spark) if from_files else nullcontext():
        if not (from_files and in_ranges(rows)):
            rows = rows.repartitionByRange(*([files] if files else []), *place)
        rows.sortWithinPartitions(*place).write.option("compression", "zstd").parquet(f"{base}/{folder}")
    commit = {"snapshot": snapshot, "committed": datetime.now(timezone.utc).isoformat(), "folder": folder}
    if not _put_if_absent(spark, f"{base}/commits/snapshot-{name}.json", json.dumps(commit)):
        _delete(spark, f"{base}/{folder}")
        raise taken


def current_snapshot(spark: SparkSession, base: str) -> str:
    """The name of the snapshot committed last; of two at one moment the later name."""
    latest = _commits(spark, base).agg(F.max(F.struct("committed", "snapshot")).alias("last")).head()
    if latest["last"] is None:
        raise LookupError(f"no snapshot published in {base}")
    return latest["last"]["snapshot"]


def read_snapshot(spark: SparkSession, base: str, snapshot: str | None = None) -> DataFrame:
    """The named snapshot, by default the one published last."""
    snapshot = snapshot or current_snapshot(spark, base)
    commit = _commits(spark, base).where(F.col("snapshot") == snapshot).head()
    if commit is None:
        raise LookupError(f"snapshot {snapshot!r} is not published in {base}")
    return spark.read.schema(ENTRY_SCHEMA).parquet(f"{base}/{commit['folder']}")


def append_summary(summary: DataFrame, path: str, run: str | None = None) -> None:
    """Add the rows of one summary run to a history table, in place of those of the same run.

    A run is known by its name, such as that of the snapshot, or else by the times its rows
    are stamped with. So a run that is repeated, because it failed or by mistake, leaves the
    history as it was; give names where several runs have one stamp.
    """
    name = F.unix_micros("time").cast("string") if run is None else F.lit(run)
    (
        summary.withColumn("run", name)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run")
        .parquet(path)
    )


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all runs of a history table."""
    return spark.read.parquet(path).drop("run")
