"""Scan records: CSV without header, CRLF between records, empty unquoted fields NULL.

Files are read as text split on the record separator, so a single huge file is still read by
many tasks, and line feeds inside quoted names do no harm. Only a name that contains the
separator itself breaks a record apart; files with such names are recognised by their quotes
and their records are put together again before parsing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovemeter.schemas import ENTRY_COLUMNS, SCAN_COLUMNS, SCAN_SCHEMA
from grovemeter.scratch import stage, unstage
from grovemeter.sources.snapshots import layout_files, publish_snapshot, read_snapshot

# The wire format.
RECORD_SEPARATOR = "\r\n"
CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "FAILFAST"}
# A name has at most 255 bytes, so this many separators cannot be inside one.
MAX_PIECES = 256
SCAN_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCAN_SCHEMA)


def read_scan_csv(
    spark: SparkSession, paths: str | Sequence[str], separator: str = RECORD_SEPARATOR
) -> DataFrame:
    """Entries from one or many scan files, folders or globs.

    ``separator`` is for files rewritten with other line ends. A record that does not fit
    the schema fails the job.
    """
    lines = _lines(spark, paths, separator)
    broken = [r["file"] for r in lines.where(_open_quote()).select("file").distinct().collect()]
    if broken:
        # The list is no longer than the list of input files, which the driver holds anyway.
        whole = lines.where(~F.col("file").isin(broken)).select("value")
        pieces = lines.where(F.col("file").isin(broken))
        lines = whole.unionByName(_rejoined(pieces, separator))
    record = F.from_csv("value", SCAN_DDL, CSV_OPTIONS)
    return (
        lines.where(F.col("value") != "")
        .select(record.alias("record"))
        .select("record.*")
        .select(*ENTRY_COLUMNS)
    )


def load_scan(
    spark: SparkSession, paths: str | Sequence[str], base: str, snapshot: str
) -> DataFrame:
    """Read scan files and publish them as the current snapshot of ``base``.

    The parsed records are staged, because laying out a snapshot reads its input twice and
    parsing is the dearer part.
    """
    staged = stage(read_scan_csv(spark, paths), "scan")
    publish_snapshot(staged, base, snapshot, max(layout_files(staged), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    unstage(staged)
    return read_snapshot(spark, base, snapshot)


def _lines(spark: SparkSession, paths, separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def _open_quote() -> Column:
    """An odd number of quotes: the piece ends or starts inside a quoted name."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return quotes % 2 == 1


def _rejoined(pieces: DataFrame, separator: str) -> DataFrame:
    """Whole records from the pieces of files whose names contain the separator.

    The state at a piece (inside or outside a quoted name) depends on all quotes before it
    in the file. It is summed in two steps, over the pieces of each input split and over the
    splits of each file, so no group is larger than a split. A quote that is never closed would
    make one record of all that follows; that is found by counting pieces and raises
    ``ValueError`` before any record is put together.
    """
    numbered = pieces.select(
        "*",
        F.monotonically_increasing_id().alias("line"),
        _open_quote().cast("int").alias("flips"),
    )
    earlier_blocks = (
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    in_block = (
        Window.partitionBy("file", "block")
        .orderBy("line")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    blocks = (
        numbered.groupBy("file", "block")
        .agg(F.sum("flips").alias("block_flips"))
        .select(
            "file",
            "block",
            F.coalesce(F.sum("block_flips").over(earlier_blocks), F.lit(0)).alias("flips_before"),
        )
    )
    placed = numbered.join(blocks, ["file", "block"]).withColumn(
        "starts",
        (
            (F.col("flips_before") + F.sum("flips").over(in_block) - F.col("flips")) % 2 == 0
        ).cast("int"),
    )
    placed = placed.withColumn("nth", F.sum("starts").over(in_block))
    # A piece before the first start of its split belongs to the last record started earlier.
    last_record = (
        placed.groupBy("file", "block")
        .agg(F.sum("starts").alias("records"))
        .select(
            "file",
            "block",
            F.last(
                F.when(F.col("records") > 0, F.struct("block", "records")), ignorenulls=True
            )
            .over(earlier_blocks)
            .alias("open_record"),
        )
    )
    owned = placed.join(last_record, ["file", "block"]).select(
        "file",
        F.when(F.col("nth") > 0, F.col("block"))
        .otherwise(F.col("open_record.block"))
        .alias("record_block"),
        F.when(F.col("nth") > 0, F.col("nth"))
        .otherwise(F.col("open_record.records"))
        .alias("record"),
        "block",
        "line",
        "value",
    )
    record = ["file", "record_block", "record"]
    sizes = owned.groupBy(*record).agg(F.count(F.lit(1)).alias("pieces"))
    if (endless := sizes.where(F.col("pieces") > MAX_PIECES).first()) is not None:
        raise ValueError(f"{endless['file']}: a quote is opened and not closed")
    parts = F.sort_array(F.collect_list(F.struct("block", "line", "value")))
    return (
        owned.groupBy(*record)
        .agg(parts.alias("parts"))
        .select(F.array_join(F.transform("parts", lambda p: p["value"]), separator).alias("value"))
    )


def scan_record(quote_pattern: str = '[",\r\n]') -> Column:
    """An entry as one CSV record; a field is quoted only if it has to be."""
    fields = []
    for name in SCAN_COLUMNS:
        text = F.col(name).cast("string")
        if name == "basename":
            quoted = F.concat(
                F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')
            )
            text = F.when(text.rlike(quote_pattern) | (text == ""), quoted).otherwise(text)
        fields.append(F.coalesce(text, F.lit("")))
    return F.concat_ws(",", *fields)


def write_scan_csv(entries: DataFrame, path: str) -> None:
    """Write entries as scan records, one file per partition."""
    entries.select(scan_record().alias("value")).write.option(
        "lineSep", RECORD_SEPARATOR
    ).text(path)
