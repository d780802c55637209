"""Exact dedup by content sort.

Sampled splitters cut the normalised texts into ranges, one shuffle brings each range
together, Spark's external sort puts equal texts side by side, and every text is compared in
full with its neighbour. A run of equal texts may cross ranges: the splitters carry the
identifier too, so copies of one text that hold a third of all rows spread over as many
ranges as they need, and the runs at the edges of ranges (two a range) are joined up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovemeter.llm.common import BLANK, id_order, partitions, range_bucket, splitters, whole
from grovemeter.scratch import stage

#: Code points of a text that splitters hold; longer texts go on by a hash of the whole text.
PREFIX = 48


def normalised(text: str | Column) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(whole(text), BLANK + "+", " ")


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", buckets: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256.

    NULL texts count as empty texts, and empty texts equal one another. A NULL id sorts after
    all others; keep_id is NULL where a group has no other. Exactly one row of a group is
    kept, also where rows repeat with their id. Columns other than the two named are not
    read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    buckets = buckets or partitions(spark)
    keys = ["prefix", "digest", "rank_id"]
    rows = docs.select(
        F.col(id_column).alias("id"), id_order(id_column).alias("rank_id"), normalised(text_column).alias("norm")
    ).select(
        "id", "rank_id", "norm", F.substring("norm", 1, PREFIX).alias("prefix"), F.xxhash64("norm").alias("digest")
    )
    cuts = splitters(rows, keys, F.octet_length("norm") + 200, buckets)
    ranged = rows.withColumn("bucket", range_bucket(rows, keys, cuts)).repartitionById(len(cuts) + 1, F.col("bucket"))

    in_order = Window.partitionBy("bucket").orderBy("prefix", "digest", "norm", "rank_id")
    compared = ranged.select(
        "bucket",
        "id",
        "norm",
        F.row_number().over(in_order).alias("place"),
        F.lag("norm").over(in_order).alias("before"),
        F.lead("norm").over(in_order).alias("after"),
    ).select(
        "bucket",
        "id",
        "place",
        (~F.col("norm").eqNullSafe(F.col("before"))).alias("first"),
        F.when((F.col("place") == 1) | F.col("after").isNull(), F.col("norm")).alias("edge"),
        F.sha2("norm", 256).alias("text_sha256"),
    )
    by_place = Window.partitionBy("bucket").orderBy("place")
    run = Window.partitionBy("bucket", "run")
    runs = stage(
        compared.withColumn("run", F.sum(F.col("first").cast("long")).over(by_place))
        .withColumn("rows", F.count(F.lit(1)).over(run))
        .withColumn("least", F.min("id").over(run)),
        "exact-runs",
    )

    # At most two runs of each bucket touch an edge, so this table is bounded by the splitters.
    along = Window.orderBy("bucket", "run")
    joined = Window.partitionBy("text_run")
    edges = (
        runs.where(F.col("edge").isNotNull())
        .groupBy("bucket", "run", "rows", "least")
        .agg(F.first("edge").alias("edge"))
        .withColumn("opens", ~F.col("edge").eqNullSafe(F.lag("edge").over(along)))
        .withColumn("text_run", F.sum(F.col("opens").cast("long")).over(along))
        .select(
            "bucket",
            "run",
            "opens",
            F.sum("rows").over(joined).alias("all_rows"),
            F.min("least").over(joined).alias("all_least"),
            F.lit(True).alias("at_edge"),
        )
    )
    return runs.join(F.broadcast(edges), ["bucket", "run"], "left").select(
        F.col("id").alias(id_column),
        F.when(F.col("at_edge"), F.col("all_least")).otherwise(F.col("least")).alias("keep_id"),
        F.coalesce("all_rows", "rows").alias("group_size"),
        (F.col("first") & F.coalesce("opens", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that repeat with their id count as one and the first of them stays; rows without an
    id are dropped only where a row with an id has the same text.
    """
    kept = exact_duplicates(docs, id_column, text_column).where(F.col("kept"))
    chosen = kept.select(F.col(id_column).alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    return docs.join(
        chosen,
        F.col(id_column).eqNullSafe(F.col("_kept_id")) & (F.sha2(normalised(text_column), 256) == F.col("_kept_sha")),
        "left_semi",
    )
