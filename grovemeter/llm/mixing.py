"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets a key -ln(u) / quality from a hash of its identifier, so smaller keys come
first and good documents sooner. A source whose target reaches its size contributes complete
epochs first; the rest of its budget is filled by its documents in the order of their keys, as
far as the prefix sums of their sizes fit, and by the one further document that comes nearest
to what is then left. Prefix sums are taken in slices of the key, so no source, however
large, is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovemeter.llm.common import id_order, partitions, range_bucket, splitters, whole, words
from grovemeter.scratch import stage, unstage

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
LIMIT = 2.0
SEED = "mix-1"
#: Documents of one slice of a source's keys.
SLICE = 2000

SOURCE = ("no_source", "source")


def text_quality(text: Column) -> Column:
    """0.5 to 1.5: by the share of letters and spaces; 0.5 for NULL and empty texts."""
    kept = F.char_length(F.regexp_replace(text, r"[^\p{L} ]", ""))
    return F.lit(0.5) + F.coalesce(kept / F.nullif(F.char_length(text), F.lit(0)), F.lit(0.0))


def sampling_key(identifier: Column, quality: Column) -> Column:
    """-ln(u) / quality with u in (0, 1) from 52 bits of a hash of the identifier."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(identifier.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 52))) / quality


def ranked_sources(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, from 0 by code point, NULL last, without one global sort."""
    keys = list(SOURCE)
    cuts = splitters(sources, keys, F.lit(1), partitions(sources.sparkSession))
    placed = sources.withColumn("range", range_bucket(sources, keys, cuts)).repartitionById(len(cuts) + 1, F.col("range"))
    inside = placed.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(*keys)))
    # one row per range, and there are at most as many ranges as shuffle partitions
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return inside.join(F.broadcast(starts), "range").withColumn("place", F.col("start") + F.col("place") - 1).drop("range", "start")


def source_targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = TOTAL_SHARE, limit: float = LIMIT
) -> DataFrame:
    """no_source, source, source_size, docs with target, epochs and rest.

    ``share`` of all sizes is dealt by weight; targets stop at ``limit`` times the source and
    the excess goes to the others by weight until none is above. Each round is one sum over
    the sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = stage(ranked_sources(sources).withColumn("weight", weight), "mix-sources")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    top = F.col("source_size") * limit
    level, full = 0.0, -1
    while True:
        is_full = top <= F.col("weight") * level
        filled, used, free = table.agg(
            F.count_if(is_full), F.coalesce(F.sum(F.when(is_full, top)), F.lit(0.0)), F.sum(F.when(~is_full, F.col("weight")))
        ).first()
        if filled == full or not free:
            break
        level, full = (total - used) / free, filled
    target = F.least(top, F.col("weight") * level)
    epochs = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (
        table.withColumn("target", F.round(target, 6))
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    )


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = TOTAL_SHARE,
    limit: float = LIMIT,
) -> DataFrame:
    """One row per row of ``docs``: id, source, digest of the text, size, source_size, target, copies, taken.

    A size is the number of words; a NULL text has size 0. A NULL source is a source, the last
    one. Rows without words, and all rows of a source without words, are taken 0 times. Rows
    that repeat with their id share a key and are taken each on its own; a NULL id has the key
    of the empty identifier. The same input gives the same mix whatever its order. Columns
    other than the three named are not read; an empty table gives an empty result.
    """
    raw = docs.select(
        F.col(id_column).alias("id"),
        F.col(source_column).isNull().alias("no_source"),
        F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("source"),
        F.size(words(F.col(text_column))).cast("long").alias("size"),
        sampling_key(F.col(id_column), text_quality(F.col(text_column))).alias("key"),
        F.xxhash64(whole(text_column)).alias("digest"),
    )
    rows = stage(raw, "mix-rows")
    totals = rows.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    targets = stage(source_targets(totals, weights, share, limit).select(*SOURCE, "source_size", "docs", "target", "epochs", "rest"), "mix-targets")

    slices = F.ceil(F.col("docs") / SLICE)
    sliced = rows.join(targets.select(*SOURCE, "docs"), list(SOURCE)).withColumn(
        "slice", F.least(slices - 1, F.floor(slices * (F.lit(1.0) - F.exp(-F.col("key")))))
    ).drop("docs")
    inside = Window.partitionBy(*SOURCE, "slice").orderBy("key", id_order("id"), "size", "digest")
    running = sliced.withColumn("sum", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # one row per SLICE documents
    before = Window.partitionBy(*SOURCE).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy(*SOURCE, "slice").agg(F.sum("size").alias("n")).select(
        *SOURCE, "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    ordered = stage(
        running.join(starts, [*SOURCE, "slice"]).withColumn("sum", F.col("sum") + F.col("start")).drop("slice", "start"), "mix-order"
    )

    fits = (F.col("size") > 0) & (F.col("sum") <= F.col("rest"))
    facts = ordered.join(targets.select(*SOURCE, "rest"), list(SOURCE))
    gaps = facts.groupBy(*SOURCE, "rest").agg((F.col("rest") - F.coalesce(F.max(F.when(fits, F.col("sum"))), F.lit(0))).alias("gap"))
    off = F.abs(F.col("gap") - F.col("size"))
    spare = facts.join(gaps.select(*SOURCE, "gap"), list(SOURCE)).where(~fits & (F.col("size") > 0) & (off < F.col("gap")))
    last = spare.groupBy(*SOURCE).agg(F.min(F.struct(off.alias("off"), F.col("sum"))).alias("last")).select(
        *SOURCE, F.col("last.sum").alias("last_sum")
    )
    limits = stage(targets.join(last, list(SOURCE), "left"), "mix-limits")
    copies = F.when(
        F.col("size") > 0,
        F.col("epochs") + (F.col("sum") <= F.col("rest")).cast("long") + F.coalesce((F.col("sum") == F.col("last_sum")).cast("long"), F.lit(0)),
    ).otherwise(F.lit(0))
    mixed = ordered.join(limits.drop("docs"), list(SOURCE)).withColumn("copies", copies)
    unstage(rows)
    unstage(targets)
    return mixed.select(
        F.col("id").alias(id_column),
        F.when(~F.col("no_source"), F.col("source")).alias("source"),
        "digest",
        "size",
        "source_size",
        "target",
        F.col("copies").cast("int").alias("copies"),
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken."""
    chosen = mix(docs, id_column, text_column, source_column)
    same = ["_id", "_source", "_digest"]
    counts = chosen.groupBy(F.col(id_column).alias("_i"), F.col("source").alias("_s"), F.col("digest").alias("_d")).agg(
        *[F.count_if(F.col("copies") == n).alias(f"_times{n}") for n in (1, 2)]
    )
    keyed = docs.withColumns(
        {"_id": F.col(id_column), "_source": F.col(source_column).cast("string"), "_digest": F.xxhash64(whole(text_column))}
    )
    met = keyed.join(
        counts.where("_times1 + _times2 > 0"),
        F.col("_id").eqNullSafe(F.col("_i")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_digest") == F.col("_d")),
    )
    turn = F.row_number().over(Window.partitionBy(*same).orderBy(*same))
    times = F.when(F.col("_turn") <= F.col("_times2"), 2).when(F.col("_turn") <= F.col("_times2") + F.col("_times1"), 1).otherwise(0)
    return (
        met.withColumn("_turn", turn)
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
        .select(*docs.columns)
    )
