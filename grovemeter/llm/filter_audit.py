"""How filters interact: what each removes after any others, from tables of failing ids.

Every filter has one table of the ids that fail it, bucketed by id. Rows that fail none survive
every filter and are only counted. For the others, the survivors of each set of filters are the
survivors of the set without its last filter, left-anti joined to that filter's table; what a
filter removes after a set is the left-semi join of the set's survivors with its table; what it
removes after no other, less that, is redundant there. The survivors of an order's prefix are
those of the set of its filters, so 32 sets stand for all orders of five filters. All tables of
ids share their buckets, so none of these joins shuffles, and sets of one size share one table
and one join per filter.
"""

from __future__ import annotations

import uuid
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemeter.llm.common import partitions, whole, words
from grovemeter.operators.lookup import argument_table, join_lookup, salted_join
from grovemeter.scratch import new_scratch_path, stage

#: Rows of a bucket of the tables of ids, at most on average.
BUCKET_ROWS = 1_000_000
#: Rows with one text above which joins on the text are split.
COPIES_PER_PIECE = 500

MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 3
SYMBOLS = "[#$%&*|]"


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions A to D on a text that is not NULL."""
    found = words(text)
    return {
        "A": F.size(found) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(found)) < MIN_DISTINCT_PERCENT * F.size(found),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS_PERCENT * F.char_length(text),
        "D": text.rlike(SYMBOLS),
    }


def later_copies(rows: DataFrame, id_column: str, digest: str) -> DataFrame:
    """``rows`` with ``copied``: whether a row with a smaller id has the same digest, not NULL.

    Copies are counted before they are joined and the most frequent are split. A NULL id is
    never smaller nor larger than another.
    """
    groups = rows.groupBy(digest).agg(F.min(id_column).alias("least"), F.max(id_column).alias("most"), F.count(F.lit(1)).alias("n"))
    groups = stage(groups.where(F.col("least") < F.col("most")), "audit-copies")
    pieces = F.ceil(F.col("n") / COPIES_PER_PIECE).cast("int").alias("pieces")
    hot = stage(groups.where(F.col("n") > COPIES_PER_PIECE).select(digest, pieces), "audit-hot")
    joined = salted_join(rows, groups.select(digest, "least"), [digest], "left", hot)
    return joined.withColumn("copied", F.coalesce(F.col(id_column) > F.col("least"), F.lit(False))).drop("least")


class _IdTables:
    """Tables bucketed by ``row``, in folders of their own; dropped at the end."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        name = f"audit_{label}_{uuid.uuid4().hex}"
        writer = df.write.format("parquet").bucketBy(self.buckets, "row").sortBy("row")
        writer.option("path", new_scratch_path(self.spark, f"audit-{label}")).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def forget(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE {name}")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def filter_relations(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang"
) -> DataFrame:
    """One staged row per row of ``docs``: ``row`` (a unique number), id, part, fails (the
    letters of the filters it fails, in order), good, toxic (its labels, if it fails any).

    A row is good or toxic if any label row of its id says so.
    """
    text = whole(text_column)
    conditions = text_filters(text)
    raw = docs.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        F.concat(*[F.when(fails, F.lit(name)).otherwise(F.lit("")) for name, fails in conditions.items()]).alias("fails"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = stage(raw.withColumn("row", F.monotonically_increasing_id()), "audit-rows")
    marked = later_copies(rows, "id", "digest").withColumn("fails", F.concat("fails", F.when(F.col("copied"), F.lit("E")).otherwise(F.lit(""))))
    marked = stage(marked.select("row", "id", "part", "fails"), "audit-marked")
    known = labels.where(F.col(id_column).isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
    known = known.groupBy(F.col(id_column).alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).cast("long").alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).cast("long").alias("toxic"),
    )
    known = stage(known, "audit-labels")
    failing = marked.where(F.col("fails") != "")
    labelled = join_lookup(failing.where(F.col("id").isNotNull()), known, ["id"], "left").fillna(0, ["good", "toxic"])
    nothing = F.lit(0).cast("long")
    others = marked.where((F.col("fails") == "") | F.col("id").isNull()).withColumns({"good": nothing, "toxic": nothing})
    return stage(labelled.unionByName(others), "audit-relations")


def interactions(relations: DataFrame, filters: str) -> DataFrame:
    """part, before, filter, kept, removed, redundant, good_lost, toxic_lost for each part of
    ``relations``, each set of filters ``before`` (letters in order) and each filter not in it.

    kept counts the rows that survive the set and the filter, removed those that the filter
    removes after the set, redundant those that fail it but are gone before.
    """
    spark = relations.sparkSession
    failing = relations.where(F.col("fails") != "")
    tables = _IdTables(spark, max(partitions(spark), -(-failing.count() // BUCKET_ROWS)))
    columns = ["row", "part", "good", "toxic"]
    last = F.substring("before", -1, 1)

    fails = {f: tables.write(failing.where(F.col("fails").contains(f)).select("row"), f"fails_{f}") for f in filters}
    alive = tables.write(failing.select(F.lit("").alias("before"), *columns), "all")
    found = []

    def note(rows: DataFrame, what: str, f: str = "") -> None:
        found.append(rows.select("part", "before", F.lit(what).alias("what"), F.lit(f).alias("filter"), "good", "toxic"))

    for size in range(len(filters)):
        note(alive, "alive")
        for f in filters:
            note(alive.where(~F.col("before").contains(f)).join(fails[f], "row", "left_semi"), "removed", f)
        if size + 1 == len(filters):
            break  # rows that fail some filter do not survive the set of all
        longer = [
            alive.where((F.col("before") == "") | (last < f)).join(fails[f], "row", "left_anti").withColumn("before", F.concat("before", F.lit(f)))
            for f in filters[size:]
        ]
        alive = tables.write(_union(longer), "alive")
    # no join above shuffles; this one shuffle takes counts
    counted = _union(found).groupBy("part", "before", "what", "filter").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
    )
    counted = stage(counted, "audit-counts")
    tables.forget()

    # what is left is small: some numbers for each part, set and filter
    sets = [("".join(s), f) for n in range(len(filters)) for s in combinations(filters, n) for f in filters if f not in s]
    pairs = F.array(*[F.struct(F.lit(s).alias("before"), F.lit(f).alias("filter"), F.lit("".join(sorted(s + f))).alias("after")) for s, f in sets])
    parts = relations.groupBy("part").agg(F.count_if(F.col("fails") == "").alias("clean"))
    grid = parts.select("part", "clean", F.inline(pairs))
    removed = counted.where("what = 'removed'").select(
        "part", "before", "filter", F.col("n").alias("removed"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost")
    )
    left = counted.where("what = 'alive'").select("part", F.col("before").alias("after"), F.col("n").alias("left"))
    failing_at_all = removed.where("before = ''").select("part", "filter", F.col("removed").alias("fail"))
    joined = grid.join(removed, ["part", "before", "filter"], "left").join(left, ["part", "after"], "left")
    filled = joined.join(failing_at_all, ["part", "filter"], "left").fillna(0, ["removed", "good_lost", "toxic_lost", "left", "fail"])
    return filled.select(
        "part", "before", "filter", (F.col("clean") + F.col("left")).alias("kept"), "removed",
        (F.col("fail") - F.col("removed")).alias("redundant"), "good_lost", "toxic_lost",
    )


def audit(relations: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row per part, order of all ``filters`` and step: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    unique_fails counts the part's rows that fail this filter only; shapley is what the filter
    removes, summed over all orders. Parts without rows do not occur, so an empty table gives
    an empty result.
    """
    found = stage(interactions(relations, filters), "audit-interactions")
    size = len(filters)
    n = F.length("before")
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(size - 1 - k)) for k in range(size)]), n + 1)
    of_filter = found.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * orders).cast("long").alias("shapley"),
        F.sum(F.when(n == size - 1, F.col("removed")).otherwise(0)).cast("long").alias("unique_fails"),
    )
    steps = [
        ("".join(order), step + 1, "".join(sorted(order[:step])), order[step]) for order in permutations(filters) for step in range(size)
    ]
    named = dict(zip(("filter_order", "step", "before", "filter"), map(list, zip(*steps))))
    listed = argument_table(relations.sparkSession, **named).withColumn("step", F.col("step").cast("int"))
    listed = listed.join(found.join(of_filter, ["part", "filter"]), ["before", "filter"])
    return listed.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def filter_interactions(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang"
) -> DataFrame:
    """The :func:`audit` of the filters A to E over whole texts.

    A: under 200 words; B: under half of them distinct; C: over 3 % of the characters are A-Z;
    D: holds one of #$%&*|; E: a row with a smaller id has the same text. NULL counts as the
    empty text and a NULL part as the empty one. Rows are told apart by a number of their own,
    so ids may repeat: rows that repeat with their id are counted each and are no copies of one
    another; rows without an id fail E never and have no labels. Columns other than those
    named are not read, and of ``labels`` only id, quality and toxic.
    """
    return audit(filter_relations(docs, labels, id_column, text_column, part_column))
