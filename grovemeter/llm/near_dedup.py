"""Near-duplicate documents by circulant MinHash.

A shingle is mapped by one fixed permutation to a place on a circle of CIRCLE slots; a second
fixed permutation, shifted round the circle by k places, gives the k-th hash. So all
coordinates of a signature come from two permutations: those of a shingle at place p are the
K values of the second permutation from p on. Signatures are cut into BANDS bands of ROWS
coordinates; texts that share a band are candidates, and every link is confirmed on full
shingle sets. At a similarity of 0.8 a pair shares no band with probability 1e-7.

Links are only needed as far as they join classes, so no bucket is expanded into pairs. Twice
each bucket checks its most central member (the one that shares most buckets, which of near
copies is the least edited) against the members of other classes, and classes are merged. Then
whoever is still outside the main class of a bucket is checked against all members of the
bucket's classes, in blocks of BLOCK by BLOCK texts of which only the links that merge classes
come out. Nothing is capped: at the end every pair of texts that share a band is in one class
or was checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemeter.llm.common import let_workers_import, lower_ascii, words
from grovemeter.scratch import stage, unstage

CIRCLE = 1 << 20
BANDS = 40
ROWS = 5
SEED = 20_240_601
#: Rounds in which one member of each bucket is checked against the others.
STARS = 2
#: Texts on each side of a block.
BLOCK = 400


def shingle_sets(text: Column, width: int) -> Column:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    Fewer than ``width`` words make one shingle of all words; no words make an empty set. The
    chance that two of 10,000 shingles share a hash is 3e-12.
    """
    found = words(lower_ascii(F.coalesce(text, F.lit(""))))

    def shingles(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1)))
        hashed = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, width)))
        return F.sort_array(F.array_distinct(hashed))

    empty = F.array().cast("array<bigint>")
    # `transform` over a single-element array names the words once
    return F.element_at(
        F.transform(F.array(found), lambda w: F.when(F.size(w) == 0, empty).otherwise(shingles(w))), 1
    )


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The place of each residue, and the second permutation written past its end."""
    random = np.random.default_rng(SEED)
    places = random.permutation(CIRCLE)
    ring = random.permutation(CIRCLE).astype(np.int32)
    return places, np.concatenate([ring, ring[: BANDS * ROWS]])


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def signature(shingles: np.ndarray) -> np.ndarray:
    """All BANDS * ROWS coordinates of one non-empty shingle set."""
    if not _TABLES:
        _TABLES.append(_permutations())
    places, ring = _TABLES[0]
    runs = np.lib.stride_tricks.sliding_window_view(ring, BANDS * ROWS)
    at = places[shingles.view(np.uint64) >> np.uint64(64 - CIRCLE.bit_length() + 1)]
    least = runs[at[0]].copy()
    for begin in range(0, len(at), 2048):  # so that long texts need little memory
        np.minimum(least, runs[at[begin : begin + 2048]].min(axis=0), out=least)
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band from the coordinates of the band and its number."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for row in range(ROWS):
            keys = (keys ^ parts[:, :, row]) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, digest, h1, h2, set) to (id, digest, h1, h2, size, keys); an empty set has no keys."""
    for batch in batches:
        sets = batch.column(4)
        values = sets.flatten().to_numpy(zero_copy_only=False)
        sizes = sets.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        for low in range(0, len(sizes), 1000):
            part = slice(low, low + 1000)
            signatures = [signature(values[end - n : end]) for end, n in zip(ends[part], sizes[part]) if n]
            keys = band_keys(np.array(signatures)).ravel() if signatures else np.empty(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum((sizes[part] > 0) * BANDS)]).astype(np.int32)
            n = len(offsets) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).slice(low, n) for i in range(4)),
                    pa.array(sizes[part].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys)),
                ],
                ["id", "digest", "h1", "h2", "size", "keys"],
            )


def _smallest_labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over undirected ``edges`` (a, b).

    Each round takes the smallest label among a node and its neighbours, then the label of
    that label, and stops when nothing changes. Rounds are written to shared tables.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "near-edges")
    labels = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "near-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        moved = stage(
            lower.join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label"), "old"), "near-labels"
        )
        unstage(labels)
        labels = moved.select("node", "label")
        if moved.where(F.col("label") != F.col("old")).isEmpty():
            unstage(both)
            return labels


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity, checked on integers."""
    right = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    full = right.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return full.where(common * 100 >= union * percent).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = 5,
    percent: int = 80,
) -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles, component_id, kept.

    Two texts are linked when their sets of ``width``-word shingles have at least ``percent``
    per cent of their union in common; component_id is the smallest id reachable over links
    and kept says that it is the row's own. Texts without words, NULL included, link with
    nothing. Where rows share an id, links of each of them may join their classes. A NULL id
    is compared like any other: its component_id is the smallest id it is linked with, else
    NULL, and it is kept exactly in the second case. Other columns are not read; an empty
    table gives an empty result.
    """
    return _classified(docs, id_column, text_column, width, percent).select(
        F.col("id").alias(id_column), "n_shingles", "component_id", "kept"
    )


def _classified(docs: DataFrame, id_column: str, text_column: str, width: int, percent: int) -> DataFrame:
    """(id, digest of the text, n_shingles, component_id, kept) of every row."""
    let_workers_import(docs.sparkSession)
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    hashed = narrow.select("id", F.xxhash64("text").alias("digest"), shingle_sets(F.col("text"), width).alias("set")).select(
        "id", "digest", F.xxhash64("set").alias("h1"), F.xxhash64(F.lit(1), "set", F.lit(2)).alias("h2"), "set"
    )
    texts = stage(hashed.mapInArrow(_sign, "id bigint, digest bigint, h1 bigint, h2 bigint, size int, keys array<bigint>"), "near-texts")

    # Equal sets are one node, named by its smallest id; without ids by a negative hash.
    groups = stage(
        texts.where("size > 0")
        .groupBy("size", "h1", "h2")
        .agg(F.min("id").alias("least"))
        .withColumn("node", F.coalesce("least", _nameless("h1"))),
        "near-groups",
    )
    members = (
        texts.select(F.coalesce("id", _nameless("h1")).alias("node"), "size", "keys")
        .join(groups.select("node").distinct(), "node", "left_semi")
        .select("node", "size", F.explode("keys").alias("key"))
    )
    shared = stage(members.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "near-shared")
    met = stage(members.join(shared, "key"), "near-met")
    central = met.groupBy("node").agg(F.sum("many").alias("central"))
    buckets = stage(met.drop("many").join(central, "node"), "near-buckets")
    unstage(met)

    # Full sets of the nodes that have a candidate; texts are shuffled, which are smaller.
    involved = buckets.select("node").distinct()
    ids = narrow.where(F.col("id").isNotNull()).join(involved.withColumnRenamed("node", "id"), "id", "left_semi")
    named = ids.select(F.col("id").alias("node"), shingle_sets(F.col("text"), width).alias("set"))
    no_id = narrow.where(F.col("id").isNull()).select(shingle_sets(F.col("text"), width).alias("set"))
    unnamed = no_id.select(_nameless(F.xxhash64("set")).alias("node"), "set").join(involved, "node", "left_semi")
    sets = stage(named.union(unnamed), "near-sets")
    labels = _classes(buckets, sets, percent)
    for done in (buckets, sets):
        unstage(done)

    classed = groups.join(labels, "node", "left")
    component = classed.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("component"))
    of_text = classed.join(component, "label", "left").select(
        "size", "h1", "h2", F.coalesce("component", "least").alias("component")
    )
    own = F.coalesce("component", "id")
    return (
        texts.select("id", "digest", "size", "h1", "h2")
        .join(of_text, ["size", "h1", "h2"], "left")
        .select(
            "id",
            "digest",
            F.col("size").cast("long").alias("n_shingles"),
            own.alias("component_id"),
            F.col("id").eqNullSafe(own).alias("kept"),
        )
    )


def _nameless(digest: str | Column) -> Column:
    """The node of a set that no row with an id has."""
    return -F.shiftrightunsigned(digest, 1) - 1


def _classes(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, label) of every node of ``buckets``; equal labels are one class."""
    labels = stage(buckets.select("node").distinct().withColumn("label", F.col("node")), "near-classes")
    live = buckets
    for _ in range(STARS):
        opened = _open_buckets(live, labels)
        if opened.isEmpty():
            return labels
        order = F.struct("central", "node", "label", "size")
        leader = stage(
            opened.groupBy("key").agg(F.max(order).alias("lead")).select(
                "key", F.col("lead.node").alias("x"), F.col("lead.label").alias("lx"), F.col("lead.size").alias("sx")
            ),
            "near-leaders",
        )
        near_size = F.least("sx", "size") * 100 >= F.greatest("sx", "size") * percent
        pairs = opened.join(leader, "key").where((F.col("lx") != F.col("label")) & near_size)
        pairs = pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
        labels = _merged(labels, stage(_confirmed(pairs, sets, percent), "near-links"))
        # the leader has met every member of other classes, so its bucket is done with it
        led = leader.select("key", F.col("x").alias("node"))
        live = stage(opened.select("key", "node", "size", "central").join(led, ["key", "node"], "left_anti"), "near-rest")
        unstage(opened)
        unstage(leader)
    opened = _open_buckets(live, labels)
    return labels if opened.isEmpty() else _merged(labels, stage(_block_links(opened, sets, percent), "near-links"))


def _open_buckets(live: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets with several classes, with their label and the bucket's largest class."""
    marked = live.join(labels, "node")
    per_label = marked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = per_label.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "label")).alias("main"))
    mixed = mixed.where("classes > 1").select("key", F.col("main.label").alias("main_label"))
    return stage(marked.join(mixed, "key"), "near-open")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` with the classes that ``links`` (a, b) join made one. Both are used up."""
    named = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(
        labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b"
    )
    joined = _smallest_labels(named.select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a != b"))
    new = joined.select(F.col("node").alias("label"), F.col("label").alias("top"))
    after = stage(labels.join(new, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "near-classes")
    for done in (labels, links, joined):
        unstage(done)
    return after


def _block_links(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that merge classes, among texts of open buckets with the same main class.

    Texts outside the main class are dealt into rows of blocks, all texts into columns; each
    block is one group of at most about BLOCK texts a side, so no group grows with a class.
    """
    texts = opened.select("main_label", "node", "label").distinct()
    texts = stage(texts.withColumn("outside", F.col("label") != F.col("main_label")), "near-texts-left")
    counts = texts.groupBy("main_label").agg(F.count(F.lit(1)).alias("all"), F.count_if("outside").alias("out"))
    placed = texts.join(counts, "main_label").select(
        "main_label", "node", "label", "outside",
        F.ceil(F.col("out") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("all") / BLOCK).cast("int").alias("columns"),
    )
    side = lambda of, other, left: placed.select(
        "main_label", "node", "label", F.lit(left).alias("left"),
        F.pmod(F.xxhash64("node"), F.col(of)).cast("int").alias(of[:-1]),
        F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[:-1]),
        "outside",
    )
    rows = side("rows", "columns", True).where("outside").drop("outside")
    columns = side("columns", "rows", False).drop("outside")
    full = rows.unionByName(columns).join(sets, "node").select("main_label", "row", "column", "left", "node", "label", "set")

    def link(table: pa.Table) -> pa.Table:
        return _link_block(table, percent)

    return full.groupBy("main_label", "row", "column").applyInArrow(link, "a bigint, b bigint")


def _link_block(table: pa.Table, percent: int) -> pa.Table:
    """Exact comparison of each left text with all right texts; one link per merge of classes."""
    left = table.column("left").to_numpy()
    nodes, labels = table.column("node").to_numpy(), table.column("label").to_pylist()
    sets = table.column("set").combine_chunks()
    sizes = sets.value_lengths().to_numpy(zero_copy_only=False)
    values = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
    parts = np.split(values, np.cumsum(sizes)[:-1])
    right = np.flatnonzero(~left)
    links: list[tuple[int, int]] = []
    if len(right):
        joined = np.concatenate([parts[i] for i in right])
        starts = np.cumsum(sizes[right]) - sizes[right]
        has = np.zeros(int(values.max()) + 1, np.int32)
        parent = {label: label for label in labels}

        def top(label: int) -> int:
            while parent[label] != label:
                parent[label] = label = parent[parent[label]]
            return label

        for i in np.flatnonzero(left):
            has[parts[i]] = 1
            common = np.add.reduceat(has[joined], starts)
            has[parts[i]] = 0
            alike = common * 100 >= (sizes[i] + sizes[right] - common) * percent
            for j in right[alike]:
                mine, other = top(labels[i]), top(labels[j])
                if mine != other:
                    parent[mine] = other
                    links.append((int(nodes[i]), int(nodes[j])))
    a, b = zip(*links) if links else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their class, with all columns.

    Rows that share an id stay or go together; rows without an id stay unless they are linked
    with one that has an id.
    """
    kept = _classified(docs, id_column, text_column, width, 80).where("kept")
    chosen = kept.select(F.col("id").alias("_kept_id"), F.col("digest").alias("_kept_digest")).distinct()
    same = F.col(id_column).eqNullSafe(F.col("_kept_id")) & (F.xxhash64(text_column) == F.col("_kept_digest"))
    return docs.join(chosen, same, "left_semi")
