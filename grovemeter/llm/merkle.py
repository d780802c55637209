"""Document fingerprints: a Merkle tree over sections and paragraphs.

A section ends at a blank line, a paragraph at a line feed, a leaf behind a word whose hash says
so, four words on average and LEAF_WORDS at most. A leaf's node is the SHA-256 of its text, that
of a paragraph the hash of its leaves' nodes, and so on over sections up to the root. Equal roots
mean equal texts. Where roots differ, one compares sections, then only the paragraphs of sections
that differ. As leaves end where their own words say, a word put in or taken out changes the leaf
it is in and the nodes above, and no other leaf: the share of equal leaves is the likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovemeter.llm.common import id_order, partitions, range_bucket, splitters, whole

LEAF_WORDS = 32
#: A word with the white space behind it; above U+2E80, where scripts have no spaces, a character.
PIECE = r"(?:[^\x20\x09-\x0D\x{2E80}-\x{10FFFF}]+|[\x{2E80}-\x{10FFFF}])[\x20\x09\x0B-\x0D]*|[\x20\x09\x0B-\x0D]+"
#: Pieces up to a cut, marked by a line feed.
LEAF = rf"(?:{PIECE}){{1,{LEAF_WORDS}}}\n?"


def leaves(paragraph: Column) -> Column:
    """The leaves of a paragraph in order; together they are its text. Each cut keeps its mark."""
    pieces = F.regexp_extract_all(paragraph, F.lit(PIECE), F.lit(0))
    marked = F.transform(pieces, lambda piece: F.when(F.md5(piece) < "4", F.concat(piece, F.lit("\n"))).otherwise(piece))
    return F.regexp_extract_all(F.array_join(marked, ""), F.lit(LEAF), F.lit(0))


def leaf_nodes(text: Column) -> Column:
    """For each section and paragraph the nodes of its leaves: array<array<array<string>>>."""
    return F.transform(
        F.split(text, "\n\n"),
        lambda section: F.transform(F.split(section, "\n"), lambda part: F.transform(leaves(part), lambda leaf: F.sha2(leaf, 256))),
    )


def paragraph_nodes(nodes: Column) -> Column:
    """For each section the nodes of its paragraphs: array<array<string>>."""
    return F.transform(
        nodes,
        lambda section: F.transform(section, lambda part: F.sha2(F.concat(F.lit("paragraph:"), F.array_join(part, ",")), 256)),
    )


def section_nodes(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda nodes: F.sha2(F.concat(F.lit("section:"), F.array_join(nodes, ",")), 256))


def root_node(sections: Column) -> Column:
    return F.sha2(F.concat(F.lit("root:"), F.array_join(sections, ",")), 256)


def fingerprint(nodes: Column) -> Column:
    """The root above the leaf nodes of a text."""
    return root_node(section_nodes(paragraph_nodes(nodes)))


def leaf_digests(nodes: Column) -> Column:
    """The distinct leaf nodes of a tree, each as 64 bits of its hash."""
    return F.array_distinct(F.transform(F.flatten(F.flatten(nodes)), lambda node: F.xxhash64(node)))


def likeness(root: Column, digests: Column, other_root: Column, other_digests: Column) -> Column:
    """1 for equal roots, else the share of leaves that two trees have in common."""
    both = F.size(digests) + F.size(other_digests)
    common = F.size(F.array_intersect(digests, other_digests))
    return F.when(root == other_root, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(F.lit(2.0) * common / both)


def merkle_trees(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint, sections, paragraphs.

    NULL counts as the empty text, which is one section of one empty paragraph. Rows repeat as
    they come. Columns other than the two named are not read.
    """
    return (
        docs.select(id_column, paragraph_nodes(leaf_nodes(whole(text_column))).alias("paragraphs"))
        .withColumn("sections", section_nodes(F.col("paragraphs")))
        .select(id_column, root_node(F.col("sections")).alias("fingerprint"), "sections", "paragraphs")
    )


def locate_edits(before: DataFrame, after: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Where trees of the same id differ: id, section, paragraph, change.

    Takes two results of ``merkle_trees``. Rows with equal roots go at once, sections with
    equal nodes next, and only what is left is compared by paragraph. ``change`` is edited,
    added or removed; sections and paragraphs count from 0. An id on one side only, or NULL,
    gives nothing.
    """
    old = before.select(id_column, F.col("fingerprint").alias("r0"), F.col("sections").alias("s0"), F.col("paragraphs").alias("p0"))
    new = after.select(id_column, F.col("fingerprint").alias("r1"), F.col("sections").alias("s1"), F.col("paragraphs").alias("p1"))
    pairs = old.join(new, id_column).where(F.col("r0") != F.col("r1"))
    sections = pairs.select(
        id_column, F.posexplode(F.arrays_zip("s0", "p0", "s1", "p1")).alias("section", "z")
    ).where(~F.col("z.s0").eqNullSafe(F.col("z.s1")))
    parts = sections.select(
        id_column,
        "section",
        F.posexplode(
            F.arrays_zip(
                F.coalesce("z.p0", F.array().cast("array<string>")).alias("a"),
                F.coalesce("z.p1", F.array().cast("array<string>")).alias("b"),
            )
        ).alias("paragraph", "n"),
    )
    change = F.when(F.col("n.a").isNull(), "added").when(F.col("n.b").isNull(), "removed").otherwise("edited")
    return parts.where(~F.col("n.a").eqNullSafe(F.col("n.b"))).select(
        id_column, "section", "paragraph", change.alias("change")
    )


def with_next_text(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Each row's id, text, root and leaf digests, and with ``next_`` those of the next id.

    After the last id comes the first. Ids are cut into ranges at sampled ids. The rows at a cut
    also go to the range before it, the smallest also to the last one, so every row finds its
    successor in its own range and each text is shuffled once. Rows with the same id follow in
    the order of a hash of the text; a NULL id comes last.
    """
    rows = docs.select(F.col(id_column).alias("id"), id_order(id_column).alias("rank_id"), whole(text_column).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    cuts = splitters(rows, ["rank_id"], F.octet_length("text") + 200, partitions(docs.sparkSession))
    least = rows.agg(F.min("rank_id")).first()[0]
    cuts = [cut for cut in cuts if cut[0] != least]
    own = range_bucket(rows, ["rank_id"], cuts)
    is_cut = F.array_contains(F.from_json(F.lit(str([cut[0] for cut in cuts])), "array<bigint>"), F.col("rank_id"))
    home = F.struct(F.col("own").alias("bucket"), F.lit(0).alias("turn"), F.lit(True).alias("mine"))
    before = F.struct((F.col("own") - 1).alias("bucket"), F.lit(0).alias("turn"), F.lit(False).alias("mine"))
    around = F.struct(F.lit(len(cuts)).alias("bucket"), F.lit(1).alias("turn"), F.lit(False).alias("mine"))
    places = F.when(F.col("rank_id") == least, F.array(home, around)).when(is_cut, F.array(home, before)).otherwise(F.array(home))
    placed = (
        rows.withColumn("own", own)
        .select("id", "rank_id", "tie", "text", F.explode(places).alias("place"))
        .select("id", "rank_id", "tie", "text", "place.*")
        .repartitionById(len(cuts) + 1, F.col("bucket"))
        .withColumn("nodes", leaf_nodes(F.col("text")))
        .withColumns({"root": fingerprint(F.col("nodes")), "digests": leaf_digests(F.col("nodes"))})
        .drop("nodes")
    )
    in_order = Window.partitionBy("bucket").orderBy("turn", "rank_id", "tie")
    return placed.select(
        "id", "text", "root", "digests", "mine",
        *[F.lead(name).over(in_order).alias(f"next_{name}") for name in ("text", "root", "digests")],
    ).where("mine").drop("mine")


def compare_with_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and likenesses to both neighbours.

    The edited text has its last quarter replaced by the start of the next document. NULL
    texts count as empty; with one row the next document is the row itself; an empty table
    gives an empty result. Columns other than the two named are not read.
    """
    size = F.char_length("text")
    cut = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = (
        with_next_text(docs, id_column, text_column)
        .withColumn("edited", edited)
        .withColumn("edited_nodes", leaf_nodes(F.col("edited")))
        .select(
            F.col("id").alias(id_column),
            size.cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            F.col("root").alias("fingerprint"),
            fingerprint(F.col("edited_nodes")).alias("edited_fingerprint"),
            "next_root",
            "digests",
            leaf_digests(F.col("edited_nodes")).alias("edited_digests"),
            "next_digests",
        )
    )
    return rows.select(
        id_column,
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("digests"), F.col("edited_fingerprint"), F.col("edited_digests")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("digests"), F.col("next_root"), F.col("next_digests")).alias("near_next"),
    )
