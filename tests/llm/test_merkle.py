"""Fingerprints, likenesses and located edits."""

import hashlib
import re

from odd import documents, empty, texts
from pyspark.sql import functions as F

from grovemeter.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


PIECE = re.compile(merkle.PIECE.replace(r"\x{2E80}-\x{10FFFF}", "\u2e80-\U0010ffff"))


def plain_leaves(paragraph):
    found, last = [], []
    for piece in PIECE.findall(paragraph):
        ends = hashlib.md5(piece.encode()).hexdigest() < "4"
        last.append(piece + "\n" * ends)
        if ends or len(last) == merkle.LEAF_WORDS:
            found.append("".join(last))
            last = []
    return found + ["".join(last)] * bool(last)


def plain_tree(text):
    nodes = [[[sha(leaf) for leaf in plain_leaves(p)] for p in s.split("\n")] for s in text.split("\n\n")]
    sections = [sha("section:" + ",".join(sha("paragraph:" + ",".join(p)) for p in s)) for s in nodes]
    return sha("root:" + ",".join(sections)), {leaf for s in nodes for p in s for leaf in p}


def plain_root(text):
    return plain_tree(text)[0]


def plain_like(a, b):
    if a == b:
        return 1.0
    x, y = plain_tree(a)[1], plain_tree(b)[1]
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def test_leaves_make_up_the_text(spark):
    words = ["a" * 50, "日本語の文章です。" * 9, " \t lead", "same " * 100, "x", "", "é\x0b\u3000mark"]
    found = spark.createDataFrame([(w,) for w in words], "t string").select("t", merkle.leaves(F.col("t")).alias("leaves")).collect()
    for row in found:
        assert row.leaves == plain_leaves(row.t)
        assert "".join(row.leaves).replace("\n", "") == row.t
        assert all(len(PIECE.findall(leaf)) <= merkle.LEAF_WORDS for leaf in row.leaves)


def test_a_word_put_in_or_out_changes_one_leaf(spark):
    long = " ".join(f"word{i * i % 9973}" for i in range(200))
    wide = "".join(chr(0x4E00 + i * i % 9973) for i in range(200))
    rows = [(1, long), (2, long.split(" ", 1)[1]), (3, long), (4, long.replace(" ", " new ", 1)), (5, wide), (6, wide[1:]), (7, "other")]
    docs = documents(spark, [(i, text, "en", "a") for i, text in rows])
    near = {r.doc_id: r.near_next for r in merkle.compare_with_edits(docs).collect()}
    assert min(near[1], near[2], near[3], near[5]) > 0.9 and near[6] == 0.0


def test_comparison_equals_the_plain_version(spark):
    rows = [row for row in texts() if row[0] is not None and row[0] != 4] + [(-3, "first of all", "en", "a"), (90, "last", "en", "a")]
    found = {r.doc_id: r for r in merkle.compare_with_edits(documents(spark, rows)).collect()}
    ordered = sorted((row[0], row[1] or "") for row in rows)
    assert len(found) == len(ordered)
    for at, (doc_id, text) in enumerate(ordered):
        after = ordered[(at + 1) % len(ordered)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        row = found[doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(text), sha(edited))
        assert (row.fingerprint, row.edited_fingerprint) == (plain_root(text), plain_root(edited))
        assert abs(row.near_edited - plain_like(text, edited)) < 1e-12
        assert abs(row.near_next - plain_like(text, after)) < 1e-12


def test_many_ranges_find_every_successor(spark):
    docs = documents(spark, [(i, f"text {i}", "en", "a") for i in range(500)])
    found = merkle.with_next_text(docs, "doc_id", "text").select("id", "next_text").collect()
    assert {r.id: r.next_text for r in found} == {i: f"text {(i + 1) % 500}" for i in range(500)}


def test_repeated_and_missing_ids_return_every_row(spark):
    assert merkle.compare_with_edits(documents(spark)).count() == len(texts())


def test_edits_are_located(spark):
    before = documents(spark, [(1, "a\nb\n\nc", "en", "a"), (2, "same", "en", "a"), (3, "x\n\ny", "en", "a"), (4, None, "en", "a")])
    after = documents(spark, [(1, "a\nB\n\nc\nd", "en", "a"), (2, "same", "en", "a"), (3, "x", "en", "a"), (4, "", "en", "a")])
    found = merkle.locate_edits(merkle.merkle_trees(before), merkle.merkle_trees(after)).collect()
    assert sorted(tuple(r) for r in found) == [(1, 0, 1, "edited"), (1, 1, 1, "added"), (3, 1, 0, "removed")]


def test_one_row_and_no_row(spark):
    row = merkle.compare_with_edits(documents(spark, [(1, "abcdefgh", "en", "a")])).first()
    assert row.edited_sha256 == sha("abcdefab") and row.near_next == 1.0
    assert merkle.compare_with_edits(empty(spark)).count() == 0


def test_no_python_on_the_native_paths(spark):
    from grovemeter.llm import exact_dedup

    for frame in (merkle.compare_with_edits(documents(spark)), exact_dedup.exact_duplicates(documents(spark))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
