"""Alignment of two tokenizers by lockstep merging.

Both token sequences of a text cover the same bytes. Merging them walks a pointer over each:
the tokens under the pointers overlap and are linked; the pointer whose token ends first moves
on, and where both end together the text is cut and both move. One NumPy vector holds the
pointers of all documents of a block and advances them at once, a step a link; lanes that are
done are compacted away. A long text takes several lanes, that begin at cuts.

Documents are handled in blocks of about BLOCK_CHARS characters. A block is one row: what was
counted for its documents, its distinct linked pairs of ids, and which pairs each document
links how often, as numbers into them. Only pairs are shuffled, one row a block and pair: their
documents are counted over the corpus, and the counts return to the blocks that hold them.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemeter.llm.common import let_workers_import, partitions
from grovemeter.operators.lookup import limit_hot, salted_join
from grovemeter.scratch import new_scratch_path, stage

BLOCK_CHARS = 4_000_000
#: Texts whose tokens are held at once, by characters; a longer text is alone.
BATCH_CHARS = 1_000_000
#: Tokens of A in a lane, about.
LANE = 2000

BLOCK_SCHEMA = (
    "block long, ids array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "groups_sha256 array<string>, pairs array<bigint>, holders array<int>, sizes array<int>, numbers array<int>, times array<int>"
)


class TokenBytes:
    """A tokenizer's ids of texts, and the bytes and their number of each id."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of = bytes_of
        self.sizes = np.array([len(b) for b in bytes_of], np.int64)

    def covers(self, ids: np.ndarray, data: bytes) -> bool:
        return int(self.sizes[ids].sum()) == len(data) and b"".join(map(self.bytes_of.__getitem__, ids.tolist())) == data


class RankTokens(TokenBytes):
    """A byte-level vocabulary in a file of ranks: base64 of the bytes, then the id."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.tool = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            bytes_of[rank] = token
        super().__init__(bytes_of)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of a space and each text."""
        return [np.array(self.tool.encode_ordinary(" " + text), np.int64) for text in texts]


class PieceTokens(TokenBytes):
    """A sentencepiece model with byte pieces, that puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.tool = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.tool.id_to_piece(i) for i in range(self.tool.vocab_size())]
        super().__init__(
            [bytes([int(p[3:5], 16)]) if self.tool.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        )

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.tool.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def tokenizers(ranks: str, pieces: str) -> tuple[RankTokens, PieceTokens]:
    """One of each per Python worker."""
    return RankTokens(ranks), PieceTokens(pieces)


@dataclass
class Aligned:
    """Documents' tokens and links, one after another; *_ends are bounds in the arrays.

    ``cut_a`` and ``cut_b`` tell for each token whether its end is a cut, ``link_a`` and
    ``link_b`` are places in ``a`` and ``b``, in the order of the text.
    """

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    link_ends: np.ndarray


def _lanes(a_at: np.ndarray, b_at: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bounds in A and B of the lanes of all documents, and the document of each.

    ``a_at`` and ``b_at`` are end offsets that grow over all documents, so the end of a lane is
    found by a search; only ends that both share are taken.
    """
    a_stops, b_stops, docs = [], [], []
    for doc, (low, high) in enumerate(zip(np.concatenate([[0], a_ends[:-1]]), a_ends)):
        if high == low:
            continue
        for stop in range(low + LANE, high - LANE // 2, LANE):
            ends = a_at[stop : min(stop + LANE // 2, high - 1)]
            near = np.searchsorted(b_at, ends)
            shared = np.flatnonzero(b_at[np.minimum(near, len(b_at) - 1)] == ends)
            if len(shared):
                a_stops.append(stop + shared[0] + 1)
                b_stops.append(near[shared[0]] + 1)
                docs.append(doc)
        a_stops.append(high)
        b_stops.append(b_ends[doc])
        docs.append(doc)
    a_stops, b_stops = np.array(a_stops, np.int64), np.array(b_stops, np.int64)
    return a_stops, b_stops, np.array(docs, np.int64)


def lockstep(a: list[np.ndarray], b: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray) -> Aligned:
    """Align documents given as their ids; the tokens' bytes are equally many in both.

    No token may be empty. A step moves every lane by one link.
    """
    a_ends, b_ends = np.cumsum([len(x) for x in a]), np.cumsum([len(x) for x in b])
    all_a = np.concatenate(a) if a else np.empty(0, np.int64)
    all_b = np.concatenate(b) if b else np.empty(0, np.int64)
    a_at, b_at = np.cumsum(a_sizes[all_a]), np.cumsum(b_sizes[all_b])
    a_stop, b_stop, lane_doc = _lanes(a_at, b_at, a_ends, b_ends)
    i, j = np.concatenate([[0], a_stop])[:-1], np.concatenate([[0], b_stop])[:-1]
    room = (a_stop - i) + (b_stop - j)  # more than the links of a lane
    base = np.cumsum(room) - room
    link_a, link_b = np.full(room.sum(), -1, np.int64), np.empty(room.sum(), np.int64)
    cut_a, cut_b = np.zeros(len(all_a), bool), np.zeros(len(all_b), bool)
    at = base.copy()
    while len(i):
        link_a[at], link_b[at] = i, j
        ends_a, ends_b = a_at[i], b_at[j]
        moves_a, moves_b = ends_a <= ends_b, ends_b <= ends_a
        both = moves_a & moves_b
        cut_a[i[both]] = True
        cut_b[j[both]] = True
        i, j, at = i + moves_a, j + moves_b, at + 1
        going = i < a_stop
        if not going.all():
            i, j, at, a_stop = i[going], j[going], at[going], a_stop[going]
    used = link_a >= 0
    per_lane = np.add.reduceat(used, base) if len(base) else np.empty(0, np.int64)
    links = np.bincount(lane_doc, per_lane, len(a)).astype(np.int64) if len(lane_doc) else np.zeros(len(a), np.int64)
    return Aligned(all_a, all_b, a_ends, b_ends, cut_a, cut_b, link_a[used], link_b[used], np.cumsum(links))


@lru_cache(maxsize=1)
def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of all ids below ``size``, from the left, and their number."""
    texts = [str(n).encode() for n in range(size)]
    width = len(texts[-1]) if texts else 1
    table = np.frombuffer(b"".join(t.ljust(width + 1) for t in texts), np.uint8).reshape(size, width + 1)
    return table, np.array([len(t) for t in texts], np.int64)


def group_texts(aligned: Aligned, ids: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document: its groups of tokens between cuts."""
    group_a = np.cumsum(aligned.cut_a) - aligned.cut_a
    group_b = np.cumsum(aligned.cut_b) - aligned.cut_b
    groups = int(aligned.cut_a.sum())
    in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    place_a = np.arange(len(aligned.a)) + (np.cumsum(in_b) - in_b)[group_a]
    place_b = np.arange(len(aligned.b)) + np.cumsum(in_a)[group_b]
    total = len(aligned.a) + len(aligned.b)
    order, after = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    order[place_a], order[place_b] = aligned.a, aligned.b
    after[place_a[aligned.cut_a]] = ord("|")
    after[place_b[aligned.cut_b]] = ord(";")
    table, widths = _decimals(ids)
    cells, width = table[order], widths[order]
    cells[np.arange(total), width] = after
    data = cells[np.arange(table.shape[1]) <= width[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(width + 1)])[aligned.a_ends + aligned.b_ends] if total else aligned.a_ends
    return [data[low : max(high - 1, low)] for low, high in zip([0, *ends[:-1]], ends)]


def encode_both(texts: list[str], ranks: str, pieces: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The ids of texts in A and B; none where a text is empty or one of them changes it."""
    tool_a, tool_b = tokenizers(ranks, pieces)
    a, b, none = tool_a.encode(texts), tool_b.encode(texts), np.empty(0, np.int64)
    for n, text in enumerate(texts):
        data = (" " + text).encode()
        if not text or not tool_a.covers(a[n], data) or not tool_b.covers(b[n], data):
            a[n] = b[n] = none
    return a, b


def align_texts(texts: list[str], ranks: str, pieces: str) -> Aligned:
    a, b = encode_both(texts, ranks, pieces)
    tool_a, tool_b = tokenizers(ranks, pieces)
    return lockstep(a, b, tool_a.sizes, tool_b.sizes)


def _batches(texts: Iterator[str], limit: int) -> Iterator[list[str]]:
    """Runs of texts of at most ``limit`` characters together, or of one text."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def alignments(docs: DataFrame, ranks: str, pieces: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, a, b (ids), cuts_a, cuts_b (tokens before each cut),
    links_a, links_b (places of the linked tokens, from 0).

    Texts that are NULL, empty or changed by a tokenizer have empty arrays.
    """
    narrow = docs.select(id_column, text_column)
    kind = dict(narrow.dtypes)[id_column]
    names = ["a", "b", "cuts_a", "cuts_b", "links_a", "links_b"]
    let_workers_import(docs.sparkSession)

    def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for texts in _batches((t or "" for t in batch.column(1).to_pylist()), BATCH_CHARS):
                found = align_texts(texts, ranks, pieces)
                bounds = [found.a_ends, found.b_ends]
                starts = [np.concatenate([[0], ends[:-1]]) for ends in bounds]
                columns = [lists(found.a, found.a_ends), lists(found.b, found.b_ends)]
                for cut, ends, begin in zip((found.cut_a, found.cut_b), bounds, starts):
                    at = np.flatnonzero(cut)
                    columns.append(lists(at + 1 - begin[np.searchsorted(ends, at, "right")], np.searchsorted(at, ends)))
                doc = np.repeat(np.arange(len(texts)), np.diff(found.link_ends, prepend=0))
                for link, begin in zip((found.link_a, found.link_b), starts):
                    columns.append(lists(link - begin[doc], found.link_ends))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(texts)), *columns], ["id", *names])
                low += len(texts)

    schema = f"id {kind}, " + ", ".join(f"{name} array<int>" for name in names)
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def _summary(texts: list[str], ranks: str, pieces: str) -> tuple[list, ...]:
    """n_a, n_b, n_groups, n_links, groups_sha256 of each text, then its distinct pairs and their numbers of links."""
    found = align_texts(texts, ranks, pieces)
    tool_a, tool_b = tokenizers(ranks, pieces)
    size_a, size_b = len(tool_a.sizes), len(tool_b.sizes)
    n_a, n_b, n_links = (np.diff(ends, prepend=0) for ends in (found.a_ends, found.b_ends, found.link_ends))
    cuts = np.concatenate([[0], np.cumsum(found.cut_a)])[found.a_ends] if len(found.a) else found.a_ends
    shas = [hashlib.sha256(text).hexdigest() if n else "" for text, n in zip(group_texts(found, max(size_a, size_b)), n_a)]
    doc = np.repeat(np.arange(len(texts)), n_links)
    keys = (doc * size_a + found.a[found.link_a]) * size_b + found.b[found.link_b]
    keys, times = np.unique(keys, return_counts=True)
    sizes = np.bincount(keys // (size_a * size_b), minlength=len(texts))
    return n_a, n_b, np.diff(cuts, prepend=0), n_links, shas, keys % (size_a * size_b), times, sizes


def _one(values, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _blocks(narrow: DataFrame, kind: str, ranks: str, pieces: str) -> DataFrame:
    """The rows of blocks; a block holds documents of one partition, in their order."""
    schema = BLOCK_SCHEMA.format(kind=kind)

    def block_of(number: int, ids: list[pa.Array], parts: list[tuple]) -> pa.RecordBatch:
        n_a, n_b, n_groups, n_links, shas, keys, times, sizes = (np.concatenate(x) for x in zip(*parts))
        pairs, numbers = np.unique(keys, return_inverse=True)
        whole = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole),
                *[_one(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)],
                _one(shas.tolist(), pa.string()),
                _one(pairs, pa.int64()),
                _one(np.bincount(numbers, minlength=len(pairs)), pa.int32()),
                _one(sizes, pa.int32()),
                _one(numbers, pa.int32()),
                _one(times, pa.int32()),
            ],
            ["block", "ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "holders", "sizes", "numbers", "times"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, parts, size = [], [], 0
        for batch in batches:
            low = 0
            for texts in _batches((batch.column(1)[n].as_py() or "" for n in range(batch.num_rows)), BATCH_CHARS):
                ids.append(batch.column(0).slice(low, len(texts)))
                parts.append(_summary(texts, ranks, pieces))
                low += len(texts)
                size += sum(map(len, texts))
                if size >= BLOCK_CHARS:
                    yield block_of(number, ids, parts)
                    number, ids, parts, size = number + 1, [], [], 0
        if ids:
            yield block_of(number, ids, parts)

    return narrow.mapInArrow(run, schema)


def _scores(kind: str, id_column: str):
    """Blocks joined to what their pairs count, to one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name: batch.column(batch.schema.get_field_index(name))[row].values
                array = lambda name: cell(name).to_numpy(zero_copy_only=False)
                numbers, times, sizes = array("numbers"), array("times").astype(np.int64), array("sizes")
                docs = np.repeat(np.arange(len(sizes)), sizes)
                counts = np.zeros(len(array("pairs")), np.int64)
                best = np.zeros(len(counts), bool)
                if len(counts):
                    known = cell("known")
                    at = known.field("number").to_numpy(zero_copy_only=False)
                    counts[at] = known.field("docs").to_numpy(zero_copy_only=False)
                    best[at] = known.field("best").to_numpy(zero_copy_only=False)
                n_best, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                np.add.at(n_best, docs, times * best[numbers])
                np.add.at(total, docs, times * counts[numbers])
                yield pa.RecordBatch.from_arrays(
                    [cell("ids"), *[cell(c) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(n_best), pa.array(total), cell("groups_sha256")],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    schema = f"`{id_column}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return run, schema


def pair_counts(blocks: DataFrame, b_size: int) -> DataFrame:
    """pair, blocks (that hold it), docs (that link it), best (none of its A id has more): staged."""
    held = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.holders").alias("n"))
    counted = held.groupBy("pair").agg(F.sum("n").cast("long").alias("docs"), F.count(F.lit(1)).alias("blocks"))
    counted = stage(counted, "align-pairs").withColumn("a", F.expr(f"pair div {b_size}"))
    most = counted.groupBy("a").agg(F.max("docs").alias("most"))  # a row for each id of A at most
    joined = counted.join(F.broadcast(most), "a")
    return stage(joined.select("pair", "blocks", "docs", (F.col("docs") == F.col("most")).alias("best")), "align-counts")


def token_alignment(docs: DataFrame, ranks: str, pieces: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text with the vocabulary in ``ranks``, B the text with the model
    in ``pieces``, both paths that every executor has. The count of a pair of ids is how many
    rows link it anywhere; ``count_sum`` sums it over the row's links, ``n_best`` counts links
    whose count is the highest of their A id, ties included. ``groups_sha256`` digests the
    groups between cuts. Texts that are NULL, empty or changed by a tokenizer have zeros and an
    empty digest. Rows that repeat, with their id or without one, count each; an empty table
    gives an empty result. Columns other than the two named are not read.
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    narrow = docs.select(id_column, text_column)
    kind = dict(narrow.dtypes)[id_column]
    buckets = partitions(spark)
    # bucketed by block, so that blocks stay where they are when counts come to them
    name = f"align_{uuid.uuid4().hex}"
    writer = _blocks(narrow, kind, ranks, pieces).write.format("parquet").bucketBy(buckets, "block")
    writer.option("path", new_scratch_path(spark, "align-blocks")).saveAsTable(name)
    blocks = spark.table(name)

    counts = pair_counts(blocks, len(tokenizers(ranks, pieces)[1].sizes))
    held = blocks.select("block", F.posexplode("pairs").alias("number", "pair"))
    hot = stage(limit_hot(counts, ["pair"], "blocks"), "align-hot")
    met = salted_join(held, counts.select("pair", "docs", "best"), ["pair"], "inner", hot)
    known = stage(met.groupBy("block").agg(F.collect_list(F.struct("number", "docs", "best")).alias("known")), "align-known")
    run, schema = _scores(kind, id_column)
    scored = stage(blocks.drop("holders").join(known, "block", "left").mapInArrow(run, schema), "align-scores")
    spark.sql(f"DROP TABLE {name}")
    return scored
