"""Packing documents into sequences: first-fit decreasing over a tournament tree of capacities.

Every document is encoded whole and cut into pieces of a sequence's length; a piece that fills
a sequence is one. The shorter last pieces are dealt into random groups of about GROUP_PIECES,
and each group is packed on its own: pieces go, longest first, into the first bin with room.
The tree's leaves hold the room of each bin and its inner nodes the larger of two, so that bin
is found by walking down. Where lengths leave more than MAX_PADDING of a group empty, its
emptiest bins are taken apart and poured into the room of the others, cutting pieces as needed.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemeter.llm.bpe import byte_letters
from grovemeter.llm.common import BLANK, let_workers_import
from grovemeter.scratch import stage

CAPACITY = 2048
END_ID = 1
#: Pieces of a group, on average; each is shorter than a sequence, so a group is bounded.
GROUP_PIECES = 4096
MAX_PADDING = 0.005
SEED = 5

#: Words, and chunks that are not simple, a Python worker remembers, and the longest of them.
CACHE_WORDS = 500_000
CACHED_CHARS = 64
#: Characters of a text that are encoded at a time, and ids in a batch of results.
SECTION = 1 << 20
BATCH_IDS = 1 << 21

BLANKS = re.compile(BLANK + "+")
#: Latin and Cyrillic letters that normal forms leave as they are, with capitals of one letter.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſЀ-ҁҊ-ӿ"
#: Texts of these, of ASCII digits and marks. Added tokens begin with "<|".
SIMPLE = re.compile(rf"[\x20-~\x09-\x0D{LETTERS}]*")
ADDED = "<|"


def is_simple(text: str) -> bool:
    return ADDED not in text and SIMPLE.fullmatch(text) is not None


class WordCodes(dict):
    """The ids of words, as little-endian 32-bit numbers; each is asked for once."""

    def __init__(self, ids_of: Callable[[str], list[int]]):
        self.ids_of = ids_of

    def __missing__(self, word: str) -> bytes:
        codes = np.array(self.ids_of(word), "<u4").tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = codes
        return codes


class TextCodes:
    """The ids of whole texts under a tokenizer that drops white space.

    No token may hold white space, so that a text's ids are those of its chunks in order. If
    the tokenizer's file says that it lowers letters and encodes what a pattern finds, simple
    texts are lowered and cut here, and the tokenizer's model is asked for their words. All
    else is left to the tokenizer, a chunk at a time.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(vocabulary)
        tool.no_truncation()
        tool.no_padding()
        letters = byte_letters()

        def word_ids(word: str) -> list[int]:
            spelt = word if word.isascii() else "".join(map(letters.__getitem__, word.encode()))
            return [token.id for token in tool.model.tokenize(spelt)]

        self.words = WordCodes(word_ids)
        self.chunks = WordCodes(lambda chunk: tool.encode(chunk, add_special_tokens=False).ids)
        described = json.loads(tool.to_str())
        cutting, normal = (described.get(key) or {} for key in ("pre_tokenizer", "normalizer"))
        split, *rest = cutting.get("pretokenizers") or [{}]
        steps = [step["type"] for step in [*(normal.get("normalizers") or []), split, *rest] if step]
        known = steps == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
        known = known and split["invert"] and split["behavior"] == "Removed" and not (rest[0]["add_prefix_space"] or rest[0]["use_regex"])
        # in simple texts these are all letters and numbers
        pattern = split["pattern"]["Regex"].replace(r"\p{L}", LETTERS).replace(r"\p{N}", "0-9") if known else ""
        self.cut = re.compile(pattern) if known else None

    def _section(self, text: str) -> bytes:
        if self.cut and is_simple(text):
            return b"".join(map(self.words.__getitem__, self.cut.findall(text.lower())))
        chunks = BLANKS.split(text)
        if self.cut:
            return b"".join([self._section(c) if is_simple(c) else self.chunks[c] for c in chunks if c])
        return b"".join([self.chunks[c] for c in chunks if c])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, in sections cut at white space."""
        if len(text) <= SECTION:
            return self._section(text)
        parts, low = [], 0
        while low < len(text):
            found = BLANKS.search(text, low + SECTION)
            high = found.start() if found else len(text)
            parts.append(self._section(text[low:high]))
            low = high
        return b"".join(parts)


@lru_cache(maxsize=2)
def text_codes(vocabulary: str) -> TextCodes:
    """One per Python worker and file."""
    return TextCodes(vocabulary)


def _id_lists(parts: Sequence[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def cut_documents(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """id, start, length, doc_tokens, ids, ids_crc32 of each piece of each document, and a piece_id.

    A document is the ids of its whole text and ``end_id``, cut into pieces of ``capacity`` ids
    and a last one of 1 to ``capacity``; NULL counts as the empty text. ``doc_tokens`` counts
    all its ids, ``ids_crc32`` is the CRC-32 of the piece's ids as little-endian unsigned
    32-bit numbers. The result is a staged table.
    """
    narrow = docs.select(id_column, text_column)
    kind = dict(narrow.dtypes)[id_column]
    end = np.array([end_id], "<u4").tobytes()
    names = ["id", "start", "length", "doc_tokens", "ids", "ids_crc32"]
    let_workers_import(docs.sparkSession)

    def batch_of(ids: pa.Array, rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        of, starts, totals, parts = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(of, pa.int64())),
                pa.array(starts, pa.int64()),
                pa.array([len(p) // 4 for p in parts], pa.int64()),
                pa.array(totals, pa.int64()),
                _id_lists(parts),
                pa.array([zlib.crc32(p) for p in parts], pa.int64()),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = text_codes(vocabulary)
        for batch in batches:
            rows, held = [], 0
            for number in range(batch.num_rows):
                data = codes.encode(batch.column(1)[number].as_py() or "") + end
                total = len(data) // 4
                for start in range(0, total, capacity):
                    rows.append((number, start, total, data[4 * start : 4 * (start + capacity)]))
                    held += capacity
                    if held >= BATCH_IDS:
                        yield batch_of(batch.column(0), rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(batch.column(0), rows)

    schema = f"id {kind}, start long, length long, doc_tokens long, ids array<int>, ids_crc32 long"
    pieces = narrow.mapInArrow(run, schema).withColumn("piece_id", F.monotonically_increasing_id())
    return stage(pieces, "pack-pieces").withColumnRenamed("id", id_column)


class CapacityTree:
    """The room left in a row of bins, as a tournament: a node holds the larger of its two."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> int:
        """Put ``length`` into the first bin with room for it; its number."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        room[node] -= length
        found, node = node - self.leaves, node >> 1
        while node:
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left > right else right
            node >>= 1
        return found


def first_fit_decreasing(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """The numbers of the pieces in each bin, longest first; ties by number."""
    tree, bins = CapacityTree(len(lengths), capacity), []
    for piece in sorted(range(len(lengths)), key=lambda p: -lengths[p]):
        at = tree.place(lengths[piece])
        if at == len(bins):
            bins.append([])
        bins[at].append(piece)
    return bins


def fill(lengths: Sequence[int], bins: list[list[int]], capacity: int, max_padding: float) -> list[list[tuple[int, int, int]]]:
    """(piece, start in it, length) in each bin, with as few bins as ``max_padding`` asks for.

    The emptiest bins go; their pieces fill the largest rooms of the others, and are cut where
    a room ends.
    """
    total = sum(lengths)
    wanted = max(-(-total // capacity), int(total / (capacity * (1 - max_padding))))
    by_room = sorted(bins, key=lambda pieces: sum(lengths[p] for p in pieces))
    spare = max(len(bins) - wanted, 0)
    kept = [[(p, 0, lengths[p]) for p in pieces] for pieces in by_room[spare:]]
    pouring = iter(kept)
    room = 0
    for piece in (p for pieces in by_room[:spare] for p in pieces):
        start = 0
        while start < lengths[piece]:
            while not room:
                into = next(pouring)
                room = capacity - sum(length for _, _, length in into)
            part = min(room, lengths[piece] - start)
            into.append((piece, start, part))
            start, room = start + part, room - part
    return kept


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, max_padding: float = MAX_PADDING, with_ids: bool = True) -> DataFrame:
    """``pieces``, cut further where needed, with ``sequence_id`` and ``offset``.

    ``pieces`` is a staged table with start, length (1 to ``capacity``), ids and ids_crc32,
    and a unique piece_id that names the sequence it begins. Offsets in a sequence are gapless
    from 0. All other columns are carried along.
    """
    spark = pieces.sparkSession
    let_workers_import(spark)
    given = [c for c in pieces.columns if with_ids or c != "ids"]
    whole = pieces.where(F.col("length") == capacity).select(
        *given, F.col("piece_id").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // GROUP_PIECES))

    def pack_group(table: pa.Table) -> pa.Table:
        table = table.drop_columns("group").sort_by("piece_id").combine_chunks()
        lengths = table.column("length").to_pylist()
        bins = fill(lengths, first_fit_decreasing(lengths, capacity), capacity, max_padding)
        place = np.array([part for parts in bins for part in parts], np.int64).reshape(-1, 3)
        piece, inside, length = place.T
        sizes = np.array([len(parts) for parts in bins], np.int64)
        ends = np.cumsum(length)
        before = np.concatenate([[0], ends[np.cumsum(sizes)[:-1] - 1]]) if len(sizes) else ends
        firsts = np.array([parts[0][0] for parts in bins], np.int64)
        ids = table.column("ids").combine_chunks()
        begins = ids.offsets.to_numpy().astype(np.int64)[piece] + inside
        data = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        parts = [data[b : b + n].tobytes() for b, n in zip(begins, length)]
        new = {
            "start": pa.array(table.column("start").to_numpy()[piece] + inside),
            "length": pa.array(length),
            "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
            "sequence_id": pa.array(np.repeat(table.column("piece_id").to_numpy()[firsts], sizes)),
            "offset": pa.array(ends - length - np.repeat(before, sizes)),
        }
        if with_ids:
            new["ids"] = _id_lists(parts)
        columns = [*given, "sequence_id", "offset"]
        return pa.table([new[c] if c in new else table.column(c).take(pa.array(piece)) for c in columns], columns)

    schema = ", ".join(f"`{name}` {kind}" for name, kind in whole.dtypes)
    dealt = short.withColumn("group", F.pmod(F.xxhash64(F.col("piece_id"), F.lit(SEED)), F.lit(groups)))
    return whole.unionByName(dealt.groupBy("group").applyInArrow(pack_group, schema))


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    max_padding: float = MAX_PADDING,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """The pieces of all documents, packed: id, start, length, doc_tokens, ids, ids_crc32,
    piece_id, sequence_id, offset.

    ``vocabulary`` is the path, on every executor, of a tokenizer file whose tokens hold no
    white space. Every id of every document lies in exactly one piece. NULL and empty texts are
    documents of ``end_id`` alone; rows that repeat, with their id or without one, are packed
    each on its own; an empty table gives an empty result. Columns other than the two named are
    not read. With ``with_ids`` false the ids are left out, their checksums stay.
    """
    pieces = cut_documents(docs, vocabulary, end_id, capacity, id_column, text_column)
    return pack_pieces(pieces, capacity, max_padding, with_ids)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids, n_tokens of each sequence of packed pieces.

    Ids are padded to ``capacity`` with ``pad_id``, except where their number is a power of two.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    count = F.size("ids")
    missing = F.when(F.bit_count(count) == 1, 0).otherwise(F.lit(capacity) - count)
    return joined.select(
        "sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), missing)).alias("ids"), count.cast("long").alias("n_tokens")
    )
