"""Byte-pair encoding and decoding with a published vocabulary, by a contiguous rank array.

A short word is one array of parts and one array of the ranks of adjacent parts. The smallest
rank is found by a scan, the boundary behind it is deleted, and the two ranks beside it are
looked up anew, until no pair has a rank. For long words (over SHORT parts) the scan is
replaced by a heap over the same arrays, so a word of a megabyte does not cost its square.
Words repeat, so each task keeps the codes of the last words it met, CACHE_WORDS at most.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from grovemeter.llm.common import let_workers_import

SHORT = 256
CACHE_WORDS = 200_000
NEVER = 1 << 40
#: Characters of a batch of texts that are coded together.
BATCH_CHARS = 500_000

#: Fixed: how the published byte-level vocabularies cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary file.

    Printable bytes stand for themselves; the others take the characters from 256 on.
    """
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(byte) if byte in plain else chr(next(others)) for byte in range(256)]


class Codec:
    """Vocabulary and merge ranks of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        vocabulary = described["model"]["vocab"]
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        self.first = [vocabulary[letter] for letter in byte_letters()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(described["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])
        self.bytes_of = {code: bytes(byte_of[c] for c in token) for token, code in vocabulary.items()}
        self.special = {token["content"]: token["id"] for token in described["added_tokens"]}
        self.bytes_of |= {code: text.encode() for text, code in self.special.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None
        self.cut = regex.compile(WORDS)
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}
        self.packed: dict[str, bytes] = {}

    def _ranks(self, parts: list[int]) -> list[int]:
        merges = self.merges
        return [merges[pair][0] if pair in merges else NEVER for pair in zip(parts, parts[1:])]

    def merge_word(self, word: bytes) -> list[int]:
        parts = [self.first[byte] for byte in word]
        return self._merge_short(parts) if len(parts) <= SHORT else self._merge_long(parts)

    def _merge_short(self, parts: list[int]) -> list[int]:
        merges, ranks = self.merges, self._ranks(parts)
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            at = ranks.index(least)
            parts[at] = merges[parts[at], parts[at + 1]][1]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = merges.get((parts[at], parts[at + 1]), (NEVER,))[0]
            if at:
                ranks[at - 1] = merges.get((parts[at - 1], parts[at]), (NEVER,))[0]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        merges, ranks, size = self.merges, self._ranks(parts), len(parts)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(rank, at) for at, rank in enumerate(ranks) if rank != NEVER]
        heapq.heapify(heap)
        ranks.append(NEVER)

        def look(at: int) -> None:
            right = after[at]
            ranks[at] = merges.get((parts[at], parts[right]), (NEVER,))[0] if right < size else NEVER
            if ranks[at] != NEVER:
                heapq.heappush(heap, (ranks[at], at))

        while heap:
            rank, at = heapq.heappop(heap)
            if ranks[at] != rank:
                continue
            gone = after[at]
            parts[at] = merges[parts[at], parts[gone]][1]
            ranks[gone] = NEVER
            after[at] = after[gone]
            if after[gone] < size:
                before[after[gone]] = at
            look(at)
            if before[at] >= 0:
                look(before[at])
        out, at = [], 0
        while at < size:
            out.append(parts[at])
            at = after[at]
        return out

    def _word(self, word: str) -> tuple[tuple[int, ...], str]:
        found = self.known.get(word)
        if found is None:
            codes = self.merge_word(word.encode())
            found = tuple(codes), ",".join(map(str, codes))
            if len(word) <= SHORT:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                self.known[word] = found
        return found

    def _words(self, text: str) -> Iterator[tuple[tuple[int, ...], str]]:
        pieces = self.special_at.split(text) if self.special_at else [text]
        for piece in pieces:
            if piece in self.special:
                code = self.special[piece]
                yield (code,), str(code)
            else:
                yield from map(self._word, self.cut.findall(piece))

    def encode(self, text: str) -> list[int]:
        return [code for codes, _ in self._words(text) for code in codes]

    def encode_joined(self, text: str) -> tuple[list[int], str]:
        """The codes, and their decimal forms joined by commas."""
        ids: list[int] = []
        joined: list[str] = []
        for codes, decimal in self._words(text):
            ids += codes
            joined.append(decimal)
        return ids, ",".join(joined)

    def _packed_word(self, word: str) -> bytes:
        found = self.packed.get(word)
        if found is None:
            found = np.array(self.merge_word(word.encode()), "<i4").tobytes()
            if len(word) <= SHORT:
                if len(self.packed) >= CACHE_WORDS:
                    self.packed.clear()
                self.packed[word] = found
        return found

    def encode_packed(self, text: str) -> bytes:
        """The codes as little-endian 32-bit numbers."""
        parts = []
        for piece in self.special_at.split(text) if self.special_at else [text]:
            if piece in self.special:
                parts.append(np.array([self.special[piece]], "<i4").tobytes())
            else:
                parts += map(self._packed_word, self.cut.findall(piece))
        return b"".join(parts)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per Python worker and file."""
    return Codec(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, as codes take ten times their room as Python numbers."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def encode(docs: DataFrame, vocabulary: str, text_column: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the column ``into``: the codes of the whole text, array<int>.

    ``vocabulary`` is the path of a byte-level tokenizer file that every executor has. NULL
    and empty texts have no codes; a special token's string in a text becomes its code. A
    column of that name in ``docs`` is replaced.
    """
    docs = docs.drop(into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))])
    position = docs.columns.index(text_column)
    let_workers_import(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary)
        for batch in slices(batches):
            codes = [tool.encode(text or "") for text in batch.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int32()))], [*batch.schema.names, into])

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, vocabulary: str, ids_column: str = "ids", into: str = "text") -> DataFrame:
    """``coded`` with the column ``into``: the text of its codes; NULL codes have none.

    A column of that name in ``coded`` is replaced.
    """
    coded = coded if into == ids_column else coded.drop(into)
    schema = T.StructType([*coded.schema.fields, T.StructField(into, T.StringType())])
    position = coded.columns.index(ids_column)
    let_workers_import(coded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary)
        for batch in slices(batches):
            texts = [None if ids is None else tool.decode(ids) for ids in batch.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    return coded.mapInArrow(run, schema)


def encode_with_check(docs: DataFrame, vocabulary: str, text_column: str = "text") -> DataFrame:
    """``docs`` with ids (array<int>), n_tokens and decoded_sha256 in place of the text.

    Encodes and decodes in one pass, a batch of at most BATCH_CHARS characters, or one text, at a
    time; the digest is of the decoded text in UTF-8. NULL and empty texts have no codes. Columns of
    these names in ``docs`` are replaced.
    """
    added = ["ids", "n_tokens", "decoded_sha256"]
    given = [c for c in docs.columns if c not in (*added, text_column)]
    docs = docs.select(*given, text_column)
    kinds = [T.ArrayType(T.IntegerType()), T.LongType(), T.StringType()]
    schema = T.StructType([*docs.schema.fields[:-1], *[T.StructField(name, kind) for name, kind in zip(added, kinds)]])
    let_workers_import(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary)
        for batch in batches:
            low, rows = 0, batch.num_rows
            while low < rows:
                codes, shas, size, high = [], [], 0, low
                while high < rows and (high == low or size < BATCH_CHARS):
                    text = batch.column(len(given))[high].as_py() or ""
                    codes.append(tool.encode_packed(text))
                    shas.append(hashlib.sha256(tool.decode(np.frombuffer(codes[-1], "<i4").tolist()).encode()).hexdigest())
                    size, high = size + len(text), high + 1
                counts = np.array([len(c) // 4 for c in codes], np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(codes), "<i4")))
                kept = [batch.column(n).slice(low, high - low) for n in range(len(given))]
                yield pa.RecordBatch.from_arrays([*kept, ids, pa.array(counts), pa.array(shas)], [*given, *added])
                low = high

    return docs.mapInArrow(run, schema)


def digest_codes(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode and decode every text: id, n_tokens, ids_sha256, decoded_sha256.

    NULL counts as the empty text, whose joined codes are the empty string. Columns other than
    the two named are not read; rows repeat as they come.
    """
    narrow = docs.select(id_column, text_column)
    kind = dict(narrow.dtypes)[id_column]
    let_workers_import(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary)
        for batch in slices(batches):
            counts, coded, back = [], [], []
            for text in batch.column(1).to_pylist():
                ids, joined = tool.encode_joined(text or "")
                counts.append(len(ids))
                coded.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(tool.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(back)],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return narrow.mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
