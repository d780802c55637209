"""Packing: every id once, offsets gapless, little padding, the tree against a plain search."""

import collections
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from odd import documents, empty, texts
from tokenizers import Tokenizer

from grovemeter.llm import packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tool():
    return Tokenizer.from_file(WORDS)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check(tool, rows, packed, capacity=packing.CAPACITY):
    """Pieces cover each row's ids once; returns the ids in use of each sequence."""
    wanted = collections.Counter()
    for row in rows:
        ids = [*tool.encode(row[1] or "", add_special_tokens=False).ids, 1]
        wanted[row[0], tuple(ids)] += 1
    by_doc = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for p in packed:
        assert p.length == len(p.ids) and p.ids_crc32 == crc(p.ids) and 1 <= p.length
        by_doc[p.doc_id, p.doc_tokens].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    for (doc_id, total), pieces in by_doc.items():
        # rows that repeat give equal sets of starts only up to where they are cut
        same = [ids for (d, ids), n in wanted.items() if d == doc_id and len(ids) == total for _ in range(n)]
        covered = collections.Counter(i for p in pieces for i in range(p.start, p.start + p.length))
        assert covered == collections.Counter({i: len(same) for i in range(total)})
        assert all(any(tuple(p.ids) == ids[p.start : p.start + p.length] for ids in same) for p in pieces)
    assert sum(n * len(ids) for (_, ids), n in wanted.items()) == sum(p.length for p in packed)
    used = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        used.append(at)
    return used


def test_odd_rows_are_packed_whole(spark, tool):
    rows = texts() + [(20, "word " * 9000 + "<|startoftext|> mid<|endoftext|>dle", "en", "a"), (21, "x" * 70_000, "en", "a"), (22, "a\x1cb\x85c d é İ", "en", "a")]
    packed = packing.pack(documents(spark, rows), WORDS).collect()
    used = check(tool, rows, packed)
    assert len(used) == -(-sum(used) // packing.CAPACITY)  # one group, so all but one are full
    assert packing.pack(empty(spark), WORDS).count() == 0


def test_without_ids_only_ids_are_missing(spark):
    docs = documents(spark, texts()[:13])
    full = packing.pack(docs, WORDS)
    bare = packing.pack(docs, WORDS, with_ids=False)
    assert bare.columns == [c for c in full.columns if c != "ids"]
    assert sorted(map(str, full.drop("ids", "piece_id", "sequence_id").collect())) == sorted(map(str, bare.drop("piece_id", "sequence_id").collect()))


def test_many_groups_and_awkward_lengths(spark, tool, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 40)
    rng = random.Random(3)
    # a third of the rows are copies of a text that fills just over half of a sequence
    rows = [(i, "hot " * 36 if i % 3 else " ".join(["of"] * rng.randint(0, 200)), "en", "a") for i in range(600)]
    packed = packing.pack(documents(spark, rows), WORDS, capacity=64, max_padding=0.01).collect()
    used = check(tool, rows, packed, 64)
    total = sum(used)
    groups = -(-sum(1 for r in rows if len((r[1]).split()) % 64 != 63) // 40)
    assert len(used) <= total / (64 * 0.99) + groups


def test_documents_stay_whole_where_padding_allows(spark):
    rows = [(i, " ".join(["of"] * (31 if i % 2 else 63)), "en", "a") for i in range(100)]
    packed = packing.pack(documents(spark, rows), WORDS, capacity=64).collect()
    assert all(p.length == p.doc_tokens for p in packed)


def test_the_tree_finds_the_first_bin_with_room():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.randint(1, 50)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        plain, room = [], []
        for piece in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
            at = next((n for n, free in enumerate(room) if free >= lengths[piece]), len(room))
            if at == len(room):
                room.append(capacity)
                plain.append([])
            room[at] -= lengths[piece]
            plain[at].append(piece)
        bins = packing.first_fit_decreasing(lengths, capacity)
        assert bins == plain
        for share in (0.0, 0.1, 0.9):
            filled = packing.fill(lengths, bins, capacity, share)
            covered = collections.Counter((p, i) for parts in filled for p, start, n in parts for i in range(start, start + n))
            assert covered == collections.Counter((p, i) for p, n in enumerate(lengths) for i in range(n))
            assert all(0 < sum(n for _, _, n in parts) <= capacity for parts in filled)
            assert len(filled) <= max(-(-sum(lengths) // capacity), sum(lengths) / (capacity * (1 - share)))


def test_sequences_are_padded_except_at_powers_of_two(spark):
    rows = [(1, "of " * 63, "en", "a"), (2, "of " * 47, "en", "a"), (3, "of " * 7, "en", "a"), (4, "of " * 16, "en", "a")]
    packed = packing.pack(documents(spark, rows[:1]), WORDS, capacity=256)
    (row,) = packing.sequences(packed, 256, 9).collect()
    assert row.n_tokens == 64 and len(row.ids) == 64 and row.ids[-1] == 1
    packed = packing.pack(documents(spark, rows[1:]), WORDS, capacity=256)
    (row,) = packing.sequences(packed, 256, 9).collect()
    assert row.n_tokens == 48 + 8 + 17 and row.ids[row.n_tokens :] == [9] * (256 - row.n_tokens)


def test_chunks_have_the_ids_of_the_tokenizer(tool):
    codes = packing.TextCodes(WORDS)
    assert codes.cut
    rng = random.Random(6)
    letters = [chr(n) for n in range(0x21, 0x250)] + [chr(n) for n in range(0x400, 0x500)] + list("\u0301\u0308Σςσΐﬁǅ日ſẞ１²")
    letters += ["<|", "|>", "<|endoftext|>", "'S", "'ll", "-"]
    chunks = [c + mark for c in letters for mark in ("", ",", "x", "\u0301", "'s")]
    chunks += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) + rng.choice(["", ".", "?!", ",x"]) for _ in range(20000)]
    chunks += [" ".join(rng.choice(chunks) for _ in range(9)) for _ in range(2000)]
    for chunk in chunks:
        assert codes.encode(chunk) == np.array(tool.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes(), repr(chunk)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="sample tables not present")
def test_sample_with_sections_and_a_full_cache(spark, tool, monkeypatch):
    codes = packing.TextCodes(WORDS)
    monkeypatch.setattr(packing, "SECTION", 100)
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect():
        other = packing.TextCodes(WORDS)
        other.cut = None
        assert codes.encode(row.text) == other.encode(row.text)
        assert np.frombuffer(codes.encode(row.text), "<u4").tolist() == tool.encode(row.text, add_special_tokens=False).ids
