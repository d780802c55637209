"""Cross-tokenizer alignment against plain loops."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from odd import documents, empty, texts
from tokenizers import Tokenizer

from grovemeter.llm import token_align
from grovemeter.llm.bpe import byte_letters

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(JSON)
        self.a.encode_special_tokens = True
        self.letters = {letter: byte for byte, letter in enumerate(byte_letters())}
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def tokens(self, text):
        """[(id, bytes)] of A and B; none where the bytes differ from space + text."""
        if not text:
            return [], []
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            b.append((i, bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()))
        data = (" " + text).encode()
        return (a, b) if b"".join(t for _, t in a) == data == b"".join(t for _, t in b) else ([], [])

    def align(self, text):
        """a, b, groups, links of places."""
        a, b = self.tokens(text)
        spans = []
        for tokens in (a, b):
            ends, at = [], 0
            for _, data in tokens:
                ends.append((at, at + len(data)))
                at += len(data)
            spans.append(ends)
        cuts = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        sides = []
        for tokens, span in zip((a, b), spans):
            parts = [[]]
            for (i, _), (_, end) in zip(tokens, span):
                parts[-1].append(i)
                if end in cuts:
                    parts.append([])
            sides.append(parts[:-1])
        groups = list(zip(*sides))
        links, j = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while j and spans[1][j][0] > s:
                j -= 1
            while j < len(b) and spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((i, k))
                k += 1
        return [i for i, _ in a], [i for i, _ in b], groups, links

    def table(self, rows):
        found = [(doc_id, self.align(text)) for doc_id, text in rows]
        counts = collections.Counter(p for _, (a, b, _, links) in found for p in {(a[i], b[j]) for i, j in links})
        most = collections.defaultdict(int)
        for (a, _), n in counts.items():
            most[a] = max(most[a], n)
        out = []
        for doc_id, (a, b, groups, links) in found:
            pairs = [(a[i], b[j]) for i, j in links]
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            out.append(
                (doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in pairs), sum(counts[p] for p in pairs),
                 hashlib.sha256(text.encode()).hexdigest() if a else "")
            )
        return sorted(out, key=str)


@pytest.fixture(scope="module")
def plain():
    return Plain()


def odd_rows():
    more = [
        (30, "a▁b"), (31, "▁"), (32, " "), (33, "  two  spaces \n\n\t x\r\n"), (34, "\x00\x1c\x85 　"), (35, "<s>a</s><unk><0x41><|endoftext|>"),
        (36, "naïve façade ﬁ ½ é"), (37, "日本語のテキスト\U0001f468‍\U0001f469"), (38, "x" * 3000), (39, "it's they're 12345 İ"), (40, "▁word"),
    ]
    return [(r[0], r[1]) for r in texts()] + more


def run(spark, rows):
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    found = token_align.token_alignment(docs, RANKS, PIECES)
    assert found.columns == ["doc_id", *FIELDS]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_odd_rows(spark, plain):
    assert run(spark, odd_rows()) == plain.table(odd_rows())
    assert token_align.token_alignment(empty(spark), RANKS, PIECES).count() == 0


def test_small_blocks_batches_lanes_and_hot_pairs(spark, plain, at_scale, monkeypatch):
    from grovemeter.operators import lookup

    for name, value in (("BLOCK_CHARS", 300), ("BATCH_CHARS", 200), ("LANE", 4)):
        monkeypatch.setattr(token_align, name, value)
    monkeypatch.setattr(lookup, "ROWS_PER_PIECE", 2)
    rng = random.Random(2)
    rows = odd_rows() + [(100 + n, "".join(rng.choice("ab é日\n1.,'▁") for _ in range(rng.randint(0, 60)))) for n in range(150)]
    rows += [(400 + n, "the same words in a third of all rows") for n in range(80)]
    assert run(spark, rows) == plain.table(rows)


def test_lanes_do_not_change_links():
    rng = np.random.default_rng(5)
    sizes = np.array([0, 1, 2, 3, 5])
    for lane in (2, 3, 7, 1000):
        token_align.LANE, kept = lane, token_align.LANE
        try:
            a, b = [], []
            for _ in range(30):
                total = int(rng.integers(0, 60))
                pair = []
                for _ in range(2):
                    ids, left = [], total
                    while left:
                        ids.append(int(rng.choice([i for i in (1, 2, 3, 4) if sizes[i] <= left])))
                        left -= sizes[ids[-1]]
                    pair.append(np.array(ids, np.int64))
                a.append(pair[0])
                b.append(pair[1])
            found = token_align.lockstep(a, b, sizes, sizes)
            starts_a, starts_b, starts = ([0, *e[:-1]] for e in (found.a_ends, found.b_ends, found.link_ends))
            for n in range(30):
                spans = [[(sum(sizes[x[:k]]), sum(sizes[x[: k + 1]])) for k in range(len(x))] for x in (a[n], b[n])]
                links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
                at = slice(starts[n], found.link_ends[n])
                assert list(zip(found.link_a[at] - starts_a[n], found.link_b[at] - starts_b[n])) == links
                both = {e for _, e in spans[0]} & {e for _, e in spans[1]}
                assert found.cut_a[starts_a[n] : found.a_ends[n]].tolist() == [e in both for _, e in spans[0]]
                assert found.cut_b[starts_b[n] : found.b_ends[n]].tolist() == [e in both for _, e in spans[1]]
        finally:
            token_align.LANE = kept


def test_alignments_hold_links_and_cuts(spark, plain, monkeypatch):
    monkeypatch.setattr(token_align, "BATCH_CHARS", 100)
    rows = [r for r in odd_rows() if r[0] is not None and r[0] != 4]
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    found = {r.doc_id: r for r in token_align.alignments(docs, RANKS, PIECES).collect()}
    assert len(found) == len(rows)
    for doc_id, text in rows:
        a, b, groups, links = plain.align(text)
        r = found[doc_id]
        assert (r.a, r.b, list(zip(r.links_a, r.links_b))) == (a, b, links)
        cut = lambda side: np.cumsum([len(g[side]) for g in groups]).tolist()
        assert (r.cuts_a, r.cuts_b) == (cut(0), cut(1))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="sample tables not present")
def test_sample(spark, plain):
    from grovemeter.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.token_alignment(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == plain.table(rows)
