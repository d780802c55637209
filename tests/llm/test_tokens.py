"""Byte-pair codes against the tokenizers library, language ID and scoring against sums over all paths."""

import collections
import hashlib
import itertools
import math
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import documents, empty, texts
from tokenizers import Tokenizer

from grovemeter.llm import bpe, hmm, language_id

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text("ab \n'ś", max_size=400) | st.text("aàé<|endoftext|>0 1"))
def test_codes_equal_the_library(text):
    tool = bpe.codec(FILE)
    ids = tool.encode(text)
    assert ids == library_ids(text)
    assert tool.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


def test_long_words_merge_like_short_ones(monkeypatch):
    for word in ("ab" * 900, "é" * 700, "abcde" * 300 + "zz"):
        assert bpe.codec(FILE).merge_word(word.encode()) == library_ids(word)
    words = ["hello", "Straßenbahn", "aaaaaaaaaaa", "日本語"]
    short = [bpe.codec(FILE).merge_word(w.encode()) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 1)
    assert [bpe.codec(FILE).merge_word(w.encode()) for w in words] == short


def test_the_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    tool = bpe.Codec(FILE)
    text = "one two three four five six seven one two"
    assert tool.encode(text) == library_ids(text) and len(tool.known) <= 3


def test_digests_and_columns(spark):
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest_codes(documents(spark), FILE).collect()}
    for doc_id, text, *_ in texts():
        ids = library_ids(text or "")
        joined = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (doc_id, len(ids), joined, hashlib.sha256((text or "").encode()).hexdigest()) in rows
    docs = documents(spark)
    back = bpe.decode(bpe.encode(docs, FILE), FILE, into="back")
    assert back.columns == [c for c in docs.columns if c != "ids"] + ["ids", "back"]
    assert back.where("back != coalesce(text, '')").count() == 0
    assert bpe.digest_codes(empty(spark), FILE).count() == 0


def all_segmentations(word, probability):
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, min(len(word), language_id.LONGEST) + 1):
        piece = word[:n]
        p = probability.get(piece, probability["?"] if n == 1 else 0.0)
        total += p * all_segmentations(word[n:], probability)
    return total


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "ba", "aba", "▁", "▁a"]
    table = language_id.Pieces.of(pieces)
    rng = np.random.default_rng(1)
    probabilities = rng.random((len(pieces) + 1, 2))
    probabilities /= probabilities.sum(axis=0)
    words = ["▁abab", "▁b", "▁axb", "▁aaaabbbb", "x", "▁abababab"]
    got = language_id.forward(*language_id.lattice(words, table), probabilities)
    for i, word in enumerate(words):
        for language in range(2):
            named = dict(zip(["?", *pieces], probabilities[:, language]))
            assert abs(got[i, language] - math.log(all_segmentations(word, named))) < 1e-9


def test_expected_counts_equal_sums_over_segmentations():
    pieces = ["a", "ab", "b", "ba"]
    table = language_id.Pieces.of(pieces)
    probabilities = np.full((5, 1), 0.2)
    words = ["abab", "ba", "axb"]
    numbers, offsets, lengths = language_id.lattice(words, table)
    counts = language_id.expected_counts(numbers, lengths, offsets, probabilities, np.array([[2.0], [1.0], [1.0]]))

    def cuts(word):
        if not word:
            yield []
        for n in range(1, len(word) + 1):
            if n == 1 or word[:n] in pieces:
                yield from ([word[:n], *rest] for rest in cuts(word[n:]))

    want = collections.Counter()
    for word, weight in zip(words, (2, 1, 1)):
        ways = [(0.2 ** len(c), c) for c in cuts(word)]
        for p, cut in ways:
            for piece in cut:
                want[piece if piece in pieces else "?"] += weight * p / sum(q for q, _ in ways)
    for at, piece in enumerate(["?", *pieces]):
        assert abs(counts[at, 0] - want[piece]) < 1e-9


def test_pieces_of_every_length_count():
    import public_tokenizers

    pieces = language_id.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert max(map(len, pieces)) > 6
    table = language_id.Pieces.of(["n", "a", "nananana", "nananananana"])
    got = language_id.forward(*language_id.lattice(["nananananana"], table), np.array([[0.0], [0.1], [0.1], [0.0], [0.8]]))
    assert abs(got[0, 0] - math.log(0.8 + 0.1**12)) < 1e-9


def test_very_long_words_stay_finite():
    table = language_id.Pieces.of(["a", "aa"])
    got = language_id.forward(*language_id.lattice(["a" * 20000], table), np.array([[0.2], [0.5], [0.3]]))
    assert np.isfinite(got).all()


def test_languages_are_told_apart_on_held_out_rows(spark):
    say = {"en": "the house and that with some thing", "de": "das haus und die mit einem über", "fr": "la maison et les avec une chose où"}
    rows = []
    for i in range(120):
        language = ("en", "de", "fr")[i % 3]
        parts = say[language].split()
        rows.append((i, " ".join(parts[(i + k) % len(parts)] for k in range(6)), language, "a"))
    rows += [(500, None, "en", "a"), (501, "123 ... 4", "de", "a"), (502, "", None, "a"), (None, "the house and", None, "a")]
    found = {r.doc_id: r for r in language_id.identify(documents(spark, rows), PIECES).collect()}
    for doc_id, _, language, _ in rows[:120]:
        assert found[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert found[doc_id].lang_pred == language and 0.5 < found[doc_id].score <= 1
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (500, 501, 502))
    assert found[None].lang_pred == "en" and found[None].held_out is False


def plain_identified(docs):
    """doc_id and language of the rows the stage keeps, word by word and sum by sum."""
    pieces = language_id.vocabulary(PIECES)
    model = language_id.fit(docs.where(~language_id.held_out()), pieces)
    number = {piece: i + 1 for i, piece in enumerate(pieces)}
    letters = sum(len(p) == 1 and p.isalpha() for p in pieces)

    def log_sum(word, column):
        word = language_id.MARK + word
        ahead = [0.0]
        for end in range(1, len(word) + 1):
            ways = []
            for start in range(max(0, end - 16), end):
                code = number.get(word[start:end], 0 if end - start == 1 else None)
                if code is not None:
                    ways.append(ahead[start] + math.log(model.probabilities[code, column]))
            top = max(ways)
            ahead.append(top + math.log(sum(math.exp(way - top) for way in ways)))
        return ahead[-1]

    kept = []
    for row in docs.collect():
        found = collections.Counter(language_id.LETTERS.findall((row.text or "").lower()))
        sums = [sum(n * log_sum(w, k) for w, n in found.items()) for k in range(len(model.languages))]
        best = max(range(len(sums)), key=lambda k: sums[k] + model.priors[k])
        if found and sums[best] > -sum(n * len(w) for w, n in found.items()) * math.log(letters):
            kept.append((row.doc_id, row.lang if row.lang is not None else model.languages[best]))
    return kept


def test_language_stage_keeps_what_a_language_explains(spark):
    say = {"en": "the house and that with some thing", "de": "das haus und die mit einem über"}
    rows = [(i, f"{text} {i}", language, "a") for i, (language, text) in enumerate(list(say.items()) * 20)]
    rows += [(100, "the thing and the house", None, "b"), (101, "die mit das haus", None, "b"), (102, "qxzjv wqxj zzqv xjkq", "en", "b")]
    rows += [(103, "ᚠᚢᚦᚨᚱᚲ ᚷᚹᚺ", None, "b"), (104, "12 3", "en", "b"), (105, None, "en", "b"), (106, "das haus", "en", "b")]
    docs = documents(spark, rows)
    kept = language_id.keep_identified(docs, PIECES)
    assert kept.columns == docs.columns and kept.schema["lang"].dataType == docs.schema["lang"].dataType
    found = {r.doc_id: r.lang for r in kept.collect()}
    assert set(found) == {*range(40), 100, 101, 106}
    assert (found[100], found[101], found[106]) == ("en", "de", "en")
    assert sorted(found.items()) == sorted(plain_identified(docs))


def test_language_stage_on_odd_rows(spark):
    docs = documents(spark)
    kept = language_id.keep_identified(docs, PIECES).collect()
    key = lambda pair: (pair[0] is None, *map(str, pair))
    assert sorted(((r.doc_id, r.lang) for r in kept), key=key) == sorted(plain_identified(docs), key=key)
    as_they_were = {str(r.asDict() | {"lang": None}) for r in docs.collect()}
    assert all(str(r.asDict() | {"lang": None}) in as_they_were for r in kept)
    nothing = documents(spark, [(1, "abc", None, "a"), (2, "12", None, "a"), (3, None, None, "a")])
    assert [r.doc_id for r in language_id.keep_identified(nothing, PIECES).collect()] == [1]
    assert {r.lang_pred for r in language_id.identify(nothing, PIECES).collect()} == {"und"}
    assert language_id.identify(empty(spark), PIECES).count() == 0


def test_a_language_of_one_text_is_drawn_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TRAIN_ROWS", 30)
    say = {"en": "the house and that with some thing", "de": "das haus und die mit einem über", "fr": "la maison et les avec une chose où"}
    rows = [(3 * i + k, text if k else f"{text} {i}", language, "a") for k, (language, text) in enumerate(say.items()) for i in range(300)]
    found = language_id.identify(documents(spark, rows), PIECES).select("doc_id", "lang_pred").collect()
    assert all(r.lang_pred == list(say)[r.doc_id % 3] for r in found)


def test_new_words_are_scored_in_small_parts(monkeypatch):
    pieces = ["▁", *"abcdef", "▁ab", "cd"]
    rng = np.random.default_rng(6)
    model = language_id.Model(["x", "y"], language_id.Pieces.of(pieces), rng.dirichlet(np.ones(len(pieces) + 1), 2).T, np.zeros(2), 0.0)
    words = ["".join(letters) for letters in itertools.product("abcdef", repeat=3)]
    want = language_id.Scorer(model).score([" ".join(words), words[5]])
    handled = []
    monkeypatch.setattr(language_id, "SCORED_WORDS", 50)
    monkeypatch.setattr(language_id, "lattice", lambda part, table, own=language_id.lattice: handled.append(len(part)) or own(part, table))
    got = language_id.Scorer(model).score([" ".join(words), words[5]])
    assert handled == [50, 50, 50, 50, 16] and np.allclose(got[0], want[0], rtol=1e-12) and (got[1] == want[1]).all()


def test_long_training_words_are_learned_whole():
    words = ["ab", "x" * 450, "", "y" * 200]
    parts, origin = language_id.stretches(words)
    assert parts == ["▁ab", "▁" + "x" * 200, "x" * 200, "x" * 50, "▁" + "y" * 200] and origin.tolist() == [0, 1, 1, 1, 3]


def plain_base(rows):
    """Unigram scores as stated: end counted as a token."""
    tokens = [(text or "").encode().lower().split() + [None] for _, text, *_ in rows]
    held = [doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1 for doc_id, *_ in rows]
    counts = collections.Counter(t for own, out in zip(tokens, held) if not out for t in own)
    n, v = sum(counts.values()), len(counts)
    return [
        (row[0], out, len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own))
        for row, own, out in zip(rows, tokens, held)
    ]


def test_base_scores_equal_the_stated_sums(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_CHARS", 20_000)
    rows = texts()
    key = lambda r: (str(r[0]), r[2], r[5])
    found = sorted((tuple(r)[:6] for r in hmm.score(documents(spark, rows)).collect()), key=key)
    for got, want in zip(found, sorted(plain_base(rows), key=key)):
        assert got[:5] == want[:5] and abs(got[5] - want[5]) < 1e-6
    assert hmm.score(empty(spark)).count() == 0


def small_model(states, classes, seed=3):
    rng = np.random.default_rng(seed)
    moves = rng.random((states, states))
    return hmm.Model(rng.dirichlet(np.ones(states)), moves / moves.sum(axis=1, keepdims=True), rng.random((classes, states)) + 0.1)


def test_likelihood_is_the_sum_over_all_paths():
    model, sizes = small_model(3, 6), np.array([4, 1, 6])
    classes = np.random.default_rng(5).integers(0, 6, 11)
    known = np.ones(11, bool)
    known[2] = False
    got = hmm.log_ratio(classes, sizes, model, known)
    at = 0
    for i, size in enumerate(sizes):
        total = 0.0
        for path in itertools.product(range(3), repeat=int(size)):
            p = model.start[path[0]]
            for k, state in enumerate(path):
                p *= (model.moves[path[k - 1], state] if k else 1.0) * (model.ratio[classes[at + k], state] if known[at + k] else 1.0)
            total += p
        assert abs(got[i] - math.log10(total)) < 1e-9
        at += size


def test_expected_counts_equal_the_posterior_of_all_paths():
    model, sizes = small_model(2, 5), np.array([4, 3])
    classes = np.array([0, 1, 4, 2, 3, 3, 0])
    counts, moved, opened = hmm.expect(classes, sizes, model)
    want, want_moved, want_opened, at = np.zeros((5, 2)), np.zeros((2, 2)), np.zeros(2), 0
    for size in sizes:
        paths = {}
        for path in itertools.product(range(2), repeat=int(size)):
            p = model.start[path[0]] * model.ratio[classes[at], path[0]]
            for k in range(1, size):
                p *= model.moves[path[k - 1], path[k]] * model.ratio[classes[at + k], path[k]]
            paths[path] = p
        for path, p in paths.items():
            share = p / sum(paths.values())
            want_opened[path[0]] += share
            for k, state in enumerate(path):
                want[classes[at + k], state] += share
                if k:
                    want_moved[path[k - 1], state] += share
        at += size
    assert np.allclose(counts, want) and np.allclose(moved, want_moved) and np.allclose(opened, want_opened)


def test_blocks_are_learned_from_and_scored_in_bounded_memory(monkeypatch):
    """Arrays by state are held for AT_ONCE tokens, not for a block; the sums stay the same."""
    rng = np.random.default_rng(4)
    sizes = np.concatenate([rng.integers(1, 700, 400), [9000]])
    classes, known = rng.integers(0, 50, sizes.sum()), rng.random(sizes.sum()) < 0.9
    model = small_model(8, 50)
    whole = hmm.expect(classes, sizes, model), hmm.log_ratio(classes, sizes, model, known)
    monkeypatch.setattr(hmm, "AT_ONCE", 5000)
    for work, want in zip((lambda: hmm.expect(classes, sizes, model), lambda: (hmm.log_ratio(classes, sizes, model, known),)), (whole[0], whole[1:])):
        tracemalloc.start()
        got = work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert all(np.allclose(a, b, rtol=1e-10) for a, b in zip(got, want))
        assert peak < 45 * len(classes)  # a token by state alone takes 64 bytes


def test_the_model_beats_unigrams_on_held_out_texts(spark):
    rng = np.random.default_rng(2)
    kinds = [[f"{letter}{i}" for i in range(40)] for letter in ("aa", "bb", "cc")]
    rows = [(i, " ".join(rng.choice(kinds[i % 3], 30)), "en", "a") for i in range(150)]
    held = [r for r in hmm.score(documents(spark, rows)).collect() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) + 5 * len(held)


def test_state_distributions_sum_to_one():
    base = np.zeros(hmm.CLASSES + 1)
    base[[1, 5, 9, hmm.END]] = [0.5, 0.2, 0.1, 0.1]
    model = hmm.first_model(base)
    assert np.allclose((model.ratio * base[:, None]).sum(axis=0), base.sum())


def test_codes_with_check_equal_codes(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 100)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    docs = documents(spark, texts()).drop("ids", "n")
    found = bpe.encode_with_check(docs, FILE)
    assert found.columns == [c for c in docs.columns if c != "text"] + ["ids", "n_tokens", "decoded_sha256"]
    plain = bpe.codec(FILE)
    wanted = [[str(r.doc_id), (ids := plain.encode(r.text or "")), len(ids), hashlib.sha256(plain.decode(ids).encode()).hexdigest()] for r in docs.collect()]
    got = [[str(r.doc_id), r.ids, r.n_tokens, r.decoded_sha256] for r in found.collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert bpe.encode_with_check(empty(spark), FILE).count() == 0
