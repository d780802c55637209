"""Targets, keys and what the mix takes."""

import collections
import hashlib
import math
import re

from odd import documents, empty, sentences, texts

from grovemeter.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def rows():
    out = texts()
    for i in range(300):
        source = ("hot", "a", "b", "small", None)[0 if i % 3 else i % 5]
        out.append((1000 + i, sentences(i, 1 + i % 7), "en", source))
    return out


def test_targets_are_met_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 20)
    table = rows()
    sizes = collections.Counter()
    for _, text, _, source in table:
        sizes[source] += len(WORD.findall(text or ""))
    target = plain_targets(sizes)
    mixed = mixing.mix(documents(spark, table)).collect()
    assert len(mixed) == len(table)
    taken = collections.Counter()
    for r in mixed:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-5
        assert r.taken == r.size * r.copies <= 2 * r.size
        taken[r.source] += r.taken
    for source, goal in target.items():
        largest = max(len(WORD.findall(t or "")) for _, t, _, s in table if s == source)
        assert abs(taken[source] - goal) <= max(largest / 2, 1e-6)
    again = mixing.mix(documents(spark, table[::-1]).repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.size, str(r.source), r.copies)
    assert sorted(map(key, mixed)) == sorted(map(key, again))


def test_complete_epochs_come_first_and_keys_order_the_rest(spark):
    table = [(i, "w " * (1 + i % 4), "en", "only") for i in range(200)]
    found = mixing.mix(documents(spark, table)).collect()
    assert {r.copies for r in found} == {1, 2}  # one source: 1.5 epochs

    def key(doc_id, text):
        bits = int(hashlib.md5(f"{mixing.SEED}:{doc_id}".encode()).hexdigest()[:13], 16)
        letters = sum(c.isalpha() or c == " " for c in text) / len(text)
        return -math.log((bits + 0.5) / 2**52) / (0.5 + letters)

    order = sorted(table, key=lambda row: key(row[0], row[1]))
    rest, total, first = found[0].target - found[0].source_size, 0, set()
    for row in order:
        total += len(row[1].split())
        if total > rest:
            break
        first.add(row[0])
    twice = {r.doc_id for r in found if r.copies == 2}
    assert first <= twice and len(twice - first) <= 1


def test_mixed_documents_repeat_whole_rows(spark):
    docs = documents(spark, rows())
    chosen = collections.Counter()
    for r in mixing.mix(docs).collect():
        chosen[r.doc_id, r.source, r.size] += r.copies
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = collections.Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in out.collect())
    assert got == +chosen


def test_sources_without_words_and_empty_tables(spark):
    table = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "x y", "en", "b")]
    found = {r.doc_id: r for r in mixing.mix(documents(spark, table)).collect()}
    assert [found[i].taken for i in (1, 2)] == [0, 0] and found[3].target == 3.0 and found[3].taken in (2, 4)
    assert mixing.mix(empty(spark)).count() == 0
    nothing = [(1, None, "en", "a"), (2, " ", "en", None)]
    assert {r.taken for r in mixing.mix(documents(spark, nothing)).collect()} == {0}
