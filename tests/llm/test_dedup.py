"""Exact dedup, near dedup and line dedup against plain versions."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from odd import documents, empty, sentences, texts
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from grovemeter.llm import exact_dedup, line_dedup, near_dedup

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return [w for w in BLANKS.split(text or "") if w]


def plain_exact(rows):
    groups = {}
    for i, (doc_id, text, *_) in enumerate(rows):
        groups.setdefault(BLANKS.sub(" ", text or ""), []).append((doc_id is None, doc_id or 0, i))
    out = []
    for norm, members in groups.items():
        keep = min(members)
        for member in members:
            doc_id = None if member[0] else member[1]
            out.append((doc_id, None if keep[0] else keep[1], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_exact_duplicates_equal_the_plain_version(spark, buckets):
    rows = texts() + [(i, "same  text" if i % 3 else "same text", "en", "a") for i in range(100, 160)]
    found = exact_dedup.exact_duplicates(documents(spark, rows), buckets=buckets).collect()
    want, groups = plain_exact(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == want
    assert sum(r.kept for r in found) == groups
    assert all(r.keep_id == r.doc_id for r in found if r.kept)


def test_a_hot_text_is_spread_over_ranges(spark):
    rows = [(i, "hot", "en", "a") for i in range(400)] + [(1000 + i, sentences(i, 3), "en", "a") for i in range(200)]
    docs = documents(spark, rows)
    keyed = docs.selectExpr("doc_id as rank_id", "text as prefix", "xxhash64(text) as digest", "1 as one")
    cuts = exact_dedup.splitters(keyed, ["prefix", "digest", "rank_id"], keyed.one, 12)
    assert sum(cut[0] == "hot" for cut in cuts) >= 5
    found = exact_dedup.exact_duplicates(docs, buckets=12)
    assert found.where("keep_id = 0 and group_size = 400").count() == 400


def test_drop_exact_duplicates_keeps_all_columns(spark):
    docs = documents(spark)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert {1, 3, 4, 5, 7, 8, 9, 11} <= {r.doc_id for r in kept.collect()}
    assert not {2, 6} & {r.doc_id for r in kept.collect()}


def plain_sets(text, width):
    found = words(lower(text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1)))


def plain_components(rows, width):
    sets = [plain_sets(text, width) for _, text, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(row[0], least.get(find(i), row[0]))
    return sorted(((row[0], len(sets[i]), least.get(find(i))) for i, row in enumerate(rows)), key=str)


def variants(seed, count, edits):
    """Texts that differ from one base in a few random words each, most of them not from each other alike."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    out = []
    for i in range(count):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(len(text))] = f"v{rng.randint(0, 10**6)}"
        out.append((1000 * seed + i, " ".join(text), "en", "a"))
    return out


@pytest.mark.parametrize("width", [2, 5])
@pytest.mark.parametrize("stars", [0, 2])
def test_near_duplicates_equal_the_plain_version(spark, monkeypatch, width, stars):
    """With and without leaders first; groups whose members are linked in chains; small blocks."""
    monkeypatch.setattr(near_dedup, "STARS", stars)
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rows = texts() + variants(2, 25, 12) + variants(3, 25, 30)
    found = near_dedup.near_duplicates(documents(spark, rows), width=width).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == plain_components(rows, width)
    for r in found:
        assert r.kept == (r.doc_id == r.component_id)


def test_signature_is_the_circulant_minimum():
    import numpy as np

    shingles = np.array([5, -7, 2**62, 12345], np.int64)
    places, ring = near_dedup._permutations()
    got = near_dedup.signature(shingles)
    for k in (0, 1, 17, near_dedup.BANDS * near_dedup.ROWS - 1):
        slots = [int(places[(int(s) % 2**64) >> 44]) for s in shingles]
        assert got[k] == min(ring[(slot + k) % near_dedup.CIRCLE] for slot in slots)


def test_keep_one_of_each(spark):
    docs = documents(spark)
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and ids.count(4) == 2 and ids.count(None) == 1


PIECE = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")


def plain_prints(found, line=25, window=24):
    """Places of fingerprints: every window of lines, one after the other."""
    value = [sum(c * pow(line_dedup.BASE, j, 2**64) for j, c in enumerate(w.encode(), 1)) % 2**64 >> 32 for w in found]
    order = [
        sum((2 * j + 1) * value[i + j] for j in range(line)) * 1000003 % 2147483647 for i in range(len(found) - line + 1)
    ]
    picked = set()
    for start in range(max(1, len(order) - window + 1) if order else 0):
        part = range(start, min(start + window, len(order)))
        picked.add(max(i for i in part if order[i] == min(order[j] for j in part)))
    return sorted(picked)


def plain_lines(rows):
    """(text, deleted words) of each row: matches with first places, joined, extended, cut out."""
    found = [words(row[1]) for row in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] or ""))
    first, out, done = {}, {}, {}
    for i in order:
        if rows[i][:2] in done:
            out[i] = done[rows[i][:2]]
            continue
        runs = []
        for at in plain_prints(found[i]):
            where = first.setdefault(tuple(found[i][at : at + 25]), (i, at))
            if where != (i, at):
                if runs and at <= runs[-1][1][0] + 25:
                    runs[-1][1] = (at, where)
                else:
                    runs.append([(at, where), (at, where)])
        covered = set()
        for (head, (d, p)), (tail, (e, q)) in runs:
            start, end = head, tail + 25
            while head - start < 23 and start > 0 and p > head - start and found[i][start - 1] == found[d][p - (head - start) - 1]:
                start -= 1
            q, at = q + 25, end
            while end - at < 23 and end < len(found[i]) and q + end - at < len(found[e]) and found[i][end] == found[e][q + end - at]:
                end += 1
            covered |= set(range(start, end))
        gone, at = set(), 0
        while at < len(found[i]):
            end = at
            while end in covered:
                end += 1
            if end - at >= 30:
                gone |= set(range(at, end))
            at = max(end, at + 1)
        text = rows[i][1]
        if gone:
            pieces = PIECE.findall(text)
            text = "".join(p for k, p in enumerate(pieces) if k not in gone) + text[len("".join(pieces)) :]
        out[i] = done[rows[i][:2]] = (text, len(gone))
    return [out[i] for i in range(len(rows))]


def fresh(seed, count):
    """Words that no other seed gives."""
    return " ".join(f"w{seed}x{i}" for i in range(count))


def test_clean_lines_equal_the_plain_version(spark):
    shared = sentences(50, 20)
    rows = texts()[:12] + [(20 + i, f"Intro {i} here. {sentences(60 + i, 2)} {shared} More {i}.\n{shared}", "en", "a") for i in range(8)]
    rows += [(40, shared, "en", "a"), (41, "Short. Line.", "en", "a"), (42, "Short. Line.", "en", "a"), (None, shared + " End.", "en", "a")]
    rng = random.Random(4)
    pool = fresh(1, 300).split()
    for i in range(30):  # pieces of one pool, put together at random
        cuts = [rng.randrange(260) for _ in range(4)]
        rows.append((100 + i, " ".join(" ".join(pool[c : c + rng.randint(5, 90)]) for c in cuts), "en", "a"))
    docs = documents(spark, rows)
    found = line_dedup.clean_lines(docs)
    assert found.columns == [c for c in docs.columns if c != "n_deleted"] + ["n_deleted"]
    got = sorted(((r.doc_id, r.text, r.n_deleted) for r in found.collect()), key=str)
    want = sorted(((row[0], text, n) for row, (text, n) in zip(rows, plain_lines(rows))), key=str)
    assert got == want
    assert all(shared not in (r[1] or "") for r in got if r[0] != 20)


def test_every_repeat_of_fifty_words_goes(spark):
    """Alone on a line, inside a sentence, without any punctuation, over line ends, in any white space."""
    passage = fresh(0, 50)
    broken = passage.replace(" ", "\n", 10).replace(" ", " \t", 10)
    rows = [(0, f"{fresh(1, 40)} {passage} {fresh(2, 40)}", "en", "a")]
    rows += [
        (i, f"{fresh(10 + i, 3 * i)}{before}{middle}{after}{fresh(50 + i, 2 * i)}", "en", "a")
        for i, (before, middle, after) in enumerate(
            [("\n", passage, "\n"), (" and ", passage, " but "), (" ", broken, " "), ("\n\n", broken, ".\n\n"), ("", " " + passage, "")], 1
        )
    ]
    got = {r.doc_id: (r.text, r.n_deleted) for r in line_dedup.clean_lines(documents(spark, rows)).collect()}
    assert got[0] == (rows[0][1], 0)
    assert got[1] == (f"{fresh(11, 3)}\n{fresh(51, 2)}", 50)
    assert got[2] == (f"{fresh(12, 6)} and but {fresh(52, 4)}", 50)
    assert got[3] == (f"{fresh(13, 9)} {fresh(53, 6)}", 50)
    assert got[4] == (f"{fresh(14, 12)} w0x49.\n\n{fresh(54, 8)}", 49)
    assert got[5][1] == 49 and "w0x10" not in got[5][0]


def test_short_repeats_stay(spark):
    rows = [(i, f"{fresh(10 + i, 30)} {fresh(0, 29)} {fresh(50 + i, 30)}", "en", "a") for i in range(6)]
    got = line_dedup.clean_lines(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [row[:2] for row in rows]


def test_a_name_of_the_caller_is_kept(spark):
    docs = documents(spark).withColumns({"row": F.lit(1), "ends": F.lit(2), "n_deleted": F.lit(77)})
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    assert {(r.row, r.ends, r.n_deleted) for r in kept.collect()} == {(1, 2, 77)}


def test_drop_repeated_lines_drops_what_is_emptied(spark):
    docs = documents(spark)
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 2 not in ids and {1, 5, 6, 7, 8} <= set(ids)


def test_empty_tables(spark):
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    assert line_dedup.clean_lines(empty(spark)).count() == 0


def test_word_values_over_block_bounds():
    """Words that begin in one block and end in the next, and one longer than a block."""
    found = [b"a", b"x" * (line_dedup.BLOCK + 10), *(f"w{i}é".encode() for i in range(30_000)), b"z" * 300]
    data = b" \n".join(found)
    got = line_dedup.word_values(data, *line_dedup.word_bounds(data))
    for at in [0, *range(1, len(found), 997), len(found) - 1]:
        value, power = 0, 1
        for c in found[at]:
            power = power * line_dedup.BASE % 2**64
            value = (value + c * power) % 2**64
        assert int(got[at]) == value


def test_rows_are_handled_by_bytes_of_text(monkeypatch):
    monkeypatch.setattr(line_dedup, "BATCH", 10)
    texts = ["a" * 6, None, "b" * 4, "c", "d" * 30, "", "é" * 4]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["row", "text"])
    parts = [part.column(1).to_pylist() for part in line_dedup.row_batches(batch, 1)]
    assert parts == [["a" * 6, None, "b" * 4], ["c"], ["d" * 30], ["", "é" * 4]]
    assert not list(line_dedup.row_batches(batch.slice(0, 0), 1))


def test_large_batches_are_cleaned_in_small_ones(spark, monkeypatch):
    """What goes back to Spark at once does not grow with the batch that came."""
    steps, apply = [], DataFrame.mapInArrow
    monkeypatch.setattr(line_dedup, "BATCH", 2000)
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, step, schema: steps.append(step) or apply(self, step, schema))
    line_dedup.clean_lines(documents(spark, [(1, "a b c", "en", "a")]))
    row = pa.array([{"doc_id": i} for i in range(100)])
    batch = pa.RecordBatch.from_arrays([row, pa.array(["w " * 200] * 100), pa.nulls(100, pa.list_(pa.int64()))], ["row", "text", "ends"])
    sent = list(steps[-1](iter([batch])))
    assert len(sent) == 20 and sum(part.num_rows for part in sent) == 100


def test_texts_winnowed_together_are_winnowed_alone():
    import numpy as np

    rng = np.random.default_rng(3)
    sizes = [0, 3, 24, 25, 26, 47, 48, 49, 0, 200, 25, 1]
    texts_values = [rng.integers(0, 2**63, n).astype(np.uint64) for n in sizes]
    opens = np.cumsum([0, *sizes])
    places, lines = line_dedup.winnow(np.concatenate(texts_values), opens)
    want = []
    for start, values in zip(opens, texts_values):
        at, line = line_dedup.winnow(values, np.array([0, len(values)]))
        want += [(int(start + a), int(h)) for a, h in zip(at, line)]
    assert list(zip(places.tolist(), lines.tolist())) == want
    assert all(places + line_dedup.LINE <= opens[-1])
