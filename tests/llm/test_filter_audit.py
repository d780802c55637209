"""Filter interactions against plain sets."""

import random
import re
from collections import Counter
from itertools import permutations

from odd import documents, empty, sentences, texts

from grovemeter.llm import filter_audit

SCHEMA = "doc_id long, quality int, toxic int, part string"


def labels(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)


def plain(rows, marks):
    failing = []
    for n, (doc_id, text, lang, _) in enumerate(rows):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        ids = [r[0] for r in rows if (r[1] or "") == text and r[0] is not None]
        marked = [m for m in marks if doc_id is not None and m[0] == doc_id]
        fails = (
            "A" * (len(words) < 200)
            + "B" * (100 * len(set(words)) < 50 * len(words))
            + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
            + "D" * bool(re.search("[#$%&*|]", text))
            + "E" * (doc_id is not None and min(ids) < doc_id)
        )
        failing.append((lang or "", fails, any(m[1] == 1 for m in marked), any(m[2] == 1 for m in marked)))
    out = {}
    for part in {lang or "" for _, _, lang, _ in rows}:
        mine = [f for f in failing if f[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            alive = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if f in r[1]]
                alive = [r for r in alive if f not in r[1]]
                shapley[f] += len(gone)
                out[part, order, step] = [
                    len(alive), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)
                ]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(shapley[f])
    return out


def check(spark, rows, marks):
    found = filter_audit.filter_interactions(documents(spark, rows), labels(spark, marks)).collect()
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in found}
    assert len(got) == len(found)
    assert got == plain(rows, marks)


def test_odd_rows(spark):
    marks = [(1, 1, 0), (2, 1, 1), (2, 0, None), (4, 1, 1), (4, 1, 1), (5, None, 1), (8, 0, 0), (99, 1, 1), (None, 1, 1)]
    check(spark, texts(), marks)


def test_all_combinations_of_failures(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "COPIES_PER_PIECE", 7)
    monkeypatch.setattr(filter_audit, "BUCKET_ROWS", 10)
    rng, rows = random.Random(4), []
    for n in range(400):
        text = sentences(n, 50).lower() if rng.random() < 0.6 else sentences(n, 3).lower()
        words = text.split()
        if rng.random() < 0.5:
            words = [f"{w}{i}" for i, w in enumerate(words)]
        if rng.random() < 0.3:
            words = [w.upper() if rng.random() < 0.5 else w for w in words]
        text = " ".join(words) + rng.choice(["", "", " #1", " 5%", "|"])
        rows.append((n, text if rng.random() < 0.7 or not rows else rng.choice(rows)[1], rng.choice(["en", "de", None, ""]), "a"))
    rows += [(500 + n, rows[3][1], "en", "a") for n in range(300)]  # one text in a large share of the rows
    check(spark, rows, [(n, n % 4 // 2, int(n % 3 == 0)) for n in range(0, 800, 2)])


def test_bounds_of_the_conditions(spark):
    rows = [
        (1, " ".join(f"w{n}" for n in range(200)), "en", "a"),
        (2, " ".join(f"w{n}" for n in range(199)), "en", "a"),
        (3, " ".join(f"w{n % 100}" for n in range(200)), "en", "a"),
        (4, " ".join(f"w{n % 99}" for n in range(200)), "en", "a"),
        (5, "A" * 3 + "b" * 97, "en", "a"),
        (6, "A" * 4 + "b" * 96, "en", "a"),
        (7, "É" * 50, "en", "a"),
    ]
    check(spark, rows, [])


def test_empty_tables(spark):
    assert filter_audit.filter_interactions(empty(spark), labels(spark, [(1, 1, 1)])).count() == 0
    check(spark, texts()[:4], [])


def test_tables_of_ids_are_dropped_and_share_buckets(spark):
    before = {t.name for t in spark.catalog.listTables()}
    relations = filter_audit.filter_relations(documents(spark), labels(spark, []))
    filter_audit.interactions(relations, "ABCDE")
    assert {t.name for t in spark.catalog.listTables()} == before

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = filter_audit._IdTables(spark, 4)
        rows = tables.write(relations.select("row", "part"), "plan")
        ids = tables.write(relations.select("row"), "ids")
        plan = rows.join(ids, "row", "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        tables.forget()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
