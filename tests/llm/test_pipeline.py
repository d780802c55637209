"""Every stage of the pipeline beside its plain version, and all registered names."""

import corpus_pipeline
import pytest
from odd import documents, empty, texts
from pyspark.sql import functions as F
from test_dedup import plain_components, plain_lines, words
from test_tokens import library_ids, plain_identified

import __spark_entry__
from grovemeter.llm import queries as llm

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_equal_plain_versions(spark, tmp_path):
    rows = [row for row in texts() if row[0] is not None]
    rows = [row for i, row in enumerate(rows) if row[0] not in {r[0] for r in rows[:i]}]
    docs = documents(spark, rows).select(*COLUMNS)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "BPE":
            assert docs.columns == COLUMNS
            assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0

    languages = dict(plain_identified(documents(spark, rows)))
    assert sorted((r.doc_id, r.lang) for r in seen["language ID"].collect()) == sorted(languages.items())
    known = [row for row in rows if row[0] in languages]
    cleaned = [(row[0], text, *row[2:]) for row, (text, gone) in zip(known, plain_lines(known)) if not gone or words(text)]
    assert sorted((r.doc_id, r.text) for r in seen["line dedup"].collect()) == sorted(row[:2] for row in cleaned)
    least = [doc_id for doc_id, _, component in plain_components(cleaned, 5) if doc_id == component]
    assert sorted(r.doc_id for r in seen["near dedup"].collect()) == sorted(least)
    mixed = seen["mixing"].collect()
    assert {r.doc_id for r in mixed} <= set(least)
    final = seen["BPE"].collect()
    assert sorted((r.doc_id, r.ids) for r in final) == sorted((r.doc_id, library_ids(r.text)) for r in mixed)


def test_run_applies_all_stages(spark, tmp_path):
    documents(spark).select(*COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "decoded_sha256"]
    assert found.count() > 5


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, tmp_path, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, empty(spark).select(*COLUMNS), str(tmp_path)).count() == 0


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in llm.queries()} == {f"op{n}" for n in range(1, 14)}
    assert set(llm.queries()) | {"pipeline"} <= names
    assert set(llm.oracle_sql()) <= set(__spark_entry__.oracle_sql())
