"""The stages one after another, and the registry with and without them."""

import importlib
import os
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from test_pairs import components, shingles

import __spark_entry__ as entry
import corpus_pipeline
from folioseek.llm import langid, mixing, queries
from folioseek.llm.common import utf8

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == names
    assert 0 < docs.select("doc_id").distinct().count() <= before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_registry():
    names = entry.queries().keys()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    got = queries.queries()[name](spark, SF).toArrow()
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{SF}/{table}'")
    con.register("got", got)
    con.execute(f"CREATE TABLE want AS {queries.oracle_sql()[name]}")
    cols = ", ".join(f'"{c}"' for c in got.column_names)
    for a, b in (("got", "want"), ("want", "got")):
        assert con.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []


def test_without_the_subpackage(monkeypatch):
    found = importlib.import_module

    def gone(name, *a):
        if name.startswith(("folioseek.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
        return found(name, *a)

    monkeypatch.setattr(importlib, "import_module", gone)
    alone = importlib.reload(entry)
    try:
        assert "pipeline" not in alone.queries() and not any(n.startswith("op") for n in alone.queries()) and alone.oracle_sql()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    left = corpus_pipeline.written(stages["language"](spark, docs, SF), "language")
    filters = langid.learn(docs.where(~langid.is_held_out(docs["doc_id"])))
    ids = {r["doc_id"] for r in left.select("doc_id").collect()}
    for i, t in texts.items():
        best, score = filters.decide(*utf8(pa.array([t])))
        assert (i in ids) == (any(c.isalpha() for c in t or "") and score[0] >= 0.2)
    sets = {i: shingles(texts[i]) for i in ids}
    order = sorted(ids)
    links = [(a, b) for k, a in enumerate(order) for b in order[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = components(order, links)
    kept = corpus_pipeline.written(stages["near_duplicates"](spark, left, SF), "near")
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [i for i in order if label[i] == i]
    taken = mixing.mix(kept.select("doc_id", "source", mixing.n_words(kept["text"]).alias("size"))).collect()
    times = {r["doc_id"]: round(r["taken"] / r["size"]) if r["size"] else 1 for r in taken}
    mixed = corpus_pipeline.written(stages["mixing"](spark, kept, SF), "mixed")
    counts = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert counts == {i: n for i, n in times.items() if n}
    pieces = Counter()
    for r in stages["packing"](spark, mixed, SF).collect():
        pieces[r["doc_id"]] += r["length"] / r["doc_tokens"]
    assert {i: round(n) for i, n in pieces.items()} == dict(counts)
