"""Runs of three characters, the automaton, many queries, the stored outline."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from folioseek.operators import context, grams, index, scan, search, segments
from folioseek.sources.store import Store

WORDS = ["солдат", "солдата", "майор", "й", "аб", "абв", "вабв", "x𝒳y", "O'Neil", "перемога", "a", "%_", "нез'ясований"]


def table(spark, seed=1, n=120):
    rng = random.Random(seed)
    data = [(d, f"f{d}.docx", p, " ".join(rng.choices(WORDS, k=rng.randrange(1, 9)))) for d in range(n) for p in range(rng.randrange(1, 5))]
    data += [(n, "long.docx", 0, "абв " * 60_000 + "x𝒳y майор"), (n, "long.docx", 1, "  ")]
    return spark.createDataFrame(data, "doc_index long, file_name string, position long, text string")


@pytest.mark.parametrize("query", ["солдат", "олда майо", "аб вабв", "x𝒳y", "o'neil", "й", "a солдата", "немає", "май пере солд абв"])
def test_substring_index_equals_a_scan(spark, query):
    lines = table(spark)
    words = search.T.query_terms(query)
    want = rows(search.matches(words, lines, None).select("doc_index", "position"))
    got = grams.matches(words, lines, grams.build(lines))
    assert rows(got.select("doc_index", "position")) == want


def test_candidates_are_few(spark):
    lines = table(spark, n=400).unionByName(spark.createDataFrame([(900, "r.docx", 0, "рідкісне слово солдат")], "doc_index long, file_name string, position long, text string"))
    built = grams.build(lines)
    assert rows(grams.candidates(built, ["рідкісн", "солдат"])) == [(900, 0)]
    assert grams.candidates(built, ["відсутнє"]).isEmpty() and grams.candidates(built, ["ab", "x"]) is None
    assert grams.build(lines.where("false")).isEmpty()


def test_names_by_grams(spark):
    files = spark.createDataFrame([(f"Nakaz {i}.docx", f"p/{i:03}") for i in range(300)] + [("NAK", "q"), ("na", "r")], "name string, path string")
    names = grams.build_names(files)
    for query in ("NAKAZ 1", "nak", ".docx", "z 29", "zz9", "na", "n"):
        assert rows(grams.file_search(names, files, query, None)) == rows(search.file_search(files, query, None))
    assert grams.file_search(names, files, "nakaz").count() == 200
    with pytest.raises(ValueError):
        grams.file_search(names, files, "  ")


def test_many_queries_by_scan_and_by_index(spark, monkeypatch):
    monkeypatch.setattr(scan, "QUERIES_AT_ONCE", 4)
    rng, lines = random.Random(3), table(spark, 2)
    asked = [(k, [w.replace("'", "").lower() for w in rng.choices(WORDS, k=rng.randrange(1, 5))]) for k in range(11)] + [(11, []), (12, ["солдат", "солдат"]), (12, ["майор"]), (None, ["майор"])]
    queries = spark.createDataFrame(asked, "query_id long, words array<string>")
    plain = lambda found: rows(found.select("doc_index", "position"))
    want = [(q, *r) for q, words in asked if words for r in plain(search.matches(words, lines, None))]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, scan.scan_many(queries, lines).collect()), key=key) == sorted(want, key=key)
    postings = index.build(lines)
    terms = [(q, words) for q, words in asked[:11]]
    many = search.search_many(spark.createDataFrame(terms, "query_id long, words array<string>"), lines, postings)
    assert rows(many) == sorted((q, *r) for q, words in terms for r in plain(search.matches(words, lines, postings)))
    assert scan.scan_many(queries.where("false"), lines).isEmpty() and scan.scan_many(queries, lines.where("false")).isEmpty()
    assert search.search_many(queries.where("false"), lines, postings).isEmpty()


LINES = ["§ 1", "видати майно", "1. Вважати такими", "1.1. солдата", "зарахувати на службу", "1.2. інший", "сержант", "рядок", "Підстава: рапорт", "2. Нове", "  ", "3.1. ще", "3.2. далі"]


def test_stored_outline_is_the_windows_result(spark, tmp_path):
    rng = random.Random(7)
    data = [(f"p/{d:03}", ("Особовий " if d % 3 == 0 else "") + f"{d}.docx", p, rng.choice(LINES) + rng.choice(["", " слово"])) for d in range(60) for p in range(rng.randrange(1, 14))]
    lines = spark.createDataFrame(data, "file_path string, file_name string, position long, text string")
    kept = Store(spark, str(tmp_path / "s"))
    for part in (0, 1):  # two segments
        mine = lines.where(F.substring("file_path", 5, 1).cast("int") % 2 == part)
        fresh = mine.select(F.lit(None).cast("long").alias("doc_key"), "file_path", "file_name").distinct()
        segments.update(kept.snapshot(), fresh, mine.withColumn("line_breaks_after", F.lit(0).cast("long")), with_grams=True)
    now = kept.snapshot()
    assert len(now.tables["outline"]) == len(now.tables["grams"]) == 2
    dense = segments.numbered(now, "paragraphs")
    order = ["doc_index", "position", "is_personal", "parents", "parents_at", "action", "followups", "basis"]
    for query in ("слово", "лово"):
        got = segments.search_extracts(now, query, substring=True).select(order)
        want = context.extracts(dense, dense.where(F.contains("text", F.lit("слово")))).select(order)
        assert rows(got) == rows(want) and got.count() > 100
    assert segments.search_extracts(now, "немає").isEmpty()
    segments.compact(kept)
    assert rows(segments.search_extracts(kept.snapshot(), "слово").select(order)) == rows(want)
