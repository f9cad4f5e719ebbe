import threading

import pytest
from conftest import rows
from pyspark.sql import functions as F

from folioseek.functions import text as T
from folioseek.operators import context, index, maintenance, search
from folioseek.plans.queries import QUERIES
from folioseek.sources.store import Store
from folioseek.tables import dense_index

PARAGRAPHS = "doc_index long, file_name string, position long, text string"


def _lines(spark, docs):
    return spark.createDataFrame([(d, f"order {d} 0{d % 9 + 1}.01.2024.docx", p, t) for d, ts in docs.items() for p, t in enumerate(ts)], PARAGRAPHS)


DOCS = {0: ["солдата Іваненка", "прибув сержант"], 1: ["солдат і сержант", "Підстава: солдат"], 2: ["сержант", "солдат"], 3: ["підсолдатський"]}


def _found(df):
    return {r["doc_index"]: [m["position"] for m in r["matches"]] for r in df.collect()}


def test_incremental_is_rebuild(spark):
    old, new = _lines(spark, DOCS), _lines(spark, DOCS | {1: ["зовсім інше"], 4: ["нове"]})
    changed = spark.createDataFrame([(1,), (4,)], "doc_index long")
    assert rows(index.update(index.build(old), changed, new)) == rows(index.build(new))


def test_delete_and_renumber(spark):
    lines = _lines(spark, DOCS)
    docs = lines.select("doc_index").distinct()
    numbers = dense_index(docs.where("doc_index <> 1"), [F.col("doc_index")], "new_index")
    assert rows(numbers) == [(0, 0), (2, 1), (3, 2)]
    moved = index.renumbered(index.build(lines), numbers)
    want = index.build(_lines(spark, {0: DOCS[0], 1: DOCS[2], 2: DOCS[3]}))
    assert rows(moved) == rows(want)


def test_merge_clean_report(spark):
    raw = spark.createDataFrame([("аб", 0, [2, 1]), ("аб", 0, [1]), ("x", 0, [1]), ("yy", 1, [])], "term string, doc_index long, positions array<long>")
    assert rows(index.merged(index.cleaned(raw))) == [("аб", 0, [1, 2])]
    assert tuple(index.postings_report(raw, 1).first()) == (1, 1, 1, True)
    assert tuple(index.postings_report(raw.where("false"), 101).first()) == (0, 0, 0, False)
    assert tuple(index.postings_report(raw.where("false"), 100).first()) == (0, 0, 0, True)
    assert index.needs_rebuild(raw, 0, 11) and not index.needs_rebuild(raw, 0, 10) and index.needs_rebuild(raw.where("false"), 1, 1)


def test_search_modes_and_views(spark):
    lines = _lines(spark, DOCS)
    postings = index.build(lines)
    assert _found(search.search("солдата", lines, 4, postings)) == {0: [0], 1: [0, 1], 2: [1]}
    assert _found(search.search("солдата", lines, 4)) == {0: [0], 1: [0, 1], 2: [1], 3: [0]}
    assert _found(search.search("солдат", lines, 4, postings, view_mode="fragments")) == {0: [0], 1: [0], 2: [1]}
    assert _found(search.search("солдат сержант", lines, 4, postings)) == {1: [0]}
    for blank in ("", "'", "а"):
        assert _found(search.search(blank, lines, 4, postings)) == {}
    order = [r["doc_index"] for r in search.search("солдата", lines, 4, postings).collect()]
    assert order == [2, 1, 0]


def test_quick_and_remaining_make_full(spark):
    for n in (0, 1, 170, 171, 400):
        lines = _lines(spark, {d: ["солдат"] for d in range(n)})
        postings = index.build(lines)
        counts = {m: search.candidates(postings, ["солдат"], m, n).count() for m in search.MODES}
        assert counts == {"quick": min(n, 170), "remaining": max(0, n - 170), "full": n}


def test_every_result_has_a_place(spark):
    sf = "/root/testdata/sf0.01"
    want = QUERIES["search_one_word"](spark, sf).select("doc_index").count()
    got = QUERIES["search_places"](spark, sf).orderBy("place").collect()
    assert want > 100 and [r["place"] for r in got] == list(range(1, want + 1))
    assert [tuple(r) for r in got[:100]] == [tuple(r) for r in QUERIES["search_ranked"](spark, sf).orderBy("place").collect()]


def test_search_many_is_search(spark):
    lines = _lines(spark, DOCS)
    postings = index.build(lines)
    queries = spark.createDataFrame([(1, ["солдат"]), (2, ["солдат", "сержант"]), (3, ["немає"])], "query_id long, words array<string>")
    got = rows(search.search_many(queries, lines, postings))
    want = sorted((q, d, p) for q, ws in ((1, "солдат"), (2, "солдат сержант")) for d, ps in _found(search.search(ws, lines, 4, postings)).items() for p in ps)
    assert got == want


def test_file_search(spark):
    files = spark.createDataFrame([(f"Nakaz {i}.docx", f"p/{i:03}") for i in range(300)], "name string, path string")
    assert search.file_search(files, "NAKAZ").count() == 200
    assert search.file_search(files, "nakaz", None).count() == 300
    assert search.file_search(files, "n", least=search.LEAST_NAME).count() == 0
    with pytest.raises(ValueError):
        search.file_search(files, " ")


def test_parents_by_a_literal_walk(spark):
    import random

    rng = random.Random(1)
    lines = [(d, p, rng.choice([0, 0, 1, 2, 3, 4])) for d in range(60) for p in range(rng.randrange(15))]
    got = {(r["doc_index"], r["position"]): r["parents"] for r in context.with_parents(spark.createDataFrame(lines, "doc_index long, position long, level int")).collect()}
    levels = {(d, p): v for d, p, v in lines}
    for d, p, v in lines:
        least, found = v or 999, []
        for q in range(p - 1, -1, -1):
            if levels[d, q] and levels[d, q] < least:
                least = levels[d, q]
                found.append(q)
        assert got[d, p] == found[::-1]


def test_action_and_flags(spark):
    lines = spark.createDataFrame([(0, 0, "§ 1", None), (0, 1, "Видати майно", None), (0, 2, " текст ", 0), (0, 3, "текст", 0)], "doc_index long, position long, text string, parent long")
    assert [r["action"] for r in context.action_lines(lines).orderBy("position").collect()] == [None, None, "Видати майно", "Видати майно"]
    flags = context.document_flags(lines.drop("parent"), lines.where("position = 3").drop("parent"))
    assert [r["is_match"] for r in flags.orderBy("position").collect()] == [False, False, True, True]
    assert [r[0] for r in lines.select(T.heading_category(F.col("text"))).collect()][0] == "section"


def test_request(spark):
    lines = _lines(spark, {i: ["солдат тут"] for i in range(200)})
    postings = index.build(lines)
    quick, counts = search.request("солдат", lines, 200, postings)
    assert counts == {"count": 170, "total_count": 200} and quick.agg({"doc_index": "min"}).first()[0] == 30
    assert search.request("солдат", lines, 200, postings, full_search=True)[1] == {"count": 30, "total_count": 200}
    with pytest.raises(ValueError):
        search.request(" ", lines, 200, postings)
    with pytest.raises(ValueError):
        search.file_search(lines, " ")
    phases = search.two_phase("солдат", lines, 200, postings).groupBy("phase").count()
    assert rows(phases) == [(0, 170), (1, 30)] and search.two_phase("со", lines, 200, postings).isEmpty()


def test_repair_and_rebuild(spark, tmp_path):
    lines = _lines(spark, DOCS)
    good = index.build(lines)
    bad = good.unionByName(good.where("doc_index = 0")).unionByName(spark.createDataFrame([("x", 0, [1]), ("зайве", 9, [0])], good.schema))
    store = Store(spark, f"file://{tmp_path}/index")
    store.commit(documents=lines.select("doc_index", "file_name").distinct(), paragraphs=lines, postings=bad)
    assert maintenance.validate_and_repair(store) == {"unknown_documents": 1, "cleaned": 1, "duplicates": good.where("doc_index = 0").count()}
    assert rows(store.read("postings")) == rows(good)
    assert set(maintenance.validate_and_repair(store).values()) == {0} and not maintenance.rebuild_if_needed(store)
    store.commit(postings=good.where("false"))
    assert maintenance.rebuild_if_needed(store) and rows(store.read("postings")) == rows(good)
    assert tuple(index.difference(good, good.where("doc_index <> 3")).first()) == (0, 1, 0, 1, 0, 1)


def test_one_writer_at_a_time(spark, tmp_path):
    store, order = Store(spark, f"file://{tmp_path}/locked"), []

    def work(name):
        with store.locked():
            order.append((name, "in"))
            order.append((name, "out"))

    with store.locked():
        other = threading.Thread(target=work, args=("b",))
        other.start()
        order.append(("a", "in"))
        with pytest.raises(TimeoutError), store.locked(patience=0.3):
            pass
        order.append(("a", "out"))
    other.join()
    assert order == [("a", "in"), ("a", "out"), ("b", "in"), ("b", "out")]
