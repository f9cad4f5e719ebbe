"""What is shuffled and stored grows with the texts, not with the rows that are made of them."""

import re

import pyarrow as pa
from conftest import rows
from pyspark.sql import functions as F

from test_store import text, versions

from folioseek.functions import text as T
from folioseek.operators import buckets, grams, index, maintenance, numbering, segments
from folioseek.plans import queries
from folioseek.sources import docx, files
from folioseek.sources.store import Store


def exchanges(df):
    return re.findall(r"Exchange (\w+)\((\w+)", df._jdf.queryExecution().executedPlan().toString())


def test_postings_are_gathered_where_their_documents_are(spark, monkeypatch):
    """The terms of a document are not shuffled, wherever the rows at once are cut; positions have neither repeats nor disorder."""
    monkeypatch.setattr(index, "GATHERED", 5)
    data = [(d, p, f"слово{d % 3} слова{d % 3} солдат O'Neil x{p}") for d in range(40) for p in range(d % 7, -1, -1)] + [(50, 0, None), (51, 0, " - ")]
    lines = spark.createDataFrame(data, "doc_index long, position long, text string").repartition(3)
    built = index.build(lines)
    want = {(r["term"], r["doc_index"]): [] for r in index.occurrences(lines).collect()}
    for r in index.occurrences(lines).distinct().collect():
        want[r["term"], r["doc_index"]].append(r["position"])
    assert sorted(map(tuple, built.collect())) == sorted((*k, sorted(v)) for k, v in want.items())
    assert {key for _, key in exchanges(built) if _ == "hashpartitioning"} == {"doc_index"}
    shifted = built.unionByName(built.withColumn("positions", F.transform("positions", lambda p: p + 1))).unionByName(built.withColumn("positions", F.filter("positions", lambda p: p < 0)))
    assert sorted(map(tuple, index.merged(shifted).collect())) == sorted((*k, sorted({*v, *(p + 1 for p in v)})) for k, v in want.items())


def test_grams_are_lists(spark, monkeypatch):
    """One row has the places of a run in many documents; all letters that a number can't hold give the same."""
    data = [(d + (d > 30) * (1 << 40), p, f"абв{chr(0x4E00 + d)}абв x𝒳y{p}") for d in range(60) for p in range(3)] + [(70, 0, None), (71, 0, "ab")]
    lines = spark.createDataFrame(data, "doc_index long, position long, text string")
    want = sorted({(t[i : i + 3], d, p) for d, p, t in data if t for i in range(len(t) - 2)})
    built = grams.build(lines.coalesce(1))
    assert rows(grams.entries(built)) == want
    assert built.where("gram = 'абв'").count() <= 5 and built.where("gram = 'абв'").agg(F.sum("documents")).first()[0] == 60
    docs, places, texts = zip(*[(0, 0, "".join(map(chr, range(0x10000, 0x10FFFF))))] + [(1, p, "abcabc"[: 2 * p]) for p in range(9)], strict=True)
    (made,) = [b for b in grams._lists(list(docs), list(places), list(texts)) if "abc" in b.column("gram").to_pylist()]
    at = made.column("gram").to_pylist().index("abc")
    assert [c[at].as_py() for c in made.columns] == ["abc", 1, [0] * 7, [2, 3, 4, 5, 6, 7, 8], 1]


def test_buckets_grow_with_the_index(spark, tmp_path, monkeypatch):
    docs = {f"p/{i:03}": ["солдат тут", f"майор{i}"] for i in range(20)}
    kept = Store(spark, str(tmp_path / "s"))
    now = segments.update(kept.snapshot(), versions(spark, docs), text(spark, docs))
    largest = max(now.size("postings"), now.size("paragraphs"))
    assert buckets.write(kept).properties["buckets"] == buckets.LEAST_BUCKETS
    monkeypatch.setattr(buckets, "BUCKET_BYTES", largest // 10)
    now = buckets.write(kept)
    assert now.properties["buckets"] >= 10
    asked = spark.createDataFrame([(1, ["солдат"]), (2, ["майор3"])], "query_id long, words array<string>")
    found = rows(buckets.search_many(now, asked))
    assert len(found) == 21 and found == rows(segments.search_many(now, asked))


def test_words_are_stemmed_once_for_a_batch(spark):
    """Paragraphs, not a row for each term, go to the gathering tasks, with what a token for itself gives, whatever its letters."""
    texts = ["О'Нілові ІВАНЕНКА федір'ор ' '' a' 'b", "ΣΊΣΥΦΟΣ ΟΔΟΣ'Σ ὈΔΥΣΣΕΎΣ", "İSTANBUL Iğdır ǅ Ⅷ Ⓐ ẞß ﬁ", "Ꭰ Ა ⅷx ця ЦЮ фед Федор Фед'", None, "", "солдата-майора ʼ’ ́е́ 𝒳𐐀", "цяця"]
    lines = spark.createDataFrame([(d, 0, t) for d, t in enumerate(texts)], "doc_index long, position long, text string")
    each = lines.select("doc_index", F.explode(T.raw_tokens(F.col("text"))).alias("raw")).select(T.term(F.col("raw")).alias("term"), "doc_index")
    want = rows(each.where(F.octet_length("term") >= T.LEAST_BYTES).distinct())
    built = index.build(lines)
    assert rows(built.select("term", "doc_index")) == want == rows(index.build(lines, each).select("term", "doc_index"))
    assert rows(index.occurrences(lines).select("term", "doc_index").distinct()) == want
    assert "Generate" not in built._jdf.queryExecution().optimizedPlan().toString()


def test_sizes_are_summed_from_lengths(spark, tmp_path, monkeypatch):
    """The lists of positions are not read for the sizes of documents."""
    seen, plain = [], segments.stored
    monkeypatch.setattr(segments, "stored", lambda df, name: seen.append((name, df.columns)) or plain(df, name))
    docs = {"p/a": ["солдат тут", "солдат"], "p/b": ["майор"]}
    now = segments.update(Store(spark, str(tmp_path / "s")).snapshot(), versions(spark, docs), text(spark, docs))
    assert rows(now.read("sizes").select("rev", "postings", "positions")) == [(0, 2, 3), (1, 1, 1)]
    assert ("made", ["term", "rev", "positions", "_n"]) in seen and "_n" not in now.read("postings").columns


def test_trimming_finds_all_white_space(spark):
    texts = ["", " ", "a", " a", "a\u2003", "\u00a0\u0085a b\u2028\n", "\u200ba\u200b", "\t\n", None, "a \n b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.unicode_trim(F.col("t")), F.regexp_replace("t", r"(?U)^\s+|\s+\z", "")).collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_numbering_sorts_once(spark):
    """Counters of all levels come from windows of one order, and are those of a walk."""
    data = [(d, s, [None, 1, 2, 3, 4, 5, 6][(d * 7 + s * s * 3 + s) % 7]) for d in range(9) for s in range(60)]
    got = numbering.numbered(spark.createDataFrame(data, "doc int, seq long, level long"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    for d in range(9):
        counts, want = [0] * 5, []
        for _, s, level in (x for x in data if x[0] == d):
            if level is not None and level <= 4:
                counts = [*counts[: level], counts[level] + 1, *[0] * (4 - level)]
            want.append((s, None if level is None else "" if level > 4 else ".".join(map(str, counts[1 : level + 1])) + ". "))
        assert rows(got.where(F.col("doc") == d).select("seq", "number")) == want


def test_a_folder_is_read_by_tasks(spark, tmp_path, monkeypatch):
    """Paths are neither listed nor named by the driver, a folder's entries are held in parts, and a document is held at a time."""
    raw = spark.range(300).selectExpr("'2024/' || id % 30 || '.docx' AS doc", "id AS seq", "'a<&>\r\"' || id AS text", "if(id % 3 = 0, 'S&\"\t\n1', null) AS style", "cast(null AS string) AS ilvl", "if(id % 2 = 0, '1', null) AS num_id")
    monkeypatch.setattr(files, "LISTED", 7)
    monkeypatch.setattr(docx, "LISTED_PER_TASK", 10)
    monkeypatch.setattr(docx, "FULL_BYTES", 1)
    monkeypatch.setattr(files, "documents_below", None)
    assert docx.write_documents(raw, f"file://{tmp_path}") == 30 and len(list(tmp_path.glob("2024/*"))) == 30
    want = [tuple(r) for r in raw.orderBy("doc", "seq").select("doc", "text", "style", "ilvl", "num_id").collect()]
    listed = files.walk(spark, str(tmp_path)).select("path")
    read = docx.read_listed(spark, str(tmp_path), listed, 30)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and read.rdd.getNumPartitions() == 3
    assert [tuple(r) for r in read.orderBy("doc", "seq").select("doc", "text", "style", "ilvl", "num_id").collect()] == want
    assert docx.read_folder(spark, str(tmp_path))[0].select("doc").distinct().count() == 30
    made = docx.containers(raw)
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString() and made.count() == 30
    content = made.first()["content"]
    assert [b.num_rows for b in docx._batched((str(k), content) for k in range(1000))] == [4100, 4100, 1800]


def test_long_paragraphs_are_written_in_small_batches(spark, tmp_path, monkeypatch):
    """A writing task gets long paragraphs a few at a time and turns one document's into Python's texts; the session keeps its own size of batches."""
    raw = spark.range(400, numPartitions=1).selectExpr("'d' || id % 20 || '.docx' AS doc", "id AS seq", "repeat(id || 'слово ', 1000) AS text", "cast(null AS string) AS style", "cast(null AS string) AS ilvl", "cast(null AS string) AS num_id")
    seen, made = f"{tmp_path}/seen", docx._made

    def watched(batches):
        def noted():
            for batch in batches:
                with open(seen, "a") as f:
                    f.write(f"{batch.num_rows} {batch.nbytes}\n")
                yield batch

        return made(noted())

    monkeypatch.setattr(docx, "_made", watched)
    monkeypatch.setattr(docx, "GIVEN_BYTES", 100_000, raising=False)
    own = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert docx.write_documents(raw, f"file://{tmp_path}/files") == 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == own
    with open(seen) as f:
        batches = [tuple(map(int, line.split())) for line in f]
    assert sum(n for n, _ in batches) == 400 and max(size for _, size in batches) < 200_000
    read = docx.read_folder(spark, f"{tmp_path}/files")[0]
    assert rows(read.select("doc", "text")) == rows(raw.select("doc", F.trim("text").alias("text")))


def test_difference_of_touched_documents(spark, monkeypatch):
    """The postings of touched documents alone are compared, in tasks whose number follows theirs; terms of the others count as there."""
    monkeypatch.setattr(index, "COMPARED", 10)
    lines = spark.createDataFrame([(d, p, f"слово{d % 3} x{d} спільний y{p}") for d in range(40) for p in range(3)] + [(3, 9, "рідкісний")], "doc_index long, position long, text string")
    before = index.build(lines)
    changed, gone = spark.createDataFrame([(3,), (4,), (7,)], "doc_index long"), spark.createDataFrame([(7,), (8,)], "doc_index long")
    new = lines.where("doc_index in (3, 4, 7) and position < 2").withColumn("text", F.concat("text", F.lit(" новий")))
    after = index.remove(index.update(before, changed, new), gone)
    seen, plain = [], index.stored
    monkeypatch.setattr(index, "stored", lambda df, name: seen.append((name, plain(df, name))) or seen[-1][1])
    whole, some = index.difference(before, after), index.difference(before, after, changed.unionByName(gone))
    # new: новий in 3 and 4; gone: рідкісний, x7, x8, and y2 of 3, 4, 7, 8.
    assert rows(some) == rows(whole) and some.first()["terms_added"] == 1 and some.first()["terms_removed"] == 3
    assert {r[0] for r in seen[-1][1].select("doc_index").distinct().collect()} == {3, 4, 7, 8}
    plan = whole._jdf.queryExecution().executedPlan().toString()
    n = dict((k, v) for k, v in seen[:1])["compared"].count()
    assert f", {-(-n // 10)}), REPARTITION_BY_NUM" in plan and n > 40


def test_words_that_are_not_asked_for_are_no_rows(spark, monkeypatch):
    texts = ["О'Нілові ІВАНЕНКА федір'ор ' солдата солдат", "ΣΊΣΥΦΟΣ солдату майор", None, "", "x"]
    lines = spark.createDataFrame([(d, p, t) for d, t in enumerate(texts) for p in range(2)], "doc_index long, position int, text string").repartition(3)
    asked = spark.createDataFrame([("солдат",), ("фед",), ("σίσυφος",), ("нема",), ("солдат",), ("x",)], "term string")
    want = rows(index.build(lines).join(asked.distinct(), "term", "left_semi").select("term", "doc_index", "positions"))
    for few in (100, 1):
        monkeypatch.setattr(index, "FEW_TERMS", few)
        built = index.build(lines, asked)
        assert rows(built) == want and len(want) == 4
        plan = built._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and ("LeftSemi" in plan) is (few == 1)


def test_outlines_are_made_once(spark, tmp_path, monkeypatch):
    """An outline is written before its ranges are sought; the paths of few new versions are broadcast, and texts are not shuffled for them."""
    seen, laid = [], []
    plain, written = segments.stored, Store.written
    monkeypatch.setattr(segments, "stored", lambda df, name: seen.append(name) or plain(df, name))
    monkeypatch.setattr(Store, "written", lambda self, table, df, *a: laid.append((table, df._jdf.queryExecution().optimizedPlan().toString())) or written(self, table, df, *a))
    docs = {"p/a": ["1. солдат тут", "солдат"], "p/b": ["майор"]}
    for most in (10, 1):
        monkeypatch.setattr(segments, "BROADCAST_VERSIONS", most)
        now = segments.update(Store(spark, str(tmp_path / f"s{most}")).snapshot(), versions(spark, docs), text(spark, docs))
        assert rows(now.read("outline").select("rev", "position")) == [(0, 0), (0, 1), (1, 0)] and "outlined" in seen
        plans = dict(laid)
        assert "Window" not in plans["outline"] and ("strategy=broadcast" in plans["paragraphs"]) is (most == 10)
        seen.clear()


def test_postings_are_dealt_as_lists(spark, tmp_path, monkeypatch):
    """An index is built and rebuilt from lists of neighbouring documents, each made once; opened, they are the postings, in order."""
    monkeypatch.setattr(index, "LISTED", 40)
    monkeypatch.setattr(index, "OPENED", 50)
    seen, laid, made, written = f"{tmp_path}/seen", [], index._lists_of_words, Store.written

    def watched(table):
        with open(seen, "a") as f:
            f.write(f"{table.column('doc_index').combine_chunks().unique().to_pylist()}\n")
        return made(table)

    monkeypatch.setattr(index, "_lists_of_words", watched)
    monkeypatch.setattr(Store, "written", lambda self, table, df, *a, **k: laid.append((table, df)) or written(self, table, df, *a, **k))
    docs = {f"p/{i:03}": [f"солдат тут x{i}", "солдат солдата", f"x{i}"] for i in range(60)}
    kept = Store(spark, str(tmp_path / "s"))
    now = segments.update(kept.snapshot(), versions(spark, docs), text(spark, docs))
    want = rows(index.build(now.read("paragraphs").withColumnRenamed("rev", "doc_index")))
    assert rows(now.read("postings").select("term", "rev", "positions")) == want and len(want) == 60 * 3
    kept.commit(now, postings=now.read("postings").where("rev % 3 = 0"))
    for end in (1, 2):
        with open(seen) as f:
            dealt = sorted(d for line in f for d in eval(line))
        assert dealt == sorted([*range(60)] * end)  # no document is gathered twice for one index
        if end == 1:
            assert maintenance.rebuild_if_needed(kept)
    assert rows(kept.read("postings").select("term", "rev", "positions")) == want
    lists = [df for table, df in laid if table == "postings" and "places" in df.columns]
    assert len(lists) == 2 and all(df.where("term = 'солдат'").count() < 30 for df in lists)
    for part in (tmp_path / "s" / kept.snapshot().tables["postings"][0]).glob("part-*.parquet"):
        found = [(r["term"], r["rev"]) for r in spark.read.parquet(str(part)).collect()]
        assert found == sorted(found, key=lambda r: (r[0].encode(), r[1]))


def test_lists_hold_all_numbers(spark, monkeypatch):
    """Documents far apart, great positions and other whole types are as in postings that are gathered without lists."""
    data = [(d, p, f"слово{d % 3} слова{d % 3} a{p} ab") for d in (0, 1, 5, 1 << 20, 1 << 31, (1 << 31) + 1, 1 << 40) for p in (0, 3, 127, 128, 129, 20_000, 1 << 30)] + [(7, 0, None), (8, 0, "-")]
    for kind in ("doc_index long, position long", "doc_index long, position int"):
        lines = spark.createDataFrame(data, f"{kind}, text string").repartition(3)
        lists, schema = index.lists(lines), index.build(lines).schema
        got = index.opened(lists, schema["doc_index"].dataType, schema["positions"].dataType.elementType)
        assert got.schema == schema and rows(got) == rows(index.build(lines))
        sizes = index.build(lines).groupBy("doc_index").agg(F.count("term"), F.sum(F.size("positions")))
        assert rows(index.list_sizes(lists)) == rows(sizes)
    empty = lines.where("text is null")
    assert index.lists(empty).count() == 0 == index.opened(index.lists(empty), schema["doc_index"].dataType, schema["positions"].dataType.elementType).count()


def test_first_versions_are_not_joined(spark, tmp_path):
    """While each document has its first version, postings get their documents' indexes without a join; after a change they are joined again."""
    kept, docs = Store(spark, str(tmp_path / "s")), {"p/a": ["солдат"], "p/b": ["майор солдат"], "p/c": []}
    now = segments.update(kept.snapshot(), versions(spark, docs), text(spark, {p: t for p, t in docs.items() if t}))
    found = segments.numbered(now, "postings")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found.select("term", "doc_index")) == [("майор", 1), ("солдат", 0), ("солдат", 1)]
    dropped = segments.live(now, "documents").where("file_path = 'p/a'").select("rev", "doc_key", F.lit(True).alias("gone"))
    now = segments.update(now, versions(spark, []), text(spark, {"p/a": [""]}).where("false"), dropped)
    found = segments.numbered(now, "postings")
    assert "Join" in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found.select("term", "doc_index")) == [("майор", 0), ("солдат", 0)]


def test_beginnings_are_compared_alone(spark):
    """A line begins as its whole lower case does, whatever white space and letters it has."""
    texts = ["Підстава: наказ", " ПІДСТАВА", "підстав", "СТАРШИЙ солдат", " молодший", " ШТАБ", "İстарш", "ΣСТАРШ", "Видати", "ЗАРАХУВАТИ", " видати", "", None, "підполковник", "ПІДПОЛКОВНИК", "x підстава"]
    whole = lambda t: F.lower(T.unicode_trim(t))
    t = F.col("t")
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(
        T.is_basis(t), F.startswith(T.unicode_trim(F.lower(t)), F.lit(T.BASIS)), T.ends_followup(t), whole(t).rlike(f"^(?:{'|'.join(T.FOLLOWUP_STOPS)})"),
        T.is_action(t), F.lower(t).rlike(f"^(?:{'|'.join(T.ACTIONS)})"),
    )
    assert all(r[0] == r[1] and r[2] == r[3] and r[4] == r[5] for r in got.collect())


def test_words_of_plain_texts(spark, monkeypatch):
    """Plain texts are cut into words without an expression, as by it, whatever their letters; others go by the expression."""
    monkeypatch.setattr(T, "CUT_BYTES", 50)
    chars = [chr(c) for c in range(1, T.PLAIN)]
    texts = [f"a{c}B {c} {c}{c}'x" for c in chars] + ["О'Нілові ІВАНЕНКА\nфедір'ор ' '' a' 'b", "ΣΊΣΥΦΟΣ", "İSTANBUL", "ʼ’ ́е́ 𝒳𐐀 ﬁ", "", " ", "x", None, "ab" * 100]
    got = spark.createDataFrame(list(enumerate(texts)), "n long, t string").select("n", "t", T.unplain(F.col("t")).alias("odd"), T.words(F.col("t")).alias("words")).orderBy("n").collect()
    assert {r["t"] for r in got if r["odd"]} == {t for t in texts if t and any(c >= chr(T.PLAIN) or c in T.UNLIKE for c in t)}
    plain = [r for r in got if not r["odd"]]
    row, words = T.words_of(pa.array([r["t"] for r in plain], pa.string()))
    found = [[] for _ in plain]
    for k, w in zip(row.tolist(), words.to_pylist(), strict=True):
        found[k].append(w)
    assert found == [r["words"] or [] for r in plain]
    lines = spark.createDataFrame([(d // 7, d, t) for d, t in enumerate(texts)], "doc_index long, position long, text string")
    built = index.build(lines)
    assert rows(index.opened(index.lists(lines), built.schema["doc_index"].dataType, built.schema["positions"].dataType.elementType)) == rows(built)


def test_places_of_runs_are_packed(spark, monkeypatch):
    """A place takes few bytes where lists are shuffled, and lists opened a few at a time hold every place, however far documents and positions are apart."""
    monkeypatch.setattr(grams, "OPENED", 100)
    data = [(d, p, f"солдат {d % 3} тут") for d in range(100) for p in range(10)]
    dense = grams.build(spark.createDataFrame(data, "doc_index long, position long, text string"))
    assert dense.where("n >= 1000").count() and dense.where("n >= 1000 and octet_length(places) > 2.2 * n").count() == 0
    far = data + [(d, p, "солдат їде") for d in (300, 1 << 20, 1 << 31, (1 << 31) + 1, 1 << 40) for p in (0, 127, 128, 20_000, 1 << 30)] + [(7000, 0, ""), (7001, 0, None), (7002, 0, "їд")]
    lines = spark.createDataFrame(far, "doc_index long, position long, text string").repartition(3)
    built = grams.build(lines)
    want = rows(lines.select(F.explode(grams.runs(T.normalised(F.col("text")))).alias("gram"), "doc_index", "position"))
    assert rows(grams.entries(built)) == want
    n = rows(lines.select(F.explode(grams.runs(T.normalised(F.col("text")))).alias("gram"), "doc_index", "position").groupBy("gram").agg(F.countDistinct("doc_index"), F.count("position")))
    assert rows(built.groupBy("gram").agg(F.sum("documents"), F.sum("n"))) == n


def test_runs_are_added_when_they_are_asked_for(spark, tmp_path):
    """A store made without runs gets them from its paragraphs, once, and they are those of a store made with them; updates keep them."""
    docs = {f"p/{i}": [f"солдат номер{i}", "штаб"] for i in range(30)}
    plain, whole = (Store(spark, str(tmp_path / n)) for n in "ab")
    for kept in (plain, whole):
        segments.update(kept.snapshot(), versions(spark, docs), text(spark, docs), with_grams=kept is whole)
    assert not plain.snapshot().has("grams") and segments.add_grams(plain) and not segments.add_grams(plain) and not segments.add_grams(whole)
    for more in ({}, {"q/1": ["солдати"]}):
        if more:
            for kept in (plain, whole):
                segments.update(kept.snapshot(), versions(spark, more), text(spark, more))
        now, want = plain.snapshot(), whole.snapshot()
        assert rows(segments.live(now, "grams")) == rows(segments.live(want, "grams")) and len(now.tables["grams"]) == 1 + len(more)
        found = [[(r["doc_index"], r["n_matches"]) for r in segments.search(s, "омер2", substring=True).collect()] for s in (now, want)]
        assert sorted(found[0]) == sorted(found[1]) and len(found[0]) == 11


def test_a_batch_of_words_asks_for_no_runs(spark):
    """The stored index gets its runs with the first query that reads them, and the same index serves all."""
    sf = "/root/testdata/sf0.001"
    queries._stores.pop((spark.sparkContext.applicationId, sf), None)
    first = rows(queries.batch_search_stored(spark, sf))
    store = queries._stored(spark, sf)
    assert not store.snapshot().has("grams")
    held = {r["table"]: r["n"] for r in queries.index_stored(spark, sf).collect()}
    assert held["grams"] > 0 and queries._stored(spark, sf) is store and store.snapshot().has("grams") and rows(queries.batch_search_stored(spark, sf)) == first
