import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F
from conftest import rows

from folioseek.operators import changes, segments
from folioseek.sources import docx, files, store
from folioseek.streaming import refresh


def make_docx(path, paragraphs, numbering=None, body=None):
    def p(item):
        if item is None:
            return "<w:p/>"
        text, ilvl, style = item if isinstance(item, tuple) else (item, None, None)
        inner = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{ilvl}"/><w:numId w:val="1"/></w:numPr>' if ilvl is not None else "")
        return f"<w:p><w:pPr>{inner}</w:pPr><w:r><w:t>{text}</w:t><w:tab/></w:r></w:p>"

    xml = body or f'<?xml version="1.0"?><w:document xmlns:w="w"><w:body>{"".join(map(p, paragraphs or []))}</w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml" if paragraphs is not None else "word/other.xml", xml)
        if numbering:
            z.writestr("word/numbering.xml", numbering)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data.getvalue())


def test_docx_folder(spark, tmp_path):
    make_docx(tmp_path / "2024/a b+%.docx", ["", "Наказ", None, ("перший", 0, None), ("вкладений", 1, None), "", "текст", ("ще", None, "OiiSList1"), "ПОГОДЖЕНО x"])
    make_docx(tmp_path / "2024/bad.docx", ["x"], body="<w:document><w:p>")
    make_docx(tmp_path / "2024/none.docx", None)
    make_docx(tmp_path / "2024/.git/z.docx", ["hidden"])
    make_docx(tmp_path / "2024/~$a.docx", ["lock"])
    (tmp_path / "2024/text.docx").write_text("no container")
    lines, errors = docx.read_folder(spark, str(tmp_path))
    assert [r[1:] for r in rows(lines.select("doc", "position", "text", "line_breaks_after"))] == [
        (0, "Наказ", 1), (1, "1. перший", 0), (2, "1.1. вкладений", 0), (3, "текст", 0), (4, "2. ще", 0)
    ]
    assert {r["doc"].split("/")[-1] for r in errors.collect()} == {"bad.docx", "none.docx", "text.docx"}


def test_nested_paragraph_loses_the_outer_text():
    body = '<w:document xmlns:w="w"><w:p><w:t>outer</w:t><w:p><w:t>in</w:t><w:br/><w:t>ner</w:t></w:p><w:t>after</w:t></w:p></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    assert [p[0] for p in docx.raw_paragraphs(data.getvalue())] == ["inner"]


def test_listing(spark, tmp_path):
    for p in ("2024/a.docx", "x y/é%20.docx", "/".join("d" * 12) + "/deep.docx"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("abc")
    assert [r[:3] for r in rows(files.listing(spark, str(tmp_path)).select("path", "name", "size"))] == [("2024/a.docx", "a.docx", 3), ("x y/é%20.docx", "é%20.docx", 3)]


def test_missing_folder(spark, tmp_path):
    assert rows(files.listing(spark, str(tmp_path / "none"), missing_is_empty=True)) == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.listing(spark, str(tmp_path / "none"))


def test_containers(spark):
    data = [("a", 0, "x < y & \"z\"\r", "S&\"1\"", None, None), ("a", 1, None, None, None, None), ("a", 2, "li\x0bst", None, "0", "1"), ("b", 0, "ї", None, None, "2")]
    raw = spark.createDataFrame(data, "doc string, seq long, text string, style string, ilvl string, num_id string")
    want = [("a", 0, "x < y & \"z\"\r", "S&\"1\"", None, None), ("a", 1, "", None, None, None), ("a", 2, "list", None, "0", "1"), ("b", 0, "ї", None, None, "2")]
    assert [r[:6] for r in rows(docx.read_raw(docx.containers(raw)))] == want
    assert docx.containers(raw.where("false")).collect() == []


def test_changes(spark):
    now = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 2, 5), ("d", 1, 6)], "path string, size long, mtime_s long")
    old = spark.createDataFrame([("b", 1, 5), ("c", 1, 5), ("d", 1, 5), ("e", 1, 5)], "path string, size long, mtime_s long")
    assert rows(changes.sync_plan(now, old)) == [("a", "copy"), ("b", "keep"), ("c", "copy"), ("d", "copy"), ("e", "delete")]
    indexed = old.withColumnRenamed("mtime_s", "last_modified")
    assert rows(changes.file_changes(now, indexed)) == [("a", "new"), ("b", "unchanged"), ("c", "unchanged"), ("d", "changed"), ("e", "deleted")]
    assert rows(changes.listing_differences(now, old)) == [("a", 1, 5, -1), ("c", 1, 5, 1), ("c", 2, 5, -1), ("d", 1, 5, 1), ("d", 1, 6, -1), ("e", 1, 5, 1)]
    assert rows(changes.stale_files(now, indexed)) == [("a", "missing"), ("c", "size"), ("d", "later"), ("e", "gone")]
    assert changes.listings_differ(now, old) and not changes.listings_differ(now, now)
    assert changes.index_is_stale(now, indexed) and not changes.index_is_stale(now.where("false"), indexed) and not changes.index_is_stale(old, indexed)


def numbered(kept, table, *columns):
    return rows(segments.numbered(kept.snapshot(), table).select(*columns))


def test_refresh_and_store(spark, tmp_path):
    folder, kept = tmp_path / "in", store.Store(spark, str(tmp_path / "index"))
    make_docx(folder / "a.docx", ["солдат один"])
    make_docx(folder / "b.docx", ["сержант", "солдат"])
    make_docx(folder / "c.docx", ["капітан"])
    assert refresh.refresh(spark, str(folder), kept) == {"processed": 3, "skipped": 0, "deleted": 0, "errors": 0}
    first = kept.current()
    assert refresh.refresh(spark, str(folder), kept) == {"processed": 0, "skipped": 3, "deleted": 0, "errors": 0}
    assert kept.current() == first
    (folder / "a.docx").unlink()
    make_docx(folder / "c.docx", ["капітан", "солдат"])
    os.utime(folder / "c.docx", (4e9, 4e9))
    make_docx(folder / "0.docx", ["новий солдат"])
    (folder / "broken.docx").write_text("x")
    assert refresh.refresh(spark, str(folder), kept) == {"processed": 2, "skipped": 1, "deleted": 1, "errors": 1}
    documents = [(0, "b.docx"), (1, "c.docx"), (2, "0.docx")]
    lines = [(0, 0, "сержант"), (0, 1, "солдат"), (1, 0, "капітан"), (1, 1, "солдат"), (2, 0, "новий солдат")]
    for compacted in (False, True):
        assert numbered(kept, "documents", "doc_index", "file_name") == documents
        assert [r[1:] for r in numbered(kept, "postings", "term", "doc_index", "positions") if r[0] == "солдат"] == [(0, [1]), (1, [1]), (2, [0])]
        assert numbered(kept, "paragraphs", "doc_index", "position", "text") == lines
        found = segments.search(kept.snapshot(), "солдат").select("doc_index", "n_matches")
        assert rows(found) == [(0, 1), (1, 1), (2, 1)]
        assert segments.compact(kept) is not compacted
    assert kept.vacuum(grace=0) == 2 and numbered(kept, "documents", "doc_index", "file_name") == documents
    assert sorted(name.split("-")[0] for name in os.listdir(tmp_path / "index/data")) == ["documents", "outline", "paragraphs", "postings", "sizes"]


def test_refresh_opens_changed_files_only(spark, tmp_path):
    folder, kept = tmp_path / "in", store.Store(spark, str(tmp_path / "index"))
    for i in range(1000):
        make_docx(folder / f"{i % 7}/{i}.docx", [f"солдат {i}"])
    assert refresh.refresh(spark, str(folder), kept)["processed"] == 1000
    # Were any of them opened again, it would be an error: they are no containers now.
    for i in range(1000):
        path = folder / f"{i % 7}/{i}.docx"
        then = path.stat().st_mtime
        path.write_text("unreadable")
        os.utime(path, (then, then))
    make_docx(folder / "3/3.docx", ["капітан"])
    os.utime(folder / "3/3.docx", (4e9, 4e9))
    before = {f: sum(len(fs) for _, _, fs in os.walk(tmp_path / "index" / f)) for f in kept.snapshot().tables["paragraphs"]}
    assert refresh.refresh(spark, str(folder), kept) == {"processed": 1, "skipped": 999, "deleted": 0, "errors": 0}
    now = kept.snapshot()
    assert now.tables["paragraphs"][:1] == list(before) and len(now.tables["paragraphs"]) == 2
    written = spark.read.parquet(f"{tmp_path}/index/{now.tables['paragraphs'][1]}")
    assert rows(written.select("text")) == [("капітан",)]
    assert segments.search(now, "солдат").count() == 999 and segments.search(now, "капітан").count() == 1


def test_data_source(spark, tmp_path):
    for name in ("a.docx", "x/b [1]*.docx", "x/.git/c.docx", "x/~$d.docx", "x/e.txt"):
        make_docx(tmp_path / name, [name.split("/")[-1], "рядок"])
    spark.dataSource.register(docx.DocxSource)
    read = spark.read.format("docx")
    assert [r[:3] for r in rows(read.load(str(tmp_path)).where("seq = 0").select("doc", "seq", "text"))] == [("a.docx", 0, "a.docx"), ("x/b [1]*.docx", 0, "b [1]*.docx")]
    some = read.option("names", '["x/b [1]*.docx", "gone.docx"]').load(str(tmp_path))
    assert [(r["doc"], r["error"] is None) for r in some.where("seq = 0").orderBy("doc").collect()] == [("gone.docx", False), ("x/b [1]*.docx", True)]
    one_each = spark.read.format("docx").option("filesPerTask", 1).load(str(tmp_path))
    assert one_each.rdd.getNumPartitions() == 2
    assert docx.read_named(spark, str(tmp_path), []).isEmpty()
    with pytest.raises(ValueError, match="at most"):
        docx.read_named(spark, str(tmp_path), ["x"] * (docx.MOST_PATHS + 1))


def test_named_files_through_spark(spark, tmp_path, monkeypatch):
    for name in ("a.docx", "x/b [1]*{2}.docx", "x/other.docx"):
        make_docx(tmp_path / name, [name])
    monkeypatch.setattr(files, "is_local", lambda folder: False)
    found = docx.read_named(spark, f"file://{tmp_path}", ["a.docx", "x/b [1]*{2}.docx"])
    assert rows(found.select("doc", "text")) == [("a.docx", "a.docx"), ("x/b [1]*{2}.docx", "x/b [1]*{2}.docx")]
    assert rows(docx.read_folder(spark, f"file://{tmp_path}")[0].select("doc")) == [("a.docx",), ("x/b [1]*{2}.docx",), ("x/other.docx",)]


def test_walk(spark, tmp_path):
    for p in ("2024/a.docx", "x y/é%20.docx", "/".join("d" * 9) + "/in.docx", "/".join("d" * 10) + "/deep.docx", "2024/.git/hidden", "2024/.github/hidden", "b.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("abc")
    (tmp_path / "2024/link.docx").symlink_to(tmp_path / "b.txt")
    (tmp_path / "empty").mkdir()
    found = rows(files.walk(spark, str(tmp_path)).select("path", "name", "size"))
    assert found == sorted([("2024/a.docx", "a.docx", 3), ("x y/é%20.docx", "é%20.docx", 3), ("/".join("d" * 9) + "/in.docx", "in.docx", 3), ("b.txt", "b.txt", 3)])
    assert sorted(files.documents_below(str(tmp_path))) == sorted(p for p, _, _ in found if p.endswith(".docx"))
    assert rows(files.walk(spark, str(tmp_path / "empty"))) == []
    with pytest.raises(Exception, match="none"):
        files.walk(spark, str(tmp_path / "none"))


def test_walk_enters_no_excluded_folder(spark, tmp_path, monkeypatch):
    make_docx(tmp_path / "a.docx", ["x"])
    (tmp_path / ".git").mkdir()
    entered = []
    real = os.scandir
    monkeypatch.setattr(os, "scandir", lambda path: entered.append(str(path)) or real(path))
    assert list(files.documents_below(str(tmp_path))) == ["a.docx"]
    assert entered == [str(tmp_path)]


def test_document_names(spark):
    names = ["a.docx", "A.DOCX", "a..docx", "..docx", ".docx", "~$a.docx", "a.docx.tmp", "docx", "thumbs.db", ".DS_Store", "a.docx ", "x.y.docx"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", files.is_document(F.col("n"))).collect()}
    assert got == {n: files._is_document(n) for n in names}
    assert [n for n in names if got[n]] == ["a.docx", "A.DOCX", "a..docx", "..docx", "x.y.docx"]


def test_stream_triggers_a_refresh(spark, tmp_path):
    make_docx(tmp_path / "in/a.docx", ["солдат"])
    kept = store.Store(spark, str(tmp_path / "index"))
    query = refresh.follow(spark, str(tmp_path / "in"), kept, str(tmp_path / "state"), once=True)
    assert query.awaitTermination(120)
    assert kept.read("documents").count() == 1


DOCUMENTS = """{"documents": [{"file_path": "p", "file_name": "n", "file_size": 1, "last_modified": 2, "created": 3, "content": ["x", "y"],
 "word_count": 2, "paragraph_count": 2}, {"file_path": "q", "file_name": "m", "file_size": 1, "last_modified": 2, "created": 3, "content": ["z"],
 "paragraphs": [{"text": "z", "line_breaks_after": 4}], "word_count": 1, "paragraph_count": 1}], "total_documents": %d, "total_words": 3, "indexed_at": 9}"""


def test_json_exchange(spark, tmp_path):
    good, bad, postings = tmp_path / "good.json", tmp_path / "bad.json", tmp_path / "postings.json"
    good.write_text(DOCUMENTS % 2)
    bad.write_text(DOCUMENTS % 3)
    _, lines = store.read_documents_json(spark, str(good))
    assert rows(lines.select("doc_index", "position", "text", "line_breaks_after")) == [(0, 0, "x", 0), (0, 1, "y", 0), (1, 0, "z", 4)]
    assert tuple(store.documents_json_report(spark, str(good)).first()) == (False, False, False, True)
    assert tuple(store.documents_json_report(spark, str(bad)).first()) == (True, False, False, False)
    postings.write_text('{"word_to_docs": {"ab": [{"doc_index": 1, "paragraph_positions": [0, 2]}]}, "total_documents": 2}')
    assert rows(store.read_postings_json(spark, str(postings))) == [("ab", 1, [0, 2])]
    with pytest.raises(ValueError, match="wrong_total"):
        store.read_documents_json(spark, str(bad))
    assert store.read_documents_json(spark, str(bad), checked=False)[0].count() == 2
    postings.write_text('{"word_to_docs": {}, "total_documents": 101}')
    with pytest.raises(ValueError, match="no words"):
        store.read_postings_json(spark, str(postings))
    assert rows(store.read_postings_json(spark, str(postings), checked=False)) == []
    with pytest.raises(FileNotFoundError):
        store.Store(spark, str(tmp_path / "nothing")).read("documents")
