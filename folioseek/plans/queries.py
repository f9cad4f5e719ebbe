"""Queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import buckets, changes, context, grams, index, maintenance, numbering, scan, search, segments
from ..sources import corpus, docx, files
from ..sources.store import Snapshot, Store
from ..streaming import refresh, watch
from ..tables import dense_index, shared_folder, stored
from .samples import ENDED, FILES, KINDS, LINES, MARKS, RAW, SEQUENCE, STEMS, sample

#: Where the doc_indexes of the inline lines begin.
SAMPLE_FROM = 1_000_000_000_000
#: Where the files lie that a share shows, and the share.
LOCAL, SHARE = "/srv/orders/", "\\\\server\\orders\\"
#: Two words as a person writes them, with commas and endings.
FRIENDLY_QUERY = "Іваненко, Петра,"
#: Words of the search queries: two near each other in order, four, and one.
NEAR_QUERY, WIDE_QUERY, ONE_QUERY = "that with", "that with this from", "that"

#: Part of a file name.
NAME_QUERY = "?page="


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark, sf_dir)


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.paragraphs(_docs(spark, sf_dir))


def _flat(postings: DataFrame) -> DataFrame:
    joined = F.array_join(F.col("positions").cast("array<string>"), ",")
    return postings.select("term", "doc_index", F.size("positions").cast("long").alias("n_positions"), joined.alias("positions"))


def paragraph_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paragraphs(spark, sf_dir).select("doc_index", "file_name", "position", "text")


def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return _paragraphs(spark, sf_dir).groupBy("doc_index").agg(F.count(F.lit(1)).alias("paragraph_count"), F.sum(words).cast("long").alias("word_count"))


def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = doc_stats(spark, sf_dir)
    return stats.agg(F.count(F.lit(1)).alias("total_documents"), F.sum("word_count").alias("total_words"), F.sum("paragraph_count").alias("total_paragraphs"))


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.occurrences(_paragraphs(spark, sf_dir)).groupBy("doc_index", "term").agg(F.count(F.lit(1)).alias("n"))


def stem_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of all words of the documents, with Ukrainian endings put to them, and of some Ukrainian words."""
    raw = _docs(spark, sf_dir).select(F.explode(T.raw_tokens(F.col("text"))).alias("raw")).distinct()
    ending = F.element_at(F.array(*map(F.lit, ENDED)), (F.length("raw") % len(ENDED) + 1).cast("int"))
    words = raw.select(F.concat("raw", ending).alias("word")).unionByName(sample(spark, STEMS))
    return words.distinct().select("word", T.stem(F.col("word")).alias("stem"))


def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(index.build(_paragraphs(spark, sf_dir)))


def term_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.document_frequency(index.build(_paragraphs(spark, sf_dir)))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.statistics(index.build(_paragraphs(spark, sf_dir)))


def postings_remove_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without documents that are labelled toxic."""
    docs = _docs(spark, sf_dir)
    gone = docs.join(corpus.load(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")
    return _flat(index.remove(index.build(corpus.paragraphs(docs)), gone))


def postings_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents changed: their text is their upper half, then re-indexed."""
    docs = _docs(spark, sf_dir)
    changed = docs.join(corpus.load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    new = changed.withColumn("text", F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int")))
    return _flat(index.update(index.build(corpus.paragraphs(docs)), changed, corpus.paragraphs(new)))


def postings_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    left = docs.join(corpus.load(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_anti").select("doc_index")
    numbers = dense_index(left, [F.col("doc_index")], "new_index")
    return _flat(index.renumbered(index.build(corpus.paragraphs(docs)), numbers))


def postings_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = stored(index.build(_paragraphs(spark, sf_dir)), "built")  # read twice
    twice = postings.unionByName(postings.withColumn("positions", F.transform("positions", lambda p: p + 1)))
    return _flat(index.merged(twice))


def postings_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.build(_paragraphs(spark, sf_dir))
    cut = rows.withColumn("term", F.when(F.length("term") > 3, F.col("term")).otherwise(F.substring("term", 1, 1)))
    even = cut.withColumn("positions", F.filter("positions", lambda p: p % 2 == 0))
    return _flat(index.merged(index.cleaned(even)))


def index_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    rows = index.build(corpus.paragraphs(docs)).withColumn("positions", F.filter("positions", lambda p: p % 2 == 0))
    return index.postings_report(rows, docs.count() - 50)


def documents_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    n = F.size(F.split("text", "\n")).cast("long")
    path = F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.col("file_name"))
    rows = docs.select(path.alias("file_path"), n.alias("n_lines"), F.when(F.col("doc_id") % 9 == 0, n + 1).otherwise(n).alias("paragraph_count"))
    return index.documents_report(rows, docs.count() + 1)


def index_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which "that" is part of some word, but not a term."""
    lines = _paragraphs(spark, sf_dir)
    return index.uncovered(lines, "that", index.build(lines, ["that"]), "that")


def last_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_index", "file_name").orderBy(F.desc("doc_index")).limit(10)


def _candidates(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _docs(spark, sf_dir)
        words = T.query_terms(NEAR_QUERY)
        found = search.candidates(index.build(corpus.paragraphs(docs), words), words, mode, docs.count())
        return found.select("doc_index", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))

    return run


def _results(results: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform("matches", lambda m: m["position"].cast("string")), ",")
    extra = ["phase"] if "phase" in results.columns else []
    return results.select("doc_index", "file_name", "file_date", "n_matches", joined.alias("positions"), *extra)


def _search(query: str, indexed: bool, mode: str = "full", view_mode: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _docs(spark, sf_dir)
        lines = corpus.paragraphs(docs)
        postings = index.build(lines, T.query_terms(query)) if indexed else None
        return _results(search.search(query, lines, docs.count() if mode != "full" else 0, postings, mode, view_mode))

    return run


def search_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    lines = corpus.paragraphs(docs)
    return _results(search.two_phase(NEAR_QUERY, lines, docs.count(), index.build(lines, T.query_terms(NEAR_QUERY))))


def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-100 report of the widest query; ``search_places`` has the place of every result."""
    results = _search(ONE_QUERY, True)(spark, sf_dir)
    order = Window.orderBy(F.col("file_date").desc_nulls_last(), F.desc("n_matches"), "doc_index")
    top = search.ranked(results).limit(100)
    return top.withColumn("place", F.row_number().over(order).cast("long")).select("place", "doc_index", "file_date", "n_matches")


def search_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every result of the widest query."""
    results = _search(ONE_QUERY, True)(spark, sf_dir).select("doc_index", "file_date", "n_matches")
    places = dense_index(results, [F.col("file_date").desc_nulls_last(), F.desc("n_matches"), F.col("doc_index")], "place")
    return places.select((F.col("place") + 1).cast("long").alias("place"), "doc_index", "file_date", "n_matches")


def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text's first two different long words as a query, over all documents."""
    lines, queries = _paragraphs(spark, sf_dir), _asked(spark, sf_dir)
    found = search.search_many(queries, lines, index.build(lines, queries.select(F.explode("words").alias("term"))))
    return found.groupBy("query_id", "doc_index").agg(F.count(F.lit(1)).alias("n_matches"))


def filename_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_index", "file_name", T.file_date(F.col("file_name")).alias("file_date"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.load(spark, sf_dir, "pages").select(files.name_of(F.col("url")).alias("name"), F.col("url").alias("path"), "page_id")


def file_name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.file_search(_pages(spark, sf_dir).select("name", "path"), "1")


def file_name_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.file_search(_pages(spark, sf_dir).select("name", "path"), "1", None)


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


def file_policy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file rules over the paths of all pages, as if they were files of year folders, and some odd ones."""
    path, name = F.col("path"), files.name_of(F.col("url"))
    kinds = F.element_at(F.array(*map(F.lit, (".docx", ".xlsx", "", ".tmp", ".DOCX"))), (F.col("page_id") % 5 + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, ("2024/", "2023/.git/", "notes/", "2022/ЕРДР/", "2021/~$"))), (F.col("page_id") % 7 % 5 + 1).cast("int"))
    pages = corpus.load(spark, sf_dir, "pages").select(F.concat(folder, F.coalesce(name, F.lit("")), kinds).alias("path"))
    return pages.unionByName(sample(spark, FILES)).distinct().select(
        "path", files.is_document(path).alias("is_document"), files.in_excluded_folder(path).alias("excluded"),
        files.is_mirrored(path).alias("docx_only"), files.is_mirrored(path, "all_but_archives").alias("all_but_archives"),
    )


def mime_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of all pages as files of several kinds."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("page_id") % len(KINDS) + 1).cast("int"))
    pages = corpus.load(spark, sf_dir, "pages").select("page_id", F.concat(F.col("url"), kind).alias("path"))
    return pages.select("page_id", "path", files.mime_type(F.col("path")).alias("mime_type"))


def network_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files, two of three in the folder that is shared, some of these with backslashes."""
    folder = F.when(F.col("page_id") % 3 == 0, "/tmp/").when(F.col("page_id") % 3 == 1, LOCAL).otherwise(LOCAL.replace("/", "\\"))
    pages = corpus.load(spark, sf_dir, "pages").select("page_id", F.concat(folder, F.col("url")).alias("path"))
    return pages.select("page_id", T.network_path(F.col("path"), LOCAL, SHARE).alias("network_path"))


def _listing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = corpus.load(spark, sf_dir, "documents").select(
        F.concat(F.lit("2024/"), corpus.file_name(F.col("doc_id"))).alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 7 % 1000).alias("mtime_s"), "doc_id"
    )
    old = docs.where("doc_id % 5 <> 0").select(
        "path", F.when(F.col("doc_id") % 4 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(F.col("doc_id") % 3 == 0, F.col("mtime_s") - 1).otherwise(F.col("mtime_s")).alias("mtime_s"),
    )
    return docs.where("doc_id % 6 <> 0").drop("doc_id"), old


def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.sync_plan(*_listing(spark, sf_dir))


def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _listing(spark, sf_dir)
    return changes.file_changes(new, old.withColumnRenamed("mtime_s", "last_modified"))


def listing_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.listing_differences(*_listing(spark, sf_dir))


def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _listing(spark, sf_dir)
    return changes.stale_files(new, old.withColumnRenamed("mtime_s", "last_modified"))


def auto_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of paragraphs whose level follows from their position."""
    lines = _paragraphs(spark, sf_dir)
    level = F.when((F.col("position") * 7 + F.col("doc_index")) % 6 == 0, None).otherwise((F.col("position") * 7 + F.col("doc_index")) % 6)
    return numbering.numbered(lines.select(F.col("doc_index").alias("doc"), F.col("position").alias("seq"), level.alias("level"))).select("doc", "seq", "level", "number")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the documents as raw paragraphs, with list marks and blank ones by position, and some odd ones."""
    docs = _docs(spark, sf_dir).select(F.col("doc_index"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    k = (F.col("i") * 5 + F.col("doc_index")) % 9
    text = F.when(k == 1, "").when(k == 2, F.concat(F.lit("3.1. "), F.col("line"))).when(k == 3, F.concat(F.lit("« 2. "), F.col("line"))).otherwise(F.col("line"))
    rows = docs.select(
        F.concat(F.lit("d"), F.col("doc_index").cast("string")).alias("doc"), F.col("i").cast("long").alias("seq"), text.alias("text"),
        F.when(k == 4, "OiiSList2").when(k == 5, "Oii_S_List_3").alias("style"), F.when(k >= 6, (k - 6).cast("string")).alias("ilvl"), F.when(k >= 6, "1").alias("num_id"),
    )
    return rows.unionByName(sample(spark, RAW))


def docx_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbering of all raw paragraphs."""
    kept = numbering.kept_with_breaks(_raw(spark, sf_dir))
    return numbering.sections(numbering.numbered(numbering.classified(kept))).select("doc", "position", "text", "line_breaks_after")


def docx_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of word-processor files: every document's raw paragraphs as a file's bytes, which are then read."""
    read = docx.read_raw(docx.containers(_raw(spark, sf_dir)))
    return docx.structured(read).select("doc", "position", "text", "line_breaks_after")


def _files(spark: SparkSession, sf_dir: str, folder: str, which: str) -> None:
    """Raw paragraphs of some documents as word-processor files."""
    raw = _raw(spark, sf_dir).where(which)
    docx.write_documents(raw.withColumn("doc", F.concat(F.lit("2024/"), "doc", F.lit(".docx"))), folder)


def docx_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of a folder of files, which the data source lists and reads."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    _files(spark, sf_dir, folder, "true")
    lines, _ = docx.read_folder(spark, folder)
    return lines.select(F.regexp_extract("doc", r"^2024/(.*)\.docx$", 1).alias("doc"), "position", "text", "line_breaks_after")


def refresh_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that follows a folder: two of three files at first, the others when the stream looks again."""
    folder, store = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}", _new_store(spark, "followed")
    late = "coalesce(try_cast(substring(doc, 2) as int), 0) % 3 = 0"
    _files(spark, sf_dir, folder, f"not ({late})")
    refresh.refresh(spark, folder, store)
    _files(spark, sf_dir, folder, late)
    query = refresh.follow(spark, folder, store, f"{shared_folder(spark)}/state-{uuid.uuid4().hex}", once=True)
    query.awaitTermination()
    return segments.numbered(store.snapshot(), "paragraphs").select("doc_index", "file_name", "position", "text", "line_breaks_after")


def listing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes over the pages as files, of which some are missing, changed or back, as events of a stream."""
    passes, root = f"{shared_folder(spark)}/passes-{uuid.uuid4().hex}", shared_folder(spark)
    pages = corpus.load(spark, sf_dir, "pages").select(F.concat(F.col("page_id"), F.lit("/"), F.col("url")).alias("path"), F.length("html").alias("size"), "page_id")
    for number in (1, 2, 3, 4):
        mtime = F.when((F.col("page_id") % 5 == 0) & F.lit(number == 3), 2).otherwise(1).alias("mtime_s")
        here = pages.where((F.col("page_id") + number) % 4 != 0) if number < 4 else pages.where("false")
        watch.record_listing(here.select("path", "size", mtime), passes)
    before = {k: spark.conf.get(k, None) for k in watch.PROVIDER}
    for k, v in watch.PROVIDER.items():
        spark.conf.set(k, v)
    try:
        out = f"{root}/events-{uuid.uuid4().hex}"
        query = watch.events(spark, passes).writeStream.format("parquet").option("path", out)
        query.option("checkpointLocation", f"{root}/state-{uuid.uuid4().hex}").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(watch.EVENTS).parquet(out)


def line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank lines of documents; every 4th line is blanked."""
    docs = _docs(spark, sf_dir)
    raw = docs.select(F.col("doc_index").alias("doc"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    raw = raw.withColumn("text", F.when((F.col("seq") + F.col("doc")) % 4 == 0, "").otherwise(F.col("text"))).withColumn("seq", F.col("seq").cast("long"))
    return numbering.kept_with_breaks(raw).select("doc", "seq", "breaks")


def _levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paragraphs(spark, sf_dir).withColumn("level", ((F.col("position") * 3 + F.col("doc_index")) % 5).cast("int"))


def parent_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context.with_parents(_levelled(spark, sf_dir))
    return found.select("doc_index", "position", "level", F.array_join(F.transform("parents", lambda p: p.cast("string")), ",").alias("parents"))


def section_parent_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _paragraphs(spark, sf_dir)
    text = F.when(F.col("position") % 6 == 2, F.concat(F.lit("§ "), F.col("text"))).otherwise(F.col("text"))
    return context.with_section(lines.withColumn("text", text)).select("doc_index", "position", "section")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paragraphs as lines of orders: by position some have signs, numbers, actions, bases or ranks before them; some files are personal."""
    lines = _paragraphs(spark, sf_dir)
    k = (F.col("position") * 5 + F.col("doc_index")) % len(MARKS)
    mark = F.element_at(F.array(*map(F.lit, MARKS)), (k + 1).cast("int"))
    name = F.concat(F.when(F.col("doc_index") % 4 == 0, F.lit("Особовий ")).otherwise(F.lit("")), F.col("file_name"))
    return lines.select("doc_index", name.alias("file_name"), "position", F.concat(mark, F.col("text")).alias("text"))


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(matches, lines): the marked paragraphs, and after them the sample's under doc_indexes of their own."""
    odd = sample(spark, LINES).withColumn("doc_index", F.col("doc_index") + SAMPLE_FROM)
    lines = _marked(spark, sf_dir).select("doc_index", "position", "text", F.contains("text", F.lit(ONE_QUERY)).alias("is_match")).unionByName(odd)
    return lines.where("is_match"), lines


def followup_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.followup_personal(*_lines(spark, sf_dir))


def followup_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.followup_ordinary(*_lines(spark, sf_dir))


def heading_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _lines(spark, sf_dir)[1].select(
        "doc_index", "position", T.heading_level(text).cast("long").alias("level"), T.heading_category(text).alias("category"), T.document_category(text).alias("in_document")
    )


def _joined(parts: str) -> Column:
    return F.array_join(F.col(parts), "\n").alias(parts)


def match_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown around every paragraph with the query's word."""
    lines = _marked(spark, sf_dir)
    found = context.extracts(lines, lines.where(F.contains("text", F.lit(ONE_QUERY))))
    return found.select("doc_index", "position", "is_personal", _joined("parents"), "action", _joined("followups"), "basis")


def document_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _marked(spark, sf_dir)
    found = context.document_flags(lines, lines.where(search.verified(T.query_terms(NEAR_QUERY))))
    return found.select("doc_index", "position", "is_match", "is_parent", "category")


def highlight_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _paragraphs(spark, sf_dir).where(F.contains(T.normalised(F.col("text")), F.lit(ONE_QUERY)))
    return lines.select("doc_index", "position", T.highlight(F.col("text"), [ONE_QUERY]).alias("marked"))


def highlight_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two Ukrainian words: in a row in some lines, apart in others."""
    lines = _marked(spark, sf_dir)
    return lines.select("doc_index", "position", T.highlight(F.col("text"), list(SEQUENCE)).alias("marked"))


def full_document_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _paragraphs(spark, sf_dir)
    matches = lines.where(search.verified(T.query_terms(NEAR_QUERY)))
    return context.document_flags(lines, matches).select("doc_index", "position", "is_match")


#: Stores that this process has made, by application and tables.
_stores: dict[tuple[str, str], Store] = {}


def _versions(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """Documents as rows of a stored index; their paths are in the order of their ids."""
    key = F.lit(None).cast("long") if key is None else key
    return docs.select(key.alias("doc_key"), F.format_string("%020d", "doc_id").alias("file_path"), "file_name")


def _text(docs: DataFrame) -> DataFrame:
    lines = corpus.paragraphs(docs.select(F.col("doc_id").alias("doc_index"), "file_name", "text"))
    return lines.select(F.format_string("%020d", "doc_index").alias("file_path"), "position", "text", F.lit(0).cast("long").alias("line_breaks_after"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.load(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("file_name", corpus.file_name(F.col("doc_id")))


def _new_store(spark: SparkSession, kind: str) -> Store:
    return Store(spark, f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}")


def _stored(spark: SparkSession, sf_dir: str, with_grams: bool = False) -> Store:
    """The documents as a stored index of one segment; made at the first call and used again. Runs of three characters are added for the first query that reads them."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stores:
        store, docs = _new_store(spark, "index"), _named(spark, sf_dir)
        segments.update(store.snapshot(), _versions(docs), _text(docs))
        _stores[key] = store
    if with_grams:
        segments.add_grams(_stores[key])
    return _stores[key]


def index_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored index holds."""
    now = _stored(spark, sf_dir, with_grams=True).snapshot()
    n = lambda t: F.sum("documents") if t == "grams" else F.count(F.lit(1))
    sizes = [now.read(t).groupBy(F.lit(t).alias("table")).agg(n(t).alias("n")) for t in sorted(now.tables)]
    return reduce(DataFrame.unionByName, sizes)


def search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide query as a scan finds it, from the stored runs of three characters."""
    return _results(segments.search(_stored(spark, sf_dir, with_grams=True).snapshot(), WIDE_QUERY, substring=True))


def file_name_search_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names that contain a few characters, from an index of names."""
    pages = _pages(spark, sf_dir).select("name", "path")
    return grams.file_search(grams.build_names(pages), pages, NAME_QUERY, None)


def search_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown around every paragraph with the query's word, as a scan finds it, looked up in a stored outline."""
    store, lines = _new_store(spark, "outline"), _marked(spark, sf_dir)
    path, key = F.format_string("%020d", "doc_index").alias("file_path"), F.lit(None).cast("long").alias("doc_key")
    docs = lines.select(key, path, "file_name").distinct()
    # Documents without a line have a place too, so that indexes are those of the corpus.
    blank = _docs(spark, sf_dir).select(key, path, "file_name").join(docs.select("file_path"), "file_path", "left_anti")
    text = lines.select(path, "position", "text", F.lit(0).cast("long").alias("line_breaks_after"))
    now = segments.update(store.snapshot(), docs.unionByName(blank.select(docs.columns)), text)
    found = segments.search_extracts(now, ONE_QUERY, substring=True)
    return found.select("doc_index", "position", "is_personal", _joined("parents"), "action", _joined("followups"), "basis")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text's first two different long words as a query."""
    words = F.slice(F.array_distinct(F.filter(T.tokens(F.col("text")), lambda w: F.length(w) >= 4)), 1, 2)
    return corpus.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("words")).where(F.size("words") == 2)


def batch_search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's queries over the stored index."""
    found = segments.search_many(_stored(spark, sf_dir).snapshot(), _asked(spark, sf_dir))
    return found.groupBy("query_id", "doc_index").agg(F.count(F.lit(1)).alias("n_matches"))


def batch_search_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from buckets of an index that was updated before, without a shuffle of postings or paragraphs."""
    store = _segmented(spark, sf_dir)
    found = buckets.search_many(buckets.write(store), _asked(spark, sf_dir))
    return found.groupBy("query_id", "doc_index").agg(F.count(F.lit(1)).alias("n_matches"))


def batch_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's queries in one pass over all paragraphs, by an automaton of their words."""
    found = scan.scan_many(_asked(spark, sf_dir), _paragraphs(spark, sf_dir))
    return found.groupBy("query_id", "doc_index").agg(F.count(F.lit(1)).alias("n_matches"))


def search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide query over a stored snapshot."""
    return _results(segments.search(_stored(spark, sf_dir).snapshot(), WIDE_QUERY))


def search_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's full search over a stored snapshot, with its counts."""
    results, counts = segments.request(_stored(spark, sf_dir).snapshot(), NEAR_QUERY, full_search=True)
    return _results(results).withColumns({name: F.lit(n).cast("long") for name, n in counts.items()})


def _segmented(spark: SparkSession, sf_dir: str) -> Store:
    """A stored index after an update: at first two of three documents; then the rest is new, the labelled ones are cut to their upper half, the toxic ones gone."""
    store, docs, labels = _new_store(spark, "segments"), _named(spark, sf_dir), corpus.load(spark, sf_dir, "labels").select("doc_id", "toxic").distinct()
    first = docs.where("doc_id % 3 <> 0")
    segments.update(store.snapshot(), _versions(first), _text(first))

    def step(base: Snapshot) -> None:
        known = segments.live(base, "documents").select(F.col("file_path").cast("long").alias("doc_id"), "rev", "doc_key")
        ended = known.join(labels.groupBy("doc_id").agg((F.max("toxic") == 1).alias("gone")), "doc_id")
        half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
        changed = docs.join(ended.where("not gone").select("doc_id", "doc_key"), "doc_id").withColumn("text", half)
        fresh = docs.where("doc_id % 3 = 0").withColumn("doc_key", F.lit(None).cast("long")).unionByName(changed)
        segments.update(base, _versions(fresh, F.col("doc_key")), _text(fresh), ended.select("rev", "doc_key", "gone"))

    store.updated(step)
    return store


def refresh_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of an updated index, under dense indexes."""
    return _flat(segments.numbered(_segmented(spark, sf_dir).snapshot(), "postings"))


def index_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after compaction."""
    store = _segmented(spark, sf_dir)
    segments.compact(store)
    store.vacuum(grace=0)  # the tables of earlier snapshots go
    return _flat(segments.numbered(store.snapshot(), "postings"))


def segment_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many postings and positions the update added and removed, and how many there are, as its manifest has them."""
    found = _segmented(spark, sf_dir).snapshot().properties
    kinds = [f"{c}{end}" for c in ("postings", "positions") for end in ("_added", "_removed", "")]
    return spark.createDataFrame([tuple(found[k] for k in kinds)], ", ".join(f"{k} long" for k in kinds))


def search_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quick search over an updated index: the documents with the highest indexes."""
    return _results(segments.search(_segmented(spark, sf_dir).snapshot(), NEAR_QUERY, "quick"))


def commit_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers that begin from one snapshot: the slower one finds the conflict and runs again, so that both commits are there."""
    store, docs = _new_store(spark, "conflict"), corpus.load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    store.commit(documents=docs.where("doc_id % 2 = 0").withColumn("writer", F.lit(0)))
    tries = []

    def slower(base: Snapshot) -> Snapshot:
        if not tries:  # the other writer comes between
            store.commit(store.snapshot(), append={"documents": docs.where("doc_id % 4 = 1").withColumn("writer", F.lit(1))})
        tries.append(base.number)
        held = base.read("documents").select("doc_id")
        return store.commit(base, append={"documents": docs.join(held, "doc_id", "left_anti").withColumn("writer", F.lit(2))})

    made = store.updated(slower)
    return made.read("documents").select("doc_id", "lang", "n_chars", "writer", F.lit(len(tries)).alias("tries"), F.lit(made.number).alias("snapshot"))


def search_friendly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of the marked lines for words with commas and endings."""
    return _results(search.search(FRIENDLY_QUERY, _marked(spark, sf_dir), 0, friendly=True))


def index_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index that lacks two thirds of its documents, found out and built anew."""
    store, docs = _new_store(spark, "rebuilt"), _named(spark, sf_dir)
    made = segments.update(store.snapshot(), _versions(docs), _text(docs))
    store.commit(made, postings=store.written("postings", made.read("postings").where("rev % 3 = 0"), in_ranges=True))
    maintenance.rebuild_if_needed(store)
    return _flat(segments.numbered(store.snapshot(), "postings"))


def postings_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changing the labelled documents (their upper half is left) and removing the toxic ones adds and takes away."""
    docs = _docs(spark, sf_dir)
    labels = corpus.load(spark, sf_dir, "labels")
    changed = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    new = changed.withColumn("text", F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int")))
    old = stored(index.build(corpus.paragraphs(docs)), "before")
    gone = docs.join(labels.where("toxic = 1"), "doc_id", "left_semi")
    touched = changed.select("doc_index").unionByName(gone.select("doc_index"))
    return index.difference(old, index.remove(index.update(old, changed, corpus.paragraphs(new)), gone), touched)


def index_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with an index in which postings occur twice, are empty, or belong to documents that are gone."""
    docs = _docs(spark, sf_dir)
    rows = stored(index.build(corpus.paragraphs(docs)), "built")  # read twice
    bad = rows.withColumn("positions", F.filter("positions", lambda p: p % 2 == 0)).unionByName(rows.where("doc_index % 3 = 0"))
    return maintenance.repaired(bad, docs.count() - 20)[1]


def index_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    rows = stored(index.build(corpus.paragraphs(docs)), "built")  # read twice
    bad = rows.withColumn("positions", F.filter("positions", lambda p: p % 2 == 0)).unionByName(rows.where("doc_index % 3 = 0"))
    return _flat(maintenance.repaired(bad, docs.count() - 20)[0])


def conversation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index over another corpus: conversations, a turn being a paragraph."""
    turns = corpus.load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_index"), F.col("turn").cast("long").alias("position"), "text")
    words = T.query_terms(NEAR_QUERY)
    found = search.candidates(index.build(turns, words), words, "full", 0)
    return found.select("doc_index", F.size("positions").cast("long").alias("n_positions"))


def event_feed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change feed reduced to the last event of each key, by a partial aggregate."""
    events = corpus.load(spark, sf_dir, "events")
    last = F.max(F.struct("ts", "event_id", "event_type"))
    return events.groupBy("user_id").agg(last.alias("last"), F.count(F.lit(1)).alias("n")).select("user_id", "n", F.col("last.event_id").alias("event_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        paragraph_explode, doc_stats, corpus_totals, tokenize_terms, stem_cases, postings_build, term_doc_freq, index_stats, postings_remove_docs,
        postings_incremental, postings_renumber, postings_dedupe, postings_cleanup, index_validation, documents_validation, index_coverage,
        last_documents, search_two_phase, search_ranked, search_places, batch_search, filename_dates, file_name_search, file_name_search_all, file_listing,
        file_policy_filter, sync_plan, change_detection, auto_numbering, docx_structure, line_breaks, parent_headings, section_parent_asof,
        followup_personal, followup_section, heading_classes, highlight_marks, full_document_flags, conversation_search, event_feed_latest,
        match_extracts, document_view, highlight_sequences, search_stored, search_request, postings_changes, index_repair, index_repaired,
        mime_types, network_paths, listing_differences, stale_files, docx_containers, search_friendly, index_rebuilt, refresh_segments, index_compacted, search_segments, segment_changes,
        commit_conflict, index_stored, search_substring, file_name_search_grams, search_extracts, batch_search_stored, batch_search_bucketed, batch_scan, docx_folder,
        refresh_folder, listing_events,
    )
}
QUERIES |= {f"candidates_{m}": _candidates(m) for m in search.MODES}
QUERIES |= {
    "search_index": _search(NEAR_QUERY, True), "search_wide": _search(WIDE_QUERY, True), "search_one_word": _search(ONE_QUERY, True),
    "search_scan": _search(WIDE_QUERY, False), "search_name_proximity": _search(NEAR_QUERY, False), "search_quick": _search(NEAR_QUERY, True, "quick"),
    "search_remaining": _search(NEAR_QUERY, True, "remaining"), "search_fragments_exclude": _search(ONE_QUERY, False, "full", "fragments"),
}
