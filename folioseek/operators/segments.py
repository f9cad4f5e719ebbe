"""A stored index in segments: an update appends rows and marks old ones as deleted, compaction is a step of its own.

Each version of a document has a number of its own, ``rev``, under which its paragraphs and postings are stored; the document itself keeps
its ``doc_key``, which grows with the order of insertion. A new version of a document, or its end, marks the old rev in the table
``deleted``. So an update writes what changed and nothing else, and a reader leaves out the marked revs. The dense doc_index that callers
see is computed on reading: a document's key less the number of documents with smaller keys that are gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import Snapshot, Store
from ..tables import dense_index, stored
from . import context, grams, index
from . import search as searching

#: Marks that are broadcast at most.
BROADCAST_MARKS = 1_000_000
#: New versions whose paths, names and revs are broadcast at most.
BROADCAST_VERSIONS = 200_000
#: Keys of a block, for which the number of documents gone before is kept.
KEYS_BLOCK = 4096
#: Blocks that are broadcast at most, if the marks are few as well.
BROADCAST_BLOCKS = 10_000


def live(snapshot: Snapshot, table: str) -> DataFrame:
    """The rows of a table whose rev is not marked as deleted. The marks are broadcast if they are few by the manifest's count."""
    rows = snapshot.read(table)
    if table == "grams":  # lists of several documents; rows by place
        rows = grams.entries(rows).withColumnRenamed("doc_index", "rev")
    if not snapshot.has("deleted"):
        return rows
    marks = snapshot.read("deleted").select("rev")
    return rows.join(F.broadcast(marks) if snapshot.properties["marks"] <= BROADCAST_MARKS else marks, "rev", "left_anti")


def with_index(snapshot: Snapshot, rows: DataFrame) -> DataFrame:
    """``rows`` (with doc_key) and their dense doc_index."""
    if not snapshot.has("deleted"):
        return rows.withColumn("doc_index", F.col("doc_key"))
    block = lambda key: F.floor(key / KEYS_BLOCK)
    gone = snapshot.read("deleted").where("gone").select("doc_key")
    filled = gone.groupBy(block(F.col("doc_key")).alias("_block")).agg(F.collect_list("doc_key").alias("_keys"))  # KEYS_BLOCK at most
    n = snapshot.properties["next_key"] // KEYS_BLOCK + 1
    sizes = stored(snapshot.store.spark.range(n).select(F.col("id").alias("_block")).join(filled, "_block", "left"), "blocks")
    counted = _running(sizes.select("_block", F.coalesce(F.size("_keys"), F.lit(0)).alias("_n")))
    blocks = sizes.join(counted, "_block")
    few = n <= BROADCAST_BLOCKS and snapshot.properties["marks"] <= BROADCAST_MARKS
    found = rows.withColumn("_block", block(F.col("doc_key"))).join(F.broadcast(blocks) if few else blocks, "_block")
    inside = F.coalesce(F.size(F.filter("_keys", lambda k: k < F.col("doc_key"))), F.lit(0))
    return found.withColumn("doc_index", F.col("doc_key") - F.col("_before") - inside).drop("_block", "_keys", "_before")


def _running(sizes: DataFrame) -> DataFrame:
    """_block, _n -> _block, _before: the sum of _n over earlier blocks, by groups of ``KEYS_BLOCK`` blocks, so that no task has all."""
    group = F.floor(F.col("_block") / KEYS_BLOCK).alias("_group")
    earlier = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)  # a row for 16 million keys
    starts = sizes.groupBy(group).agg(F.sum("_n").alias("_sum")).select("_group", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("_group", group).withColumn("_own", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return rows.join(starts, "_group").select("_block", (F.col("_own") + F.col("_start")).alias("_before"))


#: Tables that follow from the paragraphs; grams only if they are asked for.
DERIVED = {"postings": index.lists, "outline": context.outline, "grams": grams.build}
#: ``sizes``: postings and positions of each rev, so that what an update takes away is known without a look at the postings.
TABLES = ("documents", "paragraphs", *DERIVED, "sizes")


def _entries() -> dict[str, Column]:
    return {"postings": F.count(F.lit(1)), "positions": F.coalesce(F.sum(F.size("positions")), F.lit(0)).cast("long")}


def listed(lists: DataFrame) -> DataFrame:
    """``index.LISTS`` written once, under the names of the stored postings: rev holds the documents, positions the packed places, _n the sizes (if they are there)."""
    rev, more = (F.struct("first", "docs"), [F.col("sizes").alias("_n")]) if "sizes" in lists.columns else (F.struct("first"), [])
    return stored(lists.select("term", rev.alias("rev"), F.col("places").alias("positions"), *more), "made")


def written_postings(store: Store, made: DataFrame, lines: DataFrame, key: str = "rev") -> tuple[str, dict[str, int]]:
    """The name of the postings of ``listed`` lists, and how many there are. Lists are dealt in ranges and sorted, and are opened as they are written. ``lines`` have been indexed by ``key``."""
    doc, place = (lines.schema[c].dataType for c in (key, "position"))
    opened = lambda rows: index.opened(rows.withColumnRenamed(key, "first"), doc, place).withColumnRenamed("doc_index", key)
    return store.counted("postings", made.select("term", F.col("rev.first").alias(key), F.col("positions").alias("places")), opened, **_entries())


def update(base: Snapshot, fresh: DataFrame, lines: DataFrame, dropped: DataFrame | None = None, with_grams: bool = False) -> Snapshot:
    """Append versions of documents and mark others; commits on ``base``, which is a ``Conflict`` if another writer came first.

    ``fresh``: file_path, file_name, doc_key (null for a new document, which goes after all others, in the order of paths) and any columns of
    documents. ``lines``: file_path, position, text, line_breaks_after of these. ``dropped``: rev, doc_key, gone of the versions that end (gone: without
    a new one). The properties of the new snapshot tell how many postings and positions the update added and removed, and how many there are:
    they are observed while the rows are written, and summed from the sizes of dropped revs. Only these rows are written: paragraphs, postings, outline and, if the store has them or they are asked for with its first
    segment, grams.
    """
    store, known = base.store, base.properties
    next_key, next_rev = known.get("next_key", 0), known.get("next_rev", 0)
    fresh = stored(fresh, "fresh")
    n, n_new = fresh.agg(F.count(F.lit(1)), F.count_if(F.col("doc_key").isNull())).first()
    order = [F.col("doc_key").isNull().asc(), F.col("doc_key").asc(), F.col("file_path").asc()]
    placed = dense_index(fresh.select("file_path", "doc_key"), order, "_place").drop("doc_key")
    key = F.coalesce("doc_key", F.col("_place") - (n - n_new) + next_key)
    docs = stored(fresh.join(placed, "file_path").withColumn("doc_key", key).withColumn("rev", F.col("_place") + next_rev).drop("_place"), "versions")
    append: dict[str, DataFrame | str] = {}
    added = removed = {"postings": 0, "positions": 0}
    if n:
        own = lines.select("file_path", "position", "text", "line_breaks_after")
        keys = docs.select("file_path", "file_name", "rev")
        keys = F.broadcast(keys) if n <= BROADCAST_VERSIONS else keys.hint("shuffle_hash")  # texts are not sorted for their paths
        text = own.join(keys, "file_path").select("rev", "file_name", "position", "text", "line_breaks_after")
        append = {"documents": docs, "paragraphs": store.written("paragraphs", text)}
        written = store.spark.read.parquet(f"{store.folder}/{append['paragraphs']}")
        for table, build in DERIVED.items():
            if table != "grams" or (base.has("grams") if known.get("segments") else with_grams):
                append[table] = build(written.withColumnRenamed("rev", "doc_index"))
        # Written as they are made: ranges are found by a look at all rows, which would make them twice.
        append["outline"] = stored(append["outline"].withColumnRenamed("doc_index", "rev"), "outlined")
        # Lengths stand beside the lists, so that sizes are summed from narrow columns.
        made = listed(append["postings"])
        append["postings"], added = written_postings(store, made, written)
        append["sizes"] = index.list_sizes(made.select("rev.first", "rev.docs", F.col("_n").alias("sizes"))).withColumnRenamed("doc_index", "rev")
    marks = gone = 0
    if dropped is not None:
        dropped = stored(dropped.select("rev", "doc_key", "gone"), "dropped")
        marks, gone = dropped.agg(F.count(F.lit(1)), F.count_if("gone")).first()
        if marks:
            append["deleted"] = dropped
            mine = base.read("sizes").join(dropped, "rev", "left_semi")
            removed = mine.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in added)).first().asDict()
    properties = {
        "next_key": next_key + n_new, "next_rev": next_rev + n, "documents": known.get("documents", 0) + n_new - gone,
        "segments": known.get("segments", 0) + bool(n), "marks": known.get("marks", 0) + marks,
    }
    for c in added:
        properties |= {f"{c}_added": added[c], f"{c}_removed": removed[c], c: known.get(c, 0) + added[c] - removed[c]}
    return store.commit(base, append=append, properties=properties)


def add_grams(store: Store) -> bool:
    """Add the runs of three characters to a store that was made without them, from its paragraphs; whether it did. Updates keep them from then on."""

    def step(base: Snapshot) -> bool:
        if base.has("grams"):
            return False
        store.commit(base, grams=grams.build(base.read("paragraphs").withColumnRenamed("rev", "doc_index")))
        return True

    return store.updated(step)


def compact(store: Store, most_segments: int = 1) -> bool:
    """Write all live rows as one segment with dense keys, if there are more than ``most_segments`` of them or marks; whether it did."""

    def step(base: Snapshot) -> bool:
        if base.properties.get("segments", 0) <= most_segments and not (most_segments == 1 and base.properties.get("marks", 0)):
            return False
        docs = live(base, "documents")
        numbers = stored(dense_index(docs.select("rev", "doc_key"), [F.col("doc_key")], "new").select("rev", "new"), "numbers")
        again = lambda rows: rows.join(numbers, "rev").withColumn("rev", F.col("new")).drop("new")
        n = numbers.count()
        properties = {"next_key": n, "next_rev": n, "documents": n, "segments": 1, "marks": 0}
        docs = docs.join(numbers, "rev").withColumns({"rev": F.col("new"), "doc_key": F.col("new")}).drop("new")
        rest = {t: again(live(base, t)) for t in TABLES if t not in ("documents", "grams") and base.has(t)}
        if base.has("grams"):
            rest["grams"] = grams.build(rest["paragraphs"].withColumnRenamed("rev", "doc_index"))
        store.commit(base, drop=("deleted",), properties=properties, documents=docs, **rest)
        return True

    return store.updated(step)


def _first_versions(snapshot: Snapshot) -> bool:
    """Whether the manifest tells that every version is the only one of its document and none has ended, so that rev, doc_key and doc_index are one number."""
    known = snapshot.properties
    return not snapshot.has("deleted") and "next_rev" in known and known["next_rev"] == known["next_key"] == known["documents"]


def _under_rev(snapshot: Snapshot, rows: DataFrame, rev: str) -> DataFrame:
    """Rows of known documents with rev as doc_index, where these are one number: no row is joined with its document."""
    inside = rows.where(F.col(rev).between(0, snapshot.properties["next_rev"] - 1))
    return inside.select(*(c for c in rows.columns if c != rev), F.col(rev).cast("long").alias("doc_index"))


def numbered(snapshot: Snapshot, table: str) -> DataFrame:
    """Live rows of a table under their dense doc_index, in place of rev and doc_key."""
    if table != "documents" and _first_versions(snapshot):
        return _under_rev(snapshot, live(snapshot, table), "rev")
    docs = with_index(snapshot, live(snapshot, "documents"))
    if table == "documents":
        return docs.drop("rev", "doc_key")
    return live(snapshot, table).join(docs.select("rev", "doc_index"), "rev").drop("rev")


def _in_mode(snapshot: Snapshot, mode: str) -> Column:
    """A predicate on rev: the quick documents are those with the highest keys."""
    if mode not in searching.MODES:
        raise ValueError(f"mode is one of {', '.join(searching.MODES)}, not {mode!r}")
    if mode == "full":
        return F.lit(True)
    last = live(snapshot, "documents").select("doc_key", "rev").orderBy(F.desc("doc_key")).limit(searching.QUICK_DOCUMENTS)
    quick = F.col("rev").isin([r["rev"] for r in last.collect()])
    return quick if mode == "quick" else ~quick


def _matches(snapshot: Snapshot, query: str, mode: str, view_mode: str | None, friendly: bool, substring: bool) -> DataFrame:
    """rev (as doc_index), file_name, position, text of the matching paragraphs."""
    words, chosen = T.query_terms(query, friendly), F.lit(True) if substring else _in_mode(snapshot, mode)
    as_index = lambda table: live(snapshot, table).where(chosen).withColumnRenamed("rev", "doc_index")
    if not substring:
        return searching.matches(words, as_index("paragraphs"), as_index("postings"), view_mode == "fragments")
    if not snapshot.has("grams"):
        return searching.matches(words, as_index("paragraphs"), None, view_mode == "fragments")
    # Places in marked revs meet no live paragraph.
    return grams.matches(words, as_index("paragraphs"), snapshot.read("grams"), view_mode == "fragments")


def indexed(snapshot: Snapshot, rows: DataFrame) -> DataFrame:
    """Rows whose doc_index is a rev, under the dense doc_index."""
    if _first_versions(snapshot):
        return _under_rev(snapshot, rows, "doc_index")
    keys = live(snapshot, "documents").select(F.col("rev").alias("doc_index"), "doc_key")
    return with_index(snapshot, rows.join(keys, "doc_index").drop("doc_index")).drop("doc_key")


def search(snapshot: Snapshot, query: str, mode: str = "full", view_mode: str | None = None, friendly: bool = False, substring: bool = False) -> DataFrame:
    """Matching documents of a snapshot, ranked, as ``operators.search.search`` gives them.

    Terms and marks are looked up first; only the paragraphs of candidates are read, by ranges of rev. ``substring``: as a scan without an index
    finds them, words being parts of words and ``mode`` without effect; from the grams, if the store has them.
    """
    found = _matches(snapshot, query, mode, view_mode, friendly, substring)
    return searching.ranked(searching.grouped(indexed(snapshot, found)))


def search_extracts(snapshot: Snapshot, query: str, mode: str = "full", view_mode: str | None = None, friendly: bool = False, substring: bool = False) -> DataFrame:
    """What is shown around each matching paragraph (see ``context.extracts``), looked up in the stored outline of its document."""
    found = stored(_matches(snapshot, query, mode, view_mode, friendly, substring).select("doc_index", "position"), "matches")
    docs = stored(found.select("doc_index").distinct(), "found")
    docs = F.broadcast(docs) if docs.count() <= BROADCAST_MARKS else docs
    mine = lambda table: live(snapshot, table).withColumnRenamed("rev", "doc_index").join(docs, "doc_index", "left_semi")
    return indexed(snapshot, context.extracts_by(mine("outline"), mine("paragraphs"), found))


def search_many(snapshot: Snapshot, queries: DataFrame) -> DataFrame:
    """(query_id, words) -> query_id, doc_index, position of every matching paragraph of a snapshot."""
    as_index = lambda table: live(snapshot, table).withColumnRenamed("rev", "doc_index")
    return indexed(snapshot, searching.search_many(queries, as_index("paragraphs"), as_index("postings")))


def request(snapshot: Snapshot, query: str, full_search: bool = False, view_mode: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """A search as a caller of the service makes it: (results, {count, total_count}), as ``operators.search.request`` gives them."""
    if not query.strip():
        raise ValueError("the query is blank")
    results = stored(search(snapshot, query, "remaining" if full_search else "quick", view_mode), "results")
    return searching.ranked(results), {"count": results.count(), "total_count": snapshot.properties["documents"]}
