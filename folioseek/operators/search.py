"""Search: candidates from the index, verification on the paragraphs, grouping and order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import stored

#: Documents of the quick mode: those with the highest indexes.
QUICK_DOCUMENTS = 170
#: Files that a name search returns.
MOST_FILES = 200
#: Characters of a query, and of a file name's part, below which a caller's search does not begin.
LEAST_QUERY, LEAST_NAME = 3, 2
#: Paragraphs to verify that are broadcast at most; more are joined by Spark as it likes.
BROADCAST_HITS = 200_000
MODES = ("quick", "remaining", "full")


def in_mode(mode: str, total_documents: int) -> Column:
    """A predicate on doc_index."""
    first = max(0, total_documents - QUICK_DOCUMENTS)
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}, not {mode!r}")
    return {"quick": F.col("doc_index") >= first, "remaining": F.col("doc_index") < first, "full": F.lit(True)}[mode]


def candidates(postings: DataFrame, words: list[str], mode: str, total_documents: int) -> DataFrame:
    """Documents of the mode that have every word, with the positions of any: one aggregate, no join."""
    terms = sorted(set(words))
    mine = postings.where(F.col("term").isin(terms) & in_mode(mode, total_documents))
    positions = F.sort_array(F.array_distinct(F.flatten(F.collect_list("positions"))))
    found = mine.groupBy("doc_index").agg(F.countDistinct("term").alias("n"), positions.alias("positions"))
    return found.where(F.col("n") == len(terms)).select("doc_index", "positions")


def verified(words: list[str], without_basis: bool = False, text: str = "text") -> Column:
    """A predicate on a paragraph: all words are in it; two or three of them near and in order."""
    norm = T.normalised(F.col(text))
    tests = [F.contains(norm, F.lit(w)) for w in dict.fromkeys(words)]
    if 2 <= len(words) <= 3:
        tests.append(T.near_in_order(norm, F.array(*map(F.lit, words))))
    if without_basis:
        tests.append(~T.is_basis(F.col(text)))
    return reduce(Column.__and__, tests)


def grouped(matches: DataFrame) -> DataFrame:
    """doc_index, file_name, position, text -> a row for each document with its matches, ranked columns added."""
    found = matches.groupBy("doc_index", "file_name").agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("matches"))
    return found.withColumn("n_matches", F.size("matches").cast("long")).withColumn("file_date", T.file_date(F.col("file_name")))


def ranked(results: DataFrame, *before: Column) -> DataFrame:
    """Newest file date first, undated last, then most matches; equal ones by doc_index."""
    return results.orderBy(*before, F.col("file_date").desc_nulls_last(), F.col("n_matches").desc(), F.col("doc_index").asc())


def search(
    query: str, paragraphs: DataFrame, total_documents: int, postings: DataFrame | None = None, mode: str = "full",
    view_mode: str | None = None, friendly: bool = False,
) -> DataFrame:
    """Matching documents, ranked. Without ``postings`` all paragraphs are scanned and ``mode`` has no effect.

    ``view_mode="fragments"`` leaves out basis paragraphs. A query without words finds nothing.
    """
    found = matches(T.query_terms(query, friendly), paragraphs, None if postings is None else postings.where(in_mode(mode, total_documents)), view_mode == "fragments")
    return ranked(grouped(found))


def matches(words: list[str], paragraphs: DataFrame, postings: DataFrame | None, without_basis: bool = False) -> DataFrame:
    """doc_index, file_name, position, text of the paragraphs that match: those of the candidates in ``postings``, or of all if it is None."""
    rows = paragraphs.select("doc_index", "file_name", "position", "text")
    if not words:
        return rows.where(F.lit(False))
    if postings is not None:
        hits = candidates(postings, words, "full", 0).select("doc_index", F.explode("positions").alias("position"))
        rows = at(rows, stored(hits, "hits"))
    return rows.where(verified(words, without_basis))


def at(paragraphs: DataFrame, hits: DataFrame) -> DataFrame:
    """The paragraphs at these places (a written table), which are broadcast if they are counted to be few."""
    return paragraphs.join(F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits, ["doc_index", "position"], "left_semi")


def request(
    query: str, paragraphs: DataFrame, total_documents: int, postings: DataFrame, full_search: bool = False, view_mode: str | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """A search as a caller of the service makes it: (results, {count, total_count}).

    A blank query is an error. ``full_search`` asks for the remaining documents, else for the quick ones; ``count`` is the number of documents
    returned, ``total_count`` that of the corpus.
    """
    if not query.strip():
        raise ValueError("the query is blank")
    results = stored(search(query, paragraphs, total_documents, postings, "remaining" if full_search else "quick", view_mode), "results")
    return ranked(results), {"count": results.count(), "total_count": total_documents}


def two_phase(query: str, paragraphs: DataFrame, total_documents: int, postings: DataFrame, **options) -> DataFrame:
    """The quick documents' matches, then the remaining ones', each ranked; ``phase`` tells which.

    One search gives both. A query of fewer than ``LEAST_QUERY`` characters finds nothing.
    """
    found = search(query if len(query.strip()) >= LEAST_QUERY else "", paragraphs, total_documents, postings, "full", **options)
    return ranked(found.withColumn("phase", F.when(in_mode("quick", total_documents), 0).otherwise(1)), F.col("phase").asc())


def _few(rows: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is counted to be small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_HITS else rows


def search_many(queries: DataFrame, paragraphs: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, words) -> query_id, doc_index, position of every matching paragraph.

    The postings of the queries' words alone are kept. Each query's rarest word gives its candidates, and its other words are looked up for
    these by word and document, so that a common word is never joined with all the queries that have it. Paragraphs are read, and normalised, at
    the places of candidates only. Queries, candidates and places are broadcast where they are counted to be few.
    """
    asked = queries.select("query_id", F.array_distinct("words").alias("terms"))
    terms = stored(asked.select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("k")), "terms")
    mine = postings.join(_few(stored(terms.select("term").distinct(), "words")), "term", "left_semi").select("term", "doc_index", "positions")
    mine = stored(mine.repartitionByRange("term", "doc_index").sortWithinPartitions("term", "doc_index"), "wanted")
    sizes = mine.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.col("n").asc(), F.col("term").asc())
    known = terms.join(sizes, "term").withColumn("place", F.row_number().over(order)).withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    known = stored(known.where(F.col("found") == F.col("k")).drop("found", "n"), "known")  # a query with an unknown word finds nothing
    rarest, others = known.where("place = 1"), known.where("place > 1").select("query_id", "term")
    first = stored(mine.join(_few(rarest.select("query_id", "term", "k")), "term").select("query_id", "k", "doc_index", "positions"), "candidates")
    more = _few(stored(first.select("query_id", "k", "doc_index").join(_few(others), "query_id"), "looked-up"))
    more = mine.join(more, ["term", "doc_index"]).select("query_id", "k", "doc_index", "positions")
    every = first.unionByName(more).groupBy("query_id", "k", "doc_index").agg(
        F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions")
    )
    hits = stored(every.where(F.col("n") == F.col("k")).select("query_id", "doc_index", F.explode("positions").alias("position")), "hits")
    lines = at(paragraphs.select("doc_index", "position", "text"), stored(hits.select("doc_index", "position").distinct(), "places"))
    lines = lines.select("doc_index", "position", T.normalised(F.col("text")).alias("norm"))
    near = ~F.size("words").between(2, 3) | T.near_in_order(F.col("norm"), F.col("words"))
    all_in = F.forall("words", lambda w: F.contains(F.col("norm"), w))
    found = lines.join(_few(hits), ["doc_index", "position"]).join(_few(stored(queries.select("query_id", "words"), "queries")), "query_id")
    return found.where(all_in & near).select("query_id", "doc_index", "position")


def file_search(files: DataFrame, query: str, limit: int | None = MOST_FILES, least: int = 1) -> DataFrame:
    """Files (name, path) whose name contains the query in any case, by path; ``limit`` None returns all.

    A blank query is an error; one of fewer than ``least`` characters finds nothing.
    """
    if not query.strip():
        raise ValueError("the query is blank")
    if len(query.strip()) < least:
        return files.where(F.lit(False))
    found = files.where(F.contains(F.lower("name"), F.lit(query.lower()))).orderBy("path", "name")
    return found if limit is None else found.limit(limit)
