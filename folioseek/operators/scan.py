"""Many queries in one pass over paragraphs, without an index: an automaton of all their words.

The words of a bounded number of queries make up one Aho-Corasick automaton, which is sent to the tasks; it finds all words of a paragraph
in one pass over its characters, however many queries there are. A query is looked at where its longest word is found. More queries take more passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import dense_index, stored

#: Queries of one pass, at most.
QUERIES_AT_ONCE = 50_000


def _found(norm: DataFrame, queries: list[tuple[int, list[str]]]) -> DataFrame:
    """doc_index, position, norm -> + k: numbers of the queries all of whose words are in the paragraph."""
    import ahocorasick

    sets = {k: sorted(set(words), key=lambda w: (-len(w), w)) for k, words in queries}
    automaton = ahocorasick.Automaton()
    for w in {w for words in sets.values() for w in words}:
        automaton.add_word(w, w)
    by_longest: dict[str, list[tuple[int, frozenset[str]]]] = {}
    for k, words in sets.items():
        by_longest.setdefault(words[0], []).append((k, frozenset(words[1:])))
    automaton.make_automaton()
    shared = norm.sparkSession.sparkContext.broadcast((automaton, by_longest))  # QUERIES_AT_ONCE queries bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, queries_of = shared.value
        for batch in batches:
            rows, numbers = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = {w for _, w in words_of.iter(text)} if text else set()
                for w in found:
                    for k, others in queries_of.get(w, ()):
                        if others <= found:
                            rows.append(i)
                            numbers.append(k)
            part = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(numbers, pa.int64())], ["doc_index", "position", "norm", "k"])

    return norm.mapInArrow(run, "doc_index long, position long, norm string, k long")


def scan_many(queries: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(query_id, words) × doc_index, position, text -> query_id, doc_index, position of every paragraph that a scan for a query finds.

    All of a query's words are in the paragraph, two or three of them near and in order. A query without words finds nothing; equal queries each
    have their rows. A paragraph of any length is passed over once for each ``QUERIES_AT_ONCE`` queries.
    """
    some = queries.where(F.size("words") > 0).select("query_id", "words")
    numbered = stored(dense_index(some, [F.col("query_id").asc(), F.col("words").asc()], "k"), "queries")
    norm = paragraphs.select(F.col("doc_index").cast("long").alias("doc_index"), F.col("position").cast("long").alias("position"), T.normalised(F.col("text")).alias("norm"))
    n, found = numbered.count(), []
    for first in range(0, n, QUERIES_AT_ONCE):
        mine = numbered.where(F.col("k").between(first, first + QUERIES_AT_ONCE - 1))
        hits = _found(norm, [(r["k"], list(r["words"])) for r in mine.select("k", "words").collect()])
        hits = hits.join(F.broadcast(mine), "k")
        near = ~F.size("words").between(2, 3) | T.near_in_order(F.col("norm"), F.col("words"))
        found.append(hits.where(near).select("query_id", "doc_index", "position"))
    nothing = numbered.select("query_id", F.lit(0).cast("long").alias("doc_index"), F.lit(0).cast("long").alias("position")).where(F.lit(False))
    return reduce(DataFrame.unionByName, found) if found else nothing
