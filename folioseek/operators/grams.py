"""Substring search from an index: runs of three characters of normalised paragraphs, and of file names.

Whatever contains a word contains all its runs of three characters, so that the paragraphs with the rarest of these are the only ones to
look at; a test of the whole words follows. Words of one or two characters have no such run: they are tested alone, and a query of nothing else is a scan.

The places of a run lie in lists, one for each run and some neighbouring documents: a row for each run and document would be many times the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions import text as T
from ..tables import stored
from . import search

GRAM = 3
#: Runs of a query that are looked up, the rarest ones: each leaves fewer paragraphs, which are all tested.
LOOKED_UP = 4
#: Characters whose runs share lists, about; a document is never parted.
CHARACTERS = 1_000_000
#: Rows of ``build``: the first document of a list; places in it; for each of these how far its document is from that of the place before, then for each its
#: position, or how far it is from that before in the same document, packed; documents.
LISTS = "gram string, first long, n long, places binary, documents long"
#: Bytes of packed lists that are opened at once, about.
OPENED = 1 << 20


def runs(text: Column) -> Column:
    """The distinct runs of three characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def runs_of(words: list[str]) -> list[str]:
    return sorted({w[i : i + GRAM] for w in words for i in range(len(w) - GRAM + 1)})


def build(paragraphs: DataFrame) -> DataFrame:
    """doc_index, position, text -> ``LISTS``. Documents are dealt in ranges, each to one task, and only texts are shuffled.

    Lists are packed, as places are many times the letters of the texts.
    """
    norm = T.normalised(F.col("text")).alias("text")
    rows = paragraphs.where(F.col("text").isNotNull()).select(F.col("doc_index").cast("long"), F.col("position").cast("long"), norm)
    return rows.repartitionByRange("doc_index").sortWithinPartitions("doc_index", "position").mapInArrow(lambda batches: map(_packed, _by_chunks(batches)), LISTS)


def _by_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs: list[int] = []
    positions: list[int] = []
    texts: list[str] = []
    n = 0
    for batch in batches:
        for doc, position, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if docs and doc != docs[-1] and (n >= CHARACTERS or doc - docs[0] > np.iinfo(np.int32).max):
                yield from _lists(docs, positions, texts)
                docs, positions, texts, n = [], [], [], 0
            docs.append(doc)
            positions.append(position)
            texts.append(text)
            n += len(text)
    yield from _lists(docs, positions, texts)


def _lists(docs: list[int], positions: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
    """The lists of some whole documents, whose paragraphs are in order."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if len(codes) < GRAM:
        return
    here = np.zeros(0x110000, bool)
    here[codes] = True
    letters = np.flatnonzero(here)
    numbers = np.zeros(0x110000, np.int64)
    numbers[letters] = np.arange(len(letters))
    numbers, k = numbers[codes], len(letters)
    paragraph = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = paragraph[:-2] == paragraph[2:]
    at = paragraph[:-2][inside]
    if k**GRAM * len(texts) < 1 << 63:
        run = ((numbers[:-2] * k + numbers[1:-1]) * k + numbers[2:])[inside]
        both = np.sort(run * len(texts) + at)
        both = both[np.r_[np.ones(min(1, len(both)), bool), both[1:] != both[:-1]]]
        run, at = both // len(texts), both % len(texts)
        of = np.stack([run // (k * k), run // k % k, run % k], axis=1)
    else:  # so many different letters and paragraphs that a number does not hold a run and its place
        of = np.stack([x[inside] for x in (numbers[:-2], numbers[1:-1], numbers[2:])], axis=1)
        order = np.lexsort((at, of[:, 2], of[:, 1], of[:, 0]))
        of, at = of[order], at[order]
        kept = np.flatnonzero(np.r_[np.ones(min(1, len(at)), bool), (of[1:] != of[:-1]).any(axis=1) | (at[1:] != at[:-1])])
        of, at = of[kept], at[kept]
    if not len(at):
        return
    first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]).any(axis=1)])
    doc = np.array(docs, np.int64)[at]
    steps = np.diff(doc, prepend=doc[0])
    steps[first] = 0
    new = steps > 0
    new[first] = True
    names = letters[of[first]].astype(np.uint32).tobytes().decode("utf-32-le")
    offsets = pa.array(np.r_[first, len(at)], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (steps, np.array(positions, np.int64)[at])]
    grams = pa.array([names[i : i + GRAM] for i in range(0, len(names), GRAM)], pa.string())
    columns = [grams, pa.array(doc[first]), *lists, pa.array(np.add.reduceat(new.astype(np.int64), first))]
    made = pa.RecordBatch.from_arrays(columns, ["gram", "first", "steps", "positions", "documents"])
    yield from (made.slice(i, 10_000) for i in range(0, made.num_rows, 10_000))


def _packed(lists: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of ``_lists`` -> ``LISTS``."""
    gram, first, steps, positions, documents = lists.columns
    n = np.diff(steps.offsets.to_numpy()).astype(np.int64)
    steps, positions, k = steps.flatten().to_numpy(), positions.flatten().to_numpy().astype(np.int64), numbers.within(n)
    values, at = np.zeros(2 * len(steps), np.int64), np.repeat(2 * (np.cumsum(n) - n), n) + k
    values[at] = steps
    values[at + np.repeat(n, n)] = np.where((k == 0) | (steps > 0), positions, np.diff(positions, prepend=0))
    return pa.RecordBatch.from_arrays([gram, first, pa.array(n), numbers.packed(values, 2 * n), documents], ["gram", "first", "n", "places", "documents"])


def entries(grams: DataFrame) -> DataFrame:
    """``LISTS`` -> gram, doc_index, position: a row for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, size in numbers.slices(pc.binary_length(batch.column("places")).to_numpy(), OPENED):
                made = _opened(batch.slice(i, size))
                yield from (made.slice(k, 10_000) for k in range(0, made.num_rows, 10_000))

    return grams.select("gram", "first", "places").mapInArrow(run, "gram string, doc_index long, position long")


def _opened(lists: pa.RecordBatch) -> pa.RecordBatch:
    values, counts = numbers.unpacked(lists.column("places"))
    n = counts // 2
    row, k = np.repeat(np.arange(len(n)), n), numbers.within(n)
    at = np.repeat(np.cumsum(counts) - counts, n) + k
    steps = values[at]
    docs = lists.column("first").to_numpy()[row] + numbers.running(steps, k == 0)
    positions = numbers.running(values[at + n[row]], (k == 0) | (steps > 0))
    return pa.RecordBatch.from_arrays([lists.column("gram").take(pa.array(row)), pa.array(docs), pa.array(positions)], ["gram", "doc_index", "position"])


def candidates(grams: DataFrame, words: list[str]) -> DataFrame | None:
    """doc_index, position of the paragraphs that have the rarest runs of the words; None if the words have no runs."""
    wanted = runs_of(words)
    if not wanted:
        return None
    mine = grams.where(F.col("gram").isin(wanted))
    sizes = {r["gram"]: r["n"] for r in mine.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row for each run of the query
    if len(sizes) < len(wanted):
        return entries(mine.where(F.lit(False))).select("doc_index", "position")
    rare = sorted(wanted, key=lambda g: (sizes[g], g))[:LOOKED_UP]
    rows = entries(grams.where(F.col("gram").isin(rare)))
    return rows.groupBy("doc_index", "position").count().where(F.col("count") == len(rare)).drop("count")


def matches(words: list[str], paragraphs: DataFrame, grams: DataFrame, without_basis: bool = False) -> DataFrame:
    """The paragraphs that a scan for the words finds, of which only candidates are read."""
    hits = candidates(grams, words) if words else None
    if hits is None:
        return search.matches(words, paragraphs, None, without_basis)
    return search.at(paragraphs, stored(hits, "hits")).where(search.verified(words, without_basis))


def build_names(files: DataFrame) -> DataFrame:
    """name, path -> gram, path, name of the runs in lower-cased file names, in ranges of gram; written."""
    rows = files.select(F.explode(runs(F.lower("name"))).alias("gram"), "path", "name")
    return stored(rows.repartitionByRange("gram", "path").sortWithinPartitions("gram", "path"), "names")


def file_search(names: DataFrame, files: DataFrame, query: str, limit: int | None = search.MOST_FILES) -> DataFrame:
    """``search.file_search`` from an index of names; a query of fewer than three characters reads all ``files``."""
    wanted = runs_of([query.lower()])
    if not wanted or not query.strip():
        return search.file_search(files, query, limit)
    mine = names.where(F.col("gram").isin(wanted))
    sizes = {r["gram"]: r["count"] for r in mine.groupBy("gram").count().collect()}
    if len(sizes) < len(wanted):
        return search.file_search(mine.select("name", "path").where(F.lit(False)), query, limit)
    rare = sorted(wanted, key=lambda g: (sizes[g], g))[0]
    return search.file_search(names.where(F.col("gram") == rare).select("name", "path"), query, limit)
