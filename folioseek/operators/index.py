"""The inverted index: (term, doc_index, positions), built and maintained with joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import numbers
from ..functions import text as T
from ..tables import stored

KEYS = ["term", "doc_index"]
#: Rows that a task gathers at once, about; the rows of a document are never parted.
GATHERED = 200_000
#: Words whose documents share lists, about.
LISTED = 1_000_000
#: Rows of ``lists``: the first document of a list; how far each document is from the first; how many positions each has; steps of documents, these
#: numbers and steps of positions, packed. The last is all that is shuffled.
LISTS = "term string, first long, docs array<int>, sizes array<int>, places binary"
#: Bytes of packed lists that are opened at once, about.
OPENED = 1 << 20
#: Terms that are asked for, sent with the tasks at most; documents whose numbers are broadcast at most.
FEW_TERMS, FEW_DOCUMENTS = 100_000, 1_000_000
#: Postings of two indexes that a task compares, about.
COMPARED = 500_000


def occurrences(paragraphs: DataFrame) -> DataFrame:
    """One row for each term of each paragraph, with repeats."""
    return _terms(paragraphs, T.words(F.col("text")))


def _terms(paragraphs: DataFrame, words: Column) -> DataFrame:
    rows = paragraphs.select("doc_index", "position", F.explode(words).alias("word"))
    return rows.select("doc_index", "position", T.stem_lowered(F.col("word")).alias("term")).where(F.octet_length("term") >= T.LEAST_BYTES)


def build(paragraphs: DataFrame, terms: list[str] | DataFrame | None = None) -> DataFrame:
    """Postings of all terms, or of some of them (a list, or a table with ``term``), filtered before they are aggregated.

    As a term is the beginning of its token, paragraphs that hold none of listed terms as they stand are left out unread.
    """
    if isinstance(terms, list):
        norm = T.normalised(F.col("text"))
        paragraphs = paragraphs.where(reduce(Column.__or__, [F.contains(norm, F.lit(t)) for t in sorted(set(terms))], F.lit(False)))
    # Once for each distinct word of a paragraph: repeats are neither stemmed nor shuffled.
    words = F.array_distinct(T.words(F.col("text")))
    if terms is None:
        # Texts are shuffled, which are less than their terms; a document's terms are then gathered where they arise.
        dealt = paragraphs.select("doc_index", "position", "text").repartition("doc_index").sortWithinPartitions("doc_index", "position")
        return _gathered(dealt.select(words.alias("words"), "doc_index", "position"), _of_words)
    if isinstance(terms, DataFrame):
        rows = _asked(paragraphs, stored(terms.select("term").distinct(), "asked"))
    else:
        rows = _terms(paragraphs, words).where(F.col("term").isin(sorted(set(terms))))
    # Dealt by key first, so that different tokens of one term and the positions are gathered after one shuffle.
    rows = rows.select("term", "doc_index", "position").repartition(*KEYS)
    return rows.groupBy(*KEYS).agg(F.sort_array(F.collect_set("position")).alias("positions"))


def _asked(paragraphs: DataFrame, terms: DataFrame) -> DataFrame:
    """Where the terms of a written table are. Each distinct word of a batch is stemmed once; words are rows only where their terms are asked for, if the terms are counted to be few."""
    known = {r["term"] for r in terms.collect()} if terms.count() <= FEW_TERMS else None
    rows = paragraphs.select(T.words(F.col("text")).alias("words"), "doc_index", "position")
    _, doc, place = rows.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            row, words = pc.list_parent_indices(words).to_numpy(), words.flatten().dictionary_encode()
            stems = [T.stem_lowered_word(w) for w in words.dictionary.to_pylist()]
            code, kept = words.indices.to_numpy(), np.array([(known is None or s in known) and len(s.encode()) >= T.LEAST_BYTES for s in stems], bool)
            at = np.flatnonzero(kept[code]) if len(code) else np.zeros(0, np.int64)
            of = lambda values, codes: values.take(pa.array(codes, pa.int64()))
            yield pa.RecordBatch.from_arrays([of(pa.array(stems, pa.string()), code[at]), *(of(batch.column(c), row[at]) for c in ("doc_index", "position"))], ["term", "doc_index", "position"])

    found = rows.mapInArrow(run, types.StructType([types.StructField("term", types.StringType()), doc, place]))
    return found if known is not None else found.join(terms, "term", "left_semi")


def lists(paragraphs: DataFrame, sizes: bool = True) -> DataFrame:
    """The postings of all terms as ``LISTS`` (without docs and sizes if these are not asked for), a row for each term and some neighbouring documents, to be dealt by term and then opened.

    A row for each term and document would be shuffled and sorted as many times the texts. Documents are dealt in ranges, so that no list lies between two others of its term.
    """
    dealt = paragraphs.select(F.col("doc_index").cast("long"), "position", "text").repartitionByRange("doc_index").sortWithinPartitions("doc_index", "position")
    # Plain texts are cut where their terms are gathered; of others the words come joined. Repeats go there.
    text, odd = F.col("text"), T.unplain(F.col("text"))
    rows = dealt.select(F.when(odd, F.array_join(T.words(text), "\n")).otherwise(text).alias("text"), odd.alias("odd"), "doc_index", "position")
    gathered, columns = _in_batches(_lists_of_words, LISTED), [c.split()[0] for c in LISTS.split(", ") if sizes or "array" not in c]
    schema = ", ".join(c for c in LISTS.split(", ") if c.split()[0] in columns)
    return rows.mapInArrow(lambda batches: (made.select(columns) for made in gathered(map(_cut, batches))), schema)


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    """text, odd, doc_index, position -> words, doc_index, position: those of a text, or those that come joined if it is odd."""
    text, odd = batch.column("text"), pc.fill_null(batch.column("odd"), False)
    row, words = T.words_of(pc.if_else(odd, pa.scalar(None, pa.string()), text))
    if pc.any(odd).as_py():
        more = pc.split_pattern(text.filter(odd), "\n")
        rows = np.r_[row, np.flatnonzero(odd.to_numpy(zero_copy_only=False))[pc.list_parent_indices(more).to_numpy()]]
        order = np.argsort(rows, kind="stable")
        row, words = rows[order], pa.concat_arrays([words, more.flatten()]).take(pa.array(order))
    offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=batch.num_rows))]
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words)
    return pa.RecordBatch.from_arrays([lists, batch.column("doc_index"), batch.column("position")], ["words", "doc_index", "position"])


def opened(lists: DataFrame, doc: types.DataType, place: types.DataType) -> DataFrame:
    """term, first, places of ``LISTS`` -> a row for each term and document, in the order of the lists."""
    schema = types.StructType([types.StructField("term", types.StringType()), types.StructField("doc_index", doc), types.StructField("positions", types.ArrayType(place))])
    doc, place = to_arrow_type(doc), to_arrow_type(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in numbers.slices(pc.binary_length(batch.column("places")).to_numpy(), OPENED):
                made = _opened(batch.slice(at, n), doc, place)
                yield from (made.slice(i, 10_000) for i in range(0, made.num_rows, 10_000))

    return lists.select("term", "first", "places").mapInArrow(run, schema)


def _opened(batch: pa.RecordBatch, doc: pa.DataType, place: pa.DataType) -> pa.RecordBatch:
    values, counts = numbers.unpacked(batch.column("places"))
    n = values[np.cumsum(counts) - counts]  # documents of each list
    of = np.repeat(np.arange(len(n)), counts)
    at = numbers.within(counts)
    inside = at - n[of]  # 1 .. n: sizes; beyond: positions
    steps, sizes, places = values[(at > 0) & (inside <= 0)], values[(inside > 0) & (inside <= n[of])], values[inside > n[of]]
    row = np.repeat(np.arange(len(n)), n)
    docs = batch.column("first").to_numpy()[row] + numbers.running(steps, numbers.within(n) == 0)
    positions = numbers.running(places, numbers.within(sizes) == 0)
    positions = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(positions, place))
    return pa.RecordBatch.from_arrays([batch.column("term").take(pa.array(row)), pa.array(docs, doc), positions], [*KEYS, "positions"])


def list_sizes(lists: DataFrame) -> DataFrame:
    """first, docs, sizes of ``LISTS`` -> doc_index, postings, positions: one row for each document."""
    rows = lists.select("first", F.explode(F.arrays_zip("docs", "sizes")).alias("_d"))
    rows = rows.select((F.col("first") + F.col("_d.docs")).alias("doc_index"), F.col("_d.sizes").alias("_n"))
    return rows.groupBy("doc_index").agg(F.count(F.lit(1)).alias("postings"), F.sum("_n").alias("positions"))


def _gathered(rows: DataFrame, lists: Callable[[pa.Table], pa.RecordBatch]) -> DataFrame:
    """Rows of lists and their doc_index -> a row for each term and document, positions in order and without repeats.

    The rows of a document lie in one partition, one after another. ``lists`` makes the postings of whole documents. Terms without a position have no row.
    """
    words, doc, place = (f.dataType for f in rows.schema.fields)
    word = words.elementType if isinstance(words, types.ArrayType) else words
    place = place.elementType if isinstance(place, types.ArrayType) else place
    schema = types.StructType([types.StructField("term", word), types.StructField("doc_index", doc), types.StructField("positions", types.ArrayType(place))])
    return rows.mapInArrow(_in_batches(lists, GATHERED), schema)


def _in_batches(lists: Callable[[pa.Table], pa.RecordBatch], least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``lists`` of some whole documents at a time, which have ``least`` rows, about."""

    def entries(batch: pa.RecordBatch) -> int:
        """Entries of its lists, or rows if these are more."""
        held = [len(c.flatten()) for c in batch.columns if pa.types.is_list(c.type)]
        return max(batch.num_rows, *held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, least
        for batch in batches:
            held.append(batch)
            n += entries(batch)
            if n < most:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            docs = whole.column("doc_index").combine_chunks().dictionary_encode("encode").indices.to_numpy()
            cut = int(np.searchsorted(docs, docs[-1]))  # codes are given in the order of documents
            if cut:
                yield lists(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
            n = sum(map(entries, held))
            most = max(least, 2 * n)
        if held and sum(b.num_rows for b in held):
            yield lists(pa.Table.from_batches(held))

    return run


def _coded(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array, np.ndarray, pa.DataType]:
    """words, doc_index, position of whole documents -> what ``_postings`` takes. Each distinct word is stemmed once."""
    words, doc, at = (table.column(c).combine_chunks() for c in ("words", "doc_index", "position"))
    row, words = pc.list_parent_indices(words).to_numpy(), words.flatten().dictionary_encode()
    stems = pa.array([T.stem_lowered_word(w) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
    code = stems.indices.to_numpy()[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
    kept = pc.greater_equal(pc.binary_length(stems.dictionary), T.LEAST_BYTES).to_numpy(zero_copy_only=False)
    if not kept.all():
        row, code = row[kept[code]], code[kept[code]]
    docs = doc.dictionary_encode("encode")
    return code, stems.dictionary, docs.indices.to_numpy()[row], docs.dictionary, at.to_numpy()[row], at.type


def _of_words(table: pa.Table) -> pa.RecordBatch:
    """words, doc_index, position of whole documents -> their postings."""
    return _postings(*_coded(table))


def _lists_of_words(table: pa.Table) -> pa.RecordBatch:
    """words, doc_index, position of whole documents -> their postings as ``LISTS``."""
    term, terms, doc, docs, places, _ = _coded(table)
    n, docs = max(1, len(docs)), docs.to_numpy()
    by_name = pc.sort_indices(terms)  # terms that begin alike are shuffled together
    rank = np.empty(len(terms), np.int64)
    rank[by_name.to_numpy()] = np.arange(len(terms))
    terms = terms.take(by_name)
    keys, places = _ordered(rank[term] * n + doc, places)
    first = _starts(keys)  # a posting each
    sizes, of, doc = np.diff(np.r_[first, len(keys)]), keys[first] // n, docs[keys[first] % n]
    start = np.union1d(_starts(of), _starts(doc >> 31))  # a list each; its documents are less than 2 ** 31 apart
    held = np.diff(np.r_[start, len(of)])
    new = np.zeros(len(of), bool)
    new[start] = True
    steps, begun = np.where(new, 0, np.diff(doc, prepend=0)), np.zeros(len(keys), bool)
    begun[first] = True
    places = np.where(begun, places, np.diff(places, prepend=0))
    # Of each list: how many documents, their steps, their sizes, steps of positions.
    counts = np.add.reduceat(sizes, start) if len(start) else sizes
    offset = np.cumsum(2 * held + counts + 1) - (2 * held + counts + 1)
    values, row = np.zeros(len(start) + 2 * len(of) + len(keys), np.int64), np.repeat(np.arange(len(start)), held)
    values[offset], at = held, offset[row] + 1 + numbers.within(held)
    values[at], values[at + held[row]] = steps, sizes
    values[np.repeat(offset + 1 + 2 * held, counts) + numbers.within(counts)] = places
    lists = lambda v: pa.ListArray.from_arrays(pa.array(np.r_[start, len(of)], pa.int32()), pa.array(v, pa.int64()).cast(pa.int32()))
    columns = [terms.take(pa.array(of[start], pa.int64())), pa.array(doc[start], pa.int64()), lists(doc - doc[start][row]), lists(sizes), numbers.packed(values, 2 * held + counts + 1)]
    return pa.RecordBatch.from_arrays(columns, ["term", "first", "docs", "sizes", "places"])


def _of_lists(table: pa.Table) -> pa.RecordBatch:
    """term, doc_index, positions of whole documents -> their postings."""
    term, doc, at = (table.column(c).combine_chunks() for c in (*KEYS, "positions"))
    terms, docs, row = term.dictionary_encode("encode"), doc.dictionary_encode("encode"), pc.list_parent_indices(at).to_numpy()
    at = at.flatten()
    return _postings(terms.indices.to_numpy()[row], terms.dictionary, docs.indices.to_numpy()[row], docs.dictionary, at.to_numpy(zero_copy_only=False), at.type)


def _postings(term: np.ndarray, terms: pa.Array, doc: np.ndarray, docs: pa.Array, places: np.ndarray, place: pa.DataType) -> pa.RecordBatch:
    """Codes of terms and documents, and a place with each -> a row for each pair of these, places in order and without repeats."""
    n = max(1, len(terms))
    keys, places = _ordered(doc.astype(np.int64) * n + term, places)
    first = _starts(keys)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(keys)], pa.int32()), pa.array(places, place))
    of = lambda codes, values: values.take(pa.array(codes, pa.int64()))
    return pa.RecordBatch.from_arrays([of(keys[first] % n, terms), of(keys[first] // n, docs), lists], [*KEYS, "positions"])


def _starts(values: np.ndarray) -> np.ndarray:
    """Where another value begins."""
    return np.flatnonzero(np.r_[np.ones(min(1, len(values)), bool), values[1:] != values[:-1]])


def _ordered(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and a place with each, in order and without repeats; keys are not negative."""
    if len(keys) and places.min() >= 0 and (int(keys.max()) + 1) * (span := int(places.max()) + 1) < 1 << 63:  # a number holds both
        both = np.sort(keys * span + places)
        both = both[_starts(both)]
        return both // span, both % span
    order = np.lexsort((places, keys))
    keys, places = keys[order], places[order]
    kept = np.ones(len(keys), bool)
    kept[1:] = (keys[1:] != keys[:-1]) | (places[1:] != places[:-1])
    return keys[kept], places[kept]


def _numbers(docs: DataFrame) -> DataFrame:
    """The doc_index of documents, written, to be broadcast where they are counted to be few, so that postings stay where they are."""
    found = stored(docs.select("doc_index").distinct(), "numbers")
    return F.broadcast(found) if found.count() <= FEW_DOCUMENTS else found


def remove(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Postings without those of ``docs`` (doc_index); terms without postings are gone by themselves."""
    return postings.join(_numbers(docs), "doc_index", "left_anti").select(postings.columns)


def update(postings: DataFrame, changed: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Postings with the documents of ``changed`` (doc_index) replaced by those in ``paragraphs``."""
    changed = _numbers(changed)
    left = postings.join(changed, "doc_index", "left_anti").select(postings.columns)
    return left.unionByName(build(paragraphs.join(changed, "doc_index", "left_semi")))


def renumbered(postings: DataFrame, numbers: DataFrame) -> DataFrame:
    """Postings under new indexes. ``numbers``: old doc_index, new_index; documents without one are deleted."""
    return postings.join(numbers, "doc_index").select("term", F.col("new_index").alias("doc_index"), "positions")


def merged(postings: DataFrame) -> DataFrame:
    """One row for each term and document, positions united; those without positions go."""
    rows = postings.where(F.size("positions") > 0).select(*KEYS, "positions")
    return _gathered(rows.repartition("doc_index").sortWithinPartitions("doc_index"), _of_lists)


def cleaned(postings: DataFrame) -> DataFrame:
    """Postings of terms long enough, with positions."""
    return postings.where((F.octet_length("term") >= T.LEAST_BYTES) & (F.size("positions") > 0))


def statistics(postings: DataFrame) -> DataFrame:
    """terms, postings, positions: one row."""
    return postings.agg(
        F.countDistinct("term").alias("terms"), F.count(F.lit(1)).alias("postings"), F.coalesce(F.sum(F.size("positions")), F.lit(0)).cast("long").alias("positions")
    )


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum(F.size("positions")).cast("long").alias("paragraph_freq"))


def postings_report(postings: DataFrame, total_documents: int) -> DataFrame:
    """What is wrong with an index, as counts; ``valid`` is false only if it is empty with over 100 documents."""
    return postings.agg(
        F.count_if(F.octet_length("term") < T.LEAST_BYTES).alias("short_terms"),
        F.count_if(F.size("positions") <= 0).alias("empty_positions"),
        F.count_if(F.col("doc_index") >= total_documents).alias("beyond_documents"),
        (~((F.count(F.lit(1)) == 0) & F.lit(total_documents > 100))).alias("valid"),
    )


def documents_report(docs: DataFrame, total_documents: int | None = None) -> DataFrame:
    """file_path, n_lines, paragraph_count -> violations of the document table, held against the total it should have (None: any)."""
    n = F.count(F.lit(1))
    return docs.agg(
        n.alias("documents"),
        (F.lit(False) if total_documents is None else n != F.lit(total_documents)).alias("wrong_total"),
        F.count_if(F.coalesce(F.col("file_path"), F.lit("")) == "").alias("empty_paths"),
        F.count_if(F.col("n_lines") != F.col("paragraph_count")).alias("count_mismatches"),
    )


def needs_rebuild(postings: DataFrame, indexed_documents: int, total_documents: int) -> bool:
    """Whether the numbers of documents differ by more than ten, or nothing is indexed."""
    return abs(indexed_documents - total_documents) > 10 or (total_documents > 0 and postings.isEmpty())


def uncovered(paragraphs: DataFrame, substring: str, postings: DataFrame, term: str) -> DataFrame:
    """Documents with a substring, in any case, that the index does not list for a term."""
    has = paragraphs.where(F.contains(F.upper("text"), F.lit(substring.upper()))).select("doc_index").distinct()
    return has.join(postings.where(F.col("term") == term).select("doc_index"), "doc_index", "left_anti")


def difference(before: DataFrame, after: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """One row: terms, postings and positions that a step (update, removal, merge, clean-up) added to an index and took from it.

    ``touched`` (doc_index): the documents that the step may have changed, if these are known; of the others the terms alone are looked at. Postings are
    counted, and dealt to so many tasks that each compares ``COMPARED`` of them, before they are aggregated.
    """

    def side(rows: DataFrame, sign: int) -> DataFrame:
        return rows.select(*KEYS, F.lit(sign).alias("n"), (F.size("positions") * sign).cast("long").alias("p"))

    rest = None
    if touched is not None:
        docs = _numbers(touched)
        rest = before.join(docs, "doc_index", "left_anti").select("term").distinct()
        before, after = (rows.join(docs, "doc_index", "left_semi") for rows in (before, after))
    both = stored(side(before, -1).unionByName(side(after, 1)), "compared")
    parts = max(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-both.count() // COMPARED))
    keys = both.repartition(parts, *KEYS).groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.max("n").alias("top"), F.min("n").alias("low"))
    if rest is not None:  # such a term is in both
        nothing = [F.lit(0).cast("long").alias(c) for c in ("n", "p")]
        keys = keys.drop("doc_index").unionByName(rest.select("term", *nothing, F.lit(1).alias("top"), F.lit(-1).alias("low")))
    up, down = (lambda c: F.sum(F.greatest(F.col(c), F.lit(0)))), (lambda c: F.sum(F.greatest(-F.col(c), F.lit(0))))
    terms = keys.groupBy("term").agg(
        F.max("top").alias("top"), F.min("low").alias("low"), up("n").alias("n_up"), down("n").alias("n_down"), up("p").alias("p_up"), down("p").alias("p_down")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return terms.agg(
        F.count_if(F.col("low") == 1).alias("terms_added"), F.count_if(F.col("top") == -1).alias("terms_removed"),
        total("n_up").alias("postings_added"), total("n_down").alias("postings_removed"),
        total("p_up").alias("positions_added"), total("p_down").alias("positions_removed"),
    )
