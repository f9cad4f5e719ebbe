"""Scores by prediction by partial matching over bytes, pretrained on the corpus.

The model is a trie of contexts of up to ``ORDER`` bytes with the counts of the bytes that follow. A byte's code length is
found in the longest context that occurred; unseen there, it pays that context's escape (method D: half a count of each
distinct symbol goes to the escape) and goes on in the next shorter one, from which the symbols of the longer are
excluded. After the empty context the bytes never seen are equally likely. A text's bytes are lower-cased A-Z, preceded
by zero bytes as context and followed by one as its end.

As the probability of a byte depends on the ``ORDER`` bytes before it alone, the corpus is counted by windows of
``ORDER + 1`` bytes. The texts are kept in chunks; each chunk asks for the distinct windows and words it holds, Spark
sums, scores and joins them, and brings them back to their chunk. No model is collected: only the counts of windows of three
bytes, of which there are 2**24 at most, are sent to all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, blocks, in_small_batches, release_memory, shuffle_partitions, utf8, word_hashes, words, written

ORDER = 5
LOW = 2  # contexts up to this order are known everywhere
CHUNK_BYTES = 32 << 20
BLOCK = 1 << 19
HELD_OUT = 10
SMOOTHING = 0.1
WINDOW, WORD = 0, 1
_END = np.uint64(0x5EED)  # the key of the end token
_MASK = [np.uint64((1 << 8 * n) - 1) for n in range(ORDER + 2)]


def is_held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text, modulo 10, is 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % HELD_OUT == 0, F.lit(False))


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window that ends at each byte and at the end of each text, offsets by text)."""
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = offsets + np.arange(len(offsets))  # each text has one more place, its end
    padded = np.zeros(len(data) + (ORDER + 1) * len(lengths) + ORDER + 1, np.uint8)
    padded[np.arange(len(data)) + (ORDER + 1) * doc + ORDER] = _LOWER[data]
    key = np.zeros(at[-1], np.uint64)
    places = np.arange(at[-1]) + ORDER * np.repeat(np.arange(len(lengths)), lengths + 1)
    for j in range(ORDER + 1):
        key = key << np.uint64(8) | padded[places + j]
    return key, at


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of each word, after those of a text its end token; offsets by text)."""
    low, starts, ends, first = words(data, offsets)
    at = first + np.arange(len(first))
    keys = np.full(at[-1], _END, np.uint64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keys[np.arange(len(starts)) + doc] = word_hashes(low, starts, ends)
    return keys, at


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[at], np.add.reduceat(counts, at) if len(keys) else counts


def chunked(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out -> rows of two kinds, written.

    Of each chunk: its texts in compressed blocks, and each distinct window and word with its count in training texts.
    """
    schema = "chunk long, kind int, key long, n long, ids array<long>, held array<boolean>, lengths array<long>, texts binary"
    names = ["chunk", "kind", "key", "n", "ids", "held", "lengths", "texts"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        # A chunk is a part of a task's rows, so that its size does not follow that of the input's partitions.
        chunk, size, pending = TaskContext.get().partitionId() << 20, 0, {WINDOW: [], WORD: []}
        squeeze = zstandard.ZstdCompressor(level=9)

        def merged(kind: int) -> None:
            if len(pending[kind]) > 1:
                pending[kind] = [_summed(*map(np.concatenate, zip(*pending[kind], strict=True)))]

        def wanted() -> Iterator[pa.RecordBatch]:
            for kind in pending:
                merged(kind)
                for keys, n in pending[kind]:
                    for a in range(0, len(keys), 100_000):
                        k = keys[a : a + 100_000]
                        made = [pa.array(np.full(len(k), chunk)), pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n[a : a + 100_000])]
                        yield pa.RecordBatch.from_arrays([*made, *(pa.nulls(len(k), t) for t in types[4:])], names)
                pending[kind] = []

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            held = np.array(batch.column(2).to_pylist(), bool)
            for i, j in blocks(offsets, BLOCK):
                part = offsets[i : j + 1]
                text, at = data[part[0] : part[-1]], part - part[0]
                for kind, found in ((WINDOW, windows), (WORD, tokens)):
                    keys, first = found(text, at)
                    learn = np.repeat(~held[i:j], np.diff(first))
                    a, n = np.unique(keys[learn], return_counts=True)
                    b = np.unique(keys[~learn])
                    pending[kind].append(_summed(np.r_[a, b], np.r_[n, np.zeros(len(b), n.dtype)]))
                    if sum(len(k) for k, _ in pending[kind][1:]) > 500_000:
                        merged(kind)
                row = [[chunk], [None], [None], [None], [batch.column(0)[i:j].to_pylist()], [list(map(bool, held[i:j]))], [np.diff(at).tolist()], [squeeze.compress(text.tobytes())]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names)
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield from wanted()
                    chunk, size = chunk + 1, 0
        yield from wanted()
        batch = data = text = keys = first = part = learn = a = b = n = row = None
        release_memory()

    cols = in_small_batches(docs).select(F.col("doc_id").cast("long"), "text", "held_out")
    return written(cols.coalesce(max(1, math.ceil(total / CHUNK_BYTES))).mapInArrow(run, schema), "chunks")


class Trie:
    """The counts of some contexts, with the totals that escapes and exclusions need."""

    def __init__(self, low: tuple[np.ndarray, np.ndarray]):
        self.levels: dict[int, tuple] = {}
        for j in range(LOW, -1, -1):
            self._level(j, *_summed(low[0] & _MASK[j + 1], low[1]))

    def _level(self, j: int, grams: np.ndarray, counts: np.ndarray) -> None:
        """grams: sorted contexts of order ``j``, each with a following byte."""
        contexts = grams >> np.uint64(8)
        at = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(grams) else np.zeros(0, int)
        total = np.add.reduceat(counts, at) if len(grams) else np.zeros(0, np.int64)
        distinct = np.diff(np.r_[at, len(grams)])
        self.levels[j] = (grams, counts, contexts[at], total, distinct, at)

    def with_windows(self, keys: np.ndarray, counts: np.ndarray) -> Trie:
        """A trie that also has the orders above ``LOW``, for windows that occurred."""
        out = Trie.__new__(Trie)
        out.levels = {j: self.levels[j] for j in range(LOW + 1)}
        for j in range(ORDER, LOW, -1):
            out._level(j, *_summed(keys & _MASK[j + 1], counts))
        return out

    @staticmethod
    def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_):
            return np.zeros(len(x), int), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
        return at, sorted_[at] == x

    def _left(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """For each context of order ``j + 1``: total and distinct of its suffix without the context's own symbols."""
        grams, _, contexts, _, distinct, first = self.levels[j + 1]
        low_grams, low_counts, low_contexts, low_total, low_distinct, _ = self.levels[j]
        at, _ = self._find(low_grams, grams & _MASK[j + 1])
        shared = np.add.reduceat(low_counts[at], first) if len(grams) else np.zeros(0, np.int64)
        up, _ = self._find(low_contexts, contexts & _MASK[j])
        return low_total[up] - shared, low_distinct[up] - distinct

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of each window after the others."""
        out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        above = np.full(len(keys), -1)  # the context escaped from, at the order above
        for j in range(ORDER, -1, -1):
            grams, counts, contexts, total, distinct, _ = self.levels[j]
            context, known = self._find(contexts, keys >> np.uint64(8) & _MASK[j])
            known &= open_
            gram, seen = self._find(grams, keys & _MASK[j + 1])
            seen &= known
            t, d = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            t[known], d[known] = total[context[known]], distinct[context[known]]
            if (escaped := known & (above >= 0)).any():
                t_left, d_left = self._left(j)
                t[escaped], d[escaped] = t_left[above[escaped]], d_left[above[escaped]]
            # Where the longer context has every symbol of this one, there is nothing to pay.
            miss = known & ~seen & (d > 0)
            out[seen] += np.log10((counts[gram[seen]] - 0.5) / t[seen])
            out[miss] += np.log10(0.5 * d[miss] / t[miss])
            open_ &= ~seen
            above = np.where(known & open_, context, -1)
        symbols = int(self.levels[0][4].sum())
        out[open_] -= np.log10(max(1, 256 - symbols))
        return out


#: Windows that a task scores at once, about.
PART = 500_000


def _window_scores(counts: DataFrame) -> DataFrame:
    """(key, n) of windows -> (key, value): their log10 probability."""
    low = counts.where("n > 0").groupBy((F.col("key").bitwiseAND(F.lit((1 << 8 * (LOW + 1)) - 1))).alias("k")).agg(F.sum("n").alias("n"))
    got = low.toArrow()  # 2**24 rows at most, whatever the corpus
    table = _summed(got["k"].to_numpy().view(np.uint64), got["n"].to_numpy())
    shared = counts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, size, most = Trie(shared.value), [], 0, PART

        def scored(part: np.ndarray) -> pa.RecordBatch:
            keys, n = part[0].view(np.uint64), part[1]
            value = base.with_windows(keys[n > 0], n[n > 0]).log10(keys)
            return pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(value)], ["key", "value"])

        # Contexts of three bytes and more stay together: a part ends where the last three bytes before the symbol change.
        for batch in batches:
            held.append(np.array([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            size += batch.num_rows
            if size > most:
                whole = np.concatenate(held, axis=1)
                suffix = whole[0] >> 8 & 0xFFFFFF
                cuts = np.flatnonzero(suffix[1:] != suffix[:-1])
                end = cuts[-1] + 1 if len(cuts) else 0
                held, size = [whole[:, end:].copy()], whole.shape[1] - end
                most = max(PART, 2 * size)  # a suffix of many windows is not looked through again at every batch
                if end:
                    part, whole, suffix = whole[:, :end], None, None
                    yield scored(part)
                    part = None
        if size:
            yield scored(np.concatenate(held, axis=1))

    suffix = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFFFF))
    dealt = counts.select("key", "n").repartition(shuffle_partitions(counts.sparkSession), suffix).sortWithinPartitions(suffix, "key")
    return dealt.mapInArrow(run, "key long, value double")


def _text_scores(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over the texts of a chunk: n_tokens, n_known, sum of log10(c + SMOOTHING), score."""
    import zstandard

    known = {}
    for k in (WINDOW, WORD):
        mine = right.filter(pc.equal(right["kind"], k)).select(["key", "value"])
        a = mine["key"].to_numpy().view(np.uint64)
        order = np.argsort(a)
        known[k] = a[order], mine["value"].to_numpy()[order]
    del right, mine, a, order
    out = {c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "word_sum", "score")}
    expand = zstandard.ZstdDecompressor()

    def looked_up(kind: int, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, first = found
        u, back = np.unique(keys, return_inverse=True)
        return known[kind][1][np.searchsorted(known[kind][0], u)][back], first

    for i in range(left.num_rows):
        data = np.frombuffer(expand.decompress(left["texts"][i].as_py()), np.uint8)
        offsets = np.r_[0, np.cumsum(np.array(left["lengths"][i].as_py(), np.int64))]
        logs, first = looked_up(WINDOW, windows(data, offsets))
        out["score"] += np.add.reduceat(logs, first[:-1]).tolist()
        count, first = looked_up(WORD, tokens(data, offsets))
        out["n_tokens"] += np.diff(first).tolist()
        out["n_known"] += np.add.reduceat((count > 0).astype(np.int64), first[:-1]).tolist()
        out["word_sum"] += np.add.reduceat(np.log10(count + SMOOTHING), first[:-1]).tolist()
        out["doc_id"] += left["ids"][i].as_py()
        out["held_out"] += left["held"][i].as_py()
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    known.clear()
    release_memory()
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), types, strict=True)})


def score(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Null and empty texts have their end alone; texts of any length are scored whole, and one longer than a chunk is a chunk by itself. Rows with a null doc_id are learned from. Repeated rows count as often as
    they occur. An empty table gives no rows; without training texts all bytes are equally likely. Other columns
    are not read.
    """
    made = chunked(docs.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out")))
    wanted = made.where("kind is not null").select("chunk", "kind", "key", "n")
    counts = written(wanted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    is_word = F.col("kind") == WORD
    total, distinct = counts.where(is_word & (F.col("n") > 0)).agg(F.sum("n"), F.count(F.lit(1))).first()
    total = total or 0
    values = _window_scores(counts.where(~is_word)).select(F.lit(WINDOW).alias("kind"), "key", "value")
    values = values.unionByName(counts.where(is_word).select("kind", "key", F.col("n").cast("double").alias("value")))
    back = wanted.select("chunk", "kind", "key").join(values, ["kind", "key"]).select("chunk", "kind", "key", "value")
    texts = made.where("texts is not null").select("chunk", "ids", "held", "lengths", "texts")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, word_sum double, score double"
    summed = texts.groupBy("chunk").cogroup(back.withColumnRenamed("chunk", "to_chunk").groupBy("to_chunk")).applyInArrow(_text_scores, schema)
    scale = math.log10(total + SMOOTHING * (distinct + 1))
    return summed.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("word_sum") - F.col("n_tokens") * scale).alias("base_score"), "score",
    )
