"""Packing documents into as few sequences as possible: minimum bin slack on the histogram of lengths.

Every document is tokenised once, into a table of pieces: whole sequences of long ones, and what is left. The driver fills bins from the
number of pieces of each length (as many rows as a sequence has tokens, at most): a bin begins with the longest piece left, and a
subset-sum table, one bitset of reachable sums for each length tried, longest first, gives the fullest sum that fits beside it. The
combination is read back from the table and removed as often as the counts allow, so that the work follows the histogram and
not the documents. To begin with the longest piece loses nothing: lengths are only ever taken away, so that its bin gets no fuller by
waiting. Pieces then find their bins by length and rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_small_batches, release_memory, written
from .packing import default_tokenizer, encode_texts, id_type

MAX_TOKENS = 4096
END_ID = 1
#: Pieces of one length that are ranked in one task, about.
RANKED = 1_000_000
LEAST_SALTS = 64


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination {length: number} with the largest sum up to ``room``; of several the one that the longest lengths reach first.

    Bit s of a row of the table is set if s is a sum of the lengths tried so far. Numbers of a length are tried as powers of two and a
    rest, so that a row takes as many steps as the number has digits.
    """
    mask, goal = (1 << room + 1) - 1, 1 << room
    sums, steps = 1, []  # (length, number, sums before)
    for length in lengths:
        left = min(counts[length], room // length)
        power = 1
        while left and not sums & goal:
            n = min(power, left)
            steps.append((length, n, sums))
            sums |= sums << length * n & mask
            left, power = left - n, power * 2
        if sums & goal:
            break
    at, out = sums.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            at -= length * n
            out[length] = out.get(length, 0) + n
    return out


def plan_bins(histogram: dict[int, int], room: int = MAX_TOKENS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """{length: count}, lengths up to ``room`` -> (placements, number of bins).

    A placement (length, rank, n, sequence, offset): of the pieces of this length those from ``rank`` to ``rank + n`` lie at ``offset`` of
    the sequences from ``sequence`` to ``sequence + n``.
    """
    counts = {k: n for k, n in histogram.items() if k and n}
    lengths, taken = sorted(counts, reverse=True), dict.fromkeys(counts, 0)
    out, bins = [], 0
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        rest = room - first
        bin_ = fullest([k for k in lengths if k <= rest and counts[k]], counts, rest) if rest else {}
        counts[first] += 1
        bin_[first] = bin_.get(first, 0) + 1
        n = min(counts[k] // m for k, m in bin_.items())
        offset = 0
        for k in sorted(bin_, reverse=True):
            for _ in range(bin_[k]):
                out.append((k, taken[k], n, bins, offset))
                taken[k] += n
                offset += k
            counts[k] -= n * bin_[k]
        lengths = [k for k in lengths if counts[k]]
        bins += n
    return out, bins


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, room: int = MAX_TOKENS) -> DataFrame:
    """doc_id, text -> piece_id, doc_id, piece, start, length, ids: written, so that piece_id stays the same.

    ``ids`` are unsigned 32-bit numbers, little-endian; each document's end with ``end_id``.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, kind = np.array([end_id], "<u4"), id_type(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                out: list[tuple] = []
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                for doc_id, raw in zip(part.column(0).to_pylist(), encode_texts(texts, path), strict=True):
                    ids = np.concatenate([np.frombuffer(raw, kind).astype("<u4"), end])
                    out += [(doc_id, k, k * room, len(cut := ids[k * room : (k + 1) * room]), cut.tobytes()) for k in range(-(-len(ids) // room))]
                columns = zip(*out, strict=True)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids"])
        release_memory()

    made = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = made.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")
    return written(made.withColumn("piece_id", F.monotonically_increasing_id()), "pieces")


def _ranked(short: DataFrame, most: int) -> DataFrame:
    """piece_id, length -> + rank among the pieces of the length; ``most``: those of the most frequent length.

    Ranks are counted under salts, and a salt begins where those before it end, so that a hot length is no single task's.
    """
    salts = max(LEAST_SALTS, most // RANKED)
    rows = short.select("piece_id", "length", F.pmod(F.xxhash64("piece_id"), F.lit(salts)).cast("int").alias("salt"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("piece_id")) - 1
    return rows.withColumn("inside", inside).join(starts, ["length", "salt"]).select("piece_id", "length", (F.col("start") + F.col("inside")).alias("rank"))


def places(cut: DataFrame, room: int = MAX_TOKENS) -> DataFrame:
    """Pieces (piece_id, length) -> piece_id, sequence_id, offset. Whole sequences have numbers after those of the bins.

    Each task finds the bins of its pieces in the sorted plan, whose size is bounded by the histogram.
    """
    short = cut.where(F.col("length") < room).select("piece_id", "length")
    histogram = {r["length"]: r["count"] for r in short.groupBy("length").count().collect()}  # ``room`` rows at most
    plan, bins = plan_bins(histogram, room)
    table = np.array(sorted(plan), np.int64).reshape(-1, 5)
    firsts = {int(k): int(i) for k, i in zip(*np.unique(table[:, 0], return_index=True), strict=True)}
    lasts = {int(k): i + int(n) for (k, i), n in zip(firsts.items(), np.unique(table[:, 0], return_counts=True)[1], strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece, length, rank = (batch.column(k).to_numpy() for k in range(3))
            sequence, offset = np.zeros(len(piece), np.int64), np.zeros(len(piece), np.int64)
            for k in np.unique(length):
                mine, own = np.flatnonzero(length == k), table[firsts[int(k)] : lasts[int(k)]]
                row = own[np.searchsorted(own[:, 1], rank[mine], "right") - 1]
                sequence[mine], offset[mine] = row[:, 3] + rank[mine] - row[:, 1], row[:, 4]
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(sequence), pa.array(offset)], ["piece_id", "sequence_id", "offset"])

    ranked = _ranked(short, max(histogram.values(), default=0)).mapInArrow(run, "piece_id long, sequence_id long, offset long")
    whole = cut.where(F.col("length") == room).select("piece_id", (F.col("piece_id") + bins).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.unionByName(whole)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, room: int = MAX_TOKENS) -> tuple[DataFrame, DataFrame]:
    """doc_id, text -> (pieces with their ids, places of the pieces): see ``pieces`` and ``places``, joined by piece_id.

    A null or empty text has its end alone. Documents of up to ``room`` ids are never cut, longer ones only after each ``room``. Rows with equal or null
    doc_ids are documents of their own; pieces of equal length are interchangeable and placed in the order of a hash of their
    piece_ids. The tokenizer is used as its file has it: the string of a special token in a text is that token. An empty table gives no
    rows; other columns are not read.
    """
    cut = pieces(docs, tokenizer, end_id, room)
    return cut, places(cut, room)


def sequences(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """Pieces and their places -> sequence_id, ids (those of the sequence's pieces, in order), doc_ids, lengths. A sequence's room bounds its group."""
    rows = cut.join(placed, "piece_id").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
