"""Hard negatives by bit-sliced integer products.

Components become integers and are stored as bit-planes of two's complement, the most significant first. Anchors go to the tasks in blocks of
bounded size, and each task holds its rows against a block plane by plane: what the planes to come can add to a score lies between the
sum of the anchor's negative components and that of its positive ones, times the largest number these planes can make, so that each plane
tightens the interval of every score. A row whose interval no longer meets a window of its anchor, or lies below the worst of those
already kept there, is dropped; where few are left, only their planes are read on. Of what remains the last plane gives the exact score.
The first pass finds the positives, whose scores set the windows of the second.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_small_batches, release_memory, shared_folder, with_rank, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LEAST_SHARE, MOST_SHARE = 30, 90
#: Anchors that are sent to the tasks at once, at most, and their components, at most.
BLOCK, BLOCK_COMPONENTS = 2048, 1 << 22
#: Components of the rows that a task holds at once, anchors they are held against at once.
STRIP, CHUNK = 1 << 18, 256
#: Where fewer than this share of the pairs are left, they are read on pair by pair.
SPARSE = 1 / 16
NONE = np.iinfo(np.int64).max
_SLICED = "vec_id long, label long, dims int, slices binary"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, embedding -> vec_id, label, q (floor of ``scale`` times each component) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"), odd.alias("odd"))
    rows = rows.where("vec_id is not null and label is not null and x is not null and not odd")
    return rows.select("vec_id", "label", F.transform("x", lambda v: F.floor(F.least(F.greatest(v * scale, F.lit(-(2.0**62))), F.lit(2.0**62)))).alias("q"))


def _bits(rows: DataFrame) -> int:
    """Bits of the largest component beside its sign; a ValueError if scores may be beyond a long."""
    size = F.greatest(F.coalesce(F.array_max("q"), F.lit(0)), -F.coalesce(F.array_min("q"), F.lit(0)) - 1)
    most, dims = rows.agg(F.max(size), F.max(F.size("q"))).first()
    bits = int(most or 0).bit_length()
    if 2 * bits + int(dims or 0).bit_length() > 61:
        raise ValueError(f"components of {bits} bits and {dims} dimensions make scores that are no longs")
    return bits


def sliced(rows: DataFrame, bits: int) -> DataFrame:
    """Quantised rows as vec_id, label, dims, slices: ``bits`` + 1 planes, each of (dims + 7) // 8 bytes; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).offsets.to_numpy()
            flat, dims, out = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at), [b""] * batch.num_rows
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                v = flat[(at[mine] - at[0])[:, None] + np.arange(d)]
                planes = np.stack([np.packbits((v >> k & 1).astype(np.uint8), axis=1) for k in range(bits, -1, -1)], axis=1)
                for i, p in zip(mine, planes, strict=True):
                    out[i] = p.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "label", "dims", "slices"])

    return written(rows.select("vec_id", "label", F.coalesce("q", F.array().cast("array<long>")).alias("q")).mapInArrow(run, _SLICED), "slices")


def _planes(slices: list[bytes], bits: int, dims: int) -> np.ndarray:
    """(planes, rows, dims) of zeros and ones."""
    packed = np.frombuffer(b"".join(slices), np.uint8).reshape(len(slices), bits + 1, (dims + 7) // 8)
    return np.unpackbits(packed, axis=2)[:, :, :dims].transpose(1, 0, 2)


def _weights(bits: int) -> np.ndarray:
    return np.array([-(1 << bits), *(1 << k for k in range(bits - 1, -1, -1))], np.int64)


class _Block:
    """Anchors of one number of dimensions with their windows, and the best rows found in each window so far."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray, low: np.ndarray, high: np.ndarray, most: int, bits: int):
        self.numbers, self.ids, self.labels, self.low, self.high, self.most, self.bits = numbers, ids, labels, low, high, most, bits
        vectors = np.tensordot(_weights(bits), planes.astype(np.int64), 1)
        room = 2 * bits + planes.shape[2].bit_length()
        # Sums of products that a float holds exactly go through its faster product.
        self.kind = np.float32 if room <= 23 else np.float64 if room <= 52 else np.int64
        self.vectors = vectors.astype(self.kind)
        self.up, self.down = np.maximum(vectors, 0).sum(1).astype(self.kind), np.minimum(vectors, 0).sum(1).astype(self.kind)
        self.scores = np.full((len(ids), low.shape[1], most), -NONE, np.int64)
        self.found = np.full((len(ids), low.shape[1], most), NONE, np.int64)

    def hold(self, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray, same: bool) -> None:
        """Hold rows, all planes of them, against all anchors."""
        for first in range(0, len(self.ids), CHUNK):
            part = slice(first, first + CHUNK)
            alive = ((labels[:, None] == self.labels[part]) == same) & (ids[:, None] != self.ids[part])
            r, a, s = self._refined(planes, alive, part)
            for w in range(self.low.shape[1]):
                inside = (s >= self._floor(w)[a]) & (s <= self.high[a, w])
                if inside.any():
                    self._keep(w, a[inside], s[inside], ids[r[inside]])

    def _floor(self, w: int) -> np.ndarray:
        """The least score that can still enter a window: its own bound, or the worst of a full list (a tie may win by its id)."""
        return np.maximum(self.low[:, w], self.scores[:, w, -1])

    def _refined(self, planes: np.ndarray, alive: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, exact score) of the pairs that no plane has dropped."""
        weights, total = _weights(self.bits).astype(self.kind), np.zeros(alive.shape, self.kind)
        floors = [self._floor(w) for w in range(self.low.shape[1])]
        vectors, plane = self.vectors[part], 0
        while plane < len(weights) and alive.mean() >= SPARSE:
            total += (planes[plane].astype(self.kind) @ vectors.T) * weights[plane]
            plane += 1
            rest = self.kind((1 << (len(weights) - plane)) - 1)
            least, most = total + rest * self.down[part], total + rest * self.up[part]
            meets = np.zeros(alive.shape, bool)
            for w, floor in enumerate(floors):
                meets |= (most >= floor[part]) & (least <= self.high[part, w])
            alive &= meets
        r, a = np.nonzero(alive)
        s, a = total[r, a], a + (part.start or 0)
        while plane < len(weights) and len(r):
            for k in range(0, len(r), step := max(1, STRIP // max(1, vectors.shape[1]))):
                some = slice(k, k + step)
                s[some] += np.einsum("ij,ij->i", planes[plane][r[some]].astype(self.kind), self.vectors[a[some]]) * weights[plane]
            plane += 1
            rest = self.kind((1 << (len(weights) - plane)) - 1)
            least, most = s + rest * self.down[a], s + rest * self.up[a]
            meets = np.zeros(len(r), bool)
            for w, floor in enumerate(floors):
                meets |= (most >= floor[a]) & (least <= self.high[a, w])
            r, a, s = r[meets], a[meets], s[meets]
        return r, a, s.astype(np.int64)

    def _keep(self, w: int, a: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        """Merge rows into the lists of a window: highest scores first, then least ids."""
        touched = np.unique(a)
        a = np.r_[np.repeat(touched, self.most), a]
        s, ids = np.r_[self.scores[touched, w].ravel(), s], np.r_[self.found[touched, w].ravel(), ids]
        order = np.lexsort((ids, -s, a))
        a, s, ids = a[order], s[order], ids[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        top = place < self.most
        self.scores[a[top], w, place[top]], self.found[a[top], w, place[top]] = s[top], ids[top]

    def kept(self) -> pa.RecordBatch:
        j, w, k = np.nonzero(self.scores > -NONE)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.numbers[j]), pa.array(w.astype(np.int32)), pa.array(self.found[j, w, k]), pa.array(self.scores[j, w, k])], ["anchor", "window", "vec_id", "score"]
        )


def _best(rows: DataFrame, anchors: list, windows: dict[int, list[tuple[int, int]]], most: int, same: bool, bits: int) -> DataFrame:
    """anchor, window, vec_id, score, rank: the ``most`` best rows in each window of a block of anchors.

    Each task keeps ``most`` rows a window of all that it reads; these meet in one group a window, ``most`` from each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, _Block] = {}
        for d in {r["dims"] for r in anchors}:
            mine = [r for r in anchors if r["dims"] == d and windows[r["anchor"]]]
            if mine:
                width = max(len(windows[r["anchor"]]) for r in mine)
                # Windows that an anchor lacks are empty ones.
                spans = np.array([windows[r["anchor"]] + [(NONE, -NONE)] * (width - len(windows[r["anchor"]])) for r in mine], np.int64)
                column = lambda name: np.array([r[name] for r in mine], np.int64)  # noqa: B023, E731
                blocks[d] = _Block(column("anchor"), column("vec_id"), column("label"), _planes([bytes(r["slices"]) for r in mine], bits, d), spans[:, :, 0], spans[:, :, 1], most, bits)

        def strips() -> Iterator[pa.Table]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                if sum(b.nbytes for b in held) * 8 >= STRIP * (bits + 1):
                    yield pa.Table.from_batches(held)
                    held = []
            if held:
                yield pa.Table.from_batches(held)

        for strip in strips():
            ids, labels, dims = (strip.column(k).to_numpy() for k in range(3))
            for d in np.unique(dims):
                if (block := blocks.get(int(d))) is not None:
                    mine = np.flatnonzero(dims == d)
                    for k in range(0, len(mine), step := max(1, STRIP // max(1, int(d)))):
                        some = mine[k : k + step]
                        block.hold(ids[some], labels[some], _planes(strip.column(3).take(pa.array(some)).to_pylist(), bits, int(d)), same)
        yield from (b.kept() for b in blocks.values())
        blocks.clear()
        release_memory()

    found = in_small_batches(rows).mapInArrow(run, "anchor long, window int, vec_id long, score long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _blocks(anchors: DataFrame, dims: int) -> Iterator[list]:
    """The numbered anchors in blocks: as many as ``BLOCK``, of ``BLOCK_COMPONENTS`` components together, at most."""
    size, n = max(1, min(BLOCK, BLOCK_COMPONENTS // max(1, dims))), anchors.count()
    for first in range(0, n, size):
        yield anchors.where(F.col("anchor").between(first, first + size - 1)).collect()


def mine(
    vectors: DataFrame, is_anchor: Column | str, positives: int = POSITIVES, negatives: int = NEGATIVES,
    least_share: int = LEAST_SHARE, most_share: int = MOST_SHARE, scale: int = SCALE,
) -> DataFrame:
    """vec_id, label, embedding -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of the quantised vectors, exact. Each anchor (``is_anchor``, a predicate on the columns) has its best
    ``positives`` rows of its label, and each of these the best ``negatives`` rows of other labels with a score of ``least_share`` to
    ``most_share`` hundredths of the positive's: all, if fewer. Equal scores go by vec_id. A positive without negatives has no row.

    Rows with a null vec_id, label, vector or component, or one that is not finite, take no part. A row is no partner of an anchor with
    its own vec_id; of rows with one vec_id each is a candidate (and an anchor) of its own. Vectors of unlike length have no score with one another; empty ones
    score 0. ValueError if scores may be beyond a long. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    q = quantised(vectors, scale)
    bits = _bits(q)
    rows = sliced(q, bits)
    numbered = with_rank(rows.where(is_anchor), [F.asc("vec_id"), F.asc("label"), F.asc("slices"), F.asc("dims")], "anchor")
    anchors = written(numbered, "anchors")
    dims = anchors.agg(F.max("dims")).first()[0] or 0
    folder, made = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}", 0
    for block in _blocks(anchors, dims):
        near = _best(rows, block, {r["anchor"]: [(-NONE + 1, NONE)] for r in block}, positives, True, bits).drop("window")
        near = written(near, "positives")
        spans: dict[int, list[tuple[int, int]]] = {r["anchor"]: [] for r in block}
        for r in near.orderBy("anchor", "rank").collect():  # BLOCK * positives rows at most
            spans[r["anchor"]].append((-(-least_share * r["score"] // 100), most_share * r["score"] // 100))
        far = _best(rows, block, spans, negatives, False, bits)
        near = near.select("anchor", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        named = spark.createDataFrame([(r["anchor"], r["vec_id"]) for r in block], "anchor long, anchor_id long")
        out = far.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(F.broadcast(near), ["anchor", "window"]).join(F.broadcast(named), "anchor")
        out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.parquet(f"{folder}/block={made}")
        made += 1
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(f"{folder}/*") if made else _nothing(spark, schema)


def _nothing(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
