"""MinHash near-duplicates by an LSH forest, links confirmed on the full shingle sets.

A document's set are its distinct five-word shingles (words lower-cased A-Z, split at ASCII white space); with fewer words
the whole sequence is one shingle. Documents with equal sets form one class, known by its smallest doc_id. Every class
has a path of ``DEPTH`` min-hashes in each of ``TREES`` trees. Paths that share their first two values lie in one region; only
those in a region with others take part.

First each class of a crowded region is held against the region's hub, the member that lies in the largest regions over all
trees: the original of a family of edited copies lies in most of its copies' regions even if two copies of it are below
the threshold. Then, in ``ROUNDS`` rounds, the paths of each tree are sorted, and a class is held against the best of its
neighbours of other components, by the longest common prefix: the more members a region has, the deeper is the prefix that
its neighbours share. At last the regions that still have members of several components are completed: block by block all
their pairs that are not in one component are compared on full sets, so that every pair that shares a region is settled.

Two bits of every min-hash travel with a class, and pairs that agree in fewer of them than a pair at the threshold does in
one of a thousand million cases are left out. That and pairs at the threshold that share no region (one of 500,000) is what can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, columns, in_small_batches, release_memory, shingle_hashes, shuffle_partitions, small_or_shuffled, unused, utf8, word_hashes, words, written
from .embeddings import _by_run, _forest, _runs
from .graph import components

THRESHOLD = (75, 100)
TREES, DEPTH = 16, 6
#: Places on either side, in a sorted order, at which a neighbour is looked for; the completion takes what lies further.
NEAR = 8
#: Min-hashes that agree in two bits, of TREES * DEPTH, for a candidate: six deviations below the mean at the threshold.
LEAST_AGREE = 55
#: Rounds of neighbours in the sorted orders.
ROUNDS = 2
BLOCK = 1 << 20
#: Classes of a region in a block: of those whose bits are compared, and of those whose sets are.
BITS_BLOCK, SETS_BLOCK = 4096, 256

_rng = np.random.default_rng(10_007)
_FACTOR = _rng.integers(0, 1 << 64, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 64, TREES * DEPTH, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """Blocks of texts, each as the sorted distinct shingle hashes of its texts, whole; nothing for one without words."""
    data, offsets = utf8(texts)
    for i, j in blocks(offsets, BLOCK):
        part = offsets[i : j + 1]
        low, starts, ends, first = words(data[part[0] : part[-1]], part - part[0])
        hashes, at = shingle_hashes(word_hashes(low, starts, ends), first)
        sets = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            s = np.sort(hashes[a:b])
            sets.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s)
        yield sets


def _paths(sets: list[np.ndarray]) -> np.ndarray:
    """TREES * DEPTH big-endian min-hashes of each set; all of them are non-empty."""
    lengths = np.array([len(s) for s in sets])
    h, starts = np.concatenate(sets), np.r_[0, np.cumsum(lengths)[:-1]]
    out = np.empty((len(sets), TREES * DEPTH), ">u4")
    for a in range(0, len(sets), 64):  # a stretch that stays in the cache
        b = min(len(sets), a + 64)
        x = h[starts[a] : starts[b - 1] + lengths[b - 1]]
        at = starts[a:b] - starts[a]
        for k in range(TREES * DEPTH):
            out[a:b, k] = np.minimum.reduceat((x * _FACTOR[k] + _SHIFT[k]) >> np.uint64(32), at)
    return out


def _two_bits(paths: np.ndarray) -> np.ndarray:
    """Two low bits of each min-hash, 32 of them in a long."""
    low = (paths.astype(np.uint64) & np.uint64(3)).reshape(len(paths), TREES * DEPTH // 32, 32)
    return np.bitwise_or.reduce(low << (2 * np.arange(32, dtype=np.uint64)), axis=2).view(np.int64)


def _agree(x: str, y: str) -> Column:
    """In how many min-hashes the bits of two classes agree."""

    def differ(a: Column, b: Column) -> Column:
        z = a.bitwiseXOR(b)
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    longs = TREES * DEPTH // 32
    return F.lit(TREES * DEPTH) - sum((differ(F.get(x, F.lit(i)), F.get(y, F.lit(i))) for i in range(longs)), F.lit(0))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, key_a, key_b (of the set), paths, bits (null without words)."""
    names = ["doc_id", "n_shingles", "key_a", "key_b", "paths", "bits"]

    def sketched(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [s for s in sets if len(s)]
        made = _paths(full) if full else np.zeros((0, TREES * DEPTH), ">u4")
        paths, bits = iter(made), iter(_two_bits(made))
        with np.errstate(over="ignore"):
            keys = [(int(s.sum(dtype=np.uint64).view(np.int64)), int((s * s).sum(dtype=np.uint64).view(np.int64))) for s in sets]
        columns = [
            ids.cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
            pa.array([next(paths).tobytes() if len(s) else None for s in sets], pa.binary()),
            pa.array([next(bits) if len(s) else None for s in sets], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(1)):
                yield sketched(batch.column(0).slice(at, len(sets)), sets)
                at += len(sets)
        batch = sets = None
        release_memory()

    return in_small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, key_a long, key_b long, paths binary, bits array<long>")


def placed(classes: DataFrame) -> DataFrame:
    """(rep, paths, bits) -> rep, bits, tree, path, region, region_n where the region has other members."""
    width = 4 * DEPTH
    rows = classes.select("rep", "paths", "bits", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select("rep", "bits", "tree", F.substring(F.col("paths"), F.col("tree") * width + 1, F.lit(width)).alias("path"))
    rows = rows.withColumn("region", F.xxhash64("tree", F.substring("path", 1, 8)))
    shared = rows.groupBy("region").agg(F.count(F.lit(1)).alias("region_n")).where("region_n > 1")
    return written(rows.join(small_or_shuffled(written(shared, "regions")), "region"), "paths")


def _best(found: DataFrame) -> DataFrame:
    """(rep, other, agree) -> (a, b): of each rep the candidate that agrees most."""
    best = found.where(F.col("agree") >= LEAST_AGREE).groupBy("rep").agg(F.max(F.struct("agree", (-F.col("other")).alias("minus"))).alias("top"))
    chosen = best.select("rep", (-F.col("top.minus")).alias("other")).where("rep <> other")
    return written(chosen.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct(), "pairs")


def hub_pairs(paths: DataFrame) -> DataFrame:
    """(a, b): each class of a crowded region with the best of its regions' hubs."""
    crowded = paths.where(F.col("region_n") > NEAR)
    weight = crowded.groupBy("rep").agg(F.sum("region_n").alias("weight"))
    member = written(crowded.join(weight, "rep").select("region", "rep", "bits", "weight"), "members")
    top = F.struct(F.col("weight"), (-F.col("rep")).alias("minus"), F.col("bits"))
    hubs = written(member.groupBy("region").agg(F.max(top).alias("h")), "hubs")
    stars = member.join(hubs, "region").where(F.col("rep") != -F.col("h.minus"))
    return _best(stars.select("rep", (-F.col("h.minus")).alias("other"), _agree("bits", "h.bits").alias("agree")))


def neighbour_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): each class with the best of its neighbours, in the sorted orders of all trees, that share its region and not its label."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            whole = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()
            if not whole:
                continue
            region, rep, label = (whole[0].column(k).to_numpy() for k in range(3))
            n = len(rep)
            bits = whole[0].column(3).flatten().to_numpy().view(np.uint64).reshape(n, -1)
            best, other = np.full(n, -1), np.zeros(n, np.int64)
            for k in range(1, min(NEAR, n - 1) + 1):
                i = np.flatnonzero((region[k:] == region[:-k]) & (label[k:] != label[:-k]))
                z = bits[i] ^ bits[i + k]
                agree = TREES * DEPTH - np.bitwise_count((z | (z >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)
                for mine, its in ((i, i + k), (i + k, i)):
                    more = agree > best[mine]
                    best[mine[more]], other[mine[more]] = agree[more], rep[its[more]]
            at = np.flatnonzero(best >= LEAST_AGREE)
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(other[at]), pa.array(best[at])], ["rep", "other", "agree"])
            held = [whole[0].slice(max(0, n - NEAR))]

    order = ["tree", "path", "rep"]
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return _best(dealt.select("region", "rep", "label", "bits").mapInArrow(near, "rep long, other long, agree long"))


def _open_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Paths in regions that have members of several components, each with its component as label."""
    named = rows.drop("label").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.withColumn("label", F.coalesce("component", "rep")).drop("component")
    mixed = named.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    return written(named.drop("region_n").join(small_or_shuffled(written(mixed.select("region", F.col("size").alias("region_n")), "mixed")), "region"), "open")


def _blocked(members: DataFrame, block: int, *columns: str) -> DataFrame:
    """Members of regions, each once for each pair of blocks (x, y) it belongs to; i is its block. Sorted by region, x, y."""
    of = members.withColumn("n", F.ceil(F.col("region_n") / block).cast("int"))
    of = of.withColumn("i", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    of = of.select("region", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i", "rep", "label", "bits", *columns)
    return of.repartition(shuffle_partitions(members.sparkSession), "region", "x", "y").sortWithinPartitions("region", "x", "y")


def _open(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """Of each pair of blocks and some rows of it: (first row of the blocks, first of the rows, which pairs are still open)."""
    keys = [batch.column(k).to_numpy() for k in range(3)]
    block, label = batch.column(3).to_numpy(), batch.column(5).to_numpy()
    bits = batch.column(6).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
    at = _runs(keys)
    for a, b in zip(at[:-1], at[1:], strict=True):
        for k in range(a, b, 256):
            rows = slice(k, min(k + 256, b))
            pairs = label[rows, None] != label[None, a:b]
            if keys[1][a] != keys[2][a]:
                pairs &= block[rows, None] != block[None, a:b]
            if pairs.any():
                differ = np.zeros(pairs.shape, np.uint8)
                for n in range(bits.shape[1]):
                    z = bits[rows, n][:, None] ^ bits[a:b, n][None]
                    differ += np.bitwise_count((z | (z >> np.uint64(1))) & np.uint64(0x5555555555555555))
                pairs &= differ <= TREES * DEPTH - LEAST_AGREE
            yield a, k, pairs


def completed(rows: DataFrame, docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(a, b): edges that join all linked classes of the open ``rows`` which share a region and have different labels."""
    part, whole = threshold

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_run(batches, 3):
            some = np.zeros(batch.num_rows, bool)
            for _, k, pairs in _open(batch):
                some[k : k + len(pairs)] |= pairs.any(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4)], ["region", "rep"]).filter(pa.array(some))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_run(batches, 3):
            ids, at, found = batch.column(4).to_numpy(), _runs([batch.column(k).to_numpy() for k in range(3)]), ([], [])
            end, first, value, flags = dict(zip(at[:-1], at[1:], strict=True)), -1, None, None
            for a, k, pairs in _open(batch):
                if a != first:
                    first, sets = a, [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(7).slice(a, end[a] - a)]
                    lengths = np.array([len(v) for v in sets])
                    starts = np.cumsum(lengths) - lengths
                    value = np.unique(np.concatenate(sets), return_inverse=True)[1]
                    flags = np.zeros(value.max() + 1, np.int32)
                for r in np.flatnonzero(pairs.any(axis=1)):
                    n = k - a + r
                    own = value[starts[n] : starts[n] + lengths[n]]
                    flags[own] = 1
                    both = np.add.reduceat(flags[value], starts)
                    flags[own] = 0
                    near = np.flatnonzero(pairs[r] & (whole * both >= part * (lengths[n] + lengths - both)))
                    found[0].append(np.full(len(near), a + n))
                    found[1].append(a + near)
            if found[0]:
                x, y = _forest(ids, np.concatenate(found[0]), np.concatenate(found[1]))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    rows = rows.select("region", "region_n", "rep", "label", "bits")
    screened = _blocked(rows, BITS_BLOCK).mapInArrow(screen, "region long, rep long")
    left = written(screened.distinct(), "screened")
    sizes = left.groupBy("region").agg(F.count(F.lit(1)).alias("region_n"))
    sets = _sets(docs, left.select(F.col("rep").alias("doc_id")).distinct()).withColumnRenamed("id", "rep")
    members = rows.drop("region_n").join(left, ["region", "rep"], "left_semi").distinct().join(small_or_shuffled(written(sizes, "sizes")), "region")
    members = written(members.join(sets, "rep"), "open-sets")
    return written(_blocked(members, SETS_BLOCK, "set").mapInArrow(compare, "a long, b long").distinct(), "completed")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set): the shingle sets of the documents with these ids."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for found in shingle_sets(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(found)), pa.array([s.tobytes() for s in found], pa.binary())], ["id", "set"])
                at += len(found)
        batch = found = None
        release_memory()

    texts = docs.join(small_or_shuffled(written(ids, "needed")), "doc_id", "left_semi").select("doc_id", "text")
    return written(texts.mapInArrow(sets, "id long, set binary"), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= 75 * union. ``docs`` has one text an id."""
    part, whole = threshold

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(whole * both >= part * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    found = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    left = found.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = found.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id, kept for every row.

    Null, empty and blank texts have an empty set and link with nothing. Rows with one doc_id are one node: their
    links are joined. A row with a null doc_id takes no part: component_id is null and kept false. Texts of any length
    are compared whole. Of candidates that agree alike the smallest id is compared first, which changes no result. An empty
    table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = written(sketches(docs), "sketches")
    real = made.where("n_shingles > 0 and doc_id is not null")
    keys = ["key_a", "key_b", "n_shingles"]
    classes = written(real.groupBy(*keys).agg(F.min("doc_id").alias("rep")), "classes")
    reps = real.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    paths = placed(reps.select(F.col("doc_id").alias("rep"), "paths", "bits").dropDuplicates(["rep", "paths"]))
    unique = docs.where("doc_id is not null")
    # Ids of several rows join the classes of all of them.
    repeated = real.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id")
    same = real.join(repeated, "doc_id", "left_semi").join(classes, keys).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = components(same.unionByName(confirmed(hub_pairs(paths), unique, threshold)))
    rows = _open_rows(paths, labels)
    joins = lambda edges: components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(edges))
    for _ in range(ROUNDS):
        links = written(confirmed(neighbour_pairs(rows), unique, threshold), "links")
        if links.isEmpty():
            break
        labels = joins(links)
        rows = _open_rows(rows, labels)
    links = completed(rows, unique, threshold)
    joined = labels if links.isEmpty() else joins(links)
    named = classes.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = written(named.select(*keys, F.coalesce("component", "rep").alias("component")), "named")
    out = made.drop("paths", "bits").join(named, keys, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))



def keep_one(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose component has a smaller doc_id.

    Of rows with one doc_id one stays, the first in the order of their values as JSON, so that reruns agree. Rows with a null doc_id stay.
    """
    found = written(near_duplicates(docs, threshold).select("doc_id", "kept"), "kept")
    gone = written(found.where("not kept and doc_id is not null").select("doc_id").distinct(), "gone")
    again = written(found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    left = docs.join(small_or_shuffled(gone), "doc_id", "left_anti").select(*columns(docs.columns))
    if again.isEmpty():
        return left
    twice = left.join(again, "doc_id", "left_semi").select(*columns(docs.columns))
    rank = unused(docs.columns, "_rank")
    order = Window.partitionBy("doc_id").orderBy(F.to_json(F.struct(*columns(docs.columns))))
    once = twice.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)
    return left.join(again, "doc_id", "left_anti").select(*columns(docs.columns)).unionByName(once)
