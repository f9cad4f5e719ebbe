"""Near-duplicate embeddings by NN-descent.

Vectors that are equal are one node. The neighbour graph begins with the leaves of random-projection trees (runs of equal length in
the order of a hyperplane code) and is refined by joins of neighbours' neighbours: all pairs among the neighbours of one
node, forward and reverse, are compared, and what is nearer than a list's last entry goes into it. A list whose entries all
reach the threshold is saturated, and its room is doubled. Every compared pair at the threshold is an edge of the
components, whether or not a list has room for it: a block of compared vectors gives the edges of a forest that joins what
its pairs join. Rounds go on until one joins no more components and an audit, a bounded sample of vectors held against all rows, finds its
links inside the components; a family counts as much in it as a single vector. Where none of the audited vectors has a link, another
forest of trees takes the audit's place: it must join nothing more. If the rounds end before that, all vectors are
held against all rows, chunk by chunk.
Links are then counted exactly inside each component, block by block, so that a large family of copies never meets in one
task and its pairs are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written
from .graph import components

THRESHOLD = 0.9
TREES = 8
BITS = 31
LEAF = 128
NEIGHBOURS = 8
#: Lists guide the search alone (edges are kept without regard to them), so that their room need not grow with a family.
MOST_ROOM = 64
SLICE = 24
MIN_ROUNDS, MAX_ROUNDS = 2, 8
AUDIT = 1024
AUDIT_SEED = 1_000_003
#: Rows of a table that are held at once against the vectors of an audit or of a chunk.
STRIP = 512
CHUNK = 4096
RECALL = 0.995
COUNT_BLOCK = 256


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles from a binary column of equal lengths."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def normalised(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding -> vec_id, unit (doubles as binary; null where a vector cannot link), dims."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = []
            for v in batch.column(1):
                x = np.array(v.as_py() or [], np.float64)  # None becomes NaN
                with np.errstate(over="ignore", invalid="ignore"):
                    # Scaled first, so that squares neither overflow nor vanish.
                    top = np.abs(x).max(initial=0.0)
                    x = x / top if np.isfinite(top) and top > 0 else x * np.nan
                    units.append((x / np.linalg.norm(x)).tobytes() if len(x) and np.isfinite(x).all() else None)
            dims = pa.array([len(u) // 8 if u is not None else None for u in units], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary()), dims], ["vec_id", "unit", "dims"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, unit binary, dims int")


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where a run of equal keys begins, and the end."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.r_[np.flatnonzero(new), n]


def _by_run(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Batches of whole runs of the first ``n_keys`` columns, by which the rows are sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        at = _runs([whole.column(i).to_numpy() for i in range(n_keys)])
        if len(at) > 2:
            yield whole.slice(0, at[-2])
        held = [whole.slice(at[-2])]
    yield from held


def _forest(ids: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges, fewer than there are ids, that join what the pairs (rows, cols) of positions join."""
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, rows, label[cols])
        np.minimum.at(low, cols, label[rows])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _together(found: list[pa.RecordBatch], links: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Entries of lists, and one forest of all the links (cos is null)."""
    a, b = (np.concatenate([x[k] for x in links]) if links else np.zeros(0, np.int64) for k in (0, 1))
    ids, at = np.unique(np.r_[a, b], return_inverse=True)
    a, b = _forest(ids, at[: len(a)], at[len(a) :])
    edges = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.float64())], ["a", "b", "cos"])
    return pa.Table.from_batches([*found, edges]).combine_chunks().to_batches()[0] if len(a) + sum(x.num_rows for x in found) else edges


def _first_lists(nodes: DataFrame, threshold: float, seed: int = 77) -> DataFrame:
    """(id, dims, unit) -> (a, b, cos): the nearest in each tree's leaf, and edges at the threshold with a null cos."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                if d not in planes:
                    planes[d] = np.random.default_rng(seed + int(d)).standard_normal((int(d), TREES * BITS))
                bits = (_matrix(part.column(2)) @ planes[d] > 0).reshape(-1, TREES, BITS)
                codes = bits @ (1 << np.arange(BITS - 1, -1, -1))
                for t in range(TREES):
                    tree = pa.array(np.full(part.num_rows, int(d) * TREES + t, np.int64))
                    yield pa.RecordBatch.from_arrays([tree, pa.array(codes[:, t]), part.column(0), part.column(2)], ["tree", "code", "id", "unit"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_run(_leaves(batches), 1):
            at = _runs([batch.column(0).to_numpy()])
            out, links = [], []
            for i, j in zip(at[:-1], at[1:], strict=True):
                leaf = batch.slice(i, j - i)
                found, edges = _top(leaf.column(2).to_numpy(), _matrix(leaf.column(3)), np.full(j - i, -2.0), NEIGHBOURS, threshold)
                out.append(found)
                links.append(edges)
            yield _together(out, links)

    def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tree column replaced by the number of the leaf, LEAF rows each."""
        leaf, tree, room = 0, None, 0
        for batch in batches:
            trees, numbers = batch.column(0).to_numpy(), np.empty(batch.num_rows, np.int64)
            for k, t in enumerate(trees):
                if t != tree or not room:
                    leaf, tree, room = leaf + 1, t, LEAF
                numbers[k], room = leaf, room - 1
            yield pa.RecordBatch.from_arrays([pa.array(numbers), *batch.columns[1:]], batch.schema.names)

    coded = nodes.select("id", "dims", "unit").mapInArrow(code, "tree long, code long, id long, unit binary")
    dealt = coded.repartitionByRange(shuffle_partitions(nodes.sparkSession), "tree", "code", "id").sortWithinPartitions("tree", "code", "id")
    return dealt.mapInArrow(nearest, "a long, b long, cos double")


def _top(ids: np.ndarray, x: np.ndarray, least: np.ndarray, k: int, threshold: float) -> tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]]:
    """Of each row the ``k`` nearest other rows, those nearer than its ``least``; a forest of all pairs at the threshold."""
    cos = x @ x.T
    cos[ids[:, None] == ids[None, :]] = -3
    links = _forest(ids, *np.nonzero(cos >= threshold))
    take = np.argpartition(-cos, min(k, len(ids) - 1), axis=1)[:, :k] if len(ids) > k else np.broadcast_to(np.arange(len(ids)), cos.shape)
    c = np.take_along_axis(cos, take, axis=1)
    rows, cols = np.nonzero(c > least[:, None])
    rows, cols = rows[c[rows, cols] > -3], cols[c[rows, cols] > -3]
    return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(ids[take[rows, cols]]), pa.array(c[rows, cols])], ["a", "b", "cos"]), links


def _lists(found: DataFrame, room: DataFrame) -> DataFrame:
    """The best of (a, b, cos) for each a, as many as its room; room and the last cosine on each row."""
    best = found.groupBy("a", "b").agg(F.max("cos").alias("cos")).join(room, "a")
    order = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    kept = best.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("room")).drop("_r")
    return kept


def _refined(lists: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of neighbours' neighbours that are nearer than the last entries of their lists, and edges with a null cos."""
    last = lists.groupBy("a").agg(F.when(F.count(F.lit(1)) < F.first("room"), -2.0).otherwise(F.min("cos")).alias("least"), F.first("room").alias("room"))
    reverse = lists.select(F.col("b").alias("pivot"), F.col("a").alias("member"))
    # A node that is in many lists is a pivot in several slices; each has its own list and a part of the reverse.
    slices = reverse.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("n"))
    slices = written(slices, "slices")
    part = F.pmod(F.xxhash64("member"), F.col("n")).cast("int")
    back = reverse.join(slices, "pivot").select("pivot", part.alias("slice"), "member")
    forth = lists.select(F.col("a").alias("pivot"), F.col("b").alias("member")).join(slices, "pivot", "left")
    forth = forth.select("pivot", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)).alias("slice"), "member")
    members = back.unionByName(forth).distinct()
    vectors = nodes.select(F.col("id").alias("member"), "unit", "dims").join(last.withColumnRenamed("a", "member"), "member", "left")
    vectors = vectors.select("member", "unit", F.coalesce("least", F.lit(-2.0)).alias("least"), F.coalesce("room", F.lit(NEIGHBOURS)).alias("room"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_run(batches, 2):
            at = _runs([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            out, links, ids = [], [], batch.column(2).to_numpy()
            least, x, room = batch.column(4).to_numpy(), _matrix(batch.column(3)), batch.column(5).to_numpy()
            for i, j in zip(at[:-1], at[1:], strict=True):
                if j - i > 1:
                    found, edges = _top(ids[i:j], x[i:j], least[i:j], int(room[i:j].max()), threshold)
                    out.append(found)
                    links.append(edges)
            if out:
                yield _together(out, links)

    rows = members.join(vectors, "member").select("pivot", "slice", "member", "unit", "least", "room")
    dealt = rows.repartition(shuffle_partitions(nodes.sparkSession), "pivot", "slice").sortWithinPartitions("pivot", "slice")
    return dealt.mapInArrow(compare, "a long, b long, cos double")


def _held(nodes: DataFrame, asked: pa.Table, threshold: float, forest: bool) -> DataFrame:
    """(a, b): the links of the asked vectors to all rows, or edges that join what those links join."""
    shared = nodes.sparkSession.sparkContext.broadcast((asked["id"].to_numpy(), asked["dims"].to_numpy(), asked["unit"].to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, dims, units = shared.value
        of = {int(d): np.flatnonzero(dims == d) for d in np.unique(dims)}
        asked_x = {d: np.frombuffer(b"".join(units[i] for i in q), np.float64).reshape(len(q), -1) for d, q in of.items()}
        for batch in batches:
            mine = batch.column(1).to_numpy()
            for d in np.intersect1d(mine, dims):
                part, q = batch.filter(pa.array(mine == d)), ids[of[int(d)]]
                for k in range(0, part.num_rows, STRIP):
                    strip = part.slice(k, STRIP)
                    a, b = np.nonzero(asked_x[int(d)] @ _matrix(strip.column(2)).T >= threshold)
                    other = strip.column(0).to_numpy()
                    a, b = (_forest(np.r_[q, other], a, b + len(q)) if forest else (q[a], other[b]))
                    yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    return nodes.select("id", "dims", "unit").mapInArrow(run, "a long, b long")


def _recall(nodes: DataFrame, labels: DataFrame, threshold: float) -> float | None:
    """Which share of its links a vector has inside its component, the mean over components: a family counts once. None if no audited vector has a link.

    Held against all rows are a sample of the vectors and one of the components, each by its least hash.
    """
    order = [F.xxhash64("id"), F.col("id")]
    firsts = labels.groupBy("component").agg(F.min(F.struct(F.xxhash64("node"), F.col("node").alias("id"))).alias("f")).select("f.id").orderBy(*order).limit(AUDIT)
    ids = nodes.select("id").orderBy(*order).limit(AUDIT).unionByName(firsts).distinct()
    asked = nodes.join(F.broadcast(ids), "id").select("id", "dims", "unit").toArrow()  # 2 * AUDIT ids at most
    if not asked.num_rows:
        return None
    of = lambda name: labels.select(F.col("node").alias(name), F.col("component").alias(f"{name}_c"))
    both = _held(nodes, asked, threshold, False).join(of("a"), "a", "left").join(of("b"), "b", "left")
    vectors = both.groupBy("a", F.coalesce("a_c", "a").alias("c")).agg(F.avg(F.when(F.col("a_c") == F.col("b_c"), 1.0).otherwise(0.0)).alias("r"))
    return vectors.groupBy("c").agg(F.avg("r").alias("r")).agg(F.avg("r")).first()[0]


def _audited(nodes: DataFrame, labels: DataFrame, edges: DataFrame, threshold: float, turn: int) -> tuple[bool, DataFrame, DataFrame]:
    """(whether the links are found, labels, edges). Where links are so rare that the audit meets none, another forest must join nothing more."""
    recall = _recall(nodes, labels, threshold)
    if recall is not None:
        return recall >= RECALL, labels, edges
    more = written(_first_lists(nodes, threshold, AUDIT_SEED + turn * 100_003).where("cos is null").select("a", "b"), "audit-edges")
    again = components(edges.unionByName(more))
    same = again.where("node <> component").count() == labels.where("node <> component").count()
    return same, again, again.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _exact_edges(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): edges that join all that is linked, from all pairs, a chunk of the vectors at a time."""
    n = -(-nodes.count() // CHUNK)
    out = nodes.sparkSession.createDataFrame([], "a long, b long")
    for k in range(n):
        asked = nodes.where(F.pmod(F.xxhash64("id", "unit"), F.lit(n)) == k).select("id", "dims", "unit").toArrow()
        out = out.unionByName(written(_held(nodes, asked, threshold, True).distinct(), "exact-edges"))
    return out


def _counted(nodes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(id, links): vectors linked with each node, all pairs of a component compared block by block."""
    of = nodes.join(labels.withColumnRenamed("node", "id"), "id")
    sizes = of.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / COUNT_BLOCK).cast("int").alias("n"))
    sizes = written(sizes, "component-sizes")
    of = of.join(sizes, "component").withColumn("i", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    of = of.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    of = of.select("component", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i", "id", "copies", "unit")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_run(batches, 3):
            at = _runs([batch.column(k).to_numpy() for k in range(3)])
            block, ids, copies, x = (batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy(), _matrix(batch.column(6)))
            links = np.zeros(batch.num_rows, np.int64)
            for a, b in zip(at[:-1], at[1:], strict=True):
                near = x[a:b] @ x[a:b].T >= threshold
                if batch.column(1)[int(a)].as_py() != batch.column(2)[int(a)].as_py():
                    near &= block[a:b, None] != block[None, a:b]
                near &= ids[a:b, None] != ids[None, a:b]
                links[a:b] = near @ copies[a:b]
            yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(links)], ["id", "links"])

    dealt = of.repartition(shuffle_partitions(nodes.sparkSession), "component", "x", "y").sortWithinPartitions("component", "x", "y")
    return dealt.mapInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, embedding -> vec_id, n_links, component_id, kept for every row.

    Vectors that are null, empty or zero, or hold a null or a non-finite component, link with nothing, and vectors of unlike
    lengths don't link. A cosine of just the threshold links; equal cosines are links alike, whatever their order. Vectors of any length are compared whole.
    Equal vectors are one node and count as many links. Rows that repeat a vec_id are rows of
    their own; a null vec_id links with nothing and is not kept. An empty table gives no rows; other columns are not read.
    """
    made = written(normalised(vectors), "units")
    usable = made.where("unit is not null and vec_id is not null")
    nodes = written(usable.groupBy("unit", "dims").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "nodes")
    # Two different vectors may share an id that is the least of both: one of them then stands for the id in the graph.
    room = nodes.select(F.col("id").alias("a"), F.lit(NEIGHBOURS).alias("room")).distinct()
    found = written(_first_lists(nodes, threshold), "found")
    lists = written(_lists(found.where("cos is not null"), room), "lists")
    edges, joined = found.where("cos is null").select("a", "b"), -1
    for turn in range(1, MAX_ROUNDS + 1):
        full = lists.groupBy("a").agg(F.min("cos").alias("least"), F.count(F.lit(1)).alias("n"), F.first("room").alias("room"))
        saturated = (F.col("least") >= threshold) & (F.col("n") >= F.col("room"))
        room = written(full.select("a", F.when(saturated, F.least(F.col("room") * 2, F.lit(MOST_ROOM))).otherwise(F.col("room")).alias("room")), "room")
        # Lists with more room take what is as near as any.
        again = lists.drop("room").join(room, "a")
        found = written(_refined(again, nodes, threshold), "found")
        new = written(_lists(again.select("a", "b", "cos").unionByName(found.where("cos is not null")), room), "lists")
        lists = new
        # The edges so far, as one of each node to its component.
        labels = components(edges.unionByName(found.where("cos is null").select("a", "b")))
        edges = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        before, joined = joined, labels.where("node <> component").count()
        if turn >= MIN_ROUNDS and joined == before:
            sound, labels, edges = _audited(nodes, labels, edges, threshold, turn)
            if sound:
                break
            joined = labels.where("node <> component").count()
    else:
        sound, labels, edges = _audited(nodes, labels, edges, threshold, MAX_ROUNDS + 1)
        if not sound:
            labels = components(edges.unionByName(_exact_edges(nodes, threshold)))
    counts = written(_counted(nodes, labels, threshold), "links")
    known = nodes.join(labels.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left")
    known = written(
        known.select("unit", F.coalesce("component", "id").alias("_c"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_n")), "known"
    )
    out = made.where("unit is not null and vec_id is not null").join(known, "unit").select("vec_id", F.col("_n").alias("n_links"), F.col("_c").alias("component_id"))
    rest = made.where("unit is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
