"""The live index in buckets, for tables of queries that are too large to be sent to the tasks.

Postings lie in buckets of their term, with Bloom filters on it, and paragraphs in buckets of their document. A table of queries is dealt by
the same hash and meets them bucket by bucket, so that neither the postings nor the paragraphs are shuffled: only what follows from the queries is.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import DATA, Snapshot, Store
from ..tables import stored
from . import segments

#: What is stored in buckets: from which table, by which column.
BUCKETED = {"postings_by_term": ("postings", "term"), "paragraphs_by_document": ("paragraphs", "rev")}
#: Bytes of stored files that go into one bucket, about, and the least number of buckets: a task sorts a bucket, which takes many times its file.
BUCKET_BYTES, LEAST_BUCKETS = 32 << 20, 8


def _written(store: Store, rows: DataFrame, key: str, buckets: int) -> str:
    """Write rows in buckets under a new name, one file each; the table's entry in the catalog is dropped again, its files stay."""
    name = f"{DATA}/bucketed-{uuid.uuid4().hex}"
    entry = f"folioseek_{uuid.uuid4().hex}"
    writer = rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option(f"parquet.bloom.filter.enabled#{key}", True)
    writer.option("path", f"{store.folder}/{name}").saveAsTable(entry, format="parquet")
    store.spark.sql(f"DROP TABLE {entry}")
    return name


def write(store: Store, buckets: int | None = None) -> Snapshot:
    """Add the bucketed tables of the live rows to the newest snapshot; ``buckets``: if None, as many as its size asks for (see ``BUCKET_BYTES``)."""

    def step(base: Snapshot) -> Snapshot:
        n = buckets or max(LEAST_BUCKETS, *(-(-base.size(source) // BUCKET_BYTES) for source, _ in BUCKETED.values()))
        made = {t: _written(store, segments.live(base, source), key, n) for t, (source, key) in BUCKETED.items()}
        return store.commit(base, properties={"buckets": n, "bucketed": _state(base)}, **made)

    return store.updated(step)


def _state(snapshot: Snapshot) -> int:
    """A number for the folders that the live rows are in."""
    return zlib.crc32(json.dumps([snapshot.tables.get(t) for t in ("postings", "paragraphs", "deleted")]).encode())


def is_current(snapshot: Snapshot) -> bool:
    """Whether the buckets hold the snapshot's live rows: no update or compaction has come since."""
    return snapshot.has("postings_by_term") and snapshot.properties["bucketed"] == _state(snapshot)


def read(snapshot: Snapshot, table: str) -> DataFrame:
    """A bucketed table, put into the session's catalog under a name that follows from its folder."""
    spark, (_, key) = snapshot.store.spark, BUCKETED[table]
    path = f"{snapshot.store.folder}/{snapshot.tables[table][0]}"
    name = f"folioseek_{hashlib.md5(path.encode()).hexdigest()}"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in snapshot.read(table).schema)
    buckets = snapshot.properties["buckets"]
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _by_parts_of_keys(spark: SparkSession) -> None:
    """From now on a join on several columns may use a layout by one of them."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def search_many(snapshot: Snapshot, queries: DataFrame) -> DataFrame:
    """``segments.search_many`` over the buckets; a ValueError if they are not those of the snapshot's rows.

    As there, each query's rarest word gives its candidates and its other words are looked up for these. The numbers of documents of words come from
    the buckets as well, without a shuffle of postings.
    """
    if not is_current(snapshot):
        raise ValueError(f"the buckets of {snapshot.store.folder} are not those of snapshot {snapshot.number}")
    _by_parts_of_keys(snapshot.store.spark)
    postings, lines = read(snapshot, "postings_by_term"), read(snapshot, "paragraphs_by_document")
    terms = queries.select("query_id", F.array_distinct("words").alias("terms")).select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("k"))
    asked = stored(terms, "terms")
    sizes = postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.col("n").asc(), F.col("term").asc())
    known = asked.join(sizes, "term").withColumn("place", F.row_number().over(order)).withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    known = stored(known.where(F.col("found") == F.col("k")).select("query_id", "term", "k", "place"), "known")
    first = stored(postings.join(known.where("place = 1").drop("place"), "term").select("query_id", "k", "rev", "positions"), "candidates")
    wanted = stored(first.select("query_id", "k", "rev").join(known.where("place > 1").select("query_id", "term"), "query_id"), "looked-up")
    more = postings.join(wanted, ["term", "rev"]).select("query_id", "k", "rev", "positions")
    every = first.unionByName(more).groupBy("query_id", "k", "rev").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_list("positions"))).alias("at"))
    hits = every.where(F.col("n") == F.col("k")).select("query_id", "rev", F.explode("at").alias("position")).join(queries.select("query_id", "words"), "query_id")
    hits = stored(hits, "hits")
    norm = T.normalised(F.col("text"))
    near = ~F.size("words").between(2, 3) | T.near_in_order(norm, F.col("words"))
    found = lines.select("rev", "position", "text").join(hits, ["rev", "position"]).where(F.forall("words", lambda w: F.contains(norm, w)) & near)
    return segments.indexed(snapshot, found.select("query_id", F.col("rev").alias("doc_index"), "position"))
