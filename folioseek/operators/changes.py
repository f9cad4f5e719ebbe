"""Change detection between listings and the index, and the plan of a mirror."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_changes(listing: DataFrame, indexed: DataFrame) -> DataFrame:
    """path, mtime_s × path, last_modified -> path, status: new, changed (later time), unchanged or deleted."""
    a = listing.select("path", "mtime_s", F.lit(True).alias("_a"))
    b = indexed.select("path", "last_modified", F.lit(True).alias("_b"))
    status = (
        F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "deleted").when(F.col("mtime_s") > F.col("last_modified"), "changed").otherwise("unchanged")
    )
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def sync_plan(remote: DataFrame, local: DataFrame) -> DataFrame:
    """path, size, mtime_s of both sides -> path, action: copy (absent, later or of another size), delete or keep."""
    a = remote.select("path", F.col("size").alias("_s"), F.col("mtime_s").alias("_t"), F.lit(True).alias("_a"))
    b = local.select("path", "size", "mtime_s", F.lit(True).alias("_b"))
    copy = F.col("_b").isNull() | (F.col("_t") > F.col("mtime_s")) | (F.col("_s") != F.col("size"))
    return a.join(b, "path", "full_outer").select("path", F.when(F.col("_a").isNull(), "delete").when(copy, "copy").otherwise("keep").alias("action"))


def listing_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """path, size, mtime_s of both -> the entries that one has and the other has not, n: how many more ``b`` has (less than 0: ``a``)."""
    cols = ["path", "size", "mtime_s"]
    both = a.select(*cols, F.lit(-1).alias("n")).unionByName(b.select(*cols, F.lit(1).alias("n")))
    return both.groupBy(cols).agg(F.sum("n").alias("n")).where("n <> 0")


def listings_differ(a: DataFrame, b: DataFrame) -> bool:
    """Whether two listings (path, size, mtime_s) are unlike."""
    return not listing_differences(a, b).isEmpty()


def stale_files(cache: DataFrame, indexed: DataFrame) -> DataFrame:
    """path, size, mtime_s × path, size, last_modified -> path, reason: missing from the index, gone, of another size, or later."""
    a = cache.select("path", "size", "mtime_s", F.lit(True).alias("_a"))
    b = indexed.select("path", F.col("size").alias("_s"), F.col("last_modified").alias("_t"), F.lit(True).alias("_b"))
    reason = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "gone").when(F.col("size") != F.col("_s"), "size")
    reason = reason.when(F.col("mtime_s") > F.col("_t"), "later")
    return a.join(b, "path", "full_outer").select("path", reason.alias("reason")).where("reason is not null")


def index_is_stale(cache: DataFrame, indexed: DataFrame) -> bool:
    """Whether any file is stale. An empty cache is never newer."""
    return not cache.isEmpty() and not stale_files(cache, indexed).isEmpty()
