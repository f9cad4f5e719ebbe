"""Keeping a stored index up to date: one batch refresh, and a stream that triggers it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import changes, segments
from ..sources import docx, files
from ..sources.store import Snapshot, Store
from ..tables import dense_index, scratch, stored

PERIOD = "180 seconds"
DOCUMENTS = "rev long, doc_key long, file_path string, file_name string, file_size long, last_modified long, word_count long, paragraph_count long"


def refresh(spark: SparkSession, folder: str, store: Store, most_segments: int = 16) -> dict[str, int]:
    """Bring the stored index in line with the documents of ``folder``; returns processed, skipped, deleted, errors.

    New files are appended in the order of their paths, changed ones keep their index, deleted ones close the gap. A file that
    can't be read keeps its old rows. New and changed files alone are opened, their rows alone are written; nothing is written if nothing changed.
    Refreshes wait for one another; where a writer of another kind commits meanwhile, the refresh runs again on what that one left. Once the index has
    more than ``most_segments`` segments it is compacted.
    """
    with store.locked(), scratch(spark):
        stats = store.updated(lambda base: _refresh(spark, folder, base))
        segments.compact(store, most_segments)
    return stats


def listed(spark: SparkSession, folder: str):
    """path, name, size, mtime_s of the documents of a folder."""
    found = files.walk(spark, folder) if files.is_local(folder) else files.listing(spark, folder)
    return found.where(files.is_document(F.col("path")) & ~files.in_excluded_folder(F.col("path")))


def _read(spark: SparkSession, folder: str, paths: DataFrame, n: int) -> DataFrame:
    """Raw rows of the files in ``paths``; written. Local files are opened by tasks that have their paths, others are read in lists of a bounded length."""
    if files.is_local(folder):
        return stored(docx.read_listed(spark, folder, paths, n), "raw")
    if n <= docx.MOST_PATHS:
        return stored(docx.read_named(spark, folder, [r["path"] for r in paths.collect()]), "raw")
    numbers, out = stored(dense_index(paths, [F.col("path")], "k"), "paths"), None
    for first in range(0, n, docx.MOST_PATHS):
        names = [r["path"] for r in numbers.where(F.col("k").between(first, first + docx.MOST_PATHS - 1)).select("path").collect()]
        part = stored(docx.read_named(spark, folder, names), "raw")
        out = part if out is None else out.unionByName(part)
    return out


def _refresh(spark: SparkSession, folder: str, base: Snapshot) -> dict[str, int]:
    found = stored(listed(spark, folder), "listing")
    known = segments.live(base, "documents") if base.has("documents") else spark.createDataFrame([], DOCUMENTS)
    plan = stored(changes.file_changes(found, known.select(F.col("file_path").alias("path"), "last_modified")), "changes")
    counts = {r["status"]: r["count"] for r in plan.groupBy("status").count().collect()}
    stats = {"processed": 0, "skipped": counts.get("unchanged", 0), "deleted": counts.get("deleted", 0), "errors": 0}
    n_todo = counts.get("new", 0) + counts.get("changed", 0)
    if not (n_todo or stats["deleted"]):
        return stats

    todo = plan.where("status in ('new', 'changed')").select("path")
    raw = _read(spark, folder, todo, n_todo)
    failed = raw.where("error is not null").select(F.col("doc").alias("path")).distinct()
    good = stored(todo.join(failed, "path", "left_anti"), "good")
    stats["processed"] = good.count()
    stats["errors"] = n_todo - stats["processed"]
    if not (stats["processed"] or stats["deleted"]):
        return stats

    lines = stored(docx.structured(raw).withColumnRenamed("doc", "file_path"), "lines")
    words = F.size(F.filter(F.split(F.col("text"), r"(?U)\s+"), lambda w: w != "")).cast("long")
    sizes = lines.groupBy("file_path").agg(F.sum(words).alias("word_count"), F.count(F.lit(1)).alias("paragraph_count"))
    fresh = good.join(found, "path").select(F.col("path").alias("file_path"), F.col("name").alias("file_name"), F.col("size").alias("file_size"), F.col("mtime_s").alias("last_modified"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    fresh = fresh.join(sizes, "file_path", "left").join(known.select("file_path", "doc_key"), "file_path", "left")
    fresh = fresh.select("doc_key", "file_path", "file_name", "file_size", "last_modified", zero("word_count"), zero("paragraph_count"))
    gone = plan.where("status = 'deleted'").select(F.col("path").alias("file_path"), F.lit(True).alias("gone"))
    ended = gone.unionByName(good.select(F.col("path").alias("file_path"), F.lit(False).alias("gone")))
    segments.update(base, fresh, lines, known.join(ended, "file_path").select("rev", "doc_key", "gone"))
    return stats


def follow(spark: SparkSession, folder: str, store: Store, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Refresh whenever the period has passed (``once``: for what is there now).

    The stream of rows is only the clock: files that vanish never reach a file stream, so that each trigger compares the
    whole listing with the index.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda _, __: refresh(spark, folder, store)).option("checkpointLocation", checkpoint)
    return (writer.trigger(once=True) if once else writer.trigger(processingTime=PERIOD)).start()

