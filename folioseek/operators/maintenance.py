"""Checking, repairing and rebuilding a stored index."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Snapshot, Store
from ..tables import stored
from . import index, segments


def _report(postings: DataFrame, unknown: DataFrame, known: DataFrame) -> DataFrame:
    wrong = postings.agg(F.count_if((F.octet_length("term") < index.T.LEAST_BYTES) | (F.size("positions") <= 0)).alias("cleaned"))
    twice = index.cleaned(known).groupBy(*index.KEYS).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates"))
    return unknown.agg(F.count(F.lit(1)).alias("unknown_documents")).crossJoin(wrong).crossJoin(twice)  # one row each


def repaired(postings: DataFrame, total_documents: int) -> tuple[DataFrame, DataFrame]:
    """(postings without duplicates, short terms and empty or unknown entries; one row of what was wrong)."""
    inside = F.col("doc_index").between(0, total_documents - 1)
    known = postings.where(inside)
    return index.merged(index.cleaned(known)), _report(postings, postings.where(~inside), known)


def _keyed(base: Snapshot, table: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(live rows under doc_index, how to turn that back): stores hold versions of documents (rev), or one index alone."""
    rows = segments.live(base, table)
    if "rev" not in rows.columns:
        return rows, lambda df: df
    return rows.withColumnRenamed("rev", "doc_index"), lambda df: df.withColumnRenamed("doc_index", "rev")


def validate_and_repair(store: Store) -> dict[str, int]:
    """Hold the stored postings against the stored documents; repaired ones are committed if anything was wrong, and nothing else is written."""

    def step(base: Snapshot) -> dict[str, int]:
        postings, back = _keyed(base, "postings")
        docs = _keyed(base, "documents")[0].select("doc_index")
        known = postings.join(docs, "doc_index", "left_semi")
        found = _report(postings, postings.join(docs, "doc_index", "left_anti"), known).first().asDict()
        if any(found.values()):
            store.commit(base, postings=back(stored(index.merged(index.cleaned(known)), "repaired")))
        return found

    return store.updated(step)


def _rebuilt(base: Snapshot) -> None:
    lines, back = _keyed(base, "paragraphs")
    key = back(lines.select("doc_index")).columns[0]
    made, _ = segments.written_postings(base.store, segments.listed(index.lists(lines, sizes=False)), back(lines), key)
    base.store.commit(base, postings=made)


def rebuild(store: Store) -> None:
    """Build the postings anew from the stored paragraphs, which are not written again."""
    store.updated(_rebuilt)


#: What Spark says of files that are no Parquet, or not there.
UNREADABLE = ("CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE", "PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _unreadable(e: Exception) -> bool:
    """Whether an error is about the files of an index; a lost executor, or a time-out, is not."""
    if isinstance(e, (FileNotFoundError, AnalysisException)):
        return True
    condition = e.getCondition() if isinstance(e, PySparkException) else None
    return any(u in (condition or "") or u in str(e) for u in UNREADABLE)


def _indexed(base: Snapshot) -> DataFrame | None:
    """The live postings, or None if they can't be read."""
    try:
        rows = _keyed(base, "postings")[0]
        rows.agg(F.count("term")).first()
    except (FileNotFoundError, PySparkException, Py4JJavaError) as e:
        if not _unreadable(e):
            raise
        return None
    return rows


def rebuild_if_needed(store: Store) -> bool:
    """Rebuild where the index lacks more than ten documents, has as many too many, is empty or can't be read."""

    def step(base: Snapshot) -> bool:
        postings, total = _indexed(base), segments.live(base, "documents").count()
        needed = postings is None or index.needs_rebuild(postings, postings.agg(F.countDistinct("doc_index")).first()[0], total)
        if needed:
            _rebuilt(base)
        return needed

    return store.updated(step)
