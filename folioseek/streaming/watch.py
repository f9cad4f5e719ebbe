"""Events of files from listings in a stream: what is new, changed or gone, with a keyed state.

A pass lists the folder and puts its rows, with the number of the pass as their time, beside those of earlier passes; all of a pass appears
at once. The stream reads passes as they come and keeps for each path what it last saw. A path that a pass holds sets a timer for the end of
that pass; the watermark, which follows the passes, sets it off unless a later one has seen the path. So deletions, which no stream of files shows, are
events as well, and each key is looked at in the task that has its state: no pass is compared with an index. After a restart from the checkpoint no
event is told again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import refresh

#: Keyed states with timers are kept by this provider.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
PASS = "path string, size long, mtime_s long, pass long"
EVENTS = "path string, event string, size long, mtime_s long, pass long"
_SEEN = "size long, mtime_s long, pass long"


def record(spark: SparkSession, folder: str, passes: str) -> int:
    """List the documents of ``folder`` as the next pass into the folder ``passes``; returns its number."""
    return record_listing(refresh.listed(spark, folder), passes)


def record_listing(listing: DataFrame, passes: str) -> int:
    """path, size, mtime_s as the next pass, which appears at once; returns its number, 1 for the first.

    A row without a path tells the end of the pass before even if the folder is empty. Of two that write one pass one gets a FileExistsError.
    """
    spark, root = listing.sparkSession, passes.rstrip("/")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    store = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(path(root))] if store.exists(path(root)) else []
    number = max((int(n.removeprefix("pass-")) for n in names if n.startswith("pass-")), default=0) + 1
    draft, target = path(f"{root}/_{uuid.uuid4().hex}"), path(f"{root}/pass-{number:012d}")
    rows = listing.select("path", F.col("size").cast("long").alias("size"), F.col("mtime_s").cast("long").alias("mtime_s"), F.lit(number).cast("long").alias("pass"))
    rows.unionByName(spark.createDataFrame([(None, None, None, number)], PASS)).write.parquet(draft.toString())
    # A name that begins with an underscore is not read: the pass is there when it has its own.
    if store.exists(target) or not store.rename(draft, target):
        store.delete(draft, True)
        raise FileExistsError(f"pass {number} is in {passes} already")
    return number


class _Watcher(StatefulProcessor):
    """What a path was when it was last seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _SEEN)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        if key[0] is None:
            return
        for r in sorted(rows, key=lambda r: (r["pass"], r["size"], r["mtime_s"])):
            old = self.seen.get() if self.seen.exists() else None
            if old is not None:
                if old[2] >= r["pass"]:
                    continue
                self.handle.deleteTimer(_end_of(old[2]))
                if r["pass"] > old[2] + 1:  # passes have consecutive numbers: it was gone in between
                    yield Row(path=key[0], event="deleted", size=old[0], mtime_s=old[1], **{"pass": old[2] + 1})
                    old = None
            if old is None or (old[0], old[1]) != (r["size"], r["mtime_s"]):
                yield Row(path=key[0], event="new" if old is None else "changed", size=r["size"], mtime_s=r["mtime_s"], **{"pass": r["pass"]})
            self.seen.update((r["size"], r["mtime_s"], r["pass"]))
            self.handle.registerTimer(_end_of(r["pass"]))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        size, mtime_s, last = self.seen.get()
        self.seen.clear()
        yield Row(path=key[0], event="deleted", size=size, mtime_s=mtime_s, **{"pass": last + 1})

    def close(self) -> None:
        pass


def _end_of(number: int) -> int:
    """Milliseconds: after the time of a pass, before that of the next one."""
    return number * 1000 + 1


def events(spark: SparkSession, passes: str) -> DataFrame:
    """A stream of path, event (new, changed, deleted), size, mtime_s, pass over the folder ``passes``.

    ``pass`` is that in which an event showed; a deletion comes once a pass without the path has been read. Events do not depend on how many passes
    are read at once, but a pass must be read whole: no limit of files is set. The session's state store must be the one in ``PROVIDER``. A change is
    another size or time. Of several rows of one path in a pass the first in the order of size and time counts.
    """
    rows = spark.readStream.schema(PASS).parquet(f"{passes.rstrip('/')}/pass-*")
    timed = rows.withColumn("at", F.timestamp_seconds("pass")).withWatermark("at", "0 seconds")
    return timed.groupBy("path").transformWithState(_Watcher(), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")
