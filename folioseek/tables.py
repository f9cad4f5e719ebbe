"""Tables in the folder that all executors share, and dense ranks without a one-task window."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, from spark.checkpoint.dir; where that is unset, a temporary one in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` makes in the block, on this thread, are deleted at its end: for steps that end with a commit or a number."""
    before, _made.paths = getattr(_made, "paths", None), []
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _made.paths:
            found = jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(conf).delete(found, True)
        _made.paths = before


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back. It stays there, unless it is made inside of ``scratch``."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if getattr(_made, "paths", None) is not None:
        _made.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_index(keys: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``keys`` with their 0-based rank in ``order``, which must be total.

    Rows are range-partitioned and written with their partition; a partition's first rank is the number of rows before it,
    from one number for each partition.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(keys.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_row", inside).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")
