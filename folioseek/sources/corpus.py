"""A text table as a corpus of documents and paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import dense_index, stored

#: Ranks that are broadcast at most: 16 MB.
BROADCAST_KEYS = 1_000_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_name(doc_id):
    """A made-up file name with a date; every 7th has none and every 11th an impossible one."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    month = F.when(doc_id % 11 == 0, F.lit(13)).otherwise(F.floor(doc_id / 28) % 12 + 1)
    date = F.concat(two(doc_id % 28 + 1), F.lit("."), two(month), F.lit("."), (doc_id % 10 + 2015).cast("string"))
    return F.concat(F.lit("order_"), doc_id.cast("string"), F.when(doc_id % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("_"), date)), F.lit(".docx"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, doc_index, file_name, text; doc_index is the rank of doc_id.

    Ranks are broadcast where they are counted to be few, so that texts stay where they are; beyond that the join shuffles them, once. A stored index
    (``operators.segments``) gives its documents their numbers when they come and joins no texts.
    """
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    keys = stored(dense_index(docs.select("doc_id"), [F.col("doc_id")], "doc_index"), "keys")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return docs.join(keys, "doc_id").withColumn("file_name", file_name(F.col("doc_id")))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_index, file_name, text -> a row for each non-blank line, numbered from 0."""
    lines = F.filter(F.transform(F.split("text", "\n"), T.unicode_trim), lambda x: x != "")
    return docs.select("doc_index", "file_name", F.posexplode(lines).alias("position", "text")).withColumn("position", F.col("position").cast("long"))
