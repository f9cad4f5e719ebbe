"""File listings and the rules of which files count."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import stored

MAX_DEPTH = 10
# Folders that are never entered, files that are never documents.
EXCLUDED_FOLDERS = (".git", "ердр (не виключені)")
JUNK_NAMES, JUNK_EXTENSIONS = (".ds_store", "thumbs.db"), ("tmp", "db")
ARCHIVES = (".zip", ".xlsx", ".xls")
EXCLUDED_WORDS = ("ЕРДР", ".git")
MIME = {
    "pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp",
    "webp": "image/webp", "svg": "image/svg+xml",
}


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_of(path: Column) -> Column:
    """What follows the last dot of the name, in lower case; a name that only begins with a dot has none."""
    return F.regexp_extract(F.lower(name_of(path)), r"(?s)^.+\.([^.]*)$", 1)


def is_document(path: Column) -> Column:
    """Whether a file is a word-processor document and no lock, system or temporary file."""
    name = F.lower(name_of(path))
    junk = F.startswith(name, F.lit("~$")) | name.isin(*JUNK_NAMES) | extension_of(path).isin(*JUNK_EXTENSIONS)
    return ~junk & (extension_of(path) == "docx")


def in_excluded_folder(path: Column) -> Column:
    """Whether a folder of a relative path begins with an excluded name, in any case."""
    below = F.concat(F.lit("/"), F.replace(F.lower(path), F.lit("\\"), F.lit("/")))
    return F.contains(below, F.lit("/" + EXCLUDED_FOLDERS[0])) | F.contains(below, F.lit("/" + EXCLUDED_FOLDERS[1]))


def in_year_folder(path: Column) -> Column:
    """Whether a relative path lies in a folder whose name begins with four digits."""
    return path.rlike(r"^[0-9]{4}[^/]*/.")


def is_mirrored(path: Column, policy: str = "docx_only") -> Column:
    """Whether the mirror takes a relative path: documents alone, or all but archives and excluded words.

    Both look at the end of the path, so that a name of nothing but an ending counts; the ends of archives are told apart by case.
    """
    if policy == "docx_only":
        return in_year_folder(path) & F.endswith(F.lower(path), F.lit(".docx")) & ~F.startswith(name_of(path), F.lit("~$"))
    if policy != "all_but_archives":
        raise ValueError(f"no policy {policy!r}")
    archive = [F.endswith(path, F.lit(end)) for end in ARCHIVES]
    return in_year_folder(path) & ~(archive[0] | archive[1] | archive[2]) & ~F.contains(path, F.lit(EXCLUDED_WORDS[0])) & ~F.contains(path, F.lit(EXCLUDED_WORDS[1]))


def mime_type(path: Column) -> Column:
    kind = F.coalesce(*[F.when(extension_of(path) == k, F.lit(v)) for k, v in MIME.items()])
    return F.coalesce(kind, F.lit("application/octet-stream"))


def _local(uri: Column) -> Column:
    """A file's path without its scheme. The reader gives it as it is, not percent-encoded."""
    return F.regexp_replace(uri, "^file:/+", "/")


def is_local(folder: str) -> bool:
    """Whether a folder is on disks that driver and executors open alike."""
    return folder.startswith(("/", "file:/"))


def below(uri: Column, root: str) -> Column:
    """A file's path relative to ``root``."""
    return F.regexp_replace(F.substring(_local(uri), len(root.removeprefix("file://")) + 1, 1 << 30), "^/", "")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def listing(spark: SparkSession, folder: str, max_depth: int = MAX_DEPTH, missing_is_empty: bool = False) -> DataFrame:
    """uri, path (relative), name, size, mtime_s of all files below a folder, the contents not read.

    A folder that is not there is an error, so that a refresh does not take it for an emptied one, unless ``missing_is_empty``.
    """
    root = folder.rstrip("/")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType())])
    if missing_is_empty and not _exists(spark, root):
        found = spark.createDataFrame([], schema)
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(*schema.names)
    path = below(F.col("path"), root)
    rows = found.select(
        F.col("path").alias("uri"), path.alias("path"), name_of(path).alias("name"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime_s")
    )
    return rows.where(F.size(F.split("path", "/")) <= max_depth)


# ---- a walk that enters no excluded folder ----

#: Entries of a folder that are held at once.
LISTED = 10_000
_ENTRIES = "path string, is_folder boolean, size long, mtime_s long"


def _is_excluded(path: str) -> bool:
    inside = "/" + path.lower().replace("\\", "/")
    return any(f"/{x}" in inside for x in EXCLUDED_FOLDERS)


def _entries(root: str, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """What lies in a folder below ``root``: no links, no excluded folders."""
    with os.scandir(f"{root}/{folder}" if folder else root) as found:
        for e in found:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_symlink() or (is_folder := e.is_dir()) and _is_excluded(path):
                continue
            about = e.stat(follow_symlinks=False)
            yield path, is_folder, 0 if is_folder else about.st_size, int(about.st_mtime)


def documents_below(root: str, max_depth: int = MAX_DEPTH) -> Iterator[str]:
    """Relative paths of the documents below a folder, by one process."""
    open_folders = [""]
    while open_folders:
        for path, is_folder, _, _ in _entries(root, open_folders.pop()):
            if is_folder and path.count("/") + 2 <= max_depth:
                open_folders.append(path)
            elif not is_folder and _is_document(path.rpartition("/")[2]) and not _is_excluded(path):
                yield path


def _is_document(name: str) -> bool:
    """``is_document`` for one name."""
    low = name.lower()
    before, dot, extension = low.rpartition(".")
    return not low.startswith("~$") and low not in JUNK_NAMES and bool(before) and dot == "." and extension == "docx"


def walk(spark: SparkSession, folder: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """path (relative), name, size, mtime_s of all files below a folder, listed level by level in tasks.

    The folders of a level are dealt to tasks, and those found make up the next level, ``max_depth`` at most. Excluded folders and links are never entered, so
    that what lies there need not be readable; any other folder that can't be read is an error. The folder is one that
    driver and executors can open; others go through ``listing``.
    """
    root = folder.removeprefix("file://").rstrip("/")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parent in batch.column(0).to_pylist():
                found = _entries(root, parent)
                while rows := list(itertools.islice(found, LISTED)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], ["path", "is_folder", "size", "mtime_s"])

    level, found = spark.createDataFrame([("",)], "path string"), []
    for _ in range(max_depth):
        entries = stored(level.mapInArrow(run, _ENTRIES), "level")
        found.append(entries)
        level = entries.where("is_folder").select("path").repartition(parts)
        if level.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, found).where("not is_folder")
    return rows.where(~in_excluded_folder(F.col("path"))).select("path", name_of(F.col("path")).alias("name"), "size", "mtime_s")
