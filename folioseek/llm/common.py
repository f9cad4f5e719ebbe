"""Helpers that several operators share: shared-folder tables, ordering, text hashing."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import dense_index as with_rank  # noqa: F401
from ..tables import shared_folder  # noqa: F401
from ..tables import stored as written  # noqa: F401


#: White space that separates words, everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WORDS_IN_SHINGLE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(names: list[str]) -> list[Column]:
    """The columns of these names, whatever characters are in them."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def unused(names: list[str], name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from ``names`` in any case."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name = "_" + name
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Ids that are broadcast at most: 16 MB of longs.
BROADCAST_IDS = 1_000_000


def small_or_shuffled(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if it is counted to be small; else Spark joins it as it likes."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


#: Rows that Python gets at a time, and rows of a columnar read: long texts would fill tens of megabytes with the default numbers.
BATCH_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.parquet.columnarReaderBatchSize": ("4096", "1024")}


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df`` as it is, after its session's batches have been made small where they still have Spark's own numbers of rows."""
    conf = df.sparkSession.conf
    for key, (default, rows) in BATCH_ROWS.items():
        if conf.get(key, default) == default:
            conf.set(key, rows)
    return df


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker lives on for the tasks after this one."""
    if _pow["n"] > POWERS:
        _pow.clear()
        _pow["n"] = -1
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# ---- words and shingles of Arrow strings, hashed with numpy ----

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SHINGLE_BASE = np.uint64(0xD6E8FEB86659FD93)
_BYTE_CODES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Runs of whole documents, each of about ``size`` bytes, or one document if that is longer."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        out.append((first, last))
        first = last
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start of each word, its end, first word of each document and one past the last)."""
    low = _LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return low, none, none, np.zeros(len(offsets), np.int64)
    inside = ~_BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    left = np.r_[False, inside[:-1]] & ~cut[:-1]
    right = np.r_[inside[1:], False] & ~cut[1:]
    starts, ends = np.flatnonzero(inside & ~left), np.flatnonzero(inside & ~right) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Powers that are kept from task to task, two arrays of 8 MB; longer texts make longer ones for a while.
POWERS = 1 << 20
_pow = {"n": -1}


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: differences of prefix sums of a polynomial over coded bytes."""
    if len(low) > _pow["n"]:
        n = max(len(low), POWERS)
        _pow.update(n=n, up=_powers(n, _ODD), down=_powers(n, _ODD_INVERSE))
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[low] * _pow["up"][: len(low)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _pow["down"][starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each five-word shingle, offsets by document).

    A document of one to four words has one shingle, its whole sequence; one without words has none.
    """
    k, n_words = WORDS_IN_SHINGLE, np.diff(first)
    n = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    offsets = np.r_[0, np.cumsum(n)]
    doc = np.repeat(np.arange(len(n)), n)
    at = first[:-1][doc] + np.arange(offsets[-1]) - offsets[:-1][doc]
    left = first[1:][doc] - at
    padded = np.r_[hashes, np.zeros(k, np.uint64)]
    out, power = np.minimum(left, k).astype(np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            power = power * _SHINGLE_BASE
            out = out + np.where(left > j, padded[at + j], np.uint64(0)) * power
    return mix64(out), offsets
