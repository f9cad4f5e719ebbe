"""Language identification by bit-sliced Bloom filters of n-grams.

One array of slots holds the filters of all languages. A language has a filter for each of ``LEVELS`` rates: the first holds all
n-grams of its sample, each further one those that are so much more frequent. The conjunction of an n-gram's slots is the mask
of all languages and levels that contain it, and a popcount of a language's bits says how common the n-gram is in it, in
steps of its logarithm. These counts are added up by language over a text, corrected for the filters' rates of false positives,
and the largest decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, columns, in_small_batches, mix64, release_memory, unused, utf8, written

NGRAMS = (3, 4)
PROBES = 3
#: Labelled documents of each language that are learned from (those with the least hash of doc_id), at most.
SAMPLE = 1000
#: Languages that are learned at most, those with most documents: the filters and their sums hold a bit and a row for each.
MOST_LANGUAGES = 4096
#: Least rates of the n-grams in a language's filters, of which each n-gram is in all up to its own.
RATES = (0.0, *(2.0**-e for e in (20, 18, 16, 14, 12, 10, 8)))
LEVELS = len(RATES)
BLOCK = 1 << 19
UNKNOWN = "und"

_CODE = np.full(256, 32, np.uint8)
_CODE[97:123] = _CODE[65:91] = np.arange(97, 123)
_CODE[128:] = np.arange(128, 256)


def ngram_keys(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: (key at each place, which are n-grams, first place of each text).

    ASCII capitals are lowered and what is no letter is a blank; a text stands between blanks, and n-grams with two
    blanks side by side don't count, so that none reaches into another text.
    """
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    codes = np.full(len(data) + 2 * n + max(NGRAMS), 32, np.uint8)
    codes[np.arange(len(data)) + 2 * doc + 1] = _CODE[data]
    first = offsets[:-1] + 2 * np.arange(n)
    blank = codes == 32
    pair = blank[:-1] & blank[1:]
    size = len(data) + 2 * n
    for k in NGRAMS:
        key, bad = np.full(size, k, np.uint64), np.zeros(size, bool)
        for j in range(k):
            key = key << np.uint64(8) | codes[j : j + size]
            if j < k - 1:
                bad |= pair[j : j + size]
        yield key, ~bad, first


@dataclass
class Filters:
    """Bit ``LEVELS * i + k`` of a slot (in word ``i // per_word``) belongs to level ``k`` of language ``i``."""

    languages: list[str]
    slots: np.ndarray  # (words, slots)
    false_rate: np.ndarray  # of each language: bits that an n-gram without it has by chance, of LEVELS

    @staticmethod
    def shape(n_languages: int, most: int) -> tuple[int, int, int]:
        """(languages in a word, words, slots): at most a fourth of a filter's bits is set, whatever the number of n-grams."""
        per_word = next(n for n in (1, 2, 4, 8) if n_languages <= n or n == 8)
        return per_word, max(1, -(-n_languages // per_word)), 1 << max(10, int(np.ceil(np.log2(PROBES * max(most, 1) / 0.25))))

    @staticmethod
    def bits(number: np.ndarray, level: np.ndarray, per_word: int) -> np.ndarray:
        """The bits of the first ``level`` filters of a language in its word."""
        return (np.uint64(1) << level.astype(np.uint64)) - np.uint64(1) << np.uint64(LEVELS) * (number % per_word).astype(np.uint64)

    @staticmethod
    def places(keys: np.ndarray, m: int) -> list[np.ndarray]:
        h = mix64(keys)
        return [(h >> np.uint64(21 * i)) & np.uint64(m - 1) for i in range(PROBES)]

    @staticmethod
    def build(languages: list[str], most: int, word: np.ndarray, slot: np.ndarray, mask: np.ndarray) -> Filters:
        """From rows (word, slot, mask); masks of one slot are united."""
        per_word, words, m = Filters.shape(len(languages), most)
        slots = np.zeros((words, m), f"u{per_word * LEVELS // 8}")
        np.bitwise_or.at(slots, (word, slot), mask.astype(slots.dtype))
        rate = np.zeros(len(languages))
        for i in range(len(languages)):
            own = slots[i // per_word] >> slots.dtype.type(LEVELS * (i % per_word))
            rate[i] = sum(float((own >> slots.dtype.type(k) & slots.dtype.type(1)).mean()) ** PROBES for k in range(LEVELS))
        return Filters(languages, slots, rate)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, their levels summed by language and corrected for false positives)."""
        n, kind = len(offsets) - 1, self.slots.dtype.type
        per_word, low = self.slots.itemsize * 8 // LEVELS, kind((1 << LEVELS) - 1)
        total, hits = np.zeros(n), np.zeros((n, len(self.languages)))
        for keys, real, first in ngram_keys(data, offsets):
            total += np.add.reduceat(real, first, dtype=np.int64)
            places = self.places(keys, self.slots.shape[1])
            for w, row in enumerate(self.slots):
                mask = row[places[0]]
                for at in places[1:]:
                    mask &= row[at]
                mask[~real] = 0
                for i in range(min(per_word, len(self.languages) - w * per_word)):
                    own = np.bitwise_count(mask >> kind(LEVELS * i) & low)
                    hits[:, w * per_word + i] += np.add.reduceat(own, first, dtype=np.int64)
        rate = self.false_rate
        return total, np.maximum(0, (hits - total[:, None] * rate) * LEVELS / (LEVELS - rate))

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language's number, the mean level of the text's n-grams in it, as a share of LEVELS)."""
        total, found = self.counts(data, offsets)
        best = found.argmax(axis=1)
        return best, np.minimum(1.0, found[np.arange(len(best)), best] / np.maximum(LEVELS * total, 1))


def is_held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _sampled(usable: DataFrame, sample: int) -> DataFrame:
    """lang, text of at most ``sample`` documents a language, those with the least hash of their id, of the ``MOST_LANGUAGES`` with most documents.

    Rows that can't be among them by far are left out before the rows of a language are ranked, so that no task ranks many more
    than ``sample`` of one. Of the rows of one id one text is read.
    """
    slim = usable.where("doc_id is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"))
    sizes = F.broadcast(slim.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "lang").limit(MOST_LANGUAGES))
    share = F.col("_h") / F.lit(2.0**64) + 0.5
    slim = slim.join(sizes, "lang").where(share * F.col("_n") <= sample + 6 * math.sqrt(sample)).select("doc_id", "lang", "_h").distinct()
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    chosen = slim.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample).select("doc_id", "lang")
    texts = usable.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")  # ``sample`` rows a language
    return texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters from doc_id, text, lang (none null in use): all n-grams of at most ``sample`` documents a language."""
    texts = _sampled(labelled.where("lang is not null and text is not null"), sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                data, offsets = utf8(batch.column(1).filter(pa.array(langs == lang)))
                for i, j in blocks(offsets, BLOCK):
                    part = offsets[i : j + 1]
                    keys = [k[real] for k, real, _ in ngram_keys(data[part[0] : part[-1]], part - part[0])]
                    keys, n = np.unique(np.concatenate(keys), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
        batch = data = part = keys = n = None
        release_memory()

    grams = in_small_batches(texts).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = written(grams, "grams")
    sums = grams.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).orderBy("lang").collect()  # a row for each language
    languages, most = [r["lang"] for r in sums], max((r["kinds"] for r in sums), default=0)
    per_word, _, m = Filters.shape(len(languages), most)
    named = labelled.sparkSession.createDataFrame([(r["lang"], i, r["total"]) for i, r in enumerate(sums)], "lang string, number int, total long")
    rate = F.col("n") / F.col("total")
    level = sum(((rate >= r).cast("int") for r in RATES), F.lit(0))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, keys, levels = (c.to_numpy() for c in batch.columns)
            mask, word = Filters.bits(number, levels, per_word).view(np.int64), (number // per_word).astype(np.int32)
            for at in Filters.places(keys.view(np.uint64), m):
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(at.astype(np.int64)), pa.array(mask)], ["word", "slot", "mask"])

    made = grams.join(F.broadcast(named), "lang").select("number", "gram", level.alias("level")).mapInArrow(slots, "word int, slot long, mask long")
    got = made.groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()  # as many rows as slots, which follow the sample
    return Filters.build(languages, most, got["word"].to_numpy(), got["slot"].to_numpy(), got["mask"].to_numpy().view(np.uint64))


def predict(docs: DataFrame, filters: Filters, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns of ``docs`` (with text) + ``lang``, ``score``; ``und`` and 0 if a text is null or without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # the n-grams of a bounded sample bound its size
    names = docs.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        languages = np.array(model.languages or [UNKNOWN], object)
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            for i, j in blocks(offsets, BLOCK):
                part, rows = offsets[i : j + 1], batch.slice(i, j - i)
                best, share = np.zeros(j - i, int), np.zeros(j - i)
                if model.languages:
                    best, share = model.decide(data[part[0] : part[-1]], part - part[0])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(list(languages[best]), pa.string()), pa.array(share)], [*batch.schema.names, lang, score])
        batch = data = rows = part = None
        release_memory()

    # Python gets plain names, as it takes a dot in one for a field.
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = T.StructType([*plain.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    found = in_small_batches(plain).mapInArrow(run, schema)
    known = F.coalesce(F.col(f"c{text}").rlike(r"\p{L}"), F.lit(False)) & (F.col(lang) != UNKNOWN)
    return found.select(
        *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)],
        F.when(known, F.col(lang)).otherwise(UNKNOWN).alias(lang), F.when(known, F.col(score)).otherwise(0.0).alias(score),
    )


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, lang -> doc_id, held_out, lang_pred, score for every row.

    Learns from labelled rows that are not held out and predicts from the text alone, all of it however long. Rows with a null doc_id are not
    held out, and not learned from. Without labelled rows every prediction is ``und``. Ties go to the first language by name. Repeated rows are
    predicted alike. An empty table gives no rows; other columns are not read.
    """
    held = is_held_out(F.col("doc_id"))
    filters = learn(docs.select("doc_id", "text", "lang").where(~held), sample)
    return predict(docs.select("doc_id", "text"), filters).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.2, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with ``least_score`` or more.

    The score is the mean level of a text's n-grams in its language, about 0.7 for prose and below 0.1 for random letters, whatever the number of
    languages. Texts that are null or without letters go. Learns from the labelled rows of ``docs`` that are not held out. Columns of any name are
    passed on.
    """
    filters = learn(docs.select("doc_id", "text", "lang").where(~is_held_out(F.col("doc_id"))), sample)
    lang, score = unused(docs.columns, "_lang_pred"), unused(docs.columns, "_lang_score")
    found = predict(docs, filters, lang, score)
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least_score)).select(*columns(docs.columns))
