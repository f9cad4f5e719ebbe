"""Document fingerprints by one-permutation MinHash [DataFrame functions only].

Every five-word shingle is hashed once. Eight bits of the hash give its bin, 48 others its rank in the bin. An empty
bin takes the value of the first non-empty bin in a sequence of bins that depends on its number alone (optimal
densification): eight probes by a hash, then the least hash among the non-empty ones, which is the same
choice from a random order. Of each bin four bits of a hash of its value and its number are stored, so that bins
that share a donor agree by chance independently of one another. They are packed into sixteen longs, as hex.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS_IN_SHINGLE

BINS = 256
BITS = 4
PROBES = 8
BUCKET_ROWS = 1500
#: Buckets of as many rows as there are; as their first rows are broadcast, a larger table has larger buckets, not more.
MAX_BUCKETS = 1 << 18
#: Quantiles of the ids: an id that holds more rows than lie between two of them has buckets of its own.
QUANTILES = 256
SALTS = 1 << 20
_RANK = (1 << 48) - 1  # in a bin of its own: no shingle
_BLANKS = " \t\n\u000b\f\r"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shingles(text: Column) -> Column:
    words = F.split(F.btrim(F.lower(text), F.lit(_BLANKS)), r"[\x20\x09-\x0D]+")
    k = WORDS_IN_SHINGLE

    def of(codes: Column) -> Column:
        many = F.transform(F.slice(codes, 1, F.size(codes) - (k - 1)), lambda c, i: F.xxhash64(c, *[F.get(codes, i + j) for j in range(1, k)]))
        return F.when(F.size(codes) >= k, many).otherwise(F.array(F.xxhash64(F.size(codes), codes)))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _binned(shingles: Column) -> Column:
    """The least rank of each bin, in the order of the bins; ``_RANK`` for an empty one."""
    empty = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), 48).bitwiseOR(F.lit(_RANK)))
    placed = F.transform(shingles, lambda h: F.shiftleft(h.bitwiseAND(F.lit(BINS - 1)), 48).bitwiseOR(F.shiftrightunsigned(h, 16)))
    bin_of = lambda x: F.shiftright(x, 48)
    least = lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
    return F.transform(_let(F.sort_array(F.concat(placed, empty)), least), lambda x: x.bitwiseAND(F.lit(_RANK)))


def _densified(ranks: Column) -> Column:
    gone = lambda v: v == F.lit(_RANK)

    def probe(known: Column):
        def step(now: Column, t: Column) -> Column:
            other = lambda b: F.get(known, F.hash(b, t).bitwiseAND(F.lit(BINS - 1)))
            return F.when(F.exists(now, gone), F.transform(now, lambda v, b: F.when(gone(v), other(b)).otherwise(v))).otherwise(now)

        probed = F.aggregate(F.sequence(F.lit(1), F.lit(PROBES)), known, step)
        full = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: ~gone(F.get(known, b)))
        first = lambda bins, b: F.get(known, F.array_min(F.transform(bins, lambda o: F.struct(F.hash(o, b), o.alias("o"))))["o"])
        last = lambda now: F.when(F.exists(now, gone), _let(full, lambda bins: F.transform(now, lambda v, b: F.when(gone(v), first(bins, b)).otherwise(v)))).otherwise(now)
        return _let(probed, last)

    return _let(ranks, probe)


def packed(text: Column) -> Column:
    """array<long> of BINS * BITS bits; empty for a text without words, null for a null one."""
    per = 64 // BITS
    low = lambda v: v.bitwiseAND(F.lit((1 << BITS) - 1))
    own = lambda ranks: F.transform(ranks, lambda v, b: F.xxhash64(v, b))
    pack = lambda ranks: F.transform(
        F.sequence(F.lit(1), F.lit(BINS), F.lit(per)),
        lambda at: F.aggregate(F.slice(ranks, at, per), F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(low(v))),
    )
    made = _let(own(_densified(_binned(_shingles(text)))), pack)
    return F.when(F.length(F.btrim(text, F.lit(_BLANKS))) > 0, made).when(text.isNotNull(), F.array().cast("array<bigint>"))


def as_hex(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints.

    Bins agree by chance once in 2**BITS; the share of agreeing bins is corrected for that and held in 0 to 1. Two
    empty fingerprints are alike (1), an empty and another are not (0).
    """
    ones = int("1" * (64 // BITS), 16)

    def differ(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseAND(F.lit(ones)))

    n = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda acc, x: acc + x)
    chance = 1 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), ((1 - n / F.lit(float(BINS))) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(estimate)


def _buckets(docs: DataFrame) -> Column:
    """A number for each row of ``docs`` (with _salt, a hash of its text below SALTS) that rises with (doc_id, _salt), nulls first.

    Ranges lie between quantiles of the ids and are cut into equal parts of ids. An id that is a quantile more than once has
    a range of its own, and so have null ids; these are cut into parts of the salt.
    """
    count, nulls, cuts = docs.agg(
        F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 10000)
    ).first()
    often = Counter(x for x in cuts or [] if x is not None)
    heavy = {c: n for c, n in often.items() if n > 1}
    bounds = sorted({*often, *(c + 1 for c in heavy)}) or [0]
    of = lambda rows: int(max(1, min(rows // BUCKET_ROWS, MAX_BUCKETS * rows // max(count, 1))))
    parts = [of(heavy.get(c, 1) * count / QUANTILES) for c in bounds]
    width = max([*parts, of(nulls)]) + 1
    known = F.array(*[F.lit(c).cast("long") for c in bounds])
    at = F.greatest(F.size(F.filter(known, lambda c: c <= F.col("doc_id"))), F.lit(1))
    low, high = F.element_at(known, at), F.coalesce(F.get(known, at), F.lit(bounds[-1] + 1).cast("long"))
    n = F.element_at(F.array(*map(F.lit, parts)), at)
    by_salt = F.col("_salt") / SALTS
    salted = F.element_at(F.array(*[F.lit(c in heavy) for c in bounds]), at)
    share = F.when(salted, by_salt).otherwise((F.col("doc_id") - low).cast("double") / (high - low))
    inside = F.greatest(F.lit(0), F.least(F.floor(share * n).cast("int"), n - 1))
    return F.when(F.col("doc_id").isNull(), F.floor(by_salt * of(nulls)).cast("int")).otherwise(at * width + inside)


def with_next(docs: DataFrame, values: list[str]) -> DataFrame:
    """Add ``next_<value>``: the value of the row with the next smaller doc_id; of the largest after the smallest.

    Null ids come last, equal ids in the order of a hash of their texts. Rows are dealt into buckets of ids, so that a window covers one of
    them; the first row of each bucket is also sent to the bucket before it. Rows alike in id and text share a bucket.
    """
    names = docs.columns
    docs = docs.withColumn("_salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)))
    docs = docs.withColumn("_bucket", _buckets(docs))
    down = Window.orderBy(F.desc("_bucket"))
    key = F.struct("doc_id", "_salt", F.length("text"))
    ranges = docs.groupBy("_bucket").agg(F.max(key).alias("_head"))  # three times MAX_BUCKETS at most, and one a range
    heads = ranges.select(
        F.col("_bucket"), "_head",
        F.lag("_bucket").over(down).alias("_before"),
        F.when(F.row_number().over(down) == 1, F.min("_bucket").over(Window.partitionBy())).alias("_wrap"),
    )
    own = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("role"))
    d = docs.join(F.broadcast(heads), "_bucket")
    is_head = key.eqNullSafe(F.col("_head"))
    sent = F.filter(
        F.array(
            own,
            F.when(is_head & F.col("_before").isNotNull(), F.struct(F.col("_before").alias("b"), F.lit(1).alias("role"))),
            F.when(is_head & F.col("_wrap").isNotNull(), F.struct(F.col("_wrap").alias("b"), F.lit(2).alias("role"))),
        ),
        lambda x: x.isNotNull(),
    )
    dealt = d.withColumn("_to", F.explode(sent)).select(*names, "_salt", F.col("_to.b").alias("_b"), F.col("_to.role").alias("_role"))
    order = Window.partitionBy("_b").orderBy("_role", F.col("doc_id").desc_nulls_last(), F.desc("_salt"), F.length("text").desc(), "text")
    leads = {f"next_{v}": F.lead(v).over(order) for v in values}
    return dealt.withColumns(leads).where("_role = 0").select(*names, *leads)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text -> fingerprints of each whole text and of its edited one, and their likeness.

    The edited text has its last third (floor of the code points) replaced by the first as many code points
    of the next document in descending doc_id. A null text is empty; an empty or blank one has an empty
    fingerprint. A text of one to four words has one shingle. Equal texts have equal fingerprints. A single
    row is its own next. Texts of any length are taken whole, as one row of one task. Of equal doc_ids the one whose text has
    the larger hash is before the others, null ones come last. An empty table gives no rows; other columns are not read.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(d.withColumn("fp", packed(F.col("text"))), ["text", "fp"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    d = d.withColumn("edited_fp", packed(F.col("edited")))
    return d.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
