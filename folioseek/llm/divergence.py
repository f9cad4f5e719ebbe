"""Source divergence audit: how far the word use of each source is from that of the others of its language.

A document's terms are exploded twice, all of them and the different ones, so that one partial aggregate in the task that read it counts both
occurrences and documents before anything is shuffled. Each kept term then becomes one wide row: an array over the sources of its language, in their order,
of smoothed integer shares. Higher-order functions of the JVM emit the contributions of a term to each pair of sources, and partial
aggregates add them up by (language, pair) in the tasks that made them. All arithmetic is on integers.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Runs of ASCII letters and of everything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
ADDED = 2
TOP_TERMS = 10
#: (language, source) groups up to which their totals are broadcast; beyond that they are joined under salts.
BROADCAST_GROUPS = 100_000
SALTS = 64


#: All but ASCII and some ranges beyond it that lower() leaves as they are (Latin and Cyrillic small letters, punctuation, Chinese
#: and Japanese). Texts without such a character need no table of letters.
MAY_CHANGE = r"[^\x00-\xBF\xD7\xDF-\xFF\u0430-\u045F\u2000-\u206F\u3000-\u9FFF]"


def terms(text: Column) -> Column:
    """The terms of a text in order, with A-Z (and no other letter) in lower case."""
    low = F.when(text.rlike(MAY_CHANGE), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))
    return F.regexp_extract_all(low, F.lit(TERM), F.lit(0))


def _whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / total), on decimals, as the product may be beyond a long."""
    product = F.lit(SCALE).cast("decimal(10,0)") * (count + F.lit(ADDED)).cast("decimal(20,0)")
    return _whole(product, total.cast("decimal(20,0)")) + F.lit(1).cast("long")


def _distance(p: Column, q: Column) -> Column:
    return _whole((p - q) * (p - q), p + q)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, text (no nulls) -> lang, source, term, n, df: occurrences, and documents that have the term."""
    found = docs.select("lang", "source", terms(F.col("text")).alias("all"))
    # Each text's terms, and then once more the different ones.
    both = found.select("lang", "source", F.posexplode(F.array("all", F.array_distinct("all"))).alias("once", "t"))
    rows = both.select("lang", "source", "once", F.explode("t").alias("term"))
    return rows.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("df"))


def wide_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, n, by_source (source -> n) of the terms in at least ``least`` documents of their language: a row for each, written."""
    by_source = F.map_from_entries(F.collect_list(F.struct("source", "n")))
    rows = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), by_source.alias("by_source"))
    return written(rows.where(F.col("df") >= least).drop("df"), "wide")


def _totals(docs: DataFrame, wide: DataFrame) -> DataFrame:
    """A row for each language: sources (array of (source, total) in the order of code points), all (the language's total); written.

    A total is the number of occurrences of kept terms, and ADDED for each kept term.
    """
    sums = wide.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = wide.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("all_n"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    added = zero("terms") * ADDED
    sources = F.sort_array(F.collect_list(F.struct("source", (zero("n") + added).alias("total"))))
    return written(groups.groupBy("lang").agg(sources.alias("sources"), F.max(zero("all_n") + added).alias("all")), "totals")


def _with_totals(wide: DataFrame, totals: DataFrame) -> DataFrame:
    """The wide rows with their language's totals, which are broadcast if they are counted to be small, else met under salts."""
    if (totals.agg(F.sum(F.size("sources"))).first()[0] or 0) <= BROADCAST_GROUPS:
        return wide.join(F.broadcast(totals), "lang")
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return wide.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, text -> lang, source, part, item, value, rank.

    Part ``pair``: for each (lang, source) group that occurs and each other source of the language (item) the distance of their term shares,
    0 where the language keeps no term. Part ``term``: the ``top`` kept terms (item) that set a group apart from its language: those it
    has, with a share above the language's. Ranks begin at 1, by value descending, ties by the item's bytes.

    A null lang, source or text is the empty string. A text of any length is counted whole; the task that reads it holds its terms. Equal
    rows count each. A language of one source has no pairs; an empty table gives no rows. Other columns are not read.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(blank("lang"), blank("source"), blank("text"))
    wide = wide_terms(term_counts(docs), least)
    totals = _totals(docs, wide)
    count = lambda s: F.coalesce(F.element_at("by_source", s["source"]), F.lit(0))
    shares = F.transform("sources", lambda s: _share(count(s), s["total"]))
    vectors = _with_totals(wide, totals).select("lang", "term", "n", "by_source", "sources", "all", shares.alias("p"))

    # Not exploded at once: a row for each source first, so that a term of many sources makes no array of all their pairs.
    firsts = vectors.select("lang", "p", F.posexplode_outer("p").alias("i", "p_i"))
    later = F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda q, k: F.struct((F.col("i") + 1 + k).alias("j"), _distance(F.col("p_i"), q).alias("f")))
    sums = firsts.select("lang", "i", F.explode(later).alias("x")).groupBy("lang", "i", F.col("x.j").alias("j")).agg(F.sum("x.f").alias("value"))
    named = totals.select("lang", F.posexplode("sources").alias("at", "s")).select("lang", "at", "s.source")
    mine, others = named, named.select("lang", F.col("at").alias("other"), F.col("source").alias("item"))
    pairs = mine.join(others, "lang").where("at <> other").withColumns({"i": F.least("at", "other"), "j": F.greatest("at", "other")})
    pairs = pairs.join(sums, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    has = F.transform("sources", lambda s, k: F.struct(s["source"].alias("source"), count(s).alias("n"), F.get("p", k).alias("p")))
    held = vectors.select("lang", "term", _share(F.col("n"), F.col("all")).alias("q"), F.explode(has).alias("h")).where("h.n > 0 and h.p > q")
    apart = held.select("lang", "h.source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance(F.col("h.p"), F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))).alias("rank")
    columns = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), rank]
    return pairs.select(columns).unionByName(apart.select(columns).where(F.col("rank") <= top))
