"""Mixing sources to target weights by capped water-filling [DataFrame functions only].

Sources are filled in proportion to their weights until one reaches ``max_epochs`` times its size; it is
clamped there and the excess is dealt to the others by weight, until no target is above its cap. The whole
repetitions of a source are its documents ``floor(target / size)`` times; the fractional one takes documents
in the order of a seeded hash until the words are reached, and the document on the border gives a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns, unused, with_rank, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
BINS = 4096
#: Rows of a plan that are broadcast at most.
BROADCAST_ROWS = 100_000


def n_words(text: Column) -> Column:
    """Words of a text; 0 for a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> + target: weights repeat over the sources by code point, null last.

    Each round is one aggregate over the sources; it ends when no open source is above its cap, after as many
    rounds as there are sources at most. Sources without words get 0.
    """
    order = [F.col("source").isNull().asc(), F.col("source").asc()]
    ranked = with_rank(sizes, order, "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    state = written(
        ranked.select(
            "source", "source_size", weight.cast("double").alias("_w"),
            (F.col("source_size") * max_epochs).cast("double").alias("_cap"),
        ),
        "weights",
    )
    total = float(state.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0  # words for each unit of weight; it only rises from round to round
    while True:
        full = F.col("_cap") <= F.col("_w") * level
        row = state.agg(
            F.sum(F.when(full, F.col("_cap")).otherwise(0.0)).alias("clamped"),
            F.sum(F.when(full, 0.0).otherwise(F.col("_w"))).alias("open"),
        ).first()
        if not row["open"]:
            break
        reached = (total - row["clamped"]) / row["open"]
        if reached <= level * (1 + 1e-12):
            break
        level = reached
    target = F.least(F.col("_cap"), F.col("_w") * F.lit(level))
    return state.select("source", "source_size", target.alias("target"))


def _hash(doc_id: Column, seed: str) -> Column:
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")


def _bin(h: Column) -> Column:
    return F.pmod(h, F.lit(BINS))


def _planned(slim: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(source, size, _h) -> a row for each source and bin: which repetitions of it the mix takes. BINS rows a source at most.

    ``_whole`` times all of the bin; once more what lies before ``_rest`` words of the source, of which ``_before`` are in
    earlier bins. ``_border``: the fractional repetition ends inside the bin.
    """
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, weights, max_epochs), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.select(
        "source", "source_size", "target", F.floor(ratio).alias("_whole"),
        (F.round("target") - F.floor(ratio) * F.col("source_size")).cast("long").alias("_rest"),
    )
    bins = slim.groupBy("source", _bin(F.col("_h")).alias("_bin")).agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_words").over(upto), F.lit(0)))
    plan = bins.join(targets, bins["source"].eqNullSafe(targets["source"])).select(
        bins["source"], "_bin", "_before", "source_size", "target", "_whole", "_rest",
        (F.col("_before") + F.col("_words") <= F.col("_rest")).alias("_inside"),
        ((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_words") > F.col("_rest"))).alias("_border"),
    )
    return written(plan, "bins")


def _with_plan(rows: DataFrame, source: str, bin_: str, plan: DataFrame) -> DataFrame:
    """Join by source and bin; the plan is broadcast if it is counted to be small."""
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    return rows.join(plan, F.col(source).eqNullSafe(plan["source"]) & (F.col(bin_) == plan["_bin"]))


def _at_border(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of border bins with their plan and ``taken``."""
    rows = slim.select("doc_id", F.col("source").alias("_s"), "size", "_h", _bin(F.col("_h")).alias("_b"))
    rows = _with_plan(rows, "_s", "_b", plan.where("_border"))
    run = Window.partitionBy("source").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before") - F.coalesce(F.sum("size").over(run), F.lit(0))))
    return rows.withColumn("taken", F.col("_whole") * F.col("size") + part)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size -> doc_id, source, size, source_size, target, taken for every row.

    ``taken`` is the number of the document's words in the mix, repeats counted. Nulls: a null source is a
    source of its own; a null doc_id is an ordinary value. Rows with equal ids get equal hashes and are
    ordered by size, then taken as they come: equal rows are interchangeable. A document of any length counts with its
    size. An empty table gives no rows. Other columns are not read.
    """
    slim = written(docs.select("doc_id", "source", "size", _hash(F.col("doc_id"), seed).alias("_h")), "sizes")
    plan = _planned(slim, weights, max_epochs)
    out = ["doc_id", "source", "size", "source_size", "target", "taken"]
    rows = slim.select("doc_id", F.col("source").alias("_s"), "size", _bin(F.col("_h")).alias("_b"))
    times = F.col("_whole") + F.col("_inside").cast("long")
    plain = _with_plan(rows, "_s", "_b", plan.where("not _border")).withColumn("taken", times * F.col("size"))
    return plain.select(out).unionByName(_at_border(slim, plan).select(out))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``: each row as often as the mix repeats it.

    A document of which the mix takes a part (one a source at most) is given whole if the part is half or
    more of it. Documents without words take no room and stay. Rows that are equal in doc_id, source and
    size share one count. Columns of any name are passed on. The repetitions follow from a document's source and bin alone, so that
    texts are not shuffled; only those of the bin on the border, one a source, are joined with their counts.
    """
    names = docs.columns
    source, bin_, size, times = (unused(names, n) for n in ("_mix_source", "_mix_bin", "_mix_size", "_mix_times"))
    h = _hash(F.col("doc_id"), seed)
    slim = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), h.alias("_h")), "sizes")
    plan = _planned(slim, weights, max_epochs)
    tagged = docs.withColumns({source: F.col("source"), bin_: _bin(h)})

    def keys(which: str) -> DataFrame:
        """The plan's rows of one kind under names that ``docs`` does not have."""
        mine = plan.where(which).select("source", "_bin", (F.col("_whole") + F.col("_inside").cast("long")).alias(times))
        return mine.withColumnsRenamed({"source": unused([*names, source], "_plan_source"), "_bin": unused([*names, bin_], "_plan_bin")})

    def joined(plan: DataFrame) -> DataFrame:
        s, b, _ = plan.columns
        plan = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
        return tagged.join(plan, F.col(source).eqNullSafe(plan[s]) & (F.col(bin_) == plan[b]))

    some = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    plain = joined(keys("not _border")).withColumn(times, F.when(some, F.col(times)).otherwise(F.lit(1)))
    border = joined(keys("_border")).drop(times).withColumn(size, n_words(F.col("text")))
    share = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("long")
    counts = _at_border(slim, plan).groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n")).agg(F.max(share).alias(times))
    counts = counts.withColumnsRenamed({c: unused([*names, source, bin_, size, times], f"_count{c}") for c in ("_d", "_s", "_n")})
    d, s, n, _ = counts.columns
    border = border.join(counts, F.col("doc_id").eqNullSafe(counts[d]) & F.col(source).eqNullSafe(counts[s]) & (F.col(size) == counts[n]))
    rows = plain.select(*columns(names), times).unionByName(border.select(*columns(names), times)).where(F.col(times) > 0)
    again = unused(names, "_mix_again")
    return rows.withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*columns(names))
