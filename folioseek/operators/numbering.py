"""Automatic list numbers and blank-line counts of word-processor paragraphs, as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LEVELS = 4
# Paragraphs that begin so are dropped; style names of the four levels.
BOILERPLATE = ("ПОГОДЖЕНО", "Документ підготовлено")
STYLES = {f"{name}{n}": n for name in ("OiiSList", "Oii_S_List_") for n in range(1, LEVELS + 1)}
_DOC = ["doc"]


def classified(raw: DataFrame) -> DataFrame:
    """doc, seq, text, style, ilvl, num_id -> + level: of a list item, else null. The first rule that fits counts."""
    text = F.col("text")
    whole = F.col("ilvl").rlike(r"^\+?[0-9]{1,18}$")
    listed = F.when(F.col("num_id").isNotNull() & whole, F.col("ilvl").cast("long") + 1)
    style = F.coalesce(*[F.when(F.col("style") == k, F.lit(v)) for k, v in STYLES.items()])
    quoted = text.rlike(r"^(?U)\s*«\s*\d+(\.\d+)*\.\s+")
    level = (
        F.when(text.rlike(r"^(?U)\s*Підстава:"), F.lit(None))
        .when(text.rlike(r"^(?U)\s*\d+(\.\d+)*\.\s+"), F.lit(None))
        .when(quoted, listed)
        .otherwise(F.coalesce(listed, style))
    )
    return raw.withColumn("level", level.cast("long"))


def numbered(lines: DataFrame) -> DataFrame:
    """doc, seq, level -> + number such as ``1.2. ``: empty below the fourth level, null for no list item.

    The counter of a level is the number of its items since the last item of a higher level: their number up to here less that up to there. All
    windows have one order, so that lines are sorted once.
    """
    to_here = Window.partitionBy(*_DOC).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    level, levels = F.coalesce("level", F.lit(LEVELS + 1)), range(1, LEVELS + 1)
    lines = lines.withColumns({f"_t{n}": F.sum((level == n).cast("int")).over(to_here) for n in levels})
    before = {n: F.max(F.when(level < n, F.col(f"_t{n}"))).over(to_here) for n in levels}
    lines = lines.withColumns({f"_c{n}": F.col(f"_t{n}") - F.coalesce(before[n], F.lit(0)) for n in levels})
    counters = F.slice(F.array(*[F.col(f"_c{n}").cast("string") for n in levels]), 1, F.col("level").cast("int"))
    number = F.when(F.col("level").isNull(), None).when(F.col("level") > LEVELS, "").otherwise(F.concat(F.array_join(counters, "."), F.lit(". ")))
    return lines.withColumn("number", number).drop(*[f"_{x}{n}" for x in "tc" for n in levels])


def kept_with_breaks(raw: DataFrame) -> DataFrame:
    """doc, seq, text -> the paragraphs that stay, trimmed, with breaks: blank ones between each and the next.

    Blank ones before the first count for the first as well; those at the end are lost. Boilerplate is dropped, and
    the blank ones around it add up.
    """
    raw = raw.withColumn("text", T.unicode_trim(F.col("text")))
    order = Window.partitionBy(*_DOC).orderBy("seq")
    blanks = F.sum((F.col("text") == "").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    drop = F.startswith("text", F.lit(BOILERPLATE[0])) | F.startswith("text", F.lit(BOILERPLATE[1]))
    kept = raw.withColumn("_b", blanks).where((F.col("text") != "") & ~drop)
    so_far = F.when(F.row_number().over(order) == 1, 0).otherwise(F.col("_b"))
    return kept.withColumn("breaks", F.coalesce(F.lead("_b").over(order) - so_far, F.lit(0)).cast("long")).drop("_b")


def sections(lines: DataFrame) -> DataFrame:
    """doc, seq, text, number, breaks -> doc, position, text, line_breaks_after.

    A list item begins a section, its number in front; what stands before the first is one section. Every line of a
    paragraph is one of its own; only the last line of a section keeps its breaks.
    """
    to_here = Window.partitionBy(*_DOC).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_s", F.sum(F.col("number").isNotNull().cast("int")).over(to_here))
    whole = F.concat(F.coalesce("number", F.lit("")), F.col("text"))
    rows = lines.select(*_DOC, "seq", "_s", "breaks", F.posexplode(F.split(whole, "\n")).alias("_i", "text"))
    rows = rows.withColumn("text", T.unicode_trim(F.col("text"))).where("text <> ''")
    order = Window.partitionBy(*_DOC).orderBy("seq", "_i")
    last = F.lead("_s").over(order).isNull() | (F.lead("_s").over(order) != F.col("_s"))
    return rows.select(
        *_DOC, (F.row_number().over(order) - 1).cast("long").alias("position"), "text", F.when(last, F.col("breaks")).otherwise(0).cast("long").alias("line_breaks_after")
    )
