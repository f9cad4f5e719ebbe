"""What surrounds a match: headings, section sign, follow-up, basis, and the full document with flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as T

LEVELS = 4


def _earlier() -> WindowSpec:
    return Window.partitionBy("doc_index").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)


def with_parents(lines: DataFrame) -> DataFrame:
    """doc_index, position, level (0: no heading) -> + parents: positions of the headings above, top one first.

    A heading of a level counts if no heading of its level or a higher one stands between, and it is above the line's
    own level. One window remembers the last heading of each level.
    """
    last = [F.last(F.when(F.col("level") == n, F.col("position")), ignorenulls=True).over(_earlier()) for n in range(1, LEVELS + 1)]
    own = F.when(F.col("level") > 0, F.col("level")).otherwise(LEVELS + 1)
    lines = lines.withColumns({f"_last{n}": x for n, x in enumerate(last, 1)})
    found = []
    for n in range(1, LEVELS + 1):
        higher = F.greatest(F.lit(-1), *[F.coalesce(F.col(f"_last{m}"), F.lit(-1)) for m in range(1, n)]) if n > 1 else F.lit(-1)
        found.append(F.when((F.col(f"_last{n}") > higher) & (own > n), F.col(f"_last{n}")))
    parents = F.filter(F.array(*found), lambda p: p.isNotNull())
    return lines.withColumn("parents", parents).drop(*[f"_last{n}" for n in range(1, LEVELS + 1)])


def with_section(lines: DataFrame) -> DataFrame:
    """doc_index, position, text -> + section: position of the nearest earlier paragraph with the section sign."""
    at = F.when(F.startswith("text", F.lit(T.SECTION)), F.col("position"))
    return lines.withColumn("section", F.last(at, ignorenulls=True).over(_earlier()))


def action_lines(lines: DataFrame, parents: str = "parent") -> DataFrame:
    """doc_index, position, text, parent (position or null) -> + action: the line after the parent, if it is one."""
    nxt = lines.select(F.col("doc_index").alias("_d"), (F.col("position") - 1).alias("_p"), F.col("text").alias("_t"))
    starts = [F.startswith(F.lower(T.unicode_trim(F.col("_t"))), F.lit(a)) for a in T.ACTIONS]
    nxt = nxt.where(starts[0] | starts[1])
    on = (F.col("doc_index") == F.col("_d")) & (F.col(parents) == F.col("_p")) & (F.col("_p") + 1 < F.col("position"))
    return lines.join(nxt, on, "left").withColumn("action", F.col("_t")).drop("_d", "_p", "_t")


def _in_stretches(lines: DataFrame, stop: Column) -> DataFrame:
    """+ _stop, and _stretch: how many stops there were up to a line, itself included. No stop lies between lines that share it."""
    to_here = Window.partitionBy("doc_index").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select("doc_index", "position", "text").withColumn("_stop", F.coalesce(stop, F.lit(False)))
    return rows.withColumn("_stretch", F.sum(F.col("_stop").cast("int")).over(to_here))


def _matched(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """The lines that are matches, as match_position."""
    return rows.join(matches.select("doc_index", "position").distinct(), ["doc_index", "position"], "left_semi").withColumnRenamed("position", "match_position")


def followup_personal(matches: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines after a match up to the next section sign, none from a rank or numbered line on; a match is one of the lines.

    A match is joined with the lines of its own stretch alone.
    """
    text = F.col("text")
    rows = _in_stretches(lines, F.startswith(text, F.lit(T.SECTION)) | T.ends_followup(text) | T.is_numbered(text))
    found = _matched(rows, matches).select("doc_index", "match_position", "_stretch").join(rows.where("not _stop"), ["doc_index", "_stretch"])
    return found.where("position > match_position").select("doc_index", "match_position", "position", "text")


def followup_ordinary(matches: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines after a match in its section, and its basis (``kind``); a match is one of the lines.

    The basis ends the search. A numbered line ends it if its first number is not the match's, and is not added itself; a match
    without a number has no end of section. Nothing is added from a line that begins with a rank on, but the basis is still
    looked for. Windows inside a document find the ends, and a match is joined with the lines of its own stretch alone.
    """
    text = F.col("text")
    up, down = (Window.partitionBy("doc_index").orderBy(x) for x in (F.col("position"), F.desc("position")))
    rows = _in_stretches(lines, T.is_basis(text) | T.ends_followup(text))
    rows = rows.withColumns({"_basis": T.is_basis(text), "_n": F.regexp_extract(T.unicode_trim(text), r"^([0-9]+)\.", 1)})
    nearest = F.last(F.when(F.col("_basis"), F.struct("position", "text")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    numbered = rows.where(F.col("_n") != "").select("doc_index", "position", "_n", F.lead("_n").over(up).alias("_n2"), F.lead("position").over(up).alias("_p2"))
    end = F.last(F.when(F.col("_n2") != F.col("_n"), F.col("_p2")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    ends = numbered.select("doc_index", F.col("position").alias("match_position"), end.alias("_end"))
    at = _matched(rows.withColumn("_nearest", nearest), matches).join(ends, ["doc_index", "match_position"], "left")
    at = at.select("doc_index", "match_position", "_stretch", "_nearest", "_end")
    inside = lambda p: F.coalesce(p < F.col("_end"), F.lit(True))
    told = at.join(rows.where("not _stop and _n = ''").select("doc_index", "_stretch", "position", "text"), ["doc_index", "_stretch"])
    told = told.where(F.col("position") > F.col("match_position")).where(inside(F.col("position")))
    basis = at.where(F.col("_nearest").isNotNull() & inside(F.col("_nearest.position")))
    return told.select("doc_index", "match_position", "position", "text", F.lit("followup").alias("kind")).unionByName(
        basis.select("doc_index", "match_position", "_nearest.position", "_nearest.text", F.lit("basis").alias("kind"))
    )


def outline(lines: DataFrame) -> DataFrame:
    """doc_index, file_name, position, text -> for each line, where the parts of an extract around it are: positions alone.

    is_personal; parents (positions of the headings above, top one first, or of the section sign in a personal file); action_at, basis_at;
    end_at: the numbered line that ends its section; stretch: how many stops there were up to it; tells: whether it can be a follow-up.
    All of it depends on the line's own document, so that it can be stored with the document and looked up. Windows inside a document find it.
    """
    up = Window.partitionBy("doc_index").orderBy("position")
    down = Window.partitionBy("doc_index").orderBy(F.desc("position"))
    before, after, to_here = (w.rowsBetween(Window.unboundedPreceding, k) for w, k in ((up, -1), (down, -1), (up, 0)))
    text, here = F.col("text"), F.col("position")
    name = F.coalesce("file_name", F.lit("")) if "file_name" in lines.columns else F.lit("")  # without a name no file is personal
    number = F.regexp_extract(text, r"^([0-9]+)\.", 1)
    rows = lines.select("doc_index", name.alias("file_name"), "position", T.unicode_trim(text).alias("text"))
    rows = rows.select(
        "doc_index", "position", T.is_personal(F.col("file_name")).alias("is_personal"), T.heading_level(text).alias("_level"), F.nullif(number, F.lit("")).alias("_number"),
        T.is_basis(text).alias("_basis"), T.ends_followup(text).alias("_rank"), F.startswith(text, F.lit(T.SECTION)).alias("_sign"),
        T.is_numbered(text).alias("_numbered"), T.is_action(text).alias("_action"),
    )
    rows = rows.withColumns({
        "_next_acts": F.lead("_action").over(up), "_earlier": F.last("_number", ignorenulls=True).over(before),
        "_stop": F.when(F.col("is_personal"), F.col("_sign") | F.col("_rank") | F.col("_numbered")).otherwise(F.col("_basis") | F.col("_rank")),
    })
    it = F.struct("position", "_next_acts")
    rows = rows.withColumns(
        {f"_last{n}": F.last(F.when(F.col("_level") == n, it), ignorenulls=True).over(before) for n in range(1, LEVELS + 1)}
        | {
            "_section": F.last(F.when(F.col("_sign"), it), ignorenulls=True).over(before), "stretch": F.sum(F.col("_stop").cast("int")).over(to_here),
            "_basis_at": F.last(F.when(F.col("_basis"), here), ignorenulls=True).over(after),
            # The first numbered line after this one whose number is not that of the numbered line before it.
            "_change": F.last(F.when(F.col("_number") != F.col("_earlier"), here), ignorenulls=True).over(after),
        }
    )
    follows = F.struct("position", "_number", "_change")
    rows = rows.withColumn("_next", F.last(F.when(F.col("_number").isNotNull(), follows), ignorenulls=True).over(after))
    own = F.when(F.col("_level") > 0, F.col("_level")).otherwise(LEVELS + 1)
    found = []
    for n in range(1, LEVELS + 1):
        higher = F.greatest(F.lit(-1), *[F.coalesce(F.col(f"_last{m}.position"), F.lit(-1)) for m in range(1, n)]) if n > 1 else F.lit(-1)
        found.append(F.when((F.col(f"_last{n}.position") > higher) & (own > n), F.col(f"_last{n}")))
    parents = F.filter(F.when(F.col("is_personal"), F.array("_section")).otherwise(F.array(*found)), lambda p: p.isNotNull())
    end = F.when(F.col("_number").isNull(), None).when(F.col("_next._number") != F.col("_number"), F.col("_next.position")).otherwise(F.col("_next._change"))
    rows = rows.withColumns({"_parents": parents, "end_at": end})
    last = F.try_element_at("_parents", F.lit(-1))
    return rows.select(
        "doc_index", "position", "is_personal", F.col("_parents.position").alias("parents"), "end_at", "stretch",
        F.when((last["position"] + 1 < here) & last["_next_acts"], last["position"] + 1).alias("action_at"),
        F.when(~F.col("is_personal") & F.coalesce(F.col("_basis_at") < F.col("end_at"), F.lit(True)), F.col("_basis_at")).alias("basis_at"),
        (~F.col("_stop") & (F.col("is_personal") | F.col("_number").isNull())).alias("tells"),
    )


def extracts_by(outlined: DataFrame, lines: DataFrame, matches: DataFrame) -> DataFrame:
    """What is shown around each match, looked up in an outline; ``lines`` (doc_index, position, text) are read for the texts alone."""
    keys = matches.select("doc_index", "position").distinct()
    at = outlined.join(keys, ["doc_index", "position"], "left_semi")
    mine = at.select("doc_index", F.col("position").alias("_m"), "stretch", "end_at", "is_personal")
    told = mine.join(outlined.where("tells").select("doc_index", "stretch", "position"), ["doc_index", "stretch"])
    told = told.where((F.col("position") > F.col("_m")) & F.coalesce(F.col("is_personal") | (F.col("position") < F.col("end_at")), F.lit(True)))
    kind = lambda k: F.lit(k).alias("_kind")
    match = F.col("position").alias("_m")
    parts = at.select("doc_index", match, F.explode("parents").alias("position"), kind("parent"))
    for part, column in (("action", "action_at"), ("basis", "basis_at"), ("self", "position")):
        parts = parts.unionByName(at.where(F.col(column).isNotNull()).select("doc_index", match, F.col(column).alias("position"), kind(part)))
    parts = parts.unionByName(told.select("doc_index", "_m", "position", kind("followup")))
    texts = lines.select("doc_index", "position", T.unicode_trim(F.col("text")).alias("_t"))
    found = parts.join(texts, ["doc_index", "position"])
    ordered = lambda k: F.sort_array(F.collect_list(F.when(F.col("_kind") == k, F.struct("position", "_t"))))
    one = lambda k: F.max(F.when(F.col("_kind") == k, F.col("_t")))
    found = found.groupBy("doc_index", F.col("_m").alias("position")).agg(
        one("self").alias("text"), ordered("parent").alias("_p"), one("action").alias("action"), one("basis").alias("basis"), ordered("followup").alias("_f")
    )
    found = found.join(at.select("doc_index", "position", "is_personal"), ["doc_index", "position"])
    return found.select(
        "doc_index", "position", "text", "is_personal", F.col("_p._t").alias("parents"), F.col("_p.position").alias("parents_at"), "action", "basis", F.col("_f._t").alias("followups")
    )


def extracts(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """doc_index, file_name, position, text × doc_index, position -> what is shown around each match.

    Adds is_personal, parents (texts, top one first) and parents_at (their positions), action, followups (texts in order) and basis. In a personal file the parent is
    the section sign before the match; its follow-ups end at the next sign, rank or numbered line, and it has no basis. In others
    the parents are the headings above; follow-ups are the lines without a number up to the basis, a rank, or a
    numbered line of another first number than the match's, and the basis is the next one ahead of such a line.
    Lines between two ends share a number, by which follow-ups are joined, so that a match meets the lines of its own stretch alone.
    """
    return extracts_by(outline(lines), lines, matches)


def document_flags(lines: DataFrame, matches: DataFrame, outlined: DataFrame | None = None) -> DataFrame:
    """Every paragraph with is_match, is_parent and category: the whole document as it is shown.

    is_match: its text, trimmed, is that of a match in its document. is_parent: it is the section sign above a match in a personal
    file, else the first paragraph with the text of a match's parent; category is that of a parent. Other columns of ``lines``, such as line_breaks_after, are passed on.
    """
    trimmed = T.unicode_trim(F.col("text"))
    texts = matches.select("doc_index", trimmed.alias("_t")).distinct()
    joined = lines.withColumn("_t", trimmed).join(texts.withColumn("_hit", F.lit(True)), ["doc_index", "_t"], "left")
    found = extracts_by(outline(lines) if outlined is None else outlined, lines, matches).select("doc_index", "is_personal", F.explode(F.arrays_zip("parents", "parents_at")).alias("p"))
    above = found.where("not is_personal").select("doc_index", F.col("p.parents").alias("_t")).distinct()
    first = lines.select("doc_index", "position", trimmed.alias("_t")).join(above, ["doc_index", "_t"], "left_semi").groupBy("doc_index", "_t")
    first = first.agg(F.min("position").alias("position")).select("doc_index", "position")
    first = first.unionByName(found.where("is_personal").select("doc_index", F.col("p.parents_at").alias("position"))).distinct().withColumn("_up", F.lit(True))
    joined = joined.join(first, ["doc_index", "position"], "left")
    is_parent = F.coalesce("_up", F.lit(False))
    joined = joined.withColumns({"is_match": F.coalesce("_hit", F.lit(False)), "is_parent": is_parent, "category": F.when(is_parent, T.document_category(F.col("_t")))})
    return joined.drop("_t", "_hit", "_up")
