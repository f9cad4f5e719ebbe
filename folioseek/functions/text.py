"""Normalising, stemming, tokenising and classifying text."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numbers

# Endings that the stemmer removes, in this order, and the vowels and signs it then strips.
ENDINGS = ("ець|ця|цю", "ого", "ому")
TRAILING = "аеєиіїоуюяьй"
# The name rule.
NAME_STEM, NAME_ENDS = "фед", ("ір", "ор")
# How a basis paragraph, a personal file and an action line begin, and the section sign.
BASIS = "підстава"
PERSONAL_FILE = "особовий"
ACTIONS = ("видати", "зарахувати")
SECTION = "§"
# Ranks and words that end the follow-up of a match.
FOLLOWUP_STOPS = (
    "старш", "молодш", "солдат", "сержант", "штаб", "лейтенант", "майор", "матрос", "рекрут", "підполковник", "капітан", "полковник",
)
# Phrases of the headings of arrivals and departures.
ARRIVALS, DEPARTURES = "Вважати такими, що прибули", "Вважати такими, що вибули"
# Fixed value: the letters that may follow a word of a highlighted sequence.
ENDING_LETTERS = "а-яіїєґ"
#: Bytes between two words that still count as near.
NEAR_BYTES = 15

TOKEN = r"[\p{L}\p{N}']+"
LEAST_BYTES = 2


def unicode_trim(text: Column) -> Column:
    """Strip every kind of white space at both ends (``trim`` knows the blank only). A text is searched for it only where its first or last character is one."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")).otherwise(text)


def _stem_part(word: Column) -> Column:
    for ending in (*ENDINGS, f"[{TRAILING}]+"):
        word = F.regexp_replace(word, rf"(?:{ending})\z", "")
    return F.when(word.rlike(rf"^{NAME_STEM}(?s:.*)(?:{'|'.join(NAME_ENDS)})\z"), F.lit(NAME_STEM)).otherwise(word)


def _stem_guarded(word: Column) -> Column:
    """``_stem_part`` for words that end in a letter that some ending has, or begin like the name; others are their own stem."""
    may = F.contains(F.lit(TRAILING), F.right(word, F.lit(1))) | F.startswith(word, F.lit(NAME_STEM))
    return F.when(may, _stem_part(word)).otherwise(word)


def stem(word: Column) -> Column:
    """The stem of a word; the parts of a hyphenated one are stemmed each."""
    return F.array_join(F.transform(F.split(F.lower(word), "-"), _stem_guarded), "-")


def stem_token(token: Column) -> Column:
    """``stem`` for tokens, which have no hyphen."""
    return stem_lowered(F.lower(token))


def stem_lowered(word: Column) -> Column:
    """``stem_token`` for one that is in lower case."""
    return _stem_guarded(word)


def raw_tokens(text: Column) -> Column:
    """Letter and digit runs of a text, with their apostrophes."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def term(raw: Column) -> Column:
    """The index term of a raw token: its stem without apostrophes."""
    return stem_token(F.replace(raw, F.lit("'"), F.lit("")))


#: Letters whose lower case hangs on the letters around, or is more than a letter: a text with one has its tokens cut before they are in lower case.
UNLIKE = ("\u0130", "\u03a3")


def words(text: Column) -> Column:
    """The raw tokens of a text in lower case without apostrophes; those of apostrophes alone may be left out. A text is changed as a whole if it can be."""
    odd = F.contains(text, F.lit(UNLIKE[0])) | F.contains(text, F.lit(UNLIKE[1]))
    each = F.transform(raw_tokens(text), lambda w: F.lower(F.replace(w, F.lit("'"), F.lit(""))))
    return F.when(odd, each).otherwise(F.regexp_extract_all(normalised(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


#: Where the letters end of which ``words_of`` cuts words: Latin, Greek and Cyrillic. No character below comes or changes its kind any more, and its lower case is one character.
PLAIN = 0x500
#: Letters and digits among these and their lower cases.
_LETTERS = np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x3000)])
#: Bytes of texts that are cut at once, about.
CUT_BYTES = 1 << 20


def unplain(text: Column) -> Column:
    """Whether a text has a character that ``words_of`` does not know."""
    odd = text.rlike(rf"[\x{{{PLAIN:X}}}-\x{{10FFFF}}]") | F.contains(text, F.lit(UNLIKE[0])) | F.contains(text, F.lit(UNLIKE[1]))
    return (F.octet_length(text) > F.length(text)) & odd  # others are ASCII


def words_of(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """``words`` of plain texts: (the text of each word, all words)."""
    rows, found = [np.zeros(0, np.int64)], [pa.array([], pa.string())]
    for first, n in numbers.slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), CUT_BYTES):
        part = pc.fill_null(pc.replace_substring(texts.slice(first, n), "'", ""), "")
        text = "\n".join(part.to_pylist()).lower()
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        inside = _LETTERS[codes]
        at = np.flatnonzero(inside & np.r_[True, ~inside[:-1]][: len(inside)])
        sizes = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800)
        held = np.cumsum(sizes * inside, dtype=np.int64)
        offsets = np.r_[held[at] - sizes[at], held[-1:] if len(held) else 0].astype(np.int32)
        data = np.frombuffer(text.encode(), np.uint8)[np.repeat(inside, sizes)]
        starts = np.cumsum(pc.utf8_length(part).to_numpy().astype(np.int64) + 1)
        rows.append(first + np.searchsorted(starts, at, "right"))
        found.append(pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))))
    return np.concatenate(rows), pa.concat_arrays(found)


def tokens(text: Column) -> Column:
    """The index terms of a text in order: stems of its letter and digit runs, apostrophes removed."""
    return F.filter(F.transform(raw_tokens(text), term), lambda t: F.octet_length(t) >= LEAST_BYTES)


def normalised(text: Column) -> Column:
    """Lower case without apostrophes, as paragraphs are searched."""
    return F.replace(F.lower(text), F.lit("'"), F.lit(""))


# ---- queries are strings on the driver ----

_PY_RULES = [re.compile(rf"(?:{e})\Z") for e in (*ENDINGS, f"[{TRAILING}]+")]


def stem_word(word: str) -> str:
    """``stem`` of a Python string."""
    parts = []
    for part in word.lower().split("-"):
        for rule in _PY_RULES:
            part = rule.sub("", part)
        parts.append(NAME_STEM if part.startswith(NAME_STEM) and part.endswith(NAME_ENDS) else part)
    return "-".join(parts)


def stem_lowered_word(word: str) -> str:
    """``stem_lowered`` of a Python string."""
    if word[-1:] not in TRAILING and not word.startswith(NAME_STEM):
        return word
    for rule in _PY_RULES:
        word = rule.sub("", word)
    return NAME_STEM if word.startswith(NAME_STEM) and word.endswith(NAME_ENDS) else word


def query_terms(query: str, friendly: bool = False) -> list[str]:
    """The words of a query, in order and with repeats; ``friendly`` drops commas after words first.

    Words are stemmed with the punctuation that stands at them, so that ``солдата,`` keeps its ending unless friendly.
    """
    if friendly:
        query = re.sub(r",(?=\s|\Z)", "", query)
    stemmed = " ".join(map(stem_word, query.replace("'", "").split()))
    return [w.lower() for w in re.findall(r"\b[^\W_]+\b", stemmed)]


# ---- file names and paragraphs ----


def file_date(file_name: Column) -> Column:
    """The first DD.MM.YYYY of a name as the number yyyymmdd; null if there is none or it is out of range.

    Days are checked against 31 only: the date is an ordering key, not a calendar date.
    """
    part = lambda i: F.regexp_extract(file_name, r"([0-9]{2})\.([0-9]{2})\.([0-9]{4})", i)
    day, month, year = (F.when(part(i) != "", part(i).cast("int")) for i in (1, 2, 3))
    valid = day.between(1, 31) & month.between(1, 12) & (year >= 1900)
    return F.when(valid, year * 10000 + month * 100 + day)


def _beginning(text: Column, letters: int) -> Column:
    """The first letters of a text in lower case: so much of it is compared with words of this length."""
    return F.lower(F.left(text, F.lit(letters)))


def is_basis(text: Column) -> Column:
    return F.startswith(_beginning(unicode_trim(text), len(BASIS)), F.lit(BASIS))


def ends_followup(text: Column) -> Column:
    """Whether a paragraph begins with a rank or another word that ends a follow-up."""
    return _beginning(unicode_trim(text), max(map(len, FOLLOWUP_STOPS))).rlike(f"^(?:{'|'.join(FOLLOWUP_STOPS)})")


def is_numbered(text: Column) -> Column:
    return unicode_trim(text).rlike(r"^[0-9]+\.\s")


def heading_level(text: Column) -> Column:
    """1 to 4 for a line that begins with a section number, else 0."""
    number = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+){0,3})\.\s+", 1)
    return F.when(number != "", F.size(F.split(number, r"\."))).otherwise(0)


def heading_category(text: Column) -> Column:
    """``arrivals`` or ``departures`` for a numbered heading with either phrase, ``section`` for one with the sign."""
    top = text.rlike(r"^[0-9]+\.\s+")
    return (
        F.when(top & F.contains(text, F.lit(ARRIVALS)), "arrivals")
        .when(top & F.contains(text, F.lit(DEPARTURES)), "departures")
        .when(F.startswith(text, F.lit(SECTION)), "section")
    )


def network_path(path: Column, local: str, share: str) -> Column:
    """A path below the folder ``local`` as one below the network share ``share``; others stay."""
    unified = F.replace(path, F.lit("\\"), F.lit("/"))
    below = F.substring(unified, len(local) + 1, 1 << 30)
    return F.when(F.startswith(unified, F.lit(local)), F.concat(F.lit(share), F.replace(below, F.lit("/"), F.lit("\\")))).otherwise(path)


def near_in_order(text: Column, words: Column, most: int = NEAR_BYTES) -> Column:
    """Whether ``words`` follow one another in ``text`` with at most ``most`` bytes between.

    Of each word the first occurrence after the one before counts; a nearer pair further on is not looked for.
    """
    start = F.struct(text.alias("rest"), F.lit(True).alias("ok"), F.lit(True).alias("first"))

    def step(acc: Column, word: Column) -> Column:
        found = F.position(word, acc["rest"])
        gap = F.octet_length(F.substring(acc["rest"], F.lit(1), found - 1))
        ok = acc["ok"] & (found > 0) & (acc["first"] | (gap <= most))
        return F.struct(F.substring(acc["rest"], found + F.length(word), F.length(acc["rest"])).alias("rest"), ok.alias("ok"), F.lit(False).alias("first"))

    return F.aggregate(words, start, step, lambda acc: acc["ok"])


def document_category(text: Column) -> Column:
    """``heading_category`` as the view of a whole document has it: either phrase counts in any heading, numbered or not."""
    return (
        F.when(F.contains(text, F.lit(ARRIVALS)), "arrivals")
        .when(F.contains(text, F.lit(DEPARTURES)), "departures")
        .when(F.startswith(text, F.lit(SECTION)), "section")
    )


def is_personal(file_name: Column) -> Column:
    return F.startswith(F.lower(file_name), F.lit(PERSONAL_FILE))


def is_action(text: Column) -> Column:
    """Whether a trimmed line begins like an action."""
    return _beginning(text, max(map(len, ACTIONS))).rlike(f"^(?:{'|'.join(ACTIONS)})")


def highlight(text: Column, words: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """``text`` with a query's words marked, in any case.

    Two or three words of two letters or more are a sequence: where it occurs, each word with its ending, it alone is marked.
    Elsewhere every occurrence of any word is, without its ending.
    """
    if not words:
        return text
    mark = lambda pattern: F.regexp_replace(text, f"(?iu)({pattern})", f"{before}$1{after}")
    each = mark("|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w))))
    if not (2 <= len(words) <= 3 and min(map(len, words)) >= 2):
        return each
    sequence = r"\s+".join(f"{re.escape(w)}[{ENDING_LETTERS}]*" for w in words)
    return F.when(text.rlike(f"(?iu){sequence}"), mark(sequence)).otherwise(each)
