"""Small inline tables for operators that the driver's tables do not exercise; the texts are invented."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (columns, rows)
STEMS = (
    "word string",
    [(w,) for w in (
        "донецького лейтенанта солдата донецько-луганський донецькому донець федір федора федору ігор ігоря аеє перемогою "
        "Київська вулиця київську Straße WORLD читай хлопець ого"
    ).split()],
)
#: Endings that are put to the words of the documents, so that the stemmer has something to do.
ENDED = ("", "ого", "ець", "ому", "ця", "і", "ий", "цю")
#: What is put before paragraphs, by position, to make lines of orders of them.
MARKS = (
    "§ 1 ", "1. Вважати такими, що прибули ", "", "видати ", "1.2. ", "Іваненку Петру ", "", "сержант ", "Підстава: ", "2. Вважати такими, що вибули ",
    "", "Петру від Іваненка ", "2.1. ",
)
SEQUENCE = ("іваненк", "петр")
#: Ends of file names, by number.
KINDS = (".pdf", ".JPG", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".svg", ".docx", "", ".pdf.", "..png")
FILES = (
    "path string",
    [(p,) for p in (
        "2024/a.docx", "2024/A.DOCX", "2024/~$a.docx", "2024/b.zip", "2024/b.xlsx", "root.docx", "notes/a.docx", "2023рік/x.docx",
        "2024/ЕРДР/y.docx", "2024/.git/z.docx", "2024/.github/z.docx", "2024/t.tmp", "2024/thumbs.db", "2024/c.pdf", "2024/.docx", "ердр (не виключені)/a.docx",
        "2024/a..docx", "2024/..docx", "2024/.xlsx", "2024/A.ZIP", "2024/b.Xls", "2024/.zip", "2024/docx", "2024/a.docx.", "2024/.DS_Store", "2024/a.db.docx",
    )],
)
LINES = (
    "doc_index long, position long, text string, is_match boolean",
    [
        (0, 0, "1. Вважати такими, що прибули", False), (0, 1, "1.1. солдата Іваненка до частини", True), (0, 2, "видати речове майно", False),
        (0, 3, "1.2. інший пункт", False), (0, 4, "ще один рядок", False), (0, 5, "  Підстава: рапорт", False), (0, 6, "після підстави", False),
        (1, 0, "§ 1", False), (1, 1, "сержант Петренко", True), (1, 2, "прибув із відпустки", False), (1, 3, "05.03.2024 запис", False),
        (1, 4, "Солдат Коваль", False), (1, 5, "рядок", False), (1, 6, "§ 2", False), (1, 7, "підстава: наказ", False),
        (2, 0, "2. Вважати такими, що вибули", False), (2, 1, "2.1.3. когось", True), (2, 2, "рядок перший", False), (2, 3, "3. Новий розділ", False),
        (2, 4, "рядок другий", False), (2, 5, "Підстава: лист", False),
    ],
)
RAW = (
    "doc string, seq long, text string, style string, ilvl string, num_id string",
    [
        ("a", 0, "", None, None, None), ("a", 1, "Наказ", None, None, None), ("a", 2, " ", None, None, None), ("a", 3, "перший", None, "0", "1"),
        ("a", 4, "вкладений", None, "1", "1"), ("a", 5, "пояснення", None, None, None), ("a", 6, "", None, None, None), ("a", 7, "", None, None, None),
        ("a", 8, "другий вкладений", "OiiSList2", None, None), ("a", 9, "1.2. ручний номер", None, "0", "1"), ("a", 10, "« 3. лапки", None, "0", "1"),
        ("a", 11, "ПОГОДЖЕНО ким", None, None, None), ("a", 12, "Підстава: лист", None, "0", "1"), ("a", 13, "п'ятий рівень", None, "4", "1"),
        ("a", 14, "", None, None, None), ("b", 0, "тільки текст", None, None, None), ("b", 1, "третій", "Oii_S_List_3", None, None),
    ],
)


def sample(spark: SparkSession, table: tuple[str, list[tuple]]) -> DataFrame:
    return spark.createDataFrame(table[1], table[0])


def values(table: tuple[str, list[tuple]]) -> str:
    """The same rows as a SQL subquery."""
    names = [c.split()[0] for c in table[0].split(", ")]
    kinds = [{"string": "VARCHAR", "long": "BIGINT", "boolean": "BOOLEAN"}[c.split()[1]] for c in table[0].split(", ")]
    show = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    rows = ", ".join("(" + ", ".join(map(show, r)) + ")" for r in table[1])
    return "(SELECT " + ", ".join(f"{n}::{k} AS {n}" for n, k in zip(names, kinds, strict=True)) + f" FROM (VALUES {rows}) t({', '.join(names)}))"
