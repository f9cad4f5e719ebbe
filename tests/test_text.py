import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioseek.functions import text as T

#: What the stemmer has to give.
STEMS = {
    "донецького": "донецьк", "лейтенанта": "лейтенант", "солдата": "солдат", "донецько-луганський": "донецьк-луганськ", "донецькому": "донецьк",
    "донець": "дон", "федір": "фед", "федора": "фед", "федору": "фед", "ігор": "ігор", "ігоря": "ігор", "": "", "аеє": "", "WORLD": "world",
}


def test_stems(spark):
    got = {r["w"]: r["s"] for r in spark.createDataFrame([(w,) for w in STEMS], "w string").select("w", T.stem(F.col("w")).alias("s")).collect()}
    assert got == STEMS
    assert {w: T.stem_word(w) for w in STEMS} == STEMS


@settings(max_examples=500, deadline=None)
@given(st.text("федіроцьяюгмкаеєйнст-", max_size=14))
def test_stem_is_idempotent(word):
    assert T.stem_word(T.stem_word(word)) == T.stem_word(word)


def test_both_stemmers_agree(spark):
    rng = random.Random(5)
    made = ["".join(rng.choice("федіроцьяюгмкаеєйнст-АБ") for _ in range(rng.randrange(12))) for _ in range(3000)]
    got = spark.createDataFrame([(w,) for w in made], "w string").select("w", T.stem(F.col("w")).alias("s")).collect()
    assert [r for r in got if T.stem_word(r["w"]) != r["s"]] == []


def test_tokens(spark):
    cases = {"Солдата, п'ятого x й а_б 12": ["солдат", "п'ят".replace("'", ""), "й", "а", "б", "12"], "": [], "...": [], "донецько-луганський": ["донецьк", "луганськ"]}
    # A lone vowel stems to nothing.
    cases["Солдата, п'ятого x й а_б 12"] = ["солдат", "пят", "б", "12"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.tokens(F.col("t"))).collect()}
    assert got == cases


@pytest.mark.parametrize(
    ("query", "plain", "friendly"),
    [
        ("", [], []), ("'", [], []), ("а_б", [], []), ("солдата, сержанта", ["солдата", "сержант"], ["солдат", "сержант"]),
        ("that that", ["that", "that"], ["that", "that"]), ("донецько-луганський", ["донецьк", "луганськ"], ["донецьк", "луганськ"]),
    ],
)
def test_query_terms(query, plain, friendly):
    assert T.query_terms(query) == plain
    assert T.query_terms(query, friendly=True) == friendly


def test_file_dates(spark):
    cases = {
        "a 05.03.2024.docx": 20240305, "31.02.2024": 20240231, "32.01.2024": None, "01.13.2024": None, "01.01.1899": None,
        "99.99.2024 і 01.02.2023": None, "123.04.2024": 20240423, "x": None,
    }
    got = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.file_date(F.col("t"))).collect()}
    assert got == cases


def _near_by_hand(text, words):
    at = 0
    for i, w in enumerate(words):
        found = text.find(w, at)
        if found < 0 or i and len(text[at:found].encode()) > 15:
            return False
        at = found + len(w)
    return True


def test_near_in_order(spark):
    rng = random.Random(3)
    cases = [(f"x one{'а' * n} two", ["one", "two"]) for n in range(5, 10)] + [("two one", ["one", "two"]), ("one " + "x" * 20 + " one two", ["one", "two"])]
    cases += [("".join(rng.choice(["аа", "bb", " ", "cc", "ddd "]) for _ in range(12)), rng.sample(["аа", "bb", "cc"], rng.choice([2, 3]))) for _ in range(300)]
    df = spark.createDataFrame(cases, "t string, w array<string>").select("t", "w", T.near_in_order(F.col("t"), F.col("w")).alias("ok"))
    assert [r for r in df.collect() if r["ok"] != _near_by_hand(r["t"], r["w"])] == []


def test_small_functions(spark):
    df = spark.createDataFrame([("./cache/x/y.docx",), ("other/x",)], "p string")
    assert [r[0] for r in df.select(T.network_path(F.col("p"), "./cache/", "\\\\share\\")).collect()] == ["\\\\share\\x\\y.docx", "other/x"]
    marked = spark.createDataFrame([("Солдати Іваненко прибули",)], "t string").select(T.highlight(F.col("t"), ["солдат", "іваненк"])).first()[0]
    assert marked == "<mark>Солдати Іваненко</mark> прибули"
    apart = spark.createDataFrame([("Солдати та Іваненко",)], "t string").select(T.highlight(F.col("t"), ["солдат", "іваненк"])).first()[0]
    assert apart == "<mark>Солдат</mark>и та <mark>Іваненк</mark>о"
    trimmed = spark.createDataFrame([("  a b \n",)], "t string").select(T.unicode_trim(F.col("t"))).first()[0]
    assert trimmed == "a b"
