"""Very long texts, and columns whose names are those that operators use inside."""

import hashlib
import random

from conftest import rows

from folioseek.llm import chat, fingerprint, langid, neardup, ppm

RNG = random.Random(12)
LONG = " ".join(f"word{RNG.randrange(5000)}" for _ in range(150_000))


def test_a_very_long_message_and_clashing_columns(spark):
    data = [(1, 0, "ann", LONG), (1, 1, "bob", "ok"), (2, 0, "ann", "hi"), (None, None, None, None)]
    names = "conv_id long, turn int, role string, text string"
    plain = rows(chat.perspectives(spark.createDataFrame(data, names)))
    more = spark.createDataFrame([(*r, 7, "x", "y", True) for r in data], names + ", part int, speaker string, said string, late boolean")
    assert rows(chat.perspectives(more)) == plain
    ann = next(r for r in plain if r[:2] == (1, "ann"))
    begin, end = map(int, ann[5].split(":"))
    assert ann[4][begin:end] == LONG + chat.END and ann[6] == len(LONG) + len(chat.END)
    bob = next(r for r in plain if r[:2] == (1, "bob"))
    assert bob[4].startswith("<|user:ann|>\n" + LONG)


def test_scores_of_a_very_long_text_and_clashing_columns(spark, monkeypatch):
    data = [(i, f"some words {i} here") for i in range(20)] + [(20, LONG), (21, LONG[: len(LONG) // 2])]
    names = "doc_id long, text string"
    docs = spark.createDataFrame(data, names)
    plain = rows(ppm.score(docs))
    more = spark.createDataFrame([(*r, 1, 2, 3, False) for r in data], names + ", chunk int, kind int, score int, held_out boolean")
    assert [r[:5] for r in rows(ppm.score(more))] == [r[:5] for r in plain]
    assert all(abs(a[6] - b[6]) < 1e-6 * abs(b[6]) for a, b in zip(rows(ppm.score(more)), plain, strict=True))
    by = {r[0]: r for r in plain}
    assert by[20][2] == 150_001 and by[20][6] < by[21][6] < 0
    # A text longer than a chunk is a chunk by itself.
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 50_000)
    again = {r[0]: r for r in rows(ppm.score(docs))}
    assert again[20][:5] == by[20][:5] and abs(again[20][6] - by[20][6]) < 1e-6 * abs(by[20][6])


def test_language_of_a_very_long_text(spark):
    english, french = "the quick brown fox and the lazy dog were there with that thing", "le renard brun et le chien paresseux avec une chose dans la maison"
    data = [(i, english, "en") for i in range(40)] + [(100 + i, french, "fr") for i in range(40)]
    data += [(500, (french + " ") * 20_000, None), (501, (english + " ") * 20_000, None), (502, (english + " ") + "é " * 400_000, None)]
    found = {r[0]: r[2] for r in rows(langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")))}
    assert found[500] == "fr" and found[501] == "en" and 502 in found


def test_fingerprint_of_a_very_long_text(spark):
    data = [(1, LONG), (2, LONG), (3, LONG[:-200] + " and another end of it"), (4, "short one")]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    third = len(LONG) // 3
    assert got[2]["n_chars"] == len(LONG) and got[2]["edited_sha256"] == hashlib.sha256((LONG[: len(LONG) - third] + LONG[:third]).encode()).hexdigest()
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[2]["near_next"] == 1.0 and got[3]["near_next"] > 0.95 and got[4]["near_next"] < 0.2


def test_near_duplicates_of_very_long_texts(spark):
    words = LONG.split()
    near = " ".join(w if i % 50 else "changed" for i, w in enumerate(words))
    far = " ".join(reversed(words))
    data = [(1, LONG, 1), (2, near, 1), (3, far, 1), (4, LONG, 1)]
    got = {r[0]: r for r in rows(neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string, n_shingles int")))}
    assert [got[i][2] for i in (1, 2, 3, 4)] == [1, 1, 3, 1] and got[1][1] == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
