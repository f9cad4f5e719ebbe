"""Scoring, language identification, HTML, chats, mixing, WARC and packing."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows

from folioseek.llm import chat, html_text, langid, mixing, neardup, packing, ppm, warc

# ---- scoring ----


def by_hand(train, text):
    """Prediction by partial matching with dictionaries."""
    counts = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    low = lambda t: b"\0" * ppm.ORDER + (t or "").encode().lower() + b"\0"
    for t in train:
        b = low(t)
        for i in range(ppm.ORDER, len(b)):
            for j in range(ppm.ORDER + 1):
                counts[j][b[i - j : i]][b[i]] += 1
    b, total = low(text), 0.0
    for i in range(ppm.ORDER, len(b)):
        gone, p = set(), 1.0
        for j in range(ppm.ORDER, -1, -1):
            left = {s: n for s, n in counts[j].get(b[i - j : i], {}).items() if s not in gone}
            if b[i] in left:
                p *= (left[b[i]] - 0.5) / sum(left.values())
                break
            if left:
                p *= 0.5 * len(left) / sum(left.values())
                gone |= set(left)
        else:
            p /= 256 - len(counts[0].get(b"", {}))
        total += np.log10(p)
    return total


def test_scores(spark):
    rng = random.Random(2)
    data = [(i, "".join(rng.choice(["ab", "ba ", "c", " ", "É", "\n", "D"]) for _ in range(rng.randrange(80)))) for i in range(150)]
    data += [(900, None), (901, ""), (902, "ab"), (902, "ab"), (None, "ba c")]
    held = {i for i, _ in data if i is not None and zlib.crc32(str(i).encode()) % 10 == 0}
    split = lambda t: [w for w in (t or "").encode().lower().split() if w] + [None]
    train = [t for i, t in data if i not in held]
    c = Counter(w for t in train for w in split(t))
    n, v = sum(c.values()), len(c)
    got = sorted((tuple(r) for r in ppm.score(spark.createDataFrame(data, "doc_id long, text string")).collect()), key=str)
    want = sorted(
        (
            (i, i in held, len(split(t)), sum(c[w] > 0 for w in split(t)), n, sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t)), by_hand(train, t))
            for i, t in data
        ),
        key=str,
    )
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[2])), sorted(want, key=lambda r: (str(r[0]), r[2])), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:])


def test_chunks_are_bounded_inside_a_task(spark, monkeypatch):
    data = [(i, " ".join(f"w{i * j % 97}" for j in range(60))) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    whole = rows(ppm.score(docs))
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(ppm, "BLOCK", 300)
    made = ppm.chunked(docs.selectExpr("doc_id", "text", "false AS held_out").coalesce(1))
    assert made.select("chunk").distinct().count() > 5
    for a, b in zip(rows(ppm.score(docs)), whole, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_scores_of_nothing(spark):
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    one = ppm.score(spark.createDataFrame([(only_held, "ab")], "doc_id long, text string")).first()
    assert one["score"] == pytest.approx(-3 * np.log10(256)) and one["train_tokens"] == 0


# ---- languages ----


def test_languages(spark):
    rng = random.Random(1)
    sounds = {"aa": ["ka", "to", "mi", "shi", "ru"], "bb": ["str", "eich", "ung", "über", "nd"], "cc": ["ción", "os", "el", "ñar", "que"]}
    word = lambda x: "".join(rng.choice(sounds[x]) for _ in range(rng.randrange(1, 4)))
    data = []
    for i in range(600):
        x = rng.choice(list(sounds))
        data.append((i, " ".join(word(x) for _ in range(rng.choice([2, 30, 100]))), x if i % 3 else rng.choice([x, None]), x))
    data += [(1000, None, "aa", None), (1001, "", "aa", None), (1002, "12 .. 3", "bb", None), (None, "ka to mi", "aa", "aa"), (1003, "Q", None, None)]
    df = spark.createDataFrame([r[:3] for r in data], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert len(got) == len(data)
    assert all(got[i]["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in data)
    long = [(got[i]["lang_pred"], x) for i, t, _, x in data if x and len(t) > 20]
    assert sum(a == b for a, b in long) >= 0.99 * len(long)
    assert {got[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and got[1003]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = {r[0] for r in langid.keep_identified(df).select("doc_id").collect()}
    assert {i for i, _, _, x in data if x} <= kept and not kept & {1000, 1001, 1002}
    assert langid.identify(df.where("false")).collect() == []
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame([(1, "abc", None)], df.schema)).collect()} == {"und"}


def ngrams_by_hand(text):
    out = []
    coded = "".join(chr(b + 32) if 65 <= b <= 90 else chr(b) if 97 <= b <= 122 or b >= 128 else " " for b in text.encode())
    for k in langid.NGRAMS:
        padded = f" {coded} "
        out += [g for g in (padded[i : i + k] for i in range(len(padded) - k + 1)) if "  " not in g]
    return out


def test_masks_hold_every_language(spark):
    # Filters learned by Spark against dictionaries: every language and level of every n-gram is in its mask, few others are.
    rng = random.Random(4)
    for n in (3, 9):
        data = []
        for i in range(12 * n):
            x = i % n
            data.append((i, " ".join("".join(rng.choice("abcdefgh"[x % 4 :] + "xyzé") for _ in range(5)) for _ in range(40)), f"l{x:02}"))
        model = langid.learn(spark.createDataFrame(data, "doc_id long, text string, lang string"))
        by_hand = {f"l{x:02}": Counter(g for _, t, lang in data if lang == f"l{x:02}" for g in ngrams_by_hand(t)) for x in range(n)}
        assert model.languages == sorted(by_hand)
        rates = {lang: {g: c / sum(counts.values()) for g, c in counts.items()} for lang, counts in by_hand.items()}
        for _, text, _ in data[:: 2 * n + 1]:
            grams = ngrams_by_hand(text)
            total, found = model.counts(*langid.utf8(pa.array([text])))
            assert total[0] == len(grams)
            want = np.array([sum(sum(rates[x].get(g, -1) >= r for r in langid.RATES) for g in grams) for x in model.languages])
            assert np.abs(found[0] - want).max() <= 0.02 * langid.LEVELS * len(grams)
        assert (model.false_rate < 0.05 * langid.LEVELS).all()


def test_sample_of_hot_language(spark):
    data = [(i, f"text {i}", "aa") for i in range(3000)] + [(5000, "same", "aa")] * 500 + [(9000 + i, f"other {i}", "bb") for i in range(50)]
    got = langid._sampled(spark.createDataFrame(data, "doc_id long, text string, lang string"), 100).collect()
    assert Counter(r["lang"] for r in got) == {"aa": 100, "bb": 50} and len({r["text"] for r in got}) == 150


def test_stage_columns_that_clash(spark):
    schema = "doc_id long, text string, lang string, source string, score double, lang_pred string, `_lang_score` int, `_lang` int, size int, _size int, _times int, `a.b` int, component_id long, kept boolean"
    data = [(i, f"ka to mi shi {'ru ' * (i % 4)} w{i} x{i} y{i}", "aa", "s" if i % 3 else None, 0.5, "zz", i, 9, 9, 9, 9, i, 1, False) for i in range(90)]
    docs = spark.createDataFrame(data, schema)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and rows(kept) == rows(docs)
    mixed = mixing.mix_documents(docs)
    taken = mixing.mix(docs.select("doc_id", "source", mixing.n_words(docs["text"]).alias("size"))).collect()
    want = {r["doc_id"]: round(r["taken"] / r["size"]) for r in taken}
    assert mixed.columns == docs.columns and set(rows(mixed)) <= set(rows(docs))
    assert Counter(r["doc_id"] for r in mixed.collect()) == {i: n for i, n in want.items() if n}
    assert neardup.keep_one(docs).columns == docs.columns and rows(neardup.keep_one(docs)) == rows(docs)
    assert packing.pack(docs).select("doc_id").distinct().count() == 90


# ---- HTML ----

PAGES = {
    "": "", "plain &amp; text": "plain & text", "<p>a<p>b": "a\n\nb", "a<br>b<div>c</div>d": "a\nb\nc\nd", "<b>x</b> <i>y</i>": "x y",
    "<head><title>t</title></head><body>b": "b", "<script>var t='</p>'</script>x<style>y</style>": "x", "<!-- a -->b<!--": "b",
    "<ul><li>a<li>b<ul><li>c</ul></ul>": "- a\n- b\n  - c", "<ol start=9><li>a<li>b</ol>": "9. a\n10. b",
    "<table><tr><td>aaa<td>b<tr><td>c<td>d</table>": "aaa  b\nc    d", "<td>a<td>b": "a  b",
    "<table><tr><td>a<p>b</td><td>c</table>": "a  c\n\nb", "<div hidden>x</div><p style='display : none'>y</p>z": "z",
    "<pre> a\n  b</pre>": " a\n  b", "x < y > z": "x < y > z", "<a title='>'>q</a>": "q", "</p></div>x": "x", "<h1>a</h2>b": "a\n\nb",
    "<dl><dt>a<dd>b</dl>": "a\n  b", "a<hr>b": "a\n\n--------\n\nb", "<p>a</p>\n\n<p>b</p>": "a\n\nb", "<ul><li></ul>x": "-\n\nx",
    "<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>": "A  b\n   c\nd  e", "<ol><li>a<li value=7>b<li>c</ol>": "1. a\n7. b\n8. c",
    "<div style='visibility:hidden'>x<p style='visibility: visible'>y</p></div>z": "y\n\nz", "<select><option>a<option>b</select>": "a\nb",
    "<svg><title>t</title><text>s</text></svg> <math><mi>x</mi><annotation>q</annotation></math>": "s x",
    "<table><tr><td>字字<td>b<tr><td>c<td>d</table>": "字字  b\nc     d", "<table><tr><td colspan=2>aa<td>b<tr><td>c<td>d<td>e</table>": "aa    b\nc  d  e",
}


def test_pages(spark):
    got = {p: html_text.page_text(p) for p in PAGES}
    assert got == PAGES
    data = [(i, p, "u") for i, p in enumerate(PAGES)] + [(None, None, "u"), (3, "a\nb", "u")]
    out = html_text.extract(spark.createDataFrame(data, "page_id long, html string, text string")).collect()
    assert len(out) == len(data) and all(r["n_lines"] == (r["text"].count("\n") + 1 if r["text"] else 0) and r["n_chars"] == len(r["text"]) for r in out)
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_hostile_pages_end():
    for page in ("<a \"" * 9000, "<div>" * 20000 + "x", "<table>" * 500, "<td>" * 3000, "<" * 20000, "<b>" * 9000 + "x" + "</b>" * 9000, "<li>" * 9000):
        html_text.page_text(page)
    began = time.time()
    assert len(html_text.page_text("<blockquote>x" * 2000)) < 400_000
    html_text.page_text("<div>" * 4000 + "<p>x" * 4000)
    assert time.time() - began < 5


# ---- chats ----


def test_perspectives(spark):
    data = [
        (1, 1, "Bob", "hi <|end|>"), (1, 0, "system", "be kind"), (1, 2, "Eve", "é"), (1, 3, "Bob", None), (1, 4, None, "x"), (2, 0, "system", "alone"),
        (None, 0, "A|b", "q"), (3, None, "Z", "late"), (3, 2000, "Z", "b"), (3, 0, "Z", "a"), (3, 0, "Z", "a"),
    ]
    got = chat.perspectives(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((str(r["conv_id"]), r["speaker"], r["part"], r["n_messages"]) for r in got) == [
        ("1", "Bob", 0, 5), ("1", "Eve", 0, 5), ("1", "unknown", 0, 5), ("3", "Z", -1, 1), ("3", "Z", 0, 2), ("3", "Z", 1, 1), ("None", "A_b", 0, 1)
    ]
    bob = next(r for r in got if r["speaker"] == "Bob")
    assert bob["text"] == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user:Eve|>\né<|end|>\n<|assistant|>\n<|end|>\n<|user:unknown|>\nx<|end|>\n"
    spans = [tuple(map(int, s.split(":"))) for s in bob["spans"].split(",")]
    assert [bob["text"][a:b] for a, b in spans] == ["hi < |end|><|end|>", "<|end|>"] and bob["target_chars"] == sum(b - a for a, b in spans)


def test_perspectives_of_hot_conversations(spark):
    data = [(1, i % 3, "Bob" if i % 2 else "Eve", f"m{i:04d}") for i in range(50)] + [(None, None, "Z", f"n{i:04d}") for i in range(25)] + [(2, 0, "Q", "one"), (2, 15, "Q", "two")]
    got = chat.perspectives(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5), 10).collect()
    assert max(r["n_messages"] for r in got) == 10
    assert sorted((str(r["conv_id"]), r["speaker"], r["part"], r["n_messages"]) for r in got) == sorted(
        [("1", who, k, 10) for who in ("Bob", "Eve") for k in range(5)] + [("None", "Z", 0, 10), ("None", "Z", 1, 10), ("None", "Z", 2, 5), ("2", "Q", 0, 1), ("2", "Q", 1, 1)]
    )
    bob = "".join(r["text"] for r in sorted(got, key=lambda r: r["part"]) if r["speaker"] == "Bob")
    want = [text for _, _, _, text in sorted(data[:50], key=lambda x: x[1:])]
    assert re.findall(r"m\d{4}", bob) == want


# ---- mixing ----


def test_mixing(spark):
    rng = random.Random(6)
    data = [(i, s, rng.randrange(0, 90)) for i in range(900) for s in [rng.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"])]] + [(5, "tiny", 3), (5, "tiny", 3), (None, "zero", 0)]
    df = spark.createDataFrame(data, "doc_id long, source string, size long")
    out = mixing.mix(df).collect()
    assert len(out) == len(data) and rows(mixing.mix(df.repartition(7))) == sorted((tuple(r) for r in out), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    level = max(target[s] / weight[s] for s in order if target[s] < 3 * sizes[s])
    for s in order:
        assert target[s] == pytest.approx(min(3 * sizes[s], level * weight[s])) and abs(taken[s] - target[s]) <= 1
    assert mixing.mix(df.where("false")).collect() == []


def test_mixed_documents(spark):
    data = [(i, "s" + str(i % 4), " ".join(["w"] * (i % 7)), "en", i) for i in range(200)]
    df = spark.createDataFrame(data, "doc_id long, source string, text string, lang string, n_chars long")
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    seen = Counter(r["doc_id"] for r in out.collect())
    assert max(seen.values()) <= 3 and all(seen[i] == 1 for i, _, t, *_ in data if not t)
    total = sum(len(t.split()) for *_, t, _, _ in data)
    assert abs(sum(n * len(data[i][2].split()) for i, n in seen.items()) - total) < 30


# ---- archives ----


def test_archives(spark):
    rng = random.Random(8)
    data = [(i, f"http://h/{i} x", rng.choice(["", "short", "é" * 60, "z" * 99, "q" * 100, f"page {i} " * 40])) for i in range(400)]
    data += [(None, None, "é" * 60), (7, "u", None), (7, "u", None)]
    got = warc.round_trip(spark, spark.createDataFrame(data, "page_id long, url string, html string"))
    first = {}
    for i, _, h in data:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in data:
        b = (h or "").encode()
        to = first.get(h) if len(b) >= 100 and first.get(h) != i else None
        want.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if to is not None else "response", to))
    made = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect() if r["error"] is None]
    assert sorted(map(str, made)) == sorted(map(str, want))
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def _record(i, payload):
    return warc.format_record(i, "u", payload, hashlib.sha256(payload).hexdigest(), None, False)


def test_broken_archives_are_told():
    records = [_record(i, b"<p>%d</p>" % i * 30) for i in range(50)]
    good = warc.compress_archive(records)
    assert [r["page_id"] for r in warc.read_archive(good)] == list(range(50))
    assert "error" in list(warc.read_archive(good[:-5]))[-1] and "error" in list(warc.read_archive(good[:20]))[0]
    for bad in (records[0][:-1], records[0].replace(b"WARC/1.1", b"WARX/1.1"), records[0].replace(b"<p>0", b"<p>1"), records[0].replace(b"Content-Length: ", b"Content-Length: 1")):
        assert "error" in list(warc.read_archive(warc.compress_archive([bad])))[0]
    assert list(warc.read_archive(b"")) == []


# ---- packing ----


@pytest.mark.parametrize("seed", range(30))
def test_plans_fill_sequences(seed):
    rng = random.Random(seed)
    hist = {rng.randrange(1, 64): rng.randrange(1, 50) for _ in range(rng.randrange(1, 40))}
    placements, n = packing.plan_packs(hist, 64)
    fill, cover = defaultdict(list), defaultdict(list)
    for length, rank, m, start, piece, sequence, offset in placements:
        for i in range(m):
            fill[sequence + i].append((offset, piece))
            cover[length, rank + i].append((start, piece))
    for parts, full in [(v, None) for v in fill.values()] + [(v, k[0]) for k, v in cover.items()]:
        at = 0
        for start, piece in sorted(parts):
            assert start == at
            at += piece
        assert at <= 64 if full is None else at == full
    assert len(cover) == sum(hist.values()) and set(fill) == set(range(n)) and n == -(-sum(k * v for k, v in hist.items()) // 64)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    own = Tokenizer.from_file(path)
    rng = random.Random(9)
    data = [(i, " ".join(rng.choice(["It's", "Émile", "ÇA", "l'été", "x1y2", "--", "(don't)", "plain", "日本", "áb", "#tag"]) for _ in range(rng.choice([1, 9, 300, 3000]))), 0) for i in range(120)]
    odd = ["a<|endoftext|>b", "<|ENDOFTEXT|> x", "<|startoftext|><|endoftext|>", "q <| r", "A<|endoftext|", "É<|startoftext|>È <|StartOfText|>"]
    data += [(600 + i, t, 0) for i, t in enumerate(odd)]
    data += [(500, None, 0), (501, "", 0), (502, "same", 0), (502, "same", 0), (None, "x <|endoftext|> y", 0)]
    got = packing.pack(spark.createDataFrame(data, "doc_id long, text string, length int")).collect()
    ids = defaultdict(list)
    for i, t, _ in data:
        ids[i].append([*own.encode(t or "", add_special_tokens=False).ids, 2])
    sequences, found = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        found[r["doc_id"]].append(r)
        whole = ids[r["doc_id"]][0]
        assert r["doc_tokens"] == len(whole)
        assert r["ids_crc32"] == zlib.crc32(np.array(whole[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert all(sum(r["length"] for r in found[i]) == sum(map(len, x)) for i, x in ids.items())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.MAX_TOKENS
    assert sum(r["length"] for r in got) > packing.MAX_TOKENS * (len(sequences) - 1)
    assert ids[None][0] == [343, 49407, 344, 2]
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
