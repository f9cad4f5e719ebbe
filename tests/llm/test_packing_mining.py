"""Bin-slack packing, hard negatives and the divergence audit against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import rows

from folioseek.llm import binslack, divergence, hardneg, packing
from folioseek.llm.common import table
from folioseek.llm.queries import queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
LONG = " ".join(f"word{i % 977} and" for i in range(60_000))


# ---- minimum bin slack ----


def reachable(counts, room):
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * m for s in sums for m in range(n + 1) if s + k * m <= room}
    return max(sums)


@pytest.mark.parametrize("seed", range(8))
def test_fullest_combination(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 60): rng.randrange(1, 6) for _ in range(rng.randrange(0, 9))}
    for room in (0, 1, 7, 50, 97, 200):
        found = binslack.fullest(sorted((k for k in counts if k <= room), reverse=True), counts, room)
        assert sum(k * n for k, n in found.items()) == reachable(counts, room)
        assert all(0 < n <= counts[k] for k, n in found.items())


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    room = rng.choice([16, 64, 100])
    histogram = Counter(rng.randrange(1, room) for _ in range(rng.choice([0, 3, 400])))
    plan, bins = binslack.plan_bins(histogram, room)
    held, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, sequence, offset in plan:
        for k in range(n):
            held[sequence + k].append((offset, length))
            ranks[length].append(rank + k)
    assert {k: sorted(r) for k, r in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    assert sorted(held) == list(range(bins))
    for items in held.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= room
    # A first-fit-decreasing packing needs no fewer.
    gaps = []
    for k in sorted(histogram.elements(), reverse=True):
        at = next((i for i, g in enumerate(gaps) if g >= k), None)
        if at is None:
            gaps.append(room)
            at = len(gaps) - 1
        gaps[at] -= k
    assert bins <= len(gaps)


def packed_ids(spark, docs, **options):
    cut, placed = binslack.pack(docs, **options)
    return cut, placed, rows(cut.join(placed, "piece_id").select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"))


def check_packing(got, texts, room):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(binslack.default_tokenizer())
    want = Counter()
    for doc_id, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.update((doc_id, k, k * room, len(ids[k * room : (k + 1) * room]), ids[k * room : (k + 1) * room].tobytes()) for k in range(-(-len(ids) // room)))
    assert Counter((d, p, s, n, bytes(i)) for d, p, s, n, i, _, _ in got) == want
    by = defaultdict(list)
    for *_, n, _, sequence, offset in ((r[0], r[3], r[4], r[5], r[6]) for r in got):
        by[sequence].append((offset, n))
    for items in by.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= room
    return len(by), sum(r[3] for r in got)


def test_packing_of_odd_tables(spark):
    texts = [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (None, "a b"), (4, LONG), (5, " \n "), (6, "<|endoftext|> x É ß")]
    texts += [(10 + i, "w " * (i % 40)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, piece_id string")
    for room in (4096, 64):
        cut, placed, got = packed_ids(spark, docs, room=room)
        n, total = check_packing(got, texts, room)
        assert n <= -(-total // room) + 1
    found = rows(binslack.sequences(cut, placed).select("sequence_id", "ids", "lengths"))
    assert sum(len(r[1]) for r in found) == 4 * total and all(len(r[1]) == 4 * sum(r[2]) for r in found)
    assert packed_ids(spark, docs.where("false"))[2] == []


def test_binslack_query(spark):
    docs = rows(table(spark, SF, "documents").select("doc_id", "text"))
    got = rows(queries()["op11_binslack"](spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
    full = packed_ids(spark, table(spark, SF, "documents"))[2]
    n, total = check_packing(full, docs, 4096)
    assert {(r[0], r[1], r[2], r[3], zlib.crc32(r[4])) for r in full} == {r[:5] for r in got}
    assert len({r[5] for r in got}) == n == -(-total // 4096)


# ---- hard negatives ----


def brute_negatives(data, positives=5, negatives=10):
    held = [
        (i, lab, np.array([math.floor(256 * x) for x in v], object))
        for i, v, lab in data
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, lab, v in held:
        if i % 100:
            continue
        scored = [(-int((v * w).sum()) if len(v) else 0, j, other) for j, other, w in held if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == lab)[:positives]:
            fit = sorted(x for x in scored if x[2] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s)[:negatives]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fit)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label long"


@pytest.mark.parametrize(("seed", "dims", "size"), [(1, 16, 0.4), (2, 5, 30.0), (3, 20, 1e5)])
def test_hard_negatives(spark, monkeypatch, seed, dims, size):
    monkeypatch.setattr(hardneg, "BLOCK", 7)
    monkeypatch.setattr(hardneg, "CHUNK", 4)
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    data = [(i * 20, [float(x) for x in (centres[i % 6] + rng.standard_normal(dims) * 0.7) * size], int(i * 7 % 4)) for i in range(220)]
    data += [(5000 + i, data[i % 3][1], i % 2) for i in range(60)]  # a family of copies: ties
    got = rows(hardneg.mine(spark.createDataFrame(data, VECTORS).repartition(5), "vec_id % 100 = 0"))
    assert got == brute_negatives(data)
    assert len(got) > 100


def test_hard_negatives_of_odd_tables(spark):
    ok = [1.0, 0.5, -0.25]
    data = [(0, ok, 1), (100, ok, 1), (1, ok, 1), (2, [0.5, 0.25, 0.1], 2), (3, [0.4, 0.4, 0.4], 3), (4, None, 2), (5, ok, None), (None, ok, 2), (6, [1.0, None, 0.0], 2)]
    data += [(7, [math.nan] * 3, 2), (8, [math.inf, 0.0, 0.0], 2), (9, [0.5, 0.5], 2), (200, [], 1), (201, [], 1), (202, [], 2), (300, [-1.0, -0.5, 0.25], 1)]
    docs = spark.createDataFrame([(*r, "x") for r in data], VECTORS + ", slices string")
    got = rows(hardneg.mine(docs, "vec_id % 100 = 0"))
    assert got == brute_negatives(data) and {r[0] for r in got} == {0, 100, 200}
    assert rows(hardneg.mine(docs.where("false"), "vec_id % 100 = 0")) == []
    assert rows(hardneg.mine(docs, "vec_id < 0")) == []
    # Rows of one vec_id: each is a candidate of its own, none is its own anchor's partner.
    twice = spark.createDataFrame([(0, ok, 1), (1, ok, 1), (1, ok, 1), (2, [0.5, 0.25, 0.1], 2), (2, [0.5, 0.25, 0.1], 2)], VECTORS)
    assert [r[:4] for r in rows(hardneg.mine(twice, "vec_id % 100 = 0"))] == [(0, 1, 1, 2), (0, 1, 1, 2), (0, 1, 2, 2), (0, 1, 2, 2)]
    with pytest.raises(ValueError, match="no longs"):
        hardneg.mine(spark.createDataFrame([(0, [1e300], 1)], VECTORS), "vec_id = 0")


def test_planes_hold_the_numbers(spark):
    data = [(1, [0.0, -1.0, 0.999, -0.001, 3.0], 0), (2, [1.5], 0), (3, [], 0)]
    q = hardneg.quantised(spark.createDataFrame(data, VECTORS))
    bits = hardneg._bits(q)
    assert bits == 10
    for r in hardneg.sliced(q, bits).collect():
        planes = hardneg._planes([bytes(r["slices"])], bits, r["dims"])
        want = [math.floor(256 * x) for x in next(v for i, v, _ in data if i == r["vec_id"])]
        assert np.tensordot(hardneg._weights(bits), planes.astype(np.int64), 1)[0].tolist() == want


# ---- source divergence ----


def brute_audit(data, least=10, top=10):
    found = [(lang or "", source or "", Counter("".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall(divergence.TERM, text or ""))) for _, text, lang, source in data]
    out = []
    for lang in {x[0] for x in found}:
        df = Counter(t for g, _, c in found if g == lang for t in c)
        kept = {t for t, n in df.items() if n >= least}
        by = defaultdict(Counter)
        for g, source, c in found:
            if g == lang:
                by[source].update({t: n for t, n in c.items() if t in kept})
        total = sum(by.values(), Counter())

        def share(c, t, v=len(kept)):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        for s, c in by.items():
            pairs = sorted((-sum(apart(share(c, t), share(d, t)) for t in kept), o.encode()) for o, d in by.items() if o != s)
            terms = sorted((-apart(share(c, t), share(total, t)), t.encode()) for t in kept if c[t] and share(c, t) > share(total, t))[:top]
            out += [(lang, s, part, item.decode(), -v, k + 1) for part, x in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(x)]
    return sorted(out)


def audit_docs(seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "THE", "İx", "Été", "été", "naïve", "it's", "a_b", "x1y", "日本語", "🙂", "don", "t"] + [f"w{chr(97 + i)}" for i in range(20)]
    data = [(i, " ".join(rng.choices(words[i % 5 :], k=rng.randrange(1, 60))), "en", f"s{rng.choice("aaab")}{i % 5}") for i in range(150)]
    data += [(200 + i, "nur zwei Wörter", "de", "s") for i in range(9)] + [(300 + i, "sólo", "es", f"e{i % 2}") for i in range(10)]
    data += [(400, None, "en", "silent"), (401, "12 34", None, None), (402, None, None, "x"), (403, "", "xx", "")]
    return data + data[:20]


def test_divergence(spark, monkeypatch):
    data = audit_docs()
    docs = spark.createDataFrame([(*r, 1) for r in data], DOCS + ", term int").repartition(5)
    want = brute_audit(data)
    assert rows(divergence.audit(docs)) == want
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    assert rows(divergence.audit(docs)) == want
    assert rows(divergence.audit(docs.where("false"))) == []


def test_divergence_of_a_long_text(spark):
    data = [(0, LONG, "en", "long")] + [(i, "word and more", "en", "short") for i in range(1, 12)]
    assert rows(divergence.audit(spark.createDataFrame(data, DOCS))) == brute_audit(data)


def test_letters_that_lower_changes(spark):
    import pyspark.sql.functions as F

    found = spark.createDataFrame([(chr(i),) for i in range(0x80, 0x20000) if not 0xD800 <= i < 0xE000], "c string")
    assert found.where((F.lower("c") != F.col("c")) & ~F.col("c").rlike(divergence.MAY_CHANGE)).collect() == []


def test_shares_beyond_a_long(spark):
    import pyspark.sql.functions as F

    n = 5 * 10**17
    found = spark.range(1).select(divergence._share(F.lit(n), F.lit(2 * n))).first()[0]
    assert found == 1 + 10**9 * (n + 2) // (2 * n)


def test_simple_texts_are_cut_into_pieces_without_their_words():
    """Texts of plain letters, apostrophes and white space of any kind get the tokenizer's ids; none of their words is learned, other texts' words are."""
    path = packing.default_tokenizer()
    tokenizer, words, *_ = packing._loaded(path)
    words.clear()
    simple = ["It's they'LL ['s 's't ''re x'vevm I'D", "\tÀÖß Øÿ\x0b\x0c12345 a1b2--c..!\r\n", "", " ", "Straße's", "~`^|><"]
    others = ["<|x it's", "тест it's", "ﬁ é x", "a b"]
    want = lambda ts: [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in ts]
    assert packing.encode_texts([t.encode() for t in simple], path) == want(simple) and not words
    mixed = [*others[:2], *simple, *others[2:]]
    assert packing.encode_texts([t.encode() for t in mixed], path) == want(mixed) and b"it's" in words
