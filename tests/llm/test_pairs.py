"""Near-duplicates, embeddings and fingerprints against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from conftest import rows

from folioseek.llm import embeddings, fingerprint, neardup

DOCS = "doc_id long, text string, source string"


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in low.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def components(ids, links):
    label = {i: i for i in ids}
    while True:
        new = dict(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def edited(rng, words, share):
    return [rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def near_docs(seed, n_bases=25):
    rng, out = random.Random(seed), []
    for _ in range(n_bases):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 6, 40, 200, 400]))]
        out.append(" ".join(base))
        out += [" ".join(edited(rng, base, rng.choice([0, 0.005, 0.02, 0.03, 0.1]))) for _ in range(rng.randrange(12))]
    big = [f"v{rng.randrange(4000)}" for _ in range(300)]
    out += [" ".join(edited(rng, big, 0.02)) for _ in range(120)] + [" ".join(big)] * 40
    out += [None, "", " \n\t ", "One two", "ONE  two", "one two three", "É a b c d", "é a b c d", "one\x0btwo"]
    rng.shuffle(out)
    return [(i * 3, t, "s") for i, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    data = near_docs(seed)
    sets = {i: shingles(t) for i, t, _ in data}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(ids, links)
    got = rows(neardup.near_duplicates(spark.createDataFrame(data, DOCS)))
    assert got == [(i, len(sets[i]), want[i], want[i] == i) for i in ids]
    kept = neardup.keep_one(spark.createDataFrame(data, DOCS))
    assert kept.columns == ["doc_id", "text", "source"]
    assert [r[0] for r in rows(kept)] == [i for i in ids if want[i] == i]


def test_crowded_region_is_compared_whole(spark, monkeypatch):
    # A template shared by all keeps them under 0.75, except for some pairs; the neighbours in the trees are others.
    rng = random.Random(5)
    template = [f"t{i}" for i in range(300)]
    tails = [[f"u{rng.randrange(10**9)}" for _ in range(85)] for _ in range(250)]
    tails += [t[:45] + [f"u{rng.randrange(10**9)}" for _ in range(40)] for t in tails[:50]]
    data = [(i, " ".join(template + t), "s") for i, t in enumerate(tails)]
    sets = [shingles(t) for _, t, _ in data]
    links = [(a, b) for a in range(300) for b in range(a + 1, 300) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(range(300), links)
    assert len(links) == 50
    monkeypatch.setattr(neardup, "SETS_BLOCK", 64)
    monkeypatch.setattr(neardup, "BITS_BLOCK", 128)
    got = rows(neardup.near_duplicates(spark.createDataFrame(data, DOCS)))
    assert got == [(i, len(sets[i]), want[i], want[i] == i) for i in range(300)]


def test_near_duplicates_odd_tables(spark):
    same = " ".join(f"x{i}" for i in range(50))
    data = [(1, same, "a"), (1, same, "a"), (2, same + " y", "b"), (None, same, "c"), (3, None, None), (4, "other words here", "d"), (4, same, "d")]
    got = rows(neardup.near_duplicates(spark.createDataFrame(data, DOCS)))
    by = {(i, n): (c, k) for i, n, c, k in got}
    assert len(got) == 7 and by[1, 46] == (1, True) and by[2, 47] == (1, False) and by[None, 46] == (None, False)
    assert by[3, 0] == (3, True) and by[4, 46] == (1, False)
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    assert neardup.keep_one(spark.createDataFrame(data[:2] + data[4:5], DOCS)).count() == 2


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    out = []
    for _ in range(40):
        centre = rng.standard_normal(16)
        out += [centre + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.35]) for _ in range(rng.integers(1, 30))]
    centre = rng.standard_normal(16)
    out += [centre + rng.standard_normal(16) * 0.1 for _ in range(400)]
    out += [out[0], out[0] * 3, out[5] * 1e-200, np.zeros(16), out[2][:8]]
    data = [(i * 2, [float(x) for x in v]) for i, v in enumerate(out)]
    data += [(9001, None), (9003, [1.0, None] + [0.0] * 14), (9005, [math.nan] * 16), (9007, [math.inf] + [0.0] * 15), (9009, [])]
    unit = {i: np.array(v) / np.linalg.norm(np.array(v) / np.abs(v).max()) / np.abs(v).max() for i, v in data if i < 9000 and np.any(np.array(v))}
    ids = sorted(unit)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    want, n = components([i for i, _ in data], links), {i: 0 for i, _ in data}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = rows(embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")))
    right = sum(g == (i, n[i], want[i], want[i] == i) for g, i in zip(got, sorted(n), strict=True))
    assert [g[0] for g in got] == sorted(n)
    assert right >= 0.99 * len(got)
    # Nothing below the threshold.
    assert all(g[1] <= n[g[0]] for g in got)


def test_audit_without_links(spark, monkeypatch):
    # No audited vector has a link: another forest is asked, and what it finds is kept.
    rng = np.random.default_rng(11)
    base = rng.standard_normal((300, 16))
    base = np.r_[base, base[:6] + rng.standard_normal((6, 16)) * 0.05]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.9, 1)), strict=True)]
    want, asked, first = components(range(len(data)), links), [], embeddings._first_lists
    monkeypatch.setattr(embeddings, "_recall", lambda *a: None)
    monkeypatch.setattr(embeddings, "_first_lists", lambda nodes, threshold, seed=77: asked.append(seed) or first(nodes, threshold, seed))
    got = rows(embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")))
    assert [g[2] for g in got] == [want[i] for i in range(len(data))] and len(asked) == 2 and len(set(asked)) == 2


def test_families_joined_by_one_pair(spark):
    rng = np.random.default_rng(8)
    u, v = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    at = lambda degrees: np.cos(np.radians(degrees)) * u + np.sin(np.radians(degrees)) * v
    family = lambda degrees: [at(degrees) + rng.standard_normal(64) * 0.002 for _ in range(60)]
    data = [(i, x.tolist()) for i, x in enumerate([*family(0), at(4), *family(32), at(28)])]
    unit = np.array([x for _, x in data]) / np.linalg.norm([x for _, x in data], axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    assert near[60, 121] and near[:61, 61:].sum() == 1
    got = rows(embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")))
    assert got == [(i, int(near[i].sum()) - 1, 0, i == 0) for i in range(122)]


def test_recall_of_small_groups(spark):
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(64)
    family = [centre + rng.standard_normal(64) * 0.05 for _ in range(150)]
    pairs = [x + rng.standard_normal(64) * 0.05 for x in rng.standard_normal((10, 64)) for _ in range(2)]
    made = embeddings.normalised(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(family + pairs)], "vec_id long, embedding array<double>"))
    nodes = made.withColumnRenamed("vec_id", "id")
    labels = spark.createDataFrame([(i, 0) for i in range(150)], "node long, component long")
    # 22,350 links of the family are found, all 20 of the pairs are not.
    assert embeddings._recall(nodes, labels, 0.9) < 0.1
    edges = embeddings._exact_edges(nodes, 0.9)
    assert rows(embeddings.components(edges)) == [*[(i, 0) for i in range(150)], *[(i, i - i % 2) for i in range(150, 170)]]
    whole = embeddings.components(edges)
    assert embeddings._recall(nodes, whole, 0.9) == 1.0


def test_embeddings_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    data = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [0.0, 1.0], 1)]
    assert rows(embeddings.near_duplicates(spark.createDataFrame(data, schema))) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 0, None, False)]
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).collect() == []


def test_fingerprints(spark):
    data = [(i, t) for i, t, _ in near_docs(3, 15)]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    order = sorted(data, reverse=True)
    errors = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        edit = t[: len(t) - m] + nxt[:m]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        for near, other in ((r["near_edited"], edit), (r["near_next"], nxt)):
            a, b = shingles(t), shingles(other)
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.05 and np.abs(errors).max() < 0.2
    by_text = {}
    for i, t in data:
        by_text.setdefault((t or "").lower(), set()).add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprints_of_unlike_short_texts(spark):
    data = [(i, f"word{i}") for i in range(400)] + [(None, f"null{i}") for i in range(40)] + [(7, f"seven{i}") for i in range(40)]
    got = fingerprint.fingerprints(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len({r["fingerprint"] for r in got}) == len(data)
    assert all(r["near_next"] < 0.25 for r in got) and np.mean([r["near_next"] for r in got]) < 0.05


def test_next_document_of_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 10)
    rng = random.Random(3)
    data = [(i, f"t{i}") for i in range(0, 300, 3)] + [(150, f"hot{i}") for i in range(120)] + [(None, f"null{i}") for i in range(90)]
    rng.shuffle(data)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    pairs = [(r["doc_id"], r["text"], r["next_text"]) for r in fingerprint.with_next(docs, ["text"]).collect()]
    assert sorted(map(str, (p[:2] for p in pairs))) == sorted(map(str, data))
    follows, at, seen = {t: n for _, t, n in pairs}, "t297", []
    ids = {t: i for i, t in data}
    for _ in data:
        seen.append(at)
        at = follows[at]
    assert at == "t297" and len(set(seen)) == len(data)
    assert [ids[t] for t in seen] == sorted((i for i, _ in data if i is not None), reverse=True) + [None] * 90


def test_fingerprints_odd_tables(spark):
    schema = "doc_id long, text string, extra int"
    one = fingerprint.fingerprints(spark.createDataFrame([(5, "a b c", 1)], schema)).first()
    assert one["near_next"] == 1.0 and len(one["fingerprint"]) == 256
    data = [(None, "x y z", 1), (2, None, 1), (2, "q", 1), (2, "q", 1)]
    got = fingerprint.fingerprints(spark.createDataFrame(data, schema)).collect()
    assert len(got) == 4 and {r["fingerprint"] for r in got if r["n_chars"] == 0} == {""}
    assert fingerprint.fingerprints(spark.createDataFrame([], schema)).collect() == []
