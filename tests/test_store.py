"""Manifests, conflicts, pins, turns and segments."""

import os
import random
import threading
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from folioseek.operators import index, maintenance, segments
from folioseek.sources.store import Conflict, Store


def numbers(spark, *ns):
    return spark.createDataFrame([(n,) for n in ns], "n long")


def test_commits_and_references(spark, tmp_path):
    kept = Store(spark, str(tmp_path / "s"))
    assert kept.current() is None and kept.snapshot().number == 0
    with pytest.raises(FileNotFoundError):
        kept.read("a")
    first = kept.commit(a=numbers(spark, 1), b=numbers(spark, 2))
    second = kept.commit(first, append={"a": numbers(spark, 3)}, properties={"x": 5})
    assert (first.number, second.number, kept.current()) == (1, 2, 2)
    # The table that was not touched is the same folder, the appended one keeps its rows where they are.
    assert second.tables["b"] == first.tables["b"] and second.tables["a"][0] == first.tables["a"][0]
    assert rows(second.read("a")) == [(1,), (3,)] and rows(first.read("a")) == [(1,)] and second.properties == {"x": 5}
    third = kept.commit(second, drop=("b",))
    assert not third.has("b") and third.properties == {"x": 5}
    with pytest.raises(Conflict):
        kept.commit(second, a=numbers(spark, 9))
    assert rows(kept.read("a")) == [(1,), (3,)]


def test_no_commit_is_lost(spark, tmp_path):
    kept, tries = Store(spark, str(tmp_path / "s")), []
    kept.commit(a=numbers(spark))

    def add(n):
        def step(base):
            tries.append(n)
            return Store(spark, str(tmp_path / "s")).commit(base, append={"a": numbers(spark, n)})

        kept.updated(step)

    writers = [threading.Thread(target=add, args=(n,)) for n in range(6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert rows(kept.read("a")) == [(n,) for n in range(6)] and kept.numbers() == list(range(1, 8))
    assert len(tries) >= 6 and os.listdir(tmp_path / "s/_pins") == []


def test_one_of_many_creates_a_file(spark, tmp_path):
    kept, made = Store(spark, f"file://{tmp_path}/s"), []
    for k in range(5):
        both = threading.Barrier(4)

        def race(k=k, both=both):
            both.wait()
            made.append((k, kept._create(f"x/{k}", "content")))

        threads = [threading.Thread(target=race) for _ in range(4)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    assert sorted(made) == sorted([(k, False) for k in range(5)] * 3 + [(k, True) for k in range(5)])
    assert kept._names("x") == [str(k) for k in sorted(range(5))] or sorted(kept._names("x")) == [str(k) for k in range(5)]


def test_vacuum_keeps_what_is_pinned_or_young(spark, tmp_path):
    kept = Store(spark, str(tmp_path / "s"))
    kept.commit(a=numbers(spark, 1))
    with kept.pinned() as old:
        kept.commit(a=numbers(spark, 2))
        kept.commit(a=numbers(spark, 3))
        loose = kept.written("a", numbers(spark, 4))  # a commit under way
        assert kept.vacuum() == 0
        assert (tmp_path / "s" / loose).exists()
        assert kept.vacuum(grace=0) == 1
        assert rows(old.read("a")) == [(1,)] and kept.numbers() == [1, 3] and not (tmp_path / "s" / loose).exists()
    assert kept.vacuum(grace=0) == 1 and rows(kept.read("a")) == [(3,)] and len(os.listdir(tmp_path / "s/data")) == 1
    with kept.pinned():  # a reader that has died
        kept.commit(a=numbers(spark, 5))
        time.sleep(0.01)
        assert kept.vacuum(grace=0, stale=0) == 1


def test_turns(spark, tmp_path):
    kept, order = Store(spark, f"file://{tmp_path}/s"), []

    def work(name, hold):
        with kept.locked():
            order.append((name, "in"))
            time.sleep(hold)
            order.append((name, "out"))

    threads = [threading.Thread(target=work, args=(n, 0.3)) for n in "abc"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [w for _, w in order] == ["in", "out"] * 3 and all(order[k][0] == order[k + 1][0] for k in (0, 2, 4))


def test_a_long_writer_keeps_its_turn(spark, tmp_path):
    kept = Store(spark, f"file://{tmp_path}/s")
    with kept.locked(lease=0.8):
        time.sleep(2)  # more than a lease: it is renewed meanwhile
        with pytest.raises(TimeoutError), kept.locked(patience=0.2, lease=0.8):
            pass
    with kept.locked(patience=0):
        pass


def test_a_dead_writers_turn_ends_with_its_lease(spark, tmp_path):
    kept = Store(spark, f"file://{tmp_path}/s")
    assert kept._create("_turns/7", "")  # nobody renews it
    with pytest.raises(TimeoutError), kept.locked(patience=0.1, lease=1.0):
        pass
    time.sleep(1.2)
    with kept.locked(patience=0, lease=1.0) as turn:
        assert turn == 8
        # The dead one comes back to life: its end is not that of the present holder.
        kept._write("_turns/7.over", "")
        with pytest.raises(TimeoutError), kept.locked(patience=0.1, lease=1.0):
            pass


# ---- segments ----


def versions(spark, docs):
    return spark.createDataFrame([(None, p, p.split("/")[-1]) for p in docs], "doc_key long, file_path string, file_name string")


def text(spark, docs):
    data = [(p, i, t, 0) for p, ts in docs.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(data, "file_path string, position long, text string, line_breaks_after long")


def changed(spark, base, gone, again):
    """(fresh, dropped) for paths that end or have new text."""
    known = segments.live(base, "documents")
    ended = spark.createDataFrame([(p, True) for p in gone] + [(p, False) for p in again], "file_path string, gone boolean")
    dropped = known.join(ended, "file_path").select("rev", "doc_key", "gone")
    return known.where(F.col("file_path").isin(list(again))).select("doc_key", "file_path", "file_name"), dropped


def flat(postings):
    return sorted((r["term"], r["doc_index"], tuple(r["positions"])) for r in postings.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_updates_equal_a_rebuild(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(segments, "KEYS_BLOCK", 3)
    rng, kept = random.Random(seed), Store(spark, str(tmp_path / "s"))
    words = ["солдат", "сержант", "майор", "штаб", "наказ", "полк"]
    made = lambda: [" ".join(rng.choices(words, k=3)) for _ in range(rng.randrange(1, 4))]
    held = {}  # in the order of insertion
    for turn in range(4):
        gone = rng.sample(sorted(held), min(len(held), rng.randrange(3)))
        again = rng.sample(sorted(set(held) - set(gone)), min(len(held) - len(gone), rng.randrange(3)))
        new = sorted(f"p/{turn}{k}" for k in range(rng.randrange(1, 6)))
        docs = {p: made() for p in [*again, *new]}
        base = kept.snapshot()
        fresh, dropped = versions(spark, new), None
        if turn:
            old, dropped = changed(spark, base, gone, again)
            fresh = fresh.unionByName(old)
        segments.update(base, fresh, text(spark, docs), dropped)
        held = {p: t for p, t in held.items() if p not in gone}
        held |= {p: docs[p] for p in again}
        held |= {p: docs[p] for p in new}
        if turn == 2 and seed == 2:
            assert segments.compact(kept)
    want = spark.createDataFrame([(d, i, t) for d, ts in enumerate(held.values()) for i, t in enumerate(ts)], "doc_index long, position long, text string")
    now = kept.snapshot()
    assert flat(segments.numbered(now, "postings")) == flat(index.build(want))
    assert [r["file_path"] for r in segments.numbered(now, "documents").orderBy("doc_index").collect()] == list(held)
    assert now.properties["documents"] == len(held)
    for query in ("солдат", "солдат майор"):
        found = {r["doc_index"]: [m["position"] for m in r["matches"]] for r in segments.search(now, query).collect()}
        named = want.withColumn("file_name", F.lit("x"))
        from folioseek.operators import search

        assert found == {r["doc_index"]: [m["position"] for m in r["matches"]] for r in search.search(query, named, len(held), index.build(want)).collect()}
    assert segments.compact(kept) and flat(segments.numbered(kept.snapshot(), "postings")) == flat(index.build(want))
    assert not segments.compact(kept)


def test_update_writes_what_changed(spark, tmp_path):
    kept = Store(spark, str(tmp_path / "s"))
    docs = {f"p/{i:04}": [f"солдат номер {i}", "штаб"] for i in range(400)}
    segments.update(kept.snapshot(), versions(spark, docs), text(spark, docs))
    base = kept.snapshot()
    fresh, dropped = changed(spark, base, ["p/0000"], ["p/0007", "p/0008", "p/0009"])
    segments.update(base, fresh, text(spark, {f"p/000{k}": ["майор"] for k in (7, 8, 9)}), dropped)
    now = kept.snapshot()
    assert all(now.tables[t][0] == base.tables[t][0] for t in ("documents", "paragraphs", "postings"))
    added = {t: spark.read.parquet(f"{tmp_path}/s/{now.tables[t][-1]}").count() for t in now.tables}
    assert added == {"documents": 3, "paragraphs": 3, "outline": 3, "postings": 3, "sizes": 3, "deleted": 4}
    kinds = ("postings_added", "positions_added", "postings_removed", "positions_removed", "postings", "positions")
    live = segments.live(now, "postings").select(F.count("term"), F.sum(F.size("positions"))).first()
    assert [now.properties[k] for k in kinds] == [3, 3, 12, 12, *live]
    assert tuple(live) == (3 + 6 * 3 + 390 * 4,) * 2  # one digit is no term
    quick = [r["doc_index"] for r in segments.search(now, "майор", "remaining").collect()]
    assert quick == [6, 7, 8] and segments.search(now, "солдат", "quick").count() == 170 and segments.search(now, "солдат", "remaining").count() == 226
    with pytest.raises(ValueError):
        segments.search(now, "солдат", "best")
    results, counts = segments.request(now, "солдат")
    assert counts == {"count": 170, "total_count": 399} and results.first()["doc_index"] >= 229


def test_repair_writes_postings_only(spark, tmp_path):
    kept = Store(spark, str(tmp_path / "s"))
    docs = {"a": ["солдат"], "b": ["майор солдат"]}
    made = segments.update(kept.snapshot(), versions(spark, docs), text(spark, docs))
    good = flat(segments.numbered(made, "postings"))
    bad = made.read("postings").unionByName(made.read("postings").where("rev = 1")).unionByName(spark.createDataFrame([("зайве", 9, [0])], "term string, rev long, positions array<long>"))
    broken = kept.commit(made, postings=bad)
    assert maintenance.validate_and_repair(kept) == {"unknown_documents": 1, "cleaned": 0, "duplicates": 2}
    now = kept.snapshot()
    assert flat(segments.numbered(now, "postings")) == good and now.tables["paragraphs"] == broken.tables["paragraphs"]
    assert not maintenance.rebuild_if_needed(kept)
    for part in (tmp_path / "s" / now.tables["postings"][0]).glob("*part-*.parquet*"):
        part.write_bytes(b"no parquet") if part.suffix == ".parquet" else part.unlink()
    assert maintenance.rebuild_if_needed(kept) and flat(segments.numbered(kept.snapshot(), "postings")) == good


def test_rebuild_leaves_other_errors_alone():
    from pyspark.errors import SparkRuntimeException

    assert not maintenance._unreadable(SparkRuntimeException("Job aborted: executor lost"))
    assert maintenance._unreadable(FileNotFoundError())
