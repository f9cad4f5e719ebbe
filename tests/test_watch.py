"""Events from listings in a stream."""

import pytest
from conftest import rows

from folioseek.streaming import watch


@pytest.fixture
def state(spark):
    before = {k: spark.conf.get(k, None) for k in watch.PROVIDER}
    for k, v in watch.PROVIDER.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def drain(spark, tmp_path):
    query = (
        watch.events(spark, str(tmp_path / "passes")).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(300)
    return rows(spark.read.parquet(str(tmp_path / "out")).select("pass", "path", "event", "size", "mtime_s"))


def note(spark, tmp_path, number, files):
    listing = spark.createDataFrame([(p, *v) for p, v in files.items()], "path string, size long, mtime_s long")
    assert watch.record_listing(listing, str(tmp_path / "passes")) == number


def test_events_of_passes(spark, tmp_path, state):
    note(spark, tmp_path, 1, {"a": (1, 10), "b": (1, 10), "c": (1, 10)})
    got = drain(spark, tmp_path)
    assert got == [(1, p, "new", 1, 10) for p in "abc"]
    # Another size, another time, one gone; a restart from the checkpoint tells no event again.
    note(spark, tmp_path, 2, {"a": (2, 10), "b": (1, 11), "d": (1, 10)})
    got = drain(spark, tmp_path)
    assert got == [*[(1, p, "new", 1, 10) for p in "abc"], (2, "a", "changed", 2, 10), (2, "b", "changed", 1, 11), (2, "c", "deleted", 1, 10), (2, "d", "new", 1, 10)]
    # Back again, unchanged ones are no events, and an empty folder ends all.
    note(spark, tmp_path, 3, {"a": (2, 10), "c": (1, 10)})
    note(spark, tmp_path, 4, {})
    more = drain(spark, tmp_path)[len(got) :]
    assert [r for r in more if r[2] == "new"] == [(3, "c", "new", 1, 10)]
    final = drain(spark, tmp_path)
    assert [r[:3] for r in final if r[2] == "deleted"] == [(2, "c", "deleted"), (3, "b", "deleted"), (3, "d", "deleted"), (4, "a", "deleted"), (4, "c", "deleted")]


def test_passes_read_at_once(spark, tmp_path, state):
    for number, files in enumerate(({"a": (1, 1), "b": (1, 1)}, {"b": (1, 2)}, {"a": (1, 1), "b": (1, 2)}, {"b": (1, 2)}), 1):
        note(spark, tmp_path, number, files)
    got = [r[:3] for r in drain(spark, tmp_path)]
    assert got == [(1, "a", "new"), (1, "b", "new"), (2, "a", "deleted"), (2, "b", "changed"), (3, "a", "new"), (4, "a", "deleted")]


def test_a_folder_is_watched(spark, tmp_path, state):
    from test_sources import make_docx

    make_docx(tmp_path / "in/a.docx", ["x"])
    (tmp_path / "in/b.txt").write_text("no document")
    watch.record(spark, str(tmp_path / "in"), str(tmp_path / "passes"))
    assert [r[1:3] for r in drain(spark, tmp_path)] == [("a.docx", "new")]
