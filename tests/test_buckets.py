"""Bucketed postings and paragraphs."""

import re

import pytest
from conftest import rows
from test_store import changed, text, versions

from folioseek.operators import buckets, segments
from folioseek.sources.store import Store

DOCS = {f"p/{i:03}": [f"солдат номер{i % 7} тут", "майор штаб", "наказ солдат майор"][: i % 3 + 1] for i in range(60)}
ASKED = [(1, ["солдат"]), (2, ["солдат", "майор"]), (3, ["немає", "солдат"]), (4, ["номер3", "солдат"]), (5, ["майор", "штаб"])]


def test_buckets(spark, tmp_path):
    kept = Store(spark, str(tmp_path / "s"))
    segments.update(kept.snapshot(), versions(spark, DOCS), text(spark, DOCS))
    base = kept.snapshot()
    fresh, dropped = changed(spark, base, ["p/000", "p/001"], ["p/002"])
    segments.update(base, fresh, text(spark, {"p/002": ["майор солдат"]}), dropped)
    assert not buckets.is_current(kept.snapshot())
    now = buckets.write(kept, 4)
    queries = spark.createDataFrame(ASKED, "query_id long, words array<string>")
    want = rows(segments.search_many(now, queries))
    assert len(want) > 50 and rows(buckets.search_many(now, queries)) == want
    assert rows(buckets.read(now, "postings_by_term").select("term", "rev")) == rows(segments.live(now, "postings").select("term", "rev"))
    assert buckets.search_many(now, queries.where("false")).isEmpty()

    # Without broadcasts the bucketed tables still meet the queries where they lie.
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        postings, lines = buckets.read(now, "postings_by_term"), buckets.read(now, "paragraphs_by_document")
        asked = queries.selectExpr("query_id", "explode(words) as term")
        hits = postings.select("rev", "term").limit(1).selectExpr("rev", "0L as position")
        for joined in (postings.join(asked, "term"), postings.join(asked.selectExpr("term", "query_id as rev"), ["term", "rev"]), lines.join(hits, ["rev", "position"])):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
            assert re.search(r"SelectedBucketsCount|Bucketed: true", plan)
        plan = postings.join(asked, "term")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(term") == 1
        plan = postings.join(asked.selectExpr("term", "query_id as rev"), ["term", "rev"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert rows(buckets.search_many(now, queries)) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)

    base = kept.snapshot()
    fresh, dropped = changed(spark, base, ["p/005"], [])
    segments.update(base, fresh, text(spark, {"x": ["y"]}).where("false"), dropped)
    with pytest.raises(ValueError, match="not those"):
        buckets.search_many(kept.snapshot(), queries)
    segments.compact(kept)
    assert not buckets.is_current(kept.snapshot())
