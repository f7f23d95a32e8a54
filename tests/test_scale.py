"""Hot keys and plans: what must hold when one key has a large share of the rows."""

import pytest
from pyspark.sql import functions as F

from turnstone.operators import anti_insert, first_uuid_wins, salted_join, term
from turnstone.plans import score_hits, search, topk_per_project
from turnstone.sources import Store
from turnstone.plans import ingest
from turnstone.sources.transcripts import line_pos, raw_lines


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_a_join(spark, how):
    big = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    salted = salted_join(big, small, ["k"], ["id"], how)
    plain = big.join(small, "k", how)
    assert salted.columns == plain.columns
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))


def test_hot_key_is_dealt_over_tasks(spark):
    big = spark.range(8000).select("id", F.lit(1).alias("k"))
    small = spark.createDataFrame([(1, "x")], "k int, v string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        joined = salted_join(big, small, ["k"], ["id"]).withColumn("task", F.spark_partition_id())
        shares = [r["count"] for r in joined.groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(shares) == 8000 and max(shares) < 8000 * 0.6


def test_copies_of_one_id(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("uuid"),
        F.lit("p").alias("project_slug"), "id",
    )
    first = first_uuid_wins(rows, order=["id"])
    assert plan(first).count("WindowGroupLimit") == 2
    assert first.count() == 2001 and first.filter("uuid = 'hot'").first().id == 0
    assert anti_insert(first, rows.filter("uuid = 'hot'")).count() == 2000


def test_one_project_with_most_messages(spark):
    docs = spark.range(600).select(
        F.col("id").cast("string").alias("uuid"),
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 7)).alias("project_slug"),
        F.lit("s").alias("session_id"),
        F.concat(F.lit("word "), F.when(F.col("id") % 5 == 0, "needle ").otherwise(""), F.col("id")).alias("content"),
    )
    hits = score_hits(docs, term("needle"))
    assert hits.count() == 120
    best = topk_per_project(hits, 3)
    assert "CartesianProduct" not in plan(best) and plan(best).count("WindowGroupLimit") >= 2
    assert best.groupBy("project_slug").count().filter("count > 3").count() == 0


def test_a_stored_search_prunes_projects_and_reuses_the_normalised_text(spark, tmp_path):
    values = [
        (f"/p{i % 3}/s{i}.jsonl", '{"type":"user","uuid":"u%d","message":{"role":"user","content":"some needle %d"}}' % (i, i))
        for i in range(12)
    ]
    lines = spark.createDataFrame(values, "file_path string, value string")
    store = Store(spark, str(tmp_path / "store"))
    ingest(store, raw_lines(lines.select("file_path", line_pos().alias("pos"), "value")), 0)
    found = search(store.scan_messages(), store.scan_sessions(), term("needle"), slug="p1", stemmed=False)
    assert {r.message_uuid for r in found.collect()} == {"u1", "u4", "u7", "u10"}
    text = plan(found)
    assert "project_slug" in text.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "[^a-z0-9]+" not in text  # the stored normal form is read, not made again


def test_a_rollup_parses_each_line_once(spark):
    from turnstone.operators import parse_lines, session_rollup

    lines = spark.createDataFrame([("/p/s.jsonl", "{}")], "file_path string, value string")
    raw = raw_lines(lines.select("file_path", line_pos().alias("pos"), "value"))
    rolled = session_rollup(parse_lines(raw))._jdf.queryExecution().optimizedPlan().toString()
    assert rolled.count("VariantExpressionEvalUtils.parseJson") == 1
