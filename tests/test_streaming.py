import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from wirelattice.sources.events import dns_queries, http_requests
from wirelattice.streaming import pipeline as p


def test_cooldown_boundaries(spark):
    assert p.cooled([0, 59.999, 60, 119, 120], None) == ([True, False, True, False, True], 120)
    start = dt.datetime(2024, 1, 1)
    times = [0, 59.999, 60, 119, 120, 300, 310]
    rows = [("k", start + dt.timedelta(seconds=t)) for t in times] + [("j", start)]
    got = p.cooldown_batch(spark.createDataFrame(rows, "key string, ts timestamp")).orderBy("key", "ts").collect()
    assert [(r["key"], (r["ts"] - start).total_seconds()) for r in got] == [("j", 0), ("k", 0), ("k", 60), ("k", 120), ("k", 300)]


def test_stream_equals_batch(spark, sf_dir):
    rows = lambda df: sorted(map(str, df.select("start", "event_type", "n", F.round("mean", 9)).collect()))
    live = p.run_available(p.window_rates(p.event_stream(spark, sf_dir), "event_type", "1 hour"), "t", "complete")
    batch = p.window_rates(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "1 hour")
    assert rows(live) == rows(batch)


def test_stream_cooldown_equals_batch(spark, sf_dir):
    e = p.event_stream(spark, sf_dir).where("event_type = 'error'").select(F.col("event_type").alias("key"), "ts")
    live = p.run_available(p.alert_cooldown(e, 3600), "alerts", "append")
    batch = p.cooldown_batch(http_requests(spark, sf_dir).where("endpoint = '/login'").select(F.lit("error").alias("key"), "ts"), 3600)
    assert sorted(r["ts"] for r in live.collect()) == sorted(r["ts"] for r in batch.collect())


def test_detection_stream_hands_batches_to_the_sink(spark, sf_dir, tmp_path):
    seen = []
    q = p.detect_stream(p.event_stream(spark, sf_dir), lambda df: df.where("event_type = 'error'"), lambda df, n: seen.append(df.count()), str(tmp_path), "1 second")
    q.processAllAvailable()
    q.stop()
    assert sum(seen) > 0


def _sides(spark, queries, requests):
    """Rows (prefix, microseconds since 1970 or None, id) as both sides of the link."""
    side = lambda rows, name: spark.createDataFrame(rows, f"p string, us long, {name} string").select(F.concat("p", F.lit(".9")).alias("src_ip"), F.timestamp_micros("us").alias("ts"), name)
    return side(queries, "query_id"), side(requests, "request_id")


@pytest.mark.parametrize("reach", [0, 1, 300])
def test_link_has_each_pair_within_reach_once(spark, reach):
    s = reach * 1_000_000
    queries = [(net, t, f"q{i}") for net in ("10.0.0", "10.0.1") for i, t in enumerate([0, s, 2 * s, -2 * s, 5 * s + 7, -3 * s - 1, 1_704_067_200_000_000, 1_704_067_200_000_000, None])]
    requests = [(net, t + d, f"r{i}_{d}") for net in ("10.0.0", "10.0.2") for i, (_, t, _) in enumerate(queries[:8]) for d in (-s - 1, -s, -1, 0, 1, s, s + 1)] + [("10.0.0", None, "r")]
    want = sorted((net, q, r) for net, t, q in queries for other, u, r in requests if net == other and None not in (t, u) and abs(t - u) <= s)
    got = p.link_streams(*_sides(spark, queries, requests), reach).select("prefix", "query_id", "request_id")
    assert sorted(map(tuple, got.collect())) == want


def test_link_compares_only_rows_near_in_time(spark):
    rows = [("10.0.0", i * 600_000_000, str(i)) for i in range(100)]
    linked = p.link_streams(*_sides(spark, rows, rows))
    keys = re.search(r"Join \[([^\]]*)\], \[", linked._jdf.queryExecution().executedPlan().toString())[1]
    assert len(keys.split(",")) == 2, keys  # the prefix alone would compare all rows of a prefix
    assert linked.count() == 100


def test_stream_link_equals_batch(spark, sf_dir):
    pages = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/pages.parquet").schema).parquet(f"{sf_dir}/page[s].parquet")
    requests = p.event_stream(spark, sf_dir).where("user_id is not null").select(F.concat(F.lit("10.0.0."), F.col("user_id") % 200).alias("src_ip"), "ts", F.col("event_id").cast("string").alias("request_id"))
    queries = pages.select(F.lit("10.0.0.1").alias("src_ip"), F.timestamp_seconds(1704067200 + F.col("page_id") * 600).alias("ts"), F.col("page_id").cast("string").alias("query_id"))
    live = p.run_available(p.link_streams(queries, requests), "links")
    batch = p.link_streams(dns_queries(spark, sf_dir), http_requests(spark, sf_dir).withColumn("src_ip", F.lit("10.0.0.1")))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "request_id").collect()))
    assert rows(live) == rows(batch) != []
