"""Deterministic traffic scenarios, and campaigns of any size, as expressions over ``spark.range``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelattice.operators.metrics import Frames
from wirelattice.sources.events import ENDPOINT_SCHEMA

#: The frozen time at which attacks arrive.
T0 = "timestamp'2024-01-01 12:00:00'"
HTTP = ["request_id", "method", "endpoint", "src_ip", "session_id", "token", "tls_fingerprint", "response_code", "response_time_ms", "ts"]
DNS = ["query_id", "qname", "qtype", "src_ip", "dst_ip", "response_code", "response_time_ms", "ts", "query_size", "response_size"]


def _http(spark: SparkSession, tag: str, n: int, method: str, endpoint: str, ip: str, session: str, code: str, rt: str, ts: str = T0) -> DataFrame:
    return spark.range(n).selectExpr(
        f"concat('{tag}', id) request_id", f"'{method}' method", f"'{endpoint}' endpoint", f"{ip} src_ip", f"{session} session_id", "cast(null as string) token", "cast(null as string) tls_fingerprint",
        f"cast({code} as int) response_code", f"cast({rt} as bigint) response_time_ms", f"{ts} ts",
    )


def http_scenario(spark: SparkSession, multi: bool = False) -> Frames:
    """Normal traffic, a flood and failing logins; ``multi`` adds the abuse of an API."""
    ends = [("/login", 0.8, False, False, True, "high", 0), ("/api/products", 0.6, True, False, True, "medium", 0), ("/api/search", 0.9, False, False, True, "high", 0), ("/checkout", 0.95, False, True, True, "critical", 0)]
    ends.append(("/api/graphql", 0.85, False, True, True, "high", 0) if multi else ("/static/js/app.js", 0.1, True, False, False, "low", 0))
    parts = [
        _http(spark, "n", 100, "GET", "/api/products", "concat('192.168.1.', id % 50)", "concat('session_', id % 20)", "200", "50 + id % 30", f"{T0} - make_dt_interval(0, 0, 0, id)"),
        _http(spark, "f", 500, "GET", "/api/search", "concat('203.0.113.', id % 255)", "concat('attack_session_', id % 10)", "200", "200 + id % 50"),
        _http(spark, "l", 50, "POST", "/login", "concat('198.51.100.', id % 100)", "'login_attack_session'", "401", "100"),
    ]
    if multi:
        parts.append(_http(spark, "a", 200, "POST", "/api/graphql", "concat('10.0.0.', id % 50)", "concat('api_abuse_session_', id % 5)", "case when id % 3 = 0 then 400 else 200 end", "150"))
    profiles = spark.range(10).selectExpr("concat('attack_profile_', id) profile_id", "concat('attack_session_', id) session_id", "0.05D header_variability", "0.02D fingerprint_variability", "0.1D navigation_diversity", "true is_bot_like")
    return Frames(reduce(DataFrame.unionByName, parts), dns_scenario_rows(spark).limit(0), spark.createDataFrame(ends, ENDPOINT_SCHEMA), profiles)


def _dns(spark: SparkSession, tag: str, n: int, qname: str, qtype: str, ip: str, code: str, rt: str, ts: str, qs: str, rs: str) -> DataFrame:
    return spark.range(n).selectExpr(
        f"concat('{tag}', id) query_id", f"{qname} qname", f"{qtype} qtype", f"{ip} src_ip", "'8.8.8.8' dst_ip", f"{code} response_code", f"cast({rt} as bigint) response_time_ms", f"{ts} ts", f"cast({qs} as bigint) query_size", f"cast({rs} as bigint) response_size",
    )


def dns_scenario_rows(spark: SparkSession) -> DataFrame:
    """Normal queries and six classes of attack on one base domain."""
    sec = lambda x: f"{T0} + make_dt_interval(0, 0, 0, {x})"
    b64 = "element_at(array('Y2F0YXN0cm9waGU', 'ZGF0YWV4ZmlsdHI', 'c2VjcmV0ZmlsZXM', 'cGFzc3dvcmRkdW1', 'aW50ZXJuYWxkb2N'), cast(id % 5 + 1 as int))"
    parts = [
        _dns(spark, "n", 200, "concat(element_at(array('www', 'api', 'mail', 'cdn', 'www'), cast(id % 5 + 1 as int)), '.example.com')", "element_at(array('A', 'A', 'MX', 'A', 'AAAA'), cast(id % 5 + 1 as int))", "concat('192.168.1.', id % 50)", "'NOERROR'", "10 + id % 20", sec("-1800 + 2 * id"), "30 + id % 10", "60 + id % 30"),
        _dns(spark, "q", 300, "concat(substring(translate(sha2(cast(id as string), 256), 'abcdef', 'qzxkwj'), 1, 15), '.example.com')", "'A'", "concat('203.0.113.', id % 100)", "'NXDOMAIN'", "50 + id % 30", sec("-300 + id"), "65", "100"),
        _dns(spark, "x", 500, "concat('nonexistent', id % 100, '.example.com')", "'A'", "concat('198.51.100.', id % 50)", "'NXDOMAIN'", "30 + id % 20", sec("-200 + id"), "35", "80"),
        _dns(spark, "w", 150, "concat('slow', lpad(id, 4, '0'), '.api.example.com')", "'A'", "concat('10.0.0.', 100 + id % 20)", "case when id % 5 = 0 then 'NOERROR' else 'NXDOMAIN' end", "100 + id % 50", sec("-3600 + 24 * id"), "40", "case when id % 5 = 0 then 60 else 80 end"),
        _dns(spark, "m", 100, "'example.com'", "'ANY'", "concat('1.2.3.', id % 255)", "'NOERROR'", "20", sec("-100 + id"), "30", "4000"),
        _dns(spark, "t", 80, f"concat({b64}, lpad(id, 3, '0'), '.tunnel.example.com')", "'TXT'", "'10.0.0.50'", "'NOERROR'", "150", sec("-80 + id"), "102", "200"),
        _dns(spark, "p", 60, "concat(element_at(array('phantom', 'slow-phanton', 'delayed-phantom'), cast(id % 3 + 1 as int)), '.example.com')", "'A'", "concat('172.16.0.', id % 30)", "case when id % 3 = 0 then 'SERVFAIL' else 'NOERROR' end", "5000 + id", sec("-50 + id"), "40", "80"),
    ]
    return reduce(DataFrame.unionByName, parts)


def dns_scenario(spark: SparkSession) -> Frames:
    empty = http_scenario(spark)
    return Frames(empty.http.limit(0), dns_scenario_rows(spark), empty.endpoints, empty.profiles.limit(0))


def campaign_scenario(spark: SparkSession, k: int, attack: str = "credential_stuffing", requests: int = 20, legitimate: int = 200, seed: int = 1) -> DataFrame:
    """Requests of one campaign of k sessions that share a TLS fingerprint, and of sessions that share nothing; ``campaign_id`` is null for the latter."""
    path, code = {"credential_stuffing": ("/login", "401"), "http_flood": ("/search", "200"), "api_abuse": ("/api/items", "200")}[attack]
    bad = spark.range(k * requests).selectExpr(
        "concat('c', id) request_id", "'POST' method", f"'{path}' endpoint", f"concat('100.', id % {k} % 250, '.', floor(id % {k} / 250), '.1') src_ip", f"concat('bad', id % {k}) session_id", f"concat('tok', id % {k}) token",
        f"'ja-{seed}' tls_fingerprint", f"{code} response_code", "cast(100 as bigint) response_time_ms", f"{T0} + make_dt_interval(0, 0, 0, floor(id / {k}))", "'campaign' campaign_id",
    ).toDF(*HTTP, "campaign_id")
    good = spark.range(legitimate * requests).selectExpr(
        "concat('g', id) request_id", "'GET' method", "element_at(array('/search', '/api/items', '/checkout', '/login'), cast(pmod(xxhash64(id, " + str(seed) + "), 4) + 1 as int)) endpoint",
        f"concat('20.', id % {legitimate} % 250, '.', floor(id % {legitimate} / 250), '.9') src_ip", f"concat('ok', id % {legitimate}) session_id", f"concat('own', id % {legitimate}) token", f"concat('fp', id % {legitimate}) tls_fingerprint",
        "200 response_code", "cast(80 as bigint) response_time_ms", f"{T0} + make_dt_interval(0, 0, 0, floor(id / {legitimate}))", "cast(null as string) campaign_id",
    ).toDF(*HTTP, "campaign_id")
    return bad.unionByName(good)


def tabular(spark: SparkSession, rows: int = 10_000, features: int = 50, attack: float = 0.3, seed: int = 42) -> DataFrame:
    """Two Gaussian classes over ``features`` columns, three of them stretched for attacks."""
    d = spark.range(rows).withColumn("bad", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10_000)) < attack * 10_000)
    stretch = {0: 3.0, 1: 5.0, 4: 4.0}
    columns = [F.when(F.col("bad"), (2 + 0.5 * F.randn(seed + i)) * stretch.get(i, 1.0)).otherwise(F.randn(seed + i)).alias(f"feature_{i}") for i in range(features)]
    return d.select("id", *columns, F.when(F.col("bad"), "HTTP_Flood").otherwise("Benign").alias("Label"))
