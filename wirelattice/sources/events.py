"""HTTP and DNS event views, and the dimensions beside them.

The driver's tables stand in for captured traffic: ``events`` for HTTP requests, ``pages`` for DNS queries. Everything is a
projection, so filters and columns reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelattice.sources.tables import table

HTTP_SCHEMA = (
    "request_id string, method string, path string, endpoint string, src_ip string, user_agent string, referer string, session_id string, token string, "
    "response_code int, response_time_ms bigint, ts timestamp, headers map<string,string>, body_size bigint, tls_fingerprint string, username string, cache_status string"
)
DNS_SCHEMA = (
    "query_id string, qname string, qtype string, src_ip string, dst_ip string, response_code string, response_time_ms bigint, ts timestamp, answer_count int, "
    "is_response_cached boolean, query_size bigint, response_size bigint, edns_enabled boolean, dnssec_ok boolean"
)
ENDPOINT_SCHEMA = "path string, computational_cost double, is_cacheable boolean, requires_auth boolean, depends_on_db boolean, criticality string, average_response_time_ms bigint"
PROFILE_SCHEMA = (
    "profile_id string, session_id string, header_variability double, fingerprint_variability double, navigation_diversity double, request_interval_avg_ms double, "
    "request_interval_std double, is_bot_like boolean, pattern_type string"
)

#: The endpoints that the event view maps to.
ENDPOINTS = [
    ("/login", 0.8, False, False, True, "high", 1500),
    ("/search", 0.9, False, False, True, "high", 2000),
    ("/api/items", 0.6, True, False, True, "medium", 1600),
    ("/checkout", 0.95, False, True, True, "critical", 0),
    ("/graphql", 0.85, False, True, True, "high", 1000),
]


def http_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as HTTP requests; rows without a time or user are no requests."""
    e = table(spark, sf_dir, "events").where("ts is not null and user_id is not null")
    return e.selectExpr(
        "cast(event_id as string) request_id",
        "case when event_type in ('view', 'click') then 'GET' else 'POST' end method",
        "case event_type when 'view' then '/search' when 'click' then '/api/items' when 'error' then '/login' when 'purchase' then '/checkout' else '/graphql' end endpoint",
        "concat('10.', user_id % 4, '.', user_id % 16, '.', user_id % 200) src_ip",
        "concat('u', user_id) session_id",
        "concat('t', user_id % 50) token",
        "concat('ja', user_id % 8) tls_fingerprint",
        "case when event_type = 'error' then 401 when event_type = 'click' and event_id % 3 = 0 then 400 when event_type = 'signup' and event_id % 2 = 0 then 400"
        " when event_type = 'purchase' and event_id % 10 = 0 then 500 else 200 end response_code",
        "cast(floor(value * 100) as bigint) response_time_ms",
        "cast(ts as timestamp) ts",
    )


def dns_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as DNS queries for their hosts, one every ten minutes, each fifth for a random label below its host."""
    p = table(spark, sf_dir, "pages").where("page_id is not null and url is not null")
    return p.selectExpr(
        "cast(page_id as string) query_id",
        "concat(case when page_id % 5 = 0 then concat(substring(md5(url), 1, 14), '.') else '' end, regexp_extract(url, '://([^/?#]*)', 1)) qname",
        "case page_id % 10 when 0 then 'ANY' when 1 then 'TXT' when 2 then 'AAAA' else 'A' end qtype",
        "concat('10.0.0.', page_id % 8) src_ip",
        "'192.0.2.53' dst_ip",
        "case when page_id % 3 = 0 then 'NXDOMAIN' when page_id % 7 = 0 then 'SERVFAIL' else 'NOERROR' end response_code",
        "cast(page_id % 60 * 100 as bigint) response_time_ms",
        "timestamp_seconds(1704067200 + page_id * 600) ts",
        "cast(40 as bigint) query_size",
        "cast(case when page_id % 10 = 0 then 4000 else 80 end as bigint) response_size",
    )


def endpoints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENDPOINTS, ENDPOINT_SCHEMA)


def with_auto_endpoints(known: DataFrame, http: DataFrame) -> DataFrame:
    """Known endpoints plus those that requests name, with defaults: cost 0.5, cacheable if its first request is a GET, on the database."""
    first = http.groupBy(F.col("endpoint").alias("path")).agg(F.min_by("method", F.struct("ts", "request_id")).alias("m"))
    new = first.join(known, "path", "left_anti").select("path", F.lit(0.5).alias("computational_cost"), (F.col("m") == "GET").alias("is_cacheable"), F.lit(False).alias("requires_auth"), F.lit(True).alias("depends_on_db"), F.lit("medium").alias("criticality"), F.lit(0).cast("bigint").alias("average_response_time_ms"))
    return known.unionByName(new)


def auto_domains(dns: DataFrame) -> DataFrame:
    """Domain rows as queries name them."""
    from wirelattice.functions.scalars import base_domain

    return dns.groupBy(base_domain(F.col("qname")).alias("domain")).agg(F.max("ts").alias("last_query_ts"), F.array_sort(F.collect_set("qtype")).alias("record_types"))


def behavior_profiles(http: DataFrame) -> DataFrame:
    """A profile per session, from its number (the tables hold no headers to measure)."""
    n = F.regexp_replace("session_id", "^u", "").cast("long")
    return http.select("session_id").distinct().select(
        F.concat(F.lit("p_"), "session_id").alias("profile_id"), "session_id", (n % 20 / 20.0).alias("header_variability"), (n % 30 / 30.0).alias("fingerprint_variability"),
        (n % 7 / 7.0).alias("navigation_diversity"), (n % 5 == 0).alias("is_bot_like"),
    )
