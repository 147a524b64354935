"""Running statistics as aggregates.

Requests are first reduced by (session, endpoint), with map-side combine; endpoint and session metrics are second-level sums over
that small table, so neither a hot endpoint nor a hot session meets in one task row by row, and distinct counts become plain counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelattice.functions.scalars import base_domain, char_entropy, endpoint_class, guarded_ratio, is_random_label, rate, subdomain


def session_endpoint(http: DataFrame) -> DataFrame:
    """Partial sums by session (null if empty) and endpoint."""
    rt = F.col("response_time_ms")
    return http.groupBy(F.nullif("session_id", F.lit("")).alias("session_id"), "endpoint").agg(
        F.count("*").alias("n"), F.sum(rt).alias("rt"), F.sum(rt.cast("decimal(20,0)") * rt).alias("rt2"), F.count_if(F.col("response_code") >= 400).alias("errors"),
        F.count_if(F.col("response_code").isin(401, 403) & (endpoint_class(F.col("endpoint")) == "Auth")).alias("failed"), F.min("ts").alias("first"), F.max("ts").alias("last"),
    )


def endpoint_metrics(parts: DataFrame) -> DataFrame:
    """Per endpoint: counts, mean response time, error rate, rate, distinct sessions."""
    a = parts.groupBy("endpoint").agg(F.sum("n").alias("n"), F.sum("rt").alias("rt"), F.sum("errors").alias("errors"), F.count("session_id").alias("unique_sessions"), F.min("first").alias("first"), F.max("last").alias("last"))
    return a.select(
        "endpoint", F.col("n").alias("request_count"), (F.col("rt") / F.col("n")).alias("avg_response_time_ms"), (F.col("errors") / F.col("n")).alias("error_rate"),
        rate(F.col("n"), F.col("first"), F.col("last")).alias("requests_per_second"), "unique_sessions",
    )


def session_metrics(parts: DataFrame) -> DataFrame:
    """Per session: counts, rate, diversity, response times, errors, failed logins, the endpoint it asks most (ties by name)."""
    a = parts.where("session_id is not null").groupBy("session_id").agg(
        F.sum("n").alias("n"), F.count("*").alias("unique_endpoints"), F.sum("rt").alias("rt"), F.sum("rt2").alias("rt2"), F.sum("errors").alias("errors"), F.sum("failed").alias("failed"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.min(F.struct((-F.col("n")).alias("k"), "endpoint")).alias("top"),
    )
    mean = F.col("rt") / F.col("n")
    return a.select(
        "session_id", F.col("n").alias("request_count"), rate(F.col("n"), F.col("first"), F.col("last")).alias("requests_per_second"), (F.col("unique_endpoints") / F.col("n")).alias("navigation_diversity"),
        "unique_endpoints", mean.alias("avg_response_time_ms"), F.sqrt(F.greatest(F.lit(0.0), F.col("rt2").cast("double") / F.col("n") - mean * mean)).alias("response_time_std"),
        F.col("errors").alias("error_count"), F.col("failed").alias("failed_logins"), F.col("top.endpoint").alias("target_endpoint"), F.col("first").alias("created_at"), F.col("last").alias("last_activity"),
    )


def session_state(http: DataFrame) -> DataFrame:
    """Per session: first and last activity by event time, identity, address and fingerprint of its first request, and counts with and without that one."""
    at = F.struct("ts", "request_id")
    first = lambda c: F.min_by(c, at)
    return http.where("session_id <> ''").groupBy("session_id").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_activity"), F.count("*").alias("request_count"), (F.count("*") - 1).alias("later_requests"),
        F.coalesce(first("token"), F.lit("anonymous")).alias("identity"), first("src_ip").alias("src_ip"), first("tls_fingerprint").alias("fingerprint"),
    )


def dns_named(dns: DataFrame) -> DataFrame:
    named = dns.withColumn("base_domain", base_domain(F.col("qname"))).withColumn("sub", subdomain(F.col("qname")))
    return named.withColumn("entropy", char_entropy(F.col("sub"))).withColumn("random", is_random_label(F.col("sub")))


def dns_ip_metrics(named: DataFrame) -> DataFrame:
    """Per source address: counts, rates and the shares that the tunnel and randomness rules weigh."""
    has = F.col("sub") != ""
    a = named.groupBy("src_ip").agg(
        F.count("*").alias("query_count"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.countDistinct("base_domain").alias("unique_domains"), F.count_if(F.col("response_code") == "NXDOMAIN").alias("nxdomain_count"),
        F.count_if(F.col("random") & has).alias("random_subdomain_count"), F.count_if(has).alias("subs"), F.countDistinct("qtype").alias("unique_qtypes"), F.avg(F.when(has, F.length("sub"))).alias("len"),
        F.avg(F.when(F.length("sub") >= 4, F.col("entropy"))).alias("ent"), F.countDistinct(F.when(has, F.col("sub"))).alias("unique_subdomains"), F.count_if(F.col("qtype") == "ANY").alias("any_count"),
        F.count_if(F.col("qtype") == "TXT").alias("txt_count"), F.count_if(F.length("sub") > 20).alias("long_count"), F.count_if(F.col("entropy") > 3.5).alias("high_entropy_count"),
    )
    n, subs = F.col("query_count"), F.col("subs")
    return a.select(
        "src_ip", "query_count", rate(n, F.col("first"), F.col("last")).alias("queries_per_second"), "unique_domains", "nxdomain_count", (F.col("nxdomain_count") / n).alias("nxdomain_ratio"),
        "random_subdomain_count", guarded_ratio(F.col("random_subdomain_count"), subs).alias("random_subdomain_ratio"), "unique_qtypes", F.coalesce("len", F.lit(0.0)).alias("avg_subdomain_length"),
        F.coalesce("ent", F.lit(0.0)).alias("subdomain_entropy_avg"), "unique_subdomains", "any_count", guarded_ratio(F.col("txt_count"), n).alias("txt_ratio"), guarded_ratio(F.col("long_count"), subs).alias("long_ratio"),
        guarded_ratio(F.col("high_entropy_count"), subs).alias("high_entropy_ratio"),
    )


def dns_primary_domain(named: DataFrame) -> DataFrame:
    """Per source address the base domain that it asks most (ties by name)."""
    return named.groupBy("src_ip", "base_domain").count().groupBy("src_ip").agg(F.min(F.struct((-F.col("count")).alias("k"), "base_domain")).alias("t")).select("src_ip", F.col("t.base_domain").alias("primary_domain"))


def dns_domain_metrics(named: DataFrame) -> DataFrame:
    """Per base domain: counts, rates, timeouts and the steadiness of its queries."""
    slow = (F.col("response_code") == "SERVFAIL") | (F.col("response_time_ms") > 5000)
    a = named.groupBy("base_domain").agg(
        F.count("*").alias("query_count"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.countDistinct("src_ip").alias("unique_src_ips"), F.countDistinct(F.when(F.col("sub") != "", F.col("sub"))).alias("unique_subdomains"),
        F.count_if(F.col("response_code") == "NXDOMAIN").alias("nx"), F.avg("response_time_ms").alias("avg_response_time_ms"), F.count_if(slow).alias("timeout_count"),
    )
    n = F.col("query_count")
    return a.select(
        "base_domain", "query_count", rate(n, F.col("first"), F.col("last")).alias("queries_per_second"), "unique_src_ips", "unique_subdomains", (F.col("nx") / n).alias("nxdomain_ratio"), "avg_response_time_ms", "timeout_count",
        (F.col("timeout_count") / n).alias("timeout_ratio"),
    )


def interval_stats(named: DataFrame) -> DataFrame:
    """Per base domain the mean and population deviation of the gaps between its queries, and the steadiness that follows.

    Gaps inside an hour come from a window by (domain, hour); the gap between one hour's last and the next one's first
    query comes from the hours' summaries, so no domain has to be sorted in one task.
    """
    hours = named.withColumn("hour", F.date_trunc("hour", "ts"))
    inside = hours.withColumn("gap", F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(Window.partitionBy("base_domain", "hour").orderBy("ts"))))
    part = inside.groupBy("base_domain", "hour").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum(F.col("gap") / 1e6).alias("s"), F.sum(F.pow(F.col("gap") / 1e6, F.lit(2))).alias("s2"))
    step = (F.unix_micros("first") - F.unix_micros(F.lag("last").over(Window.partitionBy("base_domain").orderBy("hour")))) / 1e6
    a = part.withColumn("step", step).groupBy("base_domain").agg(
        F.sum("n").alias("n"), (F.coalesce(F.sum("s"), F.lit(0.0)) + F.coalesce(F.sum("step"), F.lit(0.0))).alias("s"), (F.coalesce(F.sum("s2"), F.lit(0.0)) + F.coalesce(F.sum(F.col("step") * F.col("step")), F.lit(0.0))).alias("s2")
    )
    k = F.col("n") - 1
    mean, square = F.col("s") / k, F.col("s2") / k
    out = a.where("n >= 2").select("base_domain", "n", mean.alias("interval_mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("interval_std"))
    return out.withColumn("steadiness", 1 - F.least(F.lit(1.0), F.col("interval_std") / F.greatest(F.col("interval_mean"), F.lit(1.0))))


@dataclass
class Frames:
    """The event tables and, built when first asked for, the metric tables that rules share."""

    http: DataFrame
    dns: DataFrame
    endpoints: DataFrame
    profiles: DataFrame

    @cached_property
    def parts(self) -> DataFrame:
        return session_endpoint(self.http)

    @cached_property
    def endpoint(self) -> DataFrame:
        return endpoint_metrics(self.parts)

    @cached_property
    def session(self) -> DataFrame:
        return session_metrics(self.parts)

    @cached_property
    def named(self) -> DataFrame:
        return dns_named(self.dns)

    @cached_property
    def ip(self) -> DataFrame:
        return dns_ip_metrics(self.named).join(dns_primary_domain(self.named), "src_ip")

    @cached_property
    def domain(self) -> DataFrame:
        return dns_domain_metrics(self.named).join(interval_stats(self.named).select("base_domain", "steadiness"), "base_domain", "left")

    @cached_property
    def endpoint_sessions(self) -> DataFrame:
        """The first ten session ids of each endpoint."""
        first = Window.partitionBy("endpoint").orderBy("session_id")
        few = self.parts.where("session_id is not null").select("endpoint", "session_id").withColumn("r", F.row_number().over(first)).where("r <= 10")
        return few.groupBy("endpoint").agg(F.array_sort(F.collect_list("session_id")).alias("sessions"))
