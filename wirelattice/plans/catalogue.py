"""Every query of the engine, with the SQL that checks it.

Doubles are rounded to six places on both sides. The driver's tables are calmer than an attack, so the rule queries run with the thresholds TABLES.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelattice.functions.scalars import base_domain, char_entropy, is_random_label, subdomain
from wirelattice.operators import correlate, crosssession, experiments, graph, metrics, ontology, rules, semantic, statistics
from wirelattice.sources import events as ev
from wirelattice.sources.staging import materialise
from wirelattice.sources.tables import table
from wirelattice.streaming import pipeline as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = replace(
    rules.CODE, http_rps=2.5e-5, expensive_rps=1e-4, scraping_endpoints=4, random_ratio=0.01, random_queries=5, unique_subdomains=5, nxdomain_ratio=0.3, nxdomain_queries=5, torture_subdomains=5, torture_qps=(0.0, 50.0), steadiness=0.05,
    phantom_queries=5, tunnel_score=0.01, tunnel_queries=5, any_queries=2,
)
#: Limits of the cross-session queries on the driver's tables.
LIMITS = crosssession.Limits(window_s=300, fail_ratio=0.1, rate=1e-9, api_rate=1e-9, quota=10.0, route_entropy=3.0)


def frames(spark: SparkSession, sf_dir: str) -> metrics.Frames:
    http = ev.http_requests(spark, sf_dir)
    return metrics.Frames(http, ev.dns_queries(spark, sf_dir), ev.endpoints(spark), ev.behavior_profiles(http))


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.detect(frames(spark, sf_dir), TABLES)


def detected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, metrics.Frames]:
    """The anomalies, written once for queries that read them several times, and the tables they come from."""
    f = frames(spark, sf_dir)
    return materialise(rules.detect(f, TABLES), "anomalies"), f


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All anomalies over the HTTP and DNS views of the tables."""
    return anomalies(spark, sf_dir).select(*rules.COLUMNS)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has one."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# --- SQL of the views and the metric tables ------------------------------------------------------------------

HTTP = """http as (
  select cast(event_id as varchar) as request_id, case when event_type in ('view', 'click') then 'GET' else 'POST' end as method,
    case event_type when 'view' then '/search' when 'click' then '/api/items' when 'error' then '/login' when 'purchase' then '/checkout' else '/graphql' end as endpoint,
    '10.' || (user_id % 4) || '.' || (user_id % 16) || '.' || (user_id % 200) as src_ip, 'u' || user_id as session_id, 't' || (user_id % 50) as token, 'ja' || (user_id % 8) as tls_fingerprint,
    case when event_type = 'error' then 401 when event_type = 'click' and event_id % 3 = 0 then 400 when event_type = 'signup' and event_id % 2 = 0 then 400 when event_type = 'purchase' and event_id % 10 = 0 then 500 else 200 end as response_code,
    cast(floor(value * 100) as bigint) as response_time_ms, ts from events where ts is not null and user_id is not null)"""
_SPAN = "greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1.0)"
SESSION = f"""top as (select session_id, endpoint as target_endpoint from http group by 1, 2 qualify row_number() over (partition by session_id order by count(*) desc, endpoint) = 1),
session as (select session_id, count(*) as request_count, case when count(*) >= 2 then count(*) / {_SPAN} else 0.0 end as requests_per_second, count(distinct endpoint) / count(*) as navigation_diversity,
  count(distinct endpoint) as unique_endpoints, avg(response_time_ms) as avg_response_time_ms, stddev_pop(response_time_ms) as response_time_std, count(*) filter (response_code >= 400) as error_count,
  count(*) filter (response_code in (401, 403) and endpoint = '/login') as failed_logins, any_value(target_endpoint) as target_endpoint, min(ts) as created_at, max(ts) as last_activity
  from http join top using (session_id) group by 1)"""
ENDPOINT = f"""endpoint as (select endpoint, count(*) as request_count, avg(response_time_ms) as avg_response_time_ms, count(*) filter (response_code >= 400) / count(*) as error_rate,
  case when count(*) >= 2 then count(*) / {_SPAN} else 0.0 end as requests_per_second, count(distinct session_id) as unique_sessions from http group by 1),
dims(path, cost, baseline) as (values ('/login', 0.8, 1500), ('/search', 0.9, 2000), ('/api/items', 0.6, 1600), ('/checkout', 0.95, 0), ('/graphql', 0.85, 1000))"""
PROFILE = """profile as (select distinct 'p_' || session_id as profile_id, session_id, cast(session_id[2:] as bigint) % 20 / 20.0 as hv, cast(session_id[2:] as bigint) % 30 / 30.0 as fv, cast(session_id[2:] as bigint) % 7 / 7.0 as nd,
  cast(session_id[2:] as bigint) % 5 = 0 as bot from http)"""


def _entropy(s: str) -> str:
    p = f"((len({s}) - len(replace(lower({s}), c, ''))) / len({s}))"
    return f"case when len({s}) = 0 then 0.0 else list_sum(list_transform(list_distinct(string_split(lower({s}), '')), lambda c: -{p} * log2({p}))) end"


DNS = f"""dns0 as (select cast(page_id as varchar) as query_id, case when page_id % 5 = 0 then md5(url)[:14] || '.' else '' end || regexp_extract(url, '://([^/?#]*)', 1) as qname, case page_id % 10 when 0 then 'ANY' when 1 then 'TXT' when 2 then 'AAAA' else 'A' end as qtype,
  '10.0.0.' || (page_id % 8) as src_ip, case when page_id % 3 = 0 then 'NXDOMAIN' when page_id % 7 = 0 then 'SERVFAIL' else 'NOERROR' end as response_code, page_id % 60 * 100 as response_time_ms,
  make_timestamp((1704067200 + page_id * 600) * 1000000) as ts, 40 as query_size, case when page_id % 10 = 0 then 4000 else 80 end as response_size, string_split(rtrim(qname, '.'), '.') as parts
  from pages where page_id is not null and url is not null),
dns1 as (select *, case when len(parts) >= 2 then array_to_string(parts[-2:], '.') else qname end as base_domain, case when len(parts) > 2 then array_to_string(parts[:-3], '.') else '' end as sub from dns0),
dns2 as (select *, {_entropy("sub")} as entropy from dns1),
dns as (select *, len(sub) > 10 and entropy > 3.5 as random from dns2)"""
IP = f"""primary_of as (select src_ip, base_domain as primary_domain from dns group by 1, 2 qualify row_number() over (partition by src_ip order by count(*) desc, base_domain) = 1),
ip as (select src_ip, count(*) as query_count, case when count(*) >= 2 then count(*) / {_SPAN} else 0.0 end as queries_per_second, count(distinct base_domain) as unique_domains, count(*) filter (response_code = 'NXDOMAIN') as nxdomain_count,
  count(*) filter (response_code = 'NXDOMAIN') / count(*) as nxdomain_ratio, count(*) filter (random and sub <> '') as random_subdomain_count, count(*) filter (random and sub <> '') / greatest(count(*) filter (sub <> ''), 1) as random_subdomain_ratio,
  count(distinct qtype) as unique_qtypes, coalesce(avg(len(sub)) filter (sub <> ''), 0.0) as avg_subdomain_length, coalesce(avg(entropy) filter (len(sub) >= 4), 0.0) as subdomain_entropy_avg, count(distinct sub) filter (sub <> '') as unique_subdomains,
  count(*) filter (qtype = 'ANY') as any_count, count(*) filter (qtype = 'TXT') / count(*) as txt_ratio, count(*) filter (len(sub) > 20) / greatest(count(*) filter (sub <> ''), 1) as long_ratio,
  count(*) filter (entropy > 3.5) / greatest(count(*) filter (sub <> ''), 1) as high_entropy_ratio, any_value(primary_domain) as primary_domain from dns join primary_of using (src_ip) group by 1)"""
DOMAIN = f"""gaps as (select base_domain, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by base_domain order by ts)) / 1e6 as gap from dns),
intervals as (select base_domain, count(*) as n, avg(gap) as interval_mean, stddev_pop(gap) as interval_std, 1 - least(1.0, stddev_pop(gap) / greatest(avg(gap), 1.0)) as steadiness from gaps group by 1 having count(*) >= 2),
domain as (select base_domain, count(*) as query_count, case when count(*) >= 2 then count(*) / {_SPAN} else 0.0 end as queries_per_second, count(distinct src_ip) as unique_src_ips, count(distinct sub) filter (sub <> '') as unique_subdomains,
  count(*) filter (response_code = 'NXDOMAIN') / count(*) as nxdomain_ratio, avg(response_time_ms) as avg_response_time_ms, count(*) filter (response_code = 'SERVFAIL' or response_time_ms > 5000) as timeout_count,
  count(*) filter (response_code = 'SERVFAIL' or response_time_ms > 5000) / count(*) as timeout_ratio from dns group by 1)"""
ALL = f"with {HTTP}, {SESSION}, {ENDPOINT}, {PROFILE}, {DNS}, {IP}, {DOMAIN}"


def _r(names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names.split())


# --- metrics -------------------------------------------------------------------------------------------------


@query(f"with {HTTP}, {ENDPOINT} select endpoint, request_count, {_r('avg_response_time_ms error_rate requests_per_second')}, unique_sessions from endpoint")
def endpoint_metrics(spark, sf_dir):
    return frames(spark, sf_dir).endpoint


@query(f"with {HTTP}, {SESSION} select session_id, request_count, {_r('requests_per_second navigation_diversity avg_response_time_ms response_time_std')}, unique_endpoints, error_count, failed_logins, target_endpoint, created_at, last_activity from session")
def session_metrics(spark, sf_dir):
    return frames(spark, sf_dir).session


@query(f"with {HTTP} select session_id, min(ts) as created_at, max(ts) as last_activity, count(*) as request_count, count(*) - 1 as later_requests, arg_min(token, ts) as identity, arg_min(src_ip, ts) as src_ip, arg_min(tls_fingerprint, ts) as fingerprint from http group by 1")
def session_state(spark, sf_dir):
    return metrics.session_state(ev.http_requests(spark, sf_dir))


@query(
    f"with {DNS}, {IP} select src_ip, query_count, {_r('queries_per_second nxdomain_ratio random_subdomain_ratio avg_subdomain_length subdomain_entropy_avg txt_ratio long_ratio high_entropy_ratio')}, unique_domains, nxdomain_count, random_subdomain_count, unique_qtypes, unique_subdomains, any_count from ip"
)
def dns_ip_metrics(spark, sf_dir):
    return metrics.dns_ip_metrics(metrics.dns_named(ev.dns_queries(spark, sf_dir)))


@query(f"with {DNS}, {DOMAIN} select base_domain, query_count, {_r('queries_per_second nxdomain_ratio avg_response_time_ms timeout_ratio')}, unique_src_ips, unique_subdomains, timeout_count from domain")
def dns_domain_metrics(spark, sf_dir):
    return metrics.dns_domain_metrics(metrics.dns_named(ev.dns_queries(spark, sf_dir)))


@query(f"with {DNS}, {DOMAIN} select base_domain, n, {_r('interval_mean interval_std steadiness')} from intervals")
def interval_stats(spark, sf_dir):
    return metrics.interval_stats(metrics.dns_named(ev.dns_queries(spark, sf_dir)))


@query(f"with {DNS} select query_id, round({_entropy('qname')}, 6) as entropy from dns")
def char_entropy_of_names(spark, sf_dir):
    return ev.dns_queries(spark, sf_dir).select("query_id", char_entropy(F.col("qname")).alias("entropy"))


@query(f"with {DNS} select query_id, base_domain, sub as subdomain, random as is_random from dns")
def base_domain_subdomain(spark, sf_dir):
    sub = subdomain(F.col("qname"))
    return ev.dns_queries(spark, sf_dir).select("query_id", base_domain(F.col("qname")).alias("base_domain"), sub.alias("subdomain"), is_random_label(sub).alias("is_random"))


@query(f"with {HTTP} select endpoint as path, 0.5::double as computational_cost, arg_min(method, ts) = 'GET' as is_cacheable from http group by 1")
def auto_endpoints(spark, sf_dir):
    return ev.with_auto_endpoints(ev.endpoints(spark).limit(0), ev.http_requests(spark, sf_dir)).select("path", "computational_cost", "is_cacheable")


@query(f"with {DNS} select base_domain as domain, max(ts) as last_query_ts, array_to_string(list_sort(list(distinct qtype)), ',') as record_types from dns group by 1")
def auto_domains(spark, sf_dir):
    return ev.auto_domains(ev.dns_queries(spark, sf_dir)).withColumn("record_types", F.array_join("record_types", ","))


# --- rules ---------------------------------------------------------------------------------------------------

T = TABLES
_SEV = "case when score > 0.7 then 'high' else 'medium' end"


def _rule(name: str, subject: str, score: str, confidence: float, measure: str, source: str, where: str, target: str = "''", severity: str = "'medium'") -> str:
    return (
        f"select '{name}' as rule, subject_id, round(score, 6) as score, cast({confidence} as double) as confidence, {severity} as severity, target_endpoint, round(measure, 6) as measure from "
        f"(select cast({subject} as varchar) as subject_id, cast({score} as double) as score, cast({measure} as double) as measure, {target} as target_endpoint from {source} where {where})"
    )


RULE_SQL = {
    "login_flood": _rule("login_flood", "session_id", "least(1.0, failed_logins / 20)", 0.85, "failed_logins", "session", f"failed_logins > {T.failed_logins}", "'/login'", _SEV),
    "http_flood": _rule("http_flood", "session_id", "least(1.0, requests_per_second / 100)", 0.8, "requests_per_second", "session", f"requests_per_second > {T.http_rps}", "target_endpoint", _SEV),
    "bot_behavior": _rule("bot_behavior", "profile_id", "1 - least(hv, fv, nd)", 0.75, "least(hv, fv, nd)", "profile", "hv < 0.15 or fv < 0.15 or nd < 0.2"),
    "low_session_value": _rule("low_session_value", "session_id", "1 - v", 0.7, "v", "(select *, navigation_diversity * (1 - error_count / greatest(request_count, 1)) as v from session)", "request_count > 50 and v < 0.1"),
    "expensive_endpoint_burst": _rule("expensive_endpoint_burst", "endpoint", "least(1.0, requests_per_second / 60) * cost", 0.9, "requests_per_second", "endpoint join dims on endpoint = path", f"cost > 0.7 and requests_per_second > {T.expensive_rps}", "endpoint", _SEV),
    "latency_increase": _rule("latency_increase", "endpoint", "least(1.0, avg_response_time_ms / baseline / 5)", 0.6, "avg_response_time_ms / baseline", "endpoint join dims on endpoint = path", "baseline > 0 and avg_response_time_ms / baseline > 3", "endpoint"),
    "repetitive_route": _rule("repetitive_route", "session_id", "1 - navigation_diversity", 0.7, "navigation_diversity", "session", "navigation_diversity < 0.2 and request_count > 30"),
    "slow_request": _rule("slow_request", "request_id", "least(1.0, response_time_ms / 60000)", 0.75, "response_time_ms", "http", "response_time_ms > 30000", "endpoint", _SEV),
    "scraping": _rule("scraping", "session_id", "least(1.0, unique_endpoints / 100)", 0.8, "unique_endpoints", "session left join (select session_id, bool_or(bot) as bot from profile group by 1) using (session_id)", f"unique_endpoints > {T.scraping_endpoints} and (coalesce(bot, false) or navigation_diversity > 0.8)"),
    "api_abuse": _rule("api_abuse", "endpoint", "least(1.0, 2 * error_rate)", 0.75, "error_rate", "endpoint", "(contains(endpoint, '/api/') or contains(endpoint, '/graphql')) and error_rate > 0.3", "endpoint"),
    "qname_randomization": _rule("qname_randomization", "src_ip", "least(1.0, 1.5 * random_subdomain_ratio)", 0.85, "random_subdomain_ratio", "ip", f"random_subdomain_ratio > {T.random_ratio} and query_count > {T.random_queries}", "'DNS:' || primary_domain", _SEV),
    "qname_randomization_domain": _rule("qname_randomization_domain", "base_domain", "least(1.0, unique_subdomains / 1000)", 0.8, "unique_subdomains", "domain", f"unique_subdomains > {T.unique_subdomains}", "'DNS:' || base_domain", _SEV),
    "nxdomain_flood": _rule("nxdomain_flood", "src_ip", "least(1.0, 1.5 * nxdomain_ratio)", 0.85, "nxdomain_ratio", "ip", f"nxdomain_ratio > {T.nxdomain_ratio} and query_count > {T.nxdomain_queries}", "'DNS:Resolver'", _SEV),
    "nxdomain_flood_domain": _rule("nxdomain_flood_domain", "base_domain", "least(1.0, nxdomain_ratio)", 0.75, "nxdomain_ratio", "domain", f"nxdomain_ratio > {T.nxdomain_ratio}", "'DNS:' || base_domain"),
    "dns_water_torture": _rule("dns_water_torture", "base_domain", "least(1.0, unique_subdomains / 500) * steadiness", 0.7, "steadiness", "domain join (select base_domain, steadiness from intervals) using (base_domain)", f"unique_subdomains > {T.torture_subdomains} and queries_per_second > 0 and queries_per_second < 50 and query_count >= 10 and steadiness > {T.steadiness}", "'DNS:' || base_domain"),
    "dns_amplification": _rule("dns_amplification", "query_id", "least(1.0, response_size / query_size / 50)", 0.8, "response_size / query_size", "dns", "query_size > 0 and response_size > 0 and (response_size / query_size > 10 or response_size > 1000)", "'DNS:' || qname", _SEV),
    "dns_amplification_any": _rule("dns_amplification_any", "src_ip", "0.75", 0.85, "any_count", "ip", f"any_count > {T.any_queries}", "'DNS:Resolver'", "'high'"),
    "phantom_domain": _rule("phantom_domain", "base_domain", "least(1.0, 2 * timeout_ratio)", 0.7, "timeout_ratio", "domain", f"(avg_response_time_ms > 2000 or timeout_ratio > 0.3) and query_count > {T.phantom_queries}", "'DNS:' || base_domain"),
    "dns_tunneling": _rule("dns_tunneling", "src_ip", "least(1.0, 2 * x)", 0.75, "x", "(select *, 0.3 * txt_ratio + 0.4 * long_ratio + 0.3 * high_entropy_ratio as x from ip)", f"x > {T.tunnel_score} and query_count > {T.tunnel_queries}", "'DNS:Tunnel'", _SEV),
}
PLAIN = ["rule", "subject_id", "score", "confidence", "severity", "target_endpoint", "measure"]


def _register_rule(name: str) -> None:
    QUERIES[f"rule_{name}"] = lambda spark, sf_dir: rounded(rules.detect(frames(spark, sf_dir), TABLES, [name]).select(*PLAIN))
    ORACLE_SQL[f"rule_{name}"] = f"{ALL} {RULE_SQL[name]}"


for _name in rules.RULES:
    _register_rule(_name)
_UNION = " union all ".join(RULE_SQL.values())


@query(f"{ALL} {_UNION}")
def all_anomalies(spark, sf_dir):
    return anomalies(spark, sf_dir).select(*PLAIN)


def _top_sql(names: list[str], k: int) -> str:
    found = " union all ".join(RULE_SQL[n] for n in names)
    return f"{ALL}, found as ({found}) select cast(row_number() over (order by score desc, list_position({list(rules.RULES)}, rule), subject_id) as integer) as rank, found.* from found qualify rank <= {k}"


@query(_top_sql(list(rules.RULES), 3))
def top_anomalies(spark, sf_dir):
    return rules.top_anomalies(anomalies(spark, sf_dir), 3).select("rank", *PLAIN)


@query(_top_sql([n for n in rules.RULES if n.startswith(("qname", "nxdomain", "dns_", "phantom"))], 5))
def top_dns_anomalies(spark, sf_dir):
    return rules.top_anomalies(anomalies(spark, sf_dir), 5, rules.DNS_ATTACKS).select("rank", *PLAIN)


@query(f"{ALL} " + _rule("slow_request", "request_id", "least(1.0, response_time_ms / 60000)", 0.75, "response_time_ms", "http", "response_time_ms > 30000 and method = 'POST'", "endpoint", _SEV))
def ontology_slow_request(spark, sf_dir):
    return rules.detect(frames(spark, sf_dir), rules.ONTOLOGY, ["slow_request"]).select(*PLAIN)


@query(f"with {HTTP}, {ENDPOINT}, m as (select avg(requests_per_second) as mu, stddev_pop(requests_per_second) as sd from endpoint) select endpoint, round(0.3 / (1 + exp(-abs(requests_per_second - mu) / greatest(sd, 1e-9))) + 0.35 * error_rate, 6) as composite from endpoint, m")
def composite_scores(spark, sf_dir):
    e = frames(spark, sf_dir).endpoint
    m = e.agg(F.avg("requests_per_second").alias("mu"), F.stddev_pop("requests_per_second").alias("sd"))
    x = e.join(F.broadcast(m))  # one row
    v = 1 / (1 + F.exp(-F.abs(F.col("requests_per_second") - F.col("mu")) / F.greatest(F.col("sd"), F.lit(1e-9))))
    return rules.composite_score(x, v, F.lit(0.0), F.col("error_rate"), F.lit(0.0)).select("endpoint", "composite")


# --- graph ---------------------------------------------------------------------------------------------------

NODES = "nodes as (select 'request:' || request_id as id, 'request' as type from http union all select distinct 'ip:' || src_ip, 'ip' from http union all select distinct 'endpoint:' || endpoint, 'endpoint' from http union all select distinct 'session:' || session_id, 'session' from http)"
EDGES = "edges as (select 'request:' || request_id as src, 'ip:' || src_ip as dst, 'fromIP' as rel from http union all select 'request:' || request_id, 'endpoint:' || endpoint, 'hasEndpoint' from http union all select 'request:' || request_id, 'session:' || session_id, 'hasSession' from http)"


@query(f"with {HTTP}, {NODES} select * from nodes")
def graph_nodes(spark, sf_dir):
    return graph.http_nodes(ev.http_requests(spark, sf_dir))


@query(f"with {HTTP}, {EDGES} select * from edges")
def graph_edges(spark, sf_dir):
    return graph.http_edges(ev.http_requests(spark, sf_dir))


@query(f"with {DNS} select 'query:' || query_id as id, 'query' as type from dns union all select distinct 'ip:' || src_ip, 'ip' from dns union all select 'server:192.0.2.53', 'server' from dns group by 1 union all select distinct 'domain:' || base_domain, 'domain' from dns")
def dns_graph_nodes(spark, sf_dir):
    return graph.dns_nodes(ev.dns_queries(spark, sf_dir))


@query(f"with {DNS} select 'query:' || query_id as src, 'ip:' || src_ip as dst, 'fromIP' as rel from dns union all select 'query:' || query_id, 'server:192.0.2.53', 'resolvedBy' from dns union all select 'query:' || query_id, 'domain:' || base_domain, 'queriesDomain' from dns")
def dns_graph_edges(spark, sf_dir):
    return graph.dns_edges(ev.dns_queries(spark, sf_dir))


@query(
    f"with {HTTP}, {NODES}, {EDGES}, d as (select id, sum(i) as i, sum(o) as o from (select src as id, 0 as i, 1 as o from edges union all select dst, 1, 0 from edges) group by 1) "
    "select id, type, cast(coalesce(i, 0) as bigint) as in_degree, cast(coalesce(o, 0) as bigint) as out_degree, round((coalesce(i, 0) + coalesce(o, 0)) / ((select count(*) from nodes) - 1), 6) as degree_centrality from nodes left join d using (id)"
)
def degree_centrality(spark, sf_dir):
    http = ev.http_requests(spark, sf_dir)
    return graph.degrees(graph.http_nodes(http), graph.http_edges(http))


@query(
    f"with {HTTP}, {PROFILE}, {NODES}, every as (select * from nodes union all select 'behavior:' || profile_id, 'behavior' from profile), i as (select session_id, count(*) as n from http group by 1) "
    "select id, type, round(coalesce(n, 0) * 1 / (((select count(*) from every) - 1) * ((select count(*) from every) - 2)), 12) as betweenness from every left join i on id = 'session:' || session_id"
)
def betweenness(spark, sf_dir):
    http = ev.http_requests(spark, sf_dir)
    profiles = ev.behavior_profiles(http)
    nodes = graph.http_nodes(http)
    every = nodes.unionByName(profiles.select(F.concat(F.lit("behavior:"), "profile_id").alias("id"), F.lit("behavior").alias("type")))
    out = graph.betweenness_two_hop(every, graph.http_edges(http).unionByName(graph.behaviour_edges(profiles, nodes)))
    return out.withColumn("betweenness", F.round("betweenness", 12).cast("decimal(20,12)").cast("double"))


QUERIES["betweenness"] = betweenness


@query(f"with {HTTP} select request_id, session_id, response_code from http where endpoint = '/login'")
def requests_for_endpoint(spark, sf_dir):
    return ev.http_requests(spark, sf_dir).where("endpoint = '/login'").select("request_id", "session_id", "response_code")


@query(f"with {HTTP}, {EDGES}, {NODES} select n.id, n.type from nodes n where n.id in (select src from edges where rel = 'hasSession' and dst = 'session:u1')")
def session_requests(spark, sf_dir):
    http = ev.http_requests(spark, sf_dir)
    mine = graph.http_edges(http).where("rel = 'hasSession' and dst = 'session:u1'").select(F.col("src").alias("id"))
    return graph.http_nodes(http).join(mine, "id", "left_semi")


_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'


def _lines(head: list[str], node: str, edge: str, tail: list[str]) -> str:
    fixed = [(part, f"{i:02}", x) for part, lines in ((0, head), (3, tail)) for i, x in enumerate(lines)]
    return (
        f"with {HTTP}, {NODES}, {EDGES} select * from (values " + ", ".join(f"({a}, '{b}', '{c}')" for a, b, c in fixed)
        + f') v(part, "at", line) union all select 1, id, {node} from nodes union all select 2, src || \'|\' || dst || \'|\' || rel, {edge} from edges'
    )


GRAPHML = _lines(
    [_HEAD, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="t" for="node" attr.name="type" attr.type="string"/>', '<key id="r" for="edge" attr.name="rel" attr.type="string"/>', '<graph edgedefault="directed">'],
    """format('<node id="{}"><data key="t">{}</data></node>', id, type)""",
    """format('<edge source="{}" target="{}"><data key="r">{}</data></edge>', src, dst, rel)""",
    ["</graph>", "</graphml>"],
)
GEXF = _lines(
    [_HEAD, '<gexf xmlns="http://gexf.net/1.3" version="1.3">', '<graph defaultedgetype="directed">'],
    """format('<node id="{}" label="{}"/>', id, type)""", """format('<edge source="{}" target="{}" label="{}"/>', src, dst, rel)""", ["</graph>", "</gexf>"],
)
CYTOSCAPE = (
    f"""with {HTTP}, {NODES}, {EDGES} select 'nodes' as "group", id, '{{"data":{{"id":"' || id || '","label":"' || id[:30] || '","type":"' || type || '","color":"' """
    """|| case type when 'request' then '#4CAF50' when 'endpoint' then '#2196F3' when 'session' then '#FF9800' else '#9C27B0' end || '"}}' as element from nodes """
    """union all select 'edges', src || '|' || rel || '|' || dst, '{"data":{"source":"' || src || '","target":"' || dst || '","label":"' || rel || '"}}' from edges"""
)
_SHORT = "regexp_replace({0}[:15], '[^A-Za-z0-9]', '_', 'g')"
MERMAID = (
    f"with {HTTP}, {NODES}, {EDGES}, firsts as (select * from nodes order by id limit 50) select 0 as part, '' as \"at\", 'graph TD' as line "
    f"union all select 1, id, '    ' || {_SHORT.format('id')} || '[' || id[:20] || ']' from firsts "
    f"union all select 2, src || '|' || dst || '|' || rel, '    ' || {_SHORT.format('src')} || ' -->|' || rel || '| ' || {_SHORT.format('dst')} from edges "
    "where src in (select id from firsts) and dst in (select id from firsts)"
)


@query(CYTOSCAPE)
def cytoscape_elements(spark, sf_dir):
    http = ev.http_requests(spark, sf_dir)
    return graph.cytoscape(graph.http_nodes(http), graph.http_edges(http))


@query(MERMAID)
def mermaid_lines(spark, sf_dir):
    http = ev.http_requests(spark, sf_dir)
    return graph.mermaid(graph.http_nodes(http), graph.http_edges(http))


@query(GRAPHML)
def graphml_lines(spark, sf_dir):
    http = ev.http_requests(spark, sf_dir)
    return graph.graph_xml(graph.http_nodes(http), graph.http_edges(http))


@query(GEXF)
def gexf_lines(spark, sf_dir):
    http = ev.http_requests(spark, sf_dir)
    return graph.graph_xml(graph.http_nodes(http), graph.http_edges(http), "gexf")


_ONTO = " union all ".join(f"select '{c}' as child, '{p}' as parent" for c, p in ontology.CLASSES.items())


@query(f"with recursive c as ({_ONTO}), up(child, ancestor, depth) as (select child, parent, 1 from c union all select up.child, c.parent, up.depth + 1 from up join c on up.ancestor = c.child) select child, ancestor, depth from up")
def ontology_closure(spark, sf_dir):
    return ontology.closure(spark)


@query(f"with {HTTP}, {EDGES} select dst as src, src as dst, rel from edges where rel = 'hasSession' union all select src, dst, 'hasEndpoint' from edges where rel = 'fromIP'")
def invalid_edges(spark, sf_dir):
    """Good edges stay out; turned round, or under another relation's name, they come out."""
    http = ev.http_requests(spark, sf_dir)
    good = graph.http_edges(http)
    turned = good.where("rel = 'hasSession'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel")
    renamed = good.where("rel = 'fromIP'").select("src", "dst", F.lit("hasEndpoint").alias("rel"))
    return ontology.invalid_edges(graph.http_nodes(http), good.unionByName(turned).unionByName(renamed)).select("src", "dst", "rel")


# --- correlation and questions -------------------------------------------------------------------------------

FOUND = f"{ALL}, found as ({_UNION}), weighed as (select *, case severity when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 4 end as w from found)"
_ATTACK = {"login_flood": "LoginFlood", "http_flood": "HTTPFlood", "bot_behavior": "BotBehavior", "low_session_value": "APIAttack", "expensive_endpoint_burst": "HTTPFlood", "latency_increase": "HTTPFlood", "repetitive_route": "BotBehavior", "slow_request": "SlowRequestAttack", "scraping": "ScrapingAttack", "api_abuse": "APIAttack", "qname_randomization": "QNameRandomization", "qname_randomization_domain": "QNameRandomization", "nxdomain_flood": "NXDOMAINFlood", "nxdomain_flood_domain": "NXDOMAINFlood", "dns_water_torture": "DNSWaterTorture", "dns_amplification": "DNSAmplification", "dns_amplification_any": "DNSAmplification", "phantom_domain": "PhantomDomainAttack", "dns_tunneling": "DNSTunneling"}
_KIND = "case rule " + " ".join(f"when '{k}' then '{v}'" for k, v in _ATTACK.items()) + " end"


@query(
    f"{FOUND}, g as (select target_endpoint, count(*) as n, sum(w) as w, min(list_position([{', '.join(repr(r) for r in rules.RULES)}], rule)) as seq from weighed where target_endpoint <> '' group by 1 order by n * sum(w) desc, seq, target_endpoint limit 1) "
    "select 'attack_detected' as status, target_endpoint as endpoint, n as anomaly_count, cast(w as bigint) as severity_sum, round(least(1.0, 0.2 * n)::double, 6) as confidence from g"
)
def endpoint_under_attack(spark, sf_dir):
    return semantic.endpoint_under_attack(anomalies(spark, sf_dir))


@query(f"{FOUND} select {_KIND} as attack_type, count(*) as n from found group by 1")
def attack_histogram(spark, sf_dir):
    return anomalies(spark, sf_dir).groupBy("attack_type").agg(F.count("*").alias("n"))


_LINES = "lines(rule, line, category) as (values ('http_flood', 1, 'rate_anomaly'), ('http_flood', 2, 'other'), ('expensive_endpoint_burst', 1, 'other'), ('expensive_endpoint_burst', 2, 'other'), ('latency_increase', 1, 'performance_impact'), ('latency_increase', 2, 'performance_impact'))"


@query(
    f"{FOUND}, {_LINES}, n as (select count(*) as n from found where rule in (select rule from lines)) select 'HTTPFlood' as attack_type, category, count(*) as evidence_count, any_value(n) as anomaly_count, "
    "round(least(1.0, 0.25 * any_value(n))::double, 6) as confidence from found join lines using (rule), n group by 2"
)
def hypothesis_evidence(spark, sf_dir):
    return semantic.hypothesis_evidence(anomalies(spark, sf_dir), "HTTPFlood")


@query(f"{FOUND} select distinct subject_id as session_id from found where rule = 'login_flood' order by 1 limit 20")
def affected_sessions(spark, sf_dir):
    return semantic.affected_sessions(anomalies(spark, sf_dir), "LoginFlood")


_CAT = " union all ".join(f"select {i} as seq, '{a}' as attack_type, '{t}' as action, '{d}' as description, '{m}' as impact, '{e}' as effectiveness, '{w}' as effort" for i, (a, t, d, m, e, w) in enumerate(semantic.MITIGATIONS))
_BEST = "case effectiveness when 'high' then 3 when 'medium' then 2 else 1 end desc, case impact when 'positive' then 4 when 'low' then 3 when 'medium' then 2 else 1 end desc"


@query(
    f"{FOUND}, cat as ({_CAT}), seen as (select {_KIND} as attack_type, count(*) as priority from found group by 1), o as (select *, row_number() over (order by {_BEST}, priority desc, seq) as rank from cat join seen using (attack_type)) "
    "select cast(rank as integer) as rank, attack_type, action, description, effectiveness, impact, effort, priority from o where rank <= 5"
)
def best_mitigation(spark, sf_dir):
    return semantic.best_mitigation(anomalies(spark, sf_dir))


_STATUS = "select 'recommendations_available' as status, {0} as endpoint, cast(sum(n) as bigint) as anomaly_count, array_to_string(list_sort(list(attack_type || ':' || n)), ',') as attack_types, round(least(1.0, 0.15 * sum(n))::double, 6) as confidence from seen"


@query(f"{FOUND}, seen as (select {_KIND} as attack_type, count(*) as n from found where target_endpoint = '/login' group by 1) {_STATUS.format(repr('/login'))}")
def mitigation_status(spark, sf_dir):
    return semantic.mitigation_status(anomalies(spark, sf_dir), "/login")


@query()
def explanations(spark, sf_dir):
    return semantic.explain(anomalies(spark, sf_dir))


@query()
def evidence_chains(spark, sf_dir):
    return semantic.evidence_chain(anomalies(spark, sf_dir))


@query()
def stix_bundle(spark, sf_dir):
    return semantic.stix_bundle(anomalies(spark, sf_dir))


@query(f"{FOUND} select rule, subject_id, cast(floor(confidence * 100 + 1e-9) as integer) as confidence, severity as x_severity from found")
def stix_indicators(spark, sf_dir):
    a = anomalies(spark, sf_dir)
    ids = a.select(F.col("anomaly_id").alias("external_id"), "rule", "subject_id")
    return semantic.stix_indicators(a).join(ids, "external_id").select("rule", "subject_id", "confidence", "x_severity")


#: Seconds; some endpoints of the tables have a longer span of anomalies, some a shorter one.
ATTACK_WINDOW = 2_000_000
_PREFIX = {
    "bot_behavior": "bot", "low_session_value": "low_value", "expensive_endpoint_burst": "expensive", "latency_increase": "latency", "repetitive_route": "repetitive", "slow_request": "slow",
    "qname_randomization": "qname_random", "qname_randomization_domain": "qname_random_domain", "nxdomain_flood_domain": "nxdomain_domain", "dns_water_torture": "water_torture",
    "dns_amplification": "dns_amp", "dns_amplification_any": "dns_amp_any", "dns_tunneling": "dns_tunnel",
}
_BY_SESSION = "('login_flood', 'http_flood', 'low_session_value', 'repetitive_route', 'scraping')"
MEMBERS = (
    f"{FOUND}, timed as (select found.*, {_KIND} as attack_type, case rule " + " ".join(f"when '{k}' then '{v}'" for k, v in _PREFIX.items()) + " else rule end || '_' || subject_id as anomaly_id, "
    f"case when rule in {_BY_SESSION} then last_activity when rule = 'slow_request' then http.ts when rule = 'dns_amplification' then dns.ts end as seen_at "
    f"from found left join session on rule in {_BY_SESSION} and subject_id = session.session_id left join http on rule = 'slow_request' and subject_id = request_id left join dns on rule = 'dns_amplification' and subject_id = query_id), "
    f"mem as (select rule, anomaly_id, target_endpoint, subject_id as session_id from timed where rule in {_BY_SESSION} union select rule, anomaly_id, target_endpoint, subject_id[3:] from timed where rule = 'bot_behavior' "
    "union select rule, anomaly_id, target_endpoint, session_id from timed join http on rule = 'slow_request' and subject_id = request_id "
    "union select rule, anomaly_id, target_endpoint, session_id from timed join http on rule in ('expensive_endpoint_burst', 'api_abuse') and subject_id = endpoint)"
)


@query(
    f"{MEMBERS}, k as (select target_endpoint, count(distinct session_id) as sessions from mem group by 1) select target_endpoint, count(*) as anomaly_count, array_to_string(list_sort(list(distinct attack_type)), ',') as attack_types, "
    "coalesce(any_value(sessions), 0) as sessions, round(least(1.0, 0.2 * count(*))::double, 6) as confidence, case when count(*) > 5 then 'critical' else 'high' end as severity "
    f"from timed left join k using (target_endpoint) where target_endpoint <> '' group by 1 having count(*) >= 2 and coalesce(epoch_us(max(seen_at)) - epoch_us(min(seen_at)), 0) < {ATTACK_WINDOW}::bigint * 1000000"
)
def coordinated_attacks(spark, sf_dir):
    a, f = detected(spark, sf_dir)
    return correlate.coordinated_attacks(a, ATTACK_WINDOW, rules.members(a, f))


@query(f"{FOUND} select count(distinct target_endpoint) filter (target_endpoint <> '') as endpoints, count(*) as anomaly_count, 1.0::double as confidence, 'critical' as severity from found")
def multi_vector(spark, sf_dir):
    return correlate.multi_vector(anomalies(spark, sf_dir), 1e12)


_STARS = (
    f"{MEMBERS}, keys as (select anomaly_id, 'e:' || target_endpoint as key, 'same_endpoint' as relation, 1 as precedence from timed where target_endpoint <> '' union all select anomaly_id, 's:' || session_id, 'shared_session', 2 from mem "
    "union all select anomaly_id, 'a:' || attack_type, 'same_attack_type', 3 from timed), hubs as (select key, min(anomaly_id) as hub from keys group by 1 having count(*) > 1), "
    "star as (select anomaly_id, hub, arg_max(relation, precedence) as relation from keys join hubs using (key) where anomaly_id <> hub group by 1, 2)"
)


@query(f"{_STARS} select * from star")
def attack_graph(spark, sf_dir):
    a, f = detected(spark, sf_dir)
    return correlate.attack_graph(a, rules.members(a, f))


@query(
    f"{_STARS.replace('with ', 'with recursive ', 1)}, b as (select anomaly_id as a, hub as b from star union select hub, anomaly_id from star), r(node, reach) as (select distinct anomaly_id, anomaly_id from timed union select r.node, b.b from r join b on r.reach = b.a), "
    "m as (select node, min(reach) as component from r group by 1) select component, count(*) as size from m group by 1"
)
def attack_components(spark, sf_dir):
    a, f = detected(spark, sf_dir)
    return correlate.attack_components(a, rules.members(a, f))


@query(f"{FOUND}, {NODES}, {EDGES} select (select count(*) from http) as requests, (select count(*) from nodes) as nodes, (select count(*) from edges) as edges, (select count(*) from found) as anomalies")
def engine_status(spark, sf_dir):
    f = frames(spark, sf_dir)
    return correlate.status(graph.http_nodes(f.http), graph.http_edges(f.http), f.http, rules.detect(f, TABLES))


# --- cross-session and cross-surface -------------------------------------------------------------------------

_SIG = f"with {HTTP}, sig as (select distinct session_id, cast(floor(epoch_us(ts) / 1000000 / {LIMITS.window_s}) as bigint) as w, unnest(['identity:' || token, 'fingerprint:' || tls_fingerprint, 'prefix:' || regexp_extract(src_ip, '^([^.]*[.][^.]*[.][^.]*)', 1)]) as v from http), hub as (select v, w, min(session_id) as hub from sig group by 1, 2 having count(*) >= 2)"


@query(f"{_SIG} select distinct hub, session_id from sig join hub using (v, w) where session_id <> hub")
def related_sessions(spark, sf_dir):
    return crosssession.related_stars(ev.http_requests(spark, sf_dir), LIMITS)


_REACH = (
    f"with recursive {_SIG[5:]}, e as (select distinct hub as a, session_id as b from sig join hub using (v, w) where session_id <> hub), b as (select a, b from e union select b, a from e), "
    "r(node, reach) as (select distinct session_id, session_id from http union select r.node, b.b from r join b on r.reach = b.a), m as (select node as session_id, min(reach) as campaign from r group by 1)"
)


@query(f"{_REACH} select session_id, campaign from m")
def campaigns(spark, sf_dir):
    return crosssession.campaigns(ev.http_requests(spark, sf_dir), LIMITS)


def _over_campaigns(spark, sf_dir, operator, *limits):
    """An operator over the campaigns of related sessions."""
    http = ev.http_requests(spark, sf_dir)
    return operator(http, crosssession.campaigns(http, LIMITS), *limits)


_CAMP = (
    f"{_REACH}, c as (select campaign, endpoint, count(distinct session_id) as sessions, count(*) as requests, count(*) filter (response_code in (401, 403)) as failed, count(distinct token) as tokens, {_SPAN} as span from http join m using (session_id) group by 1, 2), "
    "each as (select campaign, endpoint, max(k) as most from (select campaign, endpoint, session_id, count(*) as k from http join m using (session_id) group by 1, 2, 3) group by 1, 2), "
    "calm as (select campaign, max(h) as highest from (select campaign, session_id, log2(sum(k)) - sum(k * log2(k)) / sum(k) as h from (select campaign, session_id, endpoint, count(*) as k from http join m using (session_id) group by 1, 2, 3) group by 1, 2) group by 1)"
)


@query(f"{_CAMP} select campaign, endpoint, sessions, requests, round(failed / requests, 6) as fail_ratio from c where endpoint = '/login' and sessions >= 2 and failed / requests > {LIMITS.fail_ratio}")
def credential_stuffing(spark, sf_dir):
    return _over_campaigns(spark, sf_dir, crosssession.credential_stuffing, LIMITS)


@query(f"{_CAMP} select campaign, endpoint, sessions, requests, round(requests / span, 6) as rate from c join calm using (campaign) where sessions >= 2 and requests / span > {LIMITS.rate} and highest < {LIMITS.route_entropy}")
def coordinated_http_flood(spark, sf_dir):
    return _over_campaigns(spark, sf_dir, crosssession.coordinated_http_flood, LIMITS)


@query(
    f"{_CAMP} select campaign, endpoint, sessions, tokens, requests, round(requests / span, 6) as rate from c join each using (campaign, endpoint) "
    f"where endpoint in ('/api/items', '/graphql') and sessions >= 2 and tokens >= 2 and requests / span > {LIMITS.api_rate} and most / span <= {LIMITS.quota}"
)
def coordinated_api_abuse(spark, sf_dir):
    return _over_campaigns(spark, sf_dir, crosssession.coordinated_api_abuse, LIMITS)


@query(
    f"{_REACH}, s as (select distinct campaign, unnest(['identity', 'fingerprint', 'prefix']) as kind, unnest([token, tls_fingerprint, regexp_extract(src_ip, '^([^.]*[.][^.]*[.][^.]*)', 1)]) as value from http join m using (session_id)) "
    "select campaign, kind, min(value) as value from s group by 1, 2 having count(*) = 1"
)
def mitigation_scope(spark, sf_dir):
    return _over_campaigns(spark, sf_dir, crosssession.mitigation_scope)


@query(f"with {HTTP}, n as (select session_id, endpoint, count(*) as k from http group by 1, 2) select session_id, round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 6) as route_entropy from n group by 1")
def route_entropy(spark, sf_dir):
    return crosssession.route_entropy(ev.http_requests(spark, sf_dir))


@query(
    f"with {HTTP}, {DNS}, d as (select '10.0.0' as prefix, cast(floor(epoch_us(ts) / 1000000 / 300) as bigint) as w, count(*) filter (response_code = 'NXDOMAIN') as nxdomain, avg(entropy) as entropy from dns group by 1, 2 having count(*) filter (response_code = 'NXDOMAIN') between 1 and 20), "
    "d2 as (select prefix, unnest([w - 1, w, w + 1]) as w, nxdomain, entropy from d), h as (select regexp_extract(src_ip, '^([^.]*[.][^.]*[.][^.]*)', 1) as prefix, cast(floor(epoch_us(ts) / 1000000 / 300) as bigint) as w, count(*) filter (response_code >= 400) as errors, count(*) as requests from http group by 1, 2 having count(*) filter (response_code >= 400) between 1 and 20) "
    'select prefix, w as "window", nxdomain, round(entropy, 6) as entropy, errors, requests from d2 join h using (prefix, w)'
)
def cross_surface(spark, sf_dir):
    return crosssession.cross_surface(ev.dns_queries(spark, sf_dir), ev.http_requests(spark, sf_dir), LIMITS)


@query(f"with {DNS} select src_ip, count(*) filter (response_code = 'NXDOMAIN') as nxdomain, round(avg(entropy), 6) as entropy, count(distinct base_domain) as domains from dns group by 1 having count(*) filter (response_code = 'NXDOMAIN') > 5 and avg(entropy) > 1")
def dns_identity_rule(spark, sf_dir):
    return crosssession.dns_identity_rule(ev.dns_queries(spark, sf_dir), replace(LIMITS, nxdomain=5, entropy=1.0))


# --- streaming -----------------------------------------------------------------------------------------------


@query("with e as (select ts, event_type, value, unnest(range(0, 5)) as k from events where ts is not null) select time_bucket(interval 1 minute, ts) - k * interval 1 minute as start, time_bucket(interval 1 minute, ts) - k * interval 1 minute + interval 5 minutes as \"end\", event_type, count(*) as n, round(avg(value), 6) as mean from e group by 1, 2, 3")
def sliding_window_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.window_rates(e, "event_type", "5 minutes", "1 minute")


@query("select time_bucket(interval 1 hour, ts) as start, time_bucket(interval 1 hour, ts) + interval 1 hour as \"end\", event_type, count(*) as n, round(avg(value), 6) as mean from events where ts is not null group by 1, 2, 3")
def stream_window_rate(spark, sf_dir):
    return stream.run_available(stream.window_rates(stream.event_stream(spark, sf_dir), "event_type", "1 hour"), "stream-rate", "complete")


@query(
    "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events where ts is not null and user_id is not null), s as (select *, sum(new) over (partition by user_id order by ts) as k from g) "
    "select min(ts) as start, max(ts) + interval 30 minutes as \"end\", user_id, count(*) as n from s group by user_id, k"
)
def session_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("ts is not null and user_id is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.sessions(e, "user_id", "30 minutes")


@query(
    f"with recursive {HTTP}, a as (select endpoint as key, ts from http where response_code >= 400), r(key, ts) as (select key, min(ts) from a group by 1 union all "
    "select r.key, (select min(a.ts) from a where a.key = r.key and a.ts >= r.ts + interval 3600 seconds) from r where r.ts is not null) select key, ts from r where ts is not null"
)
def alert_cooldown(spark, sf_dir):
    alerts = ev.http_requests(spark, sf_dir).where("response_code >= 400").select(F.col("endpoint").alias("key"), "ts")
    return stream.cooldown_batch(alerts, 3600)


@query(f"with {DNS}, {HTTP} select '10.0.0' as prefix, query_id, request_id from dns join http on regexp_extract(http.src_ip, '^([^.]*[.][^.]*[.][^.]*)', 1) = '10.0.0' and http.ts between dns.ts - interval 300 seconds and dns.ts + interval 300 seconds")
def dns_http_link(spark, sf_dir):
    return stream.link_streams(ev.dns_queries(spark, sf_dir), ev.http_requests(spark, sf_dir), 300).select("prefix", "query_id", "request_id")


# --- experiments ---------------------------------------------------------------------------------------------


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")


@query("select quality as truth, toxic as guess, count(*) as n, round(count(*) / sum(count(*)) over (partition by quality), 6) as share from labels group by 1, 2")
def confusion_matrix(spark, sf_dir):
    return statistics.normalised_confusion(_labels(spark, sf_dir), "quality", "toxic")


_CLS = "cls as (select c.class, count(*) filter (quality = c.class) as support, count(*) filter (toxic = c.class) as g, count(*) filter (quality = c.class and toxic = c.class) as tp from labels, (select distinct quality as class from labels union select distinct toxic from labels) c group by 1), pr as (select *, case when g > 0 then tp / g else 0.0 end as precision, case when support > 0 then tp / support else 0.0 end as recall from cls), f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from pr)"


@query(f"with {_CLS} select class, support, {_r('precision recall f1')} from f")
def class_metrics(spark, sf_dir):
    return statistics.class_metrics(_labels(spark, sf_dir), "quality", "toxic")


@query(f"with {_CLS} select round((select avg(cast(quality = toxic as integer)) from labels), 6) as accuracy, round((select count(*) filter (quality = 0 and toxic <> 0) / greatest(count(*) filter (quality = 0), 1) from labels), 6) as fpr, round(sum(support * precision) / sum(support), 6) as precision, round(sum(support * recall) / sum(support), 6) as recall, round(sum(support * f1) / sum(support), 6) as f1 from f")
def classification_metrics(spark, sf_dir):
    return statistics.classification_metrics(_labels(spark, sf_dir), "quality", "toxic")


@query("with r as (select (event_type = 'error') as t, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2 as k from events where value is not null) select round((sum(k) filter (t) - count(*) filter (t) * (count(*) filter (t) + 1) / 2) / (count(*) filter (t) * count(*) filter (not t)), 6) as auc from r")
def auc_exact(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", (F.col("event_type") == "error").cast("int"))
    return statistics.auc(e, "t", "value")


@query("with g as (select label, value, count(*) as n from (select event_type as label, value from events) group by 1, 2), a as (select label, sum(n) as n, sum(n * value) / sum(n) as m from g group by 1), t as (select sum(n * m) / sum(n) as grand, count(*) as k, sum(n) as n from a), b as (select sum(a.n * (m - grand) ** 2) as ss from a, t), w as (select sum(g.n * (value - m) ** 2) as ss from g join a using (label)) select t.k, cast(t.n as bigint) as n, round(b.ss, 4) as ss_between, round(w.ss, 4) as ss_within, round((b.ss / (t.k - 1)) / (w.ss / (t.n - t.k)), 6) as f, round(b.ss / (b.ss + w.ss), 6) as eta_squared from t, b, w")
def anova_sums(spark, sf_dir):
    out = statistics.anova(table(spark, sf_dir, "events"), "event_type", "value")
    return out.withColumn("ss_between", F.round("ss_between", 4)).withColumn("ss_within", F.round("ss_within", 4))


_P = "p as (select event_type as id, (count(*) % 997 + 1) / 20000.0 as p from events group by 1)"


def _p(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("id")).agg(((F.count("*") % 997 + 1) / 20000.0).alias("p"))


@query(f"with {_P} select id, round(p, 6) as p, round(least(1.0, p * count(*) over ()), 6) as adjusted from p")
def bonferroni(spark, sf_dir):
    return statistics.corrected(_p(spark, sf_dir), "bonferroni")


@query(f"with {_P}, r as (select *, row_number() over (order by p, id) as r, count(*) over () as m from p) select id, round(p, 6) as p, round(least(1.0, max(p * (m - r + 1)) over (order by r)), 6) as adjusted from r")
def holm(spark, sf_dir):
    return statistics.corrected(_p(spark, sf_dir), "holm")


@query(f"with {_P}, r as (select *, row_number() over (order by p, id) as r, count(*) over () as m from p) select id, round(p, 6) as p, round(least(1.0, min(p * m / r) over (order by r desc)), 6) as adjusted from r")
def benjamini_hochberg(spark, sf_dir):
    return statistics.corrected(_p(spark, sf_dir), "benjamini_hochberg")


@query("select event_id, round((value - (select avg(value) from events)) / (select stddev_pop(value) from events), 6) as value from events")
def standardised_features(spark, sf_dir):
    return experiments.standardise(table(spark, sf_dir, "events").select("event_id", "value"), ["value"])


@query("select event_type, count(*) as rows, round(count(*) / sum(count(*)) over (), 6) as share from events group by 1")
def dataset_statistics(spark, sf_dir):
    return experiments.dataset_statistics(table(spark, sf_dir, "events"), "event_type")


@query("select event_id, dense_rank() over (order by event_type) - 1 as label_id from events")
def label_index(spark, sf_dir):
    return experiments.label_index(table(spark, sf_dir, "events"), "event_type").select("event_id", F.col("label_id").cast("bigint").alias("label_id"))


@query("with c as (select event_type, count(*) as n from events group by 1), s as (select event_type, n, cast(floor(n * 0.7 + 0.5) as bigint) as a, cast(floor(n * 0.85 + 0.5) as bigint) as b from c) select event_type, unnest(['train', 'validation', 'test']) as split, unnest([a, b - a, n - b]) as rows from s")
def stratified_split(spark, sf_dir):
    d = experiments.stratified_split(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type", 0.7, 0.15)
    return d.groupBy("event_type", "split").agg(F.count("*").alias("rows"))


@query("with c as (select event_type, count(*) as n from events group by 1) select event_type, cast(unnest(range(0, 10)) as integer) as fold, n // 10 + case when unnest(range(0, 10)) < n % 10 then 1 else 0 end as rows from c")
def stratified_folds(spark, sf_dir):
    d = experiments.stratified_folds(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type", 10)
    return d.groupBy("event_type", "fold").agg(F.count("*").alias("rows"))


@query()
def exact_sample(spark, sf_dir):
    return experiments.exact_sample(table(spark, sf_dir, "events"), "event_id", 100)


@query(
    'with l as (select l_orderkey, l_linenumber, l_extendedprice as d, l_quantity as q, l_discount as s, l_tax as t from lineitem) select l_orderkey, l_linenumber, round(q / greatest(d / 1e6, 1.0), 6) as requests_per_second, round(s / (select avg(s) from l), 6) as burst_ratio, round(t / greatest(q, 1.0), 6) as packet_size_cv from l'
)
def flow_features(spark, sf_dir):
    c = F.col
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", c("l_extendedprice").alias("Flow Duration"), c("l_quantity").alias("Total Fwd Packets"), c("l_discount").alias("Flow Packets/s"), c("l_tax").alias("Fwd Packet Length Std"), c("l_quantity").alias("Fwd Packet Length Mean"),
        c("l_tax").alias("Flow IAT Std"), c("l_quantity").alias("Flow IAT Mean"), c("l_linenumber").alias("SYN Flag Count"), c("l_discount").alias("ACK Flag Count"),
    )
    return experiments.flow_features(li).select("l_orderkey", "l_linenumber", "requests_per_second", "burst_ratio", "packet_size_cv")


def _without(parts: dict[str, list[str]], row: str) -> str:
    """One row of SQL for all rules and one for each part left out; ``row`` has {name} and {gone}."""
    lists = {"full": [], **parts}
    return " union all ".join(row.format(name=k, gone="(" + ", ".join(repr(x) for x in ["", *v]) + ")") for k, v in lists.items())


_RULE_ABLATION = _without(
    rules.CATEGORIES,
    "select '{name}' as component, tp, fp, fn, round(case when tp > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end, 6) as f1 from (select count(*) filter (hit and label) as tp, count(*) filter (hit and not label) as fp, "
    "count(*) filter (not hit and label) as fn from (select label, session_id in (select session_id from mem where rule not in {gone}) as hit from truth))",
)


@query(f"{MEMBERS}, truth as (select distinct session_id, cast(session_id[2:] as bigint) % 3 = 0 as label from http) {_RULE_ABLATION}")
def rule_ablation(spark, sf_dir):
    f = frames(spark, sf_dir)
    truth = f.http.select("session_id").distinct().withColumn("label", (F.regexp_replace("session_id", "^u", "").cast("int") % 3 == 0).cast("int"))
    return experiments.rule_ablation(f, truth, TABLES)


_AT = "r as (select value as threshold, count(*) filter (event_type = 'error') as p, count(*) as n from events where value is not null and event_type is not null group by 1)"


@query(
    f"with {_AT} select round(threshold, 6) as threshold, round(sum(p) over (order by threshold desc) / sum(p) over (), 6) as tpr, "
    "round(sum(n - p) over (order by threshold desc) / sum(n - p) over (), 6) as fpr from r"
)
def roc_points(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", (F.col("event_type") == "error").cast("int"))
    return statistics.roc_points(e, "t", "value")


_ONTOLOGY_ABLATION = _without(
    experiments.COMPONENTS,
    "select '{name}' as component, count(*) as anomalies, count(distinct target_endpoint) filter (target_endpoint <> '') as endpoints from found where rule not in {gone}",
)


@query(f"{FOUND} {_ONTOLOGY_ABLATION}")
def rule_ablation_by_ontology(spark, sf_dir):
    return experiments.ontology_ablation(frames(spark, sf_dir), TABLES)


@query(f"with {HTTP}, v as (select session_id, unnest(['token:' || token, 'fingerprint:' || tls_fingerprint, 'prefix:' || regexp_extract(src_ip, '^([^.]*[.][^.]*[.][^.]*)', 1)]) as dst from http) select distinct 'session:' || session_id as src, dst, 'hasIdentity' as rel from v")
def identity_edges(spark, sf_dir):
    return crosssession.identity_edges(ev.http_requests(spark, sf_dir))


@query(f"with {HTTP} select distinct 'session:' || session_id as src, 'endpoint:' || endpoint as dst, 'targets' as rel, case endpoint when '/login' then 'Auth' when '/api/items' then 'API' when '/graphql' then 'API' else 'Static' end as endpoint_class from http")
def target_edges(spark, sf_dir):
    return crosssession.target_edges(ev.http_requests(spark, sf_dir))


@query(f"with {HTTP}, n as (select session_id, endpoint, count(*) as k from http group by 1, 2), h as (select session_id, log2(sum(k)) - sum(k * log2(k)) / sum(k) as h from n group by 1) select session_id, round(h, 6) as route_entropy, case when h < 2.25 then 'BotBehavior' else 'UserBehavior' end as behaviour from h")
def behaviour_by_entropy(spark, sf_dir):
    return crosssession.behaviour_by_entropy(ev.http_requests(spark, sf_dir), replace(LIMITS, route_entropy=2.25))


@query(f"with {HTTP} select request_id from http where ts <= timestamp '2024-01-10 00:00:00' and ts > timestamp '2024-01-10 00:00:00' - interval 1 day")
def window_purge(spark, sf_dir):
    return crosssession.in_window(ev.http_requests(spark, sf_dir), "2024-01-10 00:00:00", 86_400).select("request_id")


@query(
    f"with {_AT} select round(threshold, 6) as threshold, round(sum(p) over (order by threshold desc) / sum(n) over (order by threshold desc), 6) as precision, "
    "round(sum(p) over (order by threshold desc) / sum(p) over (), 6) as recall from r"
)
def precision_recall_points(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", (F.col("event_type") == "error").cast("int"))
    return statistics.precision_recall_points(e, "t", "value")


@query()
def response_payload(spark, sf_dir):
    a = anomalies(spark, sf_dir).where("severity = 'high'")
    return correlate.response_payload(a.select(*PLAIN), correlate.coordinated_attacks(a, 1e12), semantic.endpoint_under_attack(a))


@query()
def feature_importance(spark, sf_dir):
    s = frames(spark, sf_dir).session.withColumn("label", (F.col("failed_logins") > 12).cast("int")).na.fill(0)
    return experiments.feature_importance(s, ["request_count", "navigation_diversity", "avg_response_time_ms", "response_time_std", "error_count"], "label")


@query()
def session_clusters(spark, sf_dir):
    s = frames(spark, sf_dir).session
    return experiments.session_clusters(s, ["request_count", "error_count"], 2).groupBy("prediction").agg(F.count("*").alias("sessions"))


@query()
def session_outliers(spark, sf_dir):
    cols = ["request_count", "navigation_diversity", "avg_response_time_ms", "response_time_std", "error_count"]
    s = experiments.standardise(frames(spark, sf_dir).session.select("session_id", *cols), cols)
    return experiments.reconstruction_scores(s, cols, F.lit(True), k=3).select("session_id", "mse", "outlier")
