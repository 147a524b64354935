"""Detection rules: each a filter and a projection over a metric table, one row per anomaly.

All comparisons are strict. Thresholds are a parameter; two named profiles exist. Every anomaly carries its measure, so results compare without parsing text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelattice.functions.scalars import clamp, severity
from wirelattice.operators.metrics import Frames


@dataclass(frozen=True)
class Thresholds:
    """The limits of the rules."""

    failed_logins: int = 10
    http_rps: float = 50
    header_variability: float = 0.15
    fingerprint_variability: float = 0.15
    profile_diversity: float = 0.2
    bot_needs_all: bool = False
    low_value_requests: int = 50
    low_value: float = 0.1
    expensive_cost: float = 0.7
    expensive_rps: float = 30
    latency_ratio: float = 3
    latency_per_request: bool = False
    repetitive_diversity: float = 0.2
    repetitive_requests: int = 30
    slow_ms: int = 30_000
    slow_post_only: bool = False
    scraping_endpoints: int = 50
    scraping_diversity: float = 0.8
    scraping_needs_bot: bool = False
    api_error_rate: float = 0.3
    random_ratio: float = 0.7
    random_queries: int = 50
    unique_subdomains: int = 500
    nxdomain_ratio: float = 0.6
    nxdomain_queries: int = 30
    torture_subdomains: int = 100
    torture_qps: tuple[float, float] = (1, 50)
    torture_events: int = 10
    steadiness: float = 0.5
    amplification: float = 10
    amplification_bytes: int = 1000
    any_queries: int = 5
    phantom_ms: float = 2000
    phantom_ratio: float = 0.3
    phantom_queries: int = 20
    tunnel_score: float = 0.4
    tunnel_queries: int = 20


CODE = Thresholds()
#: The ontology's stricter set.
ONTOLOGY = replace(
    CODE, http_rps=100, header_variability=0.1, fingerprint_variability=0.1, bot_needs_all=True, low_value_requests=100, expensive_rps=50, latency_per_request=True, repetitive_requests=50, slow_post_only=True,
    scraping_endpoints=100, scraping_needs_bot=True,
)

#: Columns of an anomaly.
COLUMNS = ["rule", "anomaly_id", "anomaly_type", "attack_type", "subject_type", "subject_id", "score", "confidence", "severity", "target_endpoint", "measure", "related_sessions", "ts", "evidence"]


def anomaly(
    df: DataFrame, rule: str, kind: str, attack: str, prefix: str, subject: str, subject_id: Column, score: Column, confidence: float, measure: Column, *,
    level: Column | None = None, target: Column | None = None, sessions: Column | None = None, ts: Column | None = None, evidence: dict[str, Column] | None = None,
) -> DataFrame:
    none = F.array().cast("array<string>")
    lines = [F.concat(F.lit(f"{k}: "), F.when(v.isNull(), "").otherwise(v.cast("string"))) for k, v in (evidence or {}).items()]
    when = F.coalesce(ts, F.lit(None).cast("timestamp")) if ts is not None else F.lit(None).cast("timestamp")
    return df.select(
        F.lit(rule).alias("rule"), F.concat_ws("_", F.lit(prefix), subject_id.cast("string")).alias("anomaly_id"), F.lit(kind).alias("anomaly_type"), F.lit(attack).alias("attack_type"), F.lit(subject).alias("subject_type"),
        subject_id.cast("string").alias("subject_id"), score.cast("double").alias("score"), F.lit(confidence).alias("confidence"), (F.lit("medium") if level is None else level).alias("severity"),
        (F.lit("") if target is None else target).alias("target_endpoint"), measure.cast("double").alias("measure"), (none if sessions is None else sessions).alias("related_sessions"), when.alias("ts"),
        (F.array(*lines) if lines else none).alias("evidence"),
    )


def _session(c: str = "session_id") -> Column:
    return F.array(F.col(c))


def login_flood(f: Frames, t: Thresholds) -> DataFrame:
    d = f.session.where(F.col("failed_logins") > t.failed_logins)
    score = clamp(F.col("failed_logins") / 20)
    return anomaly(d, "login_flood", "LoginFloodAnomaly", "LoginFlood", "login_flood", "session", F.col("session_id"), score, 0.85, F.col("failed_logins"), level=severity(score), target=F.lit("/login"), sessions=_session(), ts=F.col("last_activity"), evidence={"Failed logins": F.col("failed_logins"), "Session": F.col("session_id")})


def http_flood(f: Frames, t: Thresholds) -> DataFrame:
    d = f.session.where(F.col("requests_per_second") > t.http_rps)
    score = clamp(F.col("requests_per_second") / 100)
    return anomaly(d, "http_flood", "HTTPFloodAnomaly", "HTTPFlood", "http_flood", "session", F.col("session_id"), score, 0.8, F.col("requests_per_second"), level=severity(score), target=F.col("target_endpoint"), sessions=_session(), ts=F.col("last_activity"), evidence={"Requests per second": F.col("requests_per_second"), "Target": F.col("target_endpoint")})


def bot_behavior(f: Frames, t: Thresholds) -> DataFrame:
    h, p, n = F.col("header_variability"), F.col("fingerprint_variability"), F.col("navigation_diversity")
    fires = ((h < t.header_variability) & (p < t.fingerprint_variability)) if t.bot_needs_all else (h < t.header_variability) | (p < t.fingerprint_variability) | (n < t.profile_diversity)
    d = f.profiles.where(fires)
    return anomaly(d, "bot_behavior", "BotBehaviorAnomaly", "BotBehavior", "bot", "profile", F.col("profile_id"), 1 - F.least(h, p, n), 0.75, F.least(h, p, n), sessions=_session(), evidence={"Header variability": h, "Fingerprint variability": p, "Navigation diversity": n})


def low_session_value(f: Frames, t: Thresholds) -> DataFrame:
    value = F.col("navigation_diversity") * (1 - F.col("error_count") / F.greatest(F.col("request_count"), F.lit(1)))
    d = f.session.withColumn("value", value).where((F.col("request_count") > t.low_value_requests) & (F.col("value") < t.low_value))
    return anomaly(d, "low_session_value", "LowSessionValueAnomaly", "APIAttack", "low_value", "session", F.col("session_id"), 1 - F.col("value"), 0.7, F.col("value"), sessions=_session(), ts=F.col("last_activity"), evidence={"Session value": F.col("value"), "Requests": F.col("request_count")})


def expensive_endpoint_burst(f: Frames, t: Thresholds) -> DataFrame:
    d = f.endpoint.join(f.endpoints, F.col("endpoint") == F.col("path")).where((F.col("computational_cost") > t.expensive_cost) & (F.col("requests_per_second") > t.expensive_rps)).join(f.endpoint_sessions, "endpoint", "left")
    score = clamp(F.col("requests_per_second") / 60) * F.col("computational_cost")
    return anomaly(d, "expensive_endpoint_burst", "ExpensiveEndpointBurstAnomaly", "HTTPFlood", "expensive", "endpoint", F.col("endpoint"), score, 0.9, F.col("requests_per_second"), level=severity(score), target=F.col("endpoint"), sessions=F.col("sessions"), evidence={"Request rate": F.col("requests_per_second"), "Cost": F.col("computational_cost")})


def latency_increase(f: Frames, t: Thresholds) -> DataFrame:
    known = f.endpoints.where("average_response_time_ms > 0")
    rows = f.http.select("endpoint", F.col("response_time_ms").alias("avg_response_time_ms"), F.col("request_id").alias("subject")) if t.latency_per_request else f.endpoint.withColumn("subject", F.col("endpoint"))
    ratio = F.col("rt") / F.col("average_response_time_ms")
    d = rows.withColumnRenamed("avg_response_time_ms", "rt").join(known, F.col("endpoint") == F.col("path")).where(ratio > t.latency_ratio)
    return anomaly(d, "latency_increase", "LatencyIncreaseAnomaly", "HTTPFlood", "latency", "endpoint", F.col("subject"), clamp(ratio / 5), 0.6, ratio, target=F.col("endpoint"), evidence={"Latency ratio": ratio, "Average response time": F.col("rt")})


def repetitive_route(f: Frames, t: Thresholds) -> DataFrame:
    n = F.col("navigation_diversity")
    d = f.session.where((n < t.repetitive_diversity) & (F.col("request_count") > t.repetitive_requests))
    return anomaly(d, "repetitive_route", "RepetitiveRouteAnomaly", "BotBehavior", "repetitive", "session", F.col("session_id"), 1 - n, 0.7, n, sessions=_session(), ts=F.col("last_activity"), evidence={"Navigation diversity": n, "Requests": F.col("request_count")})


def slow_request(f: Frames, t: Thresholds) -> DataFrame:
    rt = F.col("response_time_ms")
    d = f.http.where((rt > t.slow_ms) & ((F.col("method") == "POST") if t.slow_post_only else F.lit(True)))
    score = clamp(rt / 60_000)
    return anomaly(d, "slow_request", "SlowRequestAnomaly", "SlowRequestAttack", "slow", "request", F.col("request_id"), score, 0.75, rt, level=severity(score), target=F.col("endpoint"), sessions=_session(), ts=F.col("ts"), evidence={"Response time": rt, "Endpoint": F.col("endpoint")})


def scraping(f: Frames, t: Thresholds) -> DataFrame:
    bots = f.profiles.groupBy("session_id").agg(F.bool_or("is_bot_like").alias("bot"))
    bot = F.coalesce("bot", F.lit(False))
    d = f.session.where(F.col("unique_endpoints") > t.scraping_endpoints).join(bots, "session_id", "left").where(bot if t.scraping_needs_bot else bot | (F.col("navigation_diversity") > t.scraping_diversity))
    return anomaly(d, "scraping", "ScrapingAnomaly", "ScrapingAttack", "scraping", "session", F.col("session_id"), clamp(F.col("unique_endpoints") / 100), 0.8, F.col("unique_endpoints"), sessions=_session(), ts=F.col("last_activity"), evidence={"Unique endpoints": F.col("unique_endpoints")})


def api_abuse(f: Frames, t: Thresholds) -> DataFrame:
    is_api = F.col("endpoint").contains("/api/") | F.col("endpoint").contains("/graphql")
    d = f.endpoint.where(is_api & (F.col("error_rate") > t.api_error_rate)).join(f.endpoint_sessions, "endpoint", "left")
    return anomaly(d, "api_abuse", "APIAbuseAnomaly", "APIAttack", "api_abuse", "endpoint", F.col("endpoint"), clamp(2 * F.col("error_rate")), 0.75, F.col("error_rate"), target=F.col("endpoint"), sessions=F.col("sessions"), evidence={"Error rate": F.col("error_rate"), "Endpoint": F.col("endpoint")})


def _dns(name: Column) -> Column:
    return F.concat(F.lit("DNS:"), name)


def qname_randomization(f: Frames, t: Thresholds) -> DataFrame:
    r = F.col("random_subdomain_ratio")
    d = f.ip.where((r > t.random_ratio) & (F.col("query_count") > t.random_queries))
    score = clamp(1.5 * r)
    return anomaly(d, "qname_randomization", "QNameRandomizationAnomaly", "QNameRandomization", "qname_random", "src_ip", F.col("src_ip"), score, 0.85, r, level=severity(score), target=_dns(F.col("primary_domain")), evidence={"Random subdomain ratio": r, "IP address": F.col("src_ip")})


def qname_randomization_domain(f: Frames, t: Thresholds) -> DataFrame:
    u = F.col("unique_subdomains")
    d, score = f.domain.where(u > t.unique_subdomains), clamp(u / 1000)
    return anomaly(d, "qname_randomization_domain", "QNameRandomizationAnomaly", "QNameRandomization", "qname_random_domain", "domain", F.col("base_domain"), score, 0.8, u, level=severity(score), target=_dns(F.col("base_domain")), evidence={"Unique subdomains": u})


def nxdomain_flood(f: Frames, t: Thresholds) -> DataFrame:
    r = F.col("nxdomain_ratio")
    d, score = f.ip.where((r > t.nxdomain_ratio) & (F.col("query_count") > t.nxdomain_queries)), clamp(1.5 * r)
    return anomaly(d, "nxdomain_flood", "NXDOMAINFloodAnomaly", "NXDOMAINFlood", "nxdomain_flood", "src_ip", F.col("src_ip"), score, 0.85, r, level=severity(score), target=F.lit("DNS:Resolver"), evidence={"NXDOMAIN ratio": r, "IP address": F.col("src_ip")})


def nxdomain_flood_domain(f: Frames, t: Thresholds) -> DataFrame:
    r = F.col("nxdomain_ratio")
    return anomaly(f.domain.where(r > t.nxdomain_ratio), "nxdomain_flood_domain", "NXDOMAINFloodAnomaly", "NXDOMAINFlood", "nxdomain_domain", "domain", F.col("base_domain"), clamp(r), 0.75, r, target=_dns(F.col("base_domain")), evidence={"NXDOMAIN ratio": r})


def dns_water_torture(f: Frames, t: Thresholds) -> DataFrame:
    u, q, s = F.col("unique_subdomains"), F.col("queries_per_second"), F.col("steadiness")
    d = f.domain.where((u > t.torture_subdomains) & (q > t.torture_qps[0]) & (q < t.torture_qps[1]) & (F.col("query_count") >= t.torture_events) & (s > t.steadiness))
    return anomaly(d, "dns_water_torture", "DNSWaterTortureAnomaly", "DNSWaterTorture", "water_torture", "domain", F.col("base_domain"), clamp(u / 500) * s, 0.7, s, target=_dns(F.col("base_domain")), evidence={"Unique subdomains": u, "Steadiness": s})


def dns_amplification(f: Frames, t: Thresholds) -> DataFrame:
    q, r = F.col("query_size"), F.col("response_size")
    factor = r / q
    d, score = f.dns.where((q > 0) & (r > 0) & ((factor > t.amplification) | (r > t.amplification_bytes))), clamp(factor / 50)
    return anomaly(d, "dns_amplification", "DNSAmplificationAnomaly", "DNSAmplification", "dns_amp", "query", F.col("query_id"), score, 0.8, factor, level=severity(score), target=_dns(F.col("qname")), ts=F.col("ts"), evidence={"Amplification factor": factor, "IP address": F.col("src_ip")})


def dns_amplification_any(f: Frames, t: Thresholds) -> DataFrame:
    n = F.col("any_count")
    return anomaly(f.ip.where(n > t.any_queries), "dns_amplification_any", "DNSAmplificationAnomaly", "DNSAmplification", "dns_amp_any", "src_ip", F.col("src_ip"), F.lit(0.75), 0.85, n, level=F.lit("high"), target=F.lit("DNS:Resolver"), evidence={"ANY queries": n, "IP address": F.col("src_ip")})


def phantom_domain(f: Frames, t: Thresholds) -> DataFrame:
    r = F.col("timeout_ratio")
    d = f.domain.where(((F.col("avg_response_time_ms") > t.phantom_ms) | (r > t.phantom_ratio)) & (F.col("query_count") > t.phantom_queries))
    return anomaly(d, "phantom_domain", "PhantomDomainAnomaly", "PhantomDomainAttack", "phantom_domain", "domain", F.col("base_domain"), clamp(2 * r), 0.7, r, target=_dns(F.col("base_domain")), evidence={"Average response time": F.col("avg_response_time_ms"), "Timeout ratio": r})


def dns_tunneling(f: Frames, t: Thresholds) -> DataFrame:
    x = 0.3 * F.col("txt_ratio") + 0.4 * F.col("long_ratio") + 0.3 * F.col("high_entropy_ratio")
    d, score = f.ip.withColumn("x", x).where((F.col("x") > t.tunnel_score) & (F.col("query_count") > t.tunnel_queries)), clamp(2 * F.col("x"))
    return anomaly(d, "dns_tunneling", "DNSTunnelingAnomaly", "DNSTunneling", "dns_tunnel", "src_ip", F.col("src_ip"), score, 0.75, F.col("x"), level=severity(score), target=F.lit("DNS:Tunnel"), evidence={"Tunnel score": F.col("x"), "IP address": F.col("src_ip")})


def cache_bypass(f: Frames, t: Thresholds) -> DataFrame:
    """Requests that ask a cacheable endpoint not to be served from the cache (needs ``headers``)."""
    d = f.http.where(F.lower(F.col("headers")["Cache-Control"]) == "no-cache").join(f.endpoints.where("is_cacheable"), F.col("endpoint") == F.col("path"))
    return anomaly(d, "cache_bypass", "CacheBypassAnomaly", "CacheBypass", "cache_bypass", "request", F.col("request_id"), F.lit(0.65), 0.65, F.lit(1), target=F.col("endpoint"), sessions=_session(), ts=F.col("ts"))


Rule = Callable[[Frames, Thresholds], DataFrame]
#: In the order in which ties are broken.
RULES: dict[str, Rule] = {
    r.__name__: r
    for r in (
        login_flood, http_flood, bot_behavior, low_session_value, expensive_endpoint_burst, latency_increase, repetitive_route, slow_request, scraping, api_abuse, qname_randomization, qname_randomization_domain,
        nxdomain_flood, nxdomain_flood_domain, dns_water_torture, dns_amplification, dns_amplification_any, phantom_domain, dns_tunneling,
    )
}
#: Rules by category, for ablation.
CATEGORIES = {
    "volume": ["http_flood", "login_flood", "expensive_endpoint_burst", "nxdomain_flood", "nxdomain_flood_domain", "dns_amplification", "dns_amplification_any"],
    "structural": ["repetitive_route", "qname_randomization", "qname_randomization_domain", "dns_tunneling"],
    "behavioural": ["bot_behavior", "low_session_value", "scraping", "slow_request"],
    "intelligence": ["latency_increase", "api_abuse", "dns_water_torture", "phantom_domain"],
}


def detect(frames: Frames, thresholds: Thresholds = CODE, rules: list[str] | None = None) -> DataFrame:
    """The union of the rules' anomalies; idempotent, and independent of the order of rows."""
    chosen = list(RULES) if rules is None else rules
    order = F.create_map(*(F.lit(x) for i, name in enumerate(RULES) for x in (name, i)))
    found = reduce(DataFrame.unionByName, [RULES[name](frames, thresholds) for name in chosen])
    return found.withColumn("rule_seq", order[F.col("rule")])


#: The attack types of DNS anomalies.
DNS_ATTACKS = ["QNameRandomization", "NXDOMAINFlood", "DNSWaterTorture", "DNSAmplification", "DNSTunneling", "PhantomDomainAttack"]


def top_anomalies(anomalies: DataFrame, k: int = 3, attack_types: list[str] | None = None) -> DataFrame:
    """The k anomalies of the highest score, of ``attack_types`` where they are given, with their ``rank`` from 1.

    Scores that agree to six places are ties, which go by the order of rules and then by subject. Each task keeps k rows
    (no sort of the whole table). Fewer than k anomalies give as many rows as there are.
    """
    a = anomalies if attack_types is None else anomalies.where(F.col("attack_type").isin(attack_types))
    order = [F.round("score", 6).desc(), F.col("rule_seq"), F.col("subject_id")]
    # the window numbers the k rows that are left
    return a.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def members(anomalies: DataFrame, frames: Frames) -> DataFrame:
    """(anomaly_id, rule, target_endpoint, session_id): every session of each anomaly, once.

    ``related_sessions`` of an endpoint's anomaly lists the first ten for display; here its sessions come from the table of requests by
    session and endpoint. Anomalies about addresses and domains have none.
    """
    a = anomalies.select("anomaly_id", "rule", "target_endpoint", "subject_type", "subject_id", "related_sessions")
    own = a.where("subject_type <> 'endpoint'").select("anomaly_id", "rule", "target_endpoint", F.explode("related_sessions").alias("session_id"))
    pairs = frames.parts.where("session_id is not null").select(F.col("endpoint").alias("subject_id"), "session_id")
    hit = a.where("subject_type = 'endpoint' and size(related_sessions) > 0").select("anomaly_id", "rule", "target_endpoint", "subject_id").join(pairs, "subject_id").drop("subject_id")
    return own.unionByName(hit).where("session_id is not null").distinct()


def composite_score(df: DataFrame, volume: Column, structure: Column, behaviour: Column, intelligence: Column, weights: tuple[float, float, float, float] = (0.3, 0.2, 0.35, 0.15)) -> DataFrame:
    """The weighted sum of four partial scores, with weights that sum to 1."""
    total = sum(weights)
    parts = [F.lit(w / total) * c for w, c in zip(weights, (volume, structure, behaviour, intelligence), strict=True)]
    return df.withColumn("composite", parts[0] + parts[1] + parts[2] + parts[3])
