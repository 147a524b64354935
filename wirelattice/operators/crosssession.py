"""Cross-session and cross-surface reasoning.

Sessions are related if they share a signal (identity token, TLS fingerprint, address prefix) within a window. Relations are kept as stars around signals, not as pairs,
and components are found on the bipartite graph, so a signal that a third of all sessions share costs one edge per session.
However many sessions share a signal, all of them are related.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelattice.functions.scalars import base_domain, char_entropy, endpoint_class, ip_prefix, subdomain
from wirelattice.operators.components import connected_components


@dataclass(frozen=True)
class Limits:
    """Calibration parameters: the drafts leave them open, these are our defaults."""

    window_s: int = 300
    fail_ratio: float = 0.5
    rate: float = 10.0
    api_rate: float = 5.0
    quota: float = 1.0
    route_entropy: float = 1.0
    nxdomain: int = 20
    entropy: float = 3.0
    cache_miss: int = 20
    signals: tuple[str, ...] = ("identity", "fingerprint", "prefix")


def signals(http: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(session_id, window, kind, value): what a session shows in each window of its activity."""
    w = F.floor(F.unix_seconds("ts") / limits.window_s)
    kinds = {"identity": F.col("token"), "fingerprint": F.col("tls_fingerprint"), "prefix": ip_prefix(F.col("src_ip"))}
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), kinds[k].alias("value")) for k in limits.signals))
    rows = http.where("session_id <> ''").select("session_id", w.alias("window"), F.explode(pairs).alias("p")).select("session_id", "window", "p.kind", "p.value")
    return rows.where("value is not null and value <> ''").distinct()


def related_stars(http: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(hub, session_id): sessions around the smallest session of each signal and window that two or more share."""
    s = signals(http, limits)
    hubs = s.groupBy("kind", "value", "window").agg(F.min("session_id").alias("hub"), F.count("*").alias("k")).where("k >= 2")
    return s.join(hubs, ["kind", "value", "window"]).where("session_id <> hub").select("hub", "session_id").distinct()


def campaigns(http: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(session_id, campaign): components of related sessions; a session without relations is its own."""
    cc = connected_components(related_stars(http, limits), "hub", "session_id") if limits.signals else None
    every = http.where("session_id <> ''").select("session_id").distinct()
    if cc is None:
        return every.select("session_id", F.col("session_id").alias("campaign"))
    return every.join(cc, every.session_id == cc.node, "left").select("session_id", F.coalesce("component", "session_id").alias("campaign"))


def _by_campaign(http: DataFrame, members: DataFrame) -> DataFrame:
    """Per campaign and endpoint, from per-session partial sums."""
    part = http.groupBy("session_id", "endpoint").agg(F.count("*").alias("n"), F.count_if(F.col("response_code").isin(401, 403)).alias("failed"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return part.join(members, "session_id").groupBy("campaign", "endpoint").agg(
        F.count("*").alias("sessions"), F.sum("n").alias("requests"), F.sum("failed").alias("failed"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("n").alias("most"),
    )


def _tokens(http: DataFrame, members: DataFrame) -> DataFrame:
    """Per campaign and endpoint the number of distinct tokens, over all tokens of each session."""
    seen = http.select("session_id", "endpoint", "token").distinct().join(members, "session_id")
    return seen.groupBy(F.col("campaign").alias("c"), F.col("endpoint").alias("e")).agg(F.countDistinct("token").alias("tokens"))


def _span():
    return F.greatest((F.unix_micros("last") - F.unix_micros("first")) / 1e6, F.lit(1.0))


def credential_stuffing(http: DataFrame, members: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Campaigns of two or more sessions whose requests to one login endpoint mostly fail."""
    c = _by_campaign(http, members).where((endpoint_class(F.col("endpoint")) == "Auth") & (F.col("sessions") >= 2))
    return c.withColumn("fail_ratio", F.col("failed") / F.col("requests")).where(F.col("fail_ratio") > limits.fail_ratio).select("campaign", "endpoint", "sessions", "requests", "fail_ratio")


def coordinated_http_flood(http: DataFrame, members: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Campaigns whose rate on one endpoint is high while each of its sessions roams little."""
    c = _by_campaign(http, members).where("sessions >= 2").withColumn("rate", F.col("requests") / _span()).where(F.col("rate") > limits.rate)
    calm = route_entropy(http).join(members, "session_id").groupBy("campaign").agg(F.max("route_entropy").alias("highest"))
    return c.join(calm, "campaign").where(F.col("highest") < limits.route_entropy).select("campaign", "endpoint", "sessions", "requests", "rate")


def coordinated_api_abuse(http: DataFrame, members: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Campaigns with several tokens whose summed rate is high while no session exceeds its quota."""
    http = http.where(endpoint_class(F.col("endpoint")) == "API")
    c = _by_campaign(http, members).where("sessions >= 2")
    c = c.join(_tokens(http, members).where("tokens >= 2"), F.col("campaign").eqNullSafe(F.col("c")) & (F.col("endpoint") == F.col("e")))
    c = c.withColumn("rate", F.col("requests") / _span()).withColumn("session_rate", F.col("most") / _span())
    return c.where((F.col("rate") > limits.api_rate) & (F.col("session_rate") <= limits.quota)).select("campaign", "endpoint", "sessions", "tokens", "requests", "rate")


def route_entropy(http: DataFrame) -> DataFrame:
    """Per session the entropy in bits of its endpoints."""
    n = http.where("session_id <> ''").groupBy("session_id", "endpoint").count()
    # H = log2(N) - sum(n log2 n) / N
    return n.groupBy("session_id").agg((F.log2(F.sum("count")) - F.sum(F.col("count") * F.log2("count")) / F.sum("count")).alias("route_entropy"))


def mitigation_scope(http: DataFrame, members: DataFrame) -> DataFrame:
    """Per campaign the signals whose value all its sessions share."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in (("identity", F.col("token")), ("fingerprint", F.col("tls_fingerprint")), ("prefix", ip_prefix(F.col("src_ip"))))))
    rows = http.join(members, "session_id").select("campaign", F.explode(kinds).alias("p"))
    return rows.groupBy("campaign", "p.kind").agg(F.min("p.value").alias("value"), F.max("p.value").alias("other")).where("value = other").select("campaign", "kind", "value")


def collateral(http: DataFrame, legitimate, in_scope) -> DataFrame:
    """The share of legitimate requests that a mitigation would hit."""
    return http.agg((F.count_if(legitimate & in_scope) / F.greatest(F.count_if(legitimate), F.lit(1))).alias("collateral"))


def campaign_recall(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """The share of instrumented campaigns with a detection (truth: session_id, campaign_id; detected: session_id)."""
    hit = truth.join(detected.select("session_id").distinct().withColumn("hit", F.lit(1)), "session_id", "left")
    return hit.groupBy("campaign_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit")).agg(F.avg("hit").alias("recall"))


def cross_surface(dns: DataFrame, http: DataFrame, limits: Limits = Limits(), apart: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """Address prefixes that show both a DNS and an HTTP sign within one window, each below its own limit.

    An equi-join on prefix and window; each DNS summary goes to the windows ``apart`` from its own, by default both neighbours too, so signs at most one window apart meet in either order.
    """
    w = F.floor(F.unix_seconds("ts") / limits.window_s)
    d = dns.groupBy(ip_prefix(F.col("src_ip")).alias("prefix"), w.alias("window")).agg(F.count_if(F.col("response_code") == "NXDOMAIN").alias("nxdomain"), F.avg(char_entropy(subdomain(F.col("qname")))).alias("entropy"))
    d = d.where((F.col("nxdomain") > 0) & (F.col("nxdomain") <= limits.nxdomain)).withColumn("window", F.explode(F.array(*(F.col("window") + i for i in apart))))
    h = http.groupBy(ip_prefix(F.col("src_ip")).alias("prefix"), w.alias("window")).agg(F.count_if(F.col("response_code") >= 400).alias("errors"), F.count("*").alias("requests")).where((F.col("errors") > 0) & (F.col("errors") <= limits.cache_miss))
    return d.join(h, ["prefix", "window"]).select("prefix", "window", "nxdomain", "entropy", "errors", "requests")


def dns_identity_rule(dns: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Addresses with many NXDOMAIN answers for names of high entropy."""
    g = dns.groupBy("src_ip").agg(F.count_if(F.col("response_code") == "NXDOMAIN").alias("nxdomain"), F.avg(char_entropy(subdomain(F.col("qname")))).alias("entropy"), F.countDistinct(base_domain(F.col("qname"))).alias("domains"))
    return g.where((F.col("nxdomain") > limits.nxdomain) & (F.col("entropy") > limits.entropy))


def cache_busting(http: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Identities with many requests whose query strings look random and miss the cache (needs ``path`` and ``cache_status``)."""
    query = F.coalesce(F.parse_url(F.concat(F.lit("http://h"), "path"), F.lit("QUERY")), F.lit(""))
    g = http.withColumn("e", char_entropy(query)).groupBy("token").agg(F.count_if(F.col("e") > limits.entropy).alias("random"), F.avg((F.col("cache_status") == "HIT").cast("int")).alias("hit_rate"))
    return g.where((F.col("random") > limits.cache_miss) & (F.col("hit_rate") < 0.5))


def identity_edges(http: DataFrame) -> DataFrame:
    """(src, dst, rel): sessions and the identities, fingerprints and prefixes that they show."""
    kinds = {"token": F.col("token"), "fingerprint": F.col("tls_fingerprint"), "prefix": ip_prefix(F.col("src_ip"))}
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in kinds.items()))
    rows = http.where("session_id <> ''").select("session_id", F.explode(pairs).alias("p")).where("p.value is not null and p.value <> ''").distinct()
    return rows.select(F.concat(F.lit("session:"), "session_id").alias("src"), F.concat(F.col("p.kind"), F.lit(":"), F.col("p.value")).alias("dst"), F.lit("hasIdentity").alias("rel"))


def target_edges(http: DataFrame) -> DataFrame:
    """(src, dst, rel, endpoint_class): the endpoints that sessions ask."""
    rows = http.where("session_id <> ''").select("session_id", "endpoint").distinct()
    return rows.select(F.concat(F.lit("session:"), "session_id").alias("src"), F.concat(F.lit("endpoint:"), "endpoint").alias("dst"), F.lit("targets").alias("rel"), endpoint_class(F.col("endpoint")).alias("endpoint_class"))


def behaviour_by_entropy(http: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(session_id, route_entropy, behaviour): little variety of routes is a bot's."""
    return route_entropy(http).withColumn("behaviour", F.when(F.col("route_entropy") < limits.route_entropy, "BotBehavior").otherwise("UserBehavior"))


def in_window(events: DataFrame, as_of, seconds: int = 300) -> DataFrame:
    """The events of the operational window that ends at ``as_of``; what is older is purged."""
    at = F.lit(as_of).cast("timestamp")
    return events.where((F.col("ts") <= at) & (F.col("ts") > at - F.make_dt_interval(secs=F.lit(seconds))))
