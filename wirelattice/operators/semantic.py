"""Three questions about anomalies, explanations and STIX objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Weights of severities, and of grades of effectiveness and of impact on legitimate users (more is better).
SEVERITY = {"low": 1, "medium": 2, "high": 3, "critical": 4}
EFFECTIVENESS = {"high": 3, "medium": 2, "low": 1}
IMPACT = {"positive": 4, "low": 3, "medium": 2, "high": 1}

#: Fixed values: (attack_type, action, description, impact on legitimate users, effectiveness, effort).
MITIGATIONS = [
    ("LoginFlood", "enable_captcha", "Add CAPTCHA challenge to login form", "low", "high", "low"),
    ("LoginFlood", "rate_limit_identity", "Rate limit by identity (email/username) not just IP", "low", "high", "medium"),
    ("LoginFlood", "progressive_delay", "Add progressive delays after failed attempts", "low", "medium", "low"),
    ("HTTPFlood", "javascript_challenge", "Implement JavaScript challenge for suspicious sessions", "medium", "high", "medium"),
    ("HTTPFlood", "rate_limit_session", "Rate limit per session token", "low", "high", "low"),
    ("HTTPFlood", "enable_caching", "Enable CDN caching for cacheable endpoints", "positive", "medium", "low"),
    ("BotBehavior", "browser_fingerprinting", "Implement browser fingerprinting checks", "low", "high", "medium"),
    ("BotBehavior", "behavior_analysis", "Enable behavioral analysis for session patterns", "low", "high", "high"),
    ("APIAttack", "api_key_validation", "Require API key for endpoint access", "medium", "high", "medium"),
    ("APIAttack", "api_rate_limiting", "Implement tiered API rate limiting", "low", "high", "low"),
    ("ScrapingAttack", "data_access_limits", "Limit data returned per request", "low", "medium", "low"),
    ("ScrapingAttack", "captcha_on_sensitive", "Add CAPTCHA to sensitive data endpoints", "medium", "high", "low"),
    ("SlowRequestAttack", "connection_timeout", "Configure strict connection timeouts", "low", "high", "low"),
    ("SlowRequestAttack", "request_size_limit", "Limit request body size", "low", "medium", "low"),
]
#: attack_type -> technique; attack_type -> description, and that of all others.
TECHNIQUES = {"HTTPFlood": "T1498.001", "LoginFlood": "T1110.003", "SlowRequestAttack": "T1498.001", "APIAttack": "T1190", "ScrapingAttack": "T1213"}
DESCRIPTIONS = {
    "HTTPFlood": "HTTP flood attack targeting web application endpoints with high request volume",
    "LoginFlood": "Brute force or credential stuffing attack against authentication endpoints",
    "SlowRequestAttack": "Slow request attack (Slowloris/RUDY) consuming server connections",
    "APIAttack": "Abuse of API endpoints through excessive requests or manipulation",
    "ScrapingAttack": "Automated scraping of web application content",
    "BotBehavior": "Automated bot traffic exhibiting malicious patterns",
}
OTHER_DESCRIPTION = "Layer 7 DDoS attack"
#: attack_type -> what its explanation recommends.
RECOMMENDATIONS = {
    "LoginFlood": ["Implement CAPTCHA challenge on login page", "Enable rate limiting per identity (e.g., 5 attempts/minute)", "Add progressive delays after failed attempts", "Consider temporary account lockout"],
    "HTTPFlood": ["Enable rate limiting per session/IP", "Implement JavaScript challenge", "Review WAF rules for this endpoint", "Consider CDN caching for static content"],
    "BotBehavior": ["Implement bot detection (CAPTCHA, JavaScript challenge)", "Review User-Agent patterns", "Enable browser fingerprinting checks", "Consider bot management service"],
    "APIAttack": ["Implement API rate limiting", "Add API key validation", "Review API authentication", "Consider request throttling"],
    "ScrapingAttack": ["Implement robots.txt restrictions", "Add CAPTCHA challenges", "Monitor session patterns", "Consider data access limits"],
    "SlowRequestAttack": ["Configure connection timeouts", "Implement request body size limits", "Enable connection rate limiting", "Review server thread pool settings"],
    "QNameRandomization": ["Implement Response Rate Limiting (RRL) on DNS servers", "Enable DNS query rate limiting per source IP", "Deploy DNS firewall with random subdomain detection", "Configure DNS cache to minimize upstream queries", "Consider DNSSEC to reduce amplification potential"],
    "NXDOMAINFlood": ["Enable NXDOMAIN caching with appropriate TTL", "Implement Response Rate Limiting (RRL)", "Configure negative caching TTL", "Deploy DNS firewall with NXDOMAIN flood detection", "Monitor and rate-limit repetitive NXDOMAIN queries"],
    "DNSWaterTorture": ["Implement DNS query rate limiting with sliding window", "Enable DNS response caching", "Deploy anycast DNS infrastructure", "Monitor long-duration low-rate query patterns", "Consider DNS load balancing across multiple servers"],
    "DNSAmplification": ["Disable open DNS recursion on authoritative servers", "Block DNS ANY queries from external sources", "Implement source IP verification", "Configure Response Rate Limiting (RRL)", "Monitor for unusually large DNS responses"],
    "PhantomDomainAttack": ["Implement aggressive timeout settings for slow domains", "Configure concurrent query limits per domain", "Monitor for domains with consistently slow responses", "Implement fallback DNS servers", "Consider blocking known phantom domains"],
    "DNSTunneling": ["Deploy DNS tunneling detection solutions", "Monitor for unusually long DNS queries", "Block or rate-limit TXT record queries", "Implement DNS query length limits", "Analyze DNS traffic for encoded data patterns"],
}
#: Categories of evidence, tested in this order; the first three on the text as it is, the others on its lower case.
CATEGORIES = [
    ("Failed logins", "authentication_failures"), ("Requests per second", "rate_anomaly"), ("request rate", "rate_anomaly"),
    ("variability", "behavioral_anomaly"), ("diversity", "behavioral_anomaly"), ("latency", "performance_impact"),
    ("response time", "performance_impact"), ("endpoint", "endpoint_targeting"),
]
AS_IT_IS = 3


def _map(values: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def endpoint_under_attack(anomalies: DataFrame) -> DataFrame:
    """The endpoint with the largest count times summed severity; one row also if there is none."""
    weight = F.coalesce(_map(SEVERITY)[F.col("severity")], F.lit(2))
    g = anomalies.where("target_endpoint <> ''").groupBy("target_endpoint").agg(F.count("*").alias("n"), F.sum(weight).alias("w"), F.min("rule_seq").alias("seq"))
    best = g.agg(F.min(F.struct((-F.col("n") * F.col("w")).alias("k"), "seq", "target_endpoint", "n", "w")).alias("b"))
    return best.select(
        F.when(F.col("b").isNull(), "no_attack_detected").otherwise("attack_detected").alias("status"), F.col("b.target_endpoint").alias("endpoint"), F.coalesce(F.col("b.n"), F.lit(0)).cast("long").alias("anomaly_count"),
        F.coalesce(F.col("b.w"), F.lit(0)).cast("long").alias("severity_sum"), F.coalesce(F.least(F.lit(1.0), 0.2 * F.col("b.n")), F.lit(0.0)).alias("confidence"),
    )


def category(line: Column) -> Column:
    out = None
    for i, (text, name) in enumerate(CATEGORIES):
        test = (line if i < AS_IT_IS else F.lower(line)).contains(text)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def hypothesis_evidence(anomalies: DataFrame, attack_type: str) -> DataFrame:
    """Evidence lines for a type of attack, by category, with the hypothesis's confidence."""
    a = anomalies.where(F.col("attack_type") == attack_type)
    n = a.agg(F.count("*").alias("n")).scalar()
    lines = a.select(F.explode("evidence").alias("line")).groupBy(category(F.col("line")).alias("category")).agg(F.count("*").alias("evidence_count"))
    return lines.select(F.lit(attack_type).alias("attack_type"), "category", "evidence_count", n.alias("anomaly_count"), F.least(F.lit(1.0), 0.25 * n).alias("confidence"))


def affected_sessions(anomalies: DataFrame, attack_type: str, most: int = 20) -> DataFrame:
    return anomalies.where(F.col("attack_type") == attack_type).select(F.explode("related_sessions").alias("session_id")).distinct().orderBy("session_id").limit(most)


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(MITIGATIONS)], "seq int, attack_type string, action string, description string, impact string, effectiveness string, effort string")


def best_mitigation(anomalies: DataFrame, endpoint: str | None = None, most: int = 5) -> DataFrame:
    """Recommendations for the types of attack seen (on an endpoint), best first: by effectiveness, then least impact, then number of anomalies."""
    a = anomalies if endpoint is None else anomalies.where(F.col("target_endpoint") == endpoint)
    seen = a.groupBy("attack_type").agg(F.count("*").alias("priority"))
    both = F.broadcast(catalogue(anomalies.sparkSession)).join(seen, "attack_type")
    order = Window.orderBy(_map(EFFECTIVENESS)[F.col("effectiveness")].desc(), _map(IMPACT)[F.col("impact")].desc(), F.col("priority").desc(), "seq")
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("rank", "attack_type", "action", "description", "effectiveness", "impact", "effort", "priority")


def mitigation_status(anomalies: DataFrame, endpoint: str | None = None) -> DataFrame:
    """One row that goes with ``best_mitigation``: whether anything is to be done, the histogram of attack types, the confidence."""
    a = anomalies if endpoint is None else anomalies.where(F.col("target_endpoint") == endpoint)
    seen = a.groupBy("attack_type").agg(F.count("*").alias("n"))
    entry = F.concat_ws(":", "attack_type", F.col("n").cast("string"))
    g = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("attack_types"))
    status = F.when(F.col("n") == 0, "no_mitigation_needed").otherwise("recommendations_available")
    confidence = F.least(F.lit(1.0), 0.15 * F.col("n")).alias("confidence")
    return g.select(status.alias("status"), F.lit(endpoint).cast("string").alias("endpoint"), F.col("n").alias("anomaly_count"), "attack_types", confidence)


def explain(anomalies: DataFrame) -> DataFrame:
    """(anomaly_id, text): Markdown of an anomaly with its evidence and actions."""
    actions = anomalies.sparkSession.createDataFrame(list(RECOMMENDATIONS.items()), "attack_type string, todo array<string>")
    a = anomalies.join(F.broadcast(actions), "attack_type", "left")
    todo = F.transform(F.coalesce("todo", F.array(F.lit("Review and investigate the anomaly"))), lambda x: F.concat(F.lit("- "), x))
    text = F.concat_ws(
        "\n", F.concat(F.lit("## "), "anomaly_type"), F.concat(F.lit("Severity: "), F.upper("severity")), F.concat(F.lit("Confidence: "), F.format_string("%.0f%%", F.col("confidence") * 100)),
        F.concat(F.lit("Attack type: "), F.coalesce("attack_type", F.lit("Unknown"))), F.when(F.col("target_endpoint") != "", F.concat(F.lit("Target: "), "target_endpoint")),
        F.when(F.size("related_sessions") > 0, F.concat(F.lit("Sessions: "), F.size("related_sessions").cast("string"))), F.lit("### Evidence"), F.concat_ws("\n", F.transform("evidence", lambda x: F.concat(F.lit("- "), x))),
        F.lit("### Actions"), F.concat_ws("\n", todo),
    )
    return a.select("anomaly_id", text.alias("text"))


def evidence_chain(anomalies: DataFrame) -> DataFrame:
    """(anomaly_id, json): a JSON-LD chain from rule to mitigation scope."""
    chain = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("EvidenceChain").alias("@type"), "rule", F.col("subject_id").alias("subject"), F.col("related_sessions").alias("sessions"), F.col("target_endpoint").alias("target"), F.round("measure", 6).alias("observed"))
    return anomalies.select("anomaly_id", F.to_json(chain).alias("json"))


def explanation_score(contributions: DataFrame) -> DataFrame:
    """Each part's share of its anomaly's contributions (anomaly_id, part, contribution)."""
    return contributions.withColumn("score", F.col("contribution") / F.sum("contribution").over(Window.partitionBy("anomaly_id")))


def _uuid(key: Column) -> Column:
    h = F.sha1(key)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def stix_pattern(a: DataFrame) -> Column:
    ips = F.transform(F.filter("evidence", lambda e: e.contains("IP address")), lambda e: F.concat(F.lit("ipv4-addr:value = '"), F.trim(F.split(e, ": ")[1]), F.lit("'")))
    sessions = F.transform("related_sessions", lambda s: F.concat(F.lit("x-session-id:value = '"), s, F.lit("'")))
    url = F.when(F.col("target_endpoint") != "", F.array(F.concat(F.lit("url:value = '"), "target_endpoint", F.lit("'")))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(ips, sessions, url)
    return F.concat(F.lit("["), F.when(F.size(parts) > 0, F.array_join(parts, " AND ")).otherwise("unknown:value = 'true'"), F.lit("]"))


def stix_indicators(anomalies: DataFrame) -> DataFrame:
    """STIX 2.1 indicators as typed columns."""
    return anomalies.select(
        F.concat(F.lit("indicator--"), _uuid(F.col("anomaly_id"))).alias("id"), F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), F.col("anomaly_type").alias("name"), stix_pattern(anomalies).alias("pattern"),
        F.floor(F.col("confidence") * 100 + 1e-9).cast("int").alias("confidence"), F.col("severity").alias("x_severity"), F.col("anomaly_id").alias("external_id"),
    )


def stix_attack_patterns(anomalies: DataFrame) -> DataFrame:
    """One attack pattern per type seen, with its technique where one is known."""
    kind = F.col("attack_type")
    seen = anomalies.select(kind).distinct()
    return seen.select(
        F.concat(F.lit("attack-pattern--"), F.lower(kind)).alias("id"), F.lit("attack-pattern").alias("type"), F.lit("2.1").alias("spec_version"), kind.alias("name"),
        F.coalesce(_texts(DESCRIPTIONS)[kind], F.lit(OTHER_DESCRIPTION)).alias("description"), _texts(TECHNIQUES)[kind].alias("technique"),
    )


def _texts(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def stix_bundle(anomalies: DataFrame) -> DataFrame:
    """One JSON object per row, attack patterns once each."""
    one = lambda d: d.select("id", F.to_json(F.struct("*")).alias("object"))
    return one(stix_attack_patterns(anomalies)).unionByName(one(stix_indicators(anomalies)))
