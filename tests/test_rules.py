from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from wirelattice.operators import correlate, crosssession, graph, rules, semantic
from wirelattice.operators.metrics import Frames
from wirelattice.sources import scenarios
from wirelattice.sources.events import ENDPOINT_SCHEMA


def counts(frames):
    return {r["rule"]: r["count"] for r in rules.detect(frames).groupBy("rule").count().collect()}


def test_basic_scenario(spark):
    f = scenarios.http_scenario(spark)
    assert counts(f) == {"login_flood": 1, "bot_behavior": 10, "expensive_endpoint_burst": 2, "repetitive_route": 11}
    rows = {r["target_endpoint"]: r for r in rules.detect(f, rules=["expensive_endpoint_burst"]).collect()}
    assert round(rows["/api/search"]["score"], 4) == 0.9 and rows["/api/search"]["severity"] == "high"
    assert round(rows["/login"]["score"], 4) == 0.6667 and rows["/login"]["severity"] == "medium"
    nodes = graph.http_nodes(f.http).count() + f.profiles.count()
    edges = graph.http_edges(f.http).unionByName(graph.behaviour_edges(f.profiles, graph.http_nodes(f.http)))
    # 650 requests, 355 addresses, 3 endpoints with traffic, 31 sessions, 10 profiles
    assert nodes == 650 + 355 + 3 + 31 + 10 and edges.distinct().count() == 1960


def test_multi_scenario(spark):
    a = rules.detect(scenarios.http_scenario(spark, multi=True)).persist()
    assert {r["rule"]: r["count"] for r in a.groupBy("rule").count().collect()} == {"login_flood": 1, "bot_behavior": 10, "expensive_endpoint_burst": 3, "repetitive_route": 16, "api_abuse": 1}
    q = semantic.endpoint_under_attack(a).first()
    assert (q["endpoint"], q["anomaly_count"], q["severity_sum"], round(q["confidence"], 6)) == ("/login", 2, 5, 0.4)
    c = {r["target_endpoint"]: r for r in correlate.coordinated_attacks(a).collect()}
    assert set(c) == {"/login", "/api/graphql"} and all(r["severity"] == "high" and round(r["confidence"], 6) == 0.4 for r in c.values())
    assert correlate.multi_vector(a).first()["anomaly_count"] == 31
    assert correlate.attack_components(a).count() == 1


def test_dns_scenario(spark):
    a = rules.detect(scenarios.dns_scenario(spark)).persist()
    assert {r["rule"]: r["count"] for r in a.groupBy("rule").count().collect()} == {"qname_randomization": 1, "qname_randomization_domain": 1, "nxdomain_flood_domain": 1, "dns_amplification": 100, "dns_tunneling": 1}
    rows = {r["rule"]: r for r in a.where("rule <> 'dns_amplification'").collect()}
    assert rows["qname_randomization"]["subject_id"] == "10.0.0.50" and rows["qname_randomization_domain"]["score"] == 0.637
    assert round(rows["nxdomain_flood_domain"]["score"], 6) == 0.661871
    q = semantic.endpoint_under_attack(a).first()
    assert (q["endpoint"], q["anomaly_count"], q["severity_sum"]) == ("DNS:example.com", 103, 307)
    assert correlate.coordinated_attacks(a).first()["severity"] == "critical"


def _http(spark, rows):
    t = "select * from values " + ", ".join(f"('r{i}', '{m}', '{e}', '{ip}', '{s}', 'tok', 'fp', {c}, {rt}L, timestamp'{ts}')" for i, (m, e, ip, s, c, rt, ts) in enumerate(rows)) + " t(request_id, method, endpoint, src_ip, session_id, token, tls_fingerprint, response_code, response_time_ms, ts)"
    return spark.sql(t)


def test_strict_thresholds(spark):
    base = scenarios.http_scenario(spark)
    second = "2024-01-01 00:00:00"
    for n, fires in ((50, False), (51, True)):
        f = Frames(_http(spark, [("GET", "/x", "1.1.1.1", "s", 200, 10, second)] * n), base.dns, base.endpoints, base.profiles.limit(0))
        assert ("http_flood" in counts(f)) is fires
    for rt, fires in ((30_000, False), (30_001, True)):
        f = Frames(_http(spark, [("GET", "/x", "1.1.1.1", "s", 200, rt, second)]), base.dns, base.endpoints, base.profiles.limit(0))
        assert ("slow_request" in counts(f)) is fires
    at = rules.anomaly(spark.range(1), "x", "X", "X", "x", "s", F.lit("a"), F.lit(0.7), 0.5, F.lit(1), level=rules.severity(F.lit(0.7)))
    assert at.first()["severity"] == "medium"


def test_profiles_differ(spark):
    f = scenarios.http_scenario(spark)
    assert rules.detect(f, rules.ONTOLOGY, ["slow_request", "bot_behavior"]).count() == 10
    assert rules.detect(f, replace(rules.CODE, failed_logins=50), ["login_flood"]).count() == 0


def test_second_dns_data_set(spark):
    row = "concat('q', id) query_id, {q} qname, {t} qtype, {ip} src_ip, 'd' dst_ip, {c} response_code, cast({rt} as bigint) response_time_ms, timestamp_micros(1704067200000000 + cast(id * {step} as bigint)) ts, 40L query_size, 80L response_size"
    part = lambda n, **k: spark.range(n).selectExpr(*(x.strip() for x in _split(row.format(**k))))
    dns = part(40, q="'a.nx.org'", t="'A'", ip="'9.9.9.9'", c="'NXDOMAIN'", rt="10", step="1000000")
    dns = dns.unionByName(part(300, q="concat('l', id, '.torture.net')", t="'A'", ip="concat('8.8.', id, '.1')", c="'NOERROR'", rt="10", step="500000"))
    dns = dns.unionByName(part(6, q="'any.info'", t="'ANY'", ip="'7.7.7.7'", c="'NOERROR'", rt="10", step="1000000"))
    dns = dns.unionByName(part(30, q="'slow.phantom.biz'", t="'A'", ip="concat('6.6.', id, '.1')", c="'NOERROR'", rt="6000", step="1000000"))
    f = scenarios.dns_scenario(spark)
    got = counts(Frames(f.http, dns, f.endpoints, f.profiles))
    assert got == {"nxdomain_flood": 1, "nxdomain_flood_domain": 1, "dns_water_torture": 1, "dns_amplification_any": 1, "phantom_domain": 1}


def _split(text):
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def test_order_and_repetition_do_not_matter(spark):
    f = scenarios.http_scenario(spark)
    again = Frames(f.http.repartition(7).orderBy(F.rand(3)), f.dns, f.endpoints, f.profiles)
    pick = lambda x: sorted(map(str, rules.detect(x).select("anomaly_id", F.round("score", 9)).collect()))
    assert pick(f) == pick(again) == pick(f)


@pytest.mark.parametrize(("span", "fires"), [("299.999", True), ("300", False)])
def test_coordination_window(spark, span, fires):
    a = spark.sql(f"select 'a' anomaly_id, '/x' target_endpoint, 'T' attack_type, array('s') related_sessions, timestamp'2024-01-01' ts union all select 'b', '/x', 'T', array('t'), timestamp'2024-01-01' + interval '{span}' second")
    assert (correlate.coordinated_attacks(a).count() == 1) is fires


def test_cache_bypass(spark):
    ends = spark.createDataFrame([("/c", 0.1, True, False, False, "low", 0)], ENDPOINT_SCHEMA)
    http = spark.sql("select 'r' request_id, '/c' endpoint, 's' session_id, timestamp'2024-01-01' ts, map('Cache-Control', 'no-cache') headers")
    assert rules.cache_bypass(Frames(http, None, ends, None), rules.CODE).count() == 1


@pytest.mark.parametrize("k", [1, 20, 200])
def test_campaign_recall(spark, k):
    http = scenarios.campaign_scenario(spark, k)
    members = crosssession.campaigns(http)
    found = crosssession.credential_stuffing(http, members)
    truth = http.where("campaign_id is not null").select("session_id", "campaign_id").distinct()
    recall = crosssession.campaign_recall(truth, members.join(found.select("campaign").distinct(), "campaign")).first()["recall"]
    # one session is no campaign; without relations none is found
    assert recall == (1.0 if k > 1 else 0.0)
    if k > 1:
        assert found.first()["sessions"] == k
        alone = crosssession.campaigns(http, crosssession.Limits(signals=("identity",)))
        assert crosssession.credential_stuffing(http, alone).count() == 0
        scope = crosssession.mitigation_scope(http, members.join(found.select("campaign"), "campaign")).collect()
        assert [r["kind"] for r in scope] == ["fingerprint"]


def test_top_anomalies(spark):
    rows = [("a", "x", 0.9, 1, "DNSTunneling"), ("b", "z", 0.9000000001, 0, "HTTPFlood"), ("b", "y", 0.9, 0, "HTTPFlood"), ("c", "w", 1.0, 2, None), ("d", "v", 0.1, 3, "PhantomDomainAttack")]
    a = spark.createDataFrame(rows, "rule string, subject_id string, score double, rule_seq int, attack_type string")
    assert [r["subject_id"] for r in rules.top_anomalies(a, 4).orderBy("rank").collect()] == ["w", "y", "z", "x"]
    dns = rules.top_anomalies(a, 5, rules.DNS_ATTACKS).orderBy("rank").collect()
    assert [(r["rank"], r["subject_id"]) for r in dns] == [(1, "x"), (2, "v")]
    assert rules.top_anomalies(a.limit(0)).count() == 0


def test_phantom_domains_have_a_listed_attack_type(spark):
    f = scenarios.dns_scenario(spark)
    slow = Frames(f.http, f.dns.where("query_id like 'p%'"), f.endpoints, f.profiles)
    found = {r["attack_type"] for r in rules.detect(slow, rules=["phantom_domain"]).collect()}
    assert found == {"PhantomDomainAttack"} and found <= set(rules.DNS_ATTACKS)
