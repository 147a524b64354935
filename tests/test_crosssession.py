from collections import defaultdict

import pytest

from wirelattice.operators import crosssession
from wirelattice.plans import catalogue
from wirelattice.sources import events as ev


def test_a_signal_of_many_sessions_relates_them_all(spark):
    http = spark.range(10_001).selectExpr("concat('s', id) session_id", "concat('t', id) token", "'f' tls_fingerprint", "cast(null as string) src_ip", "timestamp'2024-01-01' ts")
    stars = crosssession.related_stars(http)
    assert stars.count() == 10_000 and stars.select("hub").distinct().count() == 1


def test_api_abuse_counts_all_tokens_of_a_session(spark):
    rows = [("s1", "a"), ("s1", "b"), ("s2", "a"), ("s2", "c")]
    http = spark.createDataFrame(rows, "session_id string, token string").selectExpr("*", "'/graphql' endpoint", "200 response_code", "timestamp'2024-01-01' ts")
    members = spark.createDataFrame([("s1", "k"), ("s2", "k")], "session_id string, campaign string")
    found = crosssession.coordinated_api_abuse(http, members, crosssession.Limits(api_rate=0.5, quota=10.0)).collect()
    assert [(r["sessions"], r["tokens"], r["requests"]) for r in found] == [(2, 3, 4)]


def test_campaign_queries_follow_related_sessions(spark, sf_dir):
    http = ev.http_requests(spark, sf_dir)
    rows = http.selectExpr("session_id", "token", "tls_fingerprint", "src_ip", "endpoint", "response_code", "floor(unix_seconds(ts) / 300) w").collect()
    prefix = lambda r: ".".join(r["src_ip"].split(".")[:3])
    shown = defaultdict(set)
    for r in rows:
        for signal in (("identity", r["token"]), ("fingerprint", r["tls_fingerprint"]), ("prefix", prefix(r))):
            shown[signal, r["w"]].add(r["session_id"])
    label = {r["session_id"]: r["session_id"] for r in rows}
    while True:
        low = {s: min(label[t] for group in shown.values() if s in group for t in group) for s in label}
        if low == label:
            break
        label = low
    logins = defaultdict(list)
    for r in rows:
        if r["endpoint"] == "/login":
            logins[label[r["session_id"]]].append(r)
    want = {(c, len({r["session_id"] for r in g}), len(g)) for c, g in logins.items() if len({r["session_id"] for r in g}) > 1 and sum(r["response_code"] in (401, 403) for r in g) > 0.1 * len(g)}
    got = catalogue.QUERIES["credential_stuffing"](spark, sf_dir).collect()
    assert want and {(r["campaign"], r["sessions"], r["requests"]) for r in got} == want
    values = defaultdict(set)
    for r in rows:
        for kind, value in (("identity", r["token"]), ("fingerprint", r["tls_fingerprint"]), ("prefix", prefix(r))):
            values[label[r["session_id"]], kind].add(value)
    got = catalogue.QUERIES["mitigation_scope"](spark, sf_dir).collect()
    assert {(r["campaign"], r["kind"]): {r["value"]} for r in got} == {k: v for k, v in values.items() if len(v) == 1}


@pytest.mark.parametrize(("at", "meets"), [("11:59", True), ("12:01", True), ("12:06", True), ("11:54", False), ("12:11", False)])
def test_cross_surface_in_either_order(spark, at, meets):
    dns = spark.sql("select 'x.example.com.' qname, 'NXDOMAIN' response_code, '10.0.0.1' src_ip, timestamp'2024-01-01 12:01:00' ts")
    http = spark.sql(f"select '10.0.0.2' src_ip, 404 response_code, timestamp'2024-01-01 {at}:00' ts")
    assert (crosssession.cross_surface(dns, http).count() == 1) is meets
