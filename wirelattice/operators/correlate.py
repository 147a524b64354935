"""Correlation of anomalies: per endpoint, across vectors, and as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelattice.functions.scalars import span_seconds
from wirelattice.operators.components import connected_components


def listed(anomalies: DataFrame) -> DataFrame:
    """(anomaly_id, target_endpoint, session_id) of the sessions that anomalies list."""
    return anomalies.select("anomaly_id", "target_endpoint", F.explode("related_sessions").alias("session_id")).distinct()


def coordinated_attacks(anomalies: DataFrame, window_s: float = 300, members: DataFrame | None = None) -> DataFrame:
    """Endpoints with two or more anomalies within less than the window; sessions are counted over ``members`` (``rules.members``), else over the listed ones."""
    a = anomalies.where("target_endpoint <> ''")
    of = listed(anomalies) if members is None else members
    sessions = of.where("target_endpoint <> ''").groupBy("target_endpoint").agg(F.countDistinct("session_id").alias("sessions"))
    g = a.groupBy("target_endpoint").agg(F.count("*").alias("anomaly_count"), F.array_sort(F.collect_set("attack_type")).alias("attack_types"), span_seconds(F.min("ts"), F.max("ts")).alias("span"))
    g = g.where((F.col("anomaly_count") >= 2) & (F.coalesce("span", F.lit(0.0)) < window_s)).join(sessions, "target_endpoint", "left")
    return g.select(
        "target_endpoint", "anomaly_count", F.array_join("attack_types", ",").alias("attack_types"), F.coalesce("sessions", F.lit(0)).cast("long").alias("sessions"), F.least(F.lit(1.0), 0.2 * F.col("anomaly_count")).alias("confidence"),
        F.when(F.col("anomaly_count") > 5, "critical").otherwise("high").alias("severity"),
    )


def multi_vector(anomalies: DataFrame, window_s: float = 600) -> DataFrame:
    """One row if more than one endpoint is hit and all anomalies lie within less than the window."""
    g = anomalies.agg(F.count_distinct(F.when(F.col("target_endpoint") != "", F.col("target_endpoint"))).alias("endpoints"), F.count("*").alias("anomaly_count"), span_seconds(F.min("ts"), F.max("ts")).alias("span"))
    g = g.where((F.col("endpoints") > 1) & (F.coalesce("span", F.lit(0.0)) < window_s))
    return g.select("endpoints", "anomaly_count", F.least(F.lit(1.0), 0.1 * F.col("anomaly_count")).alias("confidence"), F.lit("critical").alias("severity"))


def anomaly_keys(anomalies: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(anomaly_id, key, relation, precedence): what anomalies can share (sessions by ``members``, else the listed ones). Two that share a key are related."""
    a = anomalies
    end = a.where("target_endpoint <> ''").select("anomaly_id", F.concat(F.lit("e:"), "target_endpoint").alias("key"), F.lit("same_endpoint").alias("relation"), F.lit(1).alias("precedence"))
    of = listed(a) if members is None else members
    ses = of.select("anomaly_id", F.concat(F.lit("s:"), "session_id").alias("key"), F.lit("shared_session").alias("relation"), F.lit(2).alias("precedence"))
    att = a.select("anomaly_id", F.concat(F.lit("a:"), "attack_type").alias("key"), F.lit("same_attack_type").alias("relation"), F.lit(3).alias("precedence"))
    return end.unionByName(ses).unionByName(att)


def attack_graph(anomalies: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """The graph as a star per key: (anomaly_id, hub, relation), hub the key's smallest anomaly; same components as all pairs, linear in rows."""
    keys = anomaly_keys(anomalies, members)
    hubs = keys.groupBy("key").agg(F.min("anomaly_id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    e = keys.join(hubs, "key").where("anomaly_id <> hub")
    return e.groupBy("anomaly_id", "hub").agg(F.max_by("relation", "precedence").alias("relation"))


def attack_components(anomalies: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(component, size) of the attack graph."""
    cc = connected_components(attack_graph(anomalies, members), "anomaly_id", "hub")
    every = anomalies.select(F.col("anomaly_id").alias("node")).distinct().join(cc, "node", "left")
    return every.groupBy(F.coalesce("component", "node").alias("component")).agg(F.count("*").alias("size"))


def status(nodes: DataFrame, edges: DataFrame, requests: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row of counts, requests and nodes apart."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(requests, "requests")
    for df, name in ((nodes, "nodes"), (edges, "edges"), (anomalies, "anomalies")):
        out = out.select("*", n(df, name).scalar().alias(name))
    return out


def response_payload(alerts: DataFrame, coordinated: DataFrame, endpoint_status: DataFrame) -> DataFrame:
    """What a detection hands on: one JSON row of alerts, coordinated attacks and the endpoint under attack; none without alerts."""
    pack = lambda df, name: df.select(F.to_json(F.struct("*")).alias("j")).agg(F.array_sort(F.collect_list("j")).alias(name))
    out = pack(alerts, "alerts").select("*", pack(coordinated, "coordinated").scalar().alias("coordinated"), pack(endpoint_status, "endpoint_status").scalar().alias("endpoint_status"))
    return out.where(F.size("alerts") > 0).select(F.to_json(F.struct("*")).alias("payload"))
