"""The typed property graph as a view of the event tables, and its exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelattice.functions.scalars import base_domain


def http_nodes(http: DataFrame) -> DataFrame:
    """(id, type): requests, addresses, endpoints, sessions. Ids keep the raw key, so no two collide."""
    pick = lambda kind, c: http.where(F.col(c).isNotNull() & (F.col(c) != "")).select(F.concat(F.lit(kind + ":"), c).alias("id"), F.lit(kind).alias("type"))
    return reduce(DataFrame.unionByName, [pick("request", "request_id"), *(pick(k, c).distinct() for k, c in (("ip", "src_ip"), ("endpoint", "endpoint"), ("session", "session_id")))])


def http_edges(http: DataFrame) -> DataFrame:
    """(src, dst, rel): a request's address, endpoint and session."""
    me = F.concat(F.lit("request:"), "request_id")
    pick = lambda kind, c, rel: http.where(F.col(c).isNotNull() & (F.col(c) != "")).select(me.alias("src"), F.concat(F.lit(kind + ":"), c).alias("dst"), F.lit(rel).alias("rel"))
    return reduce(DataFrame.unionByName, [pick("ip", "src_ip", "fromIP"), pick("endpoint", "endpoint", "hasEndpoint"), pick("session", "session_id", "hasSession")])


def dns_nodes(dns: DataFrame) -> DataFrame:
    pick = lambda kind, c: dns.select(F.concat(F.lit(kind + ":"), c).alias("id"), F.lit(kind).alias("type"))
    return reduce(DataFrame.unionByName, [pick("query", F.col("query_id")), *(pick(k, c).distinct() for k, c in (("ip", F.col("src_ip")), ("server", F.col("dst_ip")), ("domain", base_domain(F.col("qname")))))])


def dns_edges(dns: DataFrame) -> DataFrame:
    me = F.concat(F.lit("query:"), "query_id")
    pick = lambda kind, c, rel: dns.select(me.alias("src"), F.concat(F.lit(kind + ":"), c).alias("dst"), F.lit(rel).alias("rel"))
    return reduce(DataFrame.unionByName, [pick("ip", F.col("src_ip"), "fromIP"), pick("server", F.col("dst_ip"), "resolvedBy"), pick("domain", base_domain(F.col("qname")), "queriesDomain")])


def behaviour_edges(profiles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sessions that exist exhibit their profiles."""
    e = profiles.select(F.concat(F.lit("session:"), "session_id").alias("src"), F.concat(F.lit("behavior:"), "profile_id").alias("dst"), F.lit("exhibitsBehavior").alias("rel"))
    return e.join(nodes.where("type = 'session'").select(F.col("id").alias("src")), "src", "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node its degrees and degree centrality; edges of different relations count, repeated ones do not."""
    e = edges.distinct()
    ends = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    d = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    n = nodes.agg(F.count("*").alias("n")).select("n").scalar()
    both = nodes.join(d, "id", "left").na.fill(0, ["in_degree", "out_degree"])
    return both.select("id", "type", "in_degree", "out_degree", ((F.col("in_degree") + F.col("out_degree")) / F.greatest(n - 1, F.lit(1))).alias("degree_centrality"))


def betweenness_two_hop(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Exact betweenness of graphs whose longest path has two edges, as this one's: in times out neighbours over (n-1)(n-2)."""
    e = edges.select("src", "dst").distinct()
    ins, outs = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i")), e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    n = nodes.agg(F.count("*").alias("n")).select("n").scalar()
    both = nodes.join(ins, "id", "left").join(outs, "id", "left").na.fill(0, ["i", "o"])
    return both.select("id", "type", (F.col("i") * F.col("o") / F.greatest((n - 1) * (n - 2), F.lit(1))).alias("betweenness"))


#: Colours of node types, and that of all others.
COLOURS = {"request": "#4CAF50", "endpoint": "#2196F3", "session": "#FF9800", "anomaly": "#F44336", "ip": "#9C27B0", "behavior": "#00BCD4"}
OTHER_COLOUR = "#607D8B"


def cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Elements as JSON lines, nodes first."""
    colour = F.create_map(*(F.lit(x) for kv in COLOURS.items() for x in kv))
    n = nodes.select(F.lit("nodes").alias("group"), "id", F.to_json(F.struct(F.struct("id", F.substring("id", 1, 30).alias("label"), "type", F.coalesce(colour[F.col("type")], F.lit(OTHER_COLOUR)).alias("color")).alias("data"))).alias("element"))
    key = F.concat_ws("|", "src", "rel", "dst")
    e = edges.select(F.lit("edges").alias("group"), key.alias("id"), F.to_json(F.struct(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("rel").alias("label")).alias("data"))).alias("element"))
    return n.unionByName(e)


def mermaid(nodes: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """Text lines of a diagram of the first ``most`` nodes by id and the edges among them."""
    some = nodes.orderBy("id").limit(most)
    short = lambda c: F.regexp_replace(F.substring(c, 1, 15), "[^A-Za-z0-9]", "_")
    head = some.sparkSession.createDataFrame([(0, "", "graph TD")], "part int, at string, line string")
    lines = some.select(F.lit(1).alias("part"), F.col("id").alias("at"), F.concat(F.lit("    "), short("id"), F.lit("["), F.substring("id", 1, 20), F.lit("]")).alias("line"))
    ids = F.broadcast(some.select("id"))  # at most ``most`` rows
    inner = edges.join(ids, edges.src == ids.id, "left_semi").join(ids, edges.dst == ids.id, "left_semi")
    arrows = inner.select(F.lit(2).alias("part"), F.concat_ws("|", "src", "dst", "rel").alias("at"), F.concat(F.lit("    "), short("src"), F.lit(" -->|"), "rel", F.lit("| "), short("dst")).alias("line"))
    return head.unionByName(lines).unionByName(arrows)


def _xml(c) -> F.Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graph_xml(nodes: DataFrame, edges: DataFrame, form: str = "graphml") -> DataFrame:
    """Ordered lines (part, at, line) of a GraphML or GEXF file."""
    spark = nodes.sparkSession
    if form == "graphml":
        head, tail = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="t" for="node" attr.name="type" attr.type="string"/>', '<key id="r" for="edge" attr.name="rel" attr.type="string"/>', '<graph edgedefault="directed">'], ["</graph>", "</graphml>"]
        n = F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('"><data key="t">'), _xml(F.col("type")), F.lit("</data></node>"))
        e = F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('"><data key="r">'), _xml(F.col("rel")), F.lit("</data></edge>"))
    else:
        head, tail = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3">', '<graph defaultedgetype="directed">'], ["</graph>", "</gexf>"]
        n = F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('" label="'), _xml(F.col("type")), F.lit('"/>'))
        e = F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('" label="'), _xml(F.col("rel")), F.lit('"/>'))
    fixed = spark.createDataFrame([(0, f"{i:02}", x) for i, x in enumerate(head)] + [(3, f"{i:02}", x) for i, x in enumerate(tail)], "part int, at string, line string")
    return fixed.unionByName(nodes.select(F.lit(1).alias("part"), F.col("id").alias("at"), n.alias("line"))).unionByName(edges.select(F.lit(2).alias("part"), F.concat_ws("|", "src", "dst", "rel").alias("at"), e.alias("line")))
