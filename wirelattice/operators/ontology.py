"""The ontology as two small tables, its closure and the check of edges against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Child -> parent classes.
CLASSES = {
    "UserAgent": "HTTPHeader", "LoginEndpoint": "Endpoint", "SearchEndpoint": "Endpoint", "CheckoutEndpoint": "Endpoint", "APIEndpoint": "Endpoint", "GraphQLEndpoint": "APIEndpoint", "DynamicEndpoint": "Endpoint", "StaticEndpoint": "Endpoint",
    "UserBehavior": "Behavior", "BotBehavior": "Behavior", "NavigationPattern": "Behavior", "RequestPattern": "Behavior", "DDoSAttack": "Attack", "ApplicationLayerAttack": "DDoSAttack", "VolumetricAttack": "DDoSAttack", "ProtocolAttack": "DDoSAttack",
    "HTTPFlood": "ApplicationLayerAttack", "LoginFlood": "ApplicationLayerAttack", "SlowRequestAttack": "ApplicationLayerAttack", "Slowloris": "SlowRequestAttack", "RUDY": "SlowRequestAttack", "APIAttack": "ApplicationLayerAttack",
    "ScrapingAttack": "ApplicationLayerAttack", "CacheBypassAttack": "ApplicationLayerAttack", "SYNFlood": "ProtocolAttack", "Host": "NetworkEntity", "Server": "Host",
}
#: property -> (domain, range), over the node types of the graph
PROPERTIES = {"fromIP": ("request", "ip"), "hasEndpoint": ("request", "endpoint"), "hasSession": ("request", "session"), "exhibitsBehavior": ("session", "behavior"), "resolvedBy": ("query", "server"), "queriesDomain": ("query", "domain")}


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLASSES.items()), "child string, parent string")


def closure(spark: SparkSession) -> DataFrame:
    """(child, ancestor, depth) of the transitive subclass relation."""
    classes(spark).createOrReplaceTempView("wirelattice_onto_class")
    return spark.sql(
        "WITH RECURSIVE up(child, ancestor, depth) AS (SELECT child, parent, 1 FROM wirelattice_onto_class UNION ALL "
        "SELECT up.child, c.parent, up.depth + 1 FROM up JOIN wirelattice_onto_class c ON up.ancestor = c.child) SELECT child, ancestor, depth FROM up"
    )


def invalid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are not of the types that their relation demands."""
    p = F.broadcast(nodes.sparkSession.createDataFrame([(k, *v) for k, v in PROPERTIES.items()], "rel string, domain string, range string"))
    t = nodes.select("id", "type")
    typed = edges.join(p, "rel", "left").join(t.select(F.col("id").alias("src"), F.col("type").alias("st")), "src", "left").join(t.select(F.col("id").alias("dst"), F.col("type").alias("dt")), "dst", "left")
    return typed.where(~(F.col("st").eqNullSafe(F.col("domain")) & F.col("dt").eqNullSafe(F.col("range")))).select("src", "dst", "rel")
