from pyspark.sql import functions as F

from wirelattice.operators import semantic
from wirelattice.plans import catalogue

LINES = {
    "LoginFlood": 4, "HTTPFlood": 4, "BotBehavior": 4, "APIAttack": 4, "ScrapingAttack": 4, "SlowRequestAttack": 4,
    "QNameRandomization": 5, "NXDOMAINFlood": 5, "DNSWaterTorture": 5, "DNSAmplification": 5, "PhantomDomainAttack": 5, "DNSTunneling": 5, "Other": 1,
}


def test_each_attack_type_has_its_own_actions(spark):
    a = spark.createDataFrame([(k,) for k in LINES], "attack_type string").selectExpr(
        "attack_type as anomaly_id", "attack_type", "'T' anomaly_type", "'high' severity", "0.8D confidence", "'' target_endpoint", "array('s') related_sessions", "array('e: 1') evidence"
    )
    todo = {r["anomaly_id"]: r["text"].split("### Actions\n")[1].split("\n") for r in semantic.explain(a).collect()}
    assert {k: len(v) for k, v in todo.items()} == LINES
    assert todo["Other"] == ["- Review and investigate the anomaly"]
    assert todo["DNSTunneling"][0] == "- Deploy DNS tunneling detection solutions"


def test_ontology_ablation_has_all_six_components(spark, sf_dir):
    rows = {r["component"]: r["anomalies"] for r in catalogue.QUERIES["rule_ablation_by_ontology"](spark, sf_dir).collect()}
    assert set(rows) == {"full", "http", "dns", "session", "attack", "mitigation", "behaviour"}
    kinds = ["HTTPFlood", "LoginFlood", "QNameRandomization", "NXDOMAINFlood", "DNSWaterTorture"]
    gone = catalogue.anomalies(spark, sf_dir).where(F.col("attack_type").isin(kinds)).count()
    assert gone > 0 and rows["attack"] == rows["full"] - gone and rows["mitigation"] == rows["full"]
