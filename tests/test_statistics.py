import math
import random

from pyspark.sql import functions as F

from wirelattice.operators import experiments as ex
from wirelattice.operators import statistics as st
from wirelattice.sources import scenarios


def adjusted(spark, method, legacy=False):
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.005)], "id int, p double")
    return [round(r["adjusted"], 6) for r in st.corrected(p, method, legacy).orderBy("id").collect()]


def test_corrections(spark):
    assert adjusted(spark, "bonferroni") == [0.04, 0.16, 0.12, 0.02]
    assert adjusted(spark, "holm") == [0.03, 0.06, 0.06, 0.02]
    assert adjusted(spark, "benjamini_hochberg") == [0.02, 0.04, 0.04, 0.02]
    assert adjusted(spark, "holm", True) == [0.03, 0.04, 0.06, 0.02]
    assert adjusted(spark, "benjamini_hochberg", True) == [0.04, 0.04, 0.04, 0.04]


def scores(spark):
    r = random.Random(4)
    rows = [(m, f, base + r.gauss(0, 0.01)) for m, base in (("a", 0.9), ("b", 0.88), ("c", 0.85)) for f in range(10)]
    return spark.createDataFrame(rows, "method string, fold int, value double"), rows


def test_tests_against_plain_formulas(spark):
    df, rows = scores(spark)
    v = {(m, f): x for m, f, x in rows}
    d = [v["a", f] - v["b", f] for f in range(10)]
    mean = sum(d) / 10
    sd = math.sqrt(sum((x - mean) ** 2 for x in d) / 9)
    t = st.paired_t(df, "a", "b")
    assert abs(t["t"] - mean / (sd / math.sqrt(10))) < 1e-9 and abs(t["effect"] - mean / sd) < 1e-9
    w = st.wilcoxon(df, "a", "b")
    order = sorted(range(10), key=lambda i: abs(d[i]))
    down = sum(k + 1 for k, i in enumerate(order) if d[i] < 0)
    assert w["w"] == min(down, 55 - down)
    assert st.friedman(df)["p"] < 0.01 and st.anova_test(df, "method", "value")["p"] < 0.001
    assert len(st.post_hoc(df)) == 3 and "ANOVA" in st.report(df)
    assert st.effect_wording(0.1) == "negligible" and st.effect_wording(-0.9) == "large"


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1), (1, 0.1), (0, 0.7)], "t int, s double")
    pos, neg = [0.9, 0.5, 0.1], [0.5, 0.1, 0.7]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / 9
    assert abs(st.auc(df, "t", "s").first()[0] - want) < 1e-12


def test_classification(spark):
    rows = [(0, 0)] * 49 + [(0, 1)] * 9 + [(1, 0)] * 299 + [(1, 1)] * 42
    m = st.classification_metrics(spark.createDataFrame(rows, "y int, p int"), "y", "p").first()
    assert abs(m["accuracy"] - 91 / 399) < 1e-12 and abs(m["fpr"] - 9 / 58) < 1e-12


def test_preparation(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("inf"), "a"), (float("nan"), "b"), (None, "b"), (3.0, "a"), (3.0, "a")], " x double, Label string")
    assert sorted(r["x"] for r in ex.preprocess(df, "mean").collect()) == [1.0, 2.0, 2.0, 2.0, 3.0]
    assert ex.preprocess(df, "drop").count() == 2 and sorted(r["x"] for r in ex.preprocess(df, "zero").collect())[:3] == [0.0, 0.0, 0.0]
    z = ex.standardise(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"]).collect()
    assert sorted(tuple(r) for r in z) == [(-1.0, 0.0), (1.0, 0.0)]


def test_splits_are_exact_and_stable(spark):
    df = spark.range(1000).withColumn("y", F.when(F.col("id") % 4 == 0, "a").otherwise("b"))
    n = {(r["y"], r["split"]): r["count"] for r in ex.stratified_split(df, "id", "y").groupBy("y", "split").count().collect()}
    assert n == {("a", "train"): 175, ("a", "validation"): 38, ("a", "test"): 37, ("b", "train"): 525, ("b", "validation"): 113, ("b", "test"): 112}
    pick = lambda d: sorted(map(str, ex.stratified_folds(d, "id", "y", 5).select("id", "fold").collect()))
    assert pick(df) == pick(df.repartition(13))
    assert ex.balance(df, "id", "y").groupBy("y").count().select("count").distinct().collect()[0][0] == 250


def test_baselines_and_scores(spark):
    df = ex.label_index(scenarios.tabular(spark, 600, 6))
    cols = [f"feature_{i}" for i in range(6)]
    parts = ex.stratified_split(df, "id", "Label").persist()
    train, test = parts.where("split = 'train'"), parts.where("split = 'test'")
    from pyspark.ml.classification import RandomForestClassifier

    out = ex.fit_and_predict(train, test, cols, "label_id", RandomForestClassifier(numTrees=10, seed=1))
    assert st.auc(out, "label_id", "score").first()[0] > 0.95
    scored = ex.reconstruction_scores(df, cols, F.col("Label") == "Benign", k=3)
    assert scored.where("Label = 'HTTP_Flood'").agg(F.avg(F.col("outlier").cast("int"))).first()[0] > 0.5
    drop = ex.performance_drop(spark.createDataFrame([("x", 0.934, 0.874)], "c string, base double, f1 double")).first()
    assert round(drop["performance_drop"], 2) == 6.42 and drop["importance"] == "critical"


def test_loader_and_comparison(spark, tmp_path):
    (tmp_path / "in").mkdir()
    r = random.Random(8)
    lines = [" a , b , Flow ID, Label"] + [f"{r.gauss(k, 1):.4f},{r.gauss(-k, 1):.4f},{i},{'Attack' if k else 'Benign'}" for i in range(300) for k in [(i % 3 == 0) * 4]]
    (tmp_path / "in" / "x.csv").write_text("\n".join(lines))
    df = ex.load_dataset(spark, str(tmp_path / "in"), str(tmp_path / "cache"), {"seed": 3})
    assert "Flow ID" not in df.columns and {r["split"] for r in df.select("split").distinct().collect()} == {"train", "validation", "test"}
    from pyspark.ml.classification import RandomForestClassifier

    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    out = ex.compare_models(train, test, ["a", "b"], "label_id", {"forest": RandomForestClassifier(numTrees=5, seed=1), "broken": RandomForestClassifier(featuresCol="missing")})
    assert out[0]["auc"] > 0.95 and out[0]["accuracy"] > 0.9 and "error" in out[1]
    assert ex.feature_importance(train, ["a", "b"], "label_id").count() == 2
    wide = spark.createDataFrame([("m", 0.9, 0.2)], "method string, f1 double, fpr double")
    assert {(r["metric"], round(r["value"], 6)) for r in st.radar(wide).collect()} == {("f1", 0.9), ("1 - fpr", 0.8)}
    assert [r[0] for r in spark.createDataFrame([(0.0001,), (0.005,), (0.03,), (0.2,)], "p double").select(st.stars(F.col("p"))).collect()] == ["***", "**", "*", "ns"]
