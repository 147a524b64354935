"""Data preparation, flow features, baselines and real ablations."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from wirelattice.functions.scalars import zero_infinite
from wirelattice.operators.metrics import Frames
from wirelattice.operators.rules import CATEGORIES, CODE, Thresholds, composite_score, detect, members


def numeric(df: DataFrame, *without: str) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in without]


def preprocess(df: DataFrame, missing: str = "mean", label: str = "Label") -> DataFrame:
    """Distinct rows with trimmed names; infinite values count as missing; missing ones by mean, median, zero or dropped rows."""
    df = df.toDF(*[c.strip() for c in df.columns]).dropDuplicates()
    names = numeric(df, label)
    clean = df.select(*(F.when(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), None).otherwise(F.col(c).cast("double")).alias(c) if c in names else F.col(c) for c in df.columns))
    if missing == "drop":
        return clean.dropna(subset=names)
    if missing in ("mean", "median") and names:
        f = F.avg if missing == "mean" else F.median
        values = clean.agg(*(f(c).alias(c) for c in names)).first().asDict()
        clean = clean.na.fill({c: v for c, v in values.items() if v is not None})
    return clean.na.fill(0.0, names)


def dataset_statistics(df: DataFrame, label: str = "Label") -> DataFrame:
    """(label, rows, share) of a data set."""
    return df.groupBy(label).agg(F.count("*").alias("rows")).withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))


def label_index(df: DataFrame, label: str = "Label") -> DataFrame:
    """Adds ``label_id``: classes by name from 0 (ranks come from the few distinct names)."""
    ids = df.select(label).distinct().select(F.col(label).alias("_l"), (F.row_number().over(Window.orderBy(label)) - 1).alias("label_id"))
    return df.join(ids, F.col(label).eqNullSafe(F.col("_l"))).drop("_l")


def hash_order(key: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40))


def stratified_split(df: DataFrame, key: str, label: str, train: float = 0.7, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds ``split`` by exact class quotas in a hash order of the key.

    The rank inside a class comes from buckets of the hash and the buckets' counts, so a class of any size is dealt over many tasks.
    """
    ranked = class_rank(df, key, label, seed)
    quota = lambda share: F.floor(F.col("class_size") * share + 0.5)
    split = F.when(F.col("rank") <= quota(train), "train").when(F.col("rank") <= quota(train + validation), "validation").otherwise("test")
    return ranked.withColumn("split", split).drop("rank", "class_size")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 10, seed: int = 42) -> DataFrame:
    """Adds ``fold`` from 0 to k - 1, even within each class."""
    return class_rank(df, key, label, seed).withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(k)).cast("int")).drop("rank", "class_size")


def class_rank(df: DataFrame, key: str, label: str, seed: int, buckets: int = 256) -> DataFrame:
    h = df.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_b", F.floor(F.col("_h") / ((1 << 40) / buckets)))
    counts = h.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(label)
    offsets = counts.select(F.col(label).alias("_l"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_n").over(w).alias("class_size"))
    inside = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))
    return h.withColumn("_r", inside).join(offsets, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_c"))).withColumn("rank", F.col("_r") + F.col("_o")).drop("_h", "_b", "_r", "_l", "_c", "_o")


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if fewer), the same in every run."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def balance(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Classes cut to the size of the smallest."""
    low = df.groupBy(label).count().agg(F.min("count").alias("n")).scalar()
    return class_rank(df, key, label, seed).where(F.col("rank") <= low).drop("rank", "class_size")


def standardise(df: DataFrame, columns: list[str], fit_on: Column | None = None) -> DataFrame:
    """Columns scaled by the mean and population deviation of the training rows; constant ones are divided by 1."""
    train = df if fit_on is None else df.where(fit_on)
    stats = train.agg(*(F.avg(c).alias("m_" + c) for c in columns), *(F.stddev_pop(c).alias("s_" + c) for c in columns))
    scaled = [((F.col(c) - F.col("m_" + c)) / F.when(F.col("s_" + c) > 0, F.col("s_" + c)).otherwise(1.0)).alias(c) if c in columns else F.col(c) for c in df.columns]
    return df.join(F.broadcast(stats)).select(*scaled)  # one row of statistics


def flow_features(df: DataFrame) -> DataFrame:
    """Rates, variation and flag features of flows (duration in microseconds)."""
    c = lambda n: F.col(f"`{n}`").cast("double")
    one = lambda x: F.greatest(x, F.lit(1.0))
    flags = ["FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count", "ACK Flag Count", "URG Flag Count"]
    have = [f for f in flags if f in df.columns]
    mean = df.agg(F.avg(c("Flow Packets/s")).alias("m")).scalar()
    return df.select(
        "*", zero_infinite(c("Total Fwd Packets") / one(c("Flow Duration") / 1e6)).alias("requests_per_second"), zero_infinite(c("Flow Packets/s") / F.when(mean > 0, mean).otherwise(1.0)).alias("burst_ratio"),
        (c("Fwd Packet Length Std") / one(c("Fwd Packet Length Mean"))).alias("packet_size_cv"), (c("Flow IAT Std") / one(c("Flow IAT Mean"))).alias("iat_cv"), (c("SYN Flag Count") / one(c("ACK Flag Count"))).alias("syn_ack_ratio"),
        sum(((c(f) > 0).cast("int") for f in have), F.lit(0)).alias("flag_diversity"), ((c("SYN Flag Count") > 0) & (c("ACK Flag Count") == 0)).cast("int").alias("syn_only"),
    )


def baselines(seed: int = 42) -> dict:
    """Classifiers by name. Networks over sequences are stood in for by a perceptron; that is a substitution, not the same model."""
    return {
        "random_forest": RandomForestClassifier(numTrees=100, maxDepth=20, seed=seed),
        "gradient_boosting": GBTClassifier(maxIter=50, seed=seed),
        "linear_svm": LinearSVC(maxIter=50),
        "perceptron": lambda width, classes: MultilayerPerceptronClassifier(layers=[width, 32, classes], seed=seed, maxIter=100),
    }


def fit_and_predict(train: DataFrame, test: DataFrame, columns: list[str], label: str, estimator, classes: int = 2) -> DataFrame:
    """Test rows with ``prediction`` (and ``score`` where the model has probabilities)."""
    if callable(estimator) and not hasattr(estimator, "fit"):
        estimator = estimator(len(columns), classes)
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), estimator.copy({estimator.labelCol: label})]).fit(train)
    out = model.transform(test)
    return out.withColumn("score", vector_to_array("probability")[1]) if "probability" in out.columns else out


def reconstruction_scores(df: DataFrame, columns: list[str], benign: Column, k: int = 8, contamination: float = 0.1) -> DataFrame:
    """Squared error of a k-component reconstruction fitted on benign rows, and whether it exceeds their (1 - contamination) quantile."""
    vector = VectorAssembler(inputCols=columns, outputCol="features")
    x = vector.transform(df)
    model = PCA(k=min(k, len(columns)), inputCol="features", outputCol="pc").fit(x.where(benign))
    m = model.pc.toArray()
    mean = [r or 0.0 for r in df.where(benign).agg(*(F.avg(c) for c in columns)).first()]
    centred = F.array(*(F.col(c) - F.lit(v) for c, v in zip(columns, mean, strict=True)))
    dot = lambda w: F.aggregate(F.zip_with("_x", F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    with_x = df.withColumn("_x", centred)
    inside = sum((dot(m[:, j].tolist()) ** 2 for j in range(m.shape[1])), F.lit(0.0))
    total = F.aggregate("_x", F.lit(0.0), lambda a, b: a + b * b)
    scored = with_x.withColumn("mse", F.greatest(F.lit(0.0), total - inside) / len(columns)).drop("_x")
    limit = scored.where(benign).agg(F.percentile("mse", F.lit(1 - contamination)).alias("q")).scalar()
    return scored.withColumn("outlier", F.col("mse") > limit)


def session_clusters(df: DataFrame, columns: list[str], k: int = 2, seed: int = 42) -> DataFrame:
    x = VectorAssembler(inputCols=columns, outputCol="features").transform(df)
    return KMeans(k=k, seed=seed).fit(x).transform(x)


def performance_drop(df: DataFrame, base: str = "base", value: str = "f1") -> DataFrame:
    """Adds the drop in per cent and its importance."""
    drop = (F.col(base) - F.col(value)) / F.col(base) * 100
    return df.withColumn("performance_drop", drop).withColumn("importance", F.when(drop > 5, "critical").when(drop > 3, "high").when(drop > 1, "medium").otherwise("low"))


def _left_out(parts: dict[str, list[str]]) -> dict[str, Column]:
    """By name, whether an anomaly's rule still runs: for all rules, and without each part's."""
    return {"full": F.lit(True), **{name: ~F.col("rule").isin(gone) if gone else F.lit(True) for name, gone in parts.items()}}


def rule_ablation(frames: Frames, truth: DataFrame, thresholds: Thresholds = CODE) -> DataFrame:
    """(component, tp, fp, fn, f1): sessions detected with all rules and with each category left out, against (session_id, label). One detection serves all cases."""
    cases = _left_out(CATEGORIES)
    seen = members(detect(frames, thresholds), frames).groupBy("session_id").agg(*(F.bool_or(c).alias(f"hit_{n}") for n, c in cases.items()))
    both = truth.select("session_id", "label").join(seen, "session_id", "left").na.fill(False, [f"hit_{n}" for n in cases])
    count = lambda n, hit, label: F.count_if((F.col(f"hit_{n}") == hit) & (F.col("label") == label))
    rows = [F.struct(F.lit(n).alias("component"), count(n, True, 1).alias("tp"), count(n, True, 0).alias("fp"), count(n, False, 1).alias("fn")) for n in cases]
    out = both.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return out.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0))


def weight_ablation(df: DataFrame, parts: list[Column], truth: str, threshold: float = 0.5) -> DataFrame:
    """F1 of the composite score with each weight left out and with equal weights."""
    weights = (0.3, 0.2, 0.35, 0.15)
    cases = {"full": weights, **{n: tuple(0 if j == i else w for j, w in enumerate(weights)) for i, n in enumerate(("alpha", "beta", "gamma", "delta"))}, "equal": (1, 1, 1, 1)}
    out = None
    for name, w in cases.items():
        guess = (F.col("composite") > threshold).cast("int")
        a = composite_score(df, *parts, weights=w).agg(F.count_if((guess == 1) & (F.col(truth) == 1)).alias("tp"), F.count_if((guess == 1) & (F.col(truth) == 0)).alias("fp"), F.count_if((guess == 0) & (F.col(truth) == 1)).alias("fn"))
        row = a.select(F.lit(name).alias("component"), F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0).alias("f1"))
        out = row if out is None else out.unionByName(row)
    return out


def importance_heatmap(df: DataFrame) -> DataFrame:
    """Categories by components (category, component, performance_drop)."""
    return df.groupBy("category").pivot("component").agg(F.first("performance_drop"))


def latex_table(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(seq, line): a LaTeX table of a small frame, names in title case."""
    names = " & ".join(c.replace("_", " ").title() for c in columns)
    cells = [F.initcap(F.replace(F.col(c), F.lit("_"), F.lit(" "))) if dict(df.dtypes)[c] == "string" else F.format_string("%.3f", F.col(c).cast("double")) for c in columns]
    rows = df.select((F.row_number().over(Window.orderBy(F.col(order).desc(), columns[0])) + 1).alias("seq"), F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")).alias("line"))
    fixed = df.sparkSession.createDataFrame([(0, "\\begin{tabular}{" + "l" * len(columns) + "}"), (1, names + " \\\\ \\hline"), (1_000_000, "\\end{tabular}")], "seq int, line string")
    return fixed.unionByName(rows)


def load_dataset(spark, folder: str, cache: str, config: dict) -> DataFrame:
    """Scan, preprocess, index labels, split and scale by the training rows; kept under a path of the whole configuration.

    config: missing, labels, features, train, validation, seed (all optional).
    """
    from wirelattice.sources.files import cached, numeric_features, read_flows

    def build() -> DataFrame:
        raw = read_flows(spark, folder, keep=config.get("labels"))
        df = label_index(numeric_features(preprocess(raw, config.get("missing", "mean")), config.get("features"), exclude=EXCLUDED))
        keyed = df.withColumn("row_key", F.xxhash64(*df.columns))
        parts = stratified_split(keyed, "row_key", "Label", config.get("train", 0.7), config.get("validation", 0.15), config.get("seed", 42))
        columns = numeric(parts, "label_id", "row_key")
        return standardise(parts, columns, F.col("split") == "train")

    return cached(spark, {"folder": folder, **config}, cache, build)


#: Identifier columns of flow files that are no features.
EXCLUDED = ("Flow ID", "Source IP", "Destination IP", "Timestamp", "Source Port", "Destination Port", "Protocol", "Fwd Header Length.1", "Unnamed: 0")


def compare_models(train: DataFrame, test: DataFrame, columns: list[str], label: str, models: dict | None = None) -> list[dict]:
    """Metrics and seconds of each model; one that fails is reported with its error and does not stop the others."""
    import time

    from wirelattice.operators.statistics import auc, classification_metrics

    out = []
    for name, model in (models or baselines()).items():
        start = time.time()
        try:
            got = fit_and_predict(train, test, columns, label, model).withColumn("prediction", F.col("prediction").cast("int")).persist()
            row = classification_metrics(got, label, "prediction").first().asDict()
            if "score" in got.columns:
                row["auc"] = auc(got, label, "score").first()["auc"]
            got.unpersist()
        except Exception as e:  # noqa: BLE001  a comparison goes on without a model that can't be fitted
            row = {"error": str(e)[:200]}
        out.append({"model": name, "seconds": round(time.time() - start, 3), **row})
    return out


def feature_importance(train: DataFrame, columns: list[str], label: str, seed: int = 42) -> DataFrame:
    """(feature, importance) of a random forest, most important first."""
    x = VectorAssembler(inputCols=columns, outputCol="features").transform(train)
    model = RandomForestClassifier(numTrees=20, labelCol=label, seed=seed).fit(x)
    rows = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)]
    return train.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


#: Parts of the ontology and the rules that need them; of attack entities, the rules that conclude one of the reference's five.
COMPONENTS = {
    "http": ["login_flood", "http_flood", "expensive_endpoint_burst", "latency_increase", "slow_request", "api_abuse"],
    "dns": ["qname_randomization", "qname_randomization_domain", "nxdomain_flood", "nxdomain_flood_domain", "dns_water_torture", "dns_amplification", "dns_amplification_any", "phantom_domain", "dns_tunneling"],
    "session": ["login_flood", "http_flood", "low_session_value", "repetitive_route", "scraping"],
    "attack": ["login_flood", "http_flood", "expensive_endpoint_burst", "latency_increase", "qname_randomization", "qname_randomization_domain", "nxdomain_flood", "nxdomain_flood_domain", "dns_water_torture"],
    "mitigation": [],  # no rule reads mitigations
    "behaviour": ["bot_behavior", "scraping"],
}


def ontology_ablation(frames: Frames, thresholds: Thresholds = CODE) -> DataFrame:
    """(component, anomalies, endpoints): what is left to detect without each part of the ontology. One detection serves all cases."""
    found = detect(frames, thresholds).groupBy("rule", "target_endpoint").agg(F.count("*").alias("n"))
    hit = F.col("target_endpoint") != ""
    rows = [
        F.struct(F.lit(name).alias("component"), F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0)).alias("anomalies"), F.countDistinct(F.when(keep & hit, F.col("target_endpoint"))).alias("endpoints"))
        for name, keep in _left_out(COMPONENTS).items()
    ]
    return found.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
