"""Evaluation metrics and significance tests: aggregates and ranks in Spark, p-values of the few results on the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelattice.functions import distributions as dist


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def normalised_confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return confusion(df, truth, guess).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def class_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Per class: precision, recall, F1, support; divisions by zero give 0."""
    c = confusion(df, truth, guess)
    rows = c.select(F.col("truth").alias("class"), F.col("n").alias("t"), F.lit(0).alias("g"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("tp")).unionByName(
        c.select(F.col("guess").alias("class"), F.lit(0).alias("t"), F.col("n").alias("g"), F.lit(0).alias("tp"))
    )
    a = rows.groupBy("class").agg(F.sum("t").alias("support"), F.sum("g").alias("g"), F.sum("tp").alias("tp"))
    p, r = F.when(F.col("g") > 0, F.col("tp") / F.col("g")).otherwise(0.0), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    m = a.withColumn("precision", p).withColumn("recall", r)
    s = F.col("precision") + F.col("recall")
    return m.select("class", "support", "precision", "recall", F.when(s > 0, 2 * F.col("precision") * F.col("recall") / s).otherwise(0.0).alias("f1"))


def classification_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: accuracy, weighted precision, recall and F1, false-positive rate of the larger of two classes."""
    m = class_metrics(df, truth, guess)
    w = lambda c: (F.sum(F.col("support") * F.col(c)) / F.sum("support")).alias(c)
    weighted = m.agg(w("precision"), w("recall"), w("f1"))
    neg = F.col(truth) == 0
    top = df.agg(F.avg((F.col(truth) == F.col(guess)).cast("int")).alias("accuracy"), (F.count_if(neg & (F.col(guess) != 0)) / F.greatest(F.count_if(neg), F.lit(1))).alias("fpr"))
    return top.join(weighted)


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Exact area under the ROC curve by average ranks.

    Ranks come from counts per distinct score: a cumulative sum over score buckets (of the score's rank order),
    so no window runs over all rows in one task.
    """
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(truth) > 0).alias("p"), F.count_if(F.col(truth) <= 0).alias("q"))
    below = _before(per, "s", "q")
    a = below.agg(F.sum(F.col("p") * (F.col("before_q") + F.col("q") / 2)).alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return a.select((F.col("u") / (F.col("np") * F.col("nq"))).alias("auc"))


#: Rows that one range of a running sum holds, about.
RANGE_ROWS = 1_000_000


def _before(df: DataFrame, order: str, *values: str) -> DataFrame:
    """Adds ``before_<value>`` for each value: its sum over rows with a smaller ``order``, which must be distinct and not null.

    Sums run inside ranges of ``order`` and start at the sum of the ranges before; the number of ranges grows with the rows.
    """
    parts = max(64, df.count() // RANGE_ROWS)
    edges = df.select(F.percentile_approx(order, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    limits = F.lit(sorted(set(edges))) if edges else F.array().cast("array<double>")
    cut = df.withColumn("part", F.size(F.filter(limits, lambda e: e < F.col(order))))
    below = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("part").agg(*(F.sum(v).alias(f"total_{v}") for v in values))
    carried = totals.select("part", *(F.coalesce(F.sum(f"total_{v}").over(earlier), F.lit(0)).alias(f"carried_{v}") for v in values))
    inside = cut.select("*", *(F.coalesce(F.sum(v).over(below), F.lit(0)).alias(f"inside_{v}") for v in values))
    out = inside.join(F.broadcast(carried), "part")  # one row a range
    return out.select(*df.columns, *((F.col(f"inside_{v}") + F.col(f"carried_{v}")).alias(f"before_{v}") for v in values))


def _threshold_counts(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Per distinct score, without rounding (nulls apart): positives p and others q at it, tp and fp at or above it, all of both."""
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count_if(F.col(truth) > 0).alias("p"), F.count_if(F.col(truth) <= 0).alias("q"))
    every = per.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    out = _before(per, "threshold", "p", "q").join(F.broadcast(every))  # one row
    return out.select("threshold", (F.col("all_p") - F.col("before_p")).alias("tp"), (F.col("all_q") - F.col("before_q")).alias("fp"), "all_p", "all_q")


def roc_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score; a rate is null where its class has no rows."""
    c = _threshold_counts(df, truth, score)
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return c.select("threshold", rate("tp", "all_p").alias("tpr"), rate("fp", "all_q").alias("fpr"))


def fold_summary(scores: DataFrame) -> DataFrame:
    """(method, n, mean, sd, low, high): folds with a 95 % t interval (method, fold, value)."""
    rows = scores.groupBy("method").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    sizes = [r["n"] for r in rows.select("n").distinct().collect()]
    t = F.create_map(*(F.lit(x) for n in sizes for x in (n, dist.t_quantile(0.975, n - 1) if n > 1 else float("nan")))) if sizes else F.create_map(F.lit(0), F.lit(0.0))
    half = t[F.col("n")] * F.col("sd") / F.sqrt("n")
    return rows.select("method", "n", "mean", "sd", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def paired_t(scores: DataFrame, a: str, b: str) -> dict[str, float]:
    """t, p and Cohen's d of two methods' folds."""
    x = scores.where(F.col("method").isin(a, b)).groupBy("fold").pivot("method", [a, b]).agg(F.first("value"))
    r = x.select((F.col(a) - F.col(b)).alias("d")).agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s")).first()
    if not r["n"] or r["n"] < 2 or not r["s"]:
        return {"t": 0.0 if not r["m"] else math.inf, "p": 1.0 if not r["m"] else 0.0, "effect": 0.0}
    t = r["m"] / (r["s"] / math.sqrt(r["n"]))
    return {"t": t, "p": dist.t_two_sided(t, r["n"] - 1), "effect": r["m"] / r["s"]}


def wilcoxon(scores: DataFrame, a: str, b: str) -> dict[str, float]:
    """The signed-rank test, with average ranks of ties."""
    x = scores.where(F.col("method").isin(a, b)).groupBy("fold").pivot("method", [a, b]).agg(F.first("value"))
    d = x.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("size", F.round(F.abs("d"), 12))
    w = Window.orderBy("size")
    r = d.withColumn("rank", F.rank().over(w) + (F.count("*").over(Window.partitionBy("size")) - 1) / 2)
    s = r.agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("down"), F.countDistinct("size").alias("k")).first()
    if not s["n"]:
        return {"w": 0.0, "p": 1.0, "effect": 0.0}
    low = min(s["up"], s["down"])
    return {"w": low, "p": dist.wilcoxon_two_sided(low, s["n"], exact=s["k"] == s["n"]), "effect": 1 - 2 * low / (s["n"] * (s["n"] + 1) / 2)}


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: sums of squares, F and eta squared."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("v")).alias("ss_within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    between = F.col("q") - F.col("n") * F.col("grand") * F.col("grand")
    out = t.withColumn("ss_between", between)
    f = (F.col("ss_between") / (F.col("k") - 1)) / (F.col("ss_within") / (F.col("n") - F.col("k")))
    return out.select("k", "n", "ss_between", "ss_within", f.alias("f"), (F.col("ss_between") / (F.col("ss_between") + F.col("ss_within"))).alias("eta_squared"))


def anova_test(df: DataFrame, group: str, value: str) -> dict[str, float]:
    r = anova(df, group, value).first()
    return {"f": r["f"], "p": dist.f_upper(r["f"], r["k"] - 1, r["n"] - r["k"]), "eta_squared": r["eta_squared"]}


def friedman(scores: DataFrame) -> dict[str, float]:
    """Friedman's chi square over folds as blocks, with average ranks of ties."""
    block = Window.partitionBy("fold")
    r = scores.withColumn("rank", F.rank().over(block.orderBy("value")) + (F.count("*").over(Window.partitionBy("fold", "value")) - 1) / 2)
    m = r.groupBy("method").agg(F.sum("rank").alias("s"), F.count("*").alias("n"))
    a = m.agg(F.count("*").alias("k"), F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).first()
    k, n = a["k"], a["n"]
    chi = 12 / (n * k * (k + 1)) * a["q"] - 3 * n * (k + 1)
    return {"chi2": chi, "p": dist.chi2_upper(chi, k - 1)}


def corrected(p: DataFrame, method: str, legacy: bool = False) -> DataFrame:
    """Adjusted p-values of (id, p): bonferroni, holm or benjamini_hochberg; legacy leaves out or turns round the step that makes them monotone."""
    m = p.select("*", F.count("*").over(Window.partitionBy()).alias("m"), F.row_number().over(Window.orderBy("p", "id")).alias("r"))
    up = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.col("r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    if method == "bonferroni":
        q = F.col("p") * F.col("m")
    elif method == "holm":
        step = F.col("p") * (F.col("m") - F.col("r") + 1)
        q = step if legacy else F.max(step).over(up)
    else:
        step = F.col("p") * F.col("m") / F.col("r")
        q = F.max(step).over(down) if legacy else F.min(step).over(down)
    return m.select("id", "p", F.least(F.lit(1.0), q).alias("adjusted"))


def post_hoc(scores: DataFrame, method: str = "bonferroni") -> list[dict]:
    """All pairs of methods by paired t-tests, with corrected p-values."""
    names = sorted(r[0] for r in scores.select("method").distinct().collect())
    pairs = [{"a": a, "b": b} | paired_t(scores, a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if not pairs:
        return []
    df = scores.sparkSession.createDataFrame([(i, float(x["p"])) for i, x in enumerate(pairs)], "id int, p double")
    for r in corrected(df, method).collect():
        pairs[r["id"]]["adjusted"] = r["adjusted"]
    return pairs


def effect_wording(d: float) -> str:
    return next((w for limit, w in ((0.2, "negligible"), (0.5, "small"), (0.8, "medium")) if abs(d) < limit), "large")


def report(scores: DataFrame) -> str:
    """A text report: ANOVA for more than two methods, a paired t-test for two."""
    rows = fold_summary(scores).orderBy("method").collect()
    lines = [f"{r['method']}: {r['mean']:.4f} ± {r['sd']:.4f} [{r['low']:.4f}, {r['high']:.4f}]" for r in rows]
    if len(rows) == 2:
        x = paired_t(scores, rows[0]["method"], rows[1]["method"])
        lines.append(f"paired t = {x['t']:.4f}, p = {x['p']:.4g}, effect {effect_wording(x['effect'])}")
    elif len(rows) > 2:
        x = anova_test(scores, "method", "value")
        lines.append(f"ANOVA F = {x['f']:.4f}, p = {x['p']:.4g}, eta squared = {x['eta_squared']:.4f}")
        lines += [f"{y['a']} vs {y['b']}: p = {y['adjusted']:.4g}" for y in post_hoc(scores)]
    return "\n".join(lines)


def precision_recall_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(threshold, precision, recall) at every distinct score; recall is null without positives."""
    c = _threshold_counts(df, truth, score)
    return c.select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.when(F.col("all_p") > 0, F.col("tp") / F.col("all_p")).alias("recall"))


def radar(metrics: DataFrame) -> DataFrame:
    """(method, metric, value) of a wide table of metrics, with the false-positive rate turned round."""
    names = [c for c in metrics.columns if c != "method"]
    pairs = F.array(*(F.struct(F.lit("1 - fpr" if c == "fpr" else c).alias("metric"), (1 - F.col(c) if c == "fpr" else F.col(c)).cast("double").alias("value")) for c in names))
    return metrics.select("method", F.explode(pairs).alias("x")).select("method", "x.metric", "x.value")


def stars(p):
    """The usual marks of significance."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
