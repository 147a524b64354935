"""Column functions of the traffic engine: plain expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def char_entropy(s: Column) -> Column:
    """Shannon entropy in bits of the lower-cased characters; 0 for an empty string, null for null."""
    low, n = F.lower(s), F.length(s)
    share = lambda c: (n - F.length(F.replace(low, c, F.lit("")))) / n
    total = F.aggregate(F.array_distinct(F.split(low, "")), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    return F.when(n == 0, F.lit(0.0)).otherwise(total)


def labels(qname: Column) -> Column:
    return F.split(F.rtrim(qname, F.lit(".")), r"\.")


def base_domain(qname: Column) -> Column:
    """The last two labels; a name of one label is returned as it is."""
    return F.when(F.size(labels(qname)) >= 2, F.substring_index(F.rtrim(qname, F.lit(".")), ".", -2)).otherwise(qname)


def subdomain(qname: Column) -> Column:
    """All labels but the last two."""
    parts = labels(qname)
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 2), ".")).otherwise("")


def is_random_label(sub: Column) -> Column:
    """Long and of high entropy, dots counted as characters."""
    return (F.length(sub) >= 8) & (char_entropy(sub) > 3.5) & (F.length(sub) > 10)


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def severity(score: Column) -> Column:
    return F.when(score > 0.7, "high").otherwise("medium")


def guarded_ratio(a: Column, b: Column) -> Column:
    """a over b, with b at least 1."""
    return a / F.greatest(b.cast("double"), F.lit(1.0))


def span_seconds(first: Column, last: Column) -> Column:
    return (F.unix_micros(last) - F.unix_micros(first)) / 1e6


def rate(n: Column, first: Column, last: Column) -> Column:
    """Events per second over a span of at least one second; 0 for fewer than two."""
    return F.when(n >= 2, n / F.greatest(span_seconds(first, last), F.lit(1.0))).otherwise(0.0)


def iso(ts: Column) -> Column:
    """ISO text without a zero fraction."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def node_id(kind: str, key: Column) -> Column:
    """A display id; joins use the raw key."""
    return F.concat(F.lit(kind + "_"), F.regexp_replace(key, "[/.]", "_"))


def ip_prefix(ip: Column) -> Column:
    return F.substring_index(ip, ".", 3)


def endpoint_class(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.rlike("login|auth|signin"), "Auth").when(p.contains("/api/") | p.contains("graphql"), "API").otherwise("Static")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def zero_infinite(c: Column) -> Column:
    """Null, NaN and infinite values as 0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def register(spark: SparkSession) -> None:
    """The name functions for SQL users, as temporary SQL functions that the optimizer inlines."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION base_domain(q STRING) RETURNS STRING RETURN CASE WHEN size(split(rtrim('.', q), '[.]')) >= 2 THEN substring_index(rtrim('.', q), '.', -2) ELSE q END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ip_prefix(ip STRING) RETURNS STRING RETURN substring_index(ip, '.', 3)")
