import pytest
from pyspark.sql import functions as F

from wirelattice.functions import distributions as dist
from wirelattice.functions import scalars as s


def one(spark, expr, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(expr(F.col("x"))).collect()]


def test_entropy(spark):
    got = one(spark, s.char_entropy, "", "aaaa", "Y2F0YXN0cm9waGU000.tunnel", "abAB", None)
    assert got[:2] == [0.0, 0.0] and round(got[2], 6) == 3.829275 and got[3] == 1.0 and got[4] is None


def test_domains(spark):
    names = ["a.b.example.com.", "localhost", "localhost.", "example.com"]
    assert one(spark, s.base_domain, *names) == ["example.com", "localhost", "localhost.", "example.com"]
    assert one(spark, s.subdomain, *names) == ["a.b", "", "", ""]


def test_random_labels(spark):
    assert one(spark, s.is_random_label, "delayed-phantom", "slow-phanton", "nonexistent12") == [True, False, False]


def test_rate_boundaries(spark):
    df = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:00:00'), (5, timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:00:00.4'), (6, timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:00:03') t(n, a, b)")
    assert [r[0] for r in df.select(s.rate(F.col("n"), F.col("a"), F.col("b"))).collect()] == [0.0, 5.0, 2.0]


def test_iso_and_ids(spark):
    row = spark.sql("select timestamp'2024-01-01 10:00:00' a, timestamp'2024-01-01 10:00:00.5' b, '/a/b.c' p").select(s.iso(F.col("a")), s.iso(F.col("b")), s.node_id("endpoint", F.col("p"))).first()
    assert tuple(row) == ("2024-01-01T10:00:00", "2024-01-01T10:00:00.500000", "endpoint__a_b_c")


def test_registered_sql_functions(spark):
    s.register(spark)
    assert tuple(spark.sql("select base_domain('x.y.example.org.'), ip_prefix('1.2.3.4')").first()) == ("example.org", "1.2.3")


@pytest.mark.parametrize(
    ("got", "want"),
    [
        (dist.t_quantile(0.975, 9), 2.262157), (dist.t_two_sided(2.262157, 9), 0.05), (dist.f_upper(3.3541, 2, 27), 0.05), (dist.chi2_upper(5.991465, 2), 0.05), (dist.chi2_upper(3.841459, 1), 0.05),
        (dist.wilcoxon_two_sided(8, 10), 0.048828), (dist.betainc(2, 3, 0.4), 0.5248),
    ],
)
def test_distributions(got, want):
    assert abs(got - want) < 5e-5
