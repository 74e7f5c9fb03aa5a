import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.session import local_session

local_session(4, "4g", 4)  # columns need a session when they are made

def one(spark, column, **arrays):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in arrays.items()])
    return df.select(column.alias("x")).first()["x"]


a, b = F.col("a"), F.col("b")


def test_proportions_and_psi(spark):
    assert one(spark, stats.proportions(a), a=[1, 3]) == [0.25, 0.75]
    assert one(spark, stats.proportions(a), a=[0, 0]) == [0.0, 0.0]
    p, q = 0.4, 0.5
    want = (q - p) * math.log(q / p) + (p - q) * math.log((1 - q) / (1 - p))
    assert one(spark, stats.psi(a, b), a=[4, 6], b=[5, 5]) == pytest.approx(want, abs=1e-9)
    assert one(spark, stats.psi(a, b), a=[4, 6], b=[5, 5]) == pytest.approx(one(spark, stats.psi(b, a), a=[4, 6], b=[5, 5]))
    assert one(spark, stats.psi(a, b), a=[4, 6], b=[1, 2, 3]) is None
    assert one(spark, stats.psi(a, b), a=[0, 0], b=[1, 2]) is None


def test_js_bounds(spark):
    assert one(spark, stats.js(a, b), a=[5, 5], b=[5, 5]) == pytest.approx(0)
    assert 0.99 < one(spark, stats.js(a, b), a=[1, 0], b=[0, 1]) <= 1


@pytest.mark.parametrize("stat, dof, p", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05),
                                         (16.266, 3, 0.001), (0.0, 2, 1.0), (5.0, 0, 1.0)])
def test_chi2_survival(spark, stat, dof, p):
    assert one(spark, stats.chi2_survival(a, b), a=stat, b=dof) == pytest.approx(p, rel=1e-3)


def test_chi2_tail_stays_positive(spark):
    assert 0 <= one(spark, stats.chi2_survival(a, b), a=400.0, b=2) < 1e-80
    assert one(spark, stats.chi2_survival(a, b), a=100.0, b=1) == pytest.approx(1.52e-23, rel=0.01)


def test_chi2_of_a_table(spark):
    c = stats.chi2_statistic(a, b)
    assert one(spark, c["stat"], a=[10, 20], b=[20, 10]) == pytest.approx(20 / 3)
    assert tuple(one(spark, c, a=[10, 0], b=[5, 0])) == (0.0, 0)
    assert one(spark, c["dof"], a=[1, 0, 2], b=[2, 0, 1]) == 1


def test_histogram_quantile(spark):
    assert one(spark, stats.histogram_quantile(a, b, 0.5), a=[0, 10, 0], b=[0.0, 1.0, 2.0, 3.0]) == pytest.approx(1.5)
    assert one(spark, stats.histogram_quantile(a, b, 0.5), a=[5, 0, 5], b=[0.0, 1.0, 2.0, 3.0]) == pytest.approx(1.0)
    assert one(spark, stats.histogram_quantile(a, b, 0.5), a=[0, 0], b=[0.0, 1.0, 2.0]) is None
    assert one(spark, stats.histogram_quantile(a, b, 0.5), a=[1, 1], b=[0.0, 1.0]) is None


@pytest.mark.parametrize("value, at", [(-1.0, 0), (0.0, 0), (0.5, 1), (0.99, 1), (1.0, 1), (2.0, 1)])
def test_bins(spark, value, at):
    assert one(spark, stats.bin_index(a, b), a=value, b=[0.0, 0.5, 1.0]) == at
    assert one(spark, stats.bin_index_of(a, [0.0, 0.5, 1.0]), a=value) == at
