"""Statistical functions as columns over arrays of counts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-4
STEPS = 500
TINY = 1e-300


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once: lambdas evaluate what they capture at every step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x.cast("double"))


def proportions(counts: Column) -> Column:
    """Shares; zeros where the total isn't positive."""
    return let(counts, lambda c: let(total(c), lambda t: F.transform(
        c, lambda x: F.when(t > 0, x.cast("double") / t).otherwise(F.lit(0.0)))))


def histogram_shares(counts: Column) -> Column:
    """Shares of a histogram; null where it is empty or sums to zero."""
    return let(counts, lambda c: F.when((F.size(c) > 0) & (total(c) > 0), proportions(c)))


def smoothed(shares: Column, eps: float = EPS) -> Column:
    """Every share `eps` at least, and all adding up to one again."""
    floored = F.transform(shares, lambda x: F.greatest(x, F.lit(eps)))
    return let(floored, lambda f: let(total(f), lambda t: F.transform(f, lambda x: x / t)))


def comparable(a: Column, b: Column) -> Column:
    """Whether two histograms can be held against each other (K2)."""
    return F.coalesce((F.size(a) > 0) & (F.size(a) == F.size(b)) & (total(a) > 0) & (total(b) > 0), F.lit(False))


def psi_of_shares(p: Column, q: Column, eps: float = EPS) -> Column:
    """Population stability index; zero for arrays of different lengths."""
    terms = F.zip_with(smoothed(p, eps), smoothed(q, eps), lambda x, y: (y - x) * F.ln(y / x))
    return F.when(F.size(p) == F.size(q), total(terms)).otherwise(F.lit(0.0))


def js_of_shares(p: Column, q: Column, eps: float = EPS) -> Column:
    """Jensen-Shannon divergence to base 2, between 0 and 1."""
    def term(x, y):
        m = (x + y) / 2
        return 0.5 * x * F.log2(x / m) + 0.5 * y * F.log2(y / m)

    terms = F.zip_with(smoothed(p, eps), smoothed(q, eps), term)
    return F.when(F.size(p) == F.size(q), total(terms)).otherwise(F.lit(0.0))


def psi(a: Column, b: Column, eps: float = EPS) -> Column:
    """PSI of two count arrays; null where they aren't comparable."""
    return _compared(a, b, lambda x, y: psi_of_shares(proportions(x), proportions(y), eps))


def js(a: Column, b: Column, eps: float = EPS) -> Column:
    return _compared(a, b, lambda x, y: js_of_shares(proportions(x), proportions(y), eps))


def _compared(a: Column, b: Column, measure) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.when(comparable(s["a"], s["b"]), measure(s["a"], s["b"])))


def chi2_statistic(a: Column, b: Column) -> Column:
    """struct(stat, dof) of a table of two rows; columns without counts are left out, a table
    smaller than 2 x 2 gives (0, 0)."""
    pairs = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))),
                     lambda p: p["x"] + p["y"] > 0)
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    sums = lambda v: F.aggregate(v, zero, lambda s, p: F.struct((s["a"] + p["x"]).alias("a"), (s["b"] + p["y"]).alias("b")))

    def measured(v, t):
        def term(s, p):
            n = t["a"] + t["b"]
            ea, eb = t["a"] * (p["x"] + p["y"]) / n, t["b"] * (p["x"] + p["y"]) / n
            return s + (p["x"] - ea) * (p["x"] - ea) / ea + (p["y"] - eb) * (p["y"] - eb) / eb

        whole = (F.size(v) >= 2) & (t["a"] > 0) & (t["b"] > 0)
        stat = F.when(whole, F.aggregate(v, F.lit(0.0), term)).otherwise(F.lit(0.0))
        return F.struct(stat.alias("stat"), F.when(whole, F.size(v) - 1).otherwise(F.lit(0)).alias("dof"))

    return let(pairs, lambda v: let(sums(v), lambda t: measured(v, t)))


def log_gamma_half(dof: Column) -> Column:
    """ln gamma(dof / 2) for whole dof, as a finite sum."""
    m = F.floor(dof / 2).cast("int")
    even = F.aggregate(F.when(m > 1, F.sequence(F.lit(1), m - 1)).otherwise(F.array().cast("array<int>")), F.lit(0.0),
                       lambda s, i: s + F.ln(i.cast("double")))
    odd = F.aggregate(F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>")), F.lit(0.5 * math.log(math.pi)),
                      lambda s, i: s + F.ln(i.cast("double") + 0.5))
    return F.when(dof % 2 == 0, even).otherwise(odd)


def chi2_survival(stat: Column, dof: Column) -> Column:
    """P(chi-square >= stat): the regularised upper incomplete gamma function of (dof/2, stat/2),
    by its series below the mean and by its continued fraction above."""
    return let(F.struct(stat.cast("double").alias("s"), dof.cast("int").alias("d")), lambda v: F.when(
        (v["d"] <= 0) | (v["s"] <= 0), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _upper_gamma(v["s"], v["d"])))))


def _upper_gamma(stat: Column, dof: Column) -> Column:
    a, x = dof.cast("double") / 2, stat / 2
    front = F.exp(-x + a * F.ln(x) - log_gamma_half(dof))
    steps = F.sequence(F.lit(1), F.lit(STEPS))
    # What the steps need travels in the state.
    series = F.aggregate(steps, F.struct(a.alias("a"), x.alias("x"), (1 / a).alias("term"), (1 / a).alias("sum")), lambda s, n: F.struct(
        s["a"].alias("a"), s["x"].alias("x"), (s["term"] * s["x"] / (s["a"] + n)).alias("term"),
        (s["sum"] + s["term"] * s["x"] / (s["a"] + n)).alias("sum")), lambda s: s["sum"])
    away = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    def fraction(s, n):
        an = -n * (n - s["a"])
        b = s["b"] + 2
        d = 1 / away(an * s["d"] + b)
        c = away(b + an / s["c"])
        return F.struct(s["a"].alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    b0 = x + 1 - a
    start = F.struct(a.alias("a"), b0.alias("b"), F.lit(1 / TINY).alias("c"), (1 / away(b0)).alias("d"), (1 / away(b0)).alias("h"))
    continued = F.aggregate(steps, start, fraction, lambda s: s["h"])
    return F.when(x < a + 1, 1 - front * series).otherwise(front * continued)


def bin_index(value: Column, edges: Column) -> Column:
    """Left-closed bins, the last one closed, values outside in the end bins."""
    at = F.size(F.filter(edges, lambda e: e <= value)) - 1
    return F.greatest(F.lit(0), F.least(at, F.size(edges) - 2))


def bin_index_of(value: Column, edges: list[float]) -> Column:
    """The same for edges known when planning: plain comparisons, which compile."""
    at = F.lit(0)
    for e in edges[1:-1]:
        at = at + F.when(value >= e, 1).otherwise(0)
    return at


def histogram_quantile(counts: Column, edges: Column, q: float) -> Column:
    """Interpolated in the first bin with counts that reaches `q` of the total; null for other lengths or no counts."""
    zero = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("found"))

    def searched(v):
        def step(s, i):
            n = F.get(v["c"], i).cast("double")
            lo, hi = F.get(v["e"], i), F.get(v["e"], i + 1)
            hit = s["found"].isNull() & (n > 0) & (s["cum"] + n >= v["want"])
            return F.struct((s["cum"] + n).alias("cum"), F.when(hit, lo + (hi - lo) * (v["want"] - s["cum"]) / n).otherwise(s["found"]).alias("found"))

        fits = (F.size(v["c"]) > 0) & (F.size(v["e"]) == F.size(v["c"]) + 1) & (v["want"] > 0)
        return F.when(fits, F.aggregate(F.sequence(F.lit(0), F.size(v["c"]) - 1), zero, step, lambda s: s["found"]))

    return let(F.struct(counts.alias("c"), edges.alias("e"), (total(counts) * q).alias("want")), searched)


def mean(s: Column, n: Column) -> Column:
    return F.try_divide(s.cast("double"), n)


def std(s: Column, squares: Column, n: Column) -> Column:
    """Population standard deviation from sums."""
    m = mean(s, n)
    return F.sqrt(F.greatest(F.try_divide(squares.cast("double"), n) - m * m, F.lit(0.0)))


def rate(part: Column, n: Column) -> Column:
    """Null without a numerator, or where `n` isn't positive."""
    return F.when(n > 0, part.cast("double") / n)


def delta(before: Column, after: Column) -> Column:
    return after - before


def ratio(before: Column, after: Column) -> Column:
    return F.try_divide(after, F.when(before != 0, before))
