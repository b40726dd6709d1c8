"""Tail probabilities and quantiles as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the Lanczos approximation of the gamma function, g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
#: Acklam's rational approximation of the normal quantile (centre, tail) and where the tail begins.
CENTRE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732537539734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661996416e00, 1.0),
)
TAIL_FROM = 0.02425
#: Steps of the continued fraction; enough for degrees of freedom up to some hundred thousand.
STEPS = 600


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _horner(c: tuple[float, ...], x: Column) -> Column:
    out = F.lit(c[0])
    for v in c[1:]:
        out = out * x + v
    return out


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0."""
    y = x - 1
    s = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        s = s + F.lit(c) / (y + i)
    t = y + 7.5
    return 0.9189385332046727 + (y + 0.5) * F.ln(t) - t + F.ln(s)


def _fraction(p: Column) -> Column:
    """The continued fraction of the incomplete beta function at p (a, b, x), by Lentz's method."""
    a, b, x = p["a"], p["b"], p["x"]
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    start = _with(1 / safe(1 - (a + b) * x / (a + 1)), lambda d: F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")))

    def turn(s: Column, n: Column) -> Column:
        m = n.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

        def half(s: Column, k: Column) -> Column:
            return _with(F.struct((1 / safe(1 + k * s["d"])).alias("d"), safe(1 + k / s["c"]).alias("c"), s["h"].alias("h")),
                         lambda t: F.struct(t["c"].alias("c"), t["d"].alias("d"), (t["h"] * t["d"] * t["c"]).alias("h")))

        return _with(half(s, even), lambda t: half(t, odd))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, turn, lambda s: s["h"])


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b)."""
    a, b, x = (c.cast("double") for c in (a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p = F.struct(
        F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"), F.when(swap, 1 - x).otherwise(x).alias("x"), swap.alias("swap")
    )

    def value(p: Column) -> Column:
        front = F.exp(ln_gamma(p["a"] + p["b"]) - ln_gamma(p["a"]) - ln_gamma(p["b"]) + p["a"] * F.ln(p["x"]) + p["b"] * F.ln(1 - p["x"]))
        part = front * _fraction(p) / p["a"]
        return F.when(p["swap"], 1 - part).otherwise(part)

    inner = _with(p, value)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x.isNotNull() & (a > 0) & (b > 0), inner)


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(F > f) with df1 and df2 degrees of freedom; 1 for f of 0 and less."""
    f, d1, d2 = (c.cast("double") for c in (f, df1, df2))
    return F.when(f <= 0, 1.0).otherwise(beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))


def t_tails(t: Column, df: Column) -> Column:
    """P(|T| > |t|) with df degrees of freedom."""
    return beta_inc(df.cast("double") / 2, F.lit(0.5), df / (df + t * t))


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile, to a relative error of 1.2e-9; NULL outside 0 to 1."""

    def centre(q: Column) -> Column:
        r = q * q
        return q * _horner(CENTRE[0], r) / _horner(CENTRE[1], r)

    def tail(q: Column) -> Column:
        return _horner(TAIL[0], q) / _horner(TAIL[1], q)

    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < TAIL_FROM, tail(low))
        .when(p > 1 - TAIL_FROM, -tail(high))
        .otherwise(centre(p - 0.5))
    )
