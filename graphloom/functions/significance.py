"""Significance as column expressions: the incomplete beta function, and p-values of correlations and of mean differences.

Nothing is collected: the arguments are aggregates of any size. A null or undefined argument (too few values, no
variance) gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the continued fraction, each of which is two of its terms; it stops changing long before.
STEPS = 300
# Coefficients of Stirling's series for the logarithm of the gamma function.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for positive numbers: Stirling's series at x + 10, brought back by the recurrence."""
    z = x + 10
    series = F.lit(0.0)
    for k, c in enumerate(_STIRLING):
        series = series + F.lit(c) / F.pow(z, F.lit(2 * k + 1))
    down = F.lit(0.0)
    for k in range(10):
        down = down + F.log(x + k)
    return (z - 0.5) * F.log(z) - z + 0.5 * F.log(2 * F.pi()) + series - down


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its first terms on (Lentz's method)."""
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    first = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def turn(s: Column, m: Column) -> Column:
        m = m.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d1, c1 = 1 / safe(1 + even * s["d"]), safe(1 + even / s["c"])
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d2, c2 = 1 / safe(1 + odd * d1), safe(1 + odd / c1)
        return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d1 * c1 * d2 * c2).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, turn, lambda s: s["h"])


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b)."""
    a, b, x = a.cast("double"), b.cast("double"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double")))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    near = x < (a + 1) / (a + b + 2)
    value = F.when(near, front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(value)


def t_p_value(t: Column, df: Column) -> Column:
    """The two-sided p-value of Student's t."""
    t, df = t.cast("double"), df.cast("double")
    return F.when((df > 0) & t.isNotNull() & ~F.isnan(t), beta_share(df / 2, F.lit(0.5), df / (df + t * t)))


def pearson_p_value(r: Column, n: Column) -> Column:
    """The two-sided p-value of a correlation of n pairs; null for fewer than three."""
    r, df = r.cast("double"), (n - 2).cast("double")
    # 1 - r * r is df / (df + t * t)
    return F.when((df > 0) & r.isNotNull() & ~F.isnan(r), beta_share(df / 2, F.lit(0.5), 1 - r * r))


def welch(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> tuple[Column, Column, Column]:
    """``(t, df, p)`` of the difference of two means whose variances may differ."""
    a, b = var_a / n_a, var_b / n_b
    spread = a + b
    t = F.when(spread > 0, (mean_b - mean_a) / F.sqrt(spread))
    df = F.when(spread > 0, spread * spread / (a * a / (n_a - 1) + b * b / (n_b - 1)))
    return t, df, t_p_value(t, df)


def cronbach_alpha(items: list[str]) -> Column:
    """An aggregate: how well the items of a test agree, from their variances and that of their sum; rows with a null item are left out."""
    whole = F.lit(True)
    for c in items:
        whole = whole & F.col(c).isNotNull()
    of = lambda x: F.var_samp(F.when(whole, x))
    total = sum((F.col(c) for c in items[1:]), F.col(items[0]))
    k = len(items)
    return F.lit(k / (k - 1)) * (1 - sum((of(F.col(c)) for c in items[1:]), of(F.col(items[0]))) / of(total))
