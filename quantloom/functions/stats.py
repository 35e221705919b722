"""Statistics as columns: missing values are skipped, and what can't be computed is null."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.ranks import with_average_rank


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def std_error(x: Column) -> Column:
    return F.stddev_samp(x) / F.sqrt(F.nullif(F.count(x).cast("double"), F.lit(0.0)))


def average_rank(keys: Sequence[str], x: str) -> Column:
    """Rank with ties averaged, by one sort: the peers of a row are its own range frame."""
    order = Window.partitionBy(*keys).orderBy(x)
    peers = order.rangeBetween(Window.currentRow, Window.currentRow)
    return F.rank().over(order) + (F.count("*").over(peers) - 1) / 2


def pearson(x: Column, y: Column) -> Column:
    """Correlation of paired values; null under two pairs or without variance, never outside [-1, 1]."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    c = F.covar_pop(a, b) / F.nullif(F.sqrt(F.var_pop(a) * F.var_pop(b)), F.lit(0.0))
    return F.when(F.count(a) < 2, None).when(c > 1, 1.0).when(c < -1, -1.0).otherwise(c)


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str, most: int = 0) -> DataFrame:
    """Rank correlation by keys; pairs with a missing side are dropped before ranking, keys with none left stay.

    most: rows of the largest cross-section where that is too large for one task (ranks.crowd()).
    """
    whole = df.withColumns({"_x": F.when(F.col(y).isNotNull(), F.col(x)), "_y": F.when(F.col(x).isNotNull(), F.col(y))})
    if most:
        ranked = with_average_rank(with_average_rank(whole, keys, "_x", "_rx", most), keys, "_y", "_ry", most)
        return ranked.groupBy(*keys).agg(pearson(F.col("_rx"), F.col("_ry")).alias(name))
    paired = F.col("_x").isNotNull()
    ranked = whole.withColumn("_p", paired)
    by = [*keys, "_p"]
    ranked = ranked.withColumns({"_rx": F.when(paired, average_rank(by, "_x")), "_ry": F.when(paired, average_rank(by, "_y"))})
    return ranked.groupBy(*keys).agg(pearson(F.col("_rx"), F.col("_ry")).alias(name))


def ols(y: Column, x: Column) -> tuple[Column, Column, Column]:
    """(alpha, beta, count) of y on x over pairs; null where x doesn't vary."""
    return F.regr_intercept(y, x), F.regr_slope(y, x), F.regr_count(y, x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also inside lambdas of body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def student_t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) with df degrees of freedom: the regularized incomplete beta function of df / (df + t^2) at (df / 2, 1/2)."""
    half, square = df.cast("double") / 2, t * t
    sides = F.struct(half.alias("a"), (df / (df + square)).alias("x"), (square / (df + square)).alias("y"))

    def p(s: Column) -> Column:
        a, x, y = s["a"], s["x"], s["y"]
        front = F.exp(a * F.log(x) + F.log(y) / 2) * gamma_ratio(a) / math.sqrt(math.pi)
        # The fraction converges fast on one side of the mean: the other is what is left of 1.
        near = 1 - front / 0.5 * beta_fraction(F.lit(0.5), a, y, a)
        return F.when(square == 0, 1.0).when(x > (a + 1) / (a + 2.5), near).otherwise(front / a * beta_fraction(a, F.lit(0.5), x, a))

    return let(sides, p)


#: Steps by which the argument of gamma_ratio() is raised, until the series below has the precision of a double.
RAISED = 64


def gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a), by its asymptotic series at a + RAISED."""
    z = a + RAISED
    series = 1 - 1 / (8 * z) + 1 / (128 * z**2) + 5 / (1024 * z**3) - 21 / (32768 * z**4) - 399 / (262144 * z**5)
    return F.sqrt(z) * series * F.aggregate(F.sequence(F.lit(0), F.lit(RAISED - 1)), F.lit(1.0), lambda acc, i: acc * (a + i) / (a + i + 0.5))


def beta_fraction(p: Column, q: Column, x: Column, size: Column) -> Column:
    """The continued fraction of the incomplete beta function at (p, q), by Lentz; it takes steps like the root of `size`, the larger of them."""
    start = 1 / (1 - (p + q) * x / (p + 1))

    def step(s: Column, m: Column) -> Column:
        even = m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))
        first = F.struct((1 / (1 + even * s["d"])).alias("d"), (1 + even / s["c"]).alias("c"), odd.alias("k"))
        both = lambda f: F.struct((1 + f["k"] / f["c"]).alias("c"), (1 / (1 + f["k"] * f["d"])).alias("d"), (s["o"] * f["c"] * f["d"]).alias("o"))
        return let(first, lambda f: let(both(f), lambda g: F.struct(g["c"].alias("c"), g["d"].alias("d"), (g["o"] * g["c"] * g["d"]).alias("o"))))

    steps = F.sequence(F.lit(1), (100 + F.ceil(5 * F.sqrt(size))).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(1.0).alias("c"), start.alias("d"), start.alias("o")), lambda s, m: step(s, m.cast("double")), lambda s: s["o"])


def t_test(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """mean, std, t_stat, count, skew and excess_kurtosis by keys (one-sample test of mean 0; biased moments)."""
    c = F.col(x)
    n, sd = F.count(c), F.stddev_samp(c)
    return df.groupBy(*keys).agg(
        F.avg(c).alias("mean"),
        sd.alias("std"),
        F.when(n > 1, F.avg(c) / F.nullif(sd / F.sqrt(n.cast("double")), F.lit(0.0))).alias("t_stat"),
        F.when(n > 1, F.when(F.var_pop(c) > 0, F.skewness(c))).alias("skew"),
        F.when(n > 1, F.when(F.var_pop(c) > 0, F.kurtosis(c))).alias("excess_kurtosis"),
        n.alias("count"),
    )


def with_p_value(df: DataFrame, t: str = "t_stat", n: str = "count", name: str = "p_value") -> DataFrame:
    """Two-sided p of a t-statistic with n - 1 degrees of freedom."""
    return df.withColumn(name, F.when(F.col(t).isNotNull() & (F.col(n) > 1), student_t_two_sided(F.col(t), F.col(n) - 1)))


#: Coefficients of algorithm AS241 (Wichura, 1988), numerator and denominator by region, highest power first.
NORMAL_CENTRE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
NORMAL_SIDE = (
    (7.7454501427834140764e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.4759380849953449460e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
)
NORMAL_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def _fraction(parts: tuple[tuple[float, ...], tuple[float, ...]], r: Column) -> Column:
    top, bottom = (reduce(lambda acc, c: acc * r + c, own[1:], F.lit(own[0])) for own in parts)
    return top / bottom


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of p in (0, 1), by rational approximations with the precision of a double."""

    def at(x: Column) -> Column:
        q = x - 0.5
        centre = q * _fraction(NORMAL_CENTRE, 0.180625 - q * q)
        r = F.sqrt(-F.log(F.least(x, 1 - x)))
        outer = F.when(r <= 5, _fraction(NORMAL_SIDE, r - 1.6)).otherwise(_fraction(NORMAL_TAIL, r - 5.0))
        return F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * outer)

    return let(p, at)


def forward_rate(r: Column, period: int, base: int) -> Column:
    """A return over `period` sessions as one over `base`; null where that isn't a number."""
    grown = F.power(1 + r, F.lit(base / period))
    return finite(F.when((1 + r >= 0) | F.lit(base % period == 0), grown - 1))


def error_rate(e: Column, period: int, base: int) -> Column:
    return e / math.sqrt(period / base)
