"""Tables of the reports, each one DataFrame; they are small, whatever the panel's size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.frames import forward_periods, sessions_of
from quantloom.functions.stats import error_rate, finite, forward_rate, normal_quantile, t_test, with_p_value
from quantloom.operators import performance as perf


def quantile_statistics(factor_data: DataFrame) -> DataFrame:
    """factor_quantile, min, max, mean, std, count, count_percent of the factor."""
    x = finite(F.col("factor"))
    by = factor_data.groupBy("factor_quantile").agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.count(x).alias("count"))
    return by.withColumn("count_percent", F.col("count") / F.nullif(F.sum("count").over(Window.partitionBy()), F.lit(0)))


def rolling_mean(ic: DataFrame, window: int = 22) -> DataFrame:
    """date, period, mean_ic over complete windows of `window` dates, and how many are there."""
    own = Window.partitionBy("period").orderBy("date").rowsBetween(1 - window, 0)
    n = F.count("ic").over(own)
    return ic.select("date", "period", F.when(n == window, F.avg("ic").over(own)).alias("mean_ic"), n.alias("count"))


def ic_histogram(ic: DataFrame, bins: int = 20) -> DataFrame:
    place = F.least(F.floor(F.round((F.col("ic") + 1) / 2 * bins, 9)), F.lit(bins - 1)).cast("int")
    return ic.where("ic is not null").groupBy("period", place.alias("bin")).agg(F.count("*").alias("count"))


def qq_normal(ic: DataFrame) -> DataFrame:
    """period, position, theoretical and observed quantiles of standardized ICs; none where they don't vary."""
    every = Window.partitionBy("period")
    place = F.row_number().over(every.orderBy("ic")) - 1
    sized = ic.where("ic is not null").select("period", place.alias("position"), "ic", F.count("*").over(every).alias("n"), F.avg("ic").over(every).alias("mean"), F.stddev_samp("ic").over(every).alias("sd"))
    at = normal_quantile((F.col("position") + 0.5) / F.col("n"))
    return sized.where("sd > 0").select("period", "position", at.alias("theoretical"), ((F.col("ic") - F.col("mean")) / F.col("sd")).alias("observed"))


def ic_summary(ic: DataFrame) -> DataFrame:
    """period, ic_mean, ic_std, risk_adjusted_ic, t_stat, p_value, skew, excess_kurtosis, count."""
    by = with_p_value(t_test(ic, ["period"], "ic"))
    risk = F.col("mean") / F.nullif("std", F.lit(0.0))
    return by.select("period", F.col("mean").alias("ic_mean"), F.col("std").alias("ic_std"), risk.alias("risk_adjusted_ic"), "t_stat", "p_value", "skew", "excess_kurtosis", "count")


def in_rates(means: DataFrame, periods: Sequence[int]) -> DataFrame:
    """Mean returns and their errors, converted to the rate of the shortest period."""
    mean, error = F.lit(None).cast("double"), F.lit(None).cast("double")
    for p in periods:
        own = F.col("period") == f"{p}D"
        mean = F.when(own, forward_rate(F.col("mean_return"), p, periods[0])).otherwise(mean)
        error = F.when(own, error_rate(F.col("std_error"), p, periods[0])).otherwise(error)
    return means.withColumns({"mean_return": mean, "std_error": error})


def mean_by_quantile(factor_data: DataFrame, demeaned: bool = True, group_adjust: bool = False, by_date: bool = False, by_group: bool = False) -> DataFrame:
    """Mean returns by quantile, converted to the rate of the shortest period."""
    return in_rates(perf.mean_return_by_quantile(factor_data, by_date, by_group, demeaned, group_adjust), forward_periods(factor_data.columns))


def raw_mean_by_quantile(factor_data: DataFrame, demeaned: bool = True, group_adjust: bool = False, by_date: bool = False, by_group: bool = False) -> DataFrame:
    """Mean returns by quantile as they are, each over its own period."""
    return perf.mean_return_by_quantile(factor_data, by_date, by_group, demeaned, group_adjust)


def returns_summary(factor_data: DataFrame, long_short: bool = True, group_neutral: bool = False, moves: DataFrame | None = None, means: DataFrame | None = None) -> DataFrame:
    """metric, period, value, count: alpha and beta, mean returns of the outer quantiles and their spread.

    moves and means: the factor's returns and mean_by_quantile(), where they are there already.
    """
    ab = perf.factor_alpha_beta(factor_data, moves, demeaned=long_short, group_adjust=group_neutral)
    fits = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(c).alias("value")) for k, c in (("alpha_raw", "alpha"), ("alpha_annualized", "annualized_alpha"), ("beta", "beta"))])
    first = ab.select("period", F.col("count").cast("long").alias("count"), F.explode(fits).alias("x")).select("x.metric", "period", "x.value", "count")
    by = means if means is not None else mean_by_quantile(factor_data, long_short, group_neutral)
    every = Window.partitionBy("period")
    outer = by.withColumns({"hi": F.max("factor_quantile").over(every), "lo": F.min("factor_quantile").over(every)})
    pick = lambda c, v: F.max(F.when(F.col("factor_quantile") == F.col(c), F.col(v)))
    sides = outer.groupBy("period").agg(pick("hi", "mean_return").alias("top"), pick("lo", "mean_return").alias("bottom"), pick("hi", "count").alias("nt"), pick("lo", "count").alias("nb"))
    means = F.array(
        F.struct(F.lit("top_quantile_mean").alias("metric"), F.col("top").alias("value"), F.col("nt").cast("long").alias("count")),
        F.struct(F.lit("bottom_quantile_mean").alias("metric"), F.col("bottom").alias("value"), F.col("nb").cast("long").alias("count")),
        F.struct(F.lit("mean_spread").alias("metric"), (F.col("top") - F.col("bottom")).alias("value"), F.least("nt", "nb").cast("long").alias("count")),
    )
    return first.unionByName(sides.select("period", F.explode(means).alias("x")).select("x.metric", "period", "x.value", "x.count"))


def daily_spread(factor_data: DataFrame, long_short: bool = True, group_neutral: bool = False, ends: Sequence[int] | None = None, daily: DataFrame | None = None) -> DataFrame:
    """date, period, difference and joint error of the outer quantiles that each date has. daily: mean_by_quantile() by date, where it is there already."""
    daily = daily if daily is not None else mean_by_quantile(factor_data, long_short, group_neutral, by_date=True)
    ends = ends or factor_data.agg(F.max("factor_quantile"), F.min("factor_quantile")).first()
    both = daily.where(F.col("factor_quantile").isin(*ends)).groupBy("date", "period").agg(F.count_distinct("factor_quantile").alias("n"))
    whole = daily.join(both.where(F.col("n") == len(set(ends))), ["date", "period"], "left_semi")
    return perf.compute_mean_returns_spread(whole, *ends)


def turnover_series(factor_data: DataFrame, lags: Sequence[int]) -> DataFrame:
    """date, factor_quantile, period, turnover for all quantiles and lags.

    One sort by asset serves every lag; the grid it is laid on has a row for each date and bucket.
    """
    dates = sessions_of(factor_data)
    own = Window.partitionBy("asset").orderBy("idx")
    placed = factor_data.where("factor_quantile is not null").select("date", "asset", "factor_quantile").join(dates, "date")
    new = {f"n{k}": F.when(F.max("factor_quantile").over(own.rangeBetween(-k, -k)).eqNullSafe(F.col("factor_quantile")), 0).otherwise(1) for k in lags}
    shares = placed.withColumns(new).groupBy("idx", "factor_quantile").agg(*[F.avg(f"n{k}").alias(f"n{k}") for k in lags])
    grid = dates.join(placed.select("factor_quantile").distinct())
    each = F.array(*[F.struct(F.lit(f"{k}D").alias("period"), F.when(F.col("idx") >= k, F.col(f"n{k}")).alias("turnover")) for k in lags])
    return grid.join(shares, ["idx", "factor_quantile"], "left").select("date", "factor_quantile", F.explode(each).alias("x")).select("date", "factor_quantile", "x.*")


def autocorrelation_series(factor_data: DataFrame, lags: Sequence[int]) -> DataFrame:
    """date, period, autocorrelation for all lags."""
    return perf.rank_autocorrelations(factor_data, lags)


def mean_turnover(series: DataFrame) -> DataFrame:
    """factor_quantile, period, turnover (mean over dates that have one), count."""
    return series.groupBy("factor_quantile", "period").agg(F.avg("turnover").alias("turnover"), F.count("turnover").alias("count"))


def mean_autocorrelation(series: DataFrame) -> DataFrame:
    """period, autocorrelation (mean over dates that have one), count."""
    return series.groupBy("period").agg(F.avg("autocorrelation").alias("autocorrelation"), F.count("autocorrelation").alias("count"))


def wealth_by_quantile(daily: DataFrame) -> DataFrame:
    """date, factor_quantile, cumulative_return of one-session means by date. A window over dates by bucket."""
    own = Window.partitionBy("factor_quantile").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.product(1 + F.coalesce("mean_return", F.lit(0.0))).over(own)
    return daily.where("period = '1D'").select("date", "factor_quantile", grown.alias("cumulative_return"))


def event_distribution(factor_data: DataFrame, bins: int = 50) -> DataFrame:
    """bin, start, end (microseconds) and count of rows by date; whole-number edges, the last bin closed, one bin for one date."""
    at = F.unix_micros(F.col("date").cast("timestamp"))
    lo, hi = factor_data.agg(F.min(at), F.max(at)).first()
    schema = "bin int, start long, end long, count long"
    if lo is None:
        return factor_data.sparkSession.createDataFrame([], schema)
    n = bins if hi > lo else 1
    edges = [lo + (hi - lo) * i // n for i in range(n + 1)]
    counted = factor_data.groupBy(at.alias("t")).agg(F.count("*").alias("c"))
    table = factor_data.sparkSession.createDataFrame([(i, edges[i], edges[i + 1], i == n - 1) for i in range(n)], "bin int, start long, end long, last boolean")
    inside = (F.col("t") >= F.col("start")) & ((F.col("t") < F.col("end")) | (F.col("last") & (F.col("t") <= F.col("end"))))
    return F.broadcast(table).join(counted, inside, "left").groupBy("bin", "start", "end").agg(F.coalesce(F.sum("c"), F.lit(0).cast("long")).alias("count"))
