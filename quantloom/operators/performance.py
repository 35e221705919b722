"""Performance of a factor over its cross-sections: IC, weights, returns, spreads, turnover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.errors import FactorError
from quantloom.functions.frames import as_period, melted, period_number, placed, require, sessions_of, time_bucket, validate_factor_data
from quantloom.functions.ordering import in_order, sorted_for_output
from quantloom.functions.ranks import crowd, joined_by, percentiles, with_average_rank
from quantloom.functions.stats import average_rank, finite, ols, pearson, ratio, spearman, std_error

SESSIONS_A_YEAR = 252


def _demeaned(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """long with ret less its mean by keys, without which there is none: the means are joined, so the panel isn't dealt by keys."""
    means = long.groupBy(*keys).agg(F.avg("ret").alias("_m"))
    return long.join(means, keys).withColumn("ret", F.col("ret") - F.col("_m")).drop("_m")


def demean_forward_returns(factor_data: DataFrame, grouper: Sequence[str] | None = None) -> DataFrame:
    """factor_data with every forward return less its mean by date, or by `grouper`."""
    own = Window.partitionBy(*(grouper or ["date"]))
    names = [c for c in factor_data.columns if c.startswith("forward_return_")]
    return factor_data.withColumns({c: finite(F.col(c)) - F.avg(finite(F.col(c))).over(own) for c in names})


@in_order()
def factor_information_coefficient(factor_data: DataFrame, group_adjust: bool = False, by_group: bool = False, check: bool = True) -> DataFrame:
    """date, [group], period, ic: Spearman of factor and forward return."""
    periods = validate_factor_data(factor_data, group=group_adjust or by_group, check=check)
    grouped = ["group"] if group_adjust or by_group else []
    long = melted(factor_data, periods, ["date", *grouped, "factor"])
    if group_adjust:
        long = _demeaned(long, ["date", "group", "period"])
    most = crowd(factor_data, ["date", *(["group"] if by_group else [])], check)
    return spearman(long, ["date", *(["group"] if by_group else []), "period"], "factor", "ret", "ic", most)


@in_order()
def mean_information_coefficient(factor_data: DataFrame, group_adjust: bool = False, by_group: bool = False, by_time: str | None = None, zone: str | None = None, check: bool = True) -> DataFrame:
    """[date bucket], [group], period, mean_ic, count over ICs that aren't null."""
    ic = factor_information_coefficient(factor_data, group_adjust, by_group, check).where("ic is not null")
    if by_time:
        ic = ic.withColumn("date", time_bucket(by_time, zone=zone))
    keys = [*(["date"] if by_time else []), *(["group"] if by_group else []), "period"]
    return ic.groupBy(*keys).agg(F.avg("ic").alias("mean_ic"), F.count("ic").cast("int").alias("count"))


@in_order("date", "asset")
def factor_weights(factor_data: DataFrame, demeaned: bool = True, group_adjust: bool = False, equal_weight: bool = False, check: bool = True) -> DataFrame:
    """date, asset, [group], weight: signals over their gross by date; null where that is 0. Rows without a factor go."""
    validate_factor_data(factor_data, group=group_adjust, returns=False, check=check)
    return _weights(factor_data, demeaned, group_adjust, equal_weight, crowd(factor_data, ["date"], check))


def _weights(factor_data: DataFrame, demeaned: bool, group_adjust: bool, equal_weight: bool, most: int = 0) -> DataFrame:
    group = ["group"] if "group" in factor_data.columns else []
    df = factor_data.select("date", "asset", *group, finite(F.col("factor")).alias("x")).where("x is not null")
    keys = ["date", "group"] if group_adjust else ["date"]
    if most:
        return _crowded_weights(df, keys, group, demeaned, group_adjust, equal_weight, most)
    own = Window.partitionBy(*keys)
    x = F.col("x")
    if equal_weight and not demeaned:
        signal = F.signum(x)
    elif equal_weight:
        df = df.withColumn("_mid", F.median("x").over(own))
        up, down = x > F.col("_mid"), x < F.col("_mid")
        signal = F.when(up, F.lit(0.5) / F.nullif(F.count_if(up).over(own), F.lit(0))).when(down, F.lit(-0.5) / F.nullif(F.count_if(down).over(own), F.lit(0))).otherwise(0.0)
    else:
        signal = x - F.avg("x").over(own) if demeaned else x
    df = df.withColumn("_s", signal)
    weight = ratio(F.col("_s"), F.sum(F.abs("_s")).over(own))
    df = df.withColumn("weight", weight)
    if group_adjust:
        valid = F.size(F.collect_set(F.when(F.col("weight").isNotNull(), F.col("group"))).over(Window.partitionBy("date")))
        df = df.withColumn("weight", F.col("weight") / F.nullif(valid, F.lit(0)))
    return df.select("date", "asset", *group, "weight")


def _crowded_weights(df: DataFrame, keys: Sequence[str], group: Sequence[str], demeaned: bool, group_adjust: bool, equal_weight: bool, most: int) -> DataFrame:
    """_weights() of cross-sections too large for one task: means, sides and gross are sums by keys that are joined back."""
    x = F.col("x")
    if equal_weight and not demeaned:
        df = df.withColumn("_s", F.signum(x))
    elif equal_weight:
        middle = percentiles(df, keys, "x", [0.5], most).select(*keys, F.get("_cuts", F.lit(0)).alias("_mid"))
        df = joined_by(df, middle, keys)
        up, down = x > F.col("_mid"), x < F.col("_mid")
        df = joined_by(df, df.groupBy(*keys).agg(F.count_if(up).alias("_up"), F.count_if(down).alias("_down")), keys)
        df = df.withColumn("_s", F.when(up, F.lit(0.5) / F.nullif("_up", F.lit(0))).when(down, F.lit(-0.5) / F.nullif("_down", F.lit(0))).otherwise(0.0))
    elif demeaned:
        df = joined_by(df, df.groupBy(*keys).agg(F.avg("x").alias("_m")), keys).withColumn("_s", x - F.col("_m"))
    else:
        df = df.withColumn("_s", x)
    df = joined_by(df, df.groupBy(*keys).agg(F.sum(F.abs("_s")).alias("_gross")), keys).withColumn("weight", ratio(F.col("_s"), F.col("_gross")))
    if group_adjust:
        valid = df.where("weight is not null").groupBy("date").agg(F.count_distinct("group").alias("_valid"))
        df = joined_by(df, valid, ["date"]).withColumn("weight", F.col("weight") / F.nullif("_valid", F.lit(0)))
    return df.select("date", "asset", *group, "weight")


@in_order()
def factor_returns(factor_data: DataFrame, demeaned: bool = True, group_adjust: bool = False, equal_weight: bool = False, by_asset: bool = False, check: bool = True) -> DataFrame:
    """date, period, factor_return; or date, asset, period, weighted_return."""
    periods = validate_factor_data(factor_data, group=group_adjust, check=check)
    names = [f"forward_return_{p}D" for p in periods]
    # Weights keep the rows they came from: returns ride along in the same window, no join.
    weights = _with_weights(factor_data, names, demeaned, group_adjust, equal_weight, crowd(factor_data, ["date"], check))
    long = melted(weights, periods, ["date", "asset", "weight"])
    paired = F.col("weight") * F.col("ret")
    if by_asset:
        return long.select("date", "asset", "period", paired.alias("weighted_return"))
    return long.groupBy("date", "period").agg(F.sum(paired).alias("factor_return"))


def _with_weights(factor_data: DataFrame, carry: Sequence[str], demeaned: bool, group_adjust: bool, equal_weight: bool, most: int = 0) -> DataFrame:
    packed = factor_data.select("date", F.col("asset").alias("_asset"), *(["group"] if group_adjust else []), "factor", F.struct("asset", *carry).alias("asset"))
    out = _weights(packed, demeaned, group_adjust, equal_weight, most)
    return out.select("date", "asset.*", "weight")


@in_order()
def factor_alpha_beta(factor_data: DataFrame, returns: DataFrame | None = None, demeaned: bool = True, group_adjust: bool = False, equal_weight: bool = False, check: bool = True) -> DataFrame:
    """period, alpha, annualized_alpha, beta, count: factor returns (or `returns`) regressed on the mean return of the universe."""
    periods = validate_factor_data(factor_data, check=check)
    if returns is None:
        returns = factor_returns(factor_data, demeaned, group_adjust, equal_weight, check=check)
    else:
        require(returns, date=object, period=object, factor_return=object)
    universe = melted(factor_data, periods, ["date"]).groupBy("date", "period").agg(F.avg("ret").alias("x"))
    both = returns.select("date", "period", finite(F.col("factor_return")).alias("y")).join(universe, ["date", "period"])
    alpha, beta, n = ols(F.col("y"), F.col("x"))
    fitted = both.groupBy("period").agg(alpha.alias("alpha"), beta.alias("beta"), n.cast("int").alias("count"))
    yearly = F.when(F.col("alpha") > -1, F.power(1 + F.col("alpha"), F.lit(float(SESSIONS_A_YEAR)) / period_number()) - 1)
    return fitted.select("period", "alpha", yearly.alias("annualized_alpha"), "beta", "count")


@in_order()
def mean_return_by_quantile(factor_data: DataFrame, by_date: bool = False, by_group: bool = False, demeaned: bool = True, group_adjust: bool = False, check: bool = True) -> DataFrame:
    """factor_quantile, [date], [group], period, mean_return, std_error, count. Without by_date every date weighs the same."""
    periods = validate_factor_data(factor_data, quantile=True, group=by_group or group_adjust, check=check)
    grouped = ["group"] if by_group or group_adjust else []
    long = melted(factor_data, periods, ["date", *grouped, "factor_quantile"])
    keys = [*(["group"] if by_group else []), "factor_quantile", "period"]
    if group_adjust:
        long = _demeaned(long, ["date", "group", "period"])
    daily = _summary(long, ["date", *keys], "ret")
    if demeaned and not group_adjust:
        # A shift by date moves the means and nothing else: the panel itself is aggregated once.
        own = Window.partitionBy("date", "period")
        mean = F.sum(F.col("mean_return") * F.col("count")).over(own) / F.nullif(F.sum("count").over(own), F.lit(0))
        daily = daily.withColumn("mean_return", F.col("mean_return") - mean)
    return daily if by_date else over_dates(daily)


def over_dates(daily: DataFrame) -> DataFrame:
    """mean_return_by_quantile() of its means by date: every date weighs the same."""
    return _summary(daily, [k for k in ("group", "factor_quantile", "period") if k in daily.columns], "mean_return")


def _summary(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    c = F.col(x)
    out = df.groupBy(*keys).agg(F.avg(c).alias("mean"), std_error(c).alias("std_error"), F.count(c).cast("int").alias("count"))
    order = [k for k in ("factor_quantile", "date", "group", "period") if k in keys]
    return out.select(*order, F.col("mean").alias("mean_return"), "std_error", "count")


@in_order()
def compute_mean_returns_spread(mean_returns: DataFrame, upper_quant: int, lower_quant: int, std_err: DataFrame | None = None) -> DataFrame:
    """[date], [group], period, mean_return_difference, joint_std_error of two quantiles; a key that lacks one is an error."""
    keys = [k for k in ("date", "group", "period") if k in mean_returns.columns]

    def sides(df: DataFrame, value: str) -> DataFrame:
        pick = lambda q: F.max(F.when(F.col("factor_quantile") == q, F.struct(F.col(value).alias("v"))))
        return df.where(F.col("factor_quantile").isin(upper_quant, lower_quant)).groupBy(*keys).agg(pick(upper_quant).alias("u"), pick(lower_quant).alias("l"))

    both = F.col("u").isNotNull() & F.col("l").isNotNull()
    needed = F.when(both, F.col("u.v")).otherwise(F.raise_error(F.lit("both quantiles must be there for every key")).cast("double"))
    out = sides(mean_returns, "mean_return").select(*keys, (needed - F.col("l.v")).alias("mean_return_difference"))
    errors = std_err if std_err is not None else mean_returns if "std_error" in mean_returns.columns else None
    if errors is None:
        return out.withColumn("joint_std_error", F.lit(None).cast("double"))
    joint = sides(errors, "std_error").select(*keys, F.sqrt(F.col("u.v") ** 2 + F.col("l.v") ** 2).alias("joint_std_error"))
    return out.join(joint, keys, "left")


@in_order()
def quantile_turnover(quantile_factor: DataFrame, quantile: int, period: int = 1) -> DataFrame:
    """date, factor_quantile, period, turnover: share of today's members that weren't there `period` dates ago."""
    lag = as_period(period)
    here = F.col("factor_quantile") == quantile
    before = F.max(F.when(here, 1)).over(Window.partitionBy("asset").orderBy("idx").rangeBetween(-lag, -lag))
    new = F.when(here, before.isNull().cast("int"))
    by = placed(quantile_factor).select("date", "idx", "asset", "factor_quantile").withColumn("new", new).groupBy("date", "idx").agg(F.avg("new").alias("share"))
    return by.select("date", F.lit(quantile).cast("int").alias("factor_quantile"), F.lit(f"{lag}D").alias("period"), F.when(F.col("idx") >= lag, F.col("share")).alias("turnover"))


@in_order()
def factor_rank_autocorrelation(factor_data: DataFrame, period: int = 1, check: bool = True) -> DataFrame:
    """date, period, autocorrelation of the ranks of each whole cross-section with those `period` dates ago, over common assets."""
    return rank_autocorrelations(factor_data, [period], check)


@in_order()
def rank_autocorrelations(factor_data: DataFrame, periods: Sequence[int], check: bool = True) -> DataFrame:
    """factor_rank_autocorrelation() for several periods: one sort by date for the ranks and one by asset serve all."""
    lags = [as_period(p) for p in periods]
    # Rows without a factor are ranked among themselves and never used: a date of such rows alone stays.
    rows = placed(factor_data).select("date", "idx", "asset", finite(F.col("factor")).alias("x")).withColumn("ok", F.col("x").isNotNull())
    most = crowd(factor_data, ["date"], check)
    ranked = with_average_rank(rows, ["date"], "x", "r", most) if most else rows.withColumn("r", F.when(F.col("ok"), average_rank(["date", "ok"], "x")))
    own = Window.partitionBy("asset").orderBy("idx")
    lagged = ranked.withColumns({f"b{k}": F.max("r").over(own.rangeBetween(-k, -k)) for k in lags})
    by = lagged.groupBy("date", "idx").agg(*[pearson(F.col("r"), F.col(f"b{k}")).alias(f"c{k}") for k in lags])
    each = F.array(*[F.struct(F.lit(f"{k}D").alias("period"), F.when(F.col("idx") >= k, F.col(f"c{k}")).alias("autocorrelation")) for k in lags])
    return by.select("date", F.explode(each).alias("x")).select("date", "x.period", "x.autocorrelation")


@in_order("date", "asset")
def backshift_returns_series(series: DataFrame, periods: int, value_column: str = "return") -> DataFrame:
    """date, asset, value with the value of session i + periods at session i of the dates that the series has.

    A frame has no order of rows, so its dates stand in ascending order. No asset column is
    needed; without one the result has none.
    """
    if isinstance(periods, bool) or periods <= 0:
        raise FactorError("periods must be positive")
    require(series, **{"date": object, value_column: object})
    dates = sessions_of(series)
    later = dates.select(F.col("date").alias("_d"), (F.col("idx") - periods).alias("idx"))
    moved = dates.join(later, "idx").select(F.col("date").alias("_to"), "_d")
    rest = [c for c in series.columns if c not in ("date", value_column)]
    return series.join(moved, F.col("date") == F.col("_d")).select(F.col("_to").alias("date"), *rest, value_column)


@in_order("date", "asset")
def prices_to_returns(prices: DataFrame) -> DataFrame:
    """date, asset, return from one price of an asset to its next."""
    last = F.lag("price").over(Window.partitionBy("asset").orderBy("date"))
    return prices.select("date", "asset", (F.col("price") / last - 1).alias("return"))
