"""Preparation: forward returns, quantile buckets, cleaning with loss accounting.

Forward returns take one shuffle by asset: factor and price rows are laid on one session
axis and every period is a range frame over the same sort. Buckets take one by date.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.errors import FactorError, MaxLossExceededError
from quantloom.functions.frames import RETURN_PREFIX, as_period, require, same_dates, sessions_of, trusted, validate_factor_frame, validate_prices
from quantloom.functions.ordering import in_order
from quantloom.functions.ranks import crowd, joined_by, percentiles, with_row_number
from quantloom.functions.stats import finite
from quantloom.functions.timeutil import duration_micros, session_label


def check_periods(periods: Sequence[int | str]) -> list[int]:
    out = sorted(as_period(p) for p in periods)
    if not out or len(set(out)) != len(out):
        raise FactorError("periods must be there and unique")
    return out


def period_labels(prices: DataFrame, periods: Sequence[int]) -> list[str]:
    """'<n>D', or the time span of the first valid session pair where sessions lie less than a day apart.

    Of an intraday calendar only the sessions up to the longest period reach the driver.
    """
    at = F.unix_micros(F.col("date").cast("timestamp"))
    ordered = prices.select(at.alias("t")).where("t is not null").distinct()
    day = F.lit(duration_micros("1D"))
    # Two sessions less than a day apart lie on one day or on two that follow each other: ends of days tell, without a sort of all.
    days = ordered.groupBy(F.floor(F.col("t") / day).alias("d")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    gap = F.lead("first").over(Window.orderBy("d")) - F.col("last")
    close = days.select(((F.col("last") > F.col("first")) | (gap < day)).alias("close")).agg(F.max("close")).first()[0]
    if not close:
        return [f"{p}D" for p in periods]
    times = [r[0] for r in ordered.orderBy("t").limit(max(periods) + 1).collect()]
    return [session_label(times, p) for p in periods]


@in_order()
def compute_forward_returns(factor: DataFrame, prices: DataFrame, periods: Sequence[int] = (1, 5, 10), filter_zscore: float | None = None, cumulative_returns: bool = True, check: bool = True, labels: Sequence[str] | None = None) -> DataFrame:
    """date, asset and a forward_return_<label> for each period: price k sessions on over the price now, minus 1.

    Labels come from the sessions of the prices unless they are given.
    """
    periods = check_periods(periods)
    require(factor, date=object, asset=object)
    same_dates(factor, prices)
    if filter_zscore is not None and not (math.isfinite(filter_zscore) and filter_zscore > 0):
        raise FactorError("filter_zscore must be finite and positive")
    if check:
        validate_factor_frame(factor)
        validate_prices(prices)
    names = [RETURN_PREFIX + x for x in (labels or period_labels(prices, periods))]
    rows = prices.select("date", "asset", "price", F.lit(False).alias("asked")).unionByName(factor.select("date", "asset", F.lit(None).cast("double").alias("price"), F.lit(True).alias("asked")))
    placed = rows.join(sessions_of(prices), "date", "left")
    axis = Window.partitionBy("asset").orderBy("idx")
    at = lambda k: F.max("price").over(axis.rangeBetween(k, k))
    spots = placed.withColumns({f"_p{k}": at(k) for k in {0, *periods, *([] if cumulative_returns else [p - 1 for p in periods])}})

    def change(p: int) -> Column:
        r = F.col(f"_p{p}") / F.col("_p0" if cumulative_returns else f"_p{p - 1}") - 1
        # A row without a session has no position on the axis.
        return F.when(F.col("idx").isNotNull(), F.round(r * 1e12) / 1e12)

    out = spots.where("asked").select("date", "asset", *[change(p).alias(n) for p, n in zip(periods, names, strict=True)])
    if filter_zscore is not None:
        own = Window.partitionBy("asset")
        near = lambda n: F.coalesce(F.abs(F.col(n) - F.avg(n).over(own)) <= filter_zscore * F.nullif(F.stddev_samp(n).over(own), F.lit(0.0)), F.lit(True))
        out = out.select("date", "asset", *[F.when(near(n), F.col(n)).alias(n) for n in names])
    return out


def _cuts(value: Column, edges: Sequence[Column | float], lowest: bool) -> Column:
    """1-based right-closed bucket of value among edges; null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        lo, hi = edges[i], edges[i + 1]
        inside = (value > lo) & (value <= hi)
        if lowest and i == 0:
            inside |= (value == lo) & (value <= hi)
        out = F.when(inside, i + 1).otherwise(out)
    return out


@in_order("date", "asset")
def quantize_factor(factor: DataFrame, quantiles: int | Sequence[float] | None = 5, bins: int | Sequence[float] | None = None, by_group: bool = False, zero_aware: bool = False, check: bool = True) -> DataFrame:
    """factor with an integer factor_quantile per date (and group); null where the factor is missing or outside the bins."""
    if (quantiles is None) == (bins is None):
        raise FactorError("give quantiles or bins, not both")
    mode = quantiles if bins is None else bins
    count = isinstance(mode, int)
    if isinstance(mode, bool) or (count and mode < 1):
        raise FactorError("quantiles and bins must be positive counts or edges")
    if not count:
        mode = [float(x) for x in mode]
        if len(mode) < 2 or any(b <= a for a, b in zip(mode, mode[1:], strict=False)) or (bins is None and not (mode[0] >= 0 and mode[-1] <= 1)):
            raise FactorError("edges must increase, and those of quantiles lie in [0, 1]")
    if zero_aware and ((not count and bins is not None) or (mode if count else len(mode) - 1) % 2):
        raise FactorError("zero-aware buckets need an even count and no explicit bins")
    if check:
        validate_factor_frame(factor)
    if by_group:
        require(factor, group=object)
    x = finite(F.col("factor"))
    n_buckets = mode if count else len(mode) - 1
    half = n_buckets // 2
    keys = ["date", *(["group"] if by_group else []), "_ok", *(["_pos"] if zero_aware else [])]
    df = factor.withColumns({"_x": x, "_ok": x.isNotNull(), "_pos": F.coalesce(x >= 0, F.lit(False))})
    own = Window.partitionBy(*keys)
    each = half if zero_aware else n_buckets
    most = crowd(factor, ["date"], check)
    ties = ["_x", *(["group"] if "group" in factor.columns else []), "asset"]
    if most:
        # Cross-sections too large for one task: ranks and percentiles by ranges, sums joined back.
        sums = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        if bins is None and count:
            df = with_row_number(df, keys, ties, "_rank", most)
        elif bins is None:
            sums = sums.join(percentiles(df, keys, "_x", mode, most), keys, "left")
        df = joined_by(df, sums, keys)
    if bins is None and count:
        rank = F.col("_rank") if most else F.row_number().over(own.orderBy(*ties)) - 1
        n = F.col("_n") if most else F.count("*").over(own)
        spread = F.floor(rank * (each - 1) / F.nullif(n - 1, F.lit(0)) + 0.5)
        bucket = F.when(n < 2, None).when(n >= each, F.least(F.floor(rank * each / n), F.lit(each - 1))).otherwise(spread) + 1
    elif bins is None:
        df = df if most else df.withColumn("_cuts", F.percentile("_x", F.array(*[F.lit(e) for e in mode])).over(own))
        bucket = _cuts(F.col("_x"), [F.get("_cuts", F.lit(i)) for i in range(len(mode))], True)
    elif count:
        lo, hi = (F.col("_lo"), F.col("_hi")) if most else (F.min("_x").over(own), F.max("_x").over(own))
        width = (hi - lo) / each
        place = F.least(F.greatest(F.ceil((F.col("_x") - lo) / F.nullif(width, F.lit(0.0))), F.lit(1)), F.lit(each))
        bucket = F.when((lo == hi) | (F.col("_x") == lo) | F.lit(each == 1), 1).otherwise(place)
    else:
        bucket = _cuts(F.col("_x"), mode, False)
    if zero_aware:
        bucket = bucket + F.when(F.col("_pos"), half).otherwise(0)
    return df.withColumn("factor_quantile", F.when(F.col("_ok"), bucket).cast("int")).drop("_x", "_ok", "_pos", "_cuts", "_n", "_lo", "_hi", "_rank")


@dataclass(frozen=True)
class LossReport:
    """Rows in and out, and how many lacked a return or a bucket; a row can lack both."""

    input_rows: int
    output_rows: int
    missing_returns: int
    missing_quantiles: int

    @property
    def total_loss(self) -> float:
        return (self.input_rows - self.output_rows) / self.input_rows if self.input_rows else 0.0


@dataclass(frozen=True)
class CleanFactorResult:
    frame: DataFrame
    loss: LossReport | None


def attach_groups(factor: DataFrame, groupby: Mapping[str, str] | DataFrame | None, labels: Mapping[str, str] | None = None) -> DataFrame:
    """factor with a group from a mapping or an (asset, group) table; an asset or label that is missing is a KeyError."""
    if groupby is None:
        return factor
    if isinstance(groupby, Mapping):
        groupby = factor.sparkSession.createDataFrame([(str(k), str(v)) for k, v in groupby.items()], "asset string, group string")
    if labels is not None:
        named = factor.sparkSession.createDataFrame([(str(k), str(v)) for k, v in labels.items()], "group string, _label string")
        groupby = groupby.join(named, "group", "left").select("asset", F.col("_label").alias("group"))
    out = factor.drop("group").join(groupby.select("asset", "group"), "asset", "left")
    missing = out.where("group is null").select("asset").first()
    if missing:
        raise KeyError(missing[0])
    return out


def get_clean_factor(factor: DataFrame, forward_returns: DataFrame, quantiles: int | Sequence[float] | None = 5, bins: int | Sequence[float] | None = None, groupby: Mapping[str, str] | DataFrame | None = None, groupby_labels: Mapping[str, str] | None = None, max_loss: float = 0.35, by_group: bool = False, zero_aware: bool = False, check: bool = True) -> CleanFactorResult:
    """Buckets and returns side by side, without rows that lack either. With check the loss is counted and held to max_loss."""
    if not 0 <= max_loss <= 1:
        raise FactorError("max_loss must lie in [0, 1]")
    factor = attach_groups(factor, groupby, groupby_labels)
    names = sorted((c for c in forward_returns.columns if c.startswith(RETURN_PREFIX)), key=lambda c: (duration_micros(c.removeprefix(RETURN_PREFIX)), c))
    if not names:
        raise FactorError("no forward return columns")
    bucketed = quantize_factor(factor, None if bins is not None else quantiles, bins, by_group, zero_aware, check)
    joined = bucketed.join(forward_returns.select("date", "asset", *[finite(F.col(c)).alias(c) for c in names]), ["date", "asset"], "left")
    no_return = F.greatest(*[F.col(c).isNull() for c in names], F.lit(False))
    no_bucket = F.col("factor_quantile").isNull()
    out = joined.where(~no_return & ~no_bucket).select("date", "asset", "factor", *(["group"] if "group" in factor.columns else []), "factor_quantile", *names)
    loss = None
    if check:
        got = joined.agg(F.count("*"), F.count_if(~no_return & ~no_bucket), F.count_if(no_return), F.count_if(no_bucket)).first()
        loss = LossReport(*got)
        if loss.total_loss > max_loss:
            raise MaxLossExceededError(f"max_loss ({max_loss:.1%}) exceeded: {loss.total_loss:.1%}")
        trusted(out, "keys", "quantile")
    return CleanFactorResult(out, loss)


def get_clean_factor_and_forward_returns(factor: DataFrame, prices: DataFrame, periods: Sequence[int] = (1, 5, 10), filter_zscore: float | None = 20.0, cumulative_returns: bool = True, check: bool = True, **options) -> CleanFactorResult:
    returns = compute_forward_returns(factor, prices, periods, filter_zscore, cumulative_returns, check)
    return get_clean_factor(factor, returns, check=check, **options)
