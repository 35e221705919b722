"""Wealth, overlapping positions and portfolio exports."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.errors import FactorError
from quantloom.functions.frames import MAX_COUNT, as_period, check_keys, require, same_facts, sessions_of
from quantloom.functions.ordering import in_order
from quantloom.functions.scan import latest, running_product
from quantloom.functions.stats import finite, ratio
from quantloom.operators.performance import factor_returns, factor_weights

CASH = "cash"


def _or_error(value: Column, ok: Column, message: str) -> Column:
    """value where ok holds, else an error when the row is computed."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


@in_order("period", "date")
def cumulative_returns(returns: DataFrame) -> DataFrame:
    """date, [period], cumulative_return: running product of 1 + return, missing as 0, day by day and then over days.

    Rows with a null date, a null or wrong period, a repeated key or wealth that isn't finite
    are errors when they are computed.
    """
    value = next((c for c in ("return", "factor_return") if c in returns.columns), None)
    if value is None:
        raise FactorError("a return column is needed")
    keys = ["period"] if "period" in returns.columns else []
    grown = running_product(returns.select("date", *keys, value), keys, 1 + F.coalesce(finite(F.col(value)), F.lit(0.0)), "w")
    known = F.col("date").isNotNull()
    if keys:
        number = F.regexp_extract("period", "^([1-9][0-9]{0,9})D$", 1).try_cast("bigint")
        known &= F.coalesce(number.between(1, MAX_COUNT), F.lit(False))
    again = F.count("*").over(Window.partitionBy(*keys, "date")) > 1
    out = grown.select("date", *keys, "w", known.alias("known"), again.alias("again"))
    w = _or_error(F.col("w"), F.col("known"), "dates must be there, and periods be '<n>D'")
    w = _or_error(w, ~F.col("again"), "keys of returns must be unique")
    return out.select("date", *keys, _or_error(w, finite(F.col("w")).isNotNull(), "wealth must remain finite").alias("cumulative_return"))


def filter_portfolio(factor_data: DataFrame, quantiles: Sequence[int] | None = None, groups: Sequence[str] | None = None, check: bool = True) -> DataFrame:
    """factor_data of the given quantiles and groups; applied before any weighting."""
    out = factor_data
    for name, values in (("factor_quantile", quantiles), ("group", groups)):
        if values is None:
            continue
        values = list(values)
        if not values or len(set(values)) != len(values) or any(not v if isinstance(v, int) else not str(v).strip() for v in values):
            raise FactorError(f"{name} filter must have distinct, positive or non-blank values")
        require(out, **{name: object})
        out = out.where(F.col(name).isin(values))
    if check and out is not factor_data and out.isEmpty():
        raise FactorError("no rows are left by the filter")
    return same_facts(factor_data, out)


def _one_period(returns: DataFrame, period: int) -> DataFrame:
    return returns.where(F.col("period") == f"{period}D")


def _needs_period(factor_data: DataFrame, period: int) -> None:
    if f"forward_return_{period}D" not in factor_data.columns:
        raise FactorError(f"forward_return_{period}D is missing")


@in_order("period", "date")
def factor_cumulative_returns(factor_data: DataFrame, period: int | str, long_short: bool = True, group_neutral: bool = False, equal_weight: bool = False, quantiles: Sequence[int] | None = None, groups: Sequence[str] | None = None, check: bool = True) -> DataFrame:
    """date, period, cumulative_return of the factor portfolio of one period."""
    p = as_period(period)
    _needs_period(factor_data, p)
    kept = filter_portfolio(factor_data, quantiles, groups, check)
    return cumulative_returns(_one_period(factor_returns(kept, long_short, group_neutral, equal_weight, check=check), p))


def _axis(sessions: DataFrame, check: bool) -> DataFrame:
    """(date, idx) of a frame of sessions: one column, date, without nulls or repeats."""
    if sessions.columns != ["date"]:
        raise FactorError("sessions must have the column date alone")
    if check:
        check_keys(sessions, ["date"])
    return sessions_of(sessions)


@in_order()
def positions(weights: DataFrame, period: int | str, sessions: DataFrame | None = None, check: bool = True) -> DataFrame:
    """date, asset, position on every session: sleeves live for `period` sessions, summed, over their gross, and cash.

    The grid of assets and sessions is the result itself. Weights are dealt by asset once and
    never copied: what an asset holds is a sum over the last `period` sessions. Sums that aren't
    finite are errors when they are computed.
    """
    p = as_period(period)
    require(weights, date=object, asset=object, weight=object)
    axis = sessions_of(weights) if sessions is None else _axis(sessions, check)
    if check:
        bad = F.col("weight").isNull() | finite(F.col("weight")).isNull() | (F.col("asset") == CASH)
        check_keys(weights, ["date", "asset"], bad, "weights must be finite and no asset may be named cash")
        if not weights.join(axis, "date", "left_anti").isEmpty():
            raise FactorError("every trade date must be in the sessions")
    return _positions(weights, axis, p)


def _positions(weights: DataFrame, axis: DataFrame, p: int) -> DataFrame:
    """positions() of sleeves. An asset's first row brings a row for each session, after the deal by asset."""
    last = axis.select(F.max("idx")).scalar()
    own = Window.partitionBy("asset")
    placed = weights.join(axis, "date", "left").select("asset", "idx", "weight")
    first = F.row_number().over(own.orderBy("idx")) == 1
    cells = placed.withColumn("first", first).withColumn("cell", F.explode(F.when(F.col("first"), F.sequence(F.lit(-1), last)).otherwise(F.array(F.lit(-1)))))
    cells = cells.select("asset", "cell", F.when(F.col("cell") < 0, F.col("idx")).otherwise(F.col("cell")).alias("idx"), F.when((F.col("cell") < 0) & F.col("idx").isNotNull(), F.col("weight")).alias("weight"))
    total = F.coalesce(F.sum("weight").over(own.orderBy("idx").rangeBetween(-(p - 1), 0)), F.lit(0.0))
    held = cells.withColumn("w", total).where("cell >= 0").select("idx", "asset", _or_error(F.col("w"), finite(F.col("w")).isNotNull(), "active weights must sum to finite values").alias("w"))
    by = held.groupBy("idx").agg(F.sum(F.abs("w")).alias("gross"), F.sum("w").alias("sum"))
    gross = _or_error(F.col("gross"), finite(F.col("gross")).isNotNull(), "gross exposure must remain finite")
    by = axis.join(by, "idx", "left").select("idx", "date", gross.alias("gross"), "sum")
    filled = held.join(by, "idx").select("date", "asset", F.coalesce(ratio(F.col("w"), F.col("gross")), F.lit(0.0)).alias("position"))
    cash = by.select("date", F.lit(CASH).alias("asset"), (1 - F.coalesce(ratio(F.col("sum"), F.col("gross")), F.lit(0.0))).alias("position"))
    return filled.unionByName(cash)


@in_order()
def factor_positions(factor_data: DataFrame, period: int | str, long_short: bool = True, group_neutral: bool = False, equal_weight: bool = False, quantiles: Sequence[int] | None = None, groups: Sequence[str] | None = None, sessions: DataFrame | None = None, check: bool = True) -> DataFrame:
    """Positions of the factor weights; a date without gross exposure is an error.

    Dates and assets are those of the rows with a factor, so the weights stand in the plan
    once; what is wrong with a weight shows when it is computed.
    """
    p = as_period(period)
    _needs_period(factor_data, p)
    kept = filter_portfolio(factor_data, quantiles, groups, check)
    rows = kept.where(finite(F.col("factor")).isNotNull())
    weights = factor_weights(kept, long_short, group_neutral, equal_weight, check).select("date", "asset", "weight")
    weight = _or_error(F.col("weight"), finite(F.col("weight")).isNotNull() & (F.col("asset") != CASH), "weights must be finite and no asset may be named cash")
    axis = sessions_of(rows) if sessions is None else _axis(sessions, check)
    if sessions is not None and check and not rows.select("date").distinct().join(axis, "date", "left_anti").isEmpty():
        raise FactorError("every trade date must be in the sessions")
    return _positions(weights.withColumn("weight", weight), axis, p)


@in_order()
def overlapping_daily_wealth(returns: DataFrame, period: int | str, sessions: DataFrame | None = None) -> DataFrame:
    """date, cumulative_return before each session: sleeves earn (1 + r) ** (1 / p) - 1 a session, for p sessions, and are averaged."""
    p = as_period(period)
    axis = sessions_of(returns) if sessions is None else _axis(sessions, True)
    daily = F.when(F.col("r") >= -1, F.power(1 + F.col("r"), F.lit(1.0 / p)) - 1).otherwise(F.raise_error(F.lit("a return under -1 has no daily equivalent")).cast("double"))
    sleeves = returns.select("date", finite(F.col("factor_return")).alias("r")).where("r is not null").select("date", daily.alias("d"))
    by_session = Window.orderBy("idx")
    live = axis.join(sleeves, "date", "left").withColumn("d", F.avg("d").over(by_session.rangeBetween(-(p - 1), 0)))
    return running_product(live, [], 1 + F.coalesce("d", F.lit(0.0)), "cumulative_return", own=False).select("date", "cumulative_return")


def changes(wealth: DataFrame, name: str) -> DataFrame:
    """date and the change of wealth to the previous row; 0 first."""
    last = F.col("_last")
    broken = F.raise_error(F.lit("no return after zero wealth")).cast("double")
    return latest(wealth, "cumulative_return", "_last", own=False).select("date", F.when(last.isNull(), 0.0).when(last == 0, broken).otherwise(F.col("cumulative_return") / last - 1).alias(name))


def wealth_as_of(dates: DataFrame, wealth: DataFrame) -> DataFrame:
    """(date, wealth): the latest wealth at or before each distinct date, 1 before the first."""
    both = dates.select("date").distinct().join(wealth.select("date", "cumulative_return"), "date", "full")
    return latest(both, "cumulative_return", "_last").select("date", F.coalesce("_last", F.lit(1.0)).alias("wealth"))


@dataclass(frozen=True)
class PyfolioInput:
    returns: DataFrame
    positions: DataFrame
    benchmark: DataFrame | None


def create_pyfolio_input(factor_data: DataFrame, period: int | str, capital: float | None = None, long_short: bool = True, group_neutral: bool = False, equal_weight: bool = False, quantiles: Sequence[int] | None = None, groups: Sequence[str] | None = None, benchmark_period: int | str | None = 1, sessions: DataFrame | None = None, check: bool = True) -> PyfolioInput:
    """Returns from changes of wealth, positions (times wealth and capital) and an equal-weight benchmark if its period is there."""
    if capital is not None and not (math.isfinite(capital) and capital > 0):
        raise FactorError("capital must be finite and positive")
    p = as_period(period)
    options = {"long_short": long_short, "group_neutral": group_neutral, "equal_weight": equal_weight, "quantiles": quantiles, "groups": groups, "check": check}
    if p == 1:
        wealth = factor_cumulative_returns(factor_data, p, **options).select("date", "cumulative_return")
    else:
        _needs_period(factor_data, p)
        own = factor_returns(filter_portfolio(factor_data, quantiles, groups, check), long_short, group_neutral, equal_weight, check=check)
        wealth = overlapping_daily_wealth(_one_period(own, p), p, sessions)
    held = factor_positions(factor_data, p, sessions=sessions, **options)
    if capital is not None:
        held = held.join(wealth_as_of(held, wealth), "date").select("date", "asset", (F.col("position") * F.col("wealth") * capital).alias("position"))
    benchmark = None
    if benchmark_period is not None and f"forward_return_{as_period(benchmark_period)}D" in factor_data.columns:
        benchmark = changes(factor_cumulative_returns(factor_data, benchmark_period, False, False, True, check=check), "benchmark")
    return PyfolioInput(changes(wealth, "return"), held, benchmark)
