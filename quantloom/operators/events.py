"""Returns around factor events, on the session axis of the returns.

Wealth is kept at the sessions that have a return, and nowhere else. Returns and events are
dealt by asset once; there, events are multiplied by their offsets and each takes the latest
wealth at or before its session. No grid of assets and sessions is made and no path is
gathered: what is shuffled is returns and events, what is sorted is returns and offsets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.errors import FactorError
from quantloom.functions.frames import as_count, check_keys, require, same_dates, sessions_of, validate_factor_data
from quantloom.functions.ordering import in_order
from quantloom.functions.stats import finite


@dataclass(frozen=True)
class EventWindow:
    """frame: means by quantile and offset; coverage: counters, overall (scope 'overall') and by offset."""

    frame: DataFrame
    coverage: DataFrame


def _checked(factor_data: DataFrame, returns: DataFrame, grouped: bool, quantile: bool, check: bool) -> None:
    require(factor_data, date=object, asset=object, factor=object, **({"factor_quantile": object} if quantile else {}), **({"group": object} if grouped else {}))
    require(returns, date=object, asset=object, **{"return": object})
    same_dates(factor_data, returns)
    if check:
        validate_factor_data(factor_data, group=grouped, returns=False)
        check_keys(returns, ["date", "asset"])


def event_window(factor_data: DataFrame, returns: DataFrame, periods_before: int = 10, periods_after: int = 15, demeaned: bool = True, group_adjust: bool = False, by_group: bool = False, check: bool = True) -> EventWindow:
    """Wealth rebased to each event's session, averaged by date and quantile, then over dates."""
    as_count(periods_before, "periods_before"), as_count(periods_after, "periods_after")
    grouped = group_adjust or by_group
    _checked(factor_data, returns, grouped, True, check)
    axis = sessions_of(returns)
    group = ["group"] if grouped else []
    is_event = F.coalesce(F.col("factor_quantile") > 0, F.lit(False))
    rows = factor_data.select("date", "asset", *group, "factor_quantile", is_event.alias("event")).join(axis, "date", "left")
    inside = rows.where("idx is not null")
    dates = inside.where("event").select("date").distinct()
    members = inside.join(dates, "date", "left_semi") if demeaned or group_adjust else inside.where("event")
    if check and members.isEmpty():
        raise FactorError("no event has a session")
    known = _finite_returns(returns).join(axis, "date").select("asset", "idx", (1 + F.col("r")).alias("x"))
    asked = members.select("asset", "idx", F.struct("date", *group, "factor_quantile", "event").alias("mark"))
    each = _paths(known, asked, axis, periods_before, periods_after)
    value = F.coalesce(F.col("found.w"), F.lit(1.0)) / F.col("w") - 1
    each = each.select("mark.*", "offset", value.alias("v"), F.coalesce(F.col("found.t") != F.col("t"), F.lit(True)).cast("long").alias("missing"))
    # One aggregation of all paths; the universe's means and the events' are sums of its few rows.
    parts = each.groupBy("date", *group, "factor_quantile", "event", "offset").agg(F.sum("v").alias("v"), F.count("*").alias("n"), F.sum("missing").alias("missing"))
    zero = F.lit(0).cast("long")
    parts = parts.withColumns({"m": F.lit(0.0), "extra": zero, "all_extra": zero})
    if group_adjust:
        everyone = Window.partitionBy("date", "group", "offset")
        # What a group's universe lacks counts once for each event that is measured against it.
        parts = parts.withColumns({"m": F.sum("v").over(everyone) / F.sum("n").over(everyone), "extra": F.sum("missing").over(everyone)})
    elif demeaned:
        everyone = Window.partitionBy("date", "offset")
        parts = parts.withColumns({"m": F.sum("v").over(everyone) / F.sum("n").over(everyone), "all_extra": F.sum("missing").over(everyone)})
    keys = ["factor_quantile", *(["group"] if by_group else [])]
    moved = F.sum(F.col("v") - F.col("n") * F.col("m")) / F.sum("n")
    paths = parts.where("event").groupBy("date", *keys, "offset").agg(moved.alias("v"), F.sum("n").alias("used"), (F.sum(F.col("missing") + F.col("n") * F.col("extra")) + F.max("all_extra")).alias("missing"))
    frame = paths.groupBy(*keys, "offset").agg(F.avg("v").alias("mean_cumulative_return"), F.stddev_samp("v").alias("std_cumulative_return"), F.count("*").alias("count"))
    return EventWindow(frame.select(*keys, "offset", "mean_cumulative_return", "std_cumulative_return", "count"), _coverage(rows, members, known, axis, paths, periods_before, periods_after))


def _finite_returns(returns: DataFrame) -> DataFrame:
    return returns.select("date", "asset", finite(F.col("return")).alias("r")).where("r is not null")


def _offsets(last: Column, before: int, after: int) -> Column:
    """The offsets of a row's window that lie on the axis of sessions 0 to last."""
    lo, hi = F.greatest(F.lit(-before).cast("long"), -F.col("idx").cast("long")), F.least(F.lit(after).cast("long"), (last - F.col("idx")).cast("long"))
    return F.sequence(lo.cast("int"), hi.cast("int"))


def _paths(known: DataFrame, asked: DataFrame, axis: DataFrame, before: int, after: int) -> DataFrame:
    """asset, mark, w, offset, t, found: for each row of asked (asset, idx, mark) and each session t = idx + offset of the axis.

    w is the product of the asset's known values (asset, idx, x) up to idx; found is (t, w) at
    the latest known session up to t. Both windows lie on one deal by asset.
    """
    last = axis.select(F.max("idx")).scalar()
    kind = asked.schema["mark"].dataType
    both = known.select("asset", "idx", "x", F.lit(None).cast(kind).alias("mark")).unionByName(asked.select("asset", "idx", F.lit(None).cast("double").alias("x"), "mark"))
    own = Window.partitionBy("asset")
    w = F.coalesce(F.product("x").over(own.orderBy("idx").rangeBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    offsets = _offsets(last, before, after)
    spread = both.withColumn("w", w).withColumn("offset", F.explode(F.when(F.col("mark").isNull(), F.array(F.lit(0))).otherwise(offsets))).withColumn("t", F.col("idx") + F.col("offset"))
    found = F.last(F.when(F.col("mark").isNull(), F.struct("t", "w")), ignorenulls=True).over(own.orderBy("t").rangeBetween(Window.unboundedPreceding, 0))
    return spread.withColumn("found", found).where("mark is not null").select("asset", "mark", "w", "offset", "t", "found")


def _coverage(rows: DataFrame, members: DataFrame, known: DataFrame, axis: DataFrame, paths: DataFrame, before: int, after: int) -> DataFrame:
    zero = F.lit(0).cast("long")
    total = rows.agg(F.count_if("event").alias("input_events"), F.count_if(F.col("event") & F.col("idx").isNull()).alias("skipped_missing_date"))
    # Cells of the members' assets without a return: all of them less those with one.
    assets = members.select("asset").distinct()
    cells = assets.agg(F.count("*").alias("assets")).join(axis.agg(F.count("*").alias("sessions"))).join(known.join(assets, "asset", "left_semi").agg(F.count("*").alias("known")))
    filled = cells.select((F.col("assets") * F.col("sessions") - F.col("known")).alias("imputed_return_cells"))
    overall = total.join(filled).select(
        F.lit("overall").alias("scope"), F.lit(None).cast("int").alias("offset"), "input_events", (F.col("input_events") - F.col("skipped_missing_date")).alias("used_events"), "skipped_missing_date", "imputed_return_cells", zero.alias("path_count")
    )
    by = paths.groupBy("offset").agg(F.sum("used").alias("used_events"), F.sum("missing").alias("imputed_return_cells"), F.count("*").alias("path_count"))
    offsets = rows.sparkSession.range(-before, after + 1).select(F.col("id").cast("int").alias("offset"))
    each = offsets.join(by, "offset", "left").join(total).select(
        F.lit("offset").alias("scope"), "offset", "input_events", F.coalesce("used_events", zero).alias("used_events"), "skipped_missing_date", F.coalesce("imputed_return_cells", zero).alias("imputed_return_cells"), F.coalesce("path_count", zero).alias("path_count")
    )
    return overall.unionByName(each)


@in_order()
def average_cumulative_return_by_quantile(factor_data: DataFrame, returns: DataFrame, periods_before: int = 10, periods_after: int = 15, demeaned: bool = True, group_adjust: bool = False, by_group: bool = False, check: bool = True) -> DataFrame:
    """factor_quantile, [group], offset, mean_cumulative_return, std_cumulative_return, count."""
    return event_window(factor_data, returns, periods_before, periods_after, demeaned, group_adjust, by_group, check).frame


def _aligned(rows: DataFrame, returns: DataFrame, before: int, after: int, cumulative: bool) -> DataFrame:
    """date, [factor_quantile], offset, v: values of each event's asset around its session; missing ones are left out."""
    axis = sessions_of(returns)
    if cumulative:
        known = _finite_returns(returns).select("date", "asset", F.col("r").alias("v"))
    else:
        # Compounded returns stand at every row of the returns, at those without a number, too.
        grown = F.product(1 + F.coalesce(finite(F.col("return")), F.lit(0.0))).over(Window.partitionBy("asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
        known = returns.select("date", "asset", grown.alias("v"))
    known = known.join(axis, "date").select("asset", "idx", "v")
    last = axis.select(F.max("idx")).scalar()
    offsets = _offsets(last, before, after)
    asked = rows.join(axis, "date").withColumn("offset", F.explode(offsets)).withColumn("idx", F.col("idx") + F.col("offset"))
    return asked.join(known, ["asset", "idx"]).select(*rows.drop("asset").columns, "offset", "v")


def _summed(values: DataFrame, keys: Sequence[str], by_date: bool, demeaned: bool) -> DataFrame:
    if demeaned:
        values = values.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("date", "offset")))
    if by_date:
        values = values.groupBy("date", *keys, "offset").agg(F.avg("v").alias("v"))
    return values.groupBy(*keys, "offset").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("v").alias("count"))


@in_order()
def common_start_returns(factor_data: DataFrame, returns: DataFrame, periods_before: int, periods_after: int, cumulative: bool = False, mean_by_date: bool = False, demeaned: bool = False, check: bool = True) -> DataFrame:
    """offset, mean, std, count of values aligned on the sessions of factor rows; returns are compounded by asset unless cumulative."""
    as_count(periods_before, "periods_before"), as_count(periods_after, "periods_after")
    _checked(factor_data, returns, False, False, check)
    rows = factor_data.where(finite(F.col("factor")).isNotNull()).select("date", "asset")
    return _summed(_aligned(rows, returns, periods_before, periods_after, cumulative), [], mean_by_date, demeaned)


@in_order()
def average_cumulative_return_by_quantile_from_prices(factor_data: DataFrame, returns: DataFrame, periods_before: int = 10, periods_after: int = 15, demeaned: bool = True, group_adjust: bool = False, by_group: bool = False, check: bool = True) -> DataFrame:
    """As average_cumulative_return_by_quantile(), with values taken as they are and demeaned by the whole universe."""
    if group_adjust or by_group:
        raise FactorError("groups aren't supported here")
    as_count(periods_before, "periods_before"), as_count(periods_after, "periods_after")
    _checked(factor_data, returns, False, True, check)
    rows = factor_data.where(finite(F.col("factor")).isNotNull() & (F.col("factor_quantile") > 0)).select("date", "asset", "factor_quantile")
    out = _summed(_aligned(rows, returns, periods_before, periods_after, True), ["factor_quantile"], True, demeaned)
    return out.select("factor_quantile", "offset", F.col("mean").alias("mean_cumulative_return"), F.col("std").alias("std_cumulative_return"), "count")
