"""Running values along an axis of dates, by two levels: inside each day, and over the days before.

A window over all dates is one task. Days are few, whatever lies in them: 10^7 sessions of a
minute are some thousand days, and only the days' totals meet in one task. With one session
a day the totals are the values, and the result is that of a plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.ranks import BEFORE, joined_by


def with_day(df: DataFrame) -> DataFrame:
    """df with _day, the number of the day that its date lies in; zoned dates by UTC."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    micros = F.unix_micros("date") if df.schema["date"].dataType.typeName() == "timestamp" else F.timestamp_diff("MICROSECOND", epoch, F.col("date").cast("timestamp_ntz"))
    return df.withColumn("_day", F.floor(micros / 86_400_000_000))


def _before(totals: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """(keys, _day, values): each value over the days before, of totals with a row for each day."""
    return totals.select(*keys, "_day", *[v.over(Window.partitionBy(*keys).orderBy("_day").rowsBetween(*BEFORE)).alias(k) for k, v in values.items()])


def ordinals(dates: DataFrame) -> DataFrame:
    """(date, idx): the distinct dates and their ordinals."""
    rows = with_day(dates.select("date").distinct())
    inside = F.row_number().over(Window.partitionBy("_day").orderBy("date")) - 1
    before = _before(rows.groupBy("_day").agg(F.count("*").alias("n")), [], {"_b": F.sum("n")})
    return joined_by(rows.withColumn("idx", inside), before, ["_day"]).select("date", (F.col("idx") + F.coalesce("_b", F.lit(0))).cast("int").alias("idx"))


def running_product(df: DataFrame, keys: Sequence[str], value: Column, name: str, own: bool = True) -> DataFrame:
    """df with the product of value by keys up to each date, itself included if own, and 1 before the first."""
    rows = with_day(df.withColumn("_x", value))
    frame = Window.partitionBy(*keys, "_day").orderBy("date").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    one = F.lit(1.0)
    before = _before(rows.groupBy(*keys, "_day").agg(F.product("_x").alias("p")), keys, {"_b": F.product("p")})
    out = joined_by(rows.withColumn("_in", F.coalesce(F.product("_x").over(frame), one)), before, [*keys, "_day"])
    return out.withColumn(name, F.coalesce("_b", one) * F.col("_in")).drop("_x", "_day", "_in", "_b")


def latest(df: DataFrame, value: str, name: str, own: bool = True) -> DataFrame:
    """df with the latest value that isn't null at or before each date (before it, unless own); null before the first."""
    rows = with_day(df)
    frame = Window.partitionBy("_day").orderBy("date").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    ends = rows.where(F.col(value).isNotNull()).groupBy("_day").agg(F.max_by(value, "date").alias("v"))
    days = joined_by(rows.select("_day").distinct(), ends, ["_day"])
    before = _before(days, [], {"_b": F.last("v", ignorenulls=True)})
    out = joined_by(rows.withColumn("_in", F.last(value, ignorenulls=True).over(frame)), before, ["_day"])
    return out.withColumn(name, F.coalesce("_in", "_b")).drop("_day", "_in", "_b")
