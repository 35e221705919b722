"""Schemas, checks and the session axis of factor panels."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.errors import FactorError, NonMatchingTimezoneError
from quantloom.functions.stats import finite

RETURN_PREFIX = "forward_return_"
#: The largest count of sessions: 32 bits without a sign.
MAX_COUNT = (1 << 32) - 1
_DAYS = re.compile(r"forward_return_([1-9][0-9]*)D")
_DATES = (T.TimestampNTZType, T.TimestampType)


def require(df: DataFrame, **kinds: type | tuple[type, ...]) -> None:
    """Raise unless df has the columns with the types."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for name, kind in kinds.items():
        if name not in have:
            raise FactorError(f"missing column: {name}")
        if not isinstance(have[name], kind):
            raise FactorError(f"column {name} has type {have[name].simpleString()}")


def check_keys(df: DataFrame, keys: Sequence[str], also: Column | None = None, message: str = "") -> None:
    """Raise on a null or duplicate key, or a row where `also` holds. One aggregation that leaves one row by key and task."""
    bad_key = None
    for k in keys:
        bad_key = F.col(k).isNull() if bad_key is None else bad_key | F.col(k).isNull()
    bad = F.coalesce(also, F.lit(False)) if also is not None else F.lit(False)
    per = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(bad).alias("bad"))
    got = per.agg(F.max(bad_key).alias("null_key"), F.max("n").alias("n"), F.max("bad").alias("bad")).first()
    if got["null_key"]:
        raise FactorError("keys must not be null")
    if (got["n"] or 0) > 1:
        raise FactorError("duplicate key")
    if got["bad"]:
        raise FactorError(message)


def validate_factor_frame(df: DataFrame, check: bool = True) -> DataFrame:
    """date, asset, factor and maybe group of the right types; keys not null and unique. Sorted by key."""
    require(df, date=_DATES, asset=T.StringType, factor=T.DoubleType)
    if "group" in df.columns:
        require(df, group=T.StringType)
    if check:
        check_keys(df, ["date", "asset"])
    return df.orderBy("date", "asset")


def validate_prices(df: DataFrame, check: bool = True) -> DataFrame:
    require(df, date=_DATES, asset=T.StringType, price=T.DoubleType)
    if check:
        p = F.col("price")
        check_keys(df, ["date", "asset"], p.isNotNull() & (F.isnan(p) | (F.abs(p) == float("inf")) | (p <= 0)), "prices must be finite and positive")
    return df


def same_dates(a: DataFrame, b: DataFrame) -> None:
    """Raise unless both date columns are of one kind (zoned or not), and name one zone where their metadata has a "timezone"."""
    zones = {d.schema["date"].metadata.get("timezone") for d in (a, b)} - {None}
    if a.schema["date"].dataType != b.schema["date"].dataType or len(zones) > 1:
        raise NonMatchingTimezoneError("factor and price dates must be of the same kind")


def forward_periods(columns: Iterable[str]) -> list[int]:
    """The periods of forward_return_<n>D columns in ascending order; any other such suffix is an error."""
    out = []
    for c in columns:
        if c.startswith(RETURN_PREFIX):
            m = _DAYS.fullmatch(c)
            if not m:
                raise FactorError(f"not a forward return in days: {c}")
            out.append(int(m[1]))
    if not out or len(set(out)) != len(out):
        raise FactorError("forward return columns must be there and unique")
    return sorted(out)


def trusted(df: DataFrame, *facts: str) -> DataFrame:
    """df, known to hold what validate_factor_data() would check: "keys", "quantile", "group" (all of them if none is named)."""
    df._quantloom_facts = getattr(df, "_quantloom_facts", frozenset()) | frozenset(facts or ("keys", "quantile", "group"))
    return df


def same_facts(df: DataFrame, out: DataFrame) -> DataFrame:
    """out, whose rows are some of those of df, known to hold what df does."""
    return trusted(out, *facts) if (facts := getattr(df, "_quantloom_facts", ())) else out


def validate_factor_data(df: DataFrame, quantile: bool = False, group: bool = False, returns: bool = True, check: bool = True) -> list[int]:
    """The periods of clean factor data; raises on a wrong schema, and with check on wrong values.

    The check of values is one aggregation. What it found holds for this very frame and
    isn't looked for again; nor is what get_clean_factor() made sure of.
    """
    require(df, date=_DATES, asset=T.StringType, factor=T.DoubleType)
    if quantile:
        require(df, factor_quantile=T.IntegerType)
    if group:
        require(df, group=T.StringType)
    periods = forward_periods(df.columns) if returns else []
    for p in periods:
        require(df, **{f"{RETURN_PREFIX}{p}D": T.DoubleType})
    asked = {"keys", *(["quantile"] if quantile else []), *(["group"] if group else [])}
    if check and not asked <= getattr(df, "_quantloom_facts", frozenset()):
        bad = F.lit(False)
        if quantile:
            bad |= F.col("factor_quantile").isNull() | (F.col("factor_quantile") <= 0)
        if group:
            bad |= F.col("group").isNull()
        check_keys(df, ["date", "asset"], bad, "group and quantile must be there for every row")
        trusted(df, *asked)
    return periods


def melted(df: DataFrame, periods: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """One row for each row and period: keep, period ('<n>D'), ret. Missing numbers are null."""
    cols = [F.col(c) if c != "factor" else finite(F.col(c)).alias(c) for c in keep]
    pairs = F.array(*[F.struct(F.lit(f"{p}D").alias("period"), finite(F.col(f"{RETURN_PREFIX}{p}D")).alias("ret")) for p in periods])
    return df.select(*cols, F.explode(pairs).alias("_m")).select(*keep, "_m.period", "_m.ret")


def period_number(c: str = "period") -> Column:
    return F.regexp_extract(c, "^([0-9]+)", 1).cast("int")


def sessions_of(df: DataFrame) -> DataFrame:
    """(date, idx): the distinct dates and their ordinals. A window over dates alone, not over rows."""
    return df.select("date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")) - 1)


def sessioned(df: DataFrame) -> DataFrame:
    """df, whose column `session` is known to be the ordinal of its date among all of its dates."""
    df._quantloom_sessions = True
    return df


def placed(df: DataFrame) -> DataFrame:
    """df with the ordinal of its date, idx: from the panel's layout where it has one, else by the list of its dates."""
    if getattr(df, "_quantloom_sessions", False):
        return df.withColumnRenamed("session", "idx")
    return df.join(sessions_of(df), "date")


def time_bucket(by: str, date: str = "date", zone: str | None = None) -> Column:
    """Day, week ending on Sunday or first of month, of the local date in `zone`."""
    at = F.col(date) if zone is None else F.from_utc_timestamp(F.col(date), zone)
    day = F.to_date(at)
    made = {"daily": day, "weekly": F.date_add(F.to_date(F.trunc(day, "week")), 6), "monthly": F.trunc(day, "month")}
    if by not in made:
        raise FactorError(f"by_time must be one of {', '.join(made)}")
    return made[by]


def as_period(value: int | str) -> int:
    """A session count from 5 or '5D'."""
    m = re.fullmatch(r"([1-9][0-9]*)D?", str(value))
    if isinstance(value, bool) or not m or int(m[1]) > MAX_COUNT:
        raise FactorError(f"not a period: {value}")
    return int(m[1])


def as_count(value: int, name: str) -> int:
    """A count of sessions from 0 to MAX_COUNT."""
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= MAX_COUNT:
        raise FactorError(f"{name} must be a whole number from 0 to {MAX_COUNT}")
    return value
