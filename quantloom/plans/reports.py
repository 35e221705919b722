"""Tear sheets: named tables of one panel with their metadata, as lazy DataFrames, values and JSON.

Building a sheet reads only its metadata (one aggregation). Tables are computed when asked for;
collect() computes them all over one persisted copy of the panel. They are small whatever the
panel's size: rows are dates, buckets, groups and periods, never assets.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.errors import FactorError
from quantloom.functions.frames import as_period, forward_periods, validate_factor_data
from quantloom.functions.stats import finite
from quantloom.operators import events as ev
from quantloom.operators import performance as perf
from quantloom.operators.portfolio import cumulative_returns
from quantloom.plans import tables

CONTRACT = "quantloom.tear-sheet/v1"
KINDS = ("summary", "returns", "information", "turnover", "full", "event_returns", "event_study")
UNITS = ("raw", "decimal_return", "basis_points", "percent", "ratio", "count")
_ID = re.compile(r"[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)+")
_KEYS = ("date", "scope", "metric", "factor_quantile", "group", "period", "offset", "bin", "position")
_RETURNS = ("mean_return", "std_error", "mean_return_difference", "joint_std_error", "factor_return", "cumulative_return", "mean_cumulative_return", "std_cumulative_return")
_TYPES = {"boolean": T.BooleanType, "int": T.IntegerType, "bigint": T.LongType, "double": T.DoubleType, "string": T.StringType, "timestamp": T.TimestampType, "timestamp_ntz": T.TimestampNTZType}
_EPOCH = dt.datetime(1970, 1, 1)


@dataclass(frozen=True)
class Column:
    """How a column is to be read and shown; `kind` is its Spark type's name."""

    name: str
    kind: str
    role: str
    unit: str | None = None
    decimals: int = 0

    @property
    def label(self) -> str:
        return self.name.replace("_", " ").title()

    @classmethod
    def of(cls, name: str, kind: str) -> Column:
        role = "dimension" if name in _KEYS else "measure"
        if kind != "double":
            return cls(name, kind, "statistic" if name == "count" else role, "count" if kind in ("int", "bigint") else None)
        if name in _RETURNS:
            return cls(name, kind, "statistic" if "std" in name else role, "decimal_return", 6)
        return cls(name, kind, role, {"turnover": "ratio", "autocorrelation": "ratio", "count_percent": "percent"}.get(name, "raw"), 6)


class ReportTable:
    """A table with unique columns, sorted by keys that are never null. Values are fetched once, when first asked for."""

    def __init__(self, id: str, title: str, sort_by: Sequence[str], frame: DataFrame | None = None, columns: Sequence[Column] | None = None, values: dict[str, list] | None = None):
        if not _ID.fullmatch(id):
            raise FactorError(f"not a table id: {id}")
        if (frame is None) == (values is None):
            raise FactorError("a table has a frame or values")
        self.id, self.title, self.sort_by, self._frame = id, title, tuple(sort_by), frame
        self.columns = tuple(columns or [Column.of(f.name, f.dataType.simpleString()) for f in frame.schema.fields])
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names) or not set(self.sort_by) <= set(names):
            raise FactorError(f"{id}: columns must be unique and contain the sort keys")
        for c in self.columns:
            if c.kind not in _TYPES or (c.unit is not None and c.unit not in UNITS):
                raise FactorError(f"{id}: column {c.name} has an unknown type or unit")
        self._values = None if values is None else self._checked(values)

    def _checked(self, values: dict[str, list]) -> dict[str, list]:
        if list(values) != [c.name for c in self.columns] or len({len(v) for v in values.values()}) > 1:
            raise FactorError(f"{self.id}: columns must be those declared and of one length")
        for c in self.columns:
            want = {"boolean": bool, "double": (int, float), "string": str}.get(c.kind, int)
            for v in values[c.name]:
                if v is not None and (not isinstance(v, want) or (isinstance(v, bool) and c.kind != "boolean") or (c.kind == "double" and not math.isfinite(v))):
                    raise FactorError(f"{self.id}: {c.name} holds {v!r}")
        keys = list(zip(*[values[k] for k in self.sort_by], strict=True))
        # The offset of an overall row is the one key that may be missing; it comes first.
        order = [tuple((v is not None, v) for v in k) for k in keys]
        if any(v is None for k in keys for n, v in zip(self.sort_by, k, strict=True) if n != "offset") or any(a > b for a, b in zip(order, order[1:], strict=False)):
            raise FactorError(f"{self.id}: keys must not be null, and rows sorted by them")
        return values

    @property
    def values(self) -> dict[str, list]:
        """Column values in order; dates as microseconds since 1970, numbers that aren't finite as None."""
        if self._values is None:
            cols = [F.unix_micros(F.col(c.name).cast("timestamp")).alias(c.name) if c.kind.startswith("timestamp") else finite(F.col(c.name)).alias(c.name) if c.kind == "double" else F.col(c.name) for c in self.columns]
            if any(c.kind == "timestamp_ntz" for c in self.columns):
                cols = [F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), F.col(c.name)).alias(c.name) if c.kind == "timestamp_ntz" else x for c, x in zip(self.columns, cols, strict=True)]
            rows = sorted(self._frame.select(cols).collect(), key=lambda r: tuple((r[k] is not None, r[k]) for k in self.sort_by))
            self._values = self._checked({c.name: [r[c.name] for r in rows] for c in self.columns})
        return self._values

    def __len__(self) -> int:
        return len(next(iter(self.values.values())))

    def rows(self) -> list[tuple]:
        return list(zip(*self.values.values(), strict=True))

    def to_frame(self, spark: SparkSession | None = None) -> DataFrame:
        """The table as a DataFrame: the plan that makes it, or its values, once they are there or were read from JSON."""
        if self._values is None:
            return self._frame
        made = T.StructType([T.StructField(c.name, T.LongType() if c.kind.startswith("timestamp") else _TYPES[c.kind]()) for c in self.columns])
        out = (spark or SparkSession.active()).createDataFrame(self.rows(), made)
        at = {c.name: (F.timestamp_add("MICROSECOND", F.col(c.name), F.lit(_EPOCH).cast("timestamp_ntz")) if c.kind == "timestamp_ntz" else F.timestamp_micros(c.name)) for c in self.columns if c.kind.startswith("timestamp")}
        return out.withColumns(at) if at else out

    def cells(self) -> DataFrame:
        """table_id, row (from 0, in the order of the keys), column, value (numbers, and dates as microseconds), text: a row for each cell."""
        frame = self.to_frame()
        order = Window.orderBy(*[F.col(k).asc_nulls_first() for k in self.sort_by])
        cell = lambda name, value, text: F.struct(F.lit(name).alias("column"), value.cast("double").alias("value"), text.cast("string").alias("text"))
        none, made = F.lit(None), []
        for c in self.columns:
            x = F.col(c.name)
            if c.kind == "timestamp_ntz":
                x = F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), x)
            elif c.kind == "timestamp":
                x = F.unix_micros(x)
            elif c.kind == "double":
                x = finite(x)
            made.append(cell(c.name, none, x) if c.kind == "string" else cell(c.name, x, none))
        rows = frame.select((F.row_number().over(order) - 1).cast("long").alias("row"), F.array(*made).alias("x")).select("row", F.explode("x").alias("x"))
        return rows.select(F.lit(self.id).alias("table_id"), "row", "x.*")

    def metadata(self) -> dict:
        return {"id": self.id, "title": self.title, "row_count": len(self), "sort_by": list(self.sort_by), "columns": [self._described(c) for c in self.columns]}

    @staticmethod
    def _described(c: Column) -> dict:
        return {"name": c.name, "label": c.label, "type": c.kind, "role": c.role, "unit": c.unit, "decimals": c.decimals}

    def to_dict(self) -> dict:
        out = self.metadata()
        for c in out["columns"]:
            c["values"] = self.values[c["name"]]
        return out

    @classmethod
    def from_dict(cls, d: dict) -> ReportTable:
        try:
            columns = [Column(c["name"], c["type"], c["role"], c["unit"], c["decimals"]) for c in d["columns"]]
            out = cls(d["id"], d["title"], d["sort_by"], columns=columns, values={c["name"]: c["values"] for c in d["columns"]})
            if len(out) != d["row_count"]:
                raise FactorError(f"{out.id}: row count differs")
        except (KeyError, TypeError) as e:
            raise FactorError(f"not a report table: {e}") from e
        return out


@dataclass
class TearSheetData:
    """A report: metadata, options and its tables in their fixed order."""

    kind: str
    metadata: dict
    options: dict
    tables: dict[str, ReportTable]
    _source: list[DataFrame] = field(default_factory=list, repr=False)

    contract_version = CONTRACT

    def table_ids(self) -> list[str]:
        return list(self.tables)

    def table(self, id: str) -> DataFrame:
        """KeyError for a table that the report hasn't."""
        return self.tables[id].to_frame()

    def table_metadata(self, id: str) -> dict:
        return self.tables[id].metadata()

    def collect(self) -> TearSheetData:
        """Compute every table; sources, and frames that several tables come from, are persisted meanwhile unless they were before."""
        if all(t._values is not None for t in self.tables.values()):
            return self
        held = [s for s in self._source if not s.is_cached]
        for s in held:
            s.persist()
        try:
            for t in self.tables.values():
                t.values  # noqa: B018
        finally:
            for s in held:
                s.unpersist()
        return self

    def cells(self) -> DataFrame:
        """The cells of all tables as one frame, for comparisons and for stores that take rows: see ReportTable.cells()."""
        return reduce(DataFrame.unionByName, [t.cells() for t in self.tables.values()])

    def to_json(self, pretty: bool = False) -> str:
        """Deterministic: the same tables give the same text."""
        self.collect()
        body = {"metadata": {"contract_version": CONTRACT, "report_kind": self.kind, **self.metadata}, "options": self.options, "tables": [t.to_dict() for t in self.tables.values()]}
        return json.dumps(body, ensure_ascii=False, allow_nan=False, **({"indent": 2} if pretty else {"separators": (",", ":")}))

    @classmethod
    def from_json(cls, text: str) -> TearSheetData:
        """Raises on another version, an unknown kind, tables out of order or values against a table's contract."""
        try:
            body = json.loads(text)
            meta = dict(body["metadata"])
            version, kind = meta.pop("contract_version"), meta.pop("report_kind")
            made = [ReportTable.from_dict(t) for t in body["tables"]]
            options = dict(body["options"])
        except (json.JSONDecodeError, KeyError, TypeError, ValueError) as e:
            if isinstance(e, FactorError):
                raise
            raise FactorError(f"not a report: {e}") from e
        if version != CONTRACT:
            raise FactorError(f"report version {version}, expected {CONTRACT}")
        if kind not in KINDS:
            raise FactorError(f"unknown report kind: {kind}")
        ids = [t.id for t in made]
        if ids != [i for i in ORDER[kind] if i in ids] or not set(ORDER[kind]) - set(OPTIONAL.get(kind, ())) <= set(ids):
            raise FactorError(f"tables of a {kind} report are missing, unknown or out of order")
        return cls(kind, meta, options, {t.id: t for t in made})


_R = ["returns.summary", "returns.mean_by_quantile", "returns.daily_by_quantile", "returns.daily_spread", "returns.factor_returns"]
_R_MORE = ["returns.group_mean_by_quantile", "returns.factor_cumulative_1d", "returns.quantile_cumulative_1d"]
_I = ["information.summary", "information.ic_by_date", "information.ic_rolling", "information.ic_monthly", "information.qq_normal"]
_I_MORE = ["information.ic_by_group"]
_T = ["turnover.mean_by_quantile", "turnover.mean_rank_autocorrelation", "turnover.quantile_series", "turnover.rank_autocorrelation_series"]
_E = ["events.average_cumulative_returns", "events.coverage"]
ORDER = {
    "summary": ["quantile.statistics", "returns.summary", "returns.mean_by_quantile", "information.summary", *_T[:2]],
    "returns": _R + _R_MORE,
    "information": _I + _I_MORE,
    "turnover": _T,
    "full": ["quantile.statistics", *_R, *_I, *_T, *_R_MORE, *_I_MORE],
    "event_returns": _E,
    "event_study": ["quantile.statistics", "events.distribution", *_E, "returns.mean_by_quantile", "returns.daily_by_quantile"],
}
OPTIONAL = {"returns": _R_MORE, "information": _I_MORE, "full": _R_MORE + _I_MORE, "event_study": _E}
#: The public titles of the tables.
_TITLES = {
    "quantile.statistics": "Quantile Statistics",
    "returns.summary": "Returns Analysis",
    "returns.mean_by_quantile": "Mean Period-Wise Return by Quantile",
    "returns.daily_by_quantile": "Daily Return by Quantile",
    "returns.daily_spread": "Top Minus Bottom Quantile Mean Return",
    "returns.factor_returns": "Factor Returns",
    "returns.group_mean_by_quantile": "Mean Return by Quantile and Group",
    "returns.factor_cumulative_1d": "Factor Weighted Cumulative Return (1D)",
    "returns.quantile_cumulative_1d": "Cumulative Return by Quantile (1D)",
    "information.summary": "Information Analysis",
    "information.ic_by_date": "Information Coefficient",
    "information.ic_rolling": "Rolling Information Coefficient",
    "information.ic_monthly": "Monthly Mean Information Coefficient",
    "information.ic_by_group": "Information Coefficient by Group",
    "information.qq_normal": "Normal Q-Q",
    "turnover.mean_by_quantile": "Mean Quantile Turnover",
    "turnover.mean_rank_autocorrelation": "Mean Factor Rank Autocorrelation",
    "turnover.quantile_series": "Quantile Turnover",
    "turnover.rank_autocorrelation_series": "Factor Rank Autocorrelation",
    "events.average_cumulative_returns": "Average Cumulative Return",
    "events.coverage": "Event Coverage",
    "events.distribution": "Events Distribution",
}
_SORTS = {
    "returns.summary": ["metric", "period"],
    "information.ic_monthly": ["date", "period"],
    "information.qq_normal": ["period", "position"],
    "events.coverage": ["scope", "offset"],
    "events.distribution": ["bin"],
}


def _metadata(factor_data: DataFrame) -> dict:
    """Rows, dates, periods, buckets and groups of the panel, in one aggregation."""
    zoned = isinstance(factor_data.schema["date"].dataType, T.TimestampType)
    q = F.array_sort(F.collect_set("factor_quantile")) if "factor_quantile" in factor_data.columns else F.array().cast("array<int>")
    g = F.array_sort(F.collect_set("group")) if "group" in factor_data.columns else F.array().cast("array<string>")
    at = F.unix_micros("date") if zoned else F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), F.col("date"))
    r = factor_data.agg(F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"), q.alias("q"), g.alias("g")).first()
    zone = factor_data.sparkSession.conf.get("spark.sql.session.timeZone") if zoned else None
    periods = [f"{p}D" for p in forward_periods(factor_data.columns)] if any(c.startswith("forward_return_") for c in factor_data.columns) else []
    return {"source_rows": r["n"], "date_start": r["lo"], "date_end": r["hi"], "date_time_unit": "microseconds", "date_timezone": zone, "periods": periods, "quantiles": [x for x in r["q"] if x > 0], "groups": list(r["g"])}


def _sheet(kind: str, factor_data: DataFrame, options: dict, made: dict[str, DataFrame], *more: DataFrame, meta: dict | None = None) -> TearSheetData:
    out = {}
    for id in ORDER[kind]:
        if id in made:
            frame = made[id]
            keys = _SORTS.get(id) or [k for k in ("date", "factor_quantile", "group", "period", "offset") if k in frame.columns]
            out[id] = ReportTable(id, _TITLES[id], keys, frame.select(*keys, *[c for c in frame.columns if c not in keys]))
    return TearSheetData(kind, meta or _metadata(factor_data), options, out, [factor_data, *more])


def _lags(factor_data: DataFrame, turnover_periods: Sequence[int | str] | None) -> list[int]:
    lags = forward_periods(factor_data.columns) if turnover_periods is None else sorted(as_period(p) for p in turnover_periods)
    if not lags or len(set(lags)) != len(lags):
        raise FactorError("turnover periods must be there and unique")
    return lags


def _returns_tables(d: DataFrame, long_short: bool, group_neutral: bool, by_group: bool, meta: dict) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """The tables, and the frames that several of them come from: means by date and bucket, and the factor's returns."""
    periods = validate_factor_data(d, quantile=True, group=by_group or group_neutral)
    if not meta["quantiles"]:
        raise FactorError("no row has a bucket")
    raw = perf.mean_return_by_quantile(d, True, False, long_short, group_neutral)
    daily, means = tables.in_rates(raw, periods), tables.in_rates(perf.over_dates(raw), periods)
    moves = perf.factor_returns(d, demeaned=long_short, group_adjust=group_neutral)
    out = {
        "returns.summary": tables.returns_summary(d, long_short, group_neutral, moves, means),
        "returns.mean_by_quantile": means,
        "returns.daily_by_quantile": daily,
        "returns.daily_spread": tables.daily_spread(d, long_short, group_neutral, ends=(meta["quantiles"][-1], meta["quantiles"][0]), daily=daily),
        "returns.factor_returns": moves,
    }
    if by_group:
        out["returns.group_mean_by_quantile"] = tables.mean_by_quantile(d, long_short, group_neutral, by_group=True)
    if 1 in periods:
        out["returns.factor_cumulative_1d"] = cumulative_returns(moves.where("period = '1D'")).drop("period")
        out["returns.quantile_cumulative_1d"] = tables.wealth_by_quantile(daily)
    return out, [raw, moves]


def _information_tables(d: DataFrame, group_neutral: bool, by_group: bool, rolling_window: int) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """The tables, and the information coefficients that they come from."""
    if isinstance(rolling_window, bool) or rolling_window < 1:
        raise FactorError("the rolling window must be positive")
    ic = perf.factor_information_coefficient(d, group_adjust=group_neutral)
    month = perf.mean_information_coefficient(d, group_adjust=group_neutral, by_time="monthly")
    month = month.withColumnsRenamed({c: "date" for c in month.columns if c not in ("period", "mean_ic", "count")})
    out = {
        "information.summary": tables.ic_summary(ic),
        "information.ic_by_date": ic,
        "information.ic_rolling": tables.rolling_mean(ic, rolling_window),
        "information.ic_monthly": month.withColumn("date", F.col("date").cast("timestamp_ntz")),
        "information.qq_normal": tables.qq_normal(ic),
    }
    if by_group:
        out["information.ic_by_group"] = perf.mean_information_coefficient(d, group_adjust=group_neutral, by_group=True)
    return out, [ic]


def _turnover_tables(d: DataFrame, lags: Sequence[int]) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """The tables, and the two series that they come from."""
    by_quantile, by_rank = tables.turnover_series(d, lags), tables.autocorrelation_series(d, lags)
    return dict(zip(_T, (tables.mean_turnover(by_quantile), tables.mean_autocorrelation(by_rank), by_quantile, by_rank), strict=True)), [by_quantile, by_rank]


def create_returns_tear_sheet_data(factor_data: DataFrame, long_short: bool = True, group_neutral: bool = False, by_group: bool = False) -> TearSheetData:
    meta = _metadata(factor_data)
    options = {"long_short": long_short, "group_neutral": group_neutral, "by_group": by_group}
    made, shared = _returns_tables(factor_data, long_short, group_neutral, by_group, meta)
    return _sheet("returns", factor_data, options, made, *shared, meta=meta)


def create_information_tear_sheet_data(factor_data: DataFrame, group_neutral: bool = False, by_group: bool = False, rolling_window: int = 22) -> TearSheetData:
    options = {"group_neutral": group_neutral, "by_group": by_group, "rolling_window": rolling_window}
    made, shared = _information_tables(factor_data, group_neutral, by_group, rolling_window)
    return _sheet("information", factor_data, options, made, *shared)


def create_turnover_tear_sheet_data(factor_data: DataFrame, turnover_periods: Sequence[int | str] | None = None) -> TearSheetData:
    """Lags are the panel's periods unless given; given ones need no return column."""
    validate_factor_data(factor_data, quantile=True, returns=turnover_periods is None)
    lags, meta = _lags(factor_data, turnover_periods), _metadata(factor_data)
    if not meta["quantiles"]:
        raise FactorError("no row has a bucket")
    made, shared = _turnover_tables(factor_data, lags)
    return _sheet("turnover", factor_data, {"turnover_periods": lags}, made, *shared, meta=meta)


def create_summary_tear_sheet_data(factor_data: DataFrame, long_short: bool = True, group_neutral: bool = False, turnover_periods: Sequence[int | str] | None = None) -> TearSheetData:
    return _combined("summary", factor_data, long_short, group_neutral, False, turnover_periods, 22)


def create_full_tear_sheet_data(factor_data: DataFrame, long_short: bool = True, group_neutral: bool = False, by_group: bool = False, turnover_periods: Sequence[int | str] | None = None, ic_rolling_window: int = 22) -> TearSheetData:
    return _combined("full", factor_data, long_short, group_neutral, by_group, turnover_periods, ic_rolling_window)


def _combined(kind: str, d: DataFrame, long_short: bool, group_neutral: bool, by_group: bool, turnover_periods: Sequence[int | str] | None, window: int) -> TearSheetData:
    lags, meta = _lags(d, turnover_periods), _metadata(d)
    made, shared = {"quantile.statistics": tables.quantile_statistics(d)}, []
    parts = [_returns_tables(d, long_short, group_neutral, by_group, meta), _turnover_tables(d, lags)]
    if kind == "full":
        parts.append(_information_tables(d, group_neutral, by_group, window))
    else:
        made["information.summary"] = tables.ic_summary(perf.factor_information_coefficient(d, group_adjust=group_neutral))
    for own, common in parts:
        made |= own
        shared += common
    options = {"long_short": long_short, "group_neutral": group_neutral, "by_group": by_group, "turnover_periods": lags, "ic_rolling_window": window}
    return _sheet(kind, d, options, made, *shared, meta=meta)


def _moves(returns: DataFrame) -> DataFrame:
    return returns if "return" in returns.columns else perf.prices_to_returns(returns)


def _window(avgretplot: tuple[int, int]) -> tuple[int, int]:
    before, after = avgretplot
    if any(isinstance(x, bool) or not 0 <= x < 2**31 for x in (before, after)):
        raise FactorError("an event window needs two counts of sessions")
    return before, after


def create_event_returns_tear_sheet_data(factor_data: DataFrame, returns: DataFrame, avgretplot: tuple[int, int] = (5, 15), long_short: bool = True, group_neutral: bool = False, by_group: bool = False, check: bool = True) -> TearSheetData:
    """`returns` has date, asset and return, or price instead of return."""
    before, after = _window(avgretplot)
    moves = _moves(returns)
    got = ev.event_window(factor_data, moves, before, after, long_short, group_neutral, by_group, check)
    options = {"event_window": [before, after], "long_short": long_short, "group_neutral": group_neutral, "by_group": by_group}
    return _sheet("event_returns", factor_data, options, dict(zip(_E, (got.frame, got.coverage), strict=True)), moves)


def create_event_study_tear_sheet_data(factor_data: DataFrame, returns: DataFrame | None = None, avgretplot: tuple[int, int] | None = (5, 15), rate_of_ret: bool = True, n_bars: int = 50, check: bool = True) -> TearSheetData:
    """Long-only means by bucket, dates of the events and, with `returns`, cumulative returns around them."""
    if isinstance(n_bars, bool) or n_bars < 1:
        raise FactorError("the number of bars must be positive")
    validate_factor_data(factor_data, quantile=True, check=check)
    mean: Callable[..., DataFrame] = tables.mean_by_quantile if rate_of_ret else tables.raw_mean_by_quantile
    made = {
        "quantile.statistics": tables.quantile_statistics(factor_data),
        "events.distribution": tables.event_distribution(factor_data, n_bars),
        "returns.mean_by_quantile": mean(factor_data, demeaned=False),
        "returns.daily_by_quantile": mean(factor_data, demeaned=False, by_date=True),
    }
    more = []
    if returns is not None and avgretplot is not None:
        more = [_moves(returns)]
        got = ev.event_window(factor_data, more[0], *_window(avgretplot), False, False, False, check)
        made |= dict(zip(_E, (got.frame, got.coverage), strict=True))
    options = {"event_window": list(avgretplot) if more else None, "rate_of_return": rate_of_ret, "n_bars": n_bars}
    return _sheet("event_study", factor_data, options, made, *more)
