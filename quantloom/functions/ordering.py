"""The public order of results: frames have no order of rows, so results carry the keys by which theirs is defined."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.errors import FactorError
from quantloom.functions.frames import period_number

#: The keys of results whose operator names no others, those that they have, in this order.
KEYS = ("date", "factor_quantile", "group", "asset", "period", "offset")


def in_order(*keys: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Results of the function stand by the keys, those that they have (KEYS if none is named)."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(f)
        def call(*args, **kwargs) -> DataFrame:
            out = f(*args, **kwargs)
            out._quantloom_order = tuple(k for k in keys or KEYS if k in out.columns)
            return out

        call.order = keys or KEYS
        return call

    return wrap


def order_of(df: DataFrame) -> tuple[str, ...]:
    """The keys of a result; those of KEYS that other frames have."""
    found = getattr(df, "_quantloom_order", None) or tuple(k for k in KEYS if k in df.columns)
    if not found:
        raise FactorError("no key to sort by")
    return found


def sort_columns(df: DataFrame, keys: Sequence[str] | None = None) -> list[Column]:
    """What rows are sorted by: the keys, periods by their number, null first."""
    return [(period_number(k) if k == "period" else F.col(k)).asc_nulls_first() for k in keys or order_of(df)]


def sorted_for_output(df: DataFrame) -> DataFrame:
    """df in its public order."""
    return df.orderBy(*sort_columns(df))


def write_in_order(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write df as Parquet so that its files, by name, and the rows in each stand in the public order.

    Rows are dealt by ranges of the keys and sorted in their range: no task holds more than one.
    """
    by = sort_columns(df)
    dealt = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.parquet(path)
