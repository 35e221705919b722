"""Ranks and percentiles of cross-sections too large for one task.

A window by date sorts a whole cross-section in one task. Here equal values are counted
first, so ties cost nothing; distinct values are dealt by ranges of their cross-section,
between splitters that come from a sample by hash; running counts go over the ranges first
and inside each range then. Every step is a pure function of the values: ranges computed
twice are the same. Values can be structs, which gives ranks by several columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a cross-section from which it is dealt by ranges.
CROWDED = 1_000_000
#: Ranges that the largest cross-section is cut into, and sampled values for each.
RANGES, SAMPLE = 64, 64
BEFORE = (Window.unboundedPreceding, -1)


def crowd(df: DataFrame, keys: Sequence[str], check: bool = True) -> int:
    """Rows of the largest cross-section by keys if it is over CROWDED, else 0; counted once for a frame, and not at all without check."""
    if not check:
        return 0
    known = getattr(df, "_quantloom_crowds", {})
    if tuple(keys) not in known:
        most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        known = known | {tuple(keys): most if most > CROWDED else 0}
        df._quantloom_crowds = known
    return known[tuple(keys)]


def ranged(values: DataFrame, keys: Sequence[str], x: str, most: int) -> DataFrame:
    """values with the number of the range that x lies in, _range, by keys; most: rows of the largest cross-section."""
    every = max(1, most // (RANGES * SAMPLE))
    sample = values.where(F.pmod(F.xxhash64(F.lit(1), x), F.lit(every)) == 0)
    splitters = sample.groupBy(*keys).agg(F.sort_array(F.collect_set(x)).alias("_s"))
    splitters = splitters.select(*keys, F.filter("_s", lambda s, i: i % SAMPLE == SAMPLE - 1).alias("_s"))
    below = F.size(F.filter("_s", lambda s: s < F.col(x)))
    return joined_by(values, splitters, keys).withColumn("_range", F.coalesce(below, F.lit(0))).drop("_s")


def joined_by(df: DataFrame, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the columns of sums, which has a row by keys; null keys are like any other."""
    named = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in sums.columns if c not in keys])
    return df.join(named, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left").drop(*[f"_k{i}" for i in range(len(keys))])


def counted(df: DataFrame, keys: Sequence[str], x: str, most: int) -> DataFrame:
    """(keys, x, _n, _first): how many rows of df have each value that isn't null, and how many lie below it, by keys."""
    values = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    values = ranged(values, keys, x, most)
    zero = F.lit(0).cast("long")
    totals = values.groupBy(*keys, "_range").agg(F.sum("_n").alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(*BEFORE)), zero)
    totals = totals.select(*keys, "_range", before.alias("_before"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy(x).rowsBetween(*BEFORE)), zero)
    return joined_by(values.withColumn("_in", inside), totals, [*keys, "_range"]).select(*keys, x, "_n", (F.col("_before") + F.col("_in")).alias("_first"))


def with_counts(df: DataFrame, keys: Sequence[str], x: str, most: int) -> DataFrame:
    """df with _n and _first of each row's value among those of its keys; null where x is."""
    return joined_by(df, counted(df, keys, x, most), [*keys, x])


def with_average_rank(df: DataFrame, keys: Sequence[str], x: str, name: str, most: int) -> DataFrame:
    """df with the rank of x by keys as column `name`, ties averaged; null where x is. most: see crowd()."""
    return with_counts(df, keys, x, most).withColumn(name, F.col("_first") + (F.col("_n") + 1) / 2).drop("_n", "_first")


def with_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, most: int) -> DataFrame:
    """df with the 0-based row number by keys in the order of columns that tell all rows apart."""
    packed = df.withColumn("_o", F.struct(*order))
    return with_counts(packed, keys, "_o", most).withColumn(name, F.col("_first")).drop("_o", "_n", "_first")


def percentiles(df: DataFrame, keys: Sequence[str], x: str, at: Sequence[float], most: int) -> DataFrame:
    """(keys, _cuts): the exact percentiles of x by keys, interpolated between neighbours, without gathering a cross-section.

    Of the values with their running counts only those at the places asked for are kept.
    """
    found = counted(df, keys, x, most)
    totals = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_all"))
    both = joined_by(found, totals, keys)
    place = [F.lit(float(p)) * (F.col("_all") - 1) for p in at]
    holds = lambda i: (F.col("_first") <= i) & (i < F.col("_first") + F.col("_n"))
    wanted = [c for p in place for c in (F.floor(p), F.ceil(p))]
    kept = both.where(F.greatest(*[holds(i) for i in wanted], F.lit(False)))
    pick = lambda i: F.max(F.when(holds(i), F.col(x)))
    cuts = [_between(pick(F.floor(p)), pick(F.ceil(p)), F.max(p)) for p in place]
    return kept.groupBy(*keys).agg(F.array(*cuts).alias("_cuts"))


def _between(lo: Column, hi: Column, place: Column) -> Column:
    """As percentile(): the nearer neighbour in proportion."""
    up = place - F.floor(place)
    return F.when(lo == hi, lo).otherwise((1 - up) * lo + up * hi)
