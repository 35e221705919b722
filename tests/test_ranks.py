"""Ranks and percentiles by ranges against windows, on crowded dates and ties."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import ranks, stats
from quantloom.operators import performance, prep

ROWS = 1_000_000


@pytest.fixture(scope="module")
def crowded(spark):
    """One date of a million rows, a third of them tied, and small dates beside it; nulls, too."""
    x = F.when(F.col("id") % 3 == 0, 7.5).when(F.col("id") % 1009 == 1, None).otherwise(F.round(F.randn(5) * 10, 5))
    hot = spark.range(ROWS, numPartitions=8).select(F.lit(1).alias("k"), x.alias("x"), F.col("id").cast("string").alias("asset"))
    rest = spark.range(3_000, numPartitions=2).select((F.col("id") % 50 + 2).cast("int").alias("k"), F.rand(3).alias("x"), F.col("id").cast("string").alias("asset"))
    few = spark.createDataFrame([(None, 1.0, "a"), (None, 1.0, "b"), (None, None, "c")], "k int, x double, asset string")
    return hot.unionByName(rest).unionByName(few).cache()


def test_average_ranks_of_a_hot_date(crowded):
    got = ranks.with_average_rank(crowded, ["k"], "x", "r", ROWS)
    want = crowded.where("x is not null").withColumn("w", stats.average_rank(["k"], "x"))
    both = got.where("x is not null").join(want.select(F.col("k").alias("k2"), F.col("asset").alias("a2"), "w"), F.col("k").eqNullSafe(F.col("k2")) & (F.col("asset") == F.col("a2")))
    assert tuple(both.agg(F.count("*"), F.count_if(F.col("r") == F.col("w"))).first()) == (crowded.where("x is not null").count(),) * 2
    assert got.where("x is null and r is not null").isEmpty() and got.count() == crowded.count()


def test_no_range_holds_an_eighth_of_a_hot_date(crowded):
    values = crowded.where("x is not null").groupBy("k", "x").agg(F.count("*").alias("_n"))
    sizes = ranks.ranged(values, ["k"], "x", ROWS).groupBy("k", "_range").count().where("k = 1")
    ranges, most = sizes.agg(F.count("*"), F.max("count")).first()
    assert 8 * most < ROWS and ranges > 16
    # By (x, asset) a tie of a third of the rows is cut, too.
    rows = crowded.where("x is not null").withColumn("o", F.struct("x", "asset"))
    assert ranks.ranged(rows, ["k"], "o", ROWS).groupBy("k", "_range").count().agg(F.max("count")).first()[0] * 8 < ROWS


def test_row_numbers_of_a_hot_date(crowded):
    rows = crowded.where("x is not null")
    got = ranks.with_row_number(rows, ["k"], ["x", "asset"], "r", ROWS)
    want = rows.withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy("x", "asset")) - 1)
    both = got.join(want.select("asset", F.col("k").alias("k2"), "w"), ["asset"]).where(F.col("k").eqNullSafe(F.col("k2")))
    assert both.count() == rows.count() and both.where("r <> w").isEmpty()


def test_percentiles_of_a_hot_date(crowded):
    at = [0.0, 0.1, 0.25, 0.5, 0.777, 1.0]
    got = {r[0]: r[1] for r in ranks.percentiles(crowded, ["k"], "x", at, ROWS).collect()}
    want = {r[0]: r[1] for r in crowded.where("x is not null").groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, at)))).collect()}
    assert got == want and len(got) == 52


@pytest.fixture
def panel(spark):
    f = F.when(F.col("id") % 11 == 0, None).otherwise(F.round(F.randn(2), 1))
    day = F.timestamp_add("DAY", (F.col("id") % 7).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return spark.range(2_000, numPartitions=4).select(day.alias("date"), F.col("id").cast("string").alias("asset"), f.alias("factor"), F.concat(F.lit("g"), F.col("id") % 4).alias("group"), F.round(F.randn(4) / 50, 4).alias("forward_return_1D"), F.round(F.randn(6) / 50, 3).alias("forward_return_5D"), (F.col("id") % 5 + 1).cast("int").alias("factor_quantile"))


def rows(df):
    return sorted(([tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in df.collect()]), key=str)


@pytest.mark.parametrize("f", [
    performance.factor_information_coefficient,
    lambda d: performance.factor_information_coefficient(d, by_group=True),
    performance.factor_weights,
    lambda d: performance.factor_weights(d, equal_weight=True),
    lambda d: performance.factor_weights(d, demeaned=False, equal_weight=True),
    lambda d: performance.factor_weights(d, group_adjust=True),
    lambda d: performance.factor_weights(d, demeaned=False),
    performance.factor_returns,
    performance.factor_rank_autocorrelation,
    lambda d: prep.quantize_factor(d.drop("factor_quantile"), 5),
    lambda d: prep.quantize_factor(d.drop("factor_quantile"), 4, zero_aware=True),
    lambda d: prep.quantize_factor(d.drop("factor_quantile"), 3, by_group=True),
    lambda d: prep.quantize_factor(d.drop("factor_quantile"), [0.0, 0.2, 0.9, 1.0]),
    lambda d: prep.quantize_factor(d.drop("factor_quantile"), None, 4),
    lambda d: prep.quantize_factor(d.drop("factor_quantile"), None, [-1.0, 0.0, 2.0]),
])
def test_operators_agree_on_crowded_dates(panel, monkeypatch, f):
    want = rows(f(panel))
    monkeypatch.setattr(ranks, "CROWDED", 10)
    panel = panel.select("*")  # another frame: what was counted for the first one holds for that alone
    assert rows(f(panel)) == want
