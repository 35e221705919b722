"""Running values by days against plain windows, layouts and sweeps against plain Python."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import scan
from quantloom.functions.frames import sessions_of
from quantloom.functions.ordering import order_of, write_in_order
from quantloom.operators import performance as perf
from quantloom.operators import portfolio as pf
from quantloom.plans.reports import create_full_tear_sheet_data
from quantloom.sources import bridge
from quantloom.sources.stored import laid_out

SF = "/root/testdata/sf0.001"
TYPES = ["timestamp", "timestamp_ntz"]


def axis(spark, kind, n=5_000):
    """Sessions of some minutes over days, with holes."""
    at = F.timestamp_add("MINUTE", F.col("id").cast("int"), F.lit("2023-12-30 22:10:00").cast(kind))
    rows = spark.range(n, numPartitions=3).where("id % 7 <> 3").select(at.alias("date"), "id", F.when(F.col("id") % 5 > 0, F.sin("id") / 100).alias("x"), (F.col("id") % 2).cast("string").alias("k"))
    return rows.repartition(5, "id")


def same(a, b, columns):
    rows = lambda df: sorted(tuple(round(v, 10) if isinstance(v, float) else str(v) for v in r) for r in df.select(*columns).collect())
    assert rows(a) == rows(b)


@pytest.mark.parametrize("kind", TYPES)
def test_running_values_are_those_of_one_window(spark, kind):
    df = axis(spark, kind)
    every = Window.orderBy("date")
    same(scan.ordinals(df), sessions_of(df), ["date", "idx"])
    for own in (True, False):
        frame = every.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        value = 1 + F.coalesce("x", F.lit(0.0))
        same(scan.running_product(df, ["k"], value, "w", own), df.withColumn("w", F.coalesce(F.product(value).over(frame.partitionBy("k")), F.lit(1.0))), ["date", "k", "w"])
        # Days without any value in between.
        sparse = df.withColumn("v", F.when(F.col("id") % 3001 == 4, F.col("id")))
        same(scan.latest(sparse, "v", "w", own), sparse.withColumn("w", F.last("v", ignorenulls=True).over(frame)), ["date", "w"])
    none = df.limit(0)
    assert scan.ordinals(none).count() == scan.latest(none, "x", "w").count() == scan.running_product(none, [], F.lit(1.0), "w").count() == 0


def test_only_days_meet_in_one_task(spark):
    """The rows that go to a single partition are a day's each."""
    df = axis(spark, "timestamp_ntz", 20_000).cache()
    days = df.select(F.to_date("date")).distinct().count()
    plan = scan.ordinals(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange SinglePartition") == 1 and "row_number() windowspecdefinition(date" not in plan
    assert days < 20


@pytest.mark.parametrize("period", [1, 3, 250])
def test_positions_of_any_period(spark, period):
    rng = iter(range(10_000))
    dates = [f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}" for d in range(60)]
    rows = [(d, a, math.sin(next(rng)) or 1.0) for i, d in enumerate(dates[:40]) for a in "abcd" if (i + ord(a)) % 3 and not (a == "d" and i > 2)]
    weights = spark.createDataFrame(rows, "date string, asset string, weight double").withColumn("date", F.col("date").cast("timestamp_ntz"))
    sessions = spark.createDataFrame([(d,) for d in dates], "date string").select(F.col("date").cast("timestamp_ntz").alias("date"))
    got = {(str(r["date"])[:10], r["asset"]): r["position"] for r in pf.positions(weights, period, sessions).collect()}
    want = {}
    for i, d in enumerate(dates):
        held = {a: sum(w for x, b, w in rows if b == a and i - period < dates.index(x) <= i) for a in "abcd"}
        gross = sum(map(abs, held.values()))
        want |= {(d, a): w / gross if gross else 0.0 for a, w in held.items()}
        want[d, "cash"] = 1 - (sum(held.values()) / gross if gross else 0.0)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_sleeves_are_not_copied(spark):
    """A longer period moves no more rows: no step of the plan depends on it but the frame."""
    panel = bridge.clean_panel(spark, SF)
    plans = [pf.factor_positions(panel, p, check=False)._jdf.queryExecution().optimizedPlan().toString() for p in (5, 10)]
    assert all("-9" in p or "-4" in p for p in plans) and "sequence(idx" not in plans[0] and plans[0].count("Generate") == plans[1].count("Generate")


def test_layout_gives_the_same_answers(spark):
    panel = bridge.clean_panel(spark, SF)
    laid = laid_out(panel, 3)
    assert set(laid.columns) == {*panel.columns, "session"}
    same(laid.select("date", F.col("session").alias("idx")).distinct(), sessions_of(panel), ["date", "idx"])
    for f in (lambda d: perf.quantile_turnover(d, 2, 3), perf.factor_rank_autocorrelation, perf.factor_information_coefficient, perf.factor_weights, lambda d: pf.factor_positions(d, 5, check=False)):
        a, b = f(panel), f(laid)
        same(a, b, a.columns)
    plan = perf.quantile_turnover(laid, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the means by date; what goes along an asset's sessions is laid out for it
    assert perf.factor_rank_autocorrelation(laid)._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 3


def test_cells_are_the_tables(spark):
    sheet = create_full_tear_sheet_data(bridge.clean_panel(spark, SF))
    cells = sheet.cells().collect()
    by = {}
    for c in cells:
        assert (c["value"] is None) or (c["text"] is None)
        by.setdefault(c["table_id"], {})[c["row"], c["column"]] = c["value"] if c["text"] is None else c["text"]
    assert list(dict.fromkeys(sheet.tables)) == sheet.table_ids() and set(by) == {i for i, t in sheet.tables.items() if len(t)}
    for i, t in sheet.tables.items():
        assert len(by.get(i, {})) == len(t) * len(t.columns)
        for name, values in t.values.items():
            for row, v in enumerate(values):
                got = by[i][row, name]
                assert got == v if isinstance(v, str) or v is None else got == pytest.approx(v, rel=1e-12)


#: What the operators' results are sorted by, as their public contract has it.
ORDERS = {
    "factor_information_coefficient": (lambda d: perf.factor_information_coefficient(d, by_group=True), ["date", "group", "period"]),
    "mean_information_coefficient": (perf.mean_information_coefficient, ["period"]),
    "factor_weights": (perf.factor_weights, ["date", "asset"]),
    "factor_returns": (perf.factor_returns, ["date", "period"]),
    "factor_returns by asset": (lambda d: perf.factor_returns(d, by_asset=True), ["date", "asset", "period"]),
    "factor_alpha_beta": (perf.factor_alpha_beta, ["period"]),
    "mean_return_by_quantile": (lambda d: perf.mean_return_by_quantile(d, by_date=True), ["date", "factor_quantile", "period"]),
    "quantile_turnover": (lambda d: perf.quantile_turnover(d, 1), ["date"]),
    "factor_rank_autocorrelation": (perf.factor_rank_autocorrelation, ["date", "period"]),
    "cumulative_returns": (lambda d: pf.cumulative_returns(perf.factor_returns(d)), ["period", "date"]),
    "factor_positions": (lambda d: pf.factor_positions(d, 5, check=False), ["date", "asset"]),
}


@pytest.mark.parametrize("name", ORDERS)
def test_files_keep_the_public_order(spark, tmp_path, name):
    import pyarrow.parquet as pq

    f, keys = ORDERS[name]
    out = f(bridge.clean_panel(spark, SF))
    write_in_order(out, f"file://{tmp_path}/out", 3)
    rows = [r for p in sorted(tmp_path.glob("out/*.parquet")) for r in pq.read_table(p).to_pylist()]
    key = lambda r: tuple(int(r[k][:-1]) if k == "period" else r[k] for k in keys)
    assert len(rows) > 0 and rows == sorted(rows, key=key) and set(order_of(out)) >= set(keys)
    assert len({key(r) for r in rows}) == len(rows)
