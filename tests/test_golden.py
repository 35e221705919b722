"""Small panels with published results, and the errors of the public operators."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException

from quantloom.errors import FactorError
from quantloom.functions import timeutil
from quantloom.functions.frames import MAX_COUNT, as_period, trusted, validate_factor_data
from quantloom.operators import events as ev
from quantloom.operators import performance as perf
from quantloom.operators import portfolio as pf
from quantloom.operators import prep

# Inputs (day of January 2024, asset, group, factor, quantile, returns) and expected results.
METRICS = [
    (2, "ALFA", "growth", -2.0, 1, -0.010, -0.025, -0.040),
    (2, "BRAVO", "growth", -1.0, 2, -0.004, -0.010, -0.020),
    (2, "COBALT", "value", 0.0, 3, 0.000, 0.002, 0.005),
    (2, "DELTA", "value", 1.0, 4, 0.006, 0.014, 0.030),
    (2, "EMBER", "value", 2.0, 5, 0.012, 0.030, 0.050),
    (3, "ALFA", "growth", 2.0, 5, -0.012, -0.026, -0.052),
    (3, "BRAVO", "growth", 1.0, 4, -0.006, -0.014, -0.030),
    (3, "COBALT", "value", 0.0, 3, 0.001, 0.002, 0.004),
    (3, "DELTA", "value", -1.0, 2, 0.007, 0.016, 0.031),
    (3, "EMBER", "value", -2.0, 1, 0.013, 0.031, 0.055),
    (4, "ALFA", "growth", -1.0, 1, 0.003, 0.010, 0.018),
    (4, "BRAVO", "growth", 0.0, 3, 0.003, 0.010, 0.018),
    (4, "COBALT", "value", 1.0, 5, 0.003, 0.010, 0.018),
    (6, "ALFA", "growth", -2.0, 1, -0.008, -0.020, -0.034),
    (6, "BRAVO", "growth", 0.0, 3, 0.002, 0.004, 0.006),
    (6, "COBALT", "value", 0.0, 3, 0.002, 0.004, 0.006),
    (6, "DELTA", "value", 2.0, 5, 0.010, 0.026, 0.044),
    (6, "EMBER", "value", 2.0, 5, 0.010, 0.026, 0.044),
]
IC = {2: 1.0, 3: -1.0, 4: None, 6: 1.0}
MEAN_IC = 0.3333333333333333
WEIGHTS = {
    2: (-0.3333333333333333, -0.16666666666666666, 0.0, 0.16666666666666666, 0.3333333333333333),
    3: (0.3333333333333333, 0.16666666666666666, 0.0, -0.16666666666666666, -0.3333333333333333),
    4: (-0.5, 0.0, 0.5),
    6: (-0.37499999999999994, -0.0625, -0.0625, 0.25, 0.25),
}
FACTOR_RETURNS = {
    "1D": {2: 0.009, 3: -0.010499999999999999, 4: 0.0, 6: 0.00775},
    "5D": {2: 0.02233333333333333, 3: -0.024, 4: 0.0, 6: 0.019999999999999997},
    "10D": {2: 0.03833333333333333, 3: -0.04583333333333333, 4: 0.0, 6: 0.033999999999999996},
}
ALPHA_BETA = {"1D": (-0.5269898863897825, 2.3836206896551717), "5D": (-0.11523398875688529, 1.2744714173844935), "10D": (-0.24571483908488734, 1.87857128734405)}
MEANS = {
    2: {1: -0.0108, 2: -0.0048, 3: -0.0008, 4: 0.0052, 5: 0.0112},
    3: {1: 0.0124, 2: 0.0064, 3: 0.0004, 4: -0.0066, 5: -0.0126},
    4: {1: 0.0, 3: 0.0, 5: 0.0},
    6: {1: -0.0112, 3: -0.0012, 5: 0.0068},
}
SPREAD = {"1D": {2: 0.022, 3: -0.025, 4: 0.0, 6: 0.018}, "5D": {2: 0.055, 3: -0.057, 4: 0.0, 6: 0.046}, "10D": {2: 0.09, 3: -0.107, 4: 0.0, 6: 0.078}}
PORTFOLIO = [
    (2, "A", "g1", -2.0, 1, -0.02, -0.05), (2, "B", "g1", -1.0, 1, -0.01, -0.03), (2, "C", "g2", 1.0, 5, 0.01, 0.03), (2, "D", "g2", 2.0, 5, 0.02, 0.05),
    (3, "A", "g1", -1.0, 1, -0.01, -0.02), (3, "B", "g1", 1.0, 5, 0.02, 0.04), (3, "C", "g2", 1.0, 5, 0.01, 0.02), (3, "D", "g2", -2.0, 1, -0.02, -0.04),
    (4, "A", "g1", 2.0, 5, 0.02, 0.06), (4, "B", "g1", 1.0, 5, 0.01, 0.03), (4, "C", "g2", -1.0, 1, -0.01, -0.03), (4, "D", "g2", -2.0, 1, -0.02, -0.06),
    (5, "A", "g1", 1.0, 5, 0.01, 0.02), (5, "B", "g1", -2.0, 1, -0.02, -0.04), (5, "C", "g2", 2.0, 5, 0.02, 0.04), (5, "D", "g2", -1.0, 1, -0.01, -0.02),
]
SIMPLE_RETURNS, WEALTH = {2: 0.1, 3: None, 4: -0.2, 5: 0.05}, {2: 1.1, 3: 1.1, 4: 0.8800000000000001, 5: 0.9240000000000002}
TURNOVER = {2: None, 3: None, 4: 1.0, 5: 0.5}
AUTOCORRELATION = {2: None, 3: -0.316227766016838, 4: 0.31622776601683794, 5: 0.0}
TRADES, SESSIONS = [(2, "A", 0.75), (2, "B", -0.25), (3, "A", 0.25), (3, "B", -0.75), (5, "A", -0.5), (5, "B", 0.5)], (2, 3, 4, 5, 8, 9)
POSITIONS = {2: (0.75, -0.25, 0.5), 3: (0.5, -0.5, 1.0), 4: (0.25, -0.75, 1.5), 5: (-0.5, 0.5, 1.0), 8: (-0.5, 0.5, 1.0), 9: (0.0, 0.0, 1.0)}
FACTOR_POSITIONS = {
    2: (-0.3333333333333333, -0.16666666666666666, 0.16666666666666666, 0.3333333333333333),
    3: (-0.15, 0.25, 0.25, -0.35),
    4: (0.3333333333333333, 0.16666666666666666, -0.16666666666666666, -0.3333333333333333),
    5: (0.16666666666666669, -0.33333333333333337, 0.33333333333333337, -0.16666666666666669),
    8: (0.0, 0.0, 0.0, 0.0),
}
NEAR = {"rel": 1e-10, "abs": 1e-12}


def day(x):
    return dt.datetime(2024, 1, x)


def frame(spark, rows, periods):
    columns = "date timestamp_ntz, asset string, group string, factor double, factor_quantile int, " + ", ".join(f"forward_return_{p}D double" for p in periods)
    return spark.createDataFrame([(day(r[0]), *r[1:]) for r in rows], columns)


@pytest.fixture(scope="module")
def metrics(spark):
    return frame(spark, METRICS, (1, 5, 10)).persist()


@pytest.fixture(scope="module")
def portfolio(spark):
    return frame(spark, PORTFOLIO, (1, 3)).persist()


def by_period(df, value):
    out = {}
    for r in df.collect():
        out.setdefault(r["period"], {})[r["date"].day] = r[value]
    return out


def near(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (None if v is None else pytest.approx(v, **NEAR))


def test_metrics(metrics):
    for ic in by_period(perf.factor_information_coefficient(metrics), "ic").values():
        near(ic, IC)
    assert [r["mean_ic"] for r in perf.mean_information_coefficient(metrics).collect()] == [pytest.approx(MEAN_IC, **NEAR)] * 3
    weights = {}
    for r in perf.factor_weights(metrics).orderBy("asset").collect():
        weights.setdefault(r["date"].day, []).append(r["weight"])
    assert {d: tuple(w) for d, w in weights.items()} == {d: pytest.approx(w, **NEAR) for d, w in WEIGHTS.items()}
    for p, got in by_period(perf.factor_returns(metrics), "factor_return").items():
        near(got, FACTOR_RETURNS[p])
    got = {r["period"]: (r["annualized_alpha"], r["beta"]) for r in perf.factor_alpha_beta(metrics).collect()}
    assert got == {p: pytest.approx(x, **NEAR) for p, x in ALPHA_BETA.items()}
    daily = perf.mean_return_by_quantile(metrics, by_date=True)
    means, errors = {}, {}
    for r in daily.where("period = '1D'").collect():
        means.setdefault(r["date"].day, {})[r["factor_quantile"]] = r["mean_return"]
        errors[r["date"].day, r["factor_quantile"]] = r["std_error"]
    for d, want in MEANS.items():
        near(means[d], want)
    assert {k for k, e in errors.items() if e is not None} == {(6, 3), (6, 5)} and errors[6, 3] == errors[6, 5] == 0
    spread = perf.compute_mean_returns_spread(daily, 5, 1)
    for p, got in by_period(spread, "mean_return_difference").items():
        near(got, SPREAD[p])
    assert spread.where("joint_std_error is not null").count() == 0


def test_portfolio(spark, portfolio):
    returns = spark.createDataFrame([(day(d), r) for d, r in SIMPLE_RETURNS.items()], "date timestamp_ntz, return double")
    near({r["date"].day: r["cumulative_return"] for r in pf.cumulative_returns(returns).collect()}, WEALTH)
    near(by_period(perf.quantile_turnover(portfolio, 5, 2), "turnover")["2D"], TURNOVER)
    near(by_period(perf.factor_rank_autocorrelation(portfolio), "autocorrelation")["1D"], AUTOCORRELATION)
    both = by_period(perf.rank_autocorrelations(portfolio, [1, 3]), "autocorrelation")
    near(both["1D"], AUTOCORRELATION)
    assert both["3D"] == by_period(perf.factor_rank_autocorrelation(portfolio, 3), "autocorrelation")["3D"]
    weights = spark.createDataFrame([(day(d), a, w) for d, a, w in TRADES], "date timestamp_ntz, asset string, weight double")
    sessions = spark.createDataFrame([(day(d),) for d in SESSIONS], "date timestamp_ntz")
    cells = lambda df: {(r["date"].day, r["asset"]): r["position"] for r in df.collect()}
    near(cells(pf.positions(weights, 2, sessions)), {(d, a): x for d, row in POSITIONS.items() for a, x in zip(("A", "B", "cash"), row, strict=True)})
    some = spark.createDataFrame([(day(d),) for d in FACTOR_POSITIONS], "date timestamp_ntz")
    got = {k: v for k, v in cells(pf.factor_positions(portfolio, 1, sessions=some)).items() if k[1] != "cash"}
    near(got, {(d, a): x for d, row in FACTOR_POSITIONS.items() for a, x in zip("ABCD", row, strict=True)})


@pytest.mark.parametrize(("change", "options"), [("duplicate", {}), ("asset", {}), ("date", {}), ("group", {"group_adjust": True}), ("factor_quantile", {}), ("zero", {})])
def test_values_are_checked_by_default(spark, change, options):
    rows = [list(r) for r in METRICS]
    if change == "duplicate":
        rows.append(rows[0])
    elif change == "zero":
        rows[3][4] = 0
    else:
        rows[3][{"date": 0, "asset": 1, "group": 2, "factor_quantile": 4}[change]] = None
    columns = "date timestamp_ntz, asset string, group string, factor double, factor_quantile int, forward_return_1D double"
    bad = spark.createDataFrame([(None if r[0] is None else day(r[0]), *r[1:6]) for r in rows], columns)
    with pytest.raises(FactorError):
        perf.mean_return_by_quantile(bad, **options)
    perf.mean_return_by_quantile(bad, **options, check=False)
    if change in ("duplicate", "asset", "date"):
        for f in (perf.factor_information_coefficient, perf.factor_weights, perf.factor_returns, perf.factor_alpha_beta):
            with pytest.raises(FactorError):
                f(bad)
    else:
        perf.factor_weights(bad)


def test_a_frame_is_checked_once(spark, monkeypatch, metrics):
    calls = []
    monkeypatch.setattr("quantloom.functions.frames.check_keys", lambda *a, **k: calls.append(a))
    own = metrics.select("*")
    validate_factor_data(own, quantile=True)
    validate_factor_data(own)
    validate_factor_data(own, group=True)
    assert len(calls) == 2
    validate_factor_data(pf.filter_portfolio(own, [1, 5], check=False), group=True)
    validate_factor_data(trusted(metrics.select("*")), quantile=True, group=True)
    assert len(calls) == 2


def test_errors_of_wealth(spark):
    schema = "date timestamp_ntz, period string, return double"
    run = lambda rows: pf.cumulative_returns(spark.createDataFrame(rows, schema)).collect()
    for rows in ([(day(2), None, 0.1)], [(day(2), "D", 0.1)], [(day(2), "05D", 0.1)], [(day(2), f"{MAX_COUNT + 1}D", 0.1)], [(None, "1D", 0.1)], [(day(2), "1D", 0.1)] * 2, [(day(2), "1D", 1e200), (day(3), "1D", 1e200)]):
        with pytest.raises(PySparkException):
            run(rows)
    assert {(r.date, r.period): r.cumulative_return for r in run([(day(2), "1D", 0.5), (day(2), "2D", 1.0), (day(3), "1D", 1.0)])} == {(day(2), "1D"): 1.5, (day(2), "2D"): 2.0, (day(3), "1D"): 3.0}


def test_errors_of_positions(spark, portfolio):
    schema = "date timestamp_ntz, asset string, weight double"
    huge = spark.createDataFrame([(day(2), "A", 1.7e308), (day(3), "A", 1.7e308)], schema)
    with pytest.raises(PySparkException):
        pf.positions(huge, 2).collect()
    wide = spark.createDataFrame([(day(2), "A", 1.7e308), (day(2), "B", -1.7e308)], schema)
    with pytest.raises(PySparkException):
        pf.positions(wide, 1).collect()
    fine = spark.createDataFrame([(day(2), "A", 1.0)], schema)
    one = lambda rows, kind="date timestamp_ntz": spark.createDataFrame(rows, kind)
    for sessions in (one([(day(2), 1)], "date timestamp_ntz, x int"), one([(day(2),), (None,)]), one([(day(2),), (day(2),)]), one([(day(3),)])):
        with pytest.raises(FactorError):
            pf.positions(fine, 1, sessions)
    for bad in ([(day(2), "cash", 1.0)], [(day(2), "A", None)], [(day(2), "A", float("inf"))], [(day(2), "A", 1.0)] * 2):
        with pytest.raises(FactorError):
            pf.positions(spark.createDataFrame(bad, schema), 1)
    flat = portfolio.withColumn("factor", portfolio["factor"] * 0)
    with pytest.raises(Exception, match="weights must be finite"):
        pf.factor_positions(flat, 1).collect()


def test_counts_fit_32_bits(portfolio):
    assert as_period(f"{MAX_COUNT}D") == MAX_COUNT
    with pytest.raises(FactorError):
        as_period(MAX_COUNT + 1)
    moves = portfolio.select("date", "asset", portfolio["forward_return_1D"].alias("return"))
    for before, after in ((-1, 2), (MAX_COUNT + 1, 2), (1, True)):
        for f in (ev.event_window, ev.average_cumulative_return_by_quantile_from_prices, ev.common_start_returns):
            with pytest.raises(FactorError):
                f(portfolio, moves, before, after)


def test_backshift(spark):
    series = spark.createDataFrame([(day(d), a, float(d)) for d in (5, 2, 3) for a in "AB"], "date timestamp_ntz, asset string, return double")
    assert {(r.date.day, r.asset, r["return"]) for r in perf.backshift_returns_series(series, 1).collect()} == {(2, "A", 3.0), (2, "B", 3.0), (3, "A", 5.0), (3, "B", 5.0)}
    assert perf.backshift_returns_series(series, 3).count() == 0
    for n in (0, -1):
        with pytest.raises(FactorError):
            perf.backshift_returns_series(series, n)


def test_differences_of_custom_calendars():
    at = lambda d, h: dt.datetime(2024, 1, d, h)  # noqa: E731  the 5th is a Friday
    diff = timeutil.diff_custom_calendar_timedeltas
    assert diff(at(5, 10), at(7, 10)) == dt.timedelta(days=2)
    assert diff(at(5, 15), at(8, 10)) == dt.timedelta(days=2, hours=19)
    assert diff(at(5, 10), at(8, 12)) == dt.timedelta(days=1, hours=2) and diff(at(8, 12), at(5, 10)) == -dt.timedelta(days=1, hours=2)
    assert diff(at(4, 0), at(9, 0), holidays=[dt.date(2024, 1, 5)]) == dt.timedelta(days=2) and diff(at(5, 0), at(6, 0), weekmask={5, 6}) == dt.timedelta(days=1)
    assert timeutil.add_custom_calendar_timedelta(at(5, 10), dt.timedelta(days=1), weekmask={0, 1}) == at(8, 10)


@pytest.mark.parametrize("check", [True, False])
def test_intraday_labels_under_any_check(spark, check):
    times = [dt.datetime(2024, 1, d, h) for d in (2, 3, 4) for h in (10, 14)]
    prices = spark.createDataFrame([(t, "A", 1.0 + i) for i, t in enumerate(times)], "date timestamp_ntz, asset string, price double")
    factor = prices.select("date", "asset", prices["price"].alias("factor"))
    assert prep.compute_forward_returns(factor, prices, (1, 2, 99), check=check).columns[2:] == ["forward_return_4h", "forward_return_1D", "forward_return_99D"]
    days = prices.where("hour(date) = 10")
    assert prep.compute_forward_returns(factor, days, (1, 2), check=check).columns[2:] == ["forward_return_1D", "forward_return_2D"]
    late = spark.createDataFrame([(dt.datetime(2024, 1, 2, 20), "A", 1.0), (dt.datetime(2024, 1, 3, 8), "A", 1.0)], prices.schema)
    assert prep.compute_forward_returns(factor, late, (1,), check=check).columns[2:] == ["forward_return_12h"]
