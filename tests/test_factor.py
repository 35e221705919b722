"""Factor operators on small panels with values worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quantloom.errors import FactorError, MaxLossExceededError
from quantloom.functions import stats, timeutil
from quantloom.functions.frames import check_keys, forward_periods, validate_factor_frame
from quantloom.operators import events as ev
from quantloom.operators import performance as perf
from quantloom.operators import portfolio as pf
from quantloom.operators import prep

D = [dt.datetime(2024, 1, x) for x in (2, 3, 4, 5, 8, 9)]
CLEAN = "date timestamp_ntz, asset string, group string, factor double, factor_quantile int, forward_return_1D double"


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


@pytest.fixture(scope="module")
def clean(spark):
    data = [(d, a, g, f * s, q, r) for d, s in ((D[0], 1), (D[1], -1)) for a, g, f, q, r in (("A", "g1", -1.0, 1, 0.01), ("B", "g1", 0.0, 3, 0.02), ("C", "g2", 1.0, 5, 0.03))]
    return spark.createDataFrame(data, CLEAN)


def test_forward_returns_follow_sessions_not_rows(spark):
    prices = spark.createDataFrame([(D[0], "A", 1.0), (D[1], "B", 1.0), (D[2], "A", 3.0), (D[2], "B", 2.0)], "date timestamp_ntz, asset string, price double")
    factor = spark.createDataFrame([(D[0], "A", 1.0), (D[1], "B", 2.0), (D[5], "A", 1.0)], "date timestamp_ntz, asset string, factor double")
    got = {(r.date, r.asset): (r.forward_return_1D, r.forward_return_2D) for r in prep.compute_forward_returns(factor, prices, (1, 2)).collect()}
    assert got == {(D[0], "A"): (None, 2.0), (D[1], "B"): (1.0, None), (D[5], "A"): (None, None)}


@pytest.mark.parametrize(("n", "q", "want"), [(5, 5, [1, 2, 3, 4, 5]), (8, 5, [1, 1, 2, 2, 3, 4, 4, 5]), (3, 5, [1, 3, 5]), (1, 5, [None])])
def test_equal_count_buckets(spark, n, q, want):
    factor = spark.createDataFrame([(D[0], f"a{i}", float(i)) for i in range(n)], "date timestamp_ntz, asset string, factor double")
    assert [x for _, x in sorted(rows(prep.quantize_factor(factor, q), "asset", "factor_quantile"))] == want


def test_bucket_modes(spark):
    factor = spark.createDataFrame([(D[0], a, f) for a, f in (("a", -2.0), ("b", -1.0), ("c", 0.0), ("d", 1.0), ("e", float("nan")))], "date timestamp_ntz, asset string, factor double")
    of = lambda **k: [x for _, x in sorted(rows(prep.quantize_factor(factor, **k), "asset", "factor_quantile"))]
    assert of(quantiles=None, bins=3) == [1, 1, 2, 3, None]
    assert of(quantiles=None, bins=[-2.0, 0.0, 1.0]) == [None, 1, 1, 2, None]
    assert of(quantiles=[0.0, 0.5, 1.0]) == [1, 1, 2, 2, None]
    assert of(quantiles=4, zero_aware=True) == [1, 2, 3, 4, None]
    with pytest.raises(FactorError):
        prep.quantize_factor(factor, 5, zero_aware=True)


def test_loss_counters_overlap_and_guard(spark):
    factor = spark.createDataFrame([(D[0], "A", 1.0), (D[0], "B", None), (D[1], "A", 1.0)], "date timestamp_ntz, asset string, factor double")
    returns = spark.createDataFrame([(D[0], "A", 0.1)], "date timestamp_ntz, asset string, forward_return_1D double")
    got = prep.get_clean_factor(factor, returns, 1, max_loss=1.0)
    assert (got.loss.input_rows, got.loss.output_rows, got.loss.missing_returns, got.loss.missing_quantiles) == (3, 0, 2, 3)
    with pytest.raises(MaxLossExceededError):
        prep.get_clean_factor(factor, returns, 1)


def test_groups_are_attached_or_missed(spark):
    factor = spark.createDataFrame([(D[0], "A", 1.0)], "date timestamp_ntz, asset string, factor double")
    assert rows(prep.attach_groups(factor, {"A": "1"}, {"1": "tech"}), "group") == [("tech",)]
    with pytest.raises(KeyError):
        prep.attach_groups(factor, {"B": "1"})


def test_ic_weights_returns(clean):
    ic = perf.factor_information_coefficient(clean)
    assert sorted((d, round(x, 12)) for d, x in rows(ic, "date", "ic")) == [(D[0], 1.0), (D[1], -1.0)]
    assert rows(perf.mean_information_coefficient(clean), "mean_ic", "count") == [(pytest.approx(0.0), 2)]
    w = {(r.date, r.asset): r.weight for r in perf.factor_weights(clean).collect()}
    assert w[D[0], "A"] == -0.5 and w[D[0], "B"] == 0.0 and w[D[1], "A"] == 0.5
    assert sorted(rows(perf.factor_returns(clean), "date", "factor_return")) == [(D[0], pytest.approx(0.01)), (D[1], pytest.approx(-0.01))]


def test_constant_groups_have_no_correlation(spark):
    flat = spark.createDataFrame([(D[0], a, "g", 1.0, 1, r) for a, r in (("A", 0.1), ("B", 0.2))], CLEAN)
    assert rows(perf.factor_information_coefficient(flat), "ic") == [(None,)]
    assert rows(perf.mean_information_coefficient(flat), "mean_ic") == []
    assert rows(perf.factor_weights(flat), "weight") == [(None,), (None,)]


def test_spread_needs_both_sides(clean):
    means = perf.mean_return_by_quantile(clean, by_date=True)
    assert sorted(rows(perf.compute_mean_returns_spread(means, 5, 1), "date", "mean_return_difference")) == [(D[0], pytest.approx(0.02)), (D[1], pytest.approx(0.02))]
    with pytest.raises(Exception, match="both quantiles"):
        perf.compute_mean_returns_spread(means, 5, 2).collect()


def test_turnover_and_autocorrelation(spark):
    data = [(D[i], a, "g", f, q, 0.0) for i, fs in enumerate(((1.0, 2.0, 3.0), (3.0, 2.0, 1.0), (1.0, 2.0, 3.0))) for a, f in zip("ABC", fs, strict=True) for q in [int(f)]]
    df = spark.createDataFrame(data, CLEAN)
    assert [x for _, x in sorted(rows(perf.quantile_turnover(df, 3), "date", "turnover"))] == [None, 1.0, 1.0]
    assert [x for _, x in sorted(rows(perf.quantile_turnover(df, 3, 2), "date", "turnover"))] == [None, None, 0.0]
    assert [x for _, x in sorted(rows(perf.factor_rank_autocorrelation(df), "date", "autocorrelation"))] == [None, -1.0, -1.0]


def test_wealth_counts_missing_as_zero(spark):
    r = spark.createDataFrame([(D[0], 0.1), (D[1], None), (D[2], -1.0), (D[3], 0.5)], "date timestamp_ntz, return double")
    assert [x for _, x in sorted(rows(pf.cumulative_returns(r), "date", "cumulative_return"))] == [pytest.approx(1.1), pytest.approx(1.1), 0.0, 0.0]


def test_positions_overlap_and_expire(spark):
    w = spark.createDataFrame([(D[0], "A", 0.75), (D[0], "B", -0.25), (D[1], "A", 0.25), (D[1], "B", -0.75)], "date timestamp_ntz, asset string, weight double")
    sessions = spark.createDataFrame([(d,) for d in D[:4]], "date timestamp_ntz")
    got = {(r.date, r.asset): r.position for r in pf.positions(w, 2, sessions).collect()}
    assert [got[D[0], a] for a in ("A", "B", "cash")] == [0.75, -0.25, 0.5]
    assert [got[D[1], a] for a in ("A", "B", "cash")] == [0.5, -0.5, 1.0]
    assert [got[D[3], a] for a in ("A", "B", "cash")] == [0.0, 0.0, 1.0] and len(got) == 12
    with pytest.raises(FactorError):
        pf.positions(w.limit(0).union(spark.createDataFrame([(D[0], "cash", 1.0)], w.schema)), 1)


def test_events_are_rebased_to_their_session(spark):
    factor = spark.createDataFrame([(D[1], "A", "g", 1.0, 1, 0.0)], CLEAN)
    moves = spark.createDataFrame([(d, "A", 0.1) for d in D[:3]], "date timestamp_ntz, asset string, return double")
    got = sorted(rows(ev.average_cumulative_return_by_quantile(factor, moves, 1, 1, demeaned=False), "offset", "mean_cumulative_return", "count"))
    assert got == [(-1, pytest.approx(1 / 1.1 - 1), 1), (0, 0.0, 1), (1, pytest.approx(0.1), 1)]
    aligned = sorted(rows(ev.common_start_returns(factor, moves, 1, 1, cumulative=True), "offset", "mean"))
    assert aligned == [(-1, 0.1), (0, 0.1), (1, 0.1)]


def test_keys_are_checked(spark):
    df = spark.createDataFrame([(D[0], "A", 1.0), (D[0], "A", 2.0)], "date timestamp_ntz, asset string, factor double")
    with pytest.raises(FactorError, match="duplicate"):
        validate_factor_frame(df)
    with pytest.raises(FactorError, match="null"):
        check_keys(spark.createDataFrame([(None, "A")], "date timestamp_ntz, asset string"), ["date", "asset"])
    assert forward_periods(["forward_return_10D", "forward_return_5D"]) == [5, 10]
    with pytest.raises(FactorError):
        forward_periods(["forward_return_2h"])


def test_driver_side_helpers():
    assert timeutil.duration_micros("1D3h") == 97_200_000_000 and timeutil.duration_micros("5ns") == 0
    assert timeutil.timedelta_to_string(dt.timedelta(days=1, hours=3)) == "1D3h"
    assert timeutil.get_forward_returns_columns(["forward_return_1D", "2h", "x"]) == ["forward_return_1D", "2h"]
    assert timeutil.add_custom_calendar_timedelta(dt.datetime(2024, 1, 5), dt.timedelta(days=1)) == dt.datetime(2024, 1, 8)


def test_calendar_helpers_by_position():
    """(…, holidays, weekmask), as those who call by position do; a calendar without sessions is an error."""
    friday, holiday = dt.datetime(2024, 1, 5, 12), {dt.date(2024, 1, 8)}
    assert timeutil.add_custom_calendar_timedelta(friday, dt.timedelta(days=1), holiday) == dt.datetime(2024, 1, 9, 12)
    assert timeutil.add_custom_calendar_timedelta(friday, dt.timedelta(days=1), holiday, {0, 5}) == dt.datetime(2024, 1, 6, 12)
    assert timeutil.diff_custom_calendar_timedeltas(friday, dt.datetime(2024, 1, 9, 12), holiday) == dt.timedelta(days=1)
    assert timeutil.diff_custom_calendar_timedeltas(friday, dt.datetime(2024, 1, 9, 12), weekmask={1}) == dt.timedelta(days=1)
    for mask in ([False] * 7, {dt.date(2024, 1, 8)}, {7}, [True] * 6):
        with pytest.raises(FactorError):
            timeutil.add_custom_calendar_timedelta(friday, dt.timedelta(days=1), (), mask)
        with pytest.raises(FactorError):
            timeutil.diff_custom_calendar_timedeltas(friday, friday, (), mask)
    assert timeutil.add_custom_calendar_timedelta(value=friday, delta=dt.timedelta(days=1), holidays=None, weekmask=set()) == dt.datetime(2024, 1, 8, 12)
    days = [dt.datetime(2024, 1, d) for d in (1, 2, 3, 4, 5, 8, 10, 11, 12)]
    assert timeutil.infer_trading_calendar(days[:5], days[5:]) == {"weekmask": {0, 1, 2, 3, 4}, "holidays": {dt.date(2024, 1, 9)}}
    assert timeutil.infer_trading_calendar([], []) == {"weekmask": set(), "holidays": set()}


def test_p_values_and_normal_quantiles(spark):
    """Published values, the closed forms of one and two degrees of freedom, and the standard library's inverse."""
    from statistics import NormalDist

    cases = [(2.0, 10, 0.07338803477074), (1.0, 1, 0.5), (-3.0, 2, 1 - 3 / math.sqrt(11)), (0.0, 5, 1.0), (1e-6, 7, None), (12.706204736, 1, 0.05), (1.959963985, 10**7, 0.0500000277), (40.0, 30, None), (0.3, 251, None)]
    df = spark.createDataFrame([(t, n + 1) for t, n, _ in cases], "t_stat double, count long")
    got = {(r["t_stat"], r["count"] - 1): r["p_value"] for r in stats.with_p_value(df).collect()}
    for t, n, want in cases:
        assert 0 < got[t, n] <= 1 and (want is None or got[t, n] == pytest.approx(want, rel=1e-7))
    assert got[40.0, 30] < 1e-26 and got[0.3, 251] == pytest.approx(0.76443, abs=1e-5)
    none = spark.createDataFrame([(None, 9), (1.0, 1)], "t_stat double, count long")
    assert [r["p_value"] for r in stats.with_p_value(none).collect()] == [None, None]
    ps = [1e-300, 1e-20, 1e-6, 0.01, 0.07, 0.3, 0.5, 0.77, 0.93, 0.999999]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", stats.normal_quantile(F.col("p")).alias("q")).collect():
        assert r["q"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-13, abs=1e-15)
