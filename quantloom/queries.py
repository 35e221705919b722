"""Registered queries over the supplier panel, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.frames import melted
from quantloom.functions import stats
from quantloom.functions.stats import t_test, with_p_value
from quantloom.operators import events as ev
from quantloom.operators import performance as perf
from quantloom.operators import portfolio as pf
from quantloom.operators import prep
from quantloom.plans import reports, tables
from quantloom.sources import bridge

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

PANEL = """
panel AS (
  SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS date, CAST(l_suppkey AS VARCHAR) AS asset,
         round(avg(l_extendedprice / l_quantity), 6) AS price, round(avg(l_discount), 8) AS factor, any_value(n_name) AS "group"
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2
), ses AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT date FROM panel)),
px AS (SELECT * FROM panel JOIN ses USING (date)),
fr AS (
  SELECT f.*, round((p1.price / f.price - 1) * 1e12) / 1e12 AS r1, round((p5.price / f.price - 1) * 1e12) / 1e12 AS r5, round((p10.price / f.price - 1) * 1e12) / 1e12 AS r10
  FROM px f LEFT JOIN px p1 ON p1.asset = f.asset AND p1.idx = f.idx + 1 LEFT JOIN px p5 ON p5.asset = f.asset AND p5.idx = f.idx + 5
  LEFT JOIN px p10 ON p10.asset = f.asset AND p10.idx = f.idx + 10
)"""
CLEAN = PANEL + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor, "group", asset) - 1 AS rk, count(*) OVER (PARTITION BY date) AS n FROM fr),
bucketed AS (
  SELECT *, CAST(CASE WHEN n < 2 THEN NULL WHEN n >= 5 THEN least(rk * 5 // n, 4) + 1 ELSE floor(rk * 4.0 / (n - 1) + 0.5) + 1 END AS INTEGER) AS factor_quantile FROM ranked
), clean AS (
  SELECT date, asset, factor, "group", factor_quantile, r1, r5, r10 FROM bucketed
  WHERE r1 IS NOT NULL AND r5 IS NOT NULL AND r10 IS NOT NULL AND factor_quantile IS NOT NULL
), long AS (
  SELECT date, asset, factor, "group", factor_quantile, '1D' AS period, r1 AS ret FROM clean
  UNION ALL SELECT date, asset, factor, "group", factor_quantile, '5D', r5 FROM clean
  UNION ALL SELECT date, asset, factor, "group", factor_quantile, '10D', r10 FROM clean
)"""
_CORR = "CASE WHEN count({x}) > 1 AND var_pop({x}) > 0 AND var_pop({y}) > 0 THEN greatest(-1, least(1, covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})))) END"


def _ranked(keys: str, source: str = "long") -> str:
    avg = "rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0"
    return f"rk AS (SELECT *, {avg.format(k=keys, x='factor')} AS rx, {avg.format(k=keys, x='ret')} AS ry FROM {source})"


WEIGHTS = """, sig AS (SELECT *, factor - avg(factor) OVER (PARTITION BY date) AS s FROM clean),
weights AS (SELECT date, asset, "group", s / nullif(sum(abs(s)) OVER (PARTITION BY date), 0) AS weight FROM sig)"""
RETURNS = WEIGHTS + """, freturns AS (SELECT date, period, sum(weight * ret) AS factor_return FROM long JOIN weights USING (date, asset) GROUP BY 1, 2)"""
DEMEANED = """, dm AS (SELECT * REPLACE (ret - avg(ret) OVER (PARTITION BY date, period) AS ret) FROM long),
dayq AS (SELECT date, factor_quantile, period, avg(ret) AS mean_return, stddev_samp(ret) / sqrt(count(ret)) AS std_error, CAST(count(ret) AS INTEGER) AS count FROM dm GROUP BY 1, 2, 3)"""
HELD = """, live AS (SELECT asset, weight, unnest(range(idx, idx + 5)) AS idx FROM weights JOIN axis USING (date)),
held AS (SELECT idx, asset, sum(weight) AS w FROM live GROUP BY 1, 2),
normed AS (SELECT idx, asset, coalesce(w / nullif(sum(abs(w)) OVER (PARTITION BY idx), 0), 0) AS position FROM held),
grid AS (SELECT date, asset, coalesce(position, 0) AS position FROM (SELECT DISTINCT asset FROM weights) CROSS JOIN axis LEFT JOIN normed USING (idx, asset)),
allpos AS (SELECT * FROM grid UNION ALL SELECT date, 'cash', 1 - sum(position) FROM grid GROUP BY 1)"""
AXIS = """, axis AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT date FROM clean))"""
MOVES = """, rets AS (SELECT date, asset, idx, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM px),
axis AS (SELECT date, idx FROM ses)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = "WITH " + sql.strip()
        return f

    return put


@query("d1_forward_returns", PANEL + " SELECT date, asset, r1 AS forward_return_1D, r5 AS forward_return_5D, r10 AS forward_return_10D FROM fr")
def _(spark, sf):
    p = bridge.supplier_panel(spark, sf)
    return prep.compute_forward_returns(bridge.factor_frame(p), bridge.price_frame(p), bridge.PERIODS, check=False)


@query(
    "d1_forward_returns_single_session",
    PANEL + """, o AS (SELECT f.date, f.asset, p4.price AS a, p5.price AS b, p1.price AS c, f.price AS d FROM px f LEFT JOIN px p1 ON p1.asset = f.asset AND p1.idx = f.idx + 1
    LEFT JOIN px p4 ON p4.asset = f.asset AND p4.idx = f.idx + 4 LEFT JOIN px p5 ON p5.asset = f.asset AND p5.idx = f.idx + 5)
    SELECT date, asset, round((c / d - 1) * 1e12) / 1e12 AS forward_return_1D, round((b / a - 1) * 1e12) / 1e12 AS forward_return_5D FROM o""",
)
def _(spark, sf):
    p = bridge.supplier_panel(spark, sf)
    return prep.compute_forward_returns(bridge.factor_frame(p), bridge.price_frame(p), (1, 5), cumulative_returns=False, check=False)


_NEAR = "CASE WHEN abs({0} - avg({0}) OVER w) <= 2 * stddev_samp({0}) OVER w OR coalesce(stddev_samp({0}) OVER w, 0) = 0 THEN {0} END AS {1}"


@query(
    "d2_zscore_filter",
    PANEL + " SELECT date, asset, " + ", ".join(_NEAR.format(f"r{p}", f"forward_return_{p}D") for p in bridge.PERIODS) + " FROM fr WINDOW w AS (PARTITION BY asset)",
)
def _(spark, sf):
    p = bridge.supplier_panel(spark, sf)
    return prep.compute_forward_returns(bridge.factor_frame(p), bridge.price_frame(p), bridge.PERIODS, 2.0, check=False)


def _buckets(**options) -> Query:
    def run(spark, sf):
        factor = bridge.factor_frame(bridge.supplier_panel(spark, sf))
        if options.get("zero_aware"):
            factor = factor.withColumn("factor", F.round(F.col("factor") - 0.05, 8))
        return prep.quantize_factor(factor, check=False, **options).select("date", "asset", "factor_quantile")

    return run


_SHIFT = ", z AS (SELECT date, asset, \"group\", round(factor - 0.05, 8) AS x FROM panel)"
query("d6_equal_count_buckets", CLEAN + " SELECT date, asset, factor_quantile FROM bucketed")(_buckets())
query(
    "d6_equal_count_buckets_by_group",
    PANEL + """, q AS (SELECT date, asset, row_number() OVER (PARTITION BY date, "group" ORDER BY factor, asset) - 1 AS rk, count(*) OVER (PARTITION BY date, "group") AS n FROM panel)
    SELECT date, asset, CAST(CASE WHEN n < 2 THEN NULL WHEN n >= 3 THEN least(rk * 3 // n, 2) + 1 ELSE floor(rk * 2.0 / (n - 1) + 0.5) + 1 END AS INTEGER) AS factor_quantile FROM q""",
)(_buckets(quantiles=3, by_group=True))
query(
    "d7_quantile_edges",
    PANEL + """, e AS (SELECT date, quantile_cont(factor, [0.0, 0.25, 0.5, 0.75, 1.0]) AS c FROM panel GROUP BY 1)
    SELECT date, asset, CAST(CASE WHEN factor >= c[1] AND factor <= c[2] THEN 1 WHEN factor > c[2] AND factor <= c[3] THEN 2 WHEN factor > c[3] AND factor <= c[4] THEN 3 WHEN factor > c[4] AND factor <= c[5] THEN 4 END AS INTEGER) AS factor_quantile
    FROM panel JOIN e USING (date)""",
)(_buckets(quantiles=[0.0, 0.25, 0.5, 0.75, 1.0]))
query(
    "d8_equal_width_bins",
    PANEL + """, e AS (SELECT date, min(factor) AS lo, max(factor) AS hi FROM panel GROUP BY 1)
    SELECT date, asset, CAST(CASE WHEN lo = hi OR factor = lo THEN 1 ELSE least(greatest(ceil((factor - lo) / ((hi - lo) / 4)), 1), 4) END AS INTEGER) AS factor_quantile FROM panel JOIN e USING (date)""",
)(_buckets(quantiles=None, bins=4))
query(
    "d9_value_bins",
    PANEL + " SELECT date, asset, CAST(CASE WHEN factor > 0.02 AND factor <= 0.045 THEN 1 WHEN factor > 0.045 AND factor <= 0.055 THEN 2 WHEN factor > 0.055 AND factor <= 0.08 THEN 3 END AS INTEGER) AS factor_quantile FROM panel",
)(_buckets(quantiles=None, bins=[0.02, 0.045, 0.055, 0.08]))
query(
    "d10_zero_aware_buckets",
    PANEL + _SHIFT + """, q AS (SELECT date, asset, x, row_number() OVER (PARTITION BY date, x >= 0 ORDER BY x, "group", asset) - 1 AS rk, count(*) OVER (PARTITION BY date, x >= 0) AS n FROM z)
    SELECT date, asset, CAST(CASE WHEN n < 2 THEN NULL WHEN n >= 2 THEN least(rk * 2 // n, 1) + 1 END + CASE WHEN x >= 0 THEN 2 ELSE 0 END AS INTEGER) AS factor_quantile FROM q""",
)(_buckets(quantiles=4, zero_aware=True))


@query("d11_clean_factor", CLEAN + ' SELECT date, asset, factor, "group", factor_quantile, r1 AS forward_return_1D, r5 AS forward_return_5D, r10 AS forward_return_10D FROM clean')
def _(spark, sf):
    return bridge.clean_panel(spark, sf)


@query(
    "d13_loss_report",
    CLEAN + """ SELECT count(*) AS input_rows, count(*) FILTER (WHERE r1 IS NOT NULL AND r5 IS NOT NULL AND r10 IS NOT NULL AND factor_quantile IS NOT NULL) AS output_rows,
    count(*) FILTER (WHERE r1 IS NULL OR r5 IS NULL OR r10 IS NULL) AS missing_returns, count(*) FILTER (WHERE factor_quantile IS NULL) AS missing_quantiles FROM bucketed""",
)
def _(spark, sf):
    p = bridge.supplier_panel(spark, sf)
    got = prep.get_clean_factor_and_forward_returns(bridge.factor_frame(p), bridge.price_frame(p), bridge.PERIODS, None, max_loss=1.0).loss
    return spark.createDataFrame([(got.input_rows, got.output_rows, got.missing_returns, got.missing_quantiles)], "input_rows long, output_rows long, missing_returns long, missing_quantiles long")


def on_clean(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql and CLEAN + sql)(lambda spark, sf: f(bridge.clean_panel(spark, sf)))


on_clean("p1_information_coefficient", ", " + _ranked("date, period") + f" SELECT date, period, {_CORR.format(x='rx', y='ry')} AS ic FROM rk GROUP BY 1, 2", perf.factor_information_coefficient)
on_clean(
    "p1_information_coefficient_by_group",
    ', a AS (SELECT * REPLACE (ret - avg(ret) OVER (PARTITION BY date, "group", period) AS ret) FROM long), ' + _ranked('date, "group", period', "a") + f' SELECT date, "group", period, {_CORR.format(x="rx", y="ry")} AS ic FROM rk GROUP BY 1, 2, 3',
    lambda d: perf.factor_information_coefficient(d, group_adjust=True, by_group=True),
)
for _by, _bucket in (("daily", "CAST(date AS DATE)"), ("weekly", "CAST(date_trunc('week', date) AS DATE) + 6"), ("monthly", "CAST(date_trunc('month', date) AS DATE)")):
    on_clean(
        f"p2_mean_ic_{_by}",
        ", " + _ranked("date, period") + f", i AS (SELECT date, period, {_CORR.format(x='rx', y='ry')} AS ic FROM rk GROUP BY 1, 2) SELECT {_bucket} AS date, period, avg(ic) AS mean_ic, CAST(count(ic) AS INTEGER) AS count FROM i WHERE ic IS NOT NULL GROUP BY 1, 2",
        lambda d, by=_by: perf.mean_information_coefficient(d, by_time=by),
    )
on_clean("p4_factor_weights", WEIGHTS + " SELECT * FROM weights", perf.factor_weights)
on_clean(
    "p5_equal_weights",
    """, m AS (SELECT *, median(factor) OVER (PARTITION BY date) AS mid FROM clean), s AS (SELECT *, CASE WHEN factor > mid THEN 0.5 / count(*) FILTER (WHERE factor > mid) OVER (PARTITION BY date)
    WHEN factor < mid THEN -0.5 / count(*) FILTER (WHERE factor < mid) OVER (PARTITION BY date) ELSE 0 END AS s FROM m)
    SELECT date, asset, "group", s / nullif(sum(abs(s)) OVER (PARTITION BY date), 0) AS weight FROM s""",
    lambda d: perf.factor_weights(d, equal_weight=True),
)
on_clean(
    "p6_group_adjusted_weights",
    """, s AS (SELECT *, factor - avg(factor) OVER (PARTITION BY date, "group") AS s FROM clean), w AS (SELECT date, asset, "group", s / nullif(sum(abs(s)) OVER (PARTITION BY date, "group"), 0) AS w FROM s),
    c AS (SELECT date, count(DISTINCT "group") FILTER (WHERE w IS NOT NULL) AS n FROM w GROUP BY 1) SELECT date, asset, "group", w / nullif(n, 0) AS weight FROM w JOIN c USING (date)""",
    lambda d: perf.factor_weights(d, group_adjust=True),
)
on_clean("p7_factor_returns", RETURNS + " SELECT * FROM freturns", perf.factor_returns)
on_clean("p7_factor_returns_by_asset", WEIGHTS + " SELECT date, asset, period, weight * ret AS weighted_return FROM long JOIN weights USING (date, asset)", lambda d: perf.factor_returns(d, by_asset=True))
on_clean(
    "p8_alpha_beta",
    RETURNS + """, u AS (SELECT date, period, avg(ret) AS x FROM long GROUP BY 1, 2), f AS (SELECT period, regr_intercept(factor_return, x) AS alpha, regr_slope(factor_return, x) AS beta, CAST(regr_count(factor_return, x) AS INTEGER) AS count FROM freturns JOIN u USING (date, period) GROUP BY 1)
    SELECT period, alpha, CASE WHEN alpha > -1 THEN pow(1 + alpha, 252.0 / CAST(replace(period, 'D', '') AS INTEGER)) - 1 END AS annualized_alpha, beta, count FROM f""",
    perf.factor_alpha_beta,
)
on_clean(
    "p9_mean_return_by_quantile",
    DEMEANED + " SELECT factor_quantile, period, avg(mean_return) AS mean_return, stddev_samp(mean_return) / sqrt(count(mean_return)) AS std_error, CAST(count(mean_return) AS INTEGER) AS count FROM dayq GROUP BY 1, 2",
    perf.mean_return_by_quantile,
)
on_clean("p9_mean_return_by_quantile_by_date", DEMEANED + " SELECT * FROM dayq", lambda d: perf.mean_return_by_quantile(d, by_date=True))
on_clean(
    "p9_mean_return_by_quantile_by_group",
    """, dg AS (SELECT * REPLACE (ret - avg(ret) OVER (PARTITION BY date, "group", period) AS ret) FROM long), q AS (SELECT date, factor_quantile, "group", period, avg(ret) AS m FROM dg GROUP BY 1, 2, 3, 4)
    SELECT factor_quantile, "group", period, avg(m) AS mean_return, stddev_samp(m) / sqrt(count(m)) AS std_error, CAST(count(m) AS INTEGER) AS count FROM q GROUP BY 1, 2, 3""",
    lambda d: perf.mean_return_by_quantile(d, by_group=True, group_adjust=True),
)
on_clean(
    "p10_returns_spread",
    DEMEANED + """ SELECT date, period, u.mean_return - l.mean_return AS mean_return_difference, sqrt(u.std_error * u.std_error + l.std_error * l.std_error) AS joint_std_error
    FROM dayq u JOIN dayq l USING (date, period) WHERE u.factor_quantile = 5 AND l.factor_quantile = 1""",
    lambda d: perf.compute_mean_returns_spread(perf.mean_return_by_quantile(d, by_date=True), 5, 1),
)
on_clean(
    "p11_quantile_turnover",
    AXIS + """, m AS (SELECT idx, asset FROM clean JOIN axis USING (date) WHERE factor_quantile = 5), t AS (SELECT m.idx, avg(CASE WHEN o.asset IS NULL THEN 1 ELSE 0 END) AS s FROM m LEFT JOIN m o ON o.asset = m.asset AND o.idx = m.idx - 2 GROUP BY 1)
    SELECT date, CAST(5 AS INTEGER) AS factor_quantile, '2D' AS period, CASE WHEN idx >= 2 THEN s END AS turnover FROM axis LEFT JOIN t USING (idx)""",
    lambda d: perf.quantile_turnover(d, 5, 2),
)
on_clean(
    "p12_rank_autocorrelation",
    AXIS + f""", r AS (SELECT idx, asset, rank() OVER (PARTITION BY date ORDER BY factor) + (count(*) OVER (PARTITION BY date, factor) - 1) / 2.0 AS r FROM clean JOIN axis USING (date)),
    j AS (SELECT a.idx, a.r AS rx, b.r AS ry FROM r a JOIN r b ON b.asset = a.asset AND b.idx = a.idx - 1), c AS (SELECT idx, {_CORR.format(x='rx', y='ry')} AS c FROM j GROUP BY 1)
    SELECT date, '1D' AS period, c AS autocorrelation FROM axis LEFT JOIN c USING (idx)""",
    lambda d: perf.factor_rank_autocorrelation(d, 1),
)
on_clean(
    "p14_cumulative_returns",
    RETURNS + " SELECT date, period, product(1 + coalesce(factor_return, 0)) OVER (PARTITION BY period ORDER BY date) AS cumulative_return FROM freturns",
    lambda d: pf.cumulative_returns(perf.factor_returns(d)),
)
on_clean("p15_positions", WEIGHTS + AXIS + HELD + " SELECT * FROM allpos", lambda d: pf.factor_positions(d, 5, check=False))
on_clean(
    "p16_factor_cumulative_returns",
    """, k AS (SELECT * FROM clean WHERE factor_quantile IN (1, 5)), s AS (SELECT *, factor - avg(factor) OVER (PARTITION BY date) AS s FROM k), w AS (SELECT date, s / nullif(sum(abs(s)) OVER (PARTITION BY date), 0) * r5 AS x FROM s),
    f AS (SELECT date, sum(x) AS r FROM w GROUP BY 1) SELECT date, '5D' AS period, product(1 + coalesce(r, 0)) OVER (ORDER BY date) AS cumulative_return FROM f""",
    lambda d: pf.factor_cumulative_returns(d, 5, quantiles=[1, 5], check=False),
)
#: Weights without short sides: sleeves can't lose more than they hold, which the small panel's long-short ones can.
_LONG = """, weights AS (SELECT date, asset, factor / nullif(sum(abs(factor)) OVER (PARTITION BY date), 0) AS weight FROM clean),
freturns AS (SELECT date, sum(weight * r5) AS factor_return FROM clean JOIN weights USING (date, asset) GROUP BY 1)"""
_SLEEVES = _LONG + AXIS + """, sl AS (SELECT idx, pow(1 + factor_return, 1 / 5.0) - 1 AS d FROM freturns JOIN axis USING (date) WHERE factor_return IS NOT NULL),
lv AS (SELECT idx, avg(d) AS d FROM (SELECT unnest(range(idx, idx + 5)) AS idx, d FROM sl) GROUP BY 1),
wealth AS (SELECT date, idx, coalesce(product(1 + coalesce(d, 0)) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS cumulative_return FROM axis LEFT JOIN lv USING (idx))"""
on_clean("p18_pyfolio_returns", _SLEEVES + ' SELECT date, coalesce(cumulative_return / lag(cumulative_return) OVER (ORDER BY date) - 1, 0) AS "return" FROM wealth', lambda d: pf.create_pyfolio_input(d, 5, long_short=False, check=False).returns)
on_clean(
    "p18_pyfolio_positions",
    _SLEEVES + HELD + " SELECT date, asset, position * cumulative_return * 1000000 AS position FROM allpos JOIN wealth USING (date)",
    lambda d: pf.create_pyfolio_input(d, 5, 1_000_000.0, long_short=False, check=False).positions,
)
on_clean(
    "p18_pyfolio_benchmark",
    """, w AS (SELECT date, sign(factor) / nullif(sum(abs(sign(factor))) OVER (PARTITION BY date), 0) * r1 AS x FROM clean), f AS (SELECT date, sum(x) AS r FROM w GROUP BY 1),
    g AS (SELECT date, product(1 + coalesce(r, 0)) OVER (ORDER BY date) AS c FROM f) SELECT date, coalesce(c / lag(c) OVER (ORDER BY date) - 1, 0) AS benchmark FROM g""",
    lambda d: pf.create_pyfolio_input(d, 1, check=False).benchmark,
)
on_clean(
    "v7_group_filter",
    """, k AS (SELECT * FROM clean WHERE "group" IN ('NATION_1', 'NATION_2', 'NATION_3')), s AS (SELECT *, factor - avg(factor) OVER (PARTITION BY date) AS s FROM k), w AS (SELECT date, s / nullif(sum(abs(s)) OVER (PARTITION BY date), 0) * r1 AS x FROM s),
    f AS (SELECT date, sum(x) AS r FROM w GROUP BY 1) SELECT date, '1D' AS period, product(1 + coalesce(r, 0)) OVER (ORDER BY date) AS cumulative_return FROM f""",
    lambda d: pf.factor_cumulative_returns(d, 1, groups=["NATION_1", "NATION_2", "NATION_3"], check=False),
)
on_clean("p19_overlapping_wealth", _SLEEVES + " SELECT date, cumulative_return FROM wealth", lambda d: pf.overlapping_daily_wealth(perf.factor_returns(d, demeaned=False).where("period = '5D'"), 5))

_PATHS = MOVES + """, dense AS (
  SELECT asset, idx, product(1 + coalesce(r, 0)) OVER (PARTITION BY asset ORDER BY idx) AS w FROM (SELECT DISTINCT asset FROM clean) CROSS JOIN axis LEFT JOIN (SELECT asset, idx, r FROM rets) USING (asset, idx)
), e AS (
  SELECT c.date, c.asset, c."group", c.factor_quantile, t.idx - b.idx AS off, t.w / b.w - 1 AS v
  FROM clean c JOIN axis a USING (date) JOIN dense b ON b.asset = c.asset AND b.idx = a.idx JOIN dense t ON t.asset = c.asset AND t.idx BETWEEN a.idx - 3 AND a.idx + 5
)"""


def _moves(spark: SparkSession, sf: str) -> DataFrame:
    return perf.prices_to_returns(bridge.price_frame(bridge.supplier_panel(spark, sf)))


@query(
    "p20_event_returns",
    CLEAN + _PATHS + """, p AS (SELECT date, factor_quantile, off, avg(v) AS v FROM e GROUP BY 1, 2, 3), u AS (SELECT date, off, avg(v) AS m FROM e GROUP BY 1, 2)
    SELECT factor_quantile, off AS "offset", avg(v - m) AS mean_cumulative_return, stddev_samp(v - m) AS std_cumulative_return, count(*) AS count FROM p JOIN u USING (date, off) GROUP BY 1, 2""",
)
def _(spark, sf):
    return ev.average_cumulative_return_by_quantile(bridge.clean_panel(spark, sf), _moves(spark, sf), 3, 5, check=False)


@query(
    "p21_event_returns_by_group",
    CLEAN + _PATHS + """, g AS (SELECT *, v - avg(v) OVER (PARTITION BY date, "group", off) AS d FROM e), p AS (SELECT date, factor_quantile, "group", off, avg(d) AS d FROM g GROUP BY 1, 2, 3, 4)
    SELECT factor_quantile, "group", off AS "offset", avg(d) AS mean_cumulative_return, stddev_samp(d) AS std_cumulative_return, count(*) AS count FROM p GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return ev.average_cumulative_return_by_quantile(bridge.clean_panel(spark, sf), _moves(spark, sf), 3, 5, group_adjust=True, by_group=True, check=False)


@query(
    "p22_event_coverage",
    CLEAN + MOVES + """, c2 AS (SELECT *, (SELECT max(idx) FROM axis) AS last FROM clean JOIN axis USING (date)), miss AS (SELECT asset, a.idx FROM (SELECT DISTINCT asset FROM clean) CROSS JOIN axis a LEFT JOIN rets r USING (asset, idx) WHERE r.r IS NULL),
    offs AS (SELECT CAST(unnest(range(-3, 6)) AS INTEGER) AS o), x AS (SELECT date, asset, factor_quantile, o, idx + o AS t FROM c2 CROSS JOIN offs WHERE idx + o BETWEEN 0 AND last)
    SELECT 'overall' AS scope, CAST(NULL AS INTEGER) AS "offset", (SELECT count(*) FROM clean) AS input_events, (SELECT count(*) FROM clean) AS used_events, CAST(0 AS BIGINT) AS skipped_missing_date, (SELECT count(*) FROM miss) AS imputed_return_cells, CAST(0 AS BIGINT) AS path_count
    UNION ALL SELECT 'offset', o, (SELECT count(*) FROM clean), count(x.date), 0, count(m.asset), count(DISTINCT (x.date, factor_quantile)) FROM x LEFT JOIN miss m ON m.asset = x.asset AND m.idx = x.t GROUP BY o""",
)
def _(spark, sf):
    return ev.event_window(bridge.clean_panel(spark, sf), _moves(spark, sf), 3, 5, demeaned=False, check=False).coverage


_START = MOVES + """, cum AS (SELECT asset, idx, product(1 + coalesce(r, 0)) OVER (PARTITION BY asset ORDER BY idx) AS v FROM rets),
al AS (SELECT c.date, c.factor_quantile, t.idx - a.idx AS off, t.v FROM clean c JOIN axis a USING (date) JOIN cum t ON t.asset = c.asset AND t.idx BETWEEN a.idx - 3 AND a.idx + 5 WHERE t.v IS NOT NULL)"""


@query("p23_common_start_returns", CLEAN + _START + ' SELECT off AS "offset", avg(v) AS mean, stddev_samp(v) AS std, count(*) AS count FROM al GROUP BY 1')
def _(spark, sf):
    return ev.common_start_returns(bridge.clean_panel(spark, sf), _moves(spark, sf), 3, 5, check=False)


@query(
    "p24_event_returns_from_values",
    CLEAN + _START.replace("product(1 + coalesce(r, 0)) OVER (PARTITION BY asset ORDER BY idx)", "r") + """, d AS (SELECT *, v - avg(v) OVER (PARTITION BY date, off) AS d FROM al), p AS (SELECT date, factor_quantile, off, avg(d) AS d FROM d GROUP BY 1, 2, 3)
    SELECT factor_quantile, off AS "offset", avg(d) AS mean_cumulative_return, stddev_samp(d) AS std_cumulative_return, count(*) AS count FROM p GROUP BY 1, 2""",
)
def _(spark, sf):
    return ev.average_cumulative_return_by_quantile_from_prices(bridge.clean_panel(spark, sf), _moves(spark, sf), 3, 5, check=False)


@query(
    "d1_sparse_user_panel",
    """panel AS (SELECT date_trunc('day', ts)::TIMESTAMP AS date, CAST(user_id AS VARCHAR) AS asset, round(sum(value) + 1, 6) AS price FROM events GROUP BY 1, 2),
    ses AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM panel)), px AS (SELECT * FROM panel JOIN ses USING (date))
    SELECT f.date, f.asset, round((a.price / f.price - 1) * 1e12) / 1e12 AS forward_return_1D, round((b.price / f.price - 1) * 1e12) / 1e12 AS forward_return_3D
    FROM px f LEFT JOIN px a ON a.asset = f.asset AND a.idx = f.idx + 1 LEFT JOIN px b ON b.asset = f.asset AND b.idx = f.idx + 3""",
)
def _(spark, sf):
    p = bridge.user_day_panel(spark, sf)
    return prep.compute_forward_returns(p.select("date", "asset", "factor"), bridge.price_frame(p), (1, 3), check=False)


on_clean(
    "w1_demeaned_forward_returns",
    " SELECT date, asset, r1 - avg(r1) OVER (PARTITION BY date) AS forward_return_1D, r5 - avg(r5) OVER (PARTITION BY date) AS forward_return_5D, r10 - avg(r10) OVER (PARTITION BY date) AS forward_return_10D FROM clean",
    lambda d: perf.demean_forward_returns(d).select("date", "asset", "forward_return_1D", "forward_return_5D", "forward_return_10D"),
)
query("w2_prices_to_returns", PANEL + ' SELECT date, asset, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS "return" FROM px')(_moves)
on_clean(
    "w10_backshift_series",
    RETURNS + AXIS + " SELECT a.date, f.period, f.factor_return FROM freturns f JOIN axis l ON l.date = f.date JOIN axis a ON a.idx = l.idx - 2",
    lambda d: perf.backshift_returns_series(perf.factor_returns(d), 2, "factor_return"),
)
on_clean("v10_melt", " SELECT date, asset, period, ret FROM long", lambda d: melted(d, bridge.PERIODS, ["date", "asset"]))
on_clean(
    "r8_quantile_statistics",
    """ SELECT factor_quantile, min(factor) AS min, max(factor) AS max, avg(factor) AS mean, stddev_samp(factor) AS std, count(*) AS count, count(*) / CAST((SELECT count(*) FROM clean) AS DOUBLE) AS count_percent FROM clean GROUP BY 1""",
    tables.quantile_statistics,
)
on_clean(
    "r2_ic_rolling",
    ", " + _ranked("date, period") + f""", i AS (SELECT date, period, {_CORR.format(x='rx', y='ry')} AS ic FROM rk GROUP BY 1, 2)
    SELECT date, period, CASE WHEN count(ic) OVER w = 22 THEN avg(ic) OVER w END AS mean_ic, count(ic) OVER w AS count FROM i WINDOW w AS (PARTITION BY period ORDER BY date ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)""",
    lambda d: tables.rolling_mean(perf.factor_information_coefficient(d), 22),
)
on_clean(
    "a7_ic_summary",
    ", " + _ranked("date, period") + f""", i AS (SELECT date, period, {_CORR.format(x='rx', y='ry')} AS ic FROM rk GROUP BY 1, 2), m AS (SELECT *, avg(ic) OVER (PARTITION BY period) AS mu FROM i)
    SELECT period, avg(ic) AS mean, stddev_samp(ic) AS std, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t_stat, avg(pow(ic - mu, 3)) / pow(var_pop(ic), 1.5) AS skew, avg(pow(ic - mu, 4)) / pow(var_pop(ic), 2) - 3 AS excess_kurtosis, count(ic) AS count FROM m GROUP BY 1""",
    lambda d: t_test(perf.factor_information_coefficient(d), ["period"], "ic"),
)
#: The p-value of s (t_stat, count and more): the continued fraction of the incomplete beta function, and a series for the ratio of gamma functions.
_EVEN, _ODD = "(r.m * (q - r.m) * v / ((p + 2 * r.m - 1) * (p + 2 * r.m)))", "(-(p + r.m) * (p + q + r.m) * v / ((p + 2 * r.m) * (p + 2 * r.m + 1)))"
_C1, _D1 = f"(1 + {_EVEN} / s.c)", f"(1 / (1 + {_EVEN} * s.d))"
_C2, _D2 = f"(1 + {_ODD} / {_C1})", f"(1 / (1 + {_ODD} * {_D1}))"
_FIRST = "1 / (1 - (p + q) * v / (p + 1))"
P_VALUES = f""", z AS (SELECT *, (count - 1) / 2.0::DOUBLE AS a, (count - 1) / (count - 1 + t_stat * t_stat) AS x, t_stat * t_stat / (count - 1 + t_stat * t_stat) AS y FROM s),
sides AS (SELECT *, x > (a + 1) / (a + 2.5) AS near, CASE WHEN x > (a + 1) / (a + 2.5) THEN 0.5::DOUBLE ELSE a END AS p, CASE WHEN x > (a + 1) / (a + 2.5) THEN a ELSE 0.5::DOUBLE END AS q, CASE WHEN x > (a + 1) / (a + 2.5) THEN y ELSE x END AS v FROM z),
tails AS (SELECT *, list_reduce(list_transform(range(0, 101 + CAST(ceil(5 * sqrt(a)) AS BIGINT)), lambda i: {{'m': i::DOUBLE, 'c': 1.0::DOUBLE, 'd': {_FIRST}, 'o': {_FIRST}}}),
    lambda s, r: {{'m': r.m, 'c': {_C2}, 'd': {_D2}, 'o': s.o * {_C1} * {_D1} * {_C2} * {_D2}}}).o AS fraction,
  sqrt(a + 64) * (1 - 1 / (8 * (a + 64)) + 1 / (128 * pow(a + 64, 2)) + 5 / (1024 * pow(a + 64, 3)) - 21 / (32768 * pow(a + 64, 4)) - 399 / (262144 * pow(a + 64, 5))) * list_product(list_transform(range(0, 64), lambda i: (a + i) / (a + i + 0.5))) AS gammas
  FROM sides),
pv AS (SELECT *, CASE WHEN t_stat = 0 THEN 1 WHEN near THEN 1 - exp(a * ln(x) + ln(y) / 2) * gammas / sqrt(pi()) / p * fraction ELSE exp(a * ln(x) + ln(y) / 2) * gammas / sqrt(pi()) / p * fraction END AS p_value FROM tails)"""
_SUMMARY = _SQL["a7_ic_summary"].removeprefix("WITH ")
_AT = _SUMMARY.index("    SELECT period, avg(ic) AS mean")
on_clean("a7_ic_p_values", (_SUMMARY[:_AT] + f", s AS ({_SUMMARY[_AT:].strip()})" + P_VALUES + " SELECT period, mean, std, t_stat, skew, excess_kurtosis, count, p_value FROM pv").removeprefix(CLEAN.strip()), lambda d: with_p_value(t_test(perf.factor_information_coefficient(d), ["period"], "ic")))
_FIT = """, u AS (SELECT date, period, avg(ret) AS x FROM long GROUP BY 1, 2), ab AS (SELECT period, regr_intercept(factor_return, x) AS alpha, regr_slope(factor_return, x) AS beta, CAST(regr_count(factor_return, x) AS BIGINT) AS count FROM freturns JOIN u USING (date, period) GROUP BY 1)"""
on_clean(
    "r1_returns_summary",
    RETURNS + DEMEANED + _FIT + """, mq AS (SELECT factor_quantile, period, avg(mean_return) AS m, count(mean_return) AS c FROM dayq GROUP BY 1, 2),
    rq AS (SELECT factor_quantile, period, c, CASE WHEN period = '1D' THEN m WHEN 1 + m >= 0 THEN pow(1 + m, 1.0 / CAST(rtrim(period, 'D') AS INTEGER)) - 1 END AS m FROM mq),
    o AS (SELECT t.period, t.m AS top, t.c AS nt, b.m AS bottom, b.c AS nb FROM rq t JOIN rq b ON t.period = b.period AND t.factor_quantile = 5 AND b.factor_quantile = 1)
    SELECT 'alpha_raw' AS metric, period, alpha AS value, count FROM ab
    UNION ALL SELECT 'alpha_annualized', period, CASE WHEN alpha > -1 THEN pow(1 + alpha, 252.0 / CAST(rtrim(period, 'D') AS INTEGER)) - 1 END, count FROM ab
    UNION ALL SELECT 'beta', period, beta, count FROM ab UNION ALL SELECT 'top_quantile_mean', period, top, nt FROM o
    UNION ALL SELECT 'bottom_quantile_mean', period, bottom, nb FROM o UNION ALL SELECT 'mean_spread', period, top - bottom, least(nt, nb) FROM o""",
    lambda d: reports.create_returns_tear_sheet_data(d).table("returns.summary"),
)
on_clean(
    "a15_ic_histogram",
    ", " + _ranked("date, period") + f""", i AS (SELECT date, period, {_CORR.format(x='rx', y='ry')} AS ic FROM rk GROUP BY 1, 2)
    SELECT period, CAST(least(floor(round((ic + 1) / 2 * 20, 9)), 19) AS INTEGER) AS bin, count(*) AS count FROM i WHERE ic IS NOT NULL GROUP BY 1, 2""",
    lambda d: tables.ic_histogram(perf.factor_information_coefficient(d)),
)

IC = ", " + _ranked("date, period") + f""", i AS (SELECT date, period, {_CORR.format(x='rx', y='ry')} AS ic FROM rk GROUP BY 1, 2)"""
# The period by which rates are stated is the shortest, one session.
RATES = """, rate AS (SELECT * REPLACE (CASE WHEN period = '1D' THEN mean_return WHEN 1 + mean_return >= 0 THEN pow(1 + mean_return, 1.0 / CAST(rtrim(period, 'D') AS INTEGER)) - 1 END AS mean_return,
std_error / sqrt(CAST(rtrim(period, 'D') AS INTEGER)) AS std_error) FROM dayq)"""
on_clean(
    "r1_quantile_cumulative",
    DEMEANED + " SELECT date, factor_quantile, product(1 + coalesce(mean_return, 0)) OVER (PARTITION BY factor_quantile ORDER BY date ROWS UNBOUNDED PRECEDING) AS cumulative_return FROM dayq WHERE period = '1D'",
    lambda d: reports.create_returns_tear_sheet_data(d).table("returns.quantile_cumulative_1d"),
)
on_clean(
    "r1_daily_spread",
    DEMEANED + RATES + """ SELECT date, period, u.mean_return - l.mean_return AS mean_return_difference, sqrt(u.std_error * u.std_error + l.std_error * l.std_error) AS joint_std_error
    FROM rate u JOIN rate l USING (date, period) WHERE u.factor_quantile = 5 AND l.factor_quantile = 1""",
    lambda d: reports.create_returns_tear_sheet_data(d).table("returns.daily_spread"),
)
on_clean("r2_ic_monthly", IC + " SELECT date_trunc('month', date)::TIMESTAMP AS date, period, avg(ic) AS mean_ic, CAST(count(ic) AS INTEGER) AS count FROM i WHERE ic IS NOT NULL GROUP BY 1, 2", lambda d: reports.create_information_tear_sheet_data(d).table("information.ic_monthly"))
on_clean(
    "r2_ic_summary",
    IC + """, m AS (SELECT *, avg(ic) OVER (PARTITION BY period) AS mu FROM i)
    SELECT period, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / stddev_samp(ic) AS risk_adjusted_ic, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t_stat, avg(pow(ic - mu, 3)) / pow(var_pop(ic), 1.5) AS skew,
    avg(pow(ic - mu, 4)) / pow(var_pop(ic), 2) - 3 AS excess_kurtosis, count(ic) AS count FROM m GROUP BY 1""",
    lambda d: reports.create_information_tear_sheet_data(d).table("information.summary").drop("p_value"),
)
on_clean(
    "r2_qq_observed",
    IC + """ SELECT period, CAST(row_number() OVER (PARTITION BY period ORDER BY ic) - 1 AS INTEGER) AS position, (ic - avg(ic) OVER (PARTITION BY period)) / stddev_samp(ic) OVER (PARTITION BY period) AS observed FROM i WHERE ic IS NOT NULL""",
    lambda d: reports.create_information_tear_sheet_data(d).table("information.qq_normal").drop("theoretical"),
)


def _polynomial(parts: tuple[float, ...], r: str) -> str:
    return reduce(lambda acc, c: f"({acc} * {r} + {c!r}::DOUBLE)", parts[1:], f"{parts[0]!r}::DOUBLE")


def _normal_sql(p: str) -> str:
    """The normal quantile of p, by the coefficients of the operator."""
    over = lambda parts, r: f"{_polynomial(parts[0], r)} / {_polynomial(parts[1], r)}"
    q, tail = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    outer = f"sign({q}) * CASE WHEN {tail} <= 5 THEN {over(stats.NORMAL_SIDE, f'({tail} - 1.6)')} ELSE {over(stats.NORMAL_TAIL, f'({tail} - 5.0)')} END"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {over(stats.NORMAL_CENTRE, f'(0.180625 - {q} * {q})')} ELSE {outer} END"


_QQ = _SQL["r2_qq_observed"].removeprefix("WITH ").removeprefix(CLEAN.strip())
on_clean(
    "r2_qq_normal",
    _QQ[: _QQ.index(" SELECT period, CAST(row_number()")] + f""", qq AS ({_QQ[_QQ.index(" SELECT period, CAST(row_number()"):]}), pl AS (SELECT *, (position + 0.5) / count(*) OVER (PARTITION BY period) AS p FROM qq)
    SELECT period, position, {_normal_sql("p")} AS theoretical, observed FROM pl""",
    lambda d: reports.create_information_tear_sheet_data(d).table("information.qq_normal"),
)
on_clean(
    "r3_mean_turnover",
    AXIS + """, m AS (SELECT idx, asset, factor_quantile FROM clean JOIN axis USING (date)), lag AS (SELECT unnest([1, 3]) AS k),
    t AS (SELECT m.factor_quantile, k, m.idx, avg(CASE WHEN o.asset IS NULL THEN 1 ELSE 0 END) AS s FROM m JOIN lag ON m.idx >= k LEFT JOIN m o ON o.asset = m.asset AND o.factor_quantile = m.factor_quantile AND o.idx = m.idx - k GROUP BY 1, 2, 3)
    SELECT factor_quantile, k || 'D' AS period, avg(s) AS turnover, count(s) AS count FROM t GROUP BY 1, 2""",
    lambda d: reports.create_turnover_tear_sheet_data(d, [1, 3]).table("turnover.mean_by_quantile"),
)


@query(
    "r6_event_returns_table",
    CLEAN + _PATHS + """, p AS (SELECT date, factor_quantile, off, avg(v) AS v FROM e GROUP BY 1, 2, 3), u AS (SELECT date, off, avg(v) AS m FROM e GROUP BY 1, 2)
    SELECT factor_quantile, off AS "offset", avg(v - m) AS mean_cumulative_return, stddev_samp(v - m) AS std_cumulative_return, count(*) AS count FROM p JOIN u USING (date, off) GROUP BY 1, 2""",
)
def _(spark, sf):
    return reports.create_event_returns_tear_sheet_data(bridge.clean_panel(spark, sf), bridge.price_frame(bridge.supplier_panel(spark, sf)), (3, 5)).table("events.average_cumulative_returns")


on_clean(
    "r7_event_distribution",
    """, b AS (SELECT min(epoch_us(date)) AS lo, max(epoch_us(date)) AS hi FROM clean), e AS (SELECT i AS bin, lo + (hi - lo) * i // 50 AS start, lo + (hi - lo) * (i + 1) // 50 AS stop FROM b, range(50) r(i))
    SELECT CAST(bin AS INTEGER) AS bin, start, stop AS "end", count(date) AS count FROM e LEFT JOIN clean ON epoch_us(date) >= start AND (epoch_us(date) < stop OR (bin = 49 AND epoch_us(date) = stop)) GROUP BY 1, 2, 3""",
    lambda d: reports.create_event_study_tear_sheet_data(d).table("events.distribution"),
)
on_clean(
    "s4_statistics_from_json",
    """ SELECT factor_quantile, min(factor) AS min, max(factor) AS max, avg(factor) AS mean, stddev_samp(factor) AS std, count(*) AS count, count(*) / CAST((SELECT count(*) FROM clean) AS DOUBLE) AS count_percent FROM clean GROUP BY 1""",
    lambda d: reports.TearSheetData.from_json(reports.create_summary_tear_sheet_data(d).to_json()).table("quantile.statistics"),
)

_RATE = "CASE WHEN period = '1D' THEN mean_return WHEN 1 + mean_return >= 0 THEN pow(1 + mean_return, 1.0 / CAST(rtrim(period, 'D') AS INTEGER)) - 1 END"
_TURNOVER = _SQL["r3_mean_turnover"].replace("unnest([1, 3])", "unnest([1, 5, 10])")
_SERIES = _TURNOVER[: _TURNOVER.index("SELECT factor_quantile, k ||")] + """SELECT date, g.factor_quantile, g.k || 'D' AS period, s AS turnover FROM (SELECT * FROM axis, (SELECT DISTINCT factor_quantile FROM clean), lag) g LEFT JOIN t ON t.factor_quantile = g.factor_quantile AND t.k = g.k AND t.idx = g.idx"""
_AUTO = "WITH " + CLEAN + AXIS + f""", r AS (SELECT idx, asset, rank() OVER (PARTITION BY date ORDER BY factor) + (count(*) OVER (PARTITION BY date, factor) - 1) / 2.0 AS r FROM clean JOIN axis USING (date)), lag AS (SELECT unnest([1, 5, 10]) AS k),
j AS (SELECT a.idx, k, a.r AS rx, b.r AS ry FROM r a, lag, r b WHERE b.asset = a.asset AND b.idx = a.idx - k), c AS (SELECT idx, k, {_CORR.format(x='rx', y='ry')} AS c FROM j GROUP BY 1, 2)
SELECT date, lag.k || 'D' AS period, c AS autocorrelation FROM (SELECT * FROM axis, lag) lag LEFT JOIN c ON c.idx = lag.idx AND c.k = lag.k"""
#: Tables of the full report: their SQL and sort keys.
_FULL = {
    "quantile.statistics": (_SQL["r8_quantile_statistics"], "factor_quantile"),
    "returns.summary": (_SQL["r1_returns_summary"], "metric, period"),
    "returns.mean_by_quantile": (f"SELECT factor_quantile, period, {_RATE} AS mean_return, std_error / sqrt(CAST(rtrim(period, 'D') AS INTEGER)) AS std_error, count FROM ({_SQL['p9_mean_return_by_quantile']})", "factor_quantile, period"),
    "returns.daily_by_quantile": ("WITH " + CLEAN + DEMEANED + RATES + " SELECT * FROM rate", "date, factor_quantile, period"),
    "returns.daily_spread": (_SQL["r1_daily_spread"], "date, period"),
    "returns.factor_returns": (_SQL["p7_factor_returns"], "date, period"),
    "information.summary": ("SELECT period, mean AS ic_mean, std AS ic_std, mean / std AS risk_adjusted_ic, t_stat, p_value, skew, excess_kurtosis, count FROM (" + _SQL["a7_ic_p_values"] + ")", "period"),
    "information.ic_by_date": (_SQL["p1_information_coefficient"], "date, period"),
    "information.ic_rolling": (_SQL["r2_ic_rolling"], "date, period"),
    "information.ic_monthly": (_SQL["r2_ic_monthly"], "date, period"),
    "information.qq_normal": (_SQL["r2_qq_normal"], "period, position"),
    "turnover.mean_by_quantile": (_TURNOVER, "factor_quantile, period"),
    "turnover.mean_rank_autocorrelation": (f"SELECT period, avg(autocorrelation) AS autocorrelation, count(autocorrelation) AS count FROM ({_AUTO}) GROUP BY 1", "period"),
    "turnover.quantile_series": (_SERIES, "date, factor_quantile, period"),
    "turnover.rank_autocorrelation_series": (_AUTO, "date, period"),
    "returns.factor_cumulative_1d": (f"SELECT date, cumulative_return FROM ({_SQL['p14_cumulative_returns']}) WHERE period = '1D'", "date"),
    "returns.quantile_cumulative_1d": (_SQL["r1_quantile_cumulative"], "date, factor_quantile"),
}


def _cells(id: str, sql: str, keys: str) -> str:
    """The cells of a table's SQL: every column becomes rows, by DuckDB's unpivot."""
    return f"""SELECT '{id}' AS table_id, CAST(row AS BIGINT) AS row, "column", CASE WHEN "column" NOT IN ('metric', 'period') THEN CAST(nullif(x, '-') AS DOUBLE) END AS value, CASE WHEN "column" IN ('metric', 'period') THEN x END AS text
    FROM (UNPIVOT (SELECT row, coalesce(CAST(COLUMNS(* EXCLUDE (row)) AS VARCHAR), '-') FROM (SELECT * REPLACE ({"epoch_us(date) AS date" if "date" in keys else "row AS row"}) FROM (SELECT *, row_number() OVER (ORDER BY {keys}) - 1 AS row FROM ({sql})))) ON * EXCLUDE (row) INTO NAME "column" VALUE x)"""


query("r5_full_report_tables", "nothing AS (SELECT 1) " + " UNION ALL ".join(_cells(id, *x) for id, x in _FULL.items()))(lambda spark, sf: reports.create_full_tear_sheet_data(bridge.clean_panel(spark, sf)).cells())


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
