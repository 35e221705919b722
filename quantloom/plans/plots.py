"""One chart for each table that the operators return; each is a Chart that notebooks show as SVG."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.errors import FactorError
from quantloom.plans import reports, tables
from quantloom.plans.render import Chart, RenderedTearSheet, as_table, chart, print_table, render


def plot_returns_table(alpha_beta: DataFrame, mean_ret_quantile: DataFrame, mean_ret_spread_quantile: DataFrame) -> None:
    print_table(alpha_beta, "Returns Analysis")
    print_table(mean_ret_quantile)
    print_table(mean_ret_spread_quantile)


def plot_turnover_table(autocorrelation_data: DataFrame, quantile_turnover: DataFrame) -> None:
    print_table(autocorrelation_data, "Turnover Analysis")
    print_table(quantile_turnover)


def plot_information_table(ic_data: DataFrame) -> None:
    print_table(ic_data, "Information Analysis")


def plot_quantile_statistics_table(factor_data: DataFrame) -> None:
    """Of clean factor data, or of statistics made before."""
    print_table(tables.quantile_statistics(factor_data) if "factor" in factor_data.columns else factor_data, "Quantiles Statistics")


def plot_ic_ts(ic: DataFrame) -> Chart:
    return chart(as_table(ic), "line", "ic", "date", ("group", "period"), title="Information Coefficient")


def plot_ic_hist(ic: DataFrame) -> Chart:
    return chart(as_table(ic), "histogram", "ic", "date", title="Period IC")


def plot_ic_qq(ic: DataFrame) -> Chart:
    return chart(as_table(tables.qq_normal(ic)), "scatter", "observed", "theoretical", ("period",), title="IC Q-Q")


def plot_quantile_returns_bar(mean_ret_by_q: DataFrame, by_group: bool = False) -> Chart:
    return chart(as_table(mean_ret_by_q), "bar", "mean_return", "factor_quantile", (*(("group",) if by_group else ()), "period"), "basis_points", "Mean Period Wise Return By Factor Quantile")


def plot_quantile_returns_violin(return_by_q: DataFrame) -> Chart:
    return chart(as_table(return_by_q), "density", "mean_return", "factor_quantile", ("factor_quantile",), title="Period Wise Return By Factor Quantile")


def plot_mean_quantile_returns_spread_time_series(mean_returns_spread: DataFrame, std_err: bool = True, bandwidth: float = 1) -> Chart:
    """With std_err, lines of the joint error above and below."""
    t = as_table(mean_returns_spread)
    if bandwidth < 0:
        raise FactorError("the bandwidth must not be negative")
    made = chart(t, "line", "mean_return_difference", "date", ("period",), "basis_points", "Top Minus Bottom Quantile Mean Return")
    if not std_err or not bandwidth:
        return made
    errors = chart(t, "line", "joint_std_error", "date", ("period",)).series
    series = dict(made.series)
    for name, points in made.series.items():
        for sign, mark in ((1, "+"), (-1, "-")):
            series[f"{name} {mark}"] = [(x, None if y is None or e is None else y + sign * bandwidth * e) for (x, y), (_, e) in zip(points, errors[name], strict=True)]
    return Chart("line", made.title, series, made.unit, made.x_text)


def plot_ic_by_group(ic_group: DataFrame) -> Chart:
    return chart(as_table(ic_group), "bar", "mean_ic", "group", ("period",), title="Information Coefficient By Group")


def plot_factor_rank_auto_correlation(factor_autocorrelation: DataFrame, period: int = 1) -> Chart:
    return chart(as_table(factor_autocorrelation), "line", "autocorrelation", "date", ("period",), title=f"{period}D Period Factor Rank Autocorrelation")


def plot_top_bottom_quantile_turnover(quantile_turnover: DataFrame, period: int = 1) -> Chart:
    """Of the outer buckets alone."""
    ends = quantile_turnover.agg(F.min("factor_quantile"), F.max("factor_quantile")).first()
    outer = quantile_turnover.where(F.col("factor_quantile").isin(*[e for e in ends if e is not None]) & (F.col("period") == f"{period}D"))
    return chart(as_table(outer), "line", "turnover", "date", ("factor_quantile",), title=f"{period}D Period Top and Bottom Quantile Turnover")


def plot_monthly_ic_heatmap(mean_monthly_ic: DataFrame) -> Chart:
    """Takes the monthly table of a report, or mean ICs by month."""
    dated = mean_monthly_ic.withColumn("date", F.col("date").cast("timestamp_ntz"))
    return chart(as_table(dated), "heat", "mean_ic", "date", ("period",), title="Monthly Mean IC")


def plot_cumulative_returns(factor_returns: DataFrame, period: int | str, title: str | None = None) -> Chart:
    return chart(as_table(factor_returns), "line", "cumulative_return", "date", ("period",), title=title or f"Portfolio Cumulative Return ({period} Fwd Period)")


def plot_cumulative_returns_by_quantile(quantile_returns: DataFrame, period: int | str) -> Chart:
    return chart(as_table(quantile_returns), "line", "cumulative_return", "date", ("factor_quantile",), title=f"Cumulative Return by Quantile ({period} Period Forward Return)")


def plot_quantile_average_cumulative_return(avg_cumulative_returns: DataFrame, title: str | None = None) -> Chart:
    return chart(as_table(avg_cumulative_returns), "line", "mean_cumulative_return", "offset", ("factor_quantile", "group"), "basis_points", title or "Average Cumulative Returns by Quantile")


def plot_events_distribution(events: DataFrame, num_bars: int = 50) -> Chart:
    """Of factor data, or of a distribution made before."""
    made = events if "bin" in events.columns else tables.event_distribution(events, num_bars)
    return chart(as_table(made), "bar", "count", "bin", title="Distribution of events in time")


def _sheet(build):
    def made(*args, backend: str = "html", width: int = 1200, scale: float = 1.0, theme: str = "light", **options) -> RenderedTearSheet:
        return render(build(*args, **options), backend, width, scale, theme)

    made.__name__ = build.__name__.removesuffix("_data")
    made.__doc__ = f"{build.__name__}, drawn."
    return made


create_returns_tear_sheet = _sheet(reports.create_returns_tear_sheet_data)
create_information_tear_sheet = _sheet(reports.create_information_tear_sheet_data)
create_turnover_tear_sheet = _sheet(reports.create_turnover_tear_sheet_data)
create_summary_tear_sheet = _sheet(reports.create_summary_tear_sheet_data)
create_full_tear_sheet = _sheet(reports.create_full_tear_sheet_data)
create_event_returns_tear_sheet = _sheet(reports.create_event_returns_tear_sheet_data)
create_event_study_tear_sheet = _sheet(reports.create_event_study_tear_sheet_data)
