"""Tear sheets: tables, their contract, JSON and drawing, on a small panel."""

import datetime as dt
import importlib.util
import json
import re
import struct
import zlib
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.errors import FactorError, NonMatchingTimezoneError
from quantloom.functions.frames import same_dates
from quantloom.operators import performance as perf
from quantloom.plans import plots, raster, render, reports, tables

SCHEMA = "date timestamp_ntz, asset string, group string, factor double, factor_quantile int, forward_return_1D double, forward_return_5D double"
DAYS = [dt.datetime(2024, 1, d) for d in range(1, 13)]


@pytest.fixture(scope="module")
def clean(spark):
    data = [(d, f"a{i}", f"g{i % 2}", float((i * 7 + k * 3) % 11), (i * 7 + k * 3) % 11 * 3 // 11 + 1, ((i * 5 + k) % 9 - 4) / 100, ((i * 3 + k) % 7 - 3) / 50) for k, d in enumerate(DAYS) for i in range(8)]
    return spark.createDataFrame(data, SCHEMA).persist()


@pytest.fixture(scope="module")
def full(clean):
    return reports.create_full_tear_sheet_data(clean, by_group=True, turnover_periods=[1, "2D"], ic_rolling_window=3).collect()


def test_full_report_has_its_tables_in_order(full):
    assert full.table_ids() == reports.ORDER["full"]
    assert full.metadata["source_rows"] == 96 and full.metadata["periods"] == ["1D", "5D"]
    assert full.metadata["quantiles"] == [1, 2, 3] and full.metadata["groups"] == ["g0", "g1"]
    with pytest.raises(KeyError):
        full.table("events.coverage")


def test_json_round_trip_is_exact(full):
    text = full.to_json()
    back = reports.TearSheetData.from_json(text)
    assert back.to_json() == text and json.loads(full.to_json(pretty=True)) == json.loads(text)
    for i in full.table_ids():
        assert sorted(map(str, back.table(i).collect())) == sorted(map(str, full.table(i).select(*back.table(i).columns).collect()))


@pytest.mark.parametrize("change", [
    lambda b: b["metadata"].update(contract_version="other/v1"),
    lambda b: b["metadata"].update(report_kind="other"),
    lambda b: b["tables"].pop(0),
    lambda b: b["tables"].reverse(),
    lambda b: b["tables"][0].update(row_count=99),
    lambda b: b["tables"][0]["columns"][0].update(name="mean"),
    lambda b: b["tables"][0]["columns"][0]["values"].reverse(),
    lambda b: b["tables"][0]["columns"][0]["values"].__setitem__(0, None),
    lambda b: b["tables"][0]["columns"][1]["values"].__setitem__(0, "x"),
    lambda b: b["tables"][0]["columns"][1].update(unit="furlongs"),
    lambda b: b.pop("options"),
])
def test_json_against_the_contract_is_refused(full, change):
    body = json.loads(full.to_json())
    change(body)
    with pytest.raises(FactorError):
        reports.TearSheetData.from_json(json.dumps(body))


def test_turnover_of_all_quantiles_equals_that_of_each(clean):
    got = tables.turnover_series(clean, [1, 3])
    for q in (1, 2, 3):
        for k in (1, 3):
            want = perf.quantile_turnover(clean, q, k).select("date", "turnover").collect()
            assert sorted(map(str, got.where(f"factor_quantile = {q} and period = '{k}D'").select("date", "turnover").collect())) == sorted(map(str, want))


def test_optional_tables(clean):
    no_day = reports.create_returns_tear_sheet_data(clean.drop("forward_return_1D"))
    assert no_day.table_ids() == reports.ORDER["returns"][:5]
    assert "information.ic_by_group" not in reports.create_information_tear_sheet_data(clean).table_ids()
    bare = reports.create_event_study_tear_sheet_data(clean)
    assert bare.table_ids() == ["quantile.statistics", "events.distribution", "returns.mean_by_quantile", "returns.daily_by_quantile"]


def test_options_are_checked(clean):
    for call in (lambda: reports.create_turnover_tear_sheet_data(clean, [1, 1]), lambda: reports.create_turnover_tear_sheet_data(clean, []), lambda: reports.create_information_tear_sheet_data(clean, rolling_window=0), lambda: reports.create_event_study_tear_sheet_data(clean, n_bars=0), lambda: reports.create_event_returns_tear_sheet_data(clean, clean, (-1, 3)), lambda: reports.create_returns_tear_sheet_data(clean.where("asset = ''"))):
        with pytest.raises(FactorError):
            call()


def test_qq_is_the_normal_quantile_of_the_place(spark):
    ic = spark.createDataFrame([(DAYS[k], "1D", x) for k, x in enumerate((0.3, -0.1, None, 0.1))] + [(DAYS[0], "5D", 0.2)], "date timestamp_ntz, period string, ic double")
    got = sorted(tables.qq_normal(ic).collect())
    assert [(r.period, r.position) for r in got] == [("1D", 0), ("1D", 1), ("1D", 2)]
    assert [round(r.theoretical, 6) for r in got] == [-0.967422, 0.0, 0.967422] and [round(r.observed, 6) for r in got] == [-1.0, 0.0, 1.0]


@pytest.mark.parametrize(("x", "unit", "decimals", "want"), [(None, "raw", 2, "—"), (-0.0001, "raw", 2, "0.00"), (0.0123, "decimal_return", 2, "1.23%"), (0.0005, "basis_points", 1, "5.0 bps"), (3.0, "count", 0, "3")])
def test_numbers(x, unit, decimals, want):
    assert render.format_number(x, unit, decimals) == want


def test_density_has_its_peak_at_one():
    got = render.kde([0.0, 1.0, None, 2.0])
    assert len(got) == 64 and max(y for _, y in got) == 1.0 and render.kde([2.0, 2.0]) == [(2.0, 1.0)] and render.kde([None]) == []


def test_layout_pairs_halves_only_where_wide(full):
    wide, narrow = render.plan_report(full), render.plan_report(full, render.Options(width=800))
    assert {p.span for p in narrow} == {12} and len({p.row for p in narrow}) == len(narrow)
    assert any(p.column == 6 for p in wide) and len({(p.row, p.column) for p in wide}) == len(wide)


def test_drawn_reports_are_well_formed_and_saved(full, tmp_path):
    svg = render.render(full, "svg", width=720, scale=2.0, theme="dark")
    ElementTree.fromstring(svg.content)
    assert svg.width == 1440
    page = render.render_html(full)
    for part in re.findall(r"<svg.*?</svg>", page.content):
        ElementTree.fromstring(part)
    assert page.content == render.render_html(reports.TearSheetData.from_json(full.to_json())).content
    page.save(tmp_path / "a.html")
    for call in (lambda: page.save(tmp_path / "a.svg"), lambda: render.render(full, "gif"), lambda: render.render(full, width=100), lambda: render.render(full, scale=9), lambda: render.render(full, theme="red")):
        with pytest.raises(FactorError):
            call()
    with pytest.raises(AttributeError):
        page.width = 1


def test_plots_of_operator_outputs(clean, full, capsys):
    made = [plots.plot_ic_ts(full.table("information.ic_by_date")), plots.plot_ic_hist(full.table("information.ic_by_date")), plots.plot_monthly_ic_heatmap(full.table("information.ic_monthly")), plots.plot_quantile_returns_bar(full.table("returns.mean_by_quantile")), plots.plot_quantile_returns_violin(full.table("returns.daily_by_quantile")), plots.plot_top_bottom_quantile_turnover(full.table("turnover.quantile_series")), plots.plot_events_distribution(clean, 4), plots.plot_mean_quantile_returns_spread_time_series(full.table("returns.daily_spread"))]
    for c in made:
        ElementTree.fromstring(c.svg())
    assert sum(y for _, y in made[6].series[""]) == 96 and len(made[7].series) == 6 and set(made[5].series) == {"1", "3"}
    plots.plot_quantile_statistics_table(clean)
    assert capsys.readouterr().out.splitlines()[0] == "Quantiles Statistics"
    with pytest.raises(FactorError):
        plots.plot_ic_ts(full.table("returns.mean_by_quantile"))


def pixels(image):
    """Height, width and the rows of an unfiltered PNG of three bytes a pixel."""
    assert image[:8] == b"\x89PNG\r\n\x1a\n"
    at, body, size = 8, b"", None
    while at < len(image):
        n, name = struct.unpack_from(">I4s", image, at)
        data = image[at + 8 : at + 8 + n]
        assert struct.unpack_from(">I", image, at + 8 + n)[0] == zlib.crc32(name + data)
        size = struct.unpack(">II", data[:8]) if name == b"IHDR" else size
        body += data if name == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], 1 + 3 * size[0])
    assert not rows[:, 0].any()
    return rows[:, 1:].reshape(size[1], size[0], 3)


def test_shapes_become_pixels():
    svg = '<svg width="40" height="20" viewBox="0 0 20 10"><rect width="100%" height="100%" fill="#ffffff"/><g transform="translate(2,1)"><rect x="1" y="1" width="2" height="3" fill="#ff0000" fill-opacity="0.5"/></g><path d="M10 5 L14 5" stroke="#0000ff" stroke-width="1"/><text x="20" y="10" text-anchor="end" fill="#008000" font-size="6">I</text></svg>'
    got = pixels(raster.png(svg))
    assert got.shape == (20, 40, 3)
    red = np.argwhere((got == (255, 128, 128)).all(axis=2))
    assert red.min(axis=0).tolist() == [4, 6] and red.max(axis=0).tolist() == [9, 9] and len(red) == 24
    blue = np.argwhere((got == (0, 0, 255)).all(axis=2))
    assert set(blue[:, 0]) == {10, 11} and {blue[:, 1].min(), blue[:, 1].max()} == {20, 28}
    assert (got == (0, 128, 0)).all(axis=2).sum() == 4 * (3 + 1 + 1 + 1 + 3)


def test_png_reports(full, tmp_path):
    image = render.render_png(full, width=720, scale=0.5, theme="dark")
    got = pixels(image.content)
    assert got.shape == (image.height, image.width, 3) and image.width == 360
    assert got[0, 0].tolist() == [0x11, 0x18, 0x27] and len(np.unique(got.reshape(-1, 3), axis=0)) > 8
    render.write_png(full, tmp_path / "a.png", width=720, scale=0.5, theme="dark")
    assert (tmp_path / "a.png").read_bytes() == image.content
    with pytest.raises(FactorError):
        render.render_png(full, width=4096, scale=4.0)


def test_grid_of_charts(full):
    grid = render.GridFigure(2, 2)
    chart = plots.plot_ic_ts(full.table("information.ic_by_date"))
    grid.next_cell(chart)
    grid.next_row(chart)
    drawn = ElementTree.fromstring(grid.svg(800))
    assert [g.attrib["transform"] for g in drawn if g.tag.endswith("}g")] == ["translate(0,0)", "translate(0,320)"]
    with pytest.raises(FactorError):
        grid.next_cell(chart)
    grid.close()
    grid.next_cell(chart)


def test_matplotlib_is_optional(full):
    if importlib.util.find_spec("matplotlib"):
        assert render.render_matplotlib(full).axes
    else:
        with pytest.raises(FactorError):
            render.render_matplotlib(full)


def test_dates_of_two_zones_do_not_match(spark):
    made = [spark.createDataFrame([(DAYS[0],)], "date timestamp").select(F.col("date").alias("date", metadata={"timezone": z} if z else {})) for z in ("UTC", "Asia/Tokyo", None)]
    same_dates(made[0], made[2])
    with pytest.raises(NonMatchingTimezoneError):
        same_dates(made[0], made[1])
