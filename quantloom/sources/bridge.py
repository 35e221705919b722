"""Factor, price and event panels from the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.frames import trusted
from quantloom.functions.ranks import crowd
from quantloom.operators.prep import compute_forward_returns, get_clean_factor
from quantloom.sources.stored import stored

PERIODS = (1, 5, 10)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date (month), asset (supplier), price, factor, group (nation). Sums are rounded so that their order can't matter."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount")
    panel = lines.groupBy(F.col("l_suppkey").alias("s_suppkey"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("date")).agg(
        F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("price"), F.round(F.avg("l_discount"), 8).alias("factor")
    )
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("group"))
    return panel.join(supplier.join(nation, "n_nationkey"), "s_suppkey").select("date", F.col("s_suppkey").cast("string").alias("asset"), "price", "factor", "group")


def factor_frame(panel: DataFrame) -> DataFrame:
    return panel.select("date", "asset", "factor", "group")


def price_frame(panel: DataFrame) -> DataFrame:
    return panel.select("date", "asset", "price")


def clean_panel(spark: SparkSession, sf_dir: str, filter_zscore: float | None = None, **options) -> DataFrame:
    """Clean factor data of the supplier panel with returns over 1, 5 and 10 sessions."""
    # Factors and prices come from one panel, which is aggregated and written once; months are days apart, and its keys and groups are there by how it is made.
    panel = stored(supplier_panel(spark, sf_dir), "panel")
    returns = compute_forward_returns(factor_frame(panel), price_frame(panel), PERIODS, filter_zscore, check=False, labels=[f"{p}D" for p in PERIODS])
    clean = trusted(get_clean_factor(factor_frame(panel), returns, check=False, **options).frame)
    # No cross-section of the clean panel is larger than that of the panel it comes from.
    if not crowd(panel, ["date"]):
        clean._quantloom_crowds = {("date",): 0, ("date", "group"): 0}
    return clean


def user_day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date (day), asset (user), price, factor of the event stream; a sparse panel."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("date"), F.col("user_id").cast("string").alias("asset")).agg(
        F.round(F.sum("value") + 1, 6).alias("price"), F.count("*").cast("double").alias("factor")
    )
