"""Headline operators at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON with the seconds of each.

The clean panel is written in its layout before the clock starts and each operator is called once to warm
up, as in the published baseline; `clean_factor` is the building of the panel itself.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quantloom.operators import events, performance, portfolio
from quantloom.sources import bridge
from quantloom.sources.stored import laid_out, stored

OPERATORS = {
    "factor_information_coefficient": performance.factor_information_coefficient,
    "factor_weights": performance.factor_weights,
    "factor_returns": performance.factor_returns,
    "factor_alpha_beta": performance.factor_alpha_beta,
    "mean_return_by_quantile": performance.mean_return_by_quantile,
    "quantile_turnover": lambda d: performance.quantile_turnover(d, 5),
    "factor_rank_autocorrelation": performance.factor_rank_autocorrelation,
    "factor_positions": lambda d: portfolio.factor_positions(d, 5, check=False),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}

    def timed(name, df) -> None:
        began = time.perf_counter()
        df().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)

    timed("clean_factor", lambda: bridge.clean_panel(spark, sf_dir))
    timed("clean_factor", lambda: bridge.clean_panel(spark, sf_dir))
    clean = laid_out(bridge.clean_panel(spark, sf_dir))
    moves = stored(performance.prices_to_returns(bridge.price_frame(bridge.supplier_panel(spark, sf_dir))), "moves")
    every = OPERATORS | {"average_cumulative_return_by_quantile": lambda d: events.average_cumulative_return_by_quantile(d, moves, 3, 5, check=False)}
    for name, f in every.items():
        timed(name, lambda f=f: f(clean))
        timed(name, lambda f=f: f(clean))
    print(json.dumps({"metric": "factor operators on the clean panel, and its building", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
