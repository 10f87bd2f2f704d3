"""Time the headline queries (best of BENCH_REPEATS runs) and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from statloom.catalog import QUERIES  # noqa: E402
from statloom.session import local_session  # noqa: E402

HEADLINE = [
    "conversion_rates",
    "grouped_means",
    "correlations",
    "column_profile",
    "share_within",
    "opponent_rows",
    "scaled_features",
    "cumulative_sums",
    "trailing_averages",
    "season_to_date_by_supplier",
    "in_game_features",
    "filled_forward",
    "quartiles_in_group",
    "rolling_medium",
    "rolling_by_prefix_sums",
    "rank_with_ties",
    "unit_gross_weights",
    "hourly_returns",
    "strategy_backtest",
    "parameter_sweep",
    "regression_coefficients",
    "residual_quantiles",
    "stratified_split",
    "loss_by_trial_and_rating",
    "loss_tail",
    "nearest_parts",
    "similar_names",
    "career_features",
    "yearly_changes",
    "projected_seasons",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # bring the JVM and the Python workers up before anything is timed
    QUERIES["grouped_means"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
