"""Points projection: joined season stats, lagged features, linear model, repeated projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.scalar import season_code, season_start, season_text
from statloom.functions.text import dotted_name
from statloom.operators.aggregate import share_of_total
from statloom.operators.fuzzy import fuzzy_left_join
from statloom.operators.joins import lookup, union_named
from statloom.operators.project import drop_missing
from statloom.operators.regress import LinearFit, fit_ols, residual_buckets
from statloom.operators.windows import quantile_bucket, shifted
from statloom.session import cut_lineage

FEATURES = ["rate_prev1", "rate_prev2", "toi_prev1", "icf_prev1", "age_prev1"]
# Games per season and the bucket edges of errors and targets.
PACE = 82
ERROR_BREAKS = (-1, 5, 10, 15, 20, 25, 30, 50)
TARGET_BREAKS = (-1, 0.2, 0.4, 0.6, 0.7, 1)
# Assumed yearly change of ice time by age bucket and scoring quartile.
ICE_TIME_CHANGE = {
    ("30+", 1): -0.2, ("30+", 2): -0.2, ("30+", 3): -0.2,
    ("27-29", 2): 0.025, ("27-29", 3): 0.025, ("27-29", 4): 0.025,
    ("26u", 1): 0.2, ("26u", 2): 0.2, ("26u", 3): 0.2, ("26u", 4): 0.2,
}
OTHER_CHANGE = 0.01


def season_stats(on_ice: DataFrame, bios: DataFrame, max_distance: float = 0.1) -> DataFrame:
    """On-ice season rows with age and position of the near-equal name of the same season."""
    named = bios.withColumn("bio_name", dotted_name("player"))
    return fuzzy_left_join(
        on_ice, named, ("player_name", "bio_name"), {"season_yr": "season"}, max_distance, ["age", "position"]
    )


def age_bucket(age: str) -> Column:
    """Ages between 26 and 27 belong to no bucket."""
    a = F.col(age)
    return F.when(a >= 30, "30+").when(a >= 27, "27-29").when(a <= 26, "26u")


def model_table(
    stats: DataFrame, player: str = "player", season: str = "season", columns: Sequence[str] = ("rate", "toi", "icf", "age"), highest_target: float = 0.8
) -> DataFrame:
    """Rows with a target rate and the two previous seasons of every column; complete rows only.

    ``season`` sorts by its first year; it may be text or a code.
    """
    rows = stats.withColumn("_year", season_start(season))
    rows = shifted(rows, [player], ["_year"], list(columns), (1, 2)).drop("_year")
    rows = drop_missing(rows.withColumn("target", F.col("rate")))
    return rows.filter((F.col("target") != 0) & (F.col("target") < highest_target))


def train(table: DataFrame, in_training: Column, features: Sequence[str] = tuple(FEATURES)) -> LinearFit:
    return fit_ols(table.filter(in_training), "target", features)


def yearly_changes(table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean change of rate, ice time and attempts from one season to the next, by age bucket and
    scoring quartile."""
    rows = quantile_bucket(
        table.withColumn("age_bucket", age_bucket("age_prev1")), ["age_bucket"], "rate_prev1", key, 4, "quartile"
    )
    change = lambda c: F.avg(F.col(f"{c}_prev1") - F.col(f"{c}_prev2")).alias(f"{c}_change")
    return rows.groupBy("age_bucket", "quartile").agg(change("rate"), change("toi"), change("icf"))


def _ice_time_change(rules: Mapping[tuple[str, int], float]) -> Column:
    # a season whose player is in no age bucket has no assumed change
    out = F.when(F.col("age_bucket").isNotNull(), OTHER_CHANGE)
    for (bucket, quartile), value in rules.items():
        out = F.when((F.col("age_bucket") == bucket) & (F.col("quartile") == quartile), value).otherwise(out)
    return out


def step(
    state: DataFrame, fit: LinearFit, changes: DataFrame, player: str = "player", rules: Mapping[tuple[str, int], float] = ICE_TIME_CHANGE, level: float = 0.95
) -> DataFrame:
    """One season forward: the prediction becomes last season's rate, age moves by one, ice time and
    attempts follow the assumed changes, and the model predicts again."""
    moved = state.select(
        player,
        (season_start("season") + 1).alias("_year"),
        F.col("fit").alias("rate_prev1"),
        F.col("rate_prev1").alias("rate_prev2"),
        "toi_prev1",
        "icf_prev1",
        (F.col("age_prev1") + 1).alias("age_prev1"),
    ).withColumn("season", season_text(season_code("_year")))
    moved = moved.drop("_year").withColumn("age_bucket", age_bucket("age_prev1"))
    moved = quantile_bucket(moved, ["age_bucket"], "rate_prev1", [player], 4, "quartile")
    moved = lookup(moved, changes, ["age_bucket", "quartile"], ["icf_change"])
    moved = moved.withColumns(
        {
            "toi_prev1": F.col("toi_prev1") * (1 + _ice_time_change(rules)),
            "icf_prev1": F.col("icf_prev1") * (1 + F.col("icf_change")),
        }
    ).drop("icf_change", "age_bucket", "quartile")
    return fit.predict(moved, level)


def project(
    holdout: DataFrame, fit: LinearFit, changes: DataFrame, actuals: DataFrame, horizons: int = 3, player: str = "player"
) -> DataFrame:
    """Predictions for the holdout season and ``horizons`` seasons after it, each scored.

    ``actuals`` holds (player, season, actual). Only players with an actual value are scored and
    carried on. Each step starts from a materialised table, so plans do not nest.
    """
    def scored(rows: DataFrame, horizon: int) -> DataFrame:
        out = lookup(rows, actuals, [player, "season"], ["actual"], "inner")
        out = drop_missing(out, ["fit", "actual"])
        return residual_buckets(out, "actual", PACE, ERROR_BREAKS, TARGET_BREAKS).withColumn("horizon", F.lit(horizon))

    state = cut_lineage(scored(fit.predict(holdout.select(player, "season", *FEATURES), 0.95), 0))
    results = [state]
    for horizon in range(1, horizons + 1):
        state = cut_lineage(scored(step(state, fit, changes, player), horizon))
        results.append(state)
    return union_named(*results)


def error_shares(results: DataFrame) -> DataFrame:
    """Percentage of predictions per error bucket, by season."""
    return share_of_total(results, ["season", "error_bucket"], within=["season"])
