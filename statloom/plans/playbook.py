"""Play-by-play summaries: by formation, playcall, down and quarter, and filtered views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.scalar import half_even, text
from statloom.operators.aggregate import conversion_rates, to_long, value_counts
from statloom.operators.project import slice_rows

# The display orders of the categories.
RUN_ORDER = ["run_end_right", "run_tackle_right", "run_guard_right", "run_NA_middle", "run_guard_left", "run_tackle_left", "run_end_left"]
PASS_LENGTH_ORDER = ["short", "deep"]
FORMATION_ORDER = ["1", "2", "3", "4", "5", "6", "7", "8", "9", "10"]


def prepare_plays(pbp: DataFrame) -> DataFrame:
    """Composite playcall label; plays without a pass description, overtime and kicks drop out."""
    names = {"Play call": "playcall_"} if "Play call" in pbp.columns else {}
    plays = pbp.withColumnsRenamed(names)
    label = F.when(
        F.col("play_type") == "pass",
        F.concat_ws("_", "play_type", text("pass_length"), text("pass_location")),
    ).when(
        F.col("play_type").isNotNull(),
        F.concat_ws("_", "play_type", text("run_gap"), text("run_location")),
    )
    plays = plays.withColumn("playcall", label)
    return plays.filter((F.col("playcall") != "pass_NA_NA") & (F.col("qtr") != 5) & F.col("down").isNotNull())


def display_order(column: str, levels: Sequence[str]) -> Column:
    """Position of a category in its display order; NULL when it is not listed."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column).cast("string")), F.lit(0))


def by_formation(plays: DataFrame, digits: int | None = 1) -> DataFrame:
    gained = F.avg("yds_gained")
    out = plays.groupBy(F.col("Formation").cast("string").alias("Formation"), "playcall").agg(
        (gained if digits is None else half_even(gained, digits)).alias("avg_yds_gained"),
        F.count(F.lit(1)).alias("count_"),
    )
    return out.withColumn("formation_order", display_order("Formation", FORMATION_ORDER))


def runs_by_down(plays: DataFrame, digits: int | None = 1) -> DataFrame:
    gained = F.avg("yds_gained")
    rows = plays.filter((F.col("play_type") == "run") & (F.col("playcall") != "run_NA_NA"))
    out = rows.groupBy("down", "playcall").agg(
        (gained if digits is None else half_even(gained, digits)).alias("avg_yds_gained")
    )
    return out.withColumn("playcall_order", display_order("playcall", RUN_ORDER))


def zero_gain_passes(plays: DataFrame, digits: int | None = 2) -> DataFrame:
    """Share of passes that gained exactly 0, by down, length and location."""
    share = F.avg(F.when(F.col("yds_gained") == 0, 1.0).otherwise(0.0))
    out = plays.filter(F.col("play_type") == "pass").groupBy("down", "pass_length", "pass_location").agg(
        (share if digits is None else half_even(share, digits)).alias("zero_gain_rate")
    )
    return out.withColumn("length_order", display_order("pass_length", PASS_LENGTH_ORDER))


def execution(plays: DataFrame) -> DataFrame:
    """Yards to go, yards gained and conversion by down, by quarter and down, by playcall and down."""
    out = conversion_rates(plays, "yds_gained", "distance", [["down"], ["qtr", "down"], ["playcall", "down"]])
    return out.withColumn(
        "line_size", F.when(F.col("grouping") == "qtr+down", F.when(F.col("down").isin(3, 4), 3.0).otherwise(1.5))
    )


def execution_long(plays: DataFrame) -> DataFrame:
    """The by-down table with one row per measure."""
    by_down = conversion_rates(plays, "yds_gained", "distance", [["down"]])
    return to_long(by_down, ["down"], ["avg_needed", "avg_gained", "conversion_pct"])


def filtered_plays(
    plays: DataFrame, formations: Sequence | None = None, play_types: Sequence | None = None, playcalls: Sequence | None = None
) -> DataFrame:
    marked = plays.withColumn(
        "first_down_gained", F.when(F.col("yds_gained") > F.col("distance"), "1st Down").otherwise("Other")
    )
    return slice_rows(marked, {"Formation": formations, "play_type": play_types, "playcall": playcalls})


def tendencies(plays: DataFrame, category: str) -> DataFrame:
    """Play counts by down and category."""
    return value_counts(plays, ["down", category])
