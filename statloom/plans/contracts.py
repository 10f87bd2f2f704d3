"""Contract comparables: career features, flattened contracts, nearest earlier contracts, estimate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.scalar import age_in_years, half_even, july_first, minutes, percent, scaled_rint, signing_season
from statloom.operators.aggregate import standardise
from statloom.operators.hotgroups import find_hot, with_group_stats
from statloom.operators.joins import explode_lists, lookup
from statloom.operators.knn import nearest, price_path, weighted_estimate
from statloom.operators.project import override_when
from statloom.operators.windows import number_rows, prior_average, running_totals, trailing_average
from statloom.session import cut_lineage

# Games in a full season, position weights of the estimate, caps by season.
SEASON_GAMES = 82
POSITION_WEIGHTS = (0.30, 0.25, 0.20, 0.15, 0.10)
CURRENT_SEASON = 20242025
CAP_BY_SEASON = {20212022: 82_500_000, 20222023: 83_500_000, 20232024: 88_000_000, 20242025: 95_500_000, 20252026: 104_000_000}
LATER_CAPS = (104_000_000, 113_500_000)
# The six distance features of each status and the weights of the non-unit ones.
RFA_FEATURES = ["july_1_age", "career_to_date_gp", "career_to_date_p_pg", "career_to_date_ev_p_pg", "career_to_date_toi_avg", "pct_gp"]
UFA_FEATURES = ["career_to_date_ev_p_pg", "career_to_date_toi_avg", "pct_gp", "gamesPlayed", "pointsPerGame", "timeOnIcePerGame"]
UFA_FORWARD_WEIGHTS = {"gamesPlayed": 0.25, "pointsPerGame": 0.25, "timeOnIcePerGame": 0.25}
TRAILING = ["gamesPlayed", "points", "pointsPerGame", "evPoints", "evPointsPerGame", "timeOnIcePerGame"]


def career_table(seasons: DataFrame, bios: DataFrame | None = None, digits: int | None = 2) -> DataFrame:
    """One row per player-season with career totals, career-to-date features and trailing averages."""
    fix = (lambda c: half_even(c, digits)) if digits is not None else F.col
    by, order = ["playerId"], ["seasonId"]
    totals = {"career_gp": "gamesPlayed", "career_points": "points", "career_goals": "goals", "ev_career_points": "evPoints", "ev_career_goals": "evGoals"}
    out = with_group_stats(seasons, by, {new: F.sum(old) for new, old in totals.items()})
    out = out.withColumns(
        {
            "career_assists": F.col("career_points") - F.col("career_goals"),
            "ev_career_assists": F.col("ev_career_points") - F.col("ev_career_goals"),
            "july_1": july_first("seasonId"),
            "evPointsPerGame": F.try_divide("evPoints", "gamesPlayed"),
        }
    )
    if bios is not None:
        facts = bios.dropDuplicates(["playerId"])
        out = lookup(out, facts, ["playerId"], [c for c in facts.columns if c not in out.columns])
        out = out.withColumn("july_1_age", age_in_years("july_1", "birthDate"))
    # totals and facts add no rows, so one look at the group sizes serves every step
    hot = find_hot(seasons, by, order[0])
    out = number_rows(out, by, order, "szn_no", hot)
    out = running_totals(
        out, by, order,
        {"career_to_date_gp": "gamesPlayed", "career_to_date_points": "points", "career_to_date_ev_points": "evPoints"}, hot,
    )
    out = prior_average(out, by, order, {"career_to_date_toi_avg": "timeOnIcePerGame"}, hot=hot)
    out = prior_average(
        out, by, order, {"career_to_date_p_pg": "points", "career_to_date_ev_p_pg": "evPoints"},
        weight="gamesPlayed", inclusive_weight=True, hot=hot,
    )
    out = out.withColumns(
        {c: fix(c) for c in ("career_to_date_toi_avg", "career_to_date_p_pg", "career_to_date_ev_p_pg")}
    )
    out = out.withColumn("pct_gp", F.col("career_to_date_gp") / (F.col("szn_no") * SEASON_GAMES))
    out = trailing_average(out, by, order, TRAILING, 3, hot=hot)
    return trailing_average(out, by, order, TRAILING, 2, hot=hot)


def contract_table(players: DataFrame, current: int = CURRENT_SEASON) -> DataFrame:
    """One row per active contract with the season it was signed in; contracts ending this season
    count as this season's and take their expiry status."""
    keys = [c for c in players.columns if c not in ("current", "future")]
    rows = explode_lists(players, keys, "current", "future", "_future").filter(F.col("contract_id").isNotNull())
    ending = F.col("contract_end") == F.concat_ws(
        "-", F.substring(F.lit(str(current)), 1, 4), F.substring(F.lit(str(current)), 5, 4)
    )
    year = F.when(ending, F.lit(current)).otherwise(signing_season("contract_end", "length"))
    rows = rows.withColumn("contract_year", year.cast("int"))
    return override_when(rows, "signing_status", F.col("contract_year") == current, "expiry_status")


def cap_table(df: DataFrame, caps: Mapping[int, int] = CAP_BY_SEASON) -> DataFrame:
    return df.sparkSession.createDataFrame(list(caps.items()), "contract_year int, upper_limit bigint")


def contract_seasons(
    contracts: DataFrame, careers: DataFrame, caps: DataFrame, digits: int | None = 2, columns: Sequence[str] | None = None
) -> DataFrame:
    """Contracts joined to the career row of their season, skaters only, with the cap share.

    Materialised, because scaling, matching and every report read it again; ``columns`` names the career columns
    that they read (all), so that no others are worked out and written.
    """
    fix = (lambda x: half_even(x, digits)) if digits is not None else (lambda x: x)
    out = lookup(
        contracts, careers, {"nhl_id": "playerId", "contract_year": "seasonId"},
        [c for c in careers.columns if c not in {*contracts.columns, "playerId", "seasonId"} and (columns is None or c in columns)], "inner",
    )
    out = out.filter((F.col("position") != "Goaltender") & F.col("signing_status").isin("RFA", "UFA"))
    out = lookup(out, caps, ["contract_year"], ["upper_limit"])
    yearly = F.col("value").cast("double") / F.col("length").cast("int")
    out = out.withColumns(
        {
            "position": F.when(F.col("position").contains("ing"), "Winger").otherwise(F.col("position")),
            "pos_group": F.when(F.col("position") == "Defense", "Defense").otherwise("Forward"),
            "cap_hit_pct": fix(yearly / F.col("upper_limit") * 100),
        }
    )
    return cut_lineage(out.drop("upper_limit"))


def comparables(
    table: DataFrame, current: int = CURRENT_SEASON, seasons_back: int = 3, k: int = 5,
    rfa: Sequence[str] = tuple(RFA_FEATURES), ufa: Sequence[str] = tuple(UFA_FEATURES), ufa_forward_weights: Mapping[str, float] = UFA_FORWARD_WEIGHTS,
) -> DataFrame:
    """The ``k`` nearest earlier contracts for every pending one, within status and position group.

    Features are scaled over the whole segment before the candidate seasons are cut out. All four
    segments run as one join; each status uses its own features.
    """
    segment = ["signing_status", "pos_group"]
    used = list(dict.fromkeys([*rfa, *ufa]))
    scaled = standardise(table, segment, used)
    forward = F.col("pos_group") == "Forward"
    picked = {}
    for i, (r, u) in enumerate(zip(rfa, ufa)):
        weight = F.when(forward, float(ufa_forward_weights.get(u, 1.0))).otherwise(1.0)
        picked[f"f{i}"] = F.when(F.col("signing_status") == "RFA", F.col(f"{r}_z")).otherwise(F.col(f"{u}_z") * weight)
    names = list(picked)
    # subjects and candidates are read from it
    rows = cut_lineage(scaled.withColumns(picked).select(*segment, "contract_id", "contract_year", *names))
    pending = rows.filter(F.col("contract_year") == current).withColumnRenamed("contract_id", "subject_id")
    earlier = rows.filter(
        (F.col("contract_year") != current) & (F.col("contract_year") >= current - seasons_back * 10001)
    )
    return nearest(pending, earlier, segment, names, k, "subject_id", "contract_id")


def estimates(
    comps: DataFrame, table: DataFrame, cap: float = CAP_BY_SEASON[CURRENT_SEASON], later_caps: Sequence[float] = LATER_CAPS, weights: Sequence[float] = POSITION_WEIGHTS, digits: int | None = 2
) -> DataFrame:
    """Weighted cap share of each pending contract, its amount, and its share of later caps."""
    priced = lookup(comps, table, ["contract_id"], ["cap_hit_pct"])
    guess = weighted_estimate(priced, "subject_id", "position", "cap_hit_pct", weights, "cap_hit_pct")
    if digits is not None:
        guess = guess.withColumn("cap_hit_pct", half_even("cap_hit_pct", digits))
    return price_path(guess, "cap_hit_pct", cap, later_caps, digits)


def comparison_rows(comps: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Subject (position 0) and its matches with their contract and stat columns."""
    comps = cut_lineage(comps)  # read twice
    subjects = comps.select("subject_id").distinct().select("subject_id", F.lit(0).alias("position"), F.col("subject_id").alias("contract_id"))
    long = comps.select("subject_id", "position", "contract_id").unionByName(subjects)
    return lookup(long, table, ["contract_id"], columns)


def display_units(comps: DataFrame, digits: int = 2) -> DataFrame:
    """Units of the comparison table: share of games in percent, ice time in minutes, both rounded."""
    return comps.withColumns(
        {
            "pct_gp": percent("pct_gp", digits),
            "timeOnIcePerGame": minutes(scaled_rint("timeOnIcePerGame", digits), digits),
            "pointsPerGame": scaled_rint("pointsPerGame", digits),
        }
    )


def trajectories(comps: DataFrame, table: DataFrame, careers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every season of the subject and its matches, by age."""
    players = comparison_rows(comps, table, ["nhl_id"])
    return lookup(players, careers, {"nhl_id": "playerId"}, ["seasonId", "july_1_age", *columns])


def pending_players(table: DataFrame, status: str, pos_group: str, current: int = CURRENT_SEASON) -> DataFrame:
    return table.filter(
        (F.col("signing_status") == status) & (F.col("pos_group") == pos_group) & (F.col("contract_year") == current)
    )
