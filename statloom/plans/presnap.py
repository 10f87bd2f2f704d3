"""Play-level features known before the snap, and the table the play-type models train on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.scalar import clock_minutes, game_minutes, is_home, is_leading, text, yards_to_goal
from statloom.operators.aggregate import any_true
from statloom.operators.encode import one_hot
from statloom.operators.hotgroups import AUTO, HotGroups, running
from statloom.operators.joins import lookup
from statloom.operators.project import drop_missing, skip_first, within_bands
from statloom.operators.windows import expanding, forward_fill

PLAY = ["gameId", "playId"]
TEAM_GAME = ["possessionTeam", "gameId"]
# Plausible ranges of the running features.
BANDS = {
    "rush_avg_season": (2.5, 6.0),
    "rush_avg_game": (0.0, 10.0),
    "completion_season": (0.55, 0.75),
    "completion_game": (0.51, 0.9),
}


def personnel(player_play: DataFrame, players: DataFrame) -> DataFrame:
    """Backs and tight ends on the field and whether anyone moved, one row per play."""
    rows = lookup(player_play, players, ["nflId"], ["position"])
    out = rows.groupBy(*PLAY).agg(
        F.count_if(F.col("position") == "TE").alias("te_count"),
        F.count_if(F.col("position") == "RB").alias("rb_count"),
        *[any_true(c).alias(c) for c in ("inMotionAtBallSnap", "motionSinceLineset", "shiftSinceLineset")],
    )
    return out.withColumn("personnel", F.concat(text("rb_count"), text("te_count")))


def situation(plays: DataFrame, games: DataFrame, people: DataFrame) -> DataFrame:
    """Plays with game facts, personnel and the derived clock, field and score columns.

    Games come last: rows dealt by game then serve the windows inside a team's game too.
    """
    facts = [c for c in people.columns if c not in PLAY]
    out = lookup(lookup(plays, people, PLAY), games, ["gameId"])
    out = out.select(*[c for c in out.columns if c not in facts], *facts)
    return out.withColumns(
        {
            "qtr_minutes": clock_minutes("gameClock"),
            "game_minutes": game_minutes("quarter", clock_minutes("gameClock")),
            "yards_to_goal": yards_to_goal("possessionTeam", "yardlineSide", "yardlineNumber"),
            "poss_team_winning": is_leading(
                "possessionTeam", "homeTeamAbbr", "visitorTeamAbbr", "preSnapHomeScore", "preSnapVisitorScore"
            ),
            "poss_team_home": is_home("possessionTeam", "homeTeamAbbr"),
        }
    )


def _is_pass() -> Column:
    return F.col("play_type_design") == "pass"


def _is_completion() -> Column:
    return _is_pass() & (F.col("passResult") == "C")


def _is_attempt() -> Column:
    return _is_pass() & F.col("passResult").isNotNull() & ~F.col("passResult").isin("S", "R")


def season_to_date(plays: DataFrame, include_current: bool = True, hot: HotGroups | None | str = AUTO) -> DataFrame:
    """Running team features after each game, games in id order, one row per (team, game).

    The game itself counts unless ``include_current`` is False. Ratios divide running counts of the
    same game, also for games without a completion.
    """
    per_game = plays.groupBy(*TEAM_GAME).agg(
        F.avg(F.when(F.col("play_type_design") == "run", F.col("yardsGained"))).alias("_rush"),
        F.count_if(_is_completion()).alias("_completions"),
        F.count_if(_is_attempt()).alias("_attempts"),
        F.count_if(F.col("play_type_design_") == "pa_pass").alias("_play_action"),
        F.count_if(_is_pass() & F.col("play_type_design_").isNotNull()).alias("_pass_calls"),
        F.count_if(F.col("play_type_design_") != "").alias("_calls"),
    )
    out = expanding(
        per_game,
        ["possessionTeam"],
        ["gameId"],
        means={"rush_avg_season": "_rush"},
        ratios={
            "completion_season": ("_completions", "_attempts"),
            "play_action_share": ("_play_action", "_calls"),
            "pass_call_share": ("_pass_calls", "_calls"),
        },
        include_current=include_current,
        hot=hot,
    )
    return out.select(*TEAM_GAME, "rush_avg_season", "completion_season", "play_action_share", "pass_call_share")


def game_to_date(
    plays: DataFrame, at_completions_only: bool = False, fill_across_games: bool = False, hot: HotGroups | None | str = AUTO
) -> DataFrame:
    """Rushing average and completion share inside the game up to and including each play.

    ``at_completions_only`` updates the completion share on completions and carries it in between;
    ``fill_across_games`` lets a team's first plays take over the last value of the rows before.
    """
    out = expanding(
        plays,
        TEAM_GAME,
        ["playId"],
        means={"rush_avg_game": F.when(F.col("play_type_design") == "run", F.col("yardsGained"))},
        ratios={
            "completion_game": (
                F.when(_is_completion(), 1).otherwise(0),
                F.when(_is_attempt(), 1).otherwise(0),
            )
        },
        hot=hot,
    )
    if at_completions_only:
        out = out.withColumn("completion_game", F.when(_is_completion(), F.col("completion_game")))
        out = forward_fill(out, TEAM_GAME, ["playId"], ["completion_game"], hot)
    if fill_across_games:
        out = _fill_across_games(out)
    return out


def _fill_across_games(rows: DataFrame) -> DataFrame:
    """Carry the last value of the previous (team, game) into rows that have none yet.

    Only each game's closing value travels: one row per (team, game) is filled in order and joined
    back, so no task orders all plays.
    """
    columns = ["rush_avg_game", "completion_game"]
    closing = rows.groupBy(*TEAM_GAME).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("playId"))).alias(c) for c in columns]
    )
    teams = F.array_position(closing.agg(F.array_sort(F.collect_set("possessionTeam"))).scalar(), F.col("possessionTeam"))
    ordered = closing.withColumn("_team", teams)
    before = running(ordered, [], ["_team", "gameId"], fills={f"_b_{c}": c for c in columns}, include_current=False)
    out = lookup(rows, before, TEAM_GAME, [f"_b_{c}" for c in columns])
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_b_{c}")) for c in columns}).drop(
        *[f"_b_{c}" for c in columns]
    )


def model_table(
    plays: DataFrame,
    season: DataFrame,
    skip: int = 6,
    bands: Mapping[str, tuple[float, float]] = BANDS,
    categories: Mapping[str, Sequence | None] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Plays with season features; first plays of a team's game, spikes, kneels and outliers removed,
    categories as indicator columns, complete rows only."""
    rows = lookup(plays, season, TEAM_GAME)
    early = F.col("quarter").isin(1, 3)
    late = F.col("quarter").isin(2, 4, 5) & (F.col("qtr_minutes") < 2)
    rows = rows.filter(early | late)
    rows = rows.filter(~F.col("qbSpike").eqNullSafe(F.lit(True)) & (F.col("qbKneel") == 0))
    rows = skip_first(rows, ["gameId", "possessionTeam"], ["playId"], skip)
    rows = within_bands(rows, bands)
    made = one_hot(rows, categories or {})
    features = [c for c in made.columns if c not in rows.columns]
    base = [
        "game_minutes", "yards_to_goal", "poss_team_winning", "poss_team_home", "inMotionAtBallSnap", "motionSinceLineset",
        "shiftSinceLineset", *bands, "play_action_share", "pass_call_share",
    ]
    return drop_missing(made.select(*PLAY, "play_type_design_", *base, *features, *keep))
