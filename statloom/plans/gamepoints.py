"""Feature table and classifiers for 'the player scores a point in this game'."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators import learn
from statloom.operators.encode import stratified_split, with_folds
from statloom.operators.hotgroups import find_hot
from statloom.operators.joins import lookup, opponent_lookup
from statloom.operators.project import drop_missing
from statloom.operators.windows import prior_average, prior_trailing_average


def player_form(logs: DataFrame, player: str, order: Sequence[str], columns: Sequence[str], spans: Sequence[int] = (5, 30)) -> DataFrame:
    """Season-to-date and last-k-game averages of each player, the current game left out."""
    out = prior_average(logs, [player, "season"], order, {f"{c}_agg": c for c in columns})
    hot = find_hot(out, [player], order[0])
    for k in spans:
        out = prior_trailing_average(out, [player], order, {f"l{k}_{c}": c for c in columns}, k, hot)
    return out


def feature_table(
    logs: DataFrame,
    careers: DataFrame,
    team_for: DataFrame,
    team_against: DataFrame,
    goalies: DataFrame,
    season: int,
    career_columns: Sequence[str],
    team_columns: Sequence[str],
    against_columns: Sequence[str],
    goalie_columns: Sequence[str],
) -> DataFrame:
    """One season's player-games with career, own-team, opposing-team and opposing-goalie features."""
    rows = logs.filter(F.col("season") == season)
    rows = lookup(rows, careers, {"playerId": "playerId", "season": "seasonId"}, career_columns)
    rows = lookup(rows, team_for, ["gameId", "teamAbbrev"], team_columns)
    rows = opponent_lookup(rows, team_against, "gameId", "teamAbbrev", "opponentAbbrev", against_columns)
    return opponent_lookup(rows, goalies, "gameId", "teamAbbrev", "opponentAbbrev", goalie_columns)


def training_rows(
    table: DataFrame, label: str, key: str, features: Sequence[str], keep: Mapping[str, object] | None = None, folds: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Complete rows as (train, test) with assembled features, an exact stratified 20 % test part
    and fold numbers."""
    rows = table
    for column, value in (keep or {}).items():
        rows = rows.filter(F.col(column) == value)
    rows = drop_missing(rows.select(key, F.col(label).cast("double").alias("label"), *features))
    rows = with_folds(stratified_split(rows, "label", key, 0.2), key, folds)
    ready = learn.assemble(rows, features)
    return ready.filter(~F.col("is_test")), ready.filter("is_test")


def fit_and_score(train: DataFrame, test: DataFrame, estimator) -> tuple[object, DataFrame]:
    """Fitted model and its test accuracy, precision, recall and F1."""
    model = estimator.fit(train)
    return model, learn.binary_scores(model.transform(test))
