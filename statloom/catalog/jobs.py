"""The end-to-end jobs on inputs that Spark derives from the driver tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from statloom.catalog.registry import query
from statloom.catalog.relational import TEAM_GAMES_SQL, team_games
from statloom.functions.scalar import season_code
from statloom.operators.aggregate import value_counts
from statloom.operators.hotgroups import find_hot_early
from statloom.operators.joins import lookup
from statloom.plans import contracts, gamepoints, playbook, presnap, projection
from statloom.sources.files import load_table

# ---- play-by-play summaries ------------------------------------------------------------------------

PBP_SQL = """pbp AS (SELECT CAST(l_linenumber AS VARCHAR) AS Formation, CASE WHEN l_returnflag = 'R' THEN 'run' ELSE 'pass' END AS play_type,
      CASE WHEN l_linestatus = 'O' THEN 'short' WHEN l_quantity > 10 THEN 'deep' END AS pass_length,
      CASE WHEN l_returnflag = 'A' THEN 'left' WHEN l_quantity > 10 THEN 'right' END AS pass_location,
      CASE WHEN l_linestatus = 'O' THEN 'end' WHEN l_quantity > 20 THEN 'tackle' END AS run_gap,
      CASE WHEN l_tax < 0.03 THEN 'left' WHEN l_tax < 0.06 THEN 'right' WHEN l_quantity > 20 THEN 'middle' END AS run_location,
      CAST(CASE WHEN l_quantity = 50 THEN 5 ELSE quarter(l_shipdate) END AS INTEGER) AS qtr,
      CASE WHEN l_tax < 0.02 THEN 1 WHEN l_tax < 0.04 THEN 2 WHEN l_tax < 0.06 THEN 3 WHEN l_tax < 0.08 THEN 4 END AS down,
      CAST(round(l_discount * 100) AS INTEGER) AS distance, CAST(floor(l_quantity / 4) AS INTEGER) AS yds_gained FROM lineitem),
    named AS (SELECT *, CASE WHEN play_type = 'pass' THEN 'pass_' || coalesce(pass_length, 'NA') || '_' || coalesce(pass_location, 'NA')
              ELSE 'run_' || coalesce(run_gap, 'NA') || '_' || coalesce(run_location, 'NA') END AS playcall FROM pbp),
    plays AS (SELECT * FROM named WHERE playcall <> 'pass_NA_NA' AND qtr <> 5 AND down IS NOT NULL)"""


def pbp(spark, d):
    li = load_table(spark, d, "lineitem")
    q, tax, flag, status = F.col("l_quantity"), F.col("l_tax"), F.col("l_returnflag"), F.col("l_linestatus")
    return li.select(
        F.col("l_linenumber").cast("string").alias("Formation"),
        F.when(flag == "R", "run").otherwise("pass").alias("play_type"),
        F.when(status == "O", "short").when(q > 10, "deep").alias("pass_length"),
        F.when(flag == "A", "left").when(q > 10, "right").alias("pass_location"),
        F.when(status == "O", "end").when(q > 20, "tackle").alias("run_gap"),
        F.when(tax < 0.03, "left").when(tax < 0.06, "right").when(q > 20, "middle").alias("run_location"),
        F.when(q == 50, 5).otherwise(F.quarter("l_shipdate")).alias("qtr"),
        F.when(tax < 0.02, 1).when(tax < 0.04, 2).when(tax < 0.06, 3).when(tax < 0.08, 4).alias("down"),
        F.round(F.col("l_discount") * 100).cast("int").alias("distance"),
        F.floor(q / 4).cast("int").alias("yds_gained"),
        F.lit("x").alias("Play call"),
    )


def plays(spark, d):
    return playbook.prepare_plays(pbp(spark, d))


def _conversion_sql(grouping: str, qtr: str, playcall: str, keys: str) -> str:
    size = "CASE WHEN down IN (3, 4) THEN 3.0 ELSE 1.5 END" if grouping == "qtr+down" else "NULL"
    return f"""SELECT '{grouping}' AS grouping, down, {qtr} AS qtr, {playcall} AS playcall, avg(distance) AS avg_needed, avg(yds_gained) AS avg_gained,
        100 * avg(CASE WHEN yds_gained > distance THEN 1.0 ELSE 0.0 END) AS conversion_pct, CAST({size} AS DOUBLE) AS line_size FROM plays GROUP BY {keys}"""


@query(
    "conversion_rates",
    f"""WITH {PBP_SQL} SELECT * FROM ({_conversion_sql('down', 'NULL::INTEGER', 'NULL::VARCHAR', 'down')}) UNION ALL
        SELECT * FROM ({_conversion_sql('qtr+down', 'qtr', 'NULL::VARCHAR', 'qtr, down')}) UNION ALL
        SELECT * FROM ({_conversion_sql('playcall+down', 'NULL::INTEGER', 'playcall', 'playcall, down')})""",
    "avg_needed avg_gained conversion_pct",
)
def conversion_rates(spark, d):
    return playbook.execution(plays(spark, d))


@query(
    "conversion_by_down_long",
    f"""WITH {PBP_SQL}, w AS (SELECT down, avg(distance) AS avg_needed, avg(yds_gained) AS avg_gained,
        100 * avg(CASE WHEN yds_gained > distance THEN 1.0::DOUBLE ELSE 0.0 END) AS conversion_pct FROM plays GROUP BY 1)
        SELECT down, name, value FROM w UNPIVOT (value FOR name IN (avg_needed, avg_gained, conversion_pct))""",
    "value",
)
def conversion_by_down_long(spark, d):
    return playbook.execution_long(plays(spark, d))


@query(
    "formation_by_playcall",
    f"""WITH {PBP_SQL} SELECT Formation, playcall, avg(yds_gained) AS avg_yds_gained, count(*) AS count_, CAST(Formation AS BIGINT) AS formation_order
        FROM plays GROUP BY 1, 2""",
    "avg_yds_gained",
)
def formation_by_playcall(spark, d):
    return playbook.by_formation(plays(spark, d), None)


@query(
    "run_plays_by_down",
    f"""WITH {PBP_SQL} SELECT down, playcall, avg(yds_gained) AS avg_yds_gained,
        list_position(['run_end_right', 'run_tackle_right', 'run_guard_right', 'run_NA_middle', 'run_guard_left', 'run_tackle_left', 'run_end_left'], playcall)::BIGINT AS playcall_order
        FROM plays WHERE play_type = 'run' AND playcall <> 'run_NA_NA' GROUP BY 1, 2""",
    "avg_yds_gained",
)
def run_plays_by_down(spark, d):
    return playbook.runs_by_down(plays(spark, d), None)


@query(
    "zero_gain_passes",
    f"""WITH {PBP_SQL} SELECT down, pass_length, pass_location, avg(CASE WHEN yds_gained = 0 THEN 1.0 ELSE 0.0 END) AS zero_gain_rate,
        list_position(['short', 'deep'], pass_length)::BIGINT AS length_order FROM plays WHERE play_type = 'pass' GROUP BY 1, 2, 3""",
    "zero_gain_rate",
)
def zero_gain_passes(spark, d):
    return playbook.zero_gain_passes(plays(spark, d), None)


@query(
    "filtered_play_view",
    f"""WITH {PBP_SQL} SELECT Formation, playcall, avg(yds_gained) AS avg_yds_gained, count(*) AS count_, CAST(Formation AS BIGINT) AS formation_order FROM plays
        WHERE Formation IN ('1', '3', '5') AND play_type IN ('run') AND playcall IN ('run_end_left', 'run_tackle_right', 'run_end_right') GROUP BY 1, 2""",
    "avg_yds_gained",
)
def filtered_play_view(spark, d):
    view = playbook.filtered_plays(plays(spark, d), ["1", "3", "5"], ["run"], ["run_end_left", "run_tackle_right", "run_end_right"])
    return playbook.by_formation(view, None)


@query(
    "first_down_counts",
    f"""WITH {PBP_SQL} SELECT play_type, CASE WHEN yds_gained > distance THEN '1st Down' ELSE 'Other' END AS first_down_gained, count(*) AS n FROM plays GROUP BY 1, 2""",
)
def first_down_counts(spark, d):
    return value_counts(playbook.filtered_plays(plays(spark, d)), ["play_type", "first_down_gained"])


@query("play_tendencies", f"WITH {PBP_SQL} SELECT down, playcall, count(*) AS n FROM plays GROUP BY 1, 2")
def play_tendencies(spark, d):
    return playbook.tendencies(plays(spark, d), "playcall")


# ---- play-type features ------------------------------------------------------------------------------

SNAP_SQL = """li AS (SELECT l_suppkey AS possessionTeam, l_orderkey AS gameId, l_linenumber * 1000000 + l_partkey AS playId, l_returnflag, l_linestatus, l_quantity, l_discount, l_tax, l_shipdate FROM lineitem),
    snaps AS (SELECT DISTINCT ON (possessionTeam, gameId, playId) *, CASE l_returnflag WHEN 'R' THEN 'run' ELSE 'pass' END AS design,
              CASE WHEN l_returnflag = 'R' THEN 'run' WHEN l_discount > 0.06 THEN 'pa_pass' ELSE 'pass' END AS design2,
              CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_tax > 0.07 THEN 'S' WHEN l_quantity > 15 THEN 'C' ELSE 'I' END AS result FROM li
              ORDER BY possessionTeam, gameId, playId, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"""


def snaps(spark, d, dealt=()):
    """Line items as plays: supplier = team, order = game, line and part = play.

    Rows ``dealt`` by some of these serve later steps that group or join by the same without another exchange.
    """
    li = load_table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("possessionTeam"),
        F.col("l_orderkey").alias("gameId"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("playId"),
        F.struct("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate").alias("v"),
    )
    li = li.repartition(*dealt) if dealt else li
    one = li.groupBy("possessionTeam", "gameId", "playId").agg(F.min("v").alias("v")).select("possessionTeam", "gameId", "playId", "v.*")
    flag, disc, tax, q = F.col("l_returnflag"), F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    return one.select(
        "possessionTeam", "gameId", "playId",
        F.when(flag == "R", "run").otherwise("pass").alias("play_type_design"),
        F.when(flag == "R", "run").when(disc > 0.06, "pa_pass").otherwise("pass").alias("play_type_design_"),
        F.when(flag != "R", F.when(tax > 0.07, "S").when(q > 15, "C").otherwise("I")).alias("passResult"),
        q.alias("yardsGained"),
        F.quarter("l_shipdate").alias("quarter"),
        F.concat_ws(":", F.floor(q / 4).cast("int"), F.floor(disc * 500).cast("int")).alias("gameClock"),
        F.when(disc < 0.05, F.col("possessionTeam")).otherwise(F.lit(-1)).alias("yardlineSide"),
        q.alias("yardlineNumber"),
        (q * 2).alias("preSnapHomeScore"), (q + 20).alias("preSnapVisitorScore"),
        (q == 13).alias("qbSpike"), F.when(q == 7, 1).otherwise(0).alias("qbKneel"),
        F.when(tax < 0.02, 1).when(tax < 0.04, 2).when(tax < 0.06, 3).otherwise(4).alias("down"),
        F.col("l_linestatus").alias("offenseFormation"),
    )


_SEASON_SQL = """g AS (SELECT possessionTeam, gameId, avg(CASE WHEN design = 'run' THEN l_quantity END) AS rush, count(*) FILTER (WHERE design = 'pass' AND result = 'C') AS comp,
      count(*) FILTER (WHERE design = 'pass' AND result IS NOT NULL AND result NOT IN ('S', 'R')) AS att, count(*) FILTER (WHERE design2 = 'pa_pass') AS pa,
      count(*) FILTER (WHERE design = 'pass') AS pass_calls, count(*) AS calls FROM snaps GROUP BY 1, 2),
    season AS (SELECT possessionTeam, gameId, avg(rush) OVER w AS rush_avg_season, sum(comp) OVER w / nullif(sum(att) OVER w, 0) AS completion_season,
      sum(pa) OVER w / sum(calls) OVER w AS play_action_share, sum(pass_calls) OVER w / sum(calls) OVER w AS pass_call_share
      FROM g WINDOW w AS (PARTITION BY possessionTeam ORDER BY gameId ROWS UNBOUNDED PRECEDING))"""
_GAME_SQL = """game AS (SELECT *, avg(CASE WHEN design = 'run' THEN l_quantity END) OVER w AS rush_avg_game,
      sum(CASE WHEN design = 'pass' AND result = 'C' THEN 1 ELSE 0 END) OVER w / nullif(sum(CASE WHEN design = 'pass' AND result IS NOT NULL AND result NOT IN ('S', 'R') THEN 1 ELSE 0 END) OVER w, 0) AS completion_game
      FROM snaps WINDOW w AS (PARTITION BY possessionTeam, gameId ORDER BY playId ROWS UNBOUNDED PRECEDING))"""


@query(
    "team_season_features",
    f"WITH {SNAP_SQL}, {_SEASON_SQL} SELECT * FROM season",
    "rush_avg_season completion_season play_action_share pass_call_share",
)
def team_season_features(spark, d):
    return presnap.season_to_date(snaps(spark, d))


@query(
    "in_game_features",
    f"WITH {SNAP_SQL}, {_GAME_SQL} SELECT possessionTeam, gameId, playId, rush_avg_game, completion_game FROM game",
    "rush_avg_game completion_game",
)
def in_game_features(spark, d):
    out = presnap.game_to_date(snaps(spark, d))
    return out.select("possessionTeam", "gameId", "playId", "rush_avg_game", "completion_game")


def _people(spark, d):
    """Same-part line items as the players on a play, brands as positions."""
    li = load_table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax"])
    player_play = li.select(
        F.col("l_orderkey").alias("gameId"),
        F.col("l_linenumber").cast("bigint").alias("playId"),
        F.col("l_partkey").alias("nflId"),
        (F.col("l_quantity") > 40).alias("inMotionAtBallSnap"),
        F.when(F.col("l_discount") > 0.05, F.col("l_discount") > 0.08).alias("motionSinceLineset"),
        (F.col("l_tax") > 0.06).alias("shiftSinceLineset"),
    )
    part = load_table(spark, d, "part", ["p_partkey", "p_size"])
    players = part.select(
        F.col("p_partkey").alias("nflId"), F.when(F.col("p_size") < 20, "TE").when(F.col("p_size") < 30, "RB").otherwise("WR").alias("position")
    )
    return presnap.personnel(player_play, players)


@query(
    "personnel_on_play",
    """SELECT l_orderkey AS gameId, CAST(l_linenumber AS BIGINT) AS playId, count(*) FILTER (WHERE p_size < 20) AS te_count, count(*) FILTER (WHERE p_size >= 20 AND p_size < 30) AS rb_count,
              bool_or(l_quantity > 40) AS inMotionAtBallSnap, bool_or(l_discount > 0.08) AS motionSinceLineset, bool_or(l_tax > 0.06) AS shiftSinceLineset,
              CAST(count(*) FILTER (WHERE p_size >= 20 AND p_size < 30) AS VARCHAR) || CAST(count(*) FILTER (WHERE p_size < 20) AS VARCHAR) AS personnel
       FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""",
)
def personnel_on_play(spark, d):
    return _people(spark, d)


@query(
    "play_type_model_table",
    f"""WITH {SNAP_SQL}, {_SEASON_SQL}, {_GAME_SQL},
        j AS (SELECT game.*, s.* EXCLUDE (possessionTeam, gameId), floor(l_quantity / 4) + floor(l_discount * 500) / 60 AS minutes, quarter(l_shipdate) AS quarter
              FROM game LEFT JOIN season s USING (possessionTeam, gameId)),
        k AS (SELECT *, row_number() OVER (PARTITION BY gameId, possessionTeam ORDER BY playId) AS rn FROM j
              WHERE (quarter IN (1, 3) OR (quarter IN (2, 4, 5) AND minutes < 2)) AND NOT l_quantity = 13 AND l_quantity <> 7)
        SELECT gameId, playId, design2 AS play_type_design_, (quarter - 1) * 15 + minutes AS game_minutes,
               CASE WHEN l_discount < 0.05 THEN l_quantity + 50 ELSE l_quantity END AS yards_to_goal, CASE WHEN l_quantity * 2 > l_quantity + 20 THEN 1 ELSE 0 END AS poss_team_winning, 1 AS poss_team_home,
               rush_avg_season, rush_avg_game, completion_season, completion_game, play_action_share, pass_call_share, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS "offenseFormation_O",
               CASE WHEN l_tax >= 0.02 AND l_tax < 0.04 THEN 1 ELSE 0 END AS down_2, CASE WHEN l_tax >= 0.04 AND l_tax < 0.06 THEN 1 ELSE 0 END AS down_3, CASE WHEN l_tax >= 0.06 THEN 1 ELSE 0 END AS down_4
        FROM k WHERE rn > 1 AND rush_avg_season BETWEEN 10 AND 45 AND rush_avg_game BETWEEN 0 AND 60 AND completion_season BETWEEN 0.5 AND 0.9 AND completion_game BETWEEN 0.1 AND 1""",
    "game_minutes rush_avg_season rush_avg_game completion_season completion_game play_action_share pass_call_share",
)
def play_type_model_table(spark, d):
    li = load_table(spark, d, "lineitem", ["l_suppkey", "l_orderkey"])
    games = load_table(spark, d, "orders", ["o_orderkey"]).select(F.col("o_orderkey").alias("gameId"))
    # a game that repeats repeats its plays
    once = games.groupBy("gameId").count().filter("count > 1").isEmpty()
    hot = find_hot_early(li if once else lookup(li, games, {"l_orderkey": "gameId"}), ["l_suppkey", "l_orderkey"])
    # without team or game a play has no season and is left out; plays and first plays then share an exchange
    rows = snaps(spark, d, () if hot else presnap.PLAY).filter("possessionTeam IS NOT NULL AND gameId IS NOT NULL")
    people = rows.select("gameId", "playId").distinct().withColumns(
        {c: F.lit(True) for c in ("inMotionAtBallSnap", "motionSinceLineset", "shiftSinceLineset")}
    )
    rows = rows.withColumns({"homeTeamAbbr": F.col("possessionTeam"), "visitorTeamAbbr": F.lit(-1)})
    rows = presnap.game_to_date(presnap.situation(rows, games, people), hot=hot)
    season = snaps(spark, d, () if hot else presnap.TEAM_GAME)
    season = presnap.season_to_date(season, hot=find_hot_early(li, ["l_suppkey"]))
    bands = {"rush_avg_season": (10, 45), "rush_avg_game": (0, 60), "completion_season": (0.5, 0.9), "completion_game": (0.1, 1.0)}
    table = presnap.model_table(
        rows, season, 1, bands, {"offenseFormation": ["F", "O"], "down": [1, 2, 3, 4]}
    )
    return table.drop("inMotionAtBallSnap", "motionSinceLineset", "shiftSinceLineset")


# ---- game-level scoring features -----------------------------------------------------------------------


@query(
    "scoring_features",
    f"""WITH {TEAM_GAMES_SQL}, logs AS (SELECT l_orderkey AS gameId, l_partkey AS playerId, l_suppkey AS teamAbbrev, CAST(year(o_orderdate) * 10001 + 1 AS INTEGER) AS season, sum(l_quantity) AS shots
             FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3, 4),
        career AS (SELECT playerId, season AS seasonId, count(*) AS games FROM logs GROUP BY 1, 2)
        SELECT l.gameId, l.playerId, l.teamAbbrev, l.season, l.shots, c.games, f.n AS team_n, a.shots AS against_shots, g.n AS goalie_n FROM logs l
        LEFT JOIN career c ON c.playerId = l.playerId AND c.seasonId = l.season LEFT JOIN team_games f ON f.game = l.gameId AND f.team = l.teamAbbrev
        LEFT JOIN team_games a ON a.game = l.gameId AND a.opponent = l.teamAbbrev LEFT JOIN team_games g ON g.game = l.gameId AND g.opponent = l.teamAbbrev WHERE l.season = 19971998""",
)
def scoring_features(spark, d):
    li = load_table(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"])
    orders = load_table(spark, d, "orders", ["o_orderkey", "o_orderdate"])
    logs = (
        li.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(
            F.col("l_orderkey").alias("gameId"), F.col("l_partkey").alias("playerId"), F.col("l_suppkey").alias("teamAbbrev"),
            season_code(F.year("o_orderdate")).alias("season"),
        )
        .agg(F.sum("l_quantity").alias("shots"))
    )
    career = logs.groupBy("playerId", F.col("season").alias("seasonId")).agg(F.count(F.lit(1)).alias("games"))
    games = team_games(spark, d).select(
        F.col("game").alias("gameId"), F.col("team").alias("teamAbbrev"), F.col("opponent").alias("opponentAbbrev"), "shots", "n"
    )
    return gamepoints.feature_table(
        logs, career, games.withColumnRenamed("n", "team_n"), games.withColumnRenamed("shots", "against_shots"),
        games.withColumnRenamed("n", "goalie_n"), 19971998, ["games"], ["team_n"], ["against_shots"], ["goalie_n"],
    )


# ---- contract comparables ------------------------------------------------------------------------------

CAREER_SQL = """seasons AS (SELECT o_custkey AS playerId, CAST(year(o_orderdate) * 10001 + 1 AS INTEGER) AS seasonId, count(*) AS gamesPlayed, CAST(sum(CAST(o_totalprice / 10000 AS INTEGER)) AS BIGINT) AS points,
      CAST(sum(CAST(o_totalprice / 20000 AS INTEGER)) AS BIGINT) AS goals, CAST(sum(CAST(o_totalprice / 15000 AS INTEGER)) AS BIGINT) AS evPoints, CAST(sum(CAST(o_totalprice / 30000 AS INTEGER)) AS BIGINT) AS evGoals,
      avg(o_totalprice) / 10000 AS pointsPerGame, max(o_totalprice) / 1000 AS timeOnIcePerGame FROM orders GROUP BY 1, 2),
    career AS (SELECT *, evPoints / gamesPlayed AS evPointsPerGame, sum(gamesPlayed) OVER p AS career_gp, sum(points) OVER p AS career_points, sum(goals) OVER p AS career_goals,
      row_number() OVER w AS szn_no, sum(gamesPlayed) OVER w AS career_to_date_gp, sum(points) OVER w AS career_to_date_points, sum(evPoints) OVER w AS career_to_date_ev_points,
      coalesce(avg(timeOnIcePerGame) OVER b, 0) AS career_to_date_toi_avg, coalesce(sum(points) OVER b, 0) / sum(gamesPlayed) OVER w AS career_to_date_p_pg,
      coalesce(sum(evPoints) OVER b, 0) / sum(gamesPlayed) OVER w AS career_to_date_ev_p_pg,
      CASE WHEN count(*) OVER l3 = 3 THEN avg(points) OVER l3 END AS "points_avg_L3", CASE WHEN count(*) OVER l2 = 2 THEN avg(points) OVER l2 END AS "points_avg_L2",
      CAST(floor(date_diff('day', DATE '1972-05-20', make_date(seasonId // 10000, 7, 1)) / 365.25) AS INTEGER) AS july_1_age
      FROM seasons WINDOW p AS (PARTITION BY playerId), w AS (PARTITION BY playerId ORDER BY seasonId ROWS UNBOUNDED PRECEDING),
      b AS (PARTITION BY playerId ORDER BY seasonId ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), l3 AS (PARTITION BY playerId ORDER BY seasonId ROWS 2 PRECEDING),
      l2 AS (PARTITION BY playerId ORDER BY seasonId ROWS 1 PRECEDING))"""
CAREER_COLUMNS = [
    "playerId", "seasonId", "szn_no", "career_gp", "career_points", "career_goals", "career_to_date_gp", "career_to_date_points",
    "career_to_date_ev_points", "career_to_date_toi_avg", "career_to_date_p_pg", "career_to_date_ev_p_pg", "points_avg_L3", "points_avg_L2", "july_1_age",
]


def seasons(spark, d):
    """Customers as players, order years as seasons."""
    orders = load_table(spark, d, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    price = F.col("o_totalprice")
    whole = lambda size: F.sum(F.round(price / size).cast("int"))
    return orders.groupBy(F.col("o_custkey").alias("playerId"), season_code(F.year("o_orderdate")).alias("seasonId")).agg(
        F.count(F.lit(1)).alias("gamesPlayed"),
        whole(10000).alias("points"), whole(20000).alias("goals"), whole(15000).alias("evPoints"), whole(30000).alias("evGoals"),
        (F.avg(price) / 10000).alias("pointsPerGame"),
        (F.max(price) / 1000).alias("timeOnIcePerGame"),
    )


def careers(spark, d):
    cust = load_table(spark, d, "customer", ["c_custkey"])
    bios = cust.select(F.col("c_custkey").alias("playerId"), F.lit("1972-05-20").cast("date").alias("birthDate"))
    return contracts.career_table(seasons(spark, d), bios, digits=None)


@query(
    "career_features",
    f"""WITH {CAREER_SQL} SELECT playerId, seasonId, szn_no, CAST(career_gp AS BIGINT) AS career_gp, CAST(career_points AS BIGINT) AS career_points, CAST(career_goals AS BIGINT) AS career_goals,
        CAST(career_to_date_gp AS BIGINT) AS career_to_date_gp, CAST(career_to_date_points AS BIGINT) AS career_to_date_points, CAST(career_to_date_ev_points AS BIGINT) AS career_to_date_ev_points,
        career_to_date_toi_avg, career_to_date_p_pg, career_to_date_ev_p_pg, "points_avg_L3", "points_avg_L2", july_1_age FROM career""",
    "career_to_date_toi_avg career_to_date_p_pg career_to_date_ev_p_pg points_avg_L3 points_avg_L2",
)
def career_features(spark, d):
    return careers(spark, d).select(*CAREER_COLUMNS)


CURRENT = 20002001
CONTRACT_SQL = """deals AS (SELECT o_orderkey AS contract_id, o_custkey AS nhl_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'Defense' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Goaltender' WHEN o_orderpriority = '3-MEDIUM' THEN 'Left Wing' ELSE 'Center' END AS position,
      1 + CAST(floor(o_totalprice / 100000) AS INTEGER) AS length, year(o_orderdate) AS y, o_totalprice * 100 AS value, CASE WHEN o_orderstatus = 'F' THEN 'RFA' ELSE 'UFA' END AS signing, CASE WHEN o_orderstatus = 'O' THEN 'RFA' ELSE 'UFA' END AS expiry FROM orders),
    dated AS (SELECT *, CASE WHEN y + length = 2000 THEN 20002001 ELSE y * 10001 + 1 END AS contract_year FROM deals),
    rows_ AS (SELECT contract_id, nhl_id, position, length, value, CAST(contract_year AS INTEGER) AS contract_year, CASE WHEN contract_year = 20002001 THEN expiry ELSE signing END AS signing_status FROM dated)"""


def contract_players(spark, d):
    """Orders as records of a player with one current contract, repeated as a future one if unrestricted."""
    orders = load_table(spark, d, "orders")
    price, year = F.col("o_totalprice"), F.year("o_orderdate")
    length = 1 + F.floor(price / 100000).cast("int")
    deal = F.struct(
        F.col("o_orderkey").alias("contract_id"),
        F.concat_ws("-", year + length, year + length + 1).alias("contract_end"),
        length.cast("string").alias("length"),
        (price * 100).alias("value"),
        F.when(F.col("o_orderstatus") == "F", "RFA").otherwise("UFA").alias("signing_status"),
        F.when(F.col("o_orderstatus") == "O", "RFA").otherwise("UFA").alias("expiry_status"),
    )
    priority = F.col("o_orderpriority")
    position = F.when(priority == "5-LOW", "Defense").when(priority == "4-NOT SPECIFIED", "Goaltender").when(priority == "3-MEDIUM", "Left Wing").otherwise("Center")
    nested = orders.select(F.col("o_custkey").alias("nhl_id"), position.alias("position"), F.array(deal).alias("current"))
    return nested.withColumn("future", F.filter("current", lambda c: c["signing_status"] == "UFA"))


@query(
    "contract_rows",
    f"""WITH {CONTRACT_SQL} SELECT contract_id, nhl_id, position, CAST(length AS VARCHAR) AS length, value, contract_year, signing_status FROM rows_""",
    "value",
    2,
)
def contract_rows(spark, d):
    out = contracts.contract_table(contract_players(spark, d), CURRENT)
    return out.select("contract_id", "nhl_id", "position", "length", "value", "contract_year", "signing_status")


COMPS_SQL = f"""{CAREER_SQL}, {CONTRACT_SQL},
    t AS (SELECT r.contract_id, r.contract_year, r.signing_status, CASE WHEN r.position = 'Defense' THEN 'Defense' ELSE 'Forward' END AS pos_group, r.nhl_id,
          r.value / r.length / 1000000 * 100 AS cap_raw, c.* FROM rows_ r JOIN career c ON c.playerId = r.nhl_id AND c.seasonId = r.contract_year WHERE r.position <> 'Goaltender'),
    pct AS (SELECT *, career_to_date_gp / (szn_no * 82) AS pct_gp FROM t),
    z AS (SELECT *, {', '.join(f"coalesce(({c} - avg({c}) OVER g) / nullif(stddev_pop({c}) OVER g, 0), 0) AS z_{c}" for c in ("july_1_age", "career_to_date_gp", "career_to_date_p_pg", "career_to_date_ev_p_pg", "career_to_date_toi_avg", "pct_gp", "gamesPlayed", "pointsPerGame", "timeOnIcePerGame"))}
          FROM pct WINDOW g AS (PARTITION BY signing_status, pos_group)),
    f AS (SELECT contract_id, contract_year, signing_status, pos_group, cap_raw,
          {', '.join(f"CASE WHEN signing_status = 'RFA' THEN z_{r} ELSE z_{u} * CASE WHEN pos_group = 'Forward' THEN {w} ELSE 1.0 END END AS f{i}" for i, (r, u, w) in enumerate(zip(contracts.RFA_FEATURES, contracts.UFA_FEATURES, (1.0, 1.0, 1.0, 0.25, 0.25, 0.25))))} FROM z),
    n AS (SELECT q.signing_status, q.pos_group, q.contract_id AS subject_id, c.contract_id, c.cap_raw, sqrt({' + '.join(f'power(q.f{i} - c.f{i}, 2)' for i in range(6))}) AS distance
          FROM f q JOIN f c ON q.signing_status = c.signing_status AND q.pos_group = c.pos_group AND q.contract_year = {CURRENT} AND c.contract_year <> {CURRENT} AND c.contract_year >= {CURRENT} - 30003),
    near AS (SELECT *, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY round(distance, 9), contract_id) AS INTEGER) AS position FROM n QUALIFY position <= 5)"""


def contract_table(spark, d):
    caps = contracts.cap_table(spark.range(1), {y * 10001 + 1: 1_000_000 for y in range(1990, 2010)})
    read = [*contracts.RFA_FEATURES, *contracts.UFA_FEATURES]
    return contracts.contract_seasons(contracts.contract_table(contract_players(spark, d), CURRENT), careers(spark, d), caps, digits=None, columns=read)


@query(
    "contract_comparables",
    f"WITH {COMPS_SQL} SELECT signing_status, pos_group, subject_id, position, contract_id, distance FROM near",
    "distance",
)
def contract_comparables(spark, d):
    return contracts.comparables(contract_table(spark, d), CURRENT)


@query(
    "contract_estimates",
    f"""WITH {COMPS_SQL} SELECT subject_id, CASE WHEN count(*) = 5 THEN sum(cap_raw * [0.3, 0.25, 0.2, 0.15, 0.1][position]) END AS cap_hit_pct FROM near GROUP BY 1""",
    "cap_hit_pct",
)
def contract_estimates(spark, d):
    table = contract_table(spark, d)
    out = contracts.estimates(contracts.comparables(table, CURRENT), table, 1_000_000.0, (1_100_000.0, 1_200_000.0), digits=None)
    return out.select("subject_id", "cap_hit_pct")


@query(
    "contract_trajectories",
    f"""WITH {COMPS_SQL}, who AS (SELECT subject_id, position, contract_id FROM near UNION ALL SELECT DISTINCT subject_id, 0, subject_id FROM near)
        SELECT w.subject_id, CAST(w.position AS INTEGER) AS position, w.contract_id, t.nhl_id, c.seasonId, c.july_1_age, c.points, c.pointsPerGame
        FROM who w LEFT JOIN t ON t.contract_id = w.contract_id LEFT JOIN career c ON c.playerId = t.nhl_id""",
    "pointsPerGame",
)
def contract_trajectories(spark, d):
    table = contract_table(spark, d)
    return contracts.trajectories(contracts.comparables(table, CURRENT), table, careers(spark, d), ["points", "pointsPerGame"])


# ---- projection ----------------------------------------------------------------------------------------

STATS_SQL = """stats AS (SELECT o_custkey AS player, CAST(year(o_orderdate) AS VARCHAR) || '-' || substr(CAST(year(o_orderdate) + 1 AS VARCHAR), 3, 2) AS season, year(o_orderdate) AS yr,
      avg(o_totalprice) / 1000000 AS rate, max(o_totalprice) / 10000 AS toi, min(o_totalprice) / 10000 AS icf, year(o_orderdate) - 1970.0::DOUBLE + avg(month(o_orderdate)) / 24 AS age FROM orders GROUP BY o_custkey, year(o_orderdate)),
    lagged AS (SELECT *, lag(rate, 1) OVER w AS rate_prev1, lag(rate, 2) OVER w AS rate_prev2, lag(toi, 1) OVER w AS toi_prev1, lag(toi, 2) OVER w AS toi_prev2, lag(icf, 1) OVER w AS icf_prev1,
      lag(icf, 2) OVER w AS icf_prev2, lag(age, 1) OVER w AS age_prev1, lag(age, 2) OVER w AS age_prev2, rate AS target FROM stats WINDOW w AS (PARTITION BY player ORDER BY yr)),
    model AS (SELECT * FROM lagged WHERE rate_prev2 IS NOT NULL AND target <> 0 AND target < 0.8),
    quart AS (SELECT *, CASE WHEN age_prev1 >= 30 THEN '30+' WHEN age_prev1 >= 27 THEN '27-29' WHEN age_prev1 <= 26 THEN '26u' END AS age_bucket FROM model),
    tiles AS (SELECT *, CAST(ntile(4) OVER (PARTITION BY age_bucket ORDER BY rate_prev1, player, yr) AS INTEGER) AS quartile FROM quart),
    changes AS (SELECT age_bucket, quartile, avg(rate_prev1 - rate_prev2) AS rate_change, avg(toi_prev1 - toi_prev2) AS toi_change, avg(icf_prev1 - icf_prev2) AS icf_change FROM tiles GROUP BY 1, 2)"""


def stats(spark, d):
    orders = load_table(spark, d, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    price, year = F.col("o_totalprice"), F.year("o_orderdate")
    return (
        orders.groupBy(F.col("o_custkey").alias("player"), year.alias("_y"))
        .agg(
            (F.avg(price) / 1000000).alias("rate"), (F.max(price) / 10000).alias("toi"), (F.min(price) / 10000).alias("icf"),
            (F.avg(F.month("o_orderdate")) / 24).alias("_part"),
        )
        .select(
            "player", F.concat_ws("-", F.col("_y"), F.substring((F.col("_y") + 1).cast("string"), 3, 2)).alias("season"),
            "rate", "toi", "icf", (F.col("_y") - 1970.0 + F.col("_part")).alias("age"),
        )
    )


@query(
    "lagged_model_table",
    f"WITH {STATS_SQL} SELECT player, season, target, rate_prev1, rate_prev2, toi_prev1, toi_prev2, icf_prev1, icf_prev2, age_prev1, age_prev2 FROM model",
    "target rate_prev1 rate_prev2 toi_prev1 toi_prev2 icf_prev1 icf_prev2 age_prev1 age_prev2",
)
def lagged_model_table(spark, d):
    out = projection.model_table(stats(spark, d))
    return out.drop("rate", "toi", "icf", "age")


@query("yearly_changes", f"WITH {STATS_SQL} SELECT * FROM changes", "rate_change toi_change icf_change")
def yearly_changes(spark, d):
    return projection.yearly_changes(projection.model_table(stats(spark, d)), ["player", "season"])


HOLDOUT, LAST_TRAIN, STEPS = "1998-99", "1998", 3


def _least_squares_sql(source: str, target: str, features: Sequence[str]) -> list[str]:
    """Tables that end in ``coef`` (c0, c1, ..): features are made orthogonal one after the other."""
    k = len(features)
    centred = ", ".join(f"{f} - avg({f}) OVER () AS q0_{j}" for j, f in enumerate(features))
    means = ", ".join(f"avg({f}) AS m{j}" for j, f in enumerate(features))
    parts = [
        f"means AS (SELECT avg({target}) AS my, {means} FROM {source})",
        f"o0 AS (SELECT {target} - avg({target}) OVER () AS y0, {centred} FROM {source})",
    ]
    for i in range(k):
        z = f"q{i}_{i}"
        g = [f"sum({z} * q{i}_{j}) / sum({z} * {z}) AS g{i}_{j}" for j in range(i + 1, k)]
        parts.append(f"g{i} AS (SELECT {', '.join([f'sum({z} * y{i}) / sum({z} * {z}) AS h{i}', *g])} FROM o{i})")
        left = [f"q{i}_{j} - g{i}_{j} * {z} AS q{i + 1}_{j}" for j in range(i + 1, k)]
        parts.append(f"o{i + 1} AS (SELECT {', '.join([f'y{i} - h{i} * {z} AS y{i + 1}', *left])} FROM o{i}, g{i})")
    joined = f"SELECT * FROM means, {', '.join(f'g{i}' for i in range(k))}"
    for i in reversed(range(k)):
        later = "".join(f" - g{i}_{j} * c{j + 1}" for j in range(i + 1, k))
        joined = f"SELECT *, h{i}{later} AS c{i + 1} FROM ({joined})"
    parts.append(f"coef AS (SELECT *, my{''.join(f' - m{j} * c{j + 1}' for j in range(k))} AS c0 FROM ({joined}))")
    return parts


def _project_sql(features: Sequence[str], final: str | None = None) -> str:
    """The projection unrolled: one set of tables per season forward."""
    def fit(row: str) -> str:
        return "c0" + "".join(f" + c{j + 1} * {row}.{f}" for j, f in enumerate(features)) + " AS fit"

    parts = [
        STATS_SQL,
        f"x AS (SELECT target, {', '.join(features)} FROM model WHERE season < '{LAST_TRAIN}')",
        *_least_squares_sql("x", "target", features),
        f"""h0 AS (SELECT m.player, m.season, m.yr, m.rate_prev1, m.rate_prev2, m.toi_prev1, m.icf_prev1, m.age_prev1, {fit('m')}, m.target AS actual
            FROM model m, coef WHERE season = '{HOLDOUT}')""",
    ]
    for i in range(1, STEPS + 1):
        parts += [
            f"""b{i} AS (SELECT player, yr + 1 AS yr, CAST(yr + 1 AS VARCHAR) || '-' || substr(CAST(yr + 2 AS VARCHAR), 3, 2) AS season, fit AS rate_prev1, rate_prev1 AS rate_prev2, toi_prev1, icf_prev1, age_prev1 + 1 AS age_prev1,
                CASE WHEN age_prev1 + 1 >= 30 THEN '30+' WHEN age_prev1 + 1 >= 27 THEN '27-29' WHEN age_prev1 + 1 <= 26 THEN '26u' END AS age_bucket FROM h{i - 1})""",
            f"t{i} AS (SELECT *, ntile(4) OVER (PARTITION BY age_bucket ORDER BY rate_prev1, player) AS quartile FROM b{i})",
            f"""u{i} AS (SELECT t.player, t.season, t.yr, t.rate_prev1, t.rate_prev2, t.toi_prev1 * (1 + CASE WHEN t.age_bucket = '30+' AND t.quartile IN (1, 2, 3) THEN -0.2::DOUBLE
                WHEN t.age_bucket = '27-29' AND t.quartile IN (2, 3, 4) THEN 0.025 WHEN t.age_bucket = '26u' THEN 0.2 WHEN t.age_bucket IS NOT NULL THEN 0.01 END) AS toi_prev1, t.icf_prev1 * (1 + c.icf_change) AS icf_prev1, t.age_prev1
                FROM t{i} t LEFT JOIN changes c ON c.age_bucket = t.age_bucket AND c.quartile = t.quartile)""",
            f"h{i} AS (SELECT u.*, {fit('u')}, s.rate AS actual FROM u{i} u JOIN stats s ON s.player = u.player AND s.season = u.season, coef)",
        ]
    every = " UNION ALL ".join(
        f"SELECT player, season, {i} AS horizon, rate_prev1, rate_prev2, toi_prev1, icf_prev1, age_prev1, fit, actual FROM h{i}" for i in range(STEPS + 1)
    )
    return f"WITH {', '.join(parts)}, every AS ({every}) {final or 'SELECT * FROM every'}"


TWO = ("rate_prev1", "toi_prev1")


def _projected(spark, d, features=TWO):
    table = projection.cut_lineage(projection.model_table(stats(spark, d)))
    fit = projection.train(table, F.col("season") < LAST_TRAIN, features)
    changes = projection.yearly_changes(table, ["player", "season"])
    actuals = stats(spark, d).select("player", "season", F.col("rate").alias("actual"))
    return projection.project(table.filter(F.col("season") == HOLDOUT), fit, changes, actuals, STEPS)


PROJECTED = ["player", "season", "horizon", "rate_prev1", "rate_prev2", "toi_prev1", "icf_prev1", "age_prev1", "fit", "actual"]


@query("projected_seasons", _project_sql(TWO), "rate_prev1 rate_prev2 toi_prev1 icf_prev1 age_prev1 fit actual")
def projected_seasons(spark, d):
    return _projected(spark, d).select(*PROJECTED)


@query("projected_seasons_all_features", _project_sql(projection.FEATURES), "rate_prev1 rate_prev2 toi_prev1 icf_prev1 age_prev1 fit actual", 4)
def projected_seasons_all_features(spark, d):
    """Three seasons forward with all five regressors."""
    return _projected(spark, d, projection.FEATURES).select(*PROJECTED)


_EDGES = list(zip(projection.ERROR_BREAKS, projection.ERROR_BREAKS[1:]))
_SHARES = f"""SELECT season, error_bucket, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY season) AS share
    FROM (SELECT season, CASE {' '.join(f"WHEN e > {a} AND e <= {b} THEN '({a},{b}]'" for a, b in _EDGES)} END AS error_bucket
          FROM (SELECT season, abs(round_even((actual - fit) * {projection.PACE}, 0)) AS e FROM every)) GROUP BY season, error_bucket"""


@query("projection_error_shares", _project_sql(projection.FEATURES, _SHARES), "share")
def projection_error_shares(spark, d):
    """How far the projections of all five regressors are off, three seasons forward."""
    return projection.error_shares(_projected(spark, d, projection.FEATURES))


@query("projection_with_all_features")
def projection_with_all_features(spark, d):
    table = projection.cut_lineage(projection.model_table(stats(spark, d)))
    fit = projection.train(table, F.col("season") < LAST_TRAIN)
    return fit.coefficient_table(spark)
