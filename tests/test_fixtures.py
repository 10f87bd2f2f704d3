"""Edge cases on small literal inputs, closed forms and brute-force comparisons."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions.scalar import bucket_label, clock_minutes, epoch_ms, keyed_uniform, season_text
from statloom.functions.text import dotted_name, fold_unicode, jaro
from statloom.operators import crosssection as cs
from statloom.operators.encode import one_hot, stratified_split
from statloom.operators.fuzzy import fuzzy_left_join, similar_pairs
from statloom.operators.joins import explode_lists
from statloom.operators.knn import nearest, weighted_estimate
from statloom.operators.project import keep_extreme
from statloom.operators.regress import fit_ols
from statloom.operators.simulate import expected_loss, simulate_losses
from statloom.operators.timegrid import compound_bars
from statloom.plans import contracts, loanpool, presnap, strategy
from statloom.sources import files, schemas

T0 = dt.datetime(2024, 1, 1)


def hour(n):
    return T0 + dt.timedelta(hours=n)


# ---- bars with gaps ------------------------------------------------------------------------------


def bars_gap(spark):
    rng = random.Random(3)
    rows = []
    for s in "ABCD":
        for h in range(60):
            if h in (7, 8, 31) or (s == "D" and h < 5):  # missing hours, one late listing
                continue
            rows.append((hour(h), s, 100 + rng.random()))
    return spark.createDataFrame(rows, "ts timestamp_ntz, symbol string, close double")


def test_prices_fill_gaps_but_not_before_listing(spark):
    p = strategy.price_panel(bars_gap(spark)).collect()
    assert len(p) == 240
    early = [r for r in p if r["symbol"] == "D" and r["ts"] < hour(5)]
    assert len(early) == 5 and all(r["price"] is None for r in early)
    a = {r["ts"]: r["price"] for r in p if r["symbol"] == "A"}
    assert a[hour(7)] == a[hour(6)] == a[hour(8)]


def test_returns_start_when_every_symbol_is_listed(spark):
    r = strategy.hourly_returns(strategy.price_panel(bars_gap(spark))).collect()
    assert min(x["ts"] for x in r) == hour(6)
    assert len(r) == 54 * 4
    assert all(x["ret"] == 0 for x in r if x["ts"] in (hour(7), hour(8), hour(31)))


def test_empty_bars_return_zero(spark):
    df = spark.createDataFrame([(hour(0), "A", 0.1), (hour(5), "A", 0.2)], "ts timestamp_ntz, symbol string, ret double")
    got = {r["ts"]: r["ret"] for r in compound_bars(df, "ts", "symbol", "ret").collect()}
    assert got[hour(0)] == pytest.approx(0.1) and got[hour(5)] == pytest.approx(0.2)
    assert [got[hour(h)] for h in (1, 2, 3, 4)] == [0, 0, 0, 0]


# ---- cross-sections ------------------------------------------------------------------------------


def xs_ties(spark):
    rows = [(1, "a", 3.0), (1, "b", 3.0), (1, "c", 1.0), (1, "d", None), (2, "a", 5.0), (2, "b", 5.0), (3, "a", None), (3, "b", None)]
    return spark.createDataFrame(rows, "t int, s string, x double")


def test_ties_share_the_average_rank_and_missing_has_none(spark):
    got = {(r["t"], r["s"]): r["rank"] for r in cs.average_rank(xs_ties(spark), ["t"], "x").collect()}
    assert got == {(1, "a"): 2.5, (1, "b"): 2.5, (1, "c"): 1, (1, "d"): None, (2, "a"): 1.5, (2, "b"): 1.5, (3, "a"): None, (3, "b"): None}


def test_weights_are_neutral_and_flat_times_vanish(spark):
    out = cs.demean_and_scale(xs_ties(spark), ["t"], "x").collect()
    assert {r["t"] for r in out} == {1}
    assert sum(r["weight"] for r in out) == pytest.approx(0)
    assert sum(abs(r["weight"]) for r in out) == pytest.approx(1)


def test_lag_uses_the_previous_surviving_row_unless_a_step_is_given(spark):
    w = spark.createDataFrame([(hour(0), "a", 0.5), (hour(3), "a", 0.2)], "ts timestamp_ntz, s string, weight double")
    held = lambda **k: {r["ts"]: r["held"] for r in cs.lag_weights(w, "ts", "s", "weight", **k).collect()}
    assert held()[hour(3)] == 0.5
    assert held(step="1 hour")[hour(3)] is None


# ---- loans ---------------------------------------------------------------------------------------


def loans6(spark):
    rows = [
        (1, "Aa", "1,234,567", "823,000", "411,000", 0.0, 0.0, 0.0),
        (2, "Aa", "10,000", "6,667", "3,334", 1.0, 0.0, 0.0),
        (3, "Bb", "20,000", "13,333", "6,667", 0.0, 1.0, 0.0),
        (4, "Bb", "30,000", "20,000", "10,000", 0.0, 0.0, 1.0),
        (5, "Cc", "40,000", "26,667", "13,333", 0.3, 0.2, 0.1),
        (6, "Cc", "50,000", "33,333", "16,667", 0.5, 0.5, 0.5),
    ]
    return loanpool.prepare_pool(spark.createDataFrame(rows, schemas.LOAN_POOL))


def test_exposures_and_certain_defaults(spark):
    pool = loans6(spark)
    e = {r["loan_id"]: r for r in pool.collect()}
    assert e[1]["Loan_Amount_1Y"] == 1234567.0
    assert e[3]["exposure_2"] == pytest.approx(20000 - round(20000 * 0.3333 / 1.08, 2))
    fixed = pool.filter("loan_id <= 4")
    losses = loanpool.loss_distribution(fixed, 20, 1).collect()
    want = e[2]["exposure_1"] + e[3]["exposure_2"] + e[4]["exposure_3"]
    assert len(losses) == 20 and all(r["loss"] == pytest.approx(want) for r in losses)


def test_simulated_mean_meets_the_closed_form_for_any_partitioning(spark):
    pool = loans6(spark)
    sim = simulate_losses(pool, "loan_id", loanpool.PROBABILITIES, loanpool.EXPOSURES, 20000, 11, ["Rating"])
    means = {r["Rating"]: r["m"] for r in sim.groupBy("Rating").agg(F.avg("loss").alias("m")).collect()}
    for r in expected_loss(pool, loanpool.PROBABILITIES, loanpool.EXPOSURES, ["Rating"]).collect():
        assert means[r["Rating"]] == pytest.approx(r["expected_loss"], rel=0.02)
    again = simulate_losses(pool.repartition(5), "loan_id", loanpool.PROBABILITIES, loanpool.EXPOSURES, 50, 11)
    once = simulate_losses(pool.coalesce(1), "loan_id", loanpool.PROBABILITIES, loanpool.EXPOSURES, 50, 11)
    key = lambda df: sorted((r["trial"], round(r["loss"], 6)) for r in df.collect())
    assert key(again) == key(once)


def test_keyed_draws_look_uniform(spark):
    u = spark.range(20000).select(keyed_uniform(3, F.col("id"), 1).alias("u"), keyed_uniform(3, F.col("id"), 2).alias("v"))
    r = u.agg(F.avg("u"), F.var_pop("u"), F.corr("u", "v"), F.min("u"), F.max("u")).first()
    assert r[0] == pytest.approx(0.5, abs=0.01) and r[1] == pytest.approx(1 / 12, abs=0.003)
    assert abs(r[2]) < 0.02 and r[3] >= 0 and r[4] < 1


# ---- careers and contracts -----------------------------------------------------------------------


def test_career_table_with_missing_seasons_and_no_games(spark):
    rows = [
        (1, 20202021, 0, 0, 0, 0, 0, 0.0, 0.0), (1, 20222023, 40, 20, 8, 10, 4, 0.5, 900.0), (1, 20232024, 82, 60, 30, 40, 20, 0.73, 1100.0),
        (2, 20232024, 10, 1, 1, 1, 1, 0.1, 500.0),
    ]
    cols = "playerId long, seasonId int, gamesPlayed int, points int, goals int, evPoints int, evGoals int, pointsPerGame double, timeOnIcePerGame double"
    bios = spark.createDataFrame([(1, dt.date(2000, 7, 2)), (2, dt.date(2001, 1, 1))], "playerId long, birthDate date")
    got = {(r["playerId"], r["seasonId"]): r for r in contracts.career_table(spark.createDataFrame(rows, cols), bios).collect()}
    last = got[1, 20232024]
    assert (last["szn_no"], last["career_to_date_gp"], last["career_gp"]) == (3, 122, 122)
    assert last["career_to_date_toi_avg"] == pytest.approx(450.0)
    assert last["career_to_date_p_pg"] == pytest.approx(round(20 / 122, 2))
    assert last["points_avg_L3"] == pytest.approx(80 / 3) and got[1, 20222023]["points_avg_L3"] is None
    assert got[1, 20202021]["evPointsPerGame"] is None and got[1, 20202021]["career_to_date_p_pg"] == 0
    assert last["july_1_age"] == 22 and got[2, 20232024]["points_avg_L2"] is None


def contracts_nested(spark):
    a = (10, "2024-2025", "3", "9000000", "RFA", "UFA")
    b = (11, "2027-2028", "4", "8000000", "UFA", "UFA")
    c = (12, "2029-2030", "2", "4000000", "UFA", "UFA")
    rows = [(1, 101, "Center", "x", [a], [c]), (2, 102, "Left Wing", "y", [b, a], None), (3, 103, "Defense", "z", [], []), (4, 104, "Goaltender", "w", None, [c])]
    return spark.createDataFrame(rows, schemas.CONTRACTS)


def test_lists_flatten_side_by_side(spark):
    out = explode_lists(contracts_nested(spark), ["player_id"], "current", "future", "_future").collect()
    got = sorted((r["player_id"], r["list_position"], r["contract_id"] or 0, r["contract_id_future"] or 0) for r in out)
    assert got == [(1, 0, 10, 12), (2, 0, 11, 0), (2, 1, 10, 0), (3, 0, 0, 0), (4, 0, 0, 12)]


def test_signing_season_and_expiring_status(spark):
    out = {(r["player_id"], r["contract_id"]): r for r in contracts.contract_table(contracts_nested(spark)).collect()}
    assert out[1, 10]["contract_year"] == 20242025 and out[1, 10]["signing_status"] == "UFA"
    assert out[2, 11]["contract_year"] == 20232024 and out[2, 11]["signing_status"] == "UFA"
    assert (3, None) not in out and len(out) == 3


# ---- names ---------------------------------------------------------------------------------------


def test_names_fold(spark):
    df = spark.createDataFrame([("Aliaksei Protas",), ("Tim Stützle",), ("Pierre-Luc Dubois",), ("Jesper Bratt",), ("Łukasz Ødegård",), (None,)], "n string")
    got = [r[0] for r in df.select(dotted_name("n")).collect()]
    assert got[:4] == ["Aliaksei.Protas", "Tim.Stutzle", "Pierre.Luc.Dubois", "Jesper.Bratt"] and got[5] is None
    assert [r[0] for r in df.select(fold_unicode("n")).collect()][4] == "Lukasz Odegard"


def test_jaro_known_values():
    assert jaro("MARTHA", "MARHTA") == pytest.approx(0.944444, abs=1e-6)
    assert jaro("DIXON", "DICKSONX") == pytest.approx(0.766667, abs=1e-6)
    assert jaro("", "a") == 0 and jaro("same", "same") == 1
    assert 1 - jaro("Ryan.Strome", "Dylan.Strome") == pytest.approx(0.0859, abs=1e-3)


@pytest.mark.parametrize("limit", [0.1, 0.2, 0.3])
def test_name_keys_lose_no_pair(spark, limit):
    rng = random.Random(int(limit * 100))
    names = set()
    for _ in range(120):
        base = "".join(rng.choice("abcdeimnorst.-") for _ in range(rng.randint(1, 14)))
        names.add(base)
        for _ in range(2):
            s = list(base)
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([[], [rng.choice("aeiou")], [s[k], rng.choice("xyz")]])
            names.add("".join(s) or "a")
    names = sorted(names)
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {(r["name_l"], r["name_r"]) for r in similar_pairs(df, df, ("n", "n"), max_distance=limit).collect()}
    want = {(a, b) for a in names for b in names if 1 - jaro(a, b) <= limit + 1e-12}
    assert got == want


def test_brothers_collide_and_are_repaired(spark):
    left = spark.createDataFrame([("Ryan.Strome", "2018-19"), ("Dylan.Strome", "2018-19"), ("No.Body", "2018-19")], "name string, szn string")
    right = spark.createDataFrame([("Ryan.Strome", "2018-19", 25.0), ("Dylan.Strome", "2018-19", 21.0), ("Ryan.Strome", "2016-17", 23.0)], "bio string, season string, age double")
    out = fuzzy_left_join(left, right, ("name", "bio"), {"szn": "season"}, 0.1, ["age"])
    assert out.count() == 5 and out.filter("name = 'No.Body' and age is null").count() == 1
    fixed = keep_extreme(out, ["name", "szn"], "age", F.col("name") == "Dylan.Strome", F.col("name") == "Ryan.Strome")
    assert {(r["name"], r["age"]) for r in fixed.collect()} == {("Ryan.Strome", 25.0), ("Dylan.Strome", 21.0), ("No.Body", None)}


# ---- neighbours ----------------------------------------------------------------------------------


@pytest.mark.parametrize("block,cell", [(8192, 512), (16, 10)])
def test_neighbours_equal_brute_force(spark, block, cell):
    rng = np.random.default_rng(1)
    pool = [("big", i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(400, 2)).round(1))]
    pool += [("dup", 1000 + i, 1.0, 1.0) for i in range(150)] + [("few", 2000, 0.0, 0.0), ("few", 2001, 1.0, 0.0)]
    ask = [("big", i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(60, 2)).round(1))]
    ask += [("dup", 90, 1.0, 1.0), ("dup", 91, 5.0, 5.0), ("few", 92, 0.1, 0.0), ("none", 93, 0.0, 0.0)]
    cols = "seg string, {} long, x double, y double"
    got = nearest(
        spark.createDataFrame(ask, cols.format("sid")), spark.createDataFrame(pool, cols.format("cid")), ["seg"], ["x", "y"], 5, "sid", "cid",
        pivots=12, block_rows=block, min_cell_rows=cell,
    ).collect()
    want = {}
    for seg, sid, x, y in ask:
        near = sorted((math.hypot(x - a, y - b), c) for s, c, a, b in pool if s == seg)[:5]
        want[sid] = [(round(d, 9), i + 1) for i, (d, _) in enumerate(near)]
    have = {}
    for r in sorted(got, key=lambda r: (r["sid"], r["position"])):
        have.setdefault(r["sid"], []).append((round(r["distance"], 9), r["position"]))
    assert have == {k: v for k, v in want.items() if v}


def test_estimate_needs_every_match(spark):
    df = spark.createDataFrame([(1, p, 10.0) for p in range(1, 6)] + [(2, p, 10.0) for p in range(1, 4)], "s int, position int, pct double")
    got = {r["s"]: r["estimate"] for r in weighted_estimate(df, "s", "position", "pct", contracts.POSITION_WEIGHTS).collect()}
    assert got[1] == pytest.approx(10.0) and got[2] is None


# ---- plays ---------------------------------------------------------------------------------------


def test_in_game_features_update_and_carry(spark):
    rows = [
        ("A", 1, 1, "pass", "C", 8.0), ("A", 1, 2, "run", None, 4.0), ("A", 1, 3, "pass", "I", 0.0), ("A", 1, 4, "pass", "S", -5.0), ("A", 1, 5, "run", None, 8.0),
        ("A", 2, 1, "pass", None, 0.0), ("B", 1, 1, "run", None, 2.0),
    ]
    df = spark.createDataFrame(rows, "possessionTeam string, gameId int, playId int, play_type_design string, passResult string, yardsGained double")
    get = lambda d: {(r["possessionTeam"], r["gameId"], r["playId"]): (r["rush_avg_game"], r["completion_game"]) for r in d.collect()}
    got = get(presnap.game_to_date(df))
    assert got["A", 1, 1] == (None, 1.0) and got["A", 1, 3] == (4.0, 0.5) and got["A", 1, 5] == (6.0, 0.5)
    assert got["A", 2, 1] == (None, None)
    carried = get(presnap.game_to_date(df, at_completions_only=True, fill_across_games=True))
    assert carried["A", 1, 3] == (4.0, 1.0) and carried["A", 2, 1] == (6.0, 1.0)


# ---- regression, buckets, encoding ---------------------------------------------------------------


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3))
    y = 2 + x @ [1.0, -2.0, 0.5] + rng.normal(size=50) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    df = df.unionByName(spark.createDataFrame([(1.0, None, 1.0, 9.0)], df.schema))  # incomplete rows are left out
    fit = fit_ols(df, "y", ["a", "b", "c"])
    design = np.column_stack([np.ones(50), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    assert fit.coefficients == pytest.approx(beta) and fit.n == 50
    scored = fit.predict(df.dropna(), 0.95).withColumn("r", F.col("y") - F.col("fit"))
    sums = scored.agg(F.sum("r"), F.sum(F.col("r") * F.col("a"))).first()
    assert sums[0] == pytest.approx(0, abs=1e-8) and sums[1] == pytest.approx(0, abs=1e-8)
    sigma = math.sqrt(((y - design @ beta) ** 2).sum() / 46)
    row = scored.first()
    v = np.array([1, row["a"], row["b"], row["c"]])
    half = 2.012896 * sigma * math.sqrt(v @ np.linalg.inv(design.T @ design) @ v)
    assert row["upr"] - row["fit"] == pytest.approx(half, rel=1e-5)


def test_dependent_column_has_no_coefficient(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1, 3.0, float(i % 3)) for i in range(8)], "a double, b double, k double, y double")
    fit = fit_ols(df, "y", ["a", "b", "k"])
    assert fit.coefficients[1] is not None and fit.coefficients[2] is None and fit.coefficients[3] is None


def test_buckets_close_on_the_right(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (5.0,), (5.01,), (50.0,), (51.0,), (None,)], "x double")
    assert [r[0] for r in df.select(bucket_label("x", [-1, 5, 50])).collect()] == [None, "(-1,5]", "(-1,5]", "(5,50]", "(5,50]", None, None]


def test_small_scalars(spark):
    r = spark.range(1).select(
        clock_minutes(F.lit("12:30")), season_text(F.lit(20242025)), epoch_ms(F.lit(1577836800123)), clock_minutes(F.lit("bad"))
    ).first()
    assert r[0] == 12.5 and r[1] == "2024-25" and r[2] == dt.datetime(2020, 1, 1, 0, 0, 0, 123000) and r[3] is None


def test_split_sizes_are_exact(spark):
    df = spark.range(1003).select(F.col("id"), F.when(F.col("id") % 10 < 7, "x").otherwise("y").alias("lab"))
    got = stratified_split(df, "lab", "id").groupBy("lab").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert all(r["t"] == round(0.2 * r["n"]) for r in got)


def test_one_hot_drops_the_first_level(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert [tuple(r) for r in one_hot(df, {"c": None}).collect()] == [("a", 0), ("b", 1), (None, 0)]


# ---- sources -------------------------------------------------------------------------------------


def test_files_round_trip(spark, tmp_path):
    csv = str(tmp_path / "pool")
    raw = spark.createDataFrame([(1, "Aa", "1,000", "700", "300", 0.1, 0.2, float("nan"))], schemas.LOAN_POOL)
    files.write_csv(raw, csv)
    back = files.read_csv(spark, csv, schemas.LOAN_POOL).first()
    assert back["Loan_Amount_1Y"] == "1,000" and back["Default_Prob_3Y"] is None

    out = str(tmp_path / "seasons")
    files.write_parquet(spark.createDataFrame([(1, 20232024), (2, 20242025)], "playerId long, season int"), out, ["season"])
    assert spark.read.parquet(out).filter("season = 20242025").first()["playerId"] == 2

    folder = tmp_path / "skaters" / "season=20242025"
    folder.mkdir(parents=True)
    (folder / "part.json").write_text('{"playerId": 7, "seasonId": 20242025, "points": 3, "pointsPerGame": 0.5}\n')
    row = files.read_season_json(spark, str(tmp_path / "skaters"), schemas.SKATER_SEASONS).first()
    assert row["playerId"] == 7 and row["season"] == 20242025 and row["goals"] is None

    bars = tmp_path / "bars" / "symbol=AAA"
    bars.mkdir(parents=True)
    (bars / "b.json").write_text('[1577836800000,"1.0","2.0","0.5","1.5","10",1577840399999,"15",4,"5","7","0"]\n')
    bar = files.read_bars(spark, str(tmp_path / "bars")).first()
    assert bar["symbol"] == "AAA" and bar["ts"] == dt.datetime(2020, 1, 1) and bar["close"] == 1.5 and bar["num_trades"] == 4


# ---- projection input ------------------------------------------------------------------------------


def test_season_stats_find_ages_by_near_names(spark):
    on_ice = spark.createDataFrame(
        [("Tim.Stutzle", "2022-23", 70), ("Mathew.Barzal", "2022-23", 60), ("Nobody.Here", "2022-23", 20)], "player_name string, season_yr string, gp int"
    )
    bios = spark.createDataFrame(
        [("Tim Stützle", "2022-23", 20.0, "C"), ("Matthew Barzal", "2022-23", 25.0, "C"), ("Tim Stützle", "2021-22", 19.0, "C")], schemas.SKATER_AGES
    )
    from statloom.plans.projection import season_stats

    got = {r["player_name"]: (r["age"], r["position"]) for r in season_stats(on_ice, bios).collect()}
    assert got == {"Tim.Stutzle": (20.0, "C"), "Mathew.Barzal": (25.0, "C"), "Nobody.Here": (None, None)}


def test_results_do_not_depend_on_shuffle_partitions(spark):
    bars = bars_gap(spark)
    outs = []
    for n in ("1", "16"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            _, series = strategy.backtest(strategy.hourly_returns(strategy.price_panel(bars)), "A", 12, 3, 6, 0.5)
            outs.append(sorted((r["ts"], round(r["net"], 10)) for r in series.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert outs[0] == outs[1] and len(outs[0]) > 20


def test_levels_are_bounded_and_long_form_is_not(spark):
    from statloom.operators.encode import indicator_rows, levels_of

    df = spark.createDataFrame([(1, "b", "x"), (2, "a", None), (3, None, "y"), (4, "c", "x")], "id long, u string, v string")
    assert levels_of(df, "u", 3) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        levels_of(df, "u", 2)
    from tests.conftest import rows

    assert rows(indicator_rows(df, ["id"], ["u", "v"])) == [(1, "u", "b"), (3, "v", "y"), (4, "u", "c")]
    wide = one_hot(df, {"u": None, "v": None})
    ones = sum(v for r in wide.drop("id", "u", "v").collect() for v in r)
    assert ones == 3


def test_display_units_round_half_to_even(spark):
    from statloom.plans.contracts import display_units

    df = spark.createDataFrame([(0.12345, 1234.5, 0.125), (None, None, None)], "pct_gp double, timeOnIcePerGame double, pointsPerGame double")
    assert [tuple(r) for r in display_units(df).collect()] == [(12.34, 20.58, 0.12), (None, None, None)]
