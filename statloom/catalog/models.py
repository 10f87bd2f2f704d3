"""Regression, encoding, simulation, neighbour, name-matching and classifier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.catalog.registry import query
from statloom.functions.scalar import start_lanes, with_uniform
from statloom.operators import encode as en
from statloom.operators import histtrees, learn
from statloom.operators.ann import approximate_nearest, recall
from statloom.operators.dependence import grid_points, partial_dependences
from statloom.operators.fuzzy import fuzzy_left_join, similar_pairs
from statloom.operators.knn import nearest, price_path, weighted_estimate
from statloom.operators.joins import lookup
from statloom.operators.regress import fit_ols, fit_ols_by_factors, residual_buckets, residual_shape
from statloom.plans import gamepoints, loanpool
from statloom.session import cut_lineage
from statloom.sources.files import load_table

# ---- least squares -----------------------------------------------------------------------------

_MOMENTS = """m AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab,
             covar_pop(a, y) AS say, covar_pop(b, y) AS sby, var_pop(y) AS syy FROM x),
    s AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ca, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS cb FROM m),
    f AS (SELECT *, my - ca * ma - cb * mb AS c0, greatest(syy - ca * say - cb * sby, 0) AS rv FROM s)"""
LINE_X = "x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 1000 AS y, l_quantity AS a, l_discount AS b FROM lineitem)"


def line_rows(spark, d):
    li = load_table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"])
    return li.withColumns({"y": F.col("l_extendedprice") / 1000, "a": F.col("l_quantity"), "b": F.col("l_discount")}).drop(
        "l_extendedprice", "l_quantity", "l_discount"
    )


@query(
    "regression_coefficients",
    f"""WITH {LINE_X}, {_MOMENTS}, g AS (SELECT *, sqrt(rv * n / (n - 3)) AS sigma, saa * sbb - sab * sab AS det FROM f)
        SELECT '(intercept)' AS term, c0 AS estimate, sigma * sqrt((1 + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det) / n) AS std_error FROM g
        UNION ALL SELECT 'a', ca, sigma * sqrt(sbb / det / n) FROM g UNION ALL SELECT 'b', cb, sigma * sqrt(saa / det / n) FROM g""",
    "estimate std_error",
)
def regression_coefficients(spark, d):
    fit = fit_ols(line_rows(spark, d), "y", ["a", "b"])
    return fit.coefficient_table(spark).select("term", "estimate", "std_error")


@query(
    "regression_summary",
    f"""WITH {LINE_X}, {_MOMENTS} SELECT n, sqrt(rv * n / (n - 3)) AS residual_std, 1 - rv / syy AS r2,
        1 - (rv / (n - 3)) / (syy / (n - 1)) AS adjusted_r2 FROM f""",
    "residual_std r2 adjusted_r2",
)
def regression_summary(spark, d):
    return fit_ols(line_rows(spark, d), "y", ["a", "b"]).summary_table(spark)


@query(
    "factored_regression",
    f"""WITH {LINE_X}, {_MOMENTS}, g AS (SELECT *, sqrt(rv * n / (n - 3)) AS sigma, saa * sbb - sab * sab AS det FROM f)
        SELECT '(intercept)' AS term, c0 AS estimate, c0 / (sigma * sqrt((1 + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det) / n)) AS t_value FROM g
        UNION ALL SELECT 'a', ca, ca / (sigma * sqrt(sbb / det / n)) FROM g UNION ALL SELECT 'b', cb, cb / (sigma * sqrt(saa / det / n)) FROM g""",
    "estimate t_value",
    4,
)
def factored_regression(spark, d):
    return fit_ols_by_factors(line_rows(spark, d), "y", ["a", "b"]).coefficient_table(spark).select("term", "estimate", "t_value")


@query("regression_with_p_values")
def regression_with_p_values(spark, d):
    """t and p need the Student distribution, which SQL lacks."""
    return fit_ols_by_factors(line_rows(spark, d), "y", ["a", "b"]).coefficient_table(spark)


@query("regression_intervals")
def regression_intervals(spark, d):
    rows = line_rows(spark, d)
    return fit_ols_by_factors(rows, "y", ["a", "b"]).predict(rows, 0.95)


BREAKS, TARGETS = [-1, 5, 10, 15, 20, 25, 30, 50], [-1, 20, 40, 60, 70, 110]


@query(
    "residual_bucket_shares",
    f"""WITH {LINE_X}, {_MOMENTS}, r AS (SELECT y, abs(round_even(y - (SELECT c0 FROM f) - (SELECT ca FROM f) * a - (SELECT cb FROM f) * b, 0)) AS e FROM x),
        k AS (SELECT CASE WHEN e > -1 AND e <= 5 THEN '(-1,5]' WHEN e > 5 AND e <= 10 THEN '(5,10]' WHEN e > 10 AND e <= 15 THEN '(10,15]' WHEN e > 15 AND e <= 20 THEN '(15,20]'
              WHEN e > 20 AND e <= 25 THEN '(20,25]' WHEN e > 25 AND e <= 30 THEN '(25,30]' WHEN e > 30 AND e <= 50 THEN '(30,50]' END AS error_bucket,
              CASE WHEN y > -1 AND y <= 20 THEN '(-1,20]' WHEN y > 20 AND y <= 40 THEN '(20,40]' WHEN y > 40 AND y <= 60 THEN '(40,60]' WHEN y > 60 AND y <= 70 THEN '(60,70]'
              WHEN y > 70 AND y <= 110 THEN '(70,110]' END AS target_bucket FROM r)
        SELECT error_bucket, target_bucket, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM k) AS share FROM k GROUP BY 1, 2""",
    "share",
)
def residual_bucket_shares(spark, d):
    from statloom.operators.aggregate import share_of_total

    rows = line_rows(spark, d)
    scored = residual_buckets(fit_ols(rows, "y", ["a", "b"]).predict(rows), "y", 1, BREAKS, TARGETS)
    return share_of_total(scored, ["error_bucket", "target_bucket"])


@query(
    "residual_quantiles",
    f"""WITH {LINE_X}, {_MOMENTS}, r AS (SELECT y - (SELECT c0 FROM f) - (SELECT ca FROM f) * a - (SELECT cb FROM f) * b AS e FROM x)
        SELECT 'q5.0' AS measure, quantile_cont(e, 0.05) AS value FROM r UNION ALL SELECT 'q50.0', quantile_cont(e, 0.5) FROM r
        UNION ALL SELECT 'q95.0', quantile_cont(e, 0.95) FROM r
        UNION ALL SELECT 'skewness', (SELECT avg(power(e - m, 3)) / power(var_pop(e), 1.5) FROM r, (SELECT avg(e) AS m FROM r)) UNION ALL SELECT 'kurtosis', (SELECT avg(power(e - m, 4)) / power(var_pop(e), 2) - 3 FROM r, (SELECT avg(e) AS m FROM r))""",
    "value",
)
def residual_quantiles(spark, d):
    rows = line_rows(spark, d)
    scored = fit_ols(rows, "y", ["a", "b"]).predict(rows).withColumn("residual", F.col("y") - F.col("fit"))
    return residual_shape(scored.select("residual"), "residual", [0.05, 0.5, 0.95])


# ---- encoding and splits -------------------------------------------------------------------------


def mix_sql(source: str, start: str, seed: int | None, key: str, tag: str = "m", after: str | None = None) -> str:
    """SQL of the keyed draw's two lanes, ``{tag}a`` and ``{tag}b``, one scrambling step per sub-select.

    With a seed all bits of a key that is not negative are absorbed; with ``after``, the lanes of that
    name absorb one number below 2**31.
    """
    k = f"CAST({key} AS BIGINT)"
    if after is None:
        (a, b), limbs = start_lanes(seed), [f"({k} & 2147483647)", f"(({k} >> 31) & 2147483647)", f"({k} >> 62)"]
    else:
        a, b, limbs = f"{after}a", f"{after}b", [k]
    sql = f"SELECT {start} FROM {source}"
    for i, limb in enumerate(limbs):
        x, y = f"{tag}a{i}_", f"{tag}b{i}_"
        sql = f"SELECT *, ({a} + {limb}) & 2147483647 AS {x}0, xor(CAST({b} AS BIGINT), {limb}) & 2147483647 AS {y}0 FROM ({sql})"
        for step, (shift, factor) in enumerate(((16, 1540483477), (15, 1103515245))):
            made = [f"(xor({h}{step}, {h}{step} >> {shift}) * {factor}) & 2147483647 AS {h}{step + 1}" for h in (x, y)]
            sql = f"SELECT *, {', '.join(made)} FROM ({sql})"
        a, b = (f"{tag}a", f"{tag}b") if i == len(limbs) - 1 else (x, y)
        sql = f"SELECT *, xor({x}2, {x}2 >> 16) AS {a}, xor({y}2, {y}2 >> 16) AS {b} FROM ({sql})"
    return sql


def uniform_sql(tag: str) -> str:
    return f"(({tag}a * 4194304 + ({tag}b >> 9)) / 9007199254740992.0::DOUBLE)"


@query(
    "label_codes",
    """SELECT o_orderkey, CAST(c AS INTEGER) AS code, o_orderpriority AS back FROM orders JOIN
       (SELECT p, row_number() OVER (ORDER BY p) - 1 AS c FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)) ON p = o_orderpriority""",
)
def label_codes(spark, d):
    orders = load_table(spark, d, "orders", ["o_orderkey", "o_orderpriority"])
    codes = en.code_table(orders, "o_orderpriority")
    coded = en.with_code(orders, "o_orderpriority", codes).select("o_orderkey", "code")
    return en.with_value(coded, "code", codes, "back")


@query(
    "indicator_columns",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS o_orderstatus_O,
              CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS o_orderstatus_P FROM orders""",
)
def indicator_columns(spark, d):
    orders = load_table(spark, d, "orders", ["o_orderkey", "o_orderstatus"])
    return en.one_hot(orders, {"o_orderstatus": None}).drop("o_orderstatus")


@query(
    "indicator_rows",
    """SELECT o_orderkey, 'o_orderpriority' AS "column", o_orderpriority AS level FROM orders WHERE o_orderpriority <> (SELECT min(o_orderpriority) FROM orders)
       UNION ALL SELECT o_orderkey, 'o_clerk_day', CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM orders WHERE o_orderdate > (SELECT min(o_orderdate) FROM orders)""",
)
def indicator_rows(spark, d):
    """Priorities and days of orders: far more levels than columns could hold."""
    orders = load_table(spark, d, "orders", ["o_orderkey", "o_orderpriority", "o_orderdate"])
    return en.indicator_rows(orders.withColumn("o_clerk_day", F.to_date("o_orderdate")), ["o_orderkey"], ["o_orderpriority", "o_clerk_day"])


@query(
    "stratified_split",
    f"""WITH h AS ({mix_sql('orders', 'o_orderkey, o_orderstatus', 13, 'o_orderkey')}),
        r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY ma, mb, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM h)
        SELECT o_orderkey, o_orderstatus, rn <= round_even(n * 0.2::DOUBLE, 0) AS is_test FROM r""",
)
def stratified_split(spark, d):
    return en.stratified_split(load_table(spark, d, "orders", ["o_orderkey", "o_orderstatus"]), "o_orderstatus", "o_orderkey")


@query(
    "confusion_counts",
    """SELECT label, prediction, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
       CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS prediction FROM lineitem) GROUP BY 1, 2""",
)
def confusion_counts(spark, d):
    return learn.confusion(_guess(spark, d))


@query(
    "binary_scores",
    """WITH g AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS p FROM lineitem)
       SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS accuracy, sum(y * p) / sum(p) AS precision, sum(y * p) / sum(y) AS recall,
              2 * sum(y * p) / (sum(y) + sum(p)) AS f1 FROM g""",
    "accuracy precision recall f1",
)
def binary_scores(spark, d):
    return learn.binary_scores(_guess(spark, d))


@query(
    "micro_scores",
    """SELECT avg(h) AS accuracy, avg(h) AS precision, avg(h) AS recall FROM (SELECT CASE WHEN o_orderstatus = substr(o_orderpriority, 3, 1) THEN 1.0::DOUBLE ELSE 0.0 END AS h FROM orders)""",
    "accuracy precision recall",
)
def micro_scores(spark, d):
    orders = load_table(spark, d, "orders", ["o_orderstatus", "o_orderpriority"])
    return learn.micro_scores(orders.withColumn("guess", F.substring("o_orderpriority", 3, 1)), "o_orderstatus", "guess")


def _guess(spark, d):
    li = load_table(spark, d, "lineitem", ["l_returnflag", "l_quantity"])
    return li.select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("prediction"),
    )


# ---- loan pool -----------------------------------------------------------------------------------

TRIALS, SEED = 10_000, 7
POOL_SQL = f"""pool AS (SELECT c_custkey AS loan_id, c_mktsegment AS Rating, abs(c_acctbal) AS a1, abs(c_acctbal) * 0.6667 AS a2, abs(c_acctbal) * 0.3334 AS a3,
      {uniform_sql('c')} * 0.05 AS p1, {uniform_sql('c')} * 0.08 AS p2, {uniform_sql('c')} * 0.1 AS p3
      FROM ({mix_sql('customer', 'c_custkey, c_mktsegment, c_acctbal', 99, 'c_custkey', tag='c')})),
    valued AS (SELECT *, a1 AS e1, a1 - a1 * 0.3333 / 1.08 AS e2, a1 - a1 * 0.3333 / 1.08 - a1 * 0.3333 / (1.08 * 1.08) AS e3 FROM pool)"""


def _draws_sql(trials: int) -> str:
    years = {1: "u", 2: "v", 3: "w"}
    drawn, source = [], "k"
    for year, tag in years.items():
        drawn.append(f"y{year} AS ({mix_sql(source, '*', None, str(year), tag=tag, after='m')})")
        source = f"y{year}"
    return f"""keyed AS ({mix_sql('valued', '*', SEED, 'loan_id', tag='l')}),
    trials AS (SELECT * FROM keyed CROSS JOIN (SELECT unnest(generate_series(1, {trials})) AS trial)),
    k AS ({mix_sql('trials', '*', None, 'trial', after='l')}), {', '.join(drawn)},
    outcome AS (SELECT *, CASE WHEN {uniform_sql('u')} <= p1 THEN 1 WHEN {uniform_sql('v')} <= p2 THEN 2 WHEN {uniform_sql('w')} <= p3 THEN 3 END AS yr FROM y3)"""


LOSSES_SQL = f"WITH {POOL_SQL}, {_draws_sql(TRIALS)}, losses AS (SELECT trial, Rating, sum(CASE yr WHEN 1 THEN e1 WHEN 2 THEN e2 WHEN 3 THEN e3 ELSE 0.0 END) AS loss FROM outcome GROUP BY 1, 2)"


def pool(spark, d):
    """Customers as loans: balance as amount, segment as rating, keyed default probabilities."""
    cust = load_table(spark, d, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"])
    cust, base = with_uniform(cust, "_base", 99, "c_custkey"), F.col("_base")
    amount = F.abs("c_acctbal")
    loans = cust.select(
        F.col("c_custkey").alias("loan_id"),
        F.col("c_mktsegment").alias("Rating"),
        *[(amount * s).alias(f"Loan_Amount_{y}Y") for y, s in ((1, 1.0), (2, 0.6667), (3, 0.3334))],
        *[(base * s).alias(f"Default_Prob_{y}Y") for y, s in ((1, 0.05), (2, 0.08), (3, 0.1))],
    )
    return loanpool.prepare_pool(loans, digits=None)


@query("loss_by_trial", f"{LOSSES_SQL} SELECT CAST(trial AS INTEGER) AS trial, sum(loss) AS loss FROM losses GROUP BY 1", "loss", 4)
def loss_by_trial(spark, d):
    return loanpool.loss_distribution(pool(spark, d), TRIALS, SEED)


@query("loss_by_trial_and_rating", f"{LOSSES_SQL} SELECT CAST(trial AS INTEGER) AS trial, Rating, loss FROM losses", "loss", 4)
def loss_by_trial_and_rating(spark, d):
    return loanpool.loss_distribution(pool(spark, d), TRIALS, SEED, by_rating=True)


@query(
    "loss_tail_by_rating",
    f"{LOSSES_SQL} SELECT Rating, avg(loss) AS mean, median(loss) AS median, quantile_cont(loss, 0.95) AS tail FROM losses GROUP BY 1",
    "mean median tail",
    4,
)
def loss_tail_by_rating(spark, d):
    return loanpool.loss_report(loanpool.loss_distribution(pool(spark, d), TRIALS, SEED, True), True)


@query(
    "loss_tail",
    f"{LOSSES_SQL} SELECT avg(loss) AS mean, median(loss) AS median, quantile_cont(loss, 0.95) AS tail FROM (SELECT trial, sum(loss) AS loss FROM losses GROUP BY 1)",
    "mean median tail",
    4,
)
def loss_tail(spark, d):
    return loanpool.loss_report(loanpool.loss_distribution(pool(spark, d), TRIALS, SEED))


@query(
    "loss_histogram",
    f"""{LOSSES_SQL}, t AS (SELECT trial, sum(loss) AS loss FROM losses GROUP BY 1), e AS (SELECT min(loss) AS lo, (max(loss) - min(loss)) / 50 AS w, count(*) AS total FROM t)
        SELECT bin, lo + bin * w AS low, lo + (bin + 1) * w AS high, count(*) AS n, count(*) / (total * w) AS density
        FROM (SELECT CAST(least(floor((loss - lo) / w), 49) AS INTEGER) AS bin, lo, w, total FROM t, e) GROUP BY bin, lo, w, total""",
    "low high density",
    4,
)
def loss_histogram(spark, d):
    return loanpool.loss_histogram(loanpool.loss_distribution(pool(spark, d), TRIALS, SEED))


@query(
    "single_draw",
    f"""WITH {POOL_SQL}, {_draws_sql(1)} SELECT loan_id, Rating, CASE WHEN yr <= 1 THEN 1 ELSE 0 END AS Defaults_1Y, CASE WHEN yr <= 2 THEN 1 ELSE 0 END AS Defaults_2Y,
        CASE WHEN yr <= 3 THEN 1 ELSE 0 END AS Defaults_3Y, CASE yr WHEN 1 THEN a1 WHEN 2 THEN a2 WHEN 3 THEN a3 ELSE 0.0 END AS loss FROM outcome""",
    "loss",
)
def single_draw(spark, d):
    return loanpool.single_draw(pool(spark, d), SEED).select(
        "loan_id", "Rating", "Defaults_1Y", "Defaults_2Y", "Defaults_3Y", "loss"
    )


@query(
    "default_patterns",
    f"""WITH {POOL_SQL}, {_draws_sql(1)} SELECT CASE WHEN yr <= 1 THEN 1 ELSE 0 END AS Defaults_1Y, CASE WHEN yr <= 2 THEN 1 ELSE 0 END AS Defaults_2Y,
        CASE WHEN yr <= 3 THEN 1 ELSE 0 END AS Defaults_3Y, count(*) AS n FROM outcome GROUP BY ALL""",
)
def default_patterns(spark, d):
    return loanpool.default_patterns(loanpool.single_draw(pool(spark, d), SEED))


# ---- neighbours ----------------------------------------------------------------------------------

NEAR_SQL = """f AS (SELECT p_partkey, p_brand, p_size, p_retailprice, (p_size - avg(p_size) OVER w) / stddev_pop(p_size) OVER w AS a,
             (p_retailprice - avg(p_retailprice) OVER w) / stddev_pop(p_retailprice) OVER w AS b FROM part WINDOW w AS (PARTITION BY p_brand)),
    q AS (SELECT * FROM f WHERE p_size > 40), c AS (SELECT * FROM f WHERE p_size <= 40),
    n AS (SELECT q.p_brand, q.p_partkey AS subject, c.p_partkey AS p_partkey, sqrt(power(q.a - c.a, 2) + power(q.b - c.b, 2)) AS distance FROM q JOIN c ON q.p_brand = c.p_brand),
    near AS (SELECT p_brand, subject, p_partkey, distance, CAST(row_number() OVER (PARTITION BY subject ORDER BY distance, p_partkey) AS INTEGER) AS position FROM n QUALIFY position <= 5)"""


def near_parts(spark, d):
    from statloom.operators.aggregate import standardise

    part = load_table(spark, d, "part", ["p_partkey", "p_brand", "p_size", "p_retailprice"])
    scaled = standardise(part, ["p_brand"], ["p_size", "p_retailprice"])
    subjects = scaled.filter(F.col("p_size") > 40).withColumnRenamed("p_partkey", "subject")
    pool = scaled.filter(F.col("p_size") <= 40)
    return nearest(subjects, pool, ["p_brand"], ["p_size_z", "p_retailprice_z"], 5, "subject", "p_partkey")


@query("nearest_parts", f"WITH {NEAR_SQL} SELECT * FROM near", "distance")
def nearest_parts(spark, d):
    return near_parts(spark, d)


@query(
    "weighted_price_estimate",
    f"""WITH {NEAR_SQL}, e AS (SELECT subject, CASE WHEN count(*) = 5 THEN sum(p_retailprice * [0.3, 0.25, 0.2, 0.15, 0.1][position]) END AS share FROM near JOIN part USING (p_partkey) GROUP BY 1)
        SELECT subject, share, share * 95.5 / 100 AS amount, share AS share_season_1, share * 95.5 / 100 / 104 * 100 AS share_season_2, share * 95.5 / 100 / 113.5 * 100 AS share_season_3 FROM e""",
    "share amount share_season_1 share_season_2 share_season_3",
)
def weighted_price_estimate(spark, d):
    priced = lookup(near_parts(spark, d), load_table(spark, d, "part"), ["p_partkey"], ["p_retailprice"])
    guess = weighted_estimate(priced, "subject", "position", "p_retailprice", (0.3, 0.25, 0.2, 0.15, 0.1), "share")
    return price_path(guess, "share", 95.5, (104, 113.5), digits=None)


def order_points(spark, d):
    """Orders by price, day and lines, scaled within their priority: open ones are compared with closed ones."""
    from statloom.operators.aggregate import standardise

    lines = load_table(spark, d, "lineitem", ["l_orderkey"]).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    orders = load_table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"])
    rows = lookup(orders.withColumn("day", F.unix_date(F.to_date("o_orderdate"))), lines, ["o_orderkey"], ["lines"]).fillna(0, ["lines"])
    features = ["o_totalprice", "day", "lines"]
    scaled = cut_lineage(standardise(rows, ["o_orderpriority"], features).select("o_orderkey", "o_orderstatus", "o_orderpriority", *[f"{f}_z" for f in features]))
    subjects = scaled.filter(F.col("o_orderstatus") == "P").withColumnRenamed("o_orderkey", "subject")
    return subjects, scaled.filter(F.col("o_orderstatus") != "P"), [f"{f}_z" for f in features]


@query("approximate_orders")
def approximate_orders(spark, d):
    subjects, pool, features = order_points(spark, d)
    return approximate_nearest(subjects, pool, ["o_orderpriority"], features, 5, "subject", "o_orderkey")


@query(
    "approximate_orders_recall",
    """WITH s AS (SELECT o_orderpriority, count(*) AS a FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
            c AS (SELECT o_orderpriority, count(*) AS b FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
       SELECT o_orderpriority, CAST(a * least(b, 5) AS BIGINT) AS n, true AS enough FROM s JOIN c USING (o_orderpriority)""",
)
def approximate_orders_recall(spark, d):
    """At least 0.9 of the exact neighbours of all open orders are found, in every segment."""
    subjects, pool, features = order_points(spark, d)
    found = approximate_nearest(subjects, pool, ["o_orderpriority"], features, 5, "subject", "o_orderkey")
    exact = nearest(subjects, pool, ["o_orderpriority"], features, 5, "subject", "o_orderkey")
    measured = recall(found, exact, ["o_orderpriority"], "subject")
    return measured.select("o_orderpriority", "n", (F.col("recall") >= 0.9).alias("enough"))


# ---- names ---------------------------------------------------------------------------------------


@query(
    "similar_names",
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT l.name AS name_l, r.name AS name_r, 1 - jaro_similarity(l.name, r.name) AS distance
       FROM n l CROSS JOIN n r WHERE 1 - jaro_similarity(l.name, r.name) <= 0.2 + 1e-12""",
    "distance",
)
def similar_names(spark, d):
    part = load_table(spark, d, "part", ["p_name"])
    return similar_pairs(part, part, ("p_name", "p_name"), max_distance=0.2)


@query(
    "fuzzy_name_join",
    """WITH l AS (SELECT p_partkey, p_name, p_size FROM part),
            r AS (SELECT p_name AS name, p_size AS size, count(*) AS n FROM part GROUP BY 1, 2)
       SELECT p_partkey, p_name, p_size, name AS matched_name, 1 - jaro_similarity(p_name, name) AS distance, n FROM l LEFT JOIN r
       ON p_size = size AND 1 - jaro_similarity(p_name, name) <= 0.1 + 1e-12""",
    "distance",
)
def fuzzy_name_join(spark, d):
    part = load_table(spark, d, "part", ["p_partkey", "p_name", "p_size"])
    right = part.groupBy(F.col("p_name").alias("name"), F.col("p_size").alias("size")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return fuzzy_left_join(part, right, ("p_name", "name"), {"p_size": "size"}, 0.1, ["n"])


# ---- classifiers ---------------------------------------------------------------------------------

DOC_FEATURES = ["n_chars", "words", "mean_word", "lines", "digits"]


def doc_rows(spark, d):
    """Labelled documents with simple length features as player-game rows."""
    docs = load_table(spark, d, "documents", ["doc_id", "text", "n_chars"])
    words = F.size(F.split("text", r"\s+"))
    feats = docs.select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        words.cast("double").alias("words"),
        (F.col("n_chars") / words).alias("mean_word"),
        F.size(F.split("text", "\n")).cast("double").alias("lines"),
        F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double").alias("digits"),
    )
    return lookup(load_table(spark, d, "labels"), feats, ["doc_id"], DOC_FEATURES, "inner")


def doc_split(spark, d):
    # written once: the split reads its rows several times, and the texts need not be
    train, test = gamepoints.training_rows(cut_lineage(doc_rows(spark, d)), "quality", "doc_id", DOC_FEATURES, folds=3)
    return cut_lineage(train), cut_lineage(test)


@query("boosted_tree_scores")
def boosted_tree_scores(spark, d):
    train, test = doc_split(spark, d)
    return gamepoints.fit_and_score(train, test, learn.boosted_trees(rounds=10, depth=3, rate=0.1, row_share=0.8))[1]


@query("forest_importances")
def forest_importances(spark, d):
    train, _ = doc_split(spark, d)
    return learn.importances(learn.forest(20, 5, leaf_rows=2).fit(train), DOC_FEATURES, train, least=0.025)


@query("grid_search_scores")
def grid_search_scores(spark, d):
    train, _ = doc_split(spark, d)
    model = learn.grid_search(train, learn.forest(10), {"maxDepth": [2, 4], "minInstancesPerNode": [1, 2]}, "fold", 3)
    return learn.search_table(model, train)


@query("partial_dependence")
def partial_dependence(spark, d):
    """All features at 100 points between their 5th and 95th percentiles, for a forest of 100 trees."""
    train, _ = doc_split(spark, d)
    model = learn.forest(100, 10).fit(train)
    return partial_dependences(model, train, DOC_FEATURES, grid_points(train, DOC_FEATURES))


@query("many_class_scores")
def many_class_scores(spark, d):
    orders = load_table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    coded = en.with_code(orders, "o_orderstatus", en.code_table(orders, "o_orderstatus"))
    rows = coded.withColumns(
        {
            "price": F.col("o_totalprice"),
            "month": F.month("o_orderdate").cast("double"),
            "year": F.year("o_orderdate").cast("double"),
        }
    )
    train, test = gamepoints.training_rows(rows, "code", "o_orderkey", ["price", "month", "year"])
    # the reference's rounds, depth and rate
    model = learn.many_class_boosted_trees(rounds=75, depth=5, rate=0.075).fit(cut_lineage(train))
    return learn.micro_scores(model.transform(test))


# ---- boosted trees on shared bins ------------------------------------------------------------------

# the reference's grid of rounds, rates, depths and folds
GRID = {"rounds": [50, 100, 200], "rate": [0.01, 0.1, 0.2], "depth": [3, 5, 7]}


def order_rows(spark, d):
    orders = load_table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    coded = en.with_code(orders, "o_orderstatus", en.code_table(orders, "o_orderstatus"))
    return coded.withColumns(
        {"price": F.col("o_totalprice"), "month": F.month("o_orderdate").cast("double"), "year": F.year("o_orderdate").cast("double")}
    )


@query("softmax_boosted_scores")
def softmax_boosted_scores(spark, d):
    """Three classes on the soft-max objective: 75 rounds of depth 5 at a rate of 0.075."""
    features = ["price", "month", "year"]
    train, test = gamepoints.training_rows(order_rows(spark, d), "code", "o_orderkey", features)
    train, test = cut_lineage(train.drop("features")), cut_lineage(test.drop("features"))
    bins = histtrees.find_bins(train, features)
    table = histtrees.bin_rows(train, bins, "label", "o_orderkey")
    model = histtrees.fit(table, bins, [histtrees.Setting(rounds=75, depth=5, rate=0.075)], classes=3)
    return learn.micro_scores(histtrees.predicted(model, test))


@query("boosted_tree_full_scores")
def boosted_tree_full_scores(spark, d):
    """100 rounds of depth 6 at a rate of 0.3."""
    train, test = doc_split(spark, d)
    bins = histtrees.find_bins(train, DOC_FEATURES)
    table = histtrees.bin_rows(train, bins, "label", "doc_id")
    model = histtrees.fit(table, bins, [histtrees.Setting(rounds=100, depth=6, rate=0.3)])
    return learn.binary_scores(histtrees.predicted(model, test))


@query("boosted_grid_scores")
def boosted_grid_scores(spark, d):
    """27 combinations on 5 folds, all trees grown together."""
    rows = gamepoints.training_rows(cut_lineage(doc_rows(spark, d)), "quality", "doc_id", DOC_FEATURES, folds=5)[0]
    train = cut_lineage(rows.drop("features"))
    return histtrees.search(train, DOC_FEATURES, "label", "doc_id", "fold", 5, GRID)
