"""Projection, filter, join, aggregate and scalar-function queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from statloom.catalog.registry import query
from statloom.functions import scalar as sc
from statloom.functions.text import dotted_name, fold_unicode
from statloom.operators import aggregate as ag
from statloom.operators import joins as jn
from statloom.operators import project as pr
from statloom.operators.gram import wide_correlations
from statloom.operators.hotgroups import with_group_stats
from statloom.operators.selection import quantiles
from statloom.plans import contracts
from statloom.sources.files import load_table

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_KEY_SQL = ", ".join(LINE_KEY)


# ---- filters ---------------------------------------------------------------------------------


@query(
    "band_filter",
    f"""SELECT {LINE_KEY_SQL}, l_quantity FROM lineitem
        WHERE l_quantity BETWEEN 10 AND 30 AND l_discount BETWEEN 0.02 AND 0.06 AND l_tax BETWEEN 0.01 AND 0.05""",
)
def band_filter(spark, d):
    rows = load_table(spark, d, "lineitem", [*LINE_KEY, "l_quantity", "l_discount", "l_tax"])
    bands = {"l_quantity": (10, 30), "l_discount": (0.02, 0.06), "l_tax": (0.01, 0.05)}
    return pr.within_bands(rows, bands).select(*LINE_KEY, "l_quantity")


@query(
    "complete_rows",
    f"""SELECT * FROM (SELECT {LINE_KEY_SQL}, nullif(l_returnflag, 'N') AS flag,
        CASE WHEN l_discount > 0.02 THEN l_discount END AS discount FROM lineitem)
        WHERE flag IS NOT NULL AND discount IS NOT NULL""",
)
def complete_rows(spark, d):
    rows = load_table(spark, d, "lineitem", [*LINE_KEY, "l_returnflag", "l_discount"])
    rows = rows.select(
        *LINE_KEY,
        F.nullif("l_returnflag", F.lit("N")).alias("flag"),
        F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("discount"),
    )
    return pr.drop_missing(rows, ["flag", "discount"])


@query(
    "entities_without_gaps",
    """WITH v AS (SELECT event_id, user_id, CASE WHEN value > 1 THEN value END AS value FROM events)
       SELECT * FROM v WHERE user_id NOT IN (SELECT user_id FROM v WHERE value IS NULL)""",
)
def entities_without_gaps(spark, d):
    ev = load_table(spark, d, "events", ["event_id", "user_id", "value"])
    ev = ev.withColumn("value", F.when(F.col("value") > 1, F.col("value")))
    return pr.drop_incomplete_entities(ev, "user_id", "value")


@query(
    "complete_days",
    """WITH
            h AS (SELECT CAST(ts AS DATE) AS day, event_type, max(value) AS value FROM events GROUP BY 1, 2)
       SELECT * FROM h WHERE day IN (SELECT day FROM h GROUP BY day HAVING count(*) = (SELECT count(DISTINCT event_type) FROM h))""",
)
def complete_days(spark, d):
    ev = load_table(spark, d, "events", ["ts", "event_type", "value"])
    daily = ev.groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.max("value").alias("value"))
    return pr.complete_cross_sections(daily, "day", "event_type", "value")


@query(
    "date_slice",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-07-01'""",
)
def date_slice(spark, d):
    orders = load_table(spark, d, "orders", ["o_orderkey", "o_orderdate"])
    return pr.between_days(orders, "o_orderdate", dt.date(1996, 1, 1), dt.date(1997, 6, 30))


@query(
    "status_override",
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) = 2001 THEN o_orderpriority ELSE o_orderstatus END AS status
       FROM orders""",
)
def status_override(spark, d):
    orders = load_table(spark, d, "orders", ["o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority"])
    orders = orders.withColumnRenamed("o_orderstatus", "status")
    return pr.override_when(orders, "status", F.year("o_orderdate") == 2001, "o_orderpriority").select("o_orderkey", "status")


@query("distinct_choices", "SELECT DISTINCT o_orderpriority FROM orders")
def distinct_choices(spark, d):
    return pr.distinct_sorted(load_table(spark, d, "orders"), "o_orderpriority")


@query("distinct_rows", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def distinct_rows(spark, d):
    ev = load_table(spark, d, "events", ["user_id", "event_type", "ts"])
    return ev.select("user_id", "event_type", F.col("ts").cast("date").alias("day")).dropDuplicates()


@query(
    "renamed_columns",
    "SELECT s_suppkey AS supplier_suppkey_x, s_name AS supplier_name_x, s_nationkey AS supplier_nationkey_x, s_acctbal AS supplier_acctbal_x FROM supplier",
)
def renamed_columns(spark, d):
    return pr.rename_all(load_table(spark, d, "supplier"), {"s_": "supplier_"}, "_x")


@query(
    "extreme_row_of_named_groups",
    """WITH v AS (SELECT event_id, user_id, event_type, value, min(value) OVER (PARTITION BY user_id, event_type) AS lo,
                         max(value) OVER (PARTITION BY user_id, event_type) AS hi FROM events)
       SELECT event_id, user_id, event_type, value FROM v
       WHERE CASE WHEN event_type = 'click' THEN value = lo WHEN event_type = 'view' THEN value = hi ELSE true END""",
)
def extreme_row_of_named_groups(spark, d):
    ev = load_table(spark, d, "events", ["event_id", "user_id", "event_type", "value"])
    kind = F.col("event_type")
    return pr.keep_extreme(ev, ["user_id", "event_type"], "value", kind == "click", kind == "view")


@query(
    "without_first_rows",
    """SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
       WHERE rn > 6""",
)
def without_first_rows(spark, d):
    ev = load_table(spark, d, "events", ["event_id", "user_id", "ts"])
    return pr.skip_first(ev, ["user_id"], ["ts", "event_id"], 6)


@query(
    "pattern_filter",
    """SELECT p_partkey, CASE WHEN contains(p_type, 'BRASS') OR p_type LIKE '%a%' THEN 'yes' ELSE 'no' END AS hit
       FROM part WHERE regexp_matches(p_name, '^[a-m].*e')""",
)
def pattern_filter(spark, d):
    part = load_table(spark, d, "part", ["p_partkey", "p_name", "p_type"]).filter(F.col("p_name").rlike("^[a-m].*e"))
    hit = F.col("p_type").contains("BRASS") | F.col("p_type").like("%a%")
    return part.select("p_partkey", F.when(hit, "yes").otherwise("no").alias("hit"))


@query(
    "view_by_choices",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
       WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def view_by_choices(spark, d):
    orders = load_table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    return pr.slice_rows(
        orders, {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderkey": None}
    )


@query(
    "member_of_many",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def member_of_many(spark, d):
    """Line items of urgent orders: most others are dropped where they are read."""
    urgent = load_table(spark, d, "orders", ["o_orderkey", "o_orderpriority"]).filter(F.col("o_orderpriority") == "1-URGENT")
    return pr.one_of_many(load_table(spark, d, "lineitem", LINE_KEY), "l_orderkey", urgent.select("o_orderkey"))


@query(
    "member_of_table",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def member_of_table(spark, d):
    urgent = load_table(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select("o_custkey")
    return pr.one_of(load_table(spark, d, "customer", ["c_custkey", "c_name"]), "c_custkey", urgent)


@query(
    "masked_values",
    "SELECT event_id, CASE WHEN abs(value - 50) >= 20 THEN value ELSE 0.0 END AS kept FROM events WHERE value IS NOT NULL",
)
def masked_values(spark, d):
    ev = load_table(spark, d, "events", ["event_id", "value"])
    return ev.select("event_id", pr.masked("value", F.abs(F.col("value") - 50) >= 20).alias("kept"))


# ---- scalar functions ------------------------------------------------------------------------


@query(
    "clock_columns",
    """SELECT event_id, minute(ts) + second(ts) / 60.0 AS minutes,
              (hour(ts) - 1) * 15 + minute(ts) + second(ts) / 60.0 AS game_minutes FROM events""",
    "minutes game_minutes",
)
def clock_columns(spark, d):
    ev = load_table(spark, d, "events", ["event_id", "ts"])
    ev = ev.withColumn("clock", F.concat_ws(":", F.minute("ts"), F.second("ts")))
    return ev.select(
        "event_id",
        sc.clock_minutes("clock").alias("minutes"),
        sc.game_minutes(F.hour("ts"), sc.clock_minutes("clock")).alias("game_minutes"),
    )


@query(
    "season_columns",
    """SELECT o_orderkey, CAST(year(o_orderdate) * 10001 + 1 AS INTEGER) AS season,
              CAST((year(o_orderdate) - 3) * 10001 + 1 AS INTEGER) AS three_back,
              CAST(year(o_orderdate) AS VARCHAR) || '-' || substr(CAST(year(o_orderdate) + 1 AS VARCHAR), 3, 2) AS season_text,
              make_date(year(o_orderdate), 7, 1) AS july,
              CAST(floor(date_diff('day', make_date(1960, 3, 9), CAST(o_orderdate AS DATE)) / 365.25) AS INTEGER) AS age,
              CAST((year(o_orderdate) - 2) * 10001 + 1 AS INTEGER) AS signed
       FROM orders""",
)
def season_columns(spark, d):
    orders = load_table(spark, d, "orders", ["o_orderkey", "o_orderdate"])
    year = F.year("o_orderdate")
    orders = orders.withColumn("season", sc.season_code(year))
    return orders.select(
        "o_orderkey",
        "season",
        sc.shift_season("season", -3).alias("three_back"),
        sc.season_text("season").alias("season_text"),
        sc.july_first("season").alias("july"),
        sc.age_in_years(F.col("o_orderdate").cast("date"), F.lit(dt.date(1960, 3, 9))).alias("age"),
        sc.signing_season(F.concat_ws("-", year, year + 1), F.lit("2")).alias("signed"),
    )


@query(
    "bucket_columns",
    """SELECT p_partkey, CASE WHEN p_size > -1 AND p_size <= 5 THEN '(-1,5]' WHEN p_size > 5 AND p_size <= 10 THEN '(5,10]'
              WHEN p_size > 10 AND p_size <= 25 THEN '(10,25]' WHEN p_size > 25 AND p_size <= 40 THEN '(25,40]' END AS size_bucket,
              coalesce(CASE WHEN p_size > 20 THEN p_brand END, 'NA') || '_' || p_type AS label
       FROM part""",
)
def bucket_columns(spark, d):
    part = load_table(spark, d, "part", ["p_partkey", "p_size", "p_brand", "p_type"])
    return part.select(
        "p_partkey",
        sc.bucket_label("p_size", [-1, 5, 10, 25, 40]).alias("size_bucket"),
        F.concat_ws("_", sc.text(F.when(F.col("p_size") > 20, F.col("p_brand"))), "p_type").alias("label"),
    )


@query(
    "amount_columns",
    """WITH a AS (SELECT c_custkey, c_acctbal AS amount FROM customer)
       SELECT c_custkey, amount AS parsed, amount * 0.3333 / 1.08 AS paid_1, amount AS exposure_1,
              amount - amount * 0.3333 / 1.08 AS exposure_2,
              amount - amount * 0.3333 / 1.08 - amount * 0.3333 / (1.08 * 1.08) AS exposure_3 FROM a""",
    "parsed paid_1 exposure_1 exposure_2 exposure_3",
)
def amount_columns(spark, d):
    cust = load_table(spark, d, "customer", ["c_custkey", "c_acctbal"])
    cust = cust.withColumn("parsed", sc.parse_amount(F.format_number("c_acctbal", 2)))
    out = cust.withColumns(sc.remaining_exposure("parsed", digits=None))
    return out.withColumn("paid_1", sc.payment_value("parsed", 1, digits=None)).drop("c_acctbal")


@query(
    "epoch_columns",
    """SELECT event_id, ts AS opened, date_trunc('second', ts) AS second_start FROM events""",
)
def epoch_columns(spark, d):
    ev = load_table(spark, d, "events", ["event_id", "ts"])
    seconds = F.expr("timestampdiff(SECOND, CAST('1970-01-01' AS timestamp_ntz), ts)")
    return ev.select("event_id", F.col("ts").alias("opened"), sc.epoch_ms(seconds * 1000).alias("second_start"))


@query(
    "folded_names",
    r"""SELECT DISTINCT strip_accents(regexp_replace(source || ' ' || lang || '-' || 'é', '[ -]', '.', 'g')) AS name FROM documents""",
)
def folded_names(spark, d):
    docs = load_table(spark, d, "documents", ["source", "lang"])
    raw = F.concat(F.col("source"), F.lit(" "), F.col("lang"), F.lit("-é"))
    return docs.select(dotted_name(raw).alias("name")).distinct()


@query(
    "folded_texts",
    r"""SELECT doc_id, md5(regexp_replace(strip_accents(replace(coalesce(text, ''), 'ß', 'ss')), '[^\x00-\x7F]', '', 'g')) AS folded FROM documents""",
)
def folded_texts(spark, d):
    """Whole texts in plain ASCII, letters outside the table of accents included."""
    docs = load_table(spark, d, "documents", ["doc_id", "text"])
    return docs.select("doc_id", F.md5(fold_unicode(F.coalesce("text", F.lit("")))).alias("folded"))


@query(
    "display_units",
    """SELECT c_custkey, round_even(c_acctbal / 10000 * 100, 2) AS pct_gp, round_even(round_even(abs(c_acctbal), 2) / 60, 2) AS "timeOnIcePerGame",
              round_even(c_acctbal / 7, 2) AS "pointsPerGame" FROM customer""",
    "pct_gp timeOnIcePerGame pointsPerGame",
)
def display_units(spark, d):
    """Balances as shares, seconds and rates in the units of the comparison table."""
    cust = load_table(spark, d, "customer", ["c_custkey", "c_acctbal"])
    rows = cust.select("c_custkey", (F.col("c_acctbal") / 10000).alias("pct_gp"), F.abs("c_acctbal").alias("timeOnIcePerGame"), (F.col("c_acctbal") / 7).alias("pointsPerGame"))
    return contracts.display_units(rows)


@query(
    "flag_columns",
    f"""SELECT {LINE_KEY_SQL}, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS home,
              CASE WHEN l_returnflag = 'R' AND l_quantity > 25 THEN 1 WHEN l_returnflag = 'A' AND l_quantity < 25 THEN 1 ELSE 0 END AS leading,
              CASE WHEN l_returnflag = 'R' THEN l_quantity + 50 ELSE l_quantity END AS to_goal
       FROM lineitem""",
)
def flag_columns(spark, d):
    li = load_table(spark, d, "lineitem", [*LINE_KEY, "l_returnflag", "l_quantity"])
    flag = F.col("l_returnflag")
    return li.select(
        *LINE_KEY,
        sc.is_home(flag, F.lit("R")).alias("home"),
        sc.is_leading(flag, F.lit("R"), F.lit("A"), F.col("l_quantity"), F.lit(25)).alias("leading"),
        sc.yards_to_goal(flag, F.lit("R"), "l_quantity").alias("to_goal"),
    )


# ---- joins -----------------------------------------------------------------------------------


@query(
    "order_geography",
    """SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
       LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def order_geography(spark, d):
    out = load_table(spark, d, "orders", ["o_orderkey", "o_custkey"])
    out = jn.lookup(out, load_table(spark, d, "customer"), {"o_custkey": "c_custkey"}, ["c_name", "c_nationkey"])
    out = jn.lookup(out, load_table(spark, d, "nation"), {"c_nationkey": "n_nationkey"}, ["n_name", "n_regionkey"])
    out = jn.lookup(out, load_table(spark, d, "region"), {"n_regionkey": "r_regionkey"}, ["r_name"])
    return out.select("o_orderkey", "c_name", "n_name", "r_name")


@query(
    "composite_join",
    f"""SELECT {', '.join('l.' + c for c in LINE_KEY)}, s.total FROM lineitem l JOIN
        (SELECT l_partkey AS p, l_suppkey AS s, sum(l_quantity) AS total FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) s
        ON l.l_partkey = s.p AND l.l_suppkey = s.s""",
)
def composite_join(spark, d):
    li = load_table(spark, d, "lineitem", [*LINE_KEY, "l_quantity", "l_returnflag"])
    totals = (
        li.filter(F.col("l_returnflag") == "R")
        .groupBy(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
        .agg(F.sum("l_quantity").alias("total"))
    )
    return jn.lookup(li.select(*LINE_KEY), totals, {"l_partkey": "p", "l_suppkey": "s"}, ["total"], "inner")


TEAM_GAMES_SQL = """ends AS (SELECT l_orderkey AS game, min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY 1 HAVING min(l_suppkey) < max(l_suppkey)),
    sides AS (SELECT game, a AS team, b AS opponent FROM ends UNION ALL SELECT game, b, a FROM ends),
    team_games AS (SELECT s.game, s.team, s.opponent, sum(l_quantity) AS shots, count(*) AS n FROM sides s
                   JOIN lineitem ON l_orderkey = s.game AND l_suppkey = s.team GROUP BY 1, 2, 3)"""


def team_games(spark, d):
    """Orders as games between their lowest and highest supplier, one row per side."""
    li = load_table(spark, d, "lineitem", ["l_orderkey", "l_suppkey", "l_quantity"])
    ends = li.groupBy(F.col("l_orderkey").alias("game")).agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"))
    ends = ends.filter(F.col("a") < F.col("b"))
    side = lambda team, other: F.struct(F.col(team).alias("team"), F.col(other).alias("opponent"))
    sides = ends.select("game", F.inline(F.array(side("a", "b"), side("b", "a"))))
    per = li.groupBy(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("team")).agg(
        F.sum("l_quantity").alias("shots"), F.count(F.lit(1)).alias("n")
    )
    return sides.join(per, ["game", "team"])


@query(
    "opponent_rows",
    f"""WITH {TEAM_GAMES_SQL} SELECT t.game, t.team, t.shots, o.shots AS shots_against FROM team_games t
        LEFT JOIN team_games o ON t.game = o.game AND t.team = o.opponent""",
)
def opponent_rows(spark, d):
    games = team_games(spark, d)
    return jn.opponent_lookup(games, games, "game", "team", "opponent", ["shots"], "_against").select(
        "game", "team", "shots", "shots_against"
    )


@query(
    "first_match_lookup",
    """SELECT n_nationkey, n_name, first_customer FROM nation LEFT JOIN
       (SELECT c_nationkey, min_by(c_name, c_custkey) AS first_customer FROM customer GROUP BY 1) ON n_nationkey = c_nationkey""",
)
def first_match_lookup(spark, d):
    nation = load_table(spark, d, "nation", ["n_nationkey", "n_name"])
    cust = load_table(spark, d, "customer").withColumn("first_customer", F.col("c_name"))
    return jn.first_match(nation, cust, {"n_nationkey": "c_nationkey"}, "c_custkey", ["first_customer"])


@query(
    "suffixed_join",
    """WITH y AS (SELECT o_custkey AS custkey, year(o_orderdate) AS yr, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1, 2)
       SELECT a.custkey, CAST(a.yr AS INTEGER) AS yr, a.total, a.n, b.total AS total_old, b.n AS n_old FROM y a LEFT JOIN y b ON a.custkey = b.custkey AND b.yr = a.yr - 1""",
    "total total_old",
)
def suffixed_join(spark, d):
    orders = load_table(spark, d, "orders", ["o_custkey", "o_totalprice", "o_orderdate"])
    years = orders.groupBy(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("yr")).agg(
        F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n")
    )
    before = years.withColumn("yr", F.col("yr") + 1)
    return jn.join_suffixed(years, before, ["custkey", "yr"])


@query(
    "outer_alignment",
    """SELECT day, coalesce(c, 0.0) - coalesce(p, 0.0) AS diff FROM
       (SELECT CAST(ts AS DATE) AS day, sum(value) AS c FROM events WHERE event_type = 'click' GROUP BY 1) FULL JOIN
       (SELECT CAST(ts AS DATE) AS day, sum(value) AS p FROM events WHERE event_type = 'purchase' GROUP BY 1) USING (day)""",
    "diff",
)
def outer_alignment(spark, d):
    ev = load_table(spark, d, "events", ["ts", "event_type", "value"])

    def daily(kind, name):
        return (
            ev.filter(F.col("event_type") == kind)
            .groupBy(F.col("ts").cast("date").alias("day"))
            .agg(F.sum("value").alias(name))
        )

    both = jn.align_outer(daily("click", "c"), daily("purchase", "p"), ["day"], {"c": 0.0, "p": 0.0})
    return both.select("day", (F.col("c") - F.col("p")).alias("diff"))


@query(
    "rows_by_setting",
    """SELECT w.w, t.t, count(*) AS n, avg(CASE WHEN value > t.t THEN value / w.w ELSE 0 END) AS mean FROM events
       CROSS JOIN (VALUES (5), (10)) w(w) CROSS JOIN (VALUES (25.0::DOUBLE), (75.0::DOUBLE)) t(t) GROUP BY 1, 2""",
    "mean",
)
def rows_by_setting(spark, d):
    settings = [{"w": w, "t": t} for w in (5, 10) for t in (25.0, 75.0)]
    rows = jn.with_choices(load_table(spark, d, "events", ["value"]), settings)
    kept = F.when(F.col("value") > F.col("t"), F.col("value") / F.col("w")).otherwise(0)
    return rows.groupBy("w", "t").agg(F.count(F.lit(1)).alias("n"), F.avg(kept).alias("mean"))


@query(
    "union_by_name",
    """SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment FROM supplier
       UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer""",
)
def union_by_name(spark, d):
    s = load_table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = load_table(spark, d, "customer").select(
        F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")
    )
    return jn.union_named(s, c)


@query(
    "nested_lists",
    """WITH t AS (SELECT conv_id, coalesce(role, '') = 'user' AS asks, turn, text,
                         CAST(row_number() OVER (PARTITION BY conv_id, coalesce(role, '') = 'user' ORDER BY turn, text) - 1 AS INTEGER) AS position FROM conversations),
            u AS (SELECT * FROM t WHERE asks), a AS (SELECT * FROM t WHERE NOT asks)
       SELECT conv_id, position, u.turn AS turn, u.text AS text, a.turn AS turn_next, a.text AS text_next FROM u FULL JOIN a USING (conv_id, position)""",
)
def nested_lists(spark, d):
    conv = load_table(spark, d, "conversations").withColumn("asks", F.coalesce(F.col("role") == "user", F.lit(False)))

    def turns(kind):
        return F.array_sort(F.collect_list(F.when(kind, F.struct("turn", "text"))))

    # the lists are the record itself: all turns of users, and all others
    nested = conv.groupBy("conv_id").agg(turns(F.col("asks")).alias("current"), turns(~F.col("asks")).alias("future"))
    return jn.explode_lists(nested, ["conv_id"], "current", "future", "_next", "position")


@query(
    "ranked_children",
    """WITH top AS (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS position FROM orders)
       SELECT t.o_custkey, t.position, o.o_orderkey, o.o_totalprice, o.o_orderpriority FROM top t JOIN orders o USING (o_orderkey) WHERE position <= 3""",
)
def ranked_children(spark, d):
    orders = load_table(spark, d, "orders", ["o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority"])
    slim = orders.select("o_custkey", "o_orderkey", "o_totalprice")
    top = pr.top_per_group(slim, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3, rank="position")
    return jn.ordered_lookup(top.drop("o_totalprice"), orders.drop("o_custkey"), "o_orderkey")


@query(
    "top_orders",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def top_orders(spark, d):
    orders = load_table(spark, d, "orders", ["o_orderkey", "o_totalprice"])
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


# ---- aggregates ------------------------------------------------------------------------------


@query(
    "grouped_means",
    """SELECT l_returnflag, l_linestatus, avg(l_quantity) AS mean_quantity, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n
       FROM lineitem GROUP BY 1, 2""",
    "mean_quantity revenue",
    4,
)
def grouped_means(spark, d):
    li = load_table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.avg("l_quantity").alias("mean_quantity"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "conditional_counts",
    """SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_returnflag = 'A') AS accepted,
              avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END) AS zero_share, bool_or(l_quantity > 45) AS any_large
       FROM lineitem GROUP BY 1""",
    "zero_share",
)
def conditional_counts(spark, d):
    li = load_table(spark, d, "lineitem", ["l_orderkey", "l_returnflag", "l_discount", "l_quantity"])
    return li.groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.count_if(F.col("l_returnflag") == "A").alias("accepted"),
        F.avg(F.when(F.col("l_discount") == 0, 1.0).otherwise(0.0)).alias("zero_share"),
        ag.any_true(F.col("l_quantity") > 45).alias("any_large"),
    )


@query(
    "share_of_all",
    """SELECT o_orderpriority, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1""",
    "share",
)
def share_of_all(spark, d):
    return ag.share_of_total(load_table(spark, d, "orders"), ["o_orderpriority"])


@query(
    "share_within",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n,
              count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY o_orderstatus) AS share FROM orders GROUP BY 1, 2""",
    "share",
)
def share_within(spark, d):
    return ag.share_of_total(load_table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_orderstatus"])


@query(
    "value_counts",
    "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3",
)
def value_counts(spark, d):
    return ag.value_counts(load_table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(
    "wide_by_status",
    """SELECT o_orderpriority, max(n) FILTER (WHERE o_orderstatus = 'F') AS "F", max(n) FILTER (WHERE o_orderstatus = 'O') AS "O",
              max(n) FILTER (WHERE o_orderstatus = 'P') AS "P"
       FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""",
)
def wide_by_status(spark, d):
    counts = ag.value_counts(load_table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"])
    return ag.to_wide(counts, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], "n")


@query(
    "long_by_measure",
    """SELECT l_returnflag, name, value FROM (SELECT l_returnflag, avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax
       FROM lineitem GROUP BY 1) UNPIVOT (value FOR name IN (quantity, discount, tax))""",
    "value",
)
def long_by_measure(spark, d):
    wide = load_table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax")
    )
    return ag.to_long(wide, ["l_returnflag"], ["quantity", "discount", "tax"])


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql():
    gap = "CASE WHEN l_tax > 0.01 THEN l_tax END"
    src = f"(SELECT l_quantity, l_extendedprice, l_discount, {gap} AS l_tax FROM lineitem)"
    return " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r FROM {src}" for a in NUMERIC for b in NUMERIC
    )


@query("correlations", _corr_sql(), "r")
def correlations(spark, d):
    li = load_table(spark, d, "lineitem", NUMERIC).withColumn("l_tax", F.when(F.col("l_tax") > 0.01, F.col("l_tax")))
    return ag.correlation_matrix(li, NUMERIC)


@query(
    "embedding_correlations",
    """WITH v AS (SELECT vec_id, i, CASE WHEN (vec_id + i) % 7 <> 0 THEN CAST(embedding[i + 1] AS DOUBLE) END AS x
              FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS i))
       SELECT 'c' || a.i AS var1, 'c' || b.i AS var2, corr(a.x, b.x) AS r FROM v a JOIN v b USING (vec_id) GROUP BY ALL""",
    "r",
)
def embedding_correlations(spark, d):
    """All components of the embeddings against each other, a seventh of them missing."""
    vectors = load_table(spark, d, "embeddings", ["vec_id", "embedding"])
    columns = {f"c{i}": F.when((F.col("vec_id") + i) % 7 != 0, F.get("embedding", F.lit(i)).cast("double")) for i in range(64)}
    return wide_correlations(vectors.select(*[c.alias(n) for n, c in columns.items()]), list(columns))


def _profile_sql():
    one = """SELECT '{c}' AS variable, count({c}) AS n, count(*) - count({c}) AS missing, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
             quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max, skewness({c}) AS skew
             FROM (SELECT l_quantity, l_extendedprice, l_discount, CASE WHEN l_tax > 0.01 THEN l_tax END AS l_tax FROM lineitem)"""
    return " UNION ALL ".join(one.format(c=c) for c in NUMERIC)


@query("column_profile", _profile_sql(), "mean std min q25 q50 q75 max skew", 4)
def column_profile(spark, d):
    li = load_table(spark, d, "lineitem", NUMERIC).withColumn("l_tax", F.when(F.col("l_tax") > 0.01, F.col("l_tax")))
    return ag.profile(li, NUMERIC)


@query(
    "price_histogram",
    """WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 50 AS w, count(*) AS total FROM orders),
            b AS (SELECT CAST(least(floor((o_totalprice - lo) / w), 49) AS INTEGER) AS bin, lo, w, total FROM orders, e)
       SELECT bin, lo + bin * w AS low, lo + (bin + 1) * w AS high, count(*) AS n, count(*) / (total * w) AS density FROM b GROUP BY bin, lo, w, total""",
    "low high density",
)
def price_histogram(spark, d):
    return ag.histogram(load_table(spark, d, "orders", ["o_totalprice"]), "o_totalprice", 50)


@query(
    "value_quantiles",
    """SELECT event_type, point, value FROM (SELECT event_type, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.95) AS c
       FROM events GROUP BY 1), LATERAL (VALUES (0.05::DOUBLE, a), (0.5::DOUBLE, b), (0.95::DOUBLE, c)) t(point, value)""",
    "value",
)
def value_quantiles(spark, d):
    return quantiles(load_table(spark, d, "events", ["event_type", "value"]), ["event_type"], "value", [0.05, 0.5, 0.95])


@query(
    "row_with_group_totals",
    """SELECT o_orderkey, o_custkey, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS customer_total,
              count(*) OVER (PARTITION BY o_custkey) AS customer_orders FROM orders""",
    "customer_total",
    4,
)
def row_with_group_totals(spark, d):
    orders = load_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    stats = {"customer_total": F.sum("o_totalprice"), "customer_orders": F.count(F.lit(1))}
    return with_group_stats(orders, ["o_custkey"], stats).drop("o_totalprice")


@query(
    "scaled_features",
    """SELECT p_partkey, p_brand, (p_size - avg(p_size) OVER w) / stddev_pop(p_size) OVER w AS p_size_z,
              (p_retailprice - avg(p_retailprice) OVER w) / stddev_pop(p_retailprice) OVER w * 0.25 AS p_retailprice_z
       FROM part WINDOW w AS (PARTITION BY p_brand)""",
    "p_size_z p_retailprice_z",
)
def scaled_features(spark, d):
    part = load_table(spark, d, "part", ["p_partkey", "p_brand", "p_size", "p_retailprice"])
    out = ag.standardise(part, ["p_brand"], ["p_size", "p_retailprice"], {"p_retailprice": 0.25})
    return out.drop("p_size", "p_retailprice")
