"""Customer marts, ratings, standings and tie-breaks over the games of all seasons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.operators import ratings as R
from tablewright.operators import sets as S
from tablewright.plans.scratch import Scratch
from tablewright.queries.registry import query, table
from tablewright.queries.testing import customer_mart

SCENARIOS, KNOWN_UNTIL = 20, 500


@query("""SELECT c_custkey AS customer_id, c_name AS name, CAST(min(o_orderdate) AS DATE) AS first_order_date, CAST(max(o_orderdate) AS DATE) AS most_recent_order_date, CAST(count(o_orderkey) AS BIGINT) AS number_of_orders
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""")
def d1_customer_mart(spark: SparkSession, d: str) -> DataFrame:
    return customer_mart(table(spark, d, "customer"), table(spark, d, "orders")).build()["final"]


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderstatus = 'F' AS done, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS up, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS down FROM orders),
a AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS orders, CAST(count(*) FILTER (done) AS BIGINT) AS completed, min(day) FILTER (done) AS first_completed, max(day) FILTER (done) AS last_completed FROM o GROUP BY 1)
SELECT c_custkey AS customer_id, coalesce(a.orders, 0) AS orders, coalesce(a.completed, 0) AS completed, first_completed, last_completed, f.o_orderkey AS first_order, l.o_orderkey AS last_order, coalesce(l.done, false) AS last_is_completed
FROM customer LEFT JOIN a ON c_custkey = a.o_custkey LEFT JOIN o f ON c_custkey = f.o_custkey AND f.up = 1 LEFT JOIN o l ON c_custkey = l.o_custkey AND l.down = 1""")
def d2_enriched_mart(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("customer_id"), "o_orderkey", "o_orderdate", F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderstatus") == "F").alias("done"))
    # First and last rows come out of the same grouping as the counts: one shuffle, no sort of all orders.
    at = F.struct("o_orderdate", "o_orderkey")
    stats = orders.groupBy("customer_id").agg(
        F.count("*").alias("orders"), F.count_if("done").alias("completed"), F.min(F.when(F.col("done"), F.col("day"))).alias("first_completed"), F.max(F.when(F.col("done"), F.col("day"))).alias("last_completed"),
        F.min_by("o_orderkey", at).alias("first_order"), F.max_by("o_orderkey", at).alias("last_order"), F.max_by("done", at).alias("last_is_completed"),
    )
    out = table(spark, d, "customer").select(F.col("c_custkey").alias("customer_id")).join(stats, "customer_id", "left")
    return out.withColumns({"orders": F.coalesce("orders", F.lit(0)), "completed": F.coalesce("completed", F.lit(0)), "last_is_completed": F.coalesce("last_is_completed", F.lit(False))})


@query("""WITH s AS (SELECT c_mktsegment AS segment, c_custkey, round(coalesce(sum(o_totalprice), 0), 2) AS spent, CAST(count(o_orderkey) AS BIGINT) AS orders, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS completed FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2),
g AS (SELECT segment, CAST(count(*) AS BIGINT) AS customers, round(sum(spent), 2) AS spent, round(CAST(sum(completed) AS DOUBLE) / CAST(sum(orders) AS DOUBLE), 6) AS completed_rate, arg_max(c_custkey, (spent, c_custkey)) AS best_customer,
CAST(count(*) FILTER (spent >= 2000000) AS BIGINT) AS gold FROM s GROUP BY 1)
SELECT segment, customers, spent, completed_rate, best_customer, gold, CAST(rank() OVER (ORDER BY spent DESC) AS INTEGER) AS place FROM g UNION ALL SELECT 'unknown', 0, 0.0, NULL, NULL, 0, NULL""")
def d3_segment_report(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"), F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"))
    s = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")).join(orders, "c_custkey", "left").fillna(0, ["spent", "orders", "completed"]).withColumn("spent", F.round("spent", 2))
    g = s.groupBy("segment").agg(F.count("*").alias("customers"), F.round(F.sum("spent"), 2).alias("total"), F.round(F.sum("completed") / F.sum("orders"), 6).alias("completed_rate"), F.max_by("c_custkey", F.struct("spent", "c_custkey")).alias("best_customer"), F.count_if(F.col("spent") >= 2_000_000).alias("gold"))
    # Segments are few: their ranking is one small task.
    g = g.withColumnRenamed("total", "spent").withColumn("place", F.rank().over(Window.orderBy(F.desc("spent"))))
    return S.with_unknown_row(g, segment="unknown", customers=0, spent=0.0, gold=0)


# Games derived from orders

GAMES = """SELECT o_orderkey AS game_id, c_nationkey AS visiting_team, CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS INT) AS home_team, CAST(80 + o_orderkey * 7 % 41 AS INT) AS visiting_score,
CAST(80 + o_custkey * 11 % 43 AS INT) AS home_score, o_orderkey % 16 = 0 AS neutral, CAST(floor(o_custkey / 1500) * 1000000 + year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS season
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""
TEAMS = "SELECT n_nationkey AS team, n_regionkey AS conf, n_nationkey % 2 AS division, 1400 + n_nationkey * 37 % 300 AS elo_rating FROM {nation}"
GAMES_SQL = f"games AS MATERIALIZED ({GAMES.format(orders='orders', customer='customer')}), teams AS MATERIALIZED ({TEAMS.format(nation='nation')})"


def games(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(GAMES, orders=table(spark, d, "orders"), customer=table(spark, d, "customer"))


def teams(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(TEAMS, nation=table(spark, d, "nation"))


def p_sql(own: str, other: str, bonus: str = "0") -> str:
    return f"(1.0 / (pow(10.0, -({own} - {other} + {bonus}) / 400.0) + 1))"


PAIRS_SQL = f"WITH {GAMES_SQL}, x AS (SELECT a.team AS a, b.team AS b, a.elo_rating AS ea, b.elo_rating AS eb, {p_sql('a.elo_rating', 'b.elo_rating', '100')} AS p FROM teams a JOIN teams b ON a.team <> b.team)"


def team_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All ordered pairs of the 25 teams."""
    a = teams(spark, d).select(F.col("team").alias("a"), F.col("elo_rating").alias("ea"))
    b = teams(spark, d).select(F.col("team").alias("b"), F.col("elo_rating").alias("eb"))
    return a.join(b, F.col("a") != F.col("b"))


@query(f"{PAIRS_SQL} SELECT a, b, round(p, 8) AS p, ea - eb AS difference FROM x")
def d4_win_probability(spark: SparkSession, d: str) -> DataFrame:
    p = R.win_probability(F.col("ea"), F.col("eb"), R.HOME_BONUS)
    return team_pairs(spark, d).select("a", "b", F.round(p, 8).alias("p"), (F.col("ea") - F.col("eb")).alias("difference"))


@query(f"""{PAIRS_SQL} SELECT a, b, CASE WHEN p >= 0.5 THEN '-' || CAST(round_even(p * 100 / (1 - p), 0) AS INTEGER) ELSE '+' || CAST(round_even((1 - p) * 100 / p, 0) AS INTEGER) END AS odds, round_even(-(ea - eb + 100.0) / 28.0 * 2, 0) / 2 AS line FROM x""")
def d5_american_odds(spark: SparkSession, d: str) -> DataFrame:
    p = R.win_probability(F.col("ea"), F.col("eb"), R.HOME_BONUS)
    return team_pairs(spark, d).select("a", "b", R.american_odds(p).alias("odds"), R.implied_line(F.col("ea"), F.col("eb"), R.HOME_BONUS).alias("line"))


def rolled(spark: SparkSession, d: str, margins: Callable[[int, float], float] = R.log_margin) -> DataFrame:
    # 25 teams: their first ratings go along with the tasks.
    first = {r.team: float(r.elo_rating) for r in teams(spark, d).collect()}
    out = R.rolled_ratings(games(spark, d), first, margins=margins)
    return out.withColumns({c: F.round(c, 4) for c in ("visiting_before", "home_before", "visiting_after", "home_after")})


def rolled_sql(name: str, margin: str) -> str:
    """The fold as a recursion over the places of games in their seasons, all seasons at once; the state is a list of ratings."""
    return f"""{name}_g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY season ORDER BY game_id, visiting_team, home_team) AS k, abs(home_score - visiting_score) AS margin, home_score >= visiting_score AS won FROM games),
{name}_s AS (SELECT season, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS game_id, CAST(NULL AS INTEGER) AS vt, CAST(NULL AS INTEGER) AS ht, CAST(0 AS DOUBLE) AS v, CAST(0 AS DOUBLE) AS h, CAST(0 AS DOUBLE) AS change, (SELECT list(CAST(elo_rating AS DOUBLE) ORDER BY team) FROM teams) AS r
    FROM (SELECT DISTINCT season FROM games)
  UNION ALL SELECT season, k, game_id, vt, ht, v, h, change, list_transform(r, lambda x, i: CASE WHEN i = vt + 1 THEN x - change WHEN i = ht + 1 THEN x + change ELSE x END) FROM (
    SELECT *, 20.0 * ({margin}) * (CAST(won AS INTEGER) - 1 / (pow(10.0, -ahead / 400.0) + 1)) AS change FROM (
      SELECT *, CASE WHEN won THEN ahead ELSE -ahead END AS lead_ FROM (
        SELECT s.season, g.k, g.game_id, g.visiting_team AS vt, g.home_team AS ht, s.r[g.visiting_team + 1] AS v, s.r[g.home_team + 1] AS h, s.r, margin, won, s.r[g.home_team + 1] - s.r[g.visiting_team + 1] + CASE WHEN neutral THEN 0 ELSE 100.0 END AS ahead
        FROM {name}_s s JOIN {name}_g g ON s.season = g.season AND g.k = s.k + 1)))),
{name} AS MATERIALIZED (SELECT season, game_id, vt AS visiting_team, ht AS home_team, round(v, 4) AS visiting_before, round(h, 4) AS home_before, round(v - change, 4) AS visiting_after, round(h + change, 4) AS home_after FROM {name}_s WHERE k > 0)"""


LOG_SQL = "ln(margin + 1) * (2.2 / (lead_ * 0.001 + 2.2))"
POWER_SQL = "pow(margin + 3, 0.8) / (7.5 - 0.006 * lead_)"


@query(f"WITH RECURSIVE {GAMES_SQL}, {rolled_sql('a', LOG_SQL)}, {rolled_sql('b', POWER_SQL)} SELECT *, 'log' AS margins FROM a UNION ALL SELECT *, 'power' FROM b")
def d6_rating_roll_forward(spark: SparkSession, d: str) -> DataFrame:
    both = [rolled(spark, d, f).withColumn("margins", F.lit(n)) for n, f in (("log", R.log_margin), ("power", R.power_margin))]
    return both[0].unionByName(both[1])


@query(f"""WITH RECURSIVE {GAMES_SQL}, {rolled_sql('a', LOG_SQL)}, u AS (SELECT season, game_id, visiting_team AS team, visiting_after AS rating FROM a UNION ALL SELECT season, game_id, home_team, home_after FROM a)
SELECT teams.team, coalesce(arg_max(u.rating, (season, game_id)), CAST(any_value(elo_rating) AS DOUBLE)) AS rating FROM teams LEFT JOIN u ON teams.team = u.team GROUP BY 1""")
def d7_latest_ratings(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_ratings(rolled(spark, d), teams(spark, d))


LONG_SQL = """SELECT game_id, season, visiting_team AS team, home_team AS opponent, CAST(home_score < visiting_score AS INTEGER) AS won, visiting_score AS points, home_score AS against FROM games
UNION ALL SELECT game_id, season, home_team, visiting_team, CAST(home_score >= visiting_score AS INTEGER), home_score, visiting_score FROM games"""


@query(f"WITH {GAMES_SQL} {LONG_SQL}")
def d8_long_form(spark: SparkSession, d: str) -> DataFrame:
    return R.long_form(games(spark, d))


GRID_SQL = f"""{GAMES_SQL}, grid AS MATERIALIZED (SELECT s.i AS scenario_id, g.*, CAST((s.i * 7919 + game_id * 104729) % 10001 AS BIGINT) AS draw FROM games g, range(1, {SCENARIOS} + 1) s(i)),
cells AS MATERIALIZED (SELECT g.*, CASE WHEN game_id <= {KNOWN_UNTIL} THEN home_score >= visiting_score ELSE {p_sql('h.elo_rating', 'v.elo_rating', '100')} * 10000 >= draw END AS home_wins
FROM grid g JOIN teams h ON home_team = h.team JOIN teams v ON visiting_team = v.team)"""
ROWS_SQL = f"""{GAMES_SQL}, u AS ({LONG_SQL}),
rows_ AS MATERIALIZED (SELECT u.*, a.conf, a.division, a.conf = b.conf AS in_conf, a.conf = b.conf AND a.division = b.division AS in_division FROM u JOIN teams a ON u.team = a.team JOIN teams b ON u.opponent = b.team),
st AS MATERIALIZED (SELECT season, team, conf, division, CAST(sum(won) AS BIGINT) AS wins, CAST(count(*) AS BIGINT) AS games, CAST(count(*) - sum(won) AS BIGINT) AS losses, CAST(coalesce(sum(won) FILTER (in_division), 0) AS BIGINT) AS division_wins, CAST(count(*) FILTER (in_division) AS BIGINT) AS division_games,
CAST(coalesce(sum(won) FILTER (in_conf), 0) AS BIGINT) AS conf_wins, CAST(count(*) FILTER (in_conf) AS BIGINT) AS conf_games, CAST(sum(points - against) AS BIGINT) AS point_diff FROM rows_ GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {GRID_SQL} SELECT scenario_id, game_id, draw FROM grid")
def d9_scenario_grid(spark: SparkSession, d: str) -> DataFrame:
    return R.scenario_grid(games(spark, d), SCENARIOS).select("scenario_id", "game_id", "draw")


@query(f"WITH {GRID_SQL} SELECT scenario_id, game_id, home_wins FROM cells")
def d10_outcomes(spark: SparkSession, d: str) -> DataFrame:
    rate = lambda side: teams(spark, d).select(F.col("team").alias(f"{side}_team"), F.col("elo_rating").alias(f"{side}_elo"))
    rated = games(spark, d).join(rate("home"), "home_team").join(rate("visiting"), "visiting_team")
    return R.simulated(R.scenario_grid(rated, SCENARIOS), KNOWN_UNTIL).select("scenario_id", "game_id", "home_wins")


def season_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every team's games of all seasons, with their real results; written once, as ties read them more than once."""
    return Scratch(spark, "seasons").table(R.outcomes(games(spark, d), teams(spark, d)), "rows")


def season_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The rows and their standings, both written."""
    rows = season_rows(spark, d)
    return rows, Scratch(spark, "seasons").table(R.standings(rows), "standings")


def season_table(spark: SparkSession, d: str) -> DataFrame:
    return R.standings(R.outcomes(games(spark, d), teams(spark, d)))


@query(f"WITH {ROWS_SQL} SELECT * FROM st")
def d11_standings(spark: SparkSession, d: str) -> DataFrame:
    return season_table(spark, d)


@query(f"WITH {ROWS_SQL} SELECT r.season, r.team, CAST(sum(won) AS BIGINT) AS h2h_wins, CAST(count(*) AS BIGINT) AS h2h_games FROM rows_ r JOIN st a ON r.season = a.season AND r.team = a.team JOIN st b ON r.season = b.season AND r.opponent = b.team WHERE a.conf = b.conf AND a.wins = b.wins GROUP BY 1, 2")
def d12_head_to_head(spark: SparkSession, d: str) -> DataFrame:
    return R.head_to_head(*season_parts(spark, d))


@query(f"""WITH {ROWS_SQL}, m AS (SELECT r.season, r.team, r.opponent, r.won, a.conf, a.wins FROM rows_ r JOIN st a ON r.season = a.season AND r.team = a.team),
k AS (SELECT season, conf, wins, opponent FROM m GROUP BY ALL HAVING count(DISTINCT team) >= 2) SELECT season, team, CAST(sum(won) AS BIGINT) AS common_wins, CAST(count(*) AS BIGINT) AS common_games FROM m JOIN k USING (season, conf, wins, opponent) GROUP BY 1, 2""")
def d13_common_opponents(spark: SparkSession, d: str) -> DataFrame:
    return R.common_opponents(*season_parts(spark, d))


@query(f"WITH {ROWS_SQL} SELECT r.season, r.team, round(coalesce(avg(b.wins / b.games) FILTER (won = 1), 0), 8) AS victory, round(avg(b.wins / b.games), 8) AS schedule FROM rows_ r JOIN st b ON r.season = b.season AND r.opponent = b.team GROUP BY 1, 2")
def d14_strengths(spark: SparkSession, d: str) -> DataFrame:
    out = R.strengths(*season_parts(spark, d))
    return out.withColumns({c: F.round(c, 8) for c in ("victory", "schedule")})


@query(f"""WITH {ROWS_SQL} SELECT season, conf, team, wins, CAST(row_number() OVER (PARTITION BY season, conf ORDER BY wins DESC, division_wins DESC, conf_wins DESC, point_diff DESC, team DESC) AS INTEGER) AS place,
CASE WHEN count(*) OVER w = 1 THEN 'record' WHEN min(division_wins) OVER w <> max(division_wins) OVER w THEN 'division_wins' WHEN min(conf_wins) OVER w <> max(conf_wins) OVER w THEN 'conf_wins' WHEN min(point_diff) OVER w <> max(point_diff) OVER w THEN 'point_diff' ELSE 'team' END AS decided_by
FROM st WINDOW w AS (PARTITION BY season, conf, wins)""")
def d15_ordinal_rank(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(season_table(spark, d), ["division_wins", "conf_wins", "point_diff", "team"]).select("season", "conf", "team", "wins", "place", "decided_by")


@query(f"""WITH {ROWS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY season, conf ORDER BY wins DESC, conf_wins DESC, team) <= 3 AS strong FROM st),
m AS (SELECT r.season, r.team, coalesce(sum(won) FILTER (strong AND in_conf), 0) / greatest(count(*) FILTER (strong AND in_conf), 1) AS own_strong, coalesce(sum(won) FILTER (strong AND NOT in_conf), 0) / greatest(count(*) FILTER (strong AND NOT in_conf), 1) AS other_strong
  FROM rows_ r JOIN k ON r.season = k.season AND r.opponent = k.team GROUP BY 1, 2),
t AS (SELECT st.*, own_strong, other_strong, count(*) OVER (PARTITION BY st.season, conf, wins) AS tied FROM st LEFT JOIN m USING (season, team)), p AS (SELECT * FROM t WHERE tied = 2),
h AS (SELECT season, team, opponent, sum(won) * 2 - count(*) AS h2h FROM rows_ WHERE team < opponent GROUP BY 1, 2, 3),
b AS (SELECT a.season, a.conf, a.team AS x, b.team AS y, coalesce(h2h, 0) AS d1, CASE WHEN a.division = b.division THEN a.division_wins / greatest(a.division_games, 1) - b.division_wins / greatest(b.division_games, 1) ELSE 0 END AS d2, a.conf_wins / greatest(a.conf_games, 1) - b.conf_wins / greatest(b.conf_games, 1) AS d3,
  coalesce(a.own_strong - b.own_strong, 0) AS d4, coalesce(a.other_strong - b.other_strong, 0) AS d5, a.point_diff - b.point_diff AS d6 FROM p a JOIN p b ON a.season = b.season AND a.conf = b.conf AND a.wins = b.wins AND a.team < b.team LEFT JOIN h ON h.season = a.season AND h.team = a.team AND h.opponent = b.team),
w AS (SELECT *, CASE WHEN abs(d1) > 1e-9 THEN 'head_to_head' WHEN abs(d2) > 1e-9 THEN 'division' WHEN abs(d3) > 1e-9 THEN 'conference' WHEN abs(d4) > 1e-9 THEN 'own_eligible' WHEN abs(d5) > 1e-9 THEN 'other_eligible' WHEN abs(d6) > 1e-9 THEN 'point_diff' ELSE 'team' END AS rule FROM b),
z AS (SELECT *, CASE rule WHEN 'head_to_head' THEN d1 WHEN 'division' THEN d2 WHEN 'conference' THEN d3 WHEN 'own_eligible' THEN d4 WHEN 'other_eligible' THEN d5 WHEN 'point_diff' THEN d6 ELSE 1 END > 0 AS first_wins FROM w)
SELECT season, conf, CASE WHEN first_wins THEN x ELSE y END AS winner, CASE WHEN first_wins THEN y ELSE x END AS loser, rule FROM z""")
def d16_two_team_ties(spark: SparkSession, d: str) -> DataFrame:
    return R.two_team_ties(*season_parts(spark, d), 3)


def ties_sql(rounds: int = 5) -> str:
    """Rounds of splitting, one table each: more than a group of five teams can take."""
    steps = []
    for i in range(rounds):
        steps.append(f"""h{i} AS (SELECT a.season, a.team, sum(g.w) / sum(g.g) AS h2h FROM r{i} a JOIN r{i} b USING (season, conf, wins, before) JOIN gm g ON g.season = a.season AND g.team = a.team AND g.opponent = b.team WHERE a.rule <> 'team' GROUP BY 1, 2),
v{i} AS (SELECT r.*, coalesce(h.h2h, 0) AS h2h FROM r{i} r LEFT JOIN h{i} h ON h.season = r.season AND h.team = r.team),
s{i} AS (SELECT *, CASE WHEN count(*) OVER w = 1 OR rule = 'team' THEN rule WHEN min(h2h) OVER w < max(h2h) OVER w THEN 'head_to_head' WHEN min(division_wins) OVER w < max(division_wins) OVER w THEN 'division'
  WHEN min(conf_wins) OVER w < max(conf_wins) OVER w THEN 'conference' WHEN min(point_diff) OVER w < max(point_diff) OVER w THEN 'point_diff' ELSE 'team' END AS next, count(*) OVER w AS n FROM v{i} WINDOW w AS (PARTITION BY season, conf, wins, before)),
r{i + 1} AS (SELECT season, conf, wins, team, division_wins, conf_wins, point_diff, CASE WHEN n = 1 OR next = 'team' THEN before ELSE before - 1 + rank() OVER (PARTITION BY season, conf, wins, before
  ORDER BY CASE next WHEN 'head_to_head' THEN h2h WHEN 'division' THEN division_wins WHEN 'conference' THEN conf_wins ELSE point_diff END DESC) END AS before, next AS rule FROM s{i})""")
    return ",\n".join(steps)


@query(f"""WITH {ROWS_SQL}, gm AS (SELECT season, team, opponent, sum(won) AS w, count(*) AS g FROM rows_ GROUP BY 1, 2, 3),
r0 AS (SELECT season, conf, wins, team, division_wins, conf_wins, point_diff, 0 AS before, 'alone' AS rule FROM (SELECT *, count(*) OVER (PARTITION BY season, conf, wins) AS tied FROM st) WHERE tied >= 3),
{ties_sql()} SELECT season, conf, wins, team, CAST(before + row_number() OVER (PARTITION BY season, conf, wins, before ORDER BY team) AS INTEGER) AS place, rule FROM r5""")
def d17_multi_way_ties(spark: SparkSession, d: str) -> DataFrame:
    return R.multi_way_ties(*season_parts(spark, d))


@query(f"""WITH {ROWS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY season, conf ORDER BY wins DESC, point_diff DESC, team) AS place FROM st)
SELECT team, conf, round(avg(wins), 6) AS mean_wins, quantile_cont(CAST(wins AS DOUBLE), 0.05) AS low, quantile_cont(CAST(wins AS DOUBLE), 0.95) AS high, CAST(count(*) FILTER (place = 1) AS BIGINT) AS first_places,
CAST(round_even(quantile_cont(CAST(wins AS DOUBLE), 0.05), 0) AS INTEGER) || ' to ' || CAST(round_even(quantile_cont(CAST(wins AS DOUBLE), 0.95), 0) AS INTEGER) AS range FROM r GROUP BY 1, 2""")
def d18_season_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.season_summary(season_table(spark, d))


@query("""WITH f AS (SELECT user_id, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, bool_or(event_type = 'signup') AS s, bool_or(event_type = 'purchase') AS p FROM events GROUP BY 1)
SELECT CAST(count(*) FILTER (v) AS BIGINT) AS viewed, CAST(count(*) FILTER (v AND c) AS BIGINT) AS clicked, CAST(count(*) FILTER (v AND c AND s) AS BIGINT) AS signed_up, CAST(count(*) FILTER (v AND c AND s AND p) AS BIGINT) AS bought FROM f""")
def d19_funnel(spark: SparkSession, d: str) -> DataFrame:
    stages = ["view", "click", "signup", "purchase"]
    reached = table(spark, d, "events").groupBy("user_id").pivot("event_type", stages).count()
    through = [F.count_if(F.expr(" AND ".join(f"coalesce(`{s}`, 0) > 0" for s in stages[: i + 1]))) for i in range(4)]
    return reached.agg(*[c.alias(n) for c, n in zip(through, ("viewed", "clicked", "signed_up", "bought"))])


@query("""WITH r AS (SELECT s_suppkey, n_regionkey, s_nationkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey),
w AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM r WHERE place = 2)
SELECT s_suppkey, n_regionkey, 'winner' AS kind FROM r WHERE place = 1 UNION ALL SELECT s_suppkey, n_regionkey, 'wildcard' FROM w WHERE k = 1""")
def d20_winners_and_wildcards(spark: SparkSession, d: str) -> DataFrame:
    best = lambda key: Window.partitionBy(key).orderBy(F.desc("s_acctbal"), "s_suppkey")
    placed = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("place", F.row_number().over(best("s_nationkey"))).filter("place <= 2")
    winners = placed.filter("place = 1").select("s_suppkey", "n_regionkey", F.lit("winner").alias("kind"))
    wild = placed.filter("place = 2").withColumn("k", F.row_number().over(best("n_regionkey"))).filter("k = 1")
    return winners.unionByName(wild.select("s_suppkey", "n_regionkey", F.lit("wildcard").alias("kind")))


@query(f"""WITH {GAMES_SQL}, l AS ({LONG_SQL.replace("visiting_team AS team", "'away' AS venue, visiting_team AS team").replace("season, home_team, visiting_team", "season, 'home', home_team, visiting_team")})
SELECT team, season, CAST(count(*) AS BIGINT) AS games, CAST(sum(won) AS BIGINT) AS wins, CAST(count(*) FILTER (venue = 'home') AS BIGINT) AS home_games, CAST(coalesce(sum(won) FILTER (venue = 'home'), 0) AS BIGINT) AS home_wins, round(avg(points), 6) AS points, round(avg(against), 6) AS against FROM l GROUP BY 1, 2""")
def d21_team_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = R.long_form(games(spark, d), ["home_team"]).withColumn("home", F.col("team") == F.col("home_team"))
    return rows.groupBy("team", "season").agg(F.count("*").alias("games"), F.sum("won").alias("wins"), F.count_if("home").alias("home_games"), F.sum(F.when(F.col("home"), F.col("won")).otherwise(0)).alias("home_wins"), F.round(F.avg("points"), 6).alias("points"), F.round(F.avg("against"), 6).alias("against"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice <= 50000 THEN 0.25 WHEN o_totalprice <= 150000 THEN 0.5 WHEN o_totalprice <= 300000 THEN 0.75 ELSE 1.0 END AS weight FROM orders")
def d22_margin_value(spark: SparkSession, d: str) -> DataFrame:
    weight = R.margin_value(F.col("o_totalprice"), [(50_000, 0.25), (150_000, 0.5), (300_000, 0.75)], 1.0)
    return table(spark, d, "orders").select("o_orderkey", weight.alias("weight"))
