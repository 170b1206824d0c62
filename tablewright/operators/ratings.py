"""Ratings, outcomes per scenario, standings and tie-breaks.

Games have game_id, season, visiting_team, home_team, visiting_score, home_score; teams have team, conf, division, elo_rating.
A season is that of one league, so seasons grow in number with the games; standings and ties are those of a season.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.plans.scratch import Scratch

#: A rating difference of SPREAD is ten to one, the home side's bonus, points of rating per point of line.
SPREAD, HOME_BONUS, POINTS_A_LINE = 400.0, 100.0, 28.0


def win_probability(own: Column, other: Column, bonus: float = 0.0) -> Column:
    """Chance that ``own`` beats ``other``."""
    return F.lit(1.0) / (F.pow(F.lit(10.0), -(own - other + bonus) / SPREAD) + 1)


def american_odds(p: Column) -> Column:
    """Text of odds: minus for favourites, plus for others; 5 percent steps are rounded to whole numbers."""
    favourite = F.concat(F.lit("-"), F.bround(p * 100 / (1 - p), 0).cast("int").cast("string"))
    other = F.concat(F.lit("+"), F.bround((1 - p) * 100 / p, 0).cast("int").cast("string"))
    return F.when(p >= 0.5, favourite).otherwise(other)


def implied_line(own: Column, other: Column, bonus: float = 0.0) -> Column:
    """Points by which ``own`` is behind, in half points."""
    return F.bround(-(own - other + bonus) / POINTS_A_LINE * 2, 0) / 2


def log_margin(margin: int, lead: float) -> float:
    """How much a win by ``margin`` counts when the winner was ``lead`` ahead: by the logarithm, less for favourites."""
    return math.log(margin + 1) * (2.2 / (lead * 0.001 + 2.2))


def power_margin(margin: int, lead: float) -> float:
    """The same by a power of the margin. The lead's sign is as published for this formula: favourites' wins count more."""
    return (margin + 3) ** 0.8 / (7.5 - 0.006 * lead)


def rolled_ratings(games: DataFrame, ratings: dict[int, float], k: float = 20.0, margins: Callable[[int, float], float] = log_margin, bonus: float = HOME_BONUS) -> DataFrame:
    """Ratings before and after each game of a season, carried from game to game; ``margins`` weighs a win.

    Order matters within a season, so a season's games pass through one task in order; it holds a batch and the ratings, never
    a season, and Spark's sort spills. Seasons run side by side. Unknown teams start at 1500. Games with a column neutral give
    the home side no bonus where it is true. Games of one id are taken by their teams' order.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        season, now = math.nan, {}
        for pdf in batches:
            rows = []
            for g in pdf.itertuples():
                here = None if pd.isna(g.season) else g.season
                if here != season:
                    season, now = here, dict(ratings)
                v, h = now.get(g.visiting_team, 1500.0), now.get(g.home_team, 1500.0)
                ahead = h - v + (0.0 if g.neutral else bonus)
                expected = 1 / (10 ** (-ahead / SPREAD) + 1)
                won = float(g.home_score >= g.visiting_score)
                change = k * margins(abs(g.home_score - g.visiting_score), ahead if won else -ahead) * (won - expected)
                now[g.visiting_team], now[g.home_team] = v - change, h + change
                rows.append((g.season, g.game_id, g.visiting_team, g.home_team, v, h, now[g.visiting_team], now[g.home_team]))
            yield pd.DataFrame(rows, columns=["season", "game_id", "visiting_team", "home_team", "visiting_before", "home_before", "visiting_after", "home_after"])

    schema = "season long, game_id long, visiting_team int, home_team int, visiting_before double, home_before double, visiting_after double, home_after double"
    neutral = F.coalesce(F.col("neutral").cast("boolean"), F.lit(False)) if "neutral" in games.columns else F.lit(False)
    slim = games.select("season", "game_id", "visiting_team", "home_team", "visiting_score", "home_score", neutral.alias("neutral"))
    return slim.repartition("season").sortWithinPartitions("season", "game_id", "visiting_team", "home_team").mapInPandas(fold, schema)


def latest_ratings(rated: DataFrame, teams: DataFrame) -> DataFrame:
    """Each team's rating after its last game, from either side; its first rating if it has not played."""
    sides = F.explode(F.array(F.struct(F.col("visiting_team").alias("team"), F.col("visiting_after").alias("rating")), F.struct(F.col("home_team").alias("team"), F.col("home_after").alias("rating"))))
    last = rated.select("season", "game_id", sides.alias("s")).groupBy("s.team").agg(F.max_by("s.rating", F.struct("season", "game_id")).alias("rating"))
    return teams.join(last, "team", "left").select("team", F.coalesce("rating", F.col("elo_rating").cast("double")).alias("rating"))


def long_form(games: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per team and game: team, opponent, won, points, against; one scan. A tie goes to the home team."""
    home = F.col("home_score") >= F.col("visiting_score")
    side = lambda a, b, won: F.struct(F.col(f"{a}_team").alias("team"), F.col(f"{b}_team").alias("opponent"), won.cast("int").alias("won"), F.col(f"{a}_score").alias("points"), F.col(f"{b}_score").alias("against"))
    return games.select("game_id", "season", *extra, F.explode(F.array(side("visiting", "home", ~home), side("home", "visiting", home))).alias("s")).select("game_id", "season", *extra, "s.*")


def scenario_grid(schedule: DataFrame, scenarios: int) -> DataFrame:
    """Every game of the schedule in every scenario with a repeatable draw from 0 to 10,000; no random numbers.

    Scenarios are made beside each game, so the grid takes no join and no shuffle.
    """
    grid = schedule.withColumn("scenario_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(scenarios).cast("long"))))
    return grid.withColumn("draw", F.pmod(F.col("scenario_id") * 7919 + F.col("game_id") * 104729, F.lit(10001)))


def simulated(grid: DataFrame, known_until: int | None = None) -> DataFrame:
    """home_wins per cell: the actual result of games up to ``known_until``, else whether the draw is within the odds."""
    by_odds = win_probability(F.col("home_elo"), F.col("visiting_elo"), HOME_BONUS) * 10000 >= F.col("draw")
    actual = F.col("home_score") >= F.col("visiting_score")
    return grid.withColumn("home_wins", by_odds if known_until is None else F.when(F.col("game_id") <= known_until, actual).otherwise(by_odds))


def outcomes(games: DataFrame, teams: DataFrame) -> DataFrame:
    """One row per season, team and game with opponent, won, and whether it was within division or conference.

    Sides of teams are left to Spark's own size check.
    """
    own = teams.select("team", "conf", "division")
    theirs = teams.select(F.col("team").alias("opponent"), F.col("conf").alias("o_conf"), F.col("division").alias("o_division"))
    met = long_form(games).join(own, "team").join(theirs, "opponent")
    in_conf = F.col("conf") == F.col("o_conf")
    return met.withColumns({"in_conf": in_conf, "in_division": in_conf & (F.col("division") == F.col("o_division"))}).drop("o_conf", "o_division")


def standings(rows: DataFrame) -> DataFrame:
    """Wins, games, losses, division and conference records and point difference by season and team."""
    part = lambda c: F.sum(F.when(F.col(c), F.col("won")).otherwise(0))
    return rows.groupBy("season", "team", "conf", "division").agg(
        F.sum("won").alias("wins"), F.count("*").alias("games"), (F.count("*") - F.sum("won")).alias("losses"), part("in_division").alias("division_wins"), F.count_if("in_division").alias("division_games"),
        part("in_conf").alias("conf_wins"), F.count_if("in_conf").alias("conf_games"), F.sum(F.col("points") - F.col("against")).alias("point_diff"),
    )


def head_to_head(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(season, team, h2h_wins, h2h_games) against teams of the same conference with as many wins."""
    mine = table.select("season", "team", "conf", "wins")
    theirs = table.select("season", F.col("team").alias("opponent"), F.col("conf").alias("o_conf"), F.col("wins").alias("o_wins"))
    met = rows.select("season", "team", "opponent", "won").join(mine, ["season", "team"]).join(theirs, ["season", "opponent"])
    return met.filter("conf = o_conf AND wins = o_wins").groupBy("season", "team").agg(F.sum("won").alias("h2h_wins"), F.count("*").alias("h2h_games"))


def common_opponents(rows: DataFrame, table: DataFrame, least: int = 2) -> DataFrame:
    """(season, team, common_wins, common_games): record against opponents that ``least`` tied teams have met.

    Tied teams are those of one conference with equal wins.
    """
    met = rows.select("season", "team", "opponent", "won").join(table.select("season", "team", "conf", "wins"), ["season", "team"])
    shared = met.groupBy("season", "conf", "wins", "opponent").agg(F.countDistinct("team").alias("met_by")).filter(F.col("met_by") >= least)
    return met.join(shared, ["season", "conf", "wins", "opponent"]).groupBy("season", "team").agg(F.sum("won").alias("common_wins"), F.count("*").alias("common_games"))


def strengths(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(season, team, victory, schedule): mean win rate of beaten opponents, and of all opponents."""
    rate = table.select("season", F.col("team").alias("opponent"), (F.col("wins") / F.col("games")).alias("rate"))
    met = rows.select("season", "team", "opponent", "won").join(rate, ["season", "opponent"])
    return met.groupBy("season", "team").agg(F.coalesce(F.avg(F.when(F.col("won") == 1, F.col("rate"))), F.lit(0.0)).alias("victory"), F.avg("rate").alias("schedule"))


def ranked(table: DataFrame, criteria: Sequence[str], group: Sequence[str] = ("season", "conf")) -> DataFrame:
    """``table`` with place by wins and then ``criteria``, all descending, and decided_by, the criterion that told ties apart."""
    from tablewright.operators.windows import deciding_criterion

    w = Window.partitionBy(*group).orderBy(F.desc("wins"), *[F.desc(c) for c in criteria])
    return deciding_criterion(table.withColumn("place", F.row_number().over(w)), [*group, "wins"], criteria)


def two_team_ties(rows: DataFrame, table: DataFrame, eligible: int = 10) -> DataFrame:
    """(season, conf, winner, loser, rule) of groups of exactly two tied teams.

    Rules in order: head to head, division record (teams of one division), conference record, record against the
    conference's eligible teams, against the other conferences' eligible teams, point difference, then the smaller team.
    """
    w = Window.partitionBy("season", "conf").orderBy(F.desc("wins"), F.desc("conf_wins"), "team")
    strong = table.withColumn("rank", F.row_number().over(w)).select("season", F.col("team").alias("opponent"), F.col("conf").alias("o_conf"), (F.col("rank") <= eligible).alias("strong"))
    part = lambda c: F.sum(F.when(c, F.col("won")).otherwise(0)) / F.greatest(F.count_if(c), F.lit(1))
    met = rows.select("season", "team", "opponent", "won", "in_conf").join(strong, ["season", "opponent"])
    record = met.groupBy("season", "team").agg(part(F.col("strong") & F.col("in_conf")).alias("own_strong"), part(F.col("strong") & ~F.col("in_conf")).alias("other_strong"))
    rate = lambda name: F.col(f"{name}_wins") / F.greatest(F.col(f"{name}_games"), F.lit(1))
    full = table.join(record, ["season", "team"], "left").withColumns({"division_rate": rate("division"), "conf_rate": rate("conf")})
    pair = full.withColumn("tied", F.count("*").over(Window.partitionBy("season", "conf", "wins"))).filter("tied = 2")
    a, b = pair.alias("a"), pair.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("season", "conf", "wins")] + [F.col("a.team") < F.col("b.team")]
    both = a.join(b, on)
    games = rows.filter("team < opponent").groupBy("season", "team", "opponent").agg((F.sum("won") * 2 - F.count("*")).alias("h2h"))
    games = games.select(F.col("season").alias("h_season"), F.col("team").alias("h_team"), F.col("opponent").alias("h_opponent"), "h2h")
    both = both.join(games, (F.col("a.season") == F.col("h_season")) & (F.col("a.team") == F.col("h_team")) & (F.col("b.team") == F.col("h_opponent")), "left")
    diff = lambda c: F.coalesce(F.col(f"a.{c}") - F.col(f"b.{c}"), F.lit(0.0)).cast("double")
    same_division = F.col("a.division") == F.col("b.division")
    rules = [("head_to_head", F.coalesce("h2h", F.lit(0)).cast("double")), ("division", F.when(same_division, diff("division_rate")).otherwise(0.0)), ("conference", diff("conf_rate")), ("own_eligible", diff("own_strong")), ("other_eligible", diff("other_strong")), ("point_diff", diff("point_diff"))]
    sign, rule = F.lit(1.0), F.lit("team")
    for name, d in reversed(rules):
        sign, rule = F.when(F.abs(d) > 1e-9, d).otherwise(sign), F.when(F.abs(d) > 1e-9, name).otherwise(rule)
    first = sign > 0
    return both.select(F.col("a.season").alias("season"), F.col("a.conf").alias("conf"), F.when(first, F.col("a.team")).otherwise(F.col("b.team")).alias("winner"), F.when(first, F.col("b.team")).otherwise(F.col("a.team")).alias("loser"), rule.alias("rule"))


#: Rules that split a tied group, in order: the record among its teams comes first.
TIE_RULES = (("head_to_head", "h2h"), ("division", "division_wins"), ("conference", "conf_wins"), ("point_diff", "point_diff"))


def multi_way_ties(rows: DataFrame, table: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(season, conf, wins, team, place, rule) of all tied groups of three or more.

    A rule splits a group; parts that stay tied are taken up again from the first rule, among themselves. All open groups are
    split at once in a round of window aggregates, and a team's group is named by the number of teams before it. Rounds grow
    with the depth of ties, which is below the size of the largest group. A group that no rule splits is in order of team.
    """
    scratch = scratch or Scratch(rows.sparkSession, "ties")
    tied = table.withColumn("tied", F.count("*").over(Window.partitionBy("season", "conf", "wins"))).filter("tied >= 3")
    group = ["season", "conf", "wins", "before"]
    now = tied.select("season", "conf", "wins", "team", "division_wins", "conf_wins", "point_diff", F.lit(0).alias("before"), F.lit("alone").alias("rule"))
    now = scratch.table(now, "open")
    games = rows.join(now.select("season", "team"), ["season", "team"], "left_semi").groupBy("season", "team", "opponent").agg(F.sum("won").alias("w"), F.count("*").alias("g"))
    games = scratch.table(games, "games")
    w, done = Window.partitionBy(*group), []
    while True:
        # Groups of one team, and those that the round before found no rule for, are placed.
        done.append(now.withColumn("n", F.count("*").over(w)).filter("n = 1 OR rule = 'team'").drop("n"))
        now = scratch.table(now.withColumn("n", F.count("*").over(w)).filter("n > 1 AND rule <> 'team'").drop("n"), "open")
        if now.isEmpty():
            break
        theirs = now.select(*group, F.col("team").alias("opponent"))
        record = now.select(*group, "team").join(games, ["season", "team"]).join(theirs, [*group, "opponent"]).groupBy(*group, "team").agg((F.sum("w") / F.sum("g")).alias("h2h"))
        valued = now.join(record, [*group, "team"], "left").withColumn("h2h", F.coalesce("h2h", F.lit(0.0)))
        value, rule = F.lit(0.0), F.lit("team")
        for name, c in reversed(TIE_RULES):
            splits = F.min(c).over(w) < F.max(c).over(w)
            value, rule = F.when(splits, F.col(c).cast("double")).otherwise(value), F.when(splits, name).otherwise(rule)
        split = valued.withColumns({"value": value, "rule": rule})
        ahead = F.rank().over(w.orderBy(F.desc("value"))) - 1
        now = scratch.table(split.withColumn("before", F.col("before") + ahead).select(*now.columns), "split")
    last = functools.reduce(DataFrame.unionByName, done)
    place = F.col("before") + F.row_number().over(w.orderBy("team"))
    return last.select("season", "conf", "wins", "team", place.cast("int").alias("place"), "rule")


def season_summary(table: DataFrame) -> DataFrame:
    """Per team over seasons: mean wins, a 90 percent range as text, and how often it leads its conference."""
    w = Window.partitionBy("season", "conf").orderBy(F.desc("wins"), F.desc("point_diff"), "team")
    rows = table.withColumn("place", F.row_number().over(w))
    low, high = F.percentile("wins", 0.05), F.percentile("wins", 0.95)
    text = lambda c: F.bround(c, 0).cast("int").cast("string")
    out = rows.groupBy("team", "conf").agg(F.round(F.avg("wins"), 6).alias("mean_wins"), low.alias("low"), high.alias("high"), F.count_if(F.col("place") == 1).alias("first_places"))
    return out.withColumn("range", F.concat(text(F.col("low")), F.lit(" to "), text(F.col("high"))))


def margin_value(margin: Column, steps: Sequence[tuple[float, float]], other: float) -> Column:
    """The value of the first step whose bound the margin does not exceed."""
    out = F.lit(other)
    for bound, value in reversed(steps):
        out = F.when(margin <= bound, value).otherwise(out)
    return out
