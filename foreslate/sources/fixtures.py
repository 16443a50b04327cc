"""The domain tables stood up on the TPC-H-like tables (see FIXTURES.md).

The heavy views are written once per session and folder as derived tables;
everything else is lazy.  Sizes are never assumed: joins carry no hints, so
Spark broadcasts a side only when its own size statistics allow it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .store import materialize

LAST_PLAYED = "2001-07-01"


class Fixture:
    """Views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        """One row per (order, line number), dealt by order: sides and plays group and join by it without another shuffle."""
        return self.table("lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_partkey").alias("l_partkey"),
            F.min("l_suppkey").alias("l_suppkey"),
            F.sum("l_quantity").alias("l_quantity"),
            F.max("l_discount").alias("l_discount"),
            F.max("l_tax").alias("l_tax"),
            F.min("l_returnflag").alias("l_returnflag"),
        )

    @cached_property
    def contests(self) -> DataFrame:
        odd = F.col("l_linenumber") % 2 == 1
        sides = self.lines.groupBy("l_orderkey").agg(
            F.min("l_suppkey").alias("suppkey"),
            F.sum(F.when(odd, F.col("l_quantity"))).alias("h"),
            F.sum(F.when(~odd, F.col("l_quantity"))).alias("a"),
            (F.min(F.when(odd, F.col("l_partkey"))) % 200).alias("home_qb_id"),
            (F.min(F.when(~odd, F.col("l_partkey"))) % 200).alias("away_qb_id"),
        ).where(F.col("h").isNotNull() & F.col("a").isNotNull())
        nation = self.table("nation")
        home = nation.select(
            F.col("n_nationkey").alias("home_nation"), F.col("n_name").alias("home_name"),
            F.col("n_regionkey").alias("home_region"),
        )
        away = nation.select(
            F.col("n_nationkey").alias("away_nation"), F.col("n_name").alias("away_name"),
            F.col("n_regionkey").alias("away_region"),
        )
        hosts = self.table("customer").select(
            "c_custkey", "c_mktsegment", F.col("c_nationkey").alias("home_nation")
        ).join(home, "home_nation")
        guests = self.table("supplier").select(
            "s_suppkey", F.col("s_nationkey").alias("away_nation")
        ).join(away, "away_nation")
        priced = F.col("game_id") % 10 != 0
        played = F.col("kickoff") < F.lit(LAST_PLAYED).cast("timestamp_ntz")
        gap, total = F.col("h") - F.col("a"), F.col("h") + F.col("a")
        return (
            self.table("orders")
            .select(
                F.col("o_orderkey").alias("game_id"), "o_custkey",
                F.col("o_orderdate").cast("timestamp_ntz").alias("kickoff"), "o_orderpriority",
            )
            .join(sides, F.col("game_id") == F.col("l_orderkey"))
            .join(hosts, F.col("o_custkey") == F.col("c_custkey"))
            .join(guests, F.col("suppkey") == F.col("s_suppkey"))
            .where(F.col("home_nation") != F.col("away_nation"))
            .select(
                "game_id",
                F.col("c_mktsegment").alias("league"),
                F.year("kickoff").alias("season"),
                (F.floor((F.dayofyear("kickoff") - 1) / 7.0) + 1).cast("int").alias("week"),
                "kickoff",
                F.concat_ws("/", "c_mktsegment", "home_name").alias("home_team"),
                F.concat_ws("/", "c_mktsegment", "away_name").alias("away_team"),
                F.when(played, F.col("h")).alias("home_score"),
                F.when(played, F.col("a")).alias("away_score"),
                "home_qb_id", "away_qb_id",
                F.when(priced, F.floor(gap * 0.6) / 2.0).alias("spread_line"),
                F.when(priced, F.floor(total * 1.8) / 2.0).alias("total_line"),
                (F.col("o_orderpriority") == "1-URGENT").alias("neutral"),
                (F.col("home_region") == F.col("away_region")).alias("div_game"),
            )
        )

    @cached_property
    def games(self) -> DataFrame:
        """Contests with rest days, outcome, weather and prices.

        Rest is a lag inside (team, season); a team's first contest of a
        season looks at the latest kickoff of its earlier seasons instead, so
        no single task holds a team's whole history.
        """
        contests = materialize(self.contests, "contests")
        side = contests.select(
            "game_id", "season", "kickoff",
            F.explode(F.array(
                F.struct(F.col("home_team").alias("team"), F.lit(True).alias("is_home")),
                F.struct(F.col("away_team").alias("team"), F.lit(False).alias("is_home")),
            )).alias("s"),
        ).select("game_id", "season", "kickoff", "s.*")
        last = side.groupBy("team", "season").agg(F.max("kickoff").alias("last"))
        earlier = last.select(
            "team", "season",
            F.max("last").over(
                W.partitionBy("team").orderBy("season").rowsBetween(W.unboundedPreceding, -1)
            ).alias("earlier"),
        )
        inside = F.lag("kickoff").over(W.partitionBy("team", "season").orderBy("kickoff", "game_id"))
        rest = (
            side.withColumn("inside", inside)
            .join(earlier, ["team", "season"], "left")
            .withColumn("rest", F.date_diff("kickoff", F.coalesce("inside", "earlier")))
            .groupBy("game_id")
            .agg(
                F.max(F.when(F.col("is_home"), F.col("rest"))).alias("home_rest"),
                F.max(F.when(~F.col("is_home"), F.col("rest"))).alias("away_rest"),
            )
        )
        gid, line = F.col("game_id"), F.col("spread_line")
        reading = (gid % 4 != 0) & (gid % 9 != 0)
        margin = F.col("home_score") - F.col("away_score")
        return materialize(
            contests.join(rest, "game_id").withColumns({
                "completed": F.col("home_score").isNotNull(),
                "margin": margin,
                "home_win": F.when(margin > 0, 1.0).when(margin < 0, 0.0).when(margin == 0, 0.5),
                "is_playoff": F.col("week") > 44,
                "roof": F.when(gid % 4 == 0, "dome").otherwise("outdoors"),
                "wind": F.when(reading, (gid % 45).cast("double")),
                "temp": F.when(reading, (gid % 130 - 15).cast("double")),
                "home_moneyline": F.when(line >= 0, -110 - 5 * line).otherwise(100 - 5 * line),
                "away_moneyline": F.when(line >= 0, 100 + 5 * line).otherwise(-110 + 5 * line),
            }), "games",
        )

    @cached_property
    def plays(self) -> DataFrame:
        k = self.games.where("completed").select(
            "game_id", "league", "season", "week", "home_team", "away_team"
        )
        odd = F.col("l_linenumber") % 2 == 1
        return materialize(
            k.join(self.lines, F.col("game_id") == F.col("l_orderkey")).select(
                "game_id", "league", "season", "week",
                F.when(odd, F.col("home_team")).otherwise(F.col("away_team")).alias("posteam"),
                F.when(odd, F.col("away_team")).otherwise(F.col("home_team")).alias("defteam"),
                F.when(F.col("l_returnflag") == "A", "pass")
                .when(F.col("l_returnflag") == "R", "run").otherwise("punt").alias("play_type"),
                F.round((F.col("l_discount") - 0.05) * 10, 4).alias("epa"),
                F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0).alias("success"),
                F.col("l_quantity").alias("yards_gained"),
                F.when(F.col("l_tax") >= 0.07, 1.0).otherwise(0.0).alias("interception"),
                F.when(F.col("l_tax") == 0, 1.0).otherwise(0.0).alias("sack"),
                F.col("l_linenumber").alias("drive"),
                F.col("l_linenumber").alias("seq"),
                F.when(F.col("l_linenumber") <= 4, 1).otherwise(3).alias("qtr"),
                (F.col("l_partkey") % 200).alias("player_id"),
            ), "plays",
        )

    @cached_property
    def player_weeks(self) -> DataFrame:
        kind = F.col("play_type")

        def total(column, of):
            return F.sum(F.when(kind == of, column).otherwise(0.0))

        return materialize(
            self.plays.groupBy(
                "player_id", "league", "season", "week", "game_id",
                F.col("posteam").alias("team"), F.col("defteam").alias("opponent_team"),
            ).agg(
                total(F.lit(1.0), "pass").alias("attempts"),
                total(F.col("yards_gained"), "pass").alias("passing_yards"),
                F.sum("sack").alias("sacks_suffered"),
                F.sum(F.when(kind == "pass", F.col("epa"))).alias("passing_epa"),
                F.avg(
                    F.when((kind == "pass") & (F.col("season") >= 1997), F.col("success"))
                ).alias("passing_cpoe"),
                total(F.lit(1.0), "run").alias("carries"),
                total(F.col("yards_gained"), "run").alias("rushing_yards"),
                total(F.lit(1.0), "punt").alias("targets"),
                total(F.col("yards_gained"), "punt").alias("receiving_yards"),
            ), "player_weeks",
        )

    @cached_property
    def injuries(self) -> DataFrame:
        kind = (F.col("player_id") + F.col("week")) % 4
        return (
            self.plays.where((F.col("season") >= 1997) & (F.col("player_id") % 3 == 0))
            .select(
                "season", "week", F.col("posteam").alias("team"),
                F.col("player_id").alias("gsis_id"),
                F.when(kind == 0, "Out").when(kind == 1, "Doubtful")
                .when(kind == 2, " Questionable ").alias("report_status"),
            )
            .distinct()
        )

    @cached_property
    def events(self) -> DataFrame:
        """Independent event log: entity, season = weeks since 1970, which go on over years."""
        return self.table("events").select(
            F.col("user_id").alias("entity"),
            F.floor(F.datediff("ts", F.lit("1970-01-01")) / 7).cast("int").alias("season"),
            F.lit(1).alias("week"),
            "ts", "event_id", "event_type",
            # one value in seven is withheld so null-skipping is exercised
            F.when(F.col("event_id") % 7 != 3, F.col("value")).alias("value"),
        )


_OPEN: dict[tuple[str, str], Fixture] = {}


def fixture(spark: SparkSession, folder: str) -> Fixture:
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _OPEN:
        _OPEN[key] = Fixture(spark, folder)
    return _OPEN[key]


# --- the same views as DuckDB text, put in front of every oracle ----------

VIEW_SQL = {
    "line_u": ("", """
SELECT l_orderkey, l_linenumber, min(l_partkey) l_partkey, min(l_suppkey) l_suppkey, sum(l_quantity) l_quantity,
       max(l_discount) l_discount, max(l_tax) l_tax, min(l_returnflag) l_returnflag
FROM lineitem GROUP BY l_orderkey, l_linenumber"""),
    "sides": ("line_u", """
SELECT l_orderkey, min(l_suppkey) suppkey,
       sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END) home_score,
       sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END) away_score,
       min(CASE WHEN l_linenumber % 2 = 1 THEN l_partkey END) % 200 home_qb,
       min(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END) % 200 away_qb
FROM line_u GROUP BY l_orderkey"""),
    "contests": ("sides", """
SELECT o.o_orderkey AS game_id, c.c_mktsegment AS league,
       CAST(year(o.o_orderdate) AS INT) AS season,
       CAST(floor((dayofyear(o.o_orderdate) - 1) / 7.0) AS INT) + 1 AS week,
       o.o_orderdate AS kickoff,
       c.c_mktsegment || '/' || hn.n_name AS home_team,
       c.c_mktsegment || '/' || an.n_name AS away_team,
       CASE WHEN o.o_orderdate < TIMESTAMP '2001-07-01' THEN s.home_score END AS home_score,
       CASE WHEN o.o_orderdate < TIMESTAMP '2001-07-01' THEN s.away_score END AS away_score,
       s.home_qb home_qb_id, s.away_qb away_qb_id,
       CASE WHEN o.o_orderkey % 10 <> 0 THEN floor((s.home_score - s.away_score) * 0.6) / 2.0 END AS spread_line,
       CASE WHEN o.o_orderkey % 10 <> 0 THEN floor((s.home_score + s.away_score) * 1.8) / 2.0 END AS total_line,
       o.o_orderpriority = '1-URGENT' AS neutral,
       hn.n_regionkey = an.n_regionkey AS div_game
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation hn ON c.c_nationkey = hn.n_nationkey
JOIN sides s ON s.l_orderkey = o.o_orderkey
JOIN supplier sp ON sp.s_suppkey = s.suppkey JOIN nation an ON sp.s_nationkey = an.n_nationkey
WHERE hn.n_nationkey <> an.n_nationkey AND s.home_score IS NOT NULL AND s.away_score IS NOT NULL"""),
    "plays": ("contests line_u", """
SELECT k.game_id, k.league, k.season, k.week,
       CASE WHEN l.l_linenumber % 2 = 1 THEN k.home_team ELSE k.away_team END AS posteam,
       CASE WHEN l.l_linenumber % 2 = 1 THEN k.away_team ELSE k.home_team END AS defteam,
       CASE l.l_returnflag WHEN 'A' THEN 'pass' WHEN 'R' THEN 'run' ELSE 'punt' END AS play_type,
       round((l.l_discount - 0.05) * 10, 4) AS epa,
       CAST(CASE WHEN l.l_discount > 0.05 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS success,
       l.l_quantity AS yards_gained,
       CAST(CASE WHEN l.l_tax >= 0.07 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS interception,
       CAST(CASE WHEN l.l_tax = 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS sack,
       l.l_linenumber AS drive, l.l_linenumber AS seq,
       CASE WHEN l.l_linenumber <= 4 THEN 1 ELSE 3 END AS qtr, l.l_partkey % 200 AS player_id
FROM contests k JOIN line_u l ON l.l_orderkey = k.game_id WHERE k.home_score IS NOT NULL"""),
    "player_weeks": ("plays", """
SELECT player_id, league, season, week, game_id, posteam AS team, defteam AS opponent_team,
       CAST(sum(CASE WHEN play_type = 'pass' THEN 1 ELSE 0 END) AS DOUBLE) AS attempts,
       sum(CASE WHEN play_type = 'pass' THEN yards_gained ELSE 0 END) AS passing_yards,
       sum(sack) AS sacks_suffered, sum(CASE WHEN play_type = 'pass' THEN epa END) AS passing_epa,
       avg(CASE WHEN play_type = 'pass' AND season >= 1997 THEN success END) AS passing_cpoe,
       CAST(sum(CASE WHEN play_type = 'run' THEN 1 ELSE 0 END) AS DOUBLE) AS carries,
       sum(CASE WHEN play_type = 'run' THEN yards_gained ELSE 0 END) AS rushing_yards,
       CAST(sum(CASE WHEN play_type = 'punt' THEN 1 ELSE 0 END) AS DOUBLE) AS targets,
       sum(CASE WHEN play_type = 'punt' THEN yards_gained ELSE 0 END) AS receiving_yards
FROM plays GROUP BY player_id, league, season, week, game_id, posteam, defteam"""),
    "injuries": ("plays", """
SELECT DISTINCT season, week, team, player_id AS gsis_id,
       CASE (player_id + week) % 4 WHEN 0 THEN 'Out' WHEN 1 THEN 'Doubtful' WHEN 2 THEN ' Questionable ' END AS report_status
FROM (SELECT season, week, posteam AS team, player_id FROM plays WHERE season >= 1997 AND player_id % 3 = 0)"""),
    "team_schedule": ("contests", """
SELECT game_id, league, season, week, kickoff, team, is_home,
       date_diff('day', lag(kickoff) OVER (PARTITION BY team ORDER BY kickoff, game_id), kickoff) AS rest
FROM (SELECT game_id, league, season, week, kickoff, home_team AS team, TRUE AS is_home FROM contests
      UNION ALL
      SELECT game_id, league, season, week, kickoff, away_team, FALSE FROM contests)"""),
    "games": ("contests team_schedule", """
SELECT k.*, h.rest AS home_rest, a.rest AS away_rest,
       k.home_score IS NOT NULL AS completed, k.home_score - k.away_score AS margin,
       CAST(CASE WHEN k.home_score > k.away_score THEN 1.0 WHEN k.home_score < k.away_score THEN 0.0
            WHEN k.home_score = k.away_score THEN 0.5 END AS DOUBLE) AS home_win,
       k.week > 44 AS is_playoff,
       CASE WHEN k.game_id % 4 = 0 THEN 'dome' ELSE 'outdoors' END AS roof,
       CAST(CASE WHEN k.game_id % 4 <> 0 AND k.game_id % 9 <> 0 THEN k.game_id % 45 END AS DOUBLE) AS wind,
       CAST(CASE WHEN k.game_id % 4 <> 0 AND k.game_id % 9 <> 0 THEN k.game_id % 130 - 15 END AS DOUBLE) AS temp,
       CASE WHEN k.spread_line >= 0 THEN -110 - 5 * k.spread_line ELSE 100 - 5 * k.spread_line END AS home_moneyline,
       CASE WHEN k.spread_line >= 0 THEN 100 + 5 * k.spread_line ELSE -110 + 5 * k.spread_line END AS away_moneyline
FROM contests k
JOIN team_schedule h ON h.game_id = k.game_id AND h.is_home
JOIN team_schedule a ON a.game_id = k.game_id AND NOT a.is_home"""),
    "log": ("", """
SELECT user_id AS entity, CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 7.0) AS INT) AS season, 1 AS week, ts, event_id, event_type,
       CASE WHEN event_id % 7 <> 3 THEN value END AS value
FROM events"""),
}
