"""Landed feed payloads to tables.

A payload is one text value. Parsing is ``from_json`` with fixed schemas followed
by column expressions; there is no row function and no inference. Field names are
those of the feeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorebook import schemas
from scorebook.functions import text as t
from scorebook.functions.text import Spec
from scorebook.operators import derive


def _strings(*names: str) -> str:
    return "struct<" + ", ".join(f"`{n}`: string" for n in names) + ">"


# Fields of the schedule, summary, squad and innings feeds.
SCHEDULE = "Matchsummary array<" + _strings(
    "MatchID", "CompetitionName", "GroundName", "city", "HomeTeamName", "AwayTeamName",
    "FirstBattingTeamName", "SecondBattingTeamName", "MatchName", "MatchStatus", "Comments",
    "Commentss", "TossDetails", "TossTeam", "MatchOrder", "RowNo", "ROUND_ID", "MatchDate",
    "MATCH_COMMENCE_START_DATE", "MatchType", "MATCH_NO_OF_OVERS", "GroundUmpire1",
    "GroundUmpire2", "ThirdUmpire", "FirstBattingSummary", "SecondBattingSummary",
) + ">"
SUMMARY = "MatchSummary array<" + _strings(
    "MOM", "Target", "Referee", "GroundUmpire1", "GroundUmpire2", "ThirdUmpire", "IsSuperOver",
    "RevisedOver", "RevisedTarget", "IsMatchEnd", "Comments",
) + ">"
_SQUAD_ROW = _strings(
    "PlayerName", "PlayerShortName", "TeamName", "PlayingOrder", "IsCaptain", "IsWK",
    "IsNonDomestic", "PlayerSkill", "BattingType", "BowlingProficiency", "PlayerID", "PlayerImage",
)
SQUAD = f"squadA array<{_SQUAD_ROW}>, squadB array<{_SQUAD_ROW}>"
INNINGS = (
    "struct<Extras: array<"
    + _strings(
        "BattingTeamName", "BowlingTeamName", "Total", "FallWickets", "FallOvers", "TotalExtras",
        "Byes", "LegByes", "Wides", "NoBalls", "Penalty", "CurrentRunRate",
    )
    + ">, BattingCard: array<"
    + _strings(
        "PlayerName", "PlayingOrder", "Runs", "Balls", "Fours", "Sixes", "DotBalls", "StrikeRate",
        "OutDesc", "BowlerName", "WicketNo",
    )
    + ">, BowlingCard: array<"
    + _strings(
        "PlayerName", "BowlingOrder", "Overs", "TotalLegalBallsBowled", "Maidens", "Runs",
        "Wickets", "Wides", "NoBalls", "DotBalls", "Economy",
    )
    + ">, FallOfWickets: array<" + _strings("FallWickets", "PlayerName", "FallScore", "FallOvers")
    + ">, PartnershipScores: array<"
    + _strings(
        "RowNumber", "MatchMinOver", "MatchMaxOver", "StrikerBalls", "NonStrikerBalls", "Striker",
        "NonStriker", "PartnershipTotal", "StrikerRuns", "NonStrikerRuns", "Extras",
    )
    + ">, PartnershipBreak: array<map<string, string>>, OverHistory: array<"
    + _strings(
        "BallNo", "ActualBallNo", "OverNo", "ActualRuns", "Extras", "BallRuns", "IsWide",
        "IsNoBall", "IsBye", "IsLegBye", "IsFour", "IsSix", "IsWicket", "WicketType", "BatsManName",
        "BowlerName",
    )
    + ">>"
)


def unwrap_jsonp(payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(payloads with ``body``, quarantine with ``reason``).

    The body is what stands between the first and the last parenthesis, or the
    text itself when it is plain JSON. Only objects are bodies.
    """
    raw = F.trim(F.col(column))
    wrapped = raw.rlike(r"(?s)^[^({\[\"]*\(.*\)")
    body = F.when(wrapped, F.trim(F.regexp_extract(raw, r"(?s)^[^(]*\((.*)\)", 1))).otherwise(raw)
    parsed = F.try_parse_json(F.when(body != "", body))
    reason = (
        F.when(raw.isNull() | (raw == ""), F.lit("empty payload"))
        .when(body == "", F.lit("empty body"))
        .when(parsed.isNull(), F.lit("malformed JSON"))
        .when(~F.schema_of_variant(parsed).startswith("OBJECT"), F.lit("not an object"))
    )
    judged = payloads.withColumn("body", body).withColumn("reason", reason)
    return (
        judged.where(F.col("reason").isNull()).drop("reason", column),
        judged.where(F.col("reason").isNotNull()).drop("body"),
    )


def _rows(payloads: DataFrame, schema: str, array: str, *keep: str) -> DataFrame:
    parsed = payloads.select(
        *keep, F.from_json("body", schema, {"mode": "PERMISSIVE"}).alias("feed")
    )
    return parsed.select(*keep, F.posexplode(f"feed.{array}").alias("row_at", "row"))


def _cell(name: str, block: str = "row") -> Column:
    return F.col(f"{block}.{name}")


def read_schedule_feed(payloads: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame]:
    """(contest headers, innings totals named on the schedule).

    ``payloads`` has body, season and competition_id.
    """
    rows = _rows(payloads, SCHEDULE, "Matchsummary", "season", "competition_id").where(
        F.coalesce(_cell("MatchID"), F.lit("")) != ""
    )
    rows = rows.withColumns(
        {
            "feed_season": F.coalesce(t.season_of(_cell("CompetitionName")), F.col("season")),
            "ground": t.canonical_place(_cell("GroundName"), _cell("city"), spec),
            "home_team": t.canonical_side(_cell("HomeTeamName"), spec),
            "away_team": t.canonical_side(_cell("AwayTeamName"), spec),
            "first_batting_team": t.canonical_side(_cell("FirstBattingTeamName"), spec),
            "second_batting_team": t.canonical_side(_cell("SecondBattingTeamName"), spec),
            "result": t.parse_result(F.coalesce(t.clean_text(_cell("Comments")), _cell("Commentss")), spec),
            "toss": t.parse_toss(_cell("TossDetails"), _cell("TossTeam"), spec),
            "label": t.detect_stage(_cell("MatchOrder"), _cell("MatchName")),
            "round": F.coalesce(t.to_int(_cell("ROUND_ID")), F.lit(0)),
            "status": F.lower(F.coalesce(t.clean_text(_cell("MatchStatus")), F.lit(""))),
            "kind": F.lower(F.coalesce(t.clean_text(_cell("MatchType")), F.lit(""))),
            "name": t.clean_text(_cell("MatchName")),
        }
    )
    versus = r"^(.*?) (?:vs|Vs|VS|v) (.*)$"
    left = t.canonical_side(F.regexp_extract("name", versus, 1), spec)
    right = t.canonical_side(F.regexp_extract("name", versus, 2), spec)
    by_round = ~F.col("label.is_playoff") & (F.col("round") != 0)
    outcome = F.col("result.winner").isNotNull() | F.col("result.is_tie") | F.col("result.is_no_result")
    headers = rows.select(
        t.match_key(F.lit(spec.source), F.col("feed_season"), _cell("MatchID")).alias("match_key"),
        F.lit(spec.source).alias("source"),
        F.col("feed_season").alias("season"),
        _cell("MatchID").alias("source_match_id"),
        "competition_id",
        t.parse_date(_cell("MatchDate")).alias("match_date"),
        t.parse_timestamp(_cell("MATCH_COMMENCE_START_DATE")).alias("start_datetime"),
        F.coalesce(t.clean_text(_cell("MatchOrder")), t.clean_text(_cell("RowNo"))).alias("match_number"),
        F.when(by_round, F.coalesce("label.stage", F.lit("Playoff"))).otherwise(F.col("label.stage"))
        .alias("stage"),
        (F.col("label.is_playoff") | by_round).alias("is_playoff"),
        (F.col("kind").contains("(n)") | F.col("kind").contains("d/n")).alias("is_day_night"),
        t.to_int(_cell("MATCH_NO_OF_OVERS"), 20).alias("overs_per_innings"),
        F.col("ground.place").alias("venue"),
        F.col("ground.city").alias("city"),
        F.coalesce("home_team", left, "first_batting_team").alias("team1"),
        F.coalesce("away_team", right, "second_batting_team").alias("team2"),
        "home_team", "away_team",
        F.col("toss.winner").alias("toss_winner"),
        F.col("toss.decision").alias("toss_decision"),
        "first_batting_team", "second_batting_team",
        ((F.col("status") == "post") & outcome).alias("is_completed"),
        "result.*",
        t.is_neutral(F.col("home_team"), F.col("ground.place"), spec).alias("is_neutral_venue"),
        t.clean_text(_cell("GroundUmpire1")).alias("umpire1"),
        t.clean_text(_cell("GroundUmpire2")).alias("umpire2"),
        t.clean_text(_cell("ThirdUmpire")).alias("third_umpire"),
        t.parse_innings_summary(_cell("FirstBattingSummary")).alias("summary1"),
        t.parse_innings_summary(_cell("SecondBattingSummary")).alias("summary2"),
    )

    def innings(number: int, side: str, other: str) -> Column:
        return F.struct(
            F.lit(number).alias("innings_no"), F.col(side).alias("batting_team"),
            F.col(other).alias("bowling_team"),
            *[F.col(f"summary{number}.{c}").alias(c) for c in ("runs", "wickets", "overs", "balls")],
        )

    totals = (
        headers.select(
            "match_key",
            F.explode(
                F.array(
                    innings(1, "first_batting_team", "second_batting_team"),
                    innings(2, "second_batting_team", "first_batting_team"),
                )
            ).alias("i"),
        )
        .select("match_key", "i.*")
        .where(F.col("runs").isNotNull() & F.col("batting_team").isNotNull())
        .withColumn("run_rate", t.run_rate(F.col("runs"), F.col("balls")))
    )
    return headers.drop("summary1", "summary2"), totals


def apply_summary_feed(contests: DataFrame, payloads: DataFrame, spec: Spec) -> DataFrame:
    """Overlay award, target, officials and late results; ``payloads`` has match_key
    and body. The first row of a summary counts."""
    rows = _rows(payloads, SUMMARY, "MatchSummary", "match_key").where(F.col("row_at") == 0)
    late = rows.select(
        "match_key",
        t.canonical_actor(_cell("MOM"), spec).alias("s_player_of_match"),
        F.nullif(t.to_int(_cell("Target")), F.lit(0)).alias("s_target_runs"),
        t.clean_text(_cell("Referee")).alias("s_match_referee"),
        t.clean_text(_cell("GroundUmpire1")).alias("s_umpire1"),
        t.clean_text(_cell("GroundUmpire2")).alias("s_umpire2"),
        t.clean_text(_cell("ThirdUmpire")).alias("s_third_umpire"),
        t.to_bool(_cell("IsSuperOver")).alias("s_super_over"),
        (
            t.clean_text(_cell("RevisedOver")).isNotNull()
            | t.clean_text(_cell("RevisedTarget")).isNotNull()
        ).alias("s_revised"),
        t.to_bool(_cell("IsMatchEnd")).alias("s_ended"),
        t.parse_result(_cell("Comments"), spec).alias("s_result"),
    )
    for column, kind in {
        "player_of_match": "string", "target_runs": "int", "match_referee": "string",
        "is_dls_applied": "boolean",
    }.items():
        if column not in contests.columns:
            contests = contests.withColumn(column, F.lit(None).cast(kind))
    joined = contests.join(late, "match_key", "left")
    result = F.col("s_result")
    confirms = F.coalesce(
        ~F.col("is_completed") & F.col("s_ended")
        & (result["winner"].isNotNull() | result["is_tie"] | result["is_no_result"]),
        F.lit(False),
    )

    def late_or(name: str, keep_old: bool) -> Column:
        new = F.coalesce(result[name], F.col(name)) if keep_old else result[name]
        return F.when(confirms, new).otherwise(F.col(name))

    false = F.lit(False)
    return joined.withColumns(
        {
            **{
                c: F.coalesce(f"s_{c}", c)
                for c in (
                    "player_of_match", "target_runs", "match_referee", "umpire1", "umpire2",
                    "third_umpire",
                )
            },
            "is_super_over": F.coalesce("is_super_over", false) | F.coalesce("s_super_over", false),
            "is_dls_applied": F.coalesce("is_dls_applied", false) | F.coalesce("s_revised", false),
            "winner": late_or("winner", True),
            "result_type": late_or("result_type", True),
            "result_summary": late_or("result_summary", True),
            **{
                c: late_or(c, False)
                for c in ("win_margin_runs", "win_margin_wickets", "is_tie", "is_no_result")
            },
            "is_completed": F.col("is_completed") | confirms,
        }
    ).select(*contests.columns)


def innings_blocks(payloads: DataFrame, contests: DataFrame, spec: Spec) -> DataFrame:
    """Parsed innings payloads with the sides resolved. ``payloads`` has match_key,
    innings_no and body; the Extras block names both sides, else the batting order
    of the contest decides."""
    blocks = payloads.select(
        "match_key", "innings_no",
        F.coalesce(
            F.from_json("body", f"Innings1 {INNINGS}").getField("Innings1"),
            F.from_json("body", f"Innings2 {INNINGS}").getField("Innings2"),
        ).alias("block"),
    ).where(F.col("block").isNotNull())
    order = contests.select("match_key", "first_batting_team", "second_batting_team")
    extras = F.get(F.col("block.Extras"), F.lit(0))
    batting = t.canonical_side(extras["BattingTeamName"], spec)
    bowling = t.canonical_side(extras["BowlingTeamName"], spec)
    named = batting.isNotNull() & bowling.isNotNull()
    first = F.col("innings_no") == 1
    return blocks.join(order, "match_key", "left").select(
        "match_key", "innings_no", "block",
        F.when(named, batting)
        .otherwise(F.when(first, F.col("first_batting_team")).otherwise(F.col("second_batting_team")))
        .alias("batting_team"),
        F.when(named, bowling)
        .otherwise(F.when(first, F.col("second_batting_team")).otherwise(F.col("first_batting_team")))
        .alias("bowling_team"),
    )


INNINGS_KEYS = ["match_key", "innings_no"]


def _explode(blocks: DataFrame, name: str) -> DataFrame:
    return blocks.select(
        *INNINGS_KEYS, "batting_team", "bowling_team",
        F.posexplode(f"block.{name}").alias("row_at", "row"),
    )


def feed_attack_cards(blocks: DataFrame, spec: Spec) -> DataFrame:
    rows = _explode(blocks, "BattingCard").withColumn("out", t.parse_dismissal(_cell("OutDesc"), spec))
    return rows.select(
        *INNINGS_KEYS, F.col("batting_team").alias("team"),
        t.canonical_actor(_cell("PlayerName"), spec).alias("player"),
        t.to_int(_cell("PlayingOrder")).alias("batting_position"),
        *[t.to_int(_cell(f), 0).alias(c) for f, c in
          (("Runs", "runs"), ("Balls", "balls"), ("Fours", "fours"), ("Sixes", "sixes"))],
        t.to_int(_cell("DotBalls")).alias("dot_balls"),
        t.to_float(_cell("StrikeRate")).alias("strike_rate"),
        "out.is_out", "out.dismissal_kind", "out.dismissal_text",
        F.coalesce(t.canonical_actor(_cell("BowlerName"), spec), "out.bowler").alias("bowler"),
        "out.fielder",
        t.to_int(_cell("WicketNo")).alias("wicket_number"),
    ).where(F.col("player").isNotNull())


def feed_defence_cards(blocks: DataFrame, spec: Spec) -> DataFrame:
    overs = t.to_float(_cell("Overs"), 0.0)
    return _explode(blocks, "BowlingCard").select(
        *INNINGS_KEYS, F.col("bowling_team").alias("team"),
        t.canonical_actor(_cell("PlayerName"), spec).alias("player"),
        t.to_int(_cell("BowlingOrder")).alias("bowling_order"),
        overs.alias("overs"),
        F.coalesce(
            F.nullif(t.to_int(_cell("TotalLegalBallsBowled")), F.lit(0)), t.overs_to_balls(overs)
        ).cast("long").alias("balls"),
        *[t.to_int(_cell(f), 0).alias(c) for f, c in
          (("Maidens", "maidens"), ("Runs", "runs_conceded"), ("Wickets", "wickets"),
           ("Wides", "wides"), ("NoBalls", "no_balls"))],
        t.to_int(_cell("DotBalls")).alias("dot_balls"),
        t.to_float(_cell("Economy")).alias("economy"),
    ).where(F.col("player").isNotNull())


def feed_dismissals(blocks: DataFrame, spec: Spec) -> DataFrame:
    return _explode(blocks, "FallOfWickets").select(
        *INNINGS_KEYS, t.to_int(_cell("FallWickets")).alias("wicket_no"),
        t.canonical_actor(_cell("PlayerName"), spec).alias("player"),
        F.col("batting_team").alias("team"),
        t.to_int(_cell("FallScore")).alias("fall_score"),
        t.to_float(_cell("FallOvers")).alias("fall_overs"),
    ).where(F.col("wicket_no").isNotNull())


def feed_stands(blocks: DataFrame, spec: Spec) -> DataFrame:
    """The stands beyond the number of recorded breaks were still going."""
    rows = blocks.select(
        *INNINGS_KEYS, "batting_team",
        F.greatest(F.size("block.PartnershipBreak"), F.lit(0)).alias("breaks"),
        F.posexplode("block.PartnershipScores").alias("row_at", "row"),
    )
    index = F.col("row_at") + 1
    striker, non_striker = t.to_int(_cell("StrikerBalls"), 0), t.to_int(_cell("NonStrikerBalls"), 0)
    return rows.select(
        *INNINGS_KEYS,
        F.coalesce(F.nullif(t.to_int(_cell("RowNumber")), F.lit(0)), index).alias("wicket_no"),
        F.col("batting_team").alias("team"),
        t.canonical_actor(_cell("Striker"), spec).alias("striker"),
        t.canonical_actor(_cell("NonStriker"), spec).alias("non_striker"),
        t.to_int(_cell("PartnershipTotal")).alias("runs"),
        (striker + non_striker).alias("balls"),
        t.to_int(_cell("StrikerRuns")).alias("striker_runs"),
        striker.alias("striker_balls"),
        t.to_int(_cell("NonStrikerRuns")).alias("non_striker_runs"),
        non_striker.alias("non_striker_balls"),
        t.to_int(_cell("Extras")).alias("extras"),
        t.to_float(_cell("MatchMinOver")).alias("start_over"),
        t.to_float(_cell("MatchMaxOver")).alias("end_over"),
        (index > F.col("breaks")).alias("is_unbroken"),
    )


def read_event_history(blocks: DataFrame, spec: Spec) -> DataFrame:
    """Over history to events; over breaks and rows without an over are no balls.

    Totals come from bat plus extras and never from the display field. An innings
    is one array of one payload, so its window is bounded by the payload.
    """
    rows = _explode(blocks, "OverHistory").where(
        (F.coalesce(t.clean_text(_cell("BallNo")), F.lit("")) != "99")
        & t.clean_text(_cell("ActualBallNo")).isNotNull()
        & t.to_int(_cell("OverNo")).isNotNull()
    )
    bat, extra = t.to_int(_cell("ActualRuns"), 0), t.to_int(_cell("Extras"), 0)
    wide, no_ball = t.to_bool(_cell("IsWide")), t.to_bool(_cell("IsNoBall"))
    wicket = t.to_bool(_cell("IsWicket"))
    order = Window.partitionBy(*INNINGS_KEYS).orderBy("row_at")
    return rows.select(
        *INNINGS_KEYS,
        t.to_int(_cell("OverNo")).alias("over_no"),
        t.to_int(_cell("ActualBallNo"), 0).alias("ball_no"),
        F.row_number().over(order).alias("ball_seq"),
        "batting_team", "bowling_team",
        t.canonical_actor(_cell("BatsManName"), spec).alias("batter"),
        t.canonical_actor(_cell("BowlerName"), spec).alias("bowler"),
        bat.alias("batter_runs"), extra.alias("extra_runs"), (bat + extra).alias("total_runs"),
        wide.alias("is_wide"), no_ball.alias("is_no_ball"),
        t.to_bool(_cell("IsBye")).alias("is_bye"), t.to_bool(_cell("IsLegBye")).alias("is_leg_bye"),
        (~(wide | no_ball)).alias("is_legal"),
        t.to_bool(_cell("IsFour")).alias("is_four"), t.to_bool(_cell("IsSix")).alias("is_six"),
        wicket.alias("is_wicket"),
        t.clean_text(_cell("WicketType")).alias("wicket_type"),
        F.sum(bat + extra).over(order).alias("cumulative_runs"),
        F.sum(wicket.cast("int")).over(order).alias("cumulative_wickets"),
    )


def feed_period_totals(blocks: DataFrame) -> DataFrame:
    """Scorecard totals of the Extras block, for ``derive.merge_period_totals``."""
    extras = F.get(F.col("block.Extras"), F.lit(0))
    total = t.parse_innings_summary(extras["Total"])
    overs = t.to_float(extras["FallOvers"])
    return blocks.where(extras.isNotNull()).select(
        *INNINGS_KEYS, "batting_team", "bowling_team",
        total["runs"].alias("runs"), t.to_int(extras["FallWickets"]).alias("wickets"),
        overs.alias("overs"), t.overs_to_balls(overs).alias("balls"),
        t.to_int(extras["TotalExtras"]).alias("extras"), t.to_int(extras["Byes"]).alias("byes"),
        t.to_int(extras["LegByes"]).alias("leg_byes"), t.to_int(extras["Wides"]).alias("wides"),
        t.to_int(extras["NoBalls"]).alias("no_balls"), t.to_int(extras["Penalty"]).alias("penalty"),
        t.to_float(extras["CurrentRunRate"]).alias("run_rate"),
    )


def read_roster_feed(payloads: DataFrame, spec: Spec) -> DataFrame:
    """Both squads; the first eleven in order play, the twelfth may come in."""
    parsed = payloads.select("match_key", F.from_json("body", SQUAD).alias("feed"))
    empty = F.array().cast(f"array<{_SQUAD_ROW}>")
    rows = parsed.select(
        "match_key",
        F.explode(
            F.concat(F.coalesce("feed.squadA", empty), F.coalesce("feed.squadB", empty))
        ).alias("row"),
    )
    order = t.to_int(_cell("PlayingOrder"))
    return rows.select(
        "match_key",
        t.canonical_side(_cell("TeamName"), spec).alias("team"),
        F.coalesce(
            t.canonical_actor(_cell("PlayerName"), spec),
            t.canonical_actor(_cell("PlayerShortName"), spec),
        ).alias("player"),
        F.coalesce(order <= 11, F.lit(False)).alias("is_playing_xi"),
        t.to_bool(_cell("IsCaptain")).alias("is_captain"),
        t.to_bool(_cell("IsWK")).alias("is_wicketkeeper"),
        t.to_bool(_cell("IsNonDomestic")).alias("is_overseas"),
        F.coalesce(order == 12, F.lit(False)).alias("is_impact_sub"),
        order.alias("playing_order"),
        t.clean_text(_cell("PlayerSkill")).alias("role"),
        t.clean_text(_cell("BattingType")).alias("batting_style"),
        t.clean_text(_cell("BowlingProficiency")).alias("bowling_style"),
        t.clean_text(_cell("PlayerID")).alias("source_player_id"),
        t.clean_text(_cell("PlayerImage")).alias("image_url"),
    ).where(F.col("player").isNotNull() & F.col("team").isNotNull())


def discover_competitions(
    schedules: DataFrame, keyword: str, known: DataFrame | None = None
) -> DataFrame:
    """Season -> competition id of the schedules whose first row names the league;
    the largest id of a season wins. ``known`` seasons are left out."""
    rows = _rows(schedules, SCHEDULE, "Matchsummary", "competition_id").where(F.col("row_at") == 0)
    name = t.clean_text(_cell("CompetitionName"))
    found = (
        rows.where(F.lower(name).contains(keyword.lower()))
        .select("competition_id", t.season_of(name).alias("season"))
        .where(F.col("season").isNotNull())
        .groupBy("season").agg(F.max("competition_id").alias("competition_id"))
    )
    return found if known is None else found.join(known.select("season"), "season", "left_anti")


def read_documents(spark: SparkSession, path: str, seasons: list[int] | None = None) -> DataFrame:
    """One nested JSON document per file; broken and undated ones are dropped. The
    season is the year of the first date and the file stem the source id."""
    docs = (
        spark.read.schema(schemas.DOCUMENT + ", _corrupt_record string")
        .option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        .withColumn("source_match_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json", 1))
    )
    return typed_documents(docs.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record"), seasons)


def typed_documents(docs: DataFrame, seasons: list[int] | None = None) -> DataFrame:
    dated = docs.withColumn(
        "match_date", t.parse_date(F.get(F.col("info.dates"), F.lit(0)))
    ).where(F.col("match_date").isNotNull()).withColumn("season", F.year("match_date"))
    return dated if seasons is None else dated.where(F.col("season").isin(*seasons))


def document_contests(docs: DataFrame, spec: Spec) -> DataFrame:
    """Contest headers of typed documents."""
    info = F.col("info")

    def first(array: Column, at: int = 0) -> Column:
        return F.get(array, F.lit(at))

    number = F.coalesce(
        t.clean_text(info["event"]["match_number"]), t.clean_text(info["event"]["stage"])
    )
    rows = docs.withColumns(
        {
            "ground": t.canonical_place(info["venue"], info["city"], spec),
            "team1": t.canonical_side(first(info["teams"]), spec),
            "team2": t.canonical_side(first(info["teams"], 1), spec),
            "label": t.detect_stage(info["event"]["stage"], number),
            "outcome": t.outcome_block(info["outcome"], spec),
        }
    )
    officials = info["officials"]
    extra = F.greatest(F.size("innings"), F.lit(0)) > 2
    return rows.select(
        t.match_key(F.lit(spec.source), F.col("season"), F.col("source_match_id")).alias("match_key"),
        F.lit(spec.source).alias("source"), "season", "source_match_id", "match_date",
        number.alias("match_number"), "label.*",
        F.coalesce(info["overs"], F.lit(20)).alias("overs_per_innings"),
        F.col("ground.place").alias("venue"), F.col("ground.city").alias("city"), "team1", "team2",
        F.col("team1").alias("home_team"), F.col("team2").alias("away_team"),
        t.canonical_side(info["toss"]["winner"], spec).alias("toss_winner"),
        t.clean_text(info["toss"]["decision"]).alias("toss_decision"),
        F.lit(None).cast("string").alias("first_batting_team"),
        F.lit(None).cast("string").alias("second_batting_team"),
        t.clean_text(first(officials["umpires"])).alias("umpire1"),
        t.clean_text(first(officials["umpires"], 1)).alias("umpire2"),
        t.clean_text(first(officials["tv_umpires"])).alias("third_umpire"),
        t.clean_text(first(officials["match_referees"])).alias("match_referee"),
        t.canonical_actor(first(info["player_of_match"]), spec).alias("player_of_match"),
        *[
            F.col(f"outcome.{c}").alias(c)
            for c in (
                "winner", "result_type", "win_margin_runs", "win_margin_wickets", "is_tie",
                "is_no_result", "is_dls_applied", "result_summary", "is_completed",
            )
        ],
        (F.col("outcome.is_super_over") | extra).alias("is_super_over"),
        t.is_neutral(F.col("team1"), F.col("ground.place"), spec).alias("is_neutral_venue"),
        first(F.col("innings"), 1)["target"]["runs"].alias("target_runs"),
    )


def read_document_rosters(docs: DataFrame, spec: Spec) -> DataFrame:
    """Side -> players map to roster rows; the position in the list is the order."""
    sides = docs.select(
        "source_match_id", "season", F.col("info.registry.people").alias("people"),
        F.explode("info.players").alias("side", "players"),
    )
    rows = sides.select(
        "source_match_id", "season", "people", "side", F.posexplode("players").alias("at", "name")
    )
    return rows.select(
        "source_match_id", "season",
        t.canonical_side(F.col("side"), spec).alias("team"),
        t.canonical_actor(F.col("name"), spec).alias("player"),
        F.lit(True).alias("is_playing_xi"),
        (F.col("at") + 1).alias("playing_order"),
        t.clean_text(F.try_element_at("people", "name")).alias("source_player_id"),
    ).where(F.col("team").isNotNull() & F.col("player").isNotNull())


def document_events(docs: DataFrame, spec: Spec) -> DataFrame:
    """Events of typed documents with canonical names, keyed by source_match_id."""
    info = F.col("info")
    flat = derive.flatten_events(
        docs.select(
            F.col("source_match_id").alias("match_id"),
            F.get(info["teams"], F.lit(0)).alias("team1"),
            F.get(info["teams"], F.lit(1)).alias("team2"), "innings",
        )
    )
    return flat.withColumns(
        {
            **{c: t.canonical_side(F.col(c), spec) for c in ("batting_team", "bowling_team")},
            **{
                c: t.canonical_actor(F.col(c), spec)
                for c in ("batter", "non_striker", "bowler", "dismissed")
            },
        }
    )
