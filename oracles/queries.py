"""Every registered query: an operator applied to tables derived from Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook import schemas
from scorebook.operators import (
    actors,
    derive,
    history,
    inplay,
    maintain,
    places,
    quality,
    reports,
    sides,
    standings,
)
from scorebook.sources import testdata as td
from scorebook.sources import warehouse as wh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return add


# Scorecards -----------------------------------------------------------------

for _name, _op in {
    "d2_attack_cards": derive.attack_cards,
    "d3_defence_cards": derive.defence_cards,
    "d4_maidens": derive.maidens,
    "d5_dismissals": derive.dismissals,
    "d6_stands": derive.stands,
    "d7_period_totals": derive.period_totals,
}.items():
    QUERIES[_name] = lambda spark, sf_dir, op=_op: op(td.events(spark, sf_dir))


def _cards_with_a_slip(totals: DataFrame) -> DataFrame:
    """Scorecards that disagree with the events on every fourth contest and leave
    the ball count out on every third."""
    slip = F.when(F.col("match_id") % 4 == 1, 1).otherwise(0)
    silent = F.col("match_id") % 3 == 0
    return totals.select(
        "match_id", "innings_no", "batting_team", "bowling_team",
        (F.col("runs") + slip).alias("runs"), "wickets", "extras",
        F.when(~silent, F.col("balls")).alias("balls"),
        F.when(~silent, F.col("overs")).alias("overs"),
        F.lit(None).cast("double").alias("run_rate"),
    )


@register("d8_merge_period_totals")
def _d8(spark, sf_dir):
    totals = derive.period_totals(td.events(spark, sf_dir))
    return derive.merge_period_totals(_cards_with_a_slip(totals), totals)


@register("d9_reconcile_periods")
def _d9(spark, sf_dir):
    stream = td.events(spark, sf_dir)
    return derive.reconcile_periods(_cards_with_a_slip(derive.period_totals(stream)), stream)


@register("d10_opponent_of")
def _d10(spark, sf_dir):
    totals = derive.period_totals(td.events(spark, sf_dir)).select(
        "match_id", "innings_no", "batting_team"
    )
    sides = td.headers(spark, sf_dir).select("match_id", "team1", "team2")
    return totals.join(sides, "match_id").select(
        "match_id", "innings_no", "batting_team",
        derive.opponent_of(F.col("batting_team"), F.col("team1"), F.col("team2")).alias("opponent"),
    )


# Shared inputs ---------------------------------------------------------------


def attack(spark, sf_dir, context=True):
    cards = derive.attack_cards(td.events(spark, sf_dir))
    return derive.with_context(cards, td.headers(spark, sf_dir)) if context else cards


def defence(spark, sf_dir, context=True):
    cards = derive.defence_cards(td.events(spark, sf_dir))
    return derive.with_context(cards, td.headers(spark, sf_dir)) if context else cards


def periods(spark, sf_dir, context=True):
    totals = derive.period_totals(td.events(spark, sf_dir))
    return derive.with_context(totals, td.headers(spark, sf_dir)) if context else totals


# Sides -----------------------------------------------------------------------

TRIO = ["NATION_1", "NATION_2", "NATION_3"]

for _name, _op in {
    "t1_long_form": sides.long_form,
    "t2_team_summary": sides.team_summary,
    "t3_title_counts": sides.title_counts,
    "t4_team_season_summary": sides.season_summary,
    "t5_form_timeline": sides.form_timeline,
    "t6_head_to_head": sides.head_to_head,
    "t7_head_to_head_by_venue": lambda c: sides.head_to_head_by(c, "venue"),
    "t7_head_to_head_by_season": lambda c: sides.head_to_head_by(c, "season"),
    "t7_meeting_list": lambda c: sides.meeting_list(c, "NATION_1", "NATION_2"),
    "t8_current_streak": sides.current_streak,
    "t9_last_result": sides.last_result,
    "t10_toss_impact": sides.toss_impact_sets,
    "t12_compare_sides": lambda c: sides.compare_sides(c, TRIO),
    "t12_season_pivot": lambda c: sides.season_pivot(c, TRIO),
    "t13_recent_form": sides.recent_form,
    "t14_fixture_list": lambda c: sides.fixture_list(
        c, team="NATION_2", completed=True, limit=20, offset=5
    ),
    "v2_side_record_by_place": lambda c: places.side_record_by_place(c, min_matches=2),
    "v7_place_list": places.place_list,
    "v7_side_list": lambda c: places.side_list(c, 2001),
    "v7_season_list": places.season_list,
    "v9_latest_results": lambda c: places.latest_results(c, "NATION_4"),
    "v9_next_fixtures": places.next_fixtures,
    "e1_contests_per_season": reports.contests_per_season,
    "e6_leading_sides": lambda c: reports.leading_sides(c, top=5),
    "x4_bat_first_by_season": reports.bat_first_by_season,
    "x6_side_records_view": reports.side_records_view,
}.items():
    QUERIES[_name] = lambda spark, sf_dir, op=_op: op(td.contests(spark, sf_dir))


@register("t11_batting_first_advantage")
def _t11(spark, sf_dir):
    return sides.batting_first_advantage(td.contests(spark, sf_dir), periods(spark, sf_dir))


# Actors ----------------------------------------------------------------------

for _name, _op in {
    "p1_batting_leaderboard": actors.batting_leaderboard,
    "p2_milestones": lambda c: actors.milestones(c, fifty=20, hundred=40),
    "p7_place_split": actors.place_split,
    "p8_opposition_split": actors.opposition_split,
    "p10_runs_by_season": lambda c: actors.runs_by_season(c, ["NATION_3_P4", "NATION_1_P0"]),
    "e6_leading_batters": lambda c: reports.leading_batters(c, min_innings=20),
    "x2_leading_scorers": reports.leading_scorers,
}.items():
    QUERIES[_name] = lambda spark, sf_dir, op=_op: op(attack(spark, sf_dir))

for _name, _op in {
    "p3_bowling_leaderboard": actors.bowling_leaderboard,
    "p4_hauls": actors.hauls,
    "e6_leading_bowlers": lambda c: reports.leading_bowlers(c, min_innings=20),
}.items():
    QUERIES[_name] = lambda spark, sf_dir, op=_op: op(defence(spark, sf_dir))


def _as_text(career):
    """Lists as text, so that both engines hash the same value."""
    return career.withColumns(
        {
            "teams": F.array_join("teams", "|"),
            "seasons": F.array_join(F.col("seasons").cast("array<string>"), "|"),
        }
    )


@register("p5_career_summary")
def _p5(spark, sf_dir):
    return _as_text(
        actors.career_summary(
            attack(spark, sf_dir), defence(spark, sf_dir), td.contests(spark, sf_dir, award=True),
            fifty=20, hundred=40,
        )
    )


@register("p6_season_trend")
def _p6(spark, sf_dir):
    return actors.season_trend(attack(spark, sf_dir), defence(spark, sf_dir))


@register("p9_compare_actors")
def _p9(spark, sf_dir):
    return actors.compare_actors(
        ["NATION_3_P4", "NATION_1_P0", "NOBODY", "NATION_7_P2"],
        attack(spark, sf_dir), defence(spark, sf_dir), td.contests(spark, sf_dir, award=True),
    )


@register("p11_active_actors")
def _p11(spark, sf_dir):
    return actors.active_actors(attack(spark, sf_dir), defence(spark, sf_dir), 40)


@register("p12_scorecard")
def _p12(spark, sf_dir):
    return actors.scorecard(
        periods(spark, sf_dir, False), attack(spark, sf_dir, False), defence(spark, sf_dir, False), 12
    )


@register("p13_squad_run_leaders")
def _p13_runs(spark, sf_dir):
    return actors.squad_leaders(attack(spark, sf_dir), defence(spark, sf_dir), 5)[0]


@register("p13_squad_wicket_leaders")
def _p13_wickets(spark, sf_dir):
    return actors.squad_leaders(attack(spark, sf_dir), defence(spark, sf_dir), 5)[1]


# Places and reports ----------------------------------------------------------

for _name, _op in {
    "v4_scoring_trend": places.scoring_trend,
    "v6_score_history": places.score_history,
    "e3_score_histogram": reports.score_histogram,
    "x1_highest_totals": reports.highest_totals,
}.items():
    QUERIES[_name] = lambda spark, sf_dir, op=_op: op(periods(spark, sf_dir))

for _name, _op in {
    "v3_phase_profile": places.phase_profile,
    "e4_phase_rates": reports.phase_rates_by_season,
    "x3_death_economy": lambda e: reports.death_economy(e, min_balls=100),
}.items():
    QUERIES[_name] = lambda spark, sf_dir, op=_op: op(td.events(spark, sf_dir))

for _name, _op in {
    "v1_place_summary": places.place_summary,
    "v5_place_records": places.place_records,
    "e2_place_scoring": lambda c, p: reports.place_scoring(c, p, min_matches=5),
}.items():
    QUERIES[_name] = lambda spark, sf_dir, op=_op: op(
        td.contests(spark, sf_dir), periods(spark, sf_dir)
    )


@register("v8_events_at")
def _v8(spark, sf_dir):
    return places.events_at(td.events(spark, sf_dir), td.contests(spark, sf_dir), "NATION_4")


@register("e5_overview")
def _e5(spark, sf_dir):
    return reports.overview(
        td.contests(spark, sf_dir), periods(spark, sf_dir, False), attack(spark, sf_dir, False),
        defence(spark, sf_dir, False), td.events(spark, sf_dir),
    )


@register("x5_contests_view")
def _x5(spark, sf_dir):
    return reports.contests_view(td.contests(spark, sf_dir, award=True))


# Joined reads ----------------------------------------------------------------

for _name, _op in {
    "s1_load_contests": wh.load_contests,
    "s1_load_contests_season": lambda w: wh.load_contests(
        w, completed_only=True, season=1998,
        columns=["match_id", "team1", "team2", "winner", "is_playoff"],
    ),
    "s2_load_periods": wh.load_periods,
    "s3_load_attack_cards": wh.load_attack_cards,
    "s4_load_defence_cards": wh.load_defence_cards,
    "s5_load_events": wh.load_events,
    "s5_load_events_season": lambda w: wh.load_events(
        w, 1998, w.contests.where("is_playoff").select(F.col("id").alias("match_id"))
    ).select("match_id", "innings_no", "ball_seq", "total_runs", "batter"),
    "s6_load_rosters": wh.load_rosters,
    "s7_load_stands": wh.load_stands,
    "s8_load_dismissals": wh.load_dismissals,
    "s9_table_counts": wh.table_counts,
    "s10_season_range": lambda w: wh.season_range(w.contests),
}.items():
    QUERIES[_name] = lambda spark, sf_dir, op=_op: op(td.warehouse(spark, sf_dir))


# Maintenance -----------------------------------------------------------------


def _id(divisor):
    return F.col("match_id") % divisor


def _upsert(spark, sf_dir):
    stored = td.contests(spark, sf_dir).select("match_id", "match_key", "winner", "result_summary")
    arriving = (_id(3) == 0) | (_id(4) == 0)
    last = stored.where(arriving).withColumn("result_summary", F.upper("result_summary"))
    # Some keys were delivered before with another text; the last delivery counts.
    early = stored.where(arriving & (_id(2) == 0)).withColumn("result_summary", F.lit("early"))
    incoming = last.withColumn("delivery", F.lit(2)).unionByName(early.withColumn("delivery", F.lit(1)))
    return maintain.upsert_contests(stored.where(_id(3) != 0), incoming, order=["delivery"])


@register("k1_upsert_contests")
def _k1(spark, sf_dir):
    return _upsert(spark, sf_dir)[0]


@register("k1_upsert_counts")
def _k1_counts(spark, sf_dir):
    return _upsert(spark, sf_dir)[1]


@register("k2_replace_children")
def _k2(spark, sf_dir):
    totals = periods(spark, sf_dir, False).select("match_id", "innings_no", "runs")
    return maintain.replace_children(
        totals,
        totals.where((_id(2) == 0) & (_id(10) != 0)).withColumn("runs", F.col("runs") + 1000),
        td.headers(spark, sf_dir).where(_id(2) == 0),
    )


def _sides_dimension(spark, sf_dir):
    return td.table(spark, sf_dir, "nation").where(F.col("n_nationkey") < 10).select(
        (F.col("n_nationkey") + 1).cast("long").alias("id"), F.col("n_name").alias("name")
    )


@register("k3_resolve_dimension")
def _k3(spark, sf_dir):
    return _grown(spark, sf_dir).select("name", F.when(~F.col("is_new"), F.col("id")).alias("known_id"))


def _grown(spark, sf_dir):
    old = _sides_dimension(spark, sf_dir)
    head = td.headers(spark, sf_dir)
    names = head.select(F.explode(F.array("venue", "city")).alias("name"))
    known = old.select("name", F.lit(False).alias("known"))
    return maintain.resolve_dimension(names, old).join(known, "name", "left").withColumn(
        "is_new", F.col("known").isNull()
    )


@register("k3_new_keys")
def _k3_new(spark, sf_dir):
    """Keys of the new names: which name gets which is free, but they continue densely."""
    return _grown(spark, sf_dir).where("is_new").select("id")


@register("k3_attach_keys")
def _k3_keys(spark, sf_dir):
    head = td.headers(spark, sf_dir).select("match_id", "venue")
    return maintain.attach_keys(head, _sides_dimension(spark, sf_dir), "venue", "venue_id")


@register("k4_enrich_actors")
def _k4(spark, sf_dir):
    number = F.regexp_extract("name", "_P([0-9]+)$", 1).cast("int")
    dimension = td.warehouse(spark, sf_dir).actors.select(
        "name",
        F.when(number % 2 == 0, F.lit("known")).when(number % 4 == 1, F.lit("")).alias("role"),
    )
    attrs = td.rosters(spark, sf_dir).select(
        F.col("player").alias("name"),
        F.when(_id(3) == 0, F.lit("")).otherwise(F.col("role")).alias("role"),
        "match_id",
    )
    return maintain.enrich_actors(dimension, attrs, ["role"], "match_id")


@register("k5_filter_incremental")
def _k5(spark, sf_dir):
    head = td.headers(spark, sf_dir)
    return maintain.filter_incremental(head, head.where(_id(2) == 0)).select(
        "match_id", "match_key"
    )


def _plan(spark, sf_dir, shift):
    head = td.headers(spark, sf_dir)
    offers = head.select(
        "season", "source", F.when(F.col("source") == "official", 1).otherwise(2).alias("priority")
    )
    if shift:
        requested = head.select((F.col("season") + shift).alias("season"))
    else:
        requested = head.where((F.col("season") <= 2000) & (F.col("season") % 2 == 0)).select("season")
    return maintain.plan_sources(offers, requested)


@register("k6_plan_sources")
def _k6(spark, sf_dir):
    return _plan(spark, sf_dir, 0)[0]


@register("k6_uncovered_seasons")
def _k6_uncovered(spark, sf_dir):
    return _plan(spark, sf_dir, 3)[1]


def dirty_contests(spark, sf_dir):
    """Contests with every header fault planted on some of them."""

    def when(divisor, remainder, value, column):
        return F.when(_id(divisor) == remainder, value).otherwise(F.col(column))

    none = F.lit(None)
    ghost = F.lit("GHOST")
    return td.contests(spark, sf_dir).withColumns(
        {
            "match_key": when(41, 7, none, "match_key"),
            "season": when(43, 8, none, "season"),
            "match_date": when(47, 9, none, "match_date"),
            "team2": F.when(_id(29) == 4, F.col("team1")).otherwise(when(53, 10, none, "team2")),
            "winner": F.when(_id(31) == 5, ghost).otherwise(when(19, 2, none, "winner")),
            "toss_winner": when(17, 3, ghost, "toss_winner"),
            "toss_decision": when(37, 6, F.lit("maybe"), "toss_decision"),
            "win_margin_runs": when(13, 4, F.lit(5), "win_margin_runs"),
            "win_margin_wickets": F.when(_id(59) == 1, 12).otherwise(
                when(13, 4, F.lit(3), "win_margin_wickets")
            ),
        }
    )


def dirty_periods(spark, sf_dir):
    totals = periods(spark, sf_dir, False).withColumns(
        {
            "runs": F.when(_id(61) == 2, 400).when(_id(4) == 1, F.col("runs") + 1).otherwise(
                F.col("runs")
            ),
            "batting_team": F.when(_id(67) == 3, "GHOST").otherwise(F.col("batting_team")),
        }
    )
    return totals.unionByName(totals.where(_id(71) == 4))


@register("k7_drop_placeholders")
def _k7(spark, sf_dir):
    return maintain.drop_placeholders(dirty_contests(spark, sf_dir))[0].select(
        "match_id", "team1", "team2"
    )


@register("k7_skipped")
def _k7_skipped(spark, sf_dir):
    return maintain.drop_placeholders(dirty_contests(spark, sf_dir))[1]


@register("k8_latest_run")
def _k8(spark, sf_dir):
    """A ledger with a running and a finished row per season."""
    seasons = td.headers(spark, sf_dir).groupBy(F.col("season").cast("long").alias("id")).agg(
        F.count("*").alias("matches_seen"),
        F.sum(F.when(F.col("is_completed"), 1).otherwise(0)).alias("matches_inserted"),
        F.max("start_datetime").alias("at"),
    )
    begun = seasons.select(
        "id", F.lit("running").alias("status"), F.lit(None).cast("long").alias("matches_seen"),
        F.lit(None).cast("long").alias("matches_inserted"),
        F.lit(None).cast("timestamp_ntz").alias("finished_at"),
    )
    done = seasons.select(
        "id", F.lit("success").alias("status"), "matches_seen", "matches_inserted",
        F.col("at").alias("finished_at"),
    )
    return maintain.latest_run(begun.unionByName(done)).drop("finished_at")


# Quality ---------------------------------------------------------------------


def _only(*codes):
    return lambda issues: issues.where(F.col("code").isin(*codes)).drop("message")


for _name, _codes in {
    "q1_missing_identity": ("missing_key", "missing_season"),
    "q2_missing_date": ("missing_date",),
    "q3_missing_sides": ("missing_teams", "same_team"),
    "q4_toss": ("toss_winner_not_playing", "bad_toss_decision"),
    "q5_completed_no_result": ("completed_no_result",),
    "q6_winner_not_playing": ("winner_not_playing",),
    "q7_margins": ("double_margin", "implausible_margin"),
}.items():
    QUERIES[_name] = lambda spark, sf_dir, pick=_only(*_codes): pick(
        quality.contest_issues(dirty_contests(spark, sf_dir))
    )

for _name, _codes in {
    "q9_implausible_score": ("implausible_score",),
    "q10_implausible_wickets": ("implausible_wickets",),
    "q11_overs_exceed_limit": ("overs_exceed_limit",),
    "q12_innings_team_mismatch": ("innings_team_mismatch",),
}.items():
    QUERIES[_name] = lambda spark, sf_dir, pick=_only(*_codes): pick(
        quality.period_issues(dirty_contests(spark, sf_dir), dirty_periods(spark, sf_dir))
    )


@register("q8_duplicate_innings")
def _q8(spark, sf_dir):
    return quality.duplicate_periods(
        dirty_contests(spark, sf_dir), dirty_periods(spark, sf_dir)
    ).drop("message")


@register("q13_event_mismatch")
def _q13(spark, sf_dir):
    return quality.event_mismatch(
        dirty_contests(spark, sf_dir), dirty_periods(spark, sf_dir), td.events(spark, sf_dir)
    ).drop("message")


def _with_copies(frame, divisor, remainder):
    return frame.unionByName(frame.where(_id(divisor) == remainder))


@register("q14_duplicate_children")
def _q14(spark, sf_dir):
    return quality.duplicate_children(
        dirty_contests(spark, sf_dir),
        _with_copies(attack(spark, sf_dir, False), 73, 5),
        _with_copies(defence(spark, sf_dir, False), 79, 6),
        _with_copies(td.events(spark, sf_dir), 83, 7),
    ).drop("message")


@register("q15_dedupe")
def _q15(spark, sf_dir):
    lines = td.table(spark, sf_dir, "lineitem")
    order = [
        "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus",
    ]
    return quality.dedupe(lines, ["l_orderkey", "l_linenumber"], order).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )


@register("q15_dedupe_children")
def _q15_children(spark, sf_dir):
    """Every child table with the rows of each third contest delivered twice."""
    stream = history.shared(td.events(spark, sf_dir))
    children = {
        "periods": derive.period_totals(stream), "attack_cards": derive.attack_cards(stream),
        "defence_cards": derive.defence_cards(stream), "dismissals": derive.dismissals(stream),
        "stands": derive.stands(stream), "events": stream, "rosters": td.rosters(spark, sf_dir, stream),
    }
    out = None
    for name, keys in schemas.CHILD_KEYS.items():
        # The counts before and after read the rows and their copies.
        made = children[name] if children[name] is stream else history.shared(children[name])
        first = made.withColumn("ingest", F.lit(0))
        both = first.unionByName(first.where(_id(3) == 0).withColumn("ingest", F.lit(1)))
        before = both.agg(F.count("*").alias("rows_before"))
        after = quality.dedupe(both, keys, ["ingest"]).agg(
            F.count("*").alias("rows_after"), F.sum("ingest").alias("copies_kept")
        )
        rows = before.select(F.lit(name).alias("table_name"), "rows_before", F.lit(1).alias("one")).join(
            after.withColumn("one", F.lit(1)), "one"
        ).drop("one")
        out = rows if out is None else out.unionByName(rows)
    return out


def _checked(spark, sf_dir):
    return quality.checked(
        dirty_contests(spark, sf_dir), dirty_periods(spark, sf_dir), events=td.events(spark, sf_dir)
    )


@register("q16_issue_counts")
def _q16(spark, sf_dir):
    return quality.issue_counts(quality.issues_of(_checked(spark, sf_dir)))


@register("q16_issue_summary")
def _q16_summary(spark, sf_dir):
    return quality.issue_summary(_checked(spark, sf_dir))


@register("q17_accepted")
def _q17(spark, sf_dir):
    return quality.split_rejected(_checked(spark, sf_dir))[0].select("match_id", "match_key")


@register("q17_rejected")
def _q17_rejected(spark, sf_dir):
    return quality.split_rejected(_checked(spark, sf_dir))[1].select("match_id", "match_key")


# Standings -------------------------------------------------------------------

for _name, _op in {
    "r1_standings": standings.standings,
    "r3_remaining_fixtures": lambda c: standings.remaining_fixtures(c).select(
        "match_id", "season", "team1", "team2", "venue"
    ),
    "r6_remaining_per_side": lambda c: standings.remaining_per_side(c, standings.standings(c)),
}.items():
    QUERIES[_name] = lambda spark, sf_dir, op=_op: op(td.contests(spark, sf_dir))


@register("r2_net_run_rate")
def _r2(spark, sf_dir):
    league = td.contests(spark, sf_dir)
    return standings.with_net_run_rate(
        standings.standings(league), periods(spark, sf_dir, False), league, digits=None
    )


@register("r7_forced_standings")
def _r7(spark, sf_dir):
    """The table as it would stand if the first side won every second open fixture."""
    league = td.contests(spark, sf_dir)
    forced = standings.remaining_fixtures(league).where(_id(2) == 0).select(
        "match_id", F.col("team1").alias("winner")
    )
    return standings.standings(standings.with_forced_results(league, forced))


# History ---------------------------------------------------------------------


def base(spark, sf_dir):
    return history.contest_base(td.contests(spark, sf_dir), td.innings_scores(spark, sf_dir))


def card_tables(spark, sf_dir):
    """Cards and rosters of one event stream, which is kept because all three and
    the state before every contest read them."""
    stream = history.shared(td.events(spark, sf_dir))
    return (
        derive.attack_cards(stream), derive.defence_cards(stream),
        td.rosters(spark, sf_dir, stream, with_gaps=True),
    )


def full_features(spark, sf_dir, include_incomplete=False):
    return history.contest_features(
        td.contests(spark, sf_dir), td.innings_scores(spark, sf_dir), *card_tables(spark, sf_dir),
        include_incomplete,
    )


for _name, _columns in {
    "f1_career_win_rate": ["career_win_rate"],
    "f2_form": ["form_short", "form_long"],
    "f3_run_averages": ["avg_runs_scored", "avg_runs_conceded"],
    "f4_win_streak": ["win_streak"],
    "f6_side_rate_at_place": ["venue_win_rate"],
    "f11_rest_days": ["rest_days"],
    "f12_season_points": ["season_points", "season_matches"],
}.items():

    def _side_feature(spark, sf_dir, columns=_columns):
        rows = base(spark, sf_dir)
        state = history.side_state(history.side_rows(rows))
        done = rows.where("done").select("match_id")
        return state.join(done, "match_id", "left_semi").select("match_id", "team", *columns)

    QUERIES[_name] = _side_feature

for _name, _columns in {
    "f5_head_to_head_rate": ["team1_h2h_win_rate", "h2h_matches"],
    "f7_place_levels": ["venue_avg_first_innings", "venue_chase_win_rate"],
    "f9_league_recent_level": ["league_recent_avg_score"],
    "f10_place_recent_level": ["venue_recent_avg_score"],
}.items():
    QUERIES[_name] = lambda spark, sf_dir, columns=_columns: history.place_and_pair_state(
        history.shared(base(spark, sf_dir))
    ).select("match_id", *columns)


@register("f8_side_score_at_place")
def _f8(spark, sf_dir):
    return history.contest_features(
        td.contests(spark, sf_dir), td.innings_scores(spark, sf_dir), include_incomplete=True
    ).select("match_id", "team1_venue_avg_score", "team2_venue_avg_score")


@register("f13_career_before")
def _f13(spark, sf_dir):
    return history.career_before(
        base(spark, sf_dir), attack(spark, sf_dir, False), defence(spark, sf_dir, False)
    )


def _six_digits(df):
    """Squad means are sums of doubles; both engines show six digits of them."""
    tied = [c for c in df.columns if "xi_" in c and "experience" not in c and "has" not in c]
    return df.withColumns({c: F.round(c, 6) for c in tied})


@register("f14_squad_strength")
def _f14(spark, sf_dir):
    rows = history.shared(base(spark, sf_dir))
    cards, spells, lineups = card_tables(spark, sf_dir)
    state = history.shared(history.side_state(history.side_rows(rows, lineups)))
    return _six_digits(history.squad_strength(rows, state, cards, spells, lineups))


@register("f15_contest_features")
def _f15(spark, sf_dir):
    return _six_digits(full_features(spark, sf_dir, True)).drop(
        "winner", "first_batting_team", "target_team1_wins", "first_innings_runs",
        "second_innings_runs",
    )


@register("f16_targets")
def _f16(spark, sf_dir):
    return history.contest_features(
        td.contests(spark, sf_dir), td.innings_scores(spark, sf_dir), include_incomplete=True
    ).select(
        "match_id", "winner", "first_batting_team", "target_team1_wins", "first_innings_runs",
        "second_innings_runs",
    )


@register("f17_score_features")
def _f17(spark, sf_dir):
    return _six_digits(history.score_features(full_features(spark, sf_dir)))


@register("f18_mirror")
def _f18(spark, sf_dir):
    plain = history.contest_features(td.contests(spark, sf_dir), td.innings_scores(spark, sf_dir))
    return history.mirror(plain).select(
        "match_id", "team1", "team2", "team1_career_win_rate", "team2_rest_days", "form_short_diff",
        "rest_days_diff", "team1_is_home", "toss_winner_is_team1", "team1_h2h_win_rate",
        "target_team1_wins", "is_mirrored",
    )


def requests(spark, sf_dir):
    """Hypothetical return fixtures: every contest with the sides swapped."""
    return td.headers(spark, sf_dir).select(
        F.col("match_id").alias("request_id"), F.col("team2").alias("team1"),
        F.col("team1").alias("team2"), "venue", "season",
        F.date_add("match_date", 3).alias("match_date"), "toss_winner", "toss_decision",
        "is_playoff", "is_neutral_venue",
    )


@register("f19_featurise_requests")
def _f19(spark, sf_dir):
    return _six_digits(
        history.featurise_requests(
            requests(spark, sf_dir), td.contests(spark, sf_dir), td.innings_scores(spark, sf_dir),
            *card_tables(spark, sf_dir),
        )
    )


@register("f20_drivers")
def _f20(spark, sf_dir):
    return history.drivers(
        history.contest_features(td.contests(spark, sf_dir), td.innings_scores(spark, sf_dir)),
        digits=None,
    )


# In play and award -----------------------------------------------------------


def chases(spark, sf_dir, stride=1):
    return inplay.chase_features(
        td.events(spark, sf_dir), td.contests(spark, sf_dir), stride, digits=None
    )


@register("c1_chase_features")
def _c1(spark, sf_dir):
    return chases(spark, sf_dir)


def live_states(spark, sf_dir):
    """Every ball of every chase as a state somebody could ask about."""
    return chases(spark, sf_dir).select(
        "match_id", "ball_seq", "batting_team", "bowling_team", "venue", "target", "current_runs",
        "wickets_fallen", "balls_bowled", "runs_last_5_overs", "wickets_last_5_overs",
    )


@register("c2_chase_rows")
def _c2(spark, sf_dir):
    return inplay.chase_rows(live_states(spark, sf_dir), digits=None)


def awards(spark, sf_dir):
    stream = history.shared(td.events(spark, sf_dir))
    return inplay.award_features(
        derive.attack_cards(stream), derive.defence_cards(stream), td.contests(spark, sf_dir, award=True)
    )


@register("c3_award_features")
def _c3(spark, sf_dir):
    rows = awards(spark, sf_dir)
    return rows.select(*[c for c in rows.columns if not c.endswith(("_rank", "_share"))])


@register("c4_within_contest")
def _c4(spark, sf_dir):
    rows = awards(spark, sf_dir)
    return rows.select(
        "match_id", "player", "team",
        *[c for c in rows.columns if c.endswith("_rank")],
        *[F.round(c, 6).alias(c) for c in rows.columns if c.endswith("_share")],
    )


@register("c5_terminal_overrides")
def _c5(spark, sf_dir):
    totals = periods(spark, sf_dir, False)
    first = totals.where("innings_no = 1").select("match_id", (F.col("runs") + 1).alias("target"))
    second = totals.where("innings_no = 2").select(
        "match_id", F.col("runs").alias("current_runs"), F.col("wickets").alias("wickets_fallen"),
        F.col("balls").alias("balls_bowled"), F.lit(0.5).alias("probability"),
    )
    return inplay.terminal_overrides(second.join(first, "match_id"))


@register("c6_sensitivity_rows")
def _c6(spark, sf_dir):
    return inplay.sensitivity_rows(live_states(spark, sf_dir), digits=None).select(
        "match_id", "ball_seq", "current_runs", "target", "balls_remaining", "runs_required",
        "current_run_rate", "required_run_rate", "run_rate_pressure", "chase_progress",
        "is_powerplay", "is_death",
    )
