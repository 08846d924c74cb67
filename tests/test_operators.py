"""Invariants of the operators on small literal tables."""

import pytest
from pyspark.sql import functions as F

from scorebook.functions import text as t
from scorebook.operators import actors, derive, history, inplay, maintain, quality, sides, standings
from scorebook.plans import evaluate
from scorebook.sources import feeds, warehouse


def _one(df):
    return df.first().asDict()


def test_summary_adds_up(contests):
    for row in sides.team_summary(contests).collect():
        assert row.wins + row.losses == row.matches
        assert row.win_pct == pytest.approx(row.wins / row.matches * 100)
    assert sides.long_form(contests).count() == 2 * contests.count()
    titles = {r.team: r.titles for r in sides.team_summary(contests).collect()}
    assert titles == {"A": 0, "B": 1, "C": 0}


def test_min_matches_filters(contests):
    assert sides.team_summary(contests, min_matches=99).count() == 0


def test_head_to_head_is_symmetric(contests):
    ab = _one(sides.head_to_head(contests, "A", "B"))
    ba = _one(sides.head_to_head(contests, "B", "A"))
    assert ab["matches"] == ba["matches"] == 3
    assert (ab["a_wins"], ab["b_wins"]) == (ba["b_wins"], ba["a_wins"]) == (2, 1)
    assert ab["streak_team"] == ba["streak_team"] == "A" and ab["streak"] == ba["streak"] == 1
    assert ab["last_result"] == "A won by 16 runs"
    assert sides.head_to_head(contests, "A", "Nobody").count() == 0


def test_toss_impact_has_one_shape(contests):
    assert sides.toss_impact(contests).columns == sides.toss_impact(contests, "season").columns
    assert _one(sides.toss_impact(contests))["matches"] == 7


def test_timeline_window_of_one_is_the_result(contests):
    for row in sides.form_timeline(contests, window=1).collect():
        assert row.rolling_win_pct == row.won * 100


def test_average_uses_dismissals_and_is_null_when_never_out(spark):
    cards = spark.createDataFrame(
        [(1, "x", 30, 20, 1, 1, True), (2, "x", 50, 30, 2, 1, True), (1, "y", 10, 0, 0, 0, False)],
        "match_id long, player string, runs long, balls long, fours long, sixes long, is_out boolean",
    )
    rows = {r.player: r for r in actors.batting_leaderboard(cards).collect()}
    assert rows["x"].average == 40.0 and rows["x"].fifties == 1
    assert rows["y"].average is None and rows["y"].strike_rate is None


def test_cards_and_stands_agree_with_totals(events):
    totals = {(r.match_id, r.innings_no): r for r in derive.period_totals(events).collect()}
    runs = derive.attack_cards(events).groupBy("match_id", "innings_no").agg(F.sum("runs").alias("r"))
    for row in runs.collect():
        assert row.r == totals[row.match_id, row.innings_no].runs
    stands = derive.stands(events).groupBy("match_id", "innings_no").agg(F.sum("runs").alias("r"))
    for row in stands.collect():
        assert row.r == totals[row.match_id, row.innings_no].runs
    assert all(r.wickets == 5 and r.balls == 120 and r.overs == 20.0 for r in totals.values())


@pytest.mark.parametrize("name", ["attack_cards", "dismissals", "stands"])
def test_splitting_an_innings_changes_nothing(name, events):
    operator = getattr(derive, name)
    some = events.where("match_id <= 2")
    whole = operator(some)
    split = operator(some, split_rows=16).select(*whole.columns)
    assert sorted(map(str, whole.collect())) == sorted(map(str, split.collect()))


def test_standings_leave_playoffs_out(contests):
    table = standings.standings(contests, 2023)
    assert table.agg(F.sum("played")).first()[0] == 6
    first = {r.team: (r.points, r.position) for r in table.collect()}
    assert first["A"] == (4, 1) and first["C"] == (2, 2) and first["B"] == (0, 3)


def test_net_run_rate_charges_the_quota_when_all_out(spark, contests):
    rows = [(1, 1, "A", "B", 100, 10, 60), (1, 2, "B", "A", 90, 3, 120)]
    periods = spark.createDataFrame(
        rows, "match_id long, innings_no int, batting_team string, bowling_team string, runs long, "
        "wickets long, balls long",
    ).withColumn("season", F.lit(2023))
    table = standings.with_net_run_rate(standings.standings(contests, 2023), periods, contests, 2023)
    rate = {r.team: r.net_run_rate for r in table.collect()}
    assert rate["A"] == pytest.approx(100 / 20 - 90 / 20) and rate["C"] is None


def test_features_see_only_the_past(contests, spark):
    full = history.contest_features(contests)
    assert _one(full.where("match_id = 1"))["team1_career_win_rate"] == 0.5
    assert _one(full.where("match_id = 1"))["venue_avg_first_innings"] == 165.0
    for row in full.collect():
        earlier = sum(
            1 for r in contests.collect()
            if {r.team1, r.team2} == {row.team1, row.team2} and r.match_id < row.match_id
        )
        assert row.h2h_matches == earlier
    # Removing the future does not change the past.
    cut = history.contest_features(contests.where("match_id <= 4"))
    kept = full.where("match_id <= 4").select(*cut.columns)
    assert sorted(map(str, kept.collect())) == sorted(map(str, cut.collect()))


def test_mirror_twice_is_the_original(contests):
    full = history.contest_features(contests)
    back = history.mirror(history.mirror(full).drop("is_mirrored")).drop("is_mirrored")
    names = ["match_id", "team1", "team2", "form_short_diff", "team1_win_streak", "target_team1_wins"]
    assert sorted(map(str, full.select(*names).collect())) == sorted(
        map(str, back.select(*names).collect())
    )
    assert history.mirror(full).agg(F.sum("team1_is_home")).first()[0] == 0


def test_requests_use_the_final_state(contests, spark):
    asked = spark.createDataFrame(
        [(1, "A", "B", "Ground 0", 2024), (2, "A", "B", "Ground 0", 2024), (3, "A", "New", "X", 2024)],
        "request_id long, team1 string, team2 string, venue string, season int",
    )
    rows = {r.request_id: r for r in history.featurise_requests(asked, contests).collect()}
    assert len(rows) == 3
    assert rows[1].h2h_matches == rows[2].h2h_matches == 3.0
    assert rows[1].team1_career_win_rate == pytest.approx((3 + 2.5) / (5 + 5))
    assert rows[3].team2_career_win_rate == 0.5 and rows[1].team1_rest_days == 30.0


def test_chase_stops_when_decided(events, contests):
    rows = inplay.chase_features(events, contests)
    assert rows.where("current_runs >= target or wickets_fallen >= 10").count() == 0
    assert rows.where("balls_remaining < 0 or required_run_rate > 99").count() == 0
    thin = inplay.chase_features(events, contests, stride=10)
    assert 0 < thin.count() < rows.count()
    # The first ball is never counted in the recent window.
    first = rows.where("ball_seq = 1").first()
    assert first.runs_last_5_overs == 0


def test_chase_terminal_states(spark):
    rows = spark.createDataFrame(
        [(100, 100, 3, 50, 0.4), (100, 90, 10, 50, 0.4), (100, 90, 3, 120, 0.4), (100, 90, 3, 50, 0.4)],
        "target long, current_runs long, wickets_fallen long, balls_bowled long, probability double",
    )
    assert [r.probability for r in inplay.terminal_overrides(rows).collect()] == [1.0, 0.0, 0.0, 0.4]


def test_validation_flags_a_winner_that_did_not_play(contests):
    broken = contests.withColumn(
        "winner", F.when(F.col("match_id") == 2, F.lit("Z")).otherwise(F.col("winner"))
    )
    assert [r.code for r in quality.contest_issues(broken).collect()] == ["winner_not_playing"]
    good, bad = quality.split_rejected(quality.checked(broken))
    assert good.columns == broken.columns
    assert good.count() == 6 and bad.first().match_id == 2


def test_a_contest_without_a_key_is_rejected_and_counted(contests):
    keyless = contests.withColumn("match_key", F.when(F.col("match_id") <= 2, None).otherwise(F.col("match_key")))
    found = quality.checked(keyless)
    good, bad = quality.split_rejected(found)
    assert good.count() == 5 and sorted(r.match_id for r in bad.collect()) == [1, 2]
    assert tuple(quality.issue_summary(found).first()) == (7, 2, 2, 0)


def test_all_rules_of_a_contest_in_one_row(spark, contests, events):
    """Copies of an innings, a wrong total and repeated child rows; the parts agree with the separate checks."""
    periods = spark.createDataFrame(
        [(1, 1, 280, 4, 20.0, "A"), (1, 1, 280, 4, 20.0, "A"), (1, 1, 281, 4, 20.0, "A"), (2, 1, 400, 11, 25.0, "Z"),
         (3, None, None, None, None, None), (99, 1, 5, 5, 1.0, "A")],
        "match_id long, innings_no int, runs int, wickets int, overs double, batting_team string")
    cards = spark.createDataFrame([(4, 1, "x"), (4, 1, "x"), (4, 1, "x"), (5, 1, "y")], "match_id long, innings_no int, player string")
    twice = events.unionByName(events.where("match_id = 6 AND innings_no = 1 AND ball_seq = 7"))
    found = quality.validate(contests, periods, cards, cards, twice)
    apart = [
        quality.contest_issues(contests), quality.period_issues(contests, periods),
        quality.duplicate_periods(contests, periods), quality.event_mismatch(contests, periods, twice),
        quality.duplicate_children(contests, cards, cards, twice),
    ]
    assert sorted(map(tuple, found.collect())) == sorted(tuple(r) for part in apart for r in part.collect())
    assert found.count() >= 10


def test_dedupe_keeps_the_first(spark):
    rows = spark.createDataFrame([(1, "a", 2, None), (1, "a", 1, "x"), (2, "b", 5, "y")],
                                 "match_id long, player string, at int, note string")
    kept = quality.dedupe(rows, ["match_id", "player"], ["at"])
    assert sorted(map(tuple, kept.collect())) == [(1, "a", 1, "x"), (2, "b", 5, "y")]


def test_reload_is_idempotent(contests):
    table, counts = maintain.upsert_contests(contests, contests.where("match_id <= 3"))
    assert table.count() == contests.count()
    assert tuple(counts.first()) == (0, 3)
    assert maintain.filter_incremental(contests, contests).count() == 0


def test_auc_of_perfect_and_tied_scores(spark):
    perfect = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "label int, probability double")
    assert evaluate.classification_metrics(perfect).first().roc_auc == 1.0
    tied = perfect.withColumn("probability", F.lit(0.5))
    assert evaluate.classification_metrics(tied).first().roc_auc == 0.5
    single = perfect.where("label = 1")
    row = evaluate.classification_metrics(single).first()
    assert row.roc_auc is None and row.log_loss is None


SPEC = t.Spec(
    side_aliases={"alpha town": "Alpha", "beta": "Beta"}, side_codes={"Alpha": "ALP"},
    place_aliases={"big field": "Big Field"}, place_cities={"Big Field": "Capital"},
)


def _value(spark, value, function):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "value, expected",
    [("  Alpha   Town. ", "Alpha"), ("Beta, North", "Beta"), ("TBD", None), ("42", None), ("Gamma", "Gamma"),
     ("", None), (None, None)],
)
def test_canonical_side(spark, value, expected):
    assert _value(spark, value, lambda c: t.canonical_side(c, SPEC)) == expected


@pytest.mark.parametrize(
    "value, expected",
    [("Big Field", ("Big Field", "Capital")), ("Big Field, Stand, Capital City", ("Big Field", "Capital")),
     ("Old Park, Village", ("Old Park", "Village")), ("Old Park", ("Old Park", None))],
)
def test_canonical_place(spark, value, expected):
    got = _value(spark, value, lambda c: t.canonical_place(c, F.lit(None), SPEC))
    assert tuple(got) == expected


@pytest.mark.parametrize(
    "value, expected",
    [("A  Person (c)", "A Person"), ("A Person (c/wk)", "A Person"), ("A Person (ALP)", "A Person"),
     ("A Person (Other)", "A Person (Other)"), ("A Person ( WK )", "A Person"), ("A Person (sub)", "A Person"),
     ("A (B) Person", "A (B) Person"), (None, None), ("", None)],
)
def test_canonical_actor(spark, value, expected):
    assert _value(spark, value, lambda c: t.canonical_actor(c, SPEC)) == expected


@pytest.mark.parametrize(
    "value, kind, out, bowler, fielder",
    [("c F One b B Two", "caught", True, "B Two", "F One"), ("b B Two", "bowled", True, "B Two", None),
     ("run out (F One/K)", "run out", True, None, "F One"), ("not out", "not out", False, None, None),
     ("st K b B Two", "stumped", True, "B Two", "K"), ("lbw b B Two", "lbw", True, "B Two", None),
     ("retired hurt", "retired hurt", False, None, None), ("", None, False, None, None),
     ("c and b B Two", "caught and bowled", True, "B Two", None), ("C F One B B Two", "caught", True, "B Two", "F One"),
     ("hit wicket b B Two", "hit wicket", True, "B Two", None)],
)
def test_dismissals_text(spark, value, kind, out, bowler, fielder):
    got = _value(spark, value, lambda c: t.parse_dismissal(c, SPEC))
    assert (got.dismissal_kind, got.is_out, got.bowler, got.fielder) == (kind, out, bowler, fielder)


@pytest.mark.parametrize(
    "value, winner, kind",
    [("Beta Won by 6 Runs (Winners)", "Beta", "runs"), ("Alpha Town won by 4 wickets", "Alpha", "wickets"),
     ("Match Tied (Beta Won the One Over Eliminator)", "Beta", "tie"),
     ("Match Abandoned without a ball bowled", None, "no result"), ("Beta WON BY 6 runs", "Beta", "runs"),
     ("Match tied", None, "tie"), ("something else", None, None), (None, None, None)],
)
def test_result_text(spark, value, winner, kind):
    got = _value(spark, value, lambda c: t.parse_result(c, SPEC))
    assert (got.winner, got.result_type) == (winner, kind)


@pytest.mark.parametrize(
    "value, expected",
    [("190/9 (20.0 Ov)", (190, 9, 20.0, 120)), ("Total 7 / 0 ( 1.4 OV", (7, 0, 1.4, 10)), ("190/9", (None,) * 4),
     ("190 (20 Ov)", (None,) * 4), ("", (None,) * 4), (None, (None,) * 4)],
)
def test_innings_summary(spark, value, expected):
    assert tuple(_value(spark, value, t.parse_innings_summary)) == expected


def test_a_key_delivered_twice_keeps_the_last_delivery(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 1)], "match_key string, score long")
    incoming = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "match_key string, score long, at long")
    table, counts = maintain.upsert_contests(stored, incoming, order=["at"])
    assert sorted(map(tuple, table.collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert tuple(counts.first()) == (1, 1)


def test_a_replayed_batch_leaves_the_table_whole(spark, tmp_path):
    root = str(tmp_path / "table")
    maintain.commit_version(spark.range(300_000).withColumn("origin", F.lit("stored")), root, -1, None)
    for _ in range(3):  # batch 0 is run again after a failure
        target = maintain.read_current(spark, root, below=0)
        maintain.commit_version(target.withColumn("origin", F.lit("batch 0")), root, 0, None)
    current = maintain.read_current(spark, root)
    assert current.count() == 300_000 and current.select("origin").distinct().count() == 1
    assert maintain.published(spark, root).count() == 2
    assert maintain.read_current(spark, root, below=0).where("origin = 'stored'").count() == 300_000


def test_overs_round_trip(spark):
    rows = spark.range(121).select(
        F.col("id"), t.overs_to_balls(t.balls_to_overs(F.col("id").cast("string"))).alias("back")
    )
    assert rows.where("id <> back").count() == 0


def test_jsonp_quarantine(spark):
    rows = spark.createDataFrame([('cb({"a": 1});',), ('{"a": 2}',), ("",), ("cb({)",), ("cb([1])",)], "payload string")
    good, bad = feeds.unwrap_jsonp(rows)
    assert good.count() == 2
    assert {r.reason for r in bad.collect()} == {"empty payload", "malformed JSON", "not an object"}


def test_warehouse_round_trip(spark, tmp_path):
    root = str(tmp_path)
    warehouse.create_tables(spark, root)
    wh = warehouse.Warehouse.at(spark, root)
    assert warehouse.load_contests(wh).count() == 0
    assert warehouse.load_events(wh, match_ids=[]).count() == 0
    slim = maintain.export_slim({n: f for n, f in wh.tables().items()}, root + "/slim")
    assert "events" not in slim and "contests" in slim


def test_versions_are_published_last(spark, contests, tmp_path):
    root = str(tmp_path / "contests")
    maintain.commit_version(contests, root, 1)
    maintain.commit_version(contests.where("match_id <= 2"), root, 2)
    assert maintain.read_current(spark, root).count() == 2


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    maintain.start_run(spark, path, 1, "manual", "official", "2023")
    maintain.finish_run(spark, path, 1, "success", matches_seen=7)
    maintain.start_run(spark, path, 2, "manual", "official", "2024")
    runs = spark.read.parquet(path)
    latest = _one(maintain.latest_run(runs))
    assert latest["id"] == 2 and latest["status"] == "running"
    first = _one(maintain.latest_state(runs).where("id = 1"))
    assert first["status"] == "success" and first["matches_seen"] == 7 and first["duration_seconds"] >= 0


def test_documents_on_disk(spark, tmp_path):
    good = (
        '{"info": {"dates": ["2023-04-01"], "teams": ["Alpha Town", "Beta"], "players": {"Beta": ["P One (c)"]},'
        ' "registry": {"people": {"P One (c)": "id1"}}, "outcome": {"winner": "Beta", "by": {"runs": 5}}},'
        ' "innings": [{"team": "Beta", "overs": [{"over": 0, "deliveries": [{"batter": "x", "bowler": "y",'
        ' "non_striker": "z", "runs": {"batter": 4, "extras": 0, "total": 4}}]}]}]}'
    )
    (tmp_path / "100.json").write_text(good)
    (tmp_path / "101.json").write_text("{broken")
    (tmp_path / "102.json").write_text('{"info": {"teams": ["A", "B"]}}')
    docs = feeds.read_documents(spark, str(tmp_path))
    header = _one(feeds.document_contests(docs, SPEC))
    assert docs.count() == 1 and header["winner"] == "Beta" and header["team1"] == "Alpha"
    roster = _one(feeds.read_document_rosters(docs, SPEC))
    assert (roster["player"], roster["source_player_id"]) == ("P One", "id1")
    ball = _one(feeds.document_events(docs, SPEC))
    assert ball["is_four"] and ball["over_no"] == 1 and ball["bowling_team"] == "Alpha"


def test_tally_counts_what_a_write_writes(spark, tmp_path):
    from scorebook.functions.timeline import shared
    from scorebook.operators.maintain import Tally

    tally = Tally()
    rows = spark.range(1000).withColumn("part", (F.col("id") % 3).cast("int"))
    shared(tally.on("kept", rows, even=F.col("id") % 2 == 0, unknown=F.lit(None).cast("int") == 1))
    assert [tally.count("kept", k) for k in ("rows", "even", "unknown")] == [1000, 500, 0]
    tally.on("written", rows.hint("rebalance", "part"), low=F.col("id") < 10).write.partitionBy("part").parquet(
        f"{tmp_path}/written")
    assert (tally.count("written"), tally.count("written", "low")) == (1000, 10)
    shared(tally.on("empty", rows.where("id < 0"), even=F.col("id") % 2 == 0))
    assert (tally.count("empty"), tally.count("empty", "even"), tally.count("never")) == (0, 0, 0)


def test_mark_changes_tells_stored_contests_from_new_ones(spark):
    from scorebook.operators.maintain import mark_changes, upsert_contests

    stored = spark.createDataFrame([("a", 1), ("b", 2)], "match_key string, id long")
    incoming = spark.createDataFrame([("b", 2), ("c", 3), (None, 4)], "match_key string, id long")
    table, _ = upsert_contests(*mark_changes(stored, incoming, "change"), order=["id"])
    # A key that is null equals no stored one.
    assert {(r.match_key, r.change) for r in table.collect()} == {
        ("a", None), ("b", "updated"), ("c", "inserted"), (None, "inserted")}


def test_dedupe_by_all_other_columns(spark):
    rows = spark.createDataFrame(
        [(1, "a", 2, None), (1, "a", 1, "y"), (1, "a", 1, "x"), (1, "b", None, "z"), (1, "b", 0, "z"), (None, "a", 5, "q")] * 2,
        "match_id long, player string, at int, note string",
    )
    kept = quality.dedupe(rows, ["match_id", "player"], ["at", "note"])
    assert kept.columns == rows.columns
    assert {tuple(r) for r in kept.collect()} == {(1, "a", 1, "x"), (1, "b", None, "z"), (None, "a", 5, "q")}
    assert kept.count() == 3
    assert "min_by" not in kept._jdf.queryExecution().toString()


def test_documents_are_made_once(spark):
    from scorebook import schemas
    from scorebook.functions.text import Spec
    from scorebook.plans import load
    from scorebook.sources import feeds

    docs = spark.createDataFrame([], "source_match_id string, doc struct<" + schemas.DOCUMENT.replace("\n", " ") + ">")
    delivery = load.deliver_documents(feeds.typed_documents(docs.select("source_match_id", "doc.*")), Spec())
    for frame in (delivery.contests, delivery.children["events"], delivery.children["rosters"]):
        assert [f for f in frame.inputFiles() if "/shared-" in f]


def test_children_with_copies_are_made_once(spark, sf_dir):
    import __spark_entry__ as entry

    table = entry.queries()["q15_dedupe_children"](spark, sf_dir)
    folders = {part for f in table.inputFiles() for part in f.split("/") if part.startswith("shared-")}
    assert len(folders) == 7


def test_names_of_a_load_read_every_table_once(spark, tmp_path):
    from scorebook.plans import load

    spark.createDataFrame(
        [(1, "A", "p1", "p2"), (2, "B", "p2", None), (3, None, "A", "")], "match_id long, team string, player string, bowler string"
    ).write.parquet(f"{tmp_path}/cards")
    cards = spark.read.parquet(f"{tmp_path}/cards")
    contests = spark.createDataFrame([("A", "C", None)], "team1 string, team2 string, player_of_match string")
    found = load._names([
        (cards, {"side": ["team", "absent"], "actor": ["player", "bowler"]}),
        (contests, {"side": ["team1", "team2"], "actor": ["player_of_match"]}),
    ])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 1
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {
        ("side", "A"), ("side", "B"), ("side", "C"), ("side", None),
        ("actor", "p1"), ("actor", "p2"), ("actor", "A"), ("actor", ""), ("actor", None)}
