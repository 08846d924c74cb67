"""Checks before a load: issues per contest, duplicates, and the accepted split.

Every row-level check of one table is evaluated in one pass. :func:`checked` evaluates
all of them over one frame, a contest with the summed and counted rows of its children,
so contests, periods and events are each read once, and whether a contest is accepted
is a filter on its own row, with or without a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook import constants as k
from scorebook.functions.rates import count_where

ERROR, WARNING = "error", "warning"
ISSUE = ["match_key", "severity", "code", "message"]


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def _text(column: str) -> Column:
    return _shown(F.col(column))


def _filled(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


Rule = tuple[str, str, Column, Column]
ISSUES = "array<struct<severity:string,code:string,message:string>>"


def _issue(severity: str, code: str, message: Column) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.cast("string").alias("message")
    )


def _broken(rules: Sequence[Rule]) -> Column:
    """The issues of the (severity, code, condition, message) rules that a row breaks."""
    return F.array_compact(
        F.array(*[F.when(condition, _issue(severity, code, message)) for severity, code, condition, message in rules])
    )


def _explode_issues(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return df.select("match_key", F.explode(_broken(rules)).alias("issue")).select("match_key", "issue.*")


def _contest_rules() -> list[Rule]:
    team1, team2 = F.col("team1"), F.col("team2")
    has1, has2 = _filled("team1"), _filled("team2")
    any_side = has1 | has2

    def playing(column: str) -> Column:
        return F.coalesce(F.col(column) == team1, F.lit(False)) | F.coalesce(
            F.col(column) == team2, F.lit(False)
        )

    wickets = F.col("win_margin_wickets")
    no_outcome = ~(
        _filled("winner") | F.coalesce("is_tie", F.lit(False))
        | F.coalesce("is_no_result", F.lit(False))
    )
    return [
        (ERROR, "missing_key", ~_filled("match_key") | F.col("match_key").isNull(),
         F.lit("no match_key")),
        (ERROR, "missing_season", F.coalesce("season", F.lit(0)) == 0, F.lit("no season")),
        (WARNING, "missing_date", F.col("match_date").isNull(), F.lit("no date")),
        (ERROR, "missing_teams", ~(has1 & has2) | (team1 == team2), F.lit("fewer than two sides")),
        (ERROR, "same_team", has1 & (team1 == team2), F.concat(F.lit("both sides are "), _text("team1"))),
        (WARNING, "toss_winner_not_playing", _filled("toss_winner") & any_side & ~playing("toss_winner"),
         F.concat(F.lit("toss winner "), _text("toss_winner"))),
        (WARNING, "bad_toss_decision",
         _filled("toss_decision") & ~F.col("toss_decision").isin("bat", "field"),
         F.concat(F.lit("toss decision "), _text("toss_decision"))),
        (WARNING, "completed_no_result", F.col("is_completed") & no_outcome,
         F.lit("completed without an outcome")),
        (ERROR, "winner_not_playing", _filled("winner") & any_side & ~playing("winner"),
         F.concat(F.lit("winner "), _text("winner"))),
        (WARNING, "double_margin", F.col("win_margin_runs").isNotNull() & wickets.isNotNull(),
         F.lit("both margins are set")),
        (WARNING, "implausible_margin", ~wickets.between(0, k.MAX_WICKETS),
         F.concat(F.lit("wicket margin "), _text("win_margin_wickets"))),
    ]


def contest_issues(contests: DataFrame) -> DataFrame:
    """Identity, participants, toss and result checks."""
    return _explode_issues(contests, _contest_rules())


def _period_rules(of: Callable[[str], Column] = F.col) -> list[Rule]:
    """Rules of one innings, whose values ``of`` names; the sides are those of the contest."""
    batting, which = of("batting_team"), F.concat(F.lit("innings "), _shown(of("innings_no")), F.lit(": "))
    member = F.coalesce(batting == F.col("team1"), F.lit(False)) | F.coalesce(
        batting == F.col("team2"), F.lit(False)
    )
    return [
        (ERROR, "implausible_score", ~of("runs").between(0, k.MAX_PLAUSIBLE_RUNS),
         F.concat(which, _shown(of("runs")), F.lit(" runs"))),
        (ERROR, "implausible_wickets", ~of("wickets").between(0, k.MAX_WICKETS),
         F.concat(which, _shown(of("wickets")), F.lit(" wickets"))),
        (WARNING, "overs_exceed_limit", of("overs") > k.STANDARD_OVERS + 0.5,
         F.concat(which, _shown(of("overs")), F.lit(" overs"))),
        (WARNING, "innings_team_mismatch",
         batting.isNotNull() & (batting != "") & (_filled("team1") | _filled("team2")) & ~member,
         F.concat(which, _shown(batting))),
    ]


def period_issues(contests: DataFrame, periods: DataFrame) -> DataFrame:
    """Range checks of innings totals and the batting side's membership."""
    sides = contests.select("match_id", "match_key", "team1", "team2")
    rows = periods.select(
        "match_id", "innings_no", "runs", "wickets", "overs", "batting_team"
    ).join(sides, "match_id")
    return _explode_issues(rows, _period_rules())


def _repeats(
    contests: DataFrame, child: DataFrame, keys: Sequence[str], severity: str, code: str,
    each: bool = False,
) -> DataFrame:
    """Keys that occur more than once; ``each`` reports every repeat."""
    counted = child.groupBy("match_id", *keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    if each:
        counted = counted.withColumn("copy", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
    label = F.concat_ws(" ", *[_text(key) for key in keys])
    return counted.join(contests.select("match_id", "match_key"), "match_id").select(
        "match_key", F.lit(severity).alias("severity"), F.lit(code).alias("code"),
        label.alias("message"),
    )


def duplicate_periods(contests: DataFrame, periods: DataFrame) -> DataFrame:
    return _repeats(contests, periods, ["innings_no"], ERROR, "duplicate_innings", each=True)


def duplicate_children(
    contests: DataFrame, attack: DataFrame, defence: DataFrame, events: DataFrame
) -> DataFrame:
    return (
        _repeats(contests, attack, ["innings_no", "player"], WARNING, "duplicate_batting")
        .unionByName(
            _repeats(contests, defence, ["innings_no", "player"], WARNING, "duplicate_bowling")
        )
        .unionByName(
            _repeats(contests, events, ["innings_no", "ball_seq"], WARNING, "duplicate_delivery")
        )
    )


def event_mismatch(contests: DataFrame, periods: DataFrame, events: DataFrame) -> DataFrame:
    """Innings whose events do not add up to the scorecard."""
    keys = ["match_id", "innings_no"]
    summed = events.groupBy(*keys).agg(F.sum("total_runs").alias("event_runs"))
    return (
        periods.where(F.col("runs").isNotNull()).select(*keys, "runs").join(summed, keys)
        .where(F.col("runs") != F.col("event_runs"))
        .join(contests.select("match_id", "match_key"), "match_id")
        .select(
            "match_key", F.lit(WARNING).alias("severity"), F.lit("ballbyball_mismatch").alias("code"),
            F.concat(
                F.lit("innings "), _text("innings_no"), F.lit(": events "), _text("event_runs"),
                F.lit(" card "), _text("runs"),
            ).alias("message"),
        )
    )


def _innings(periods: DataFrame, events: DataFrame | None) -> DataFrame:
    """match_id, innings: each innings with its number of rows, its different rows and its events' runs.

    Rows delivered again are counted before they are gathered, so what is gathered for a
    contest is its innings and not the copies of them.
    """
    keys, values = ["match_id", "innings_no"], ["runs", "wickets", "overs", "batting_team"]
    counted = periods.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("copies"))
    each = counted.groupBy(*keys).agg(
        F.sum("copies").alias("n"), F.collect_list(F.struct("innings_no", *values, "copies")).alias("rows")
    )
    if events is None:
        each = each.withColumn("event_runs", F.lit(None).cast("long"))
    else:
        each = each.join(events.groupBy(*keys).agg(F.sum("total_runs").alias("event_runs")), keys, "left")
    return each.groupBy("match_id").agg(F.collect_list(F.struct("innings_no", "n", "event_runs", "rows")).alias("innings"))


def _innings_issues(innings: Column) -> Column:
    """Issues of all rows of an innings: its rules, its copies, its events."""

    def of_row(row: Column) -> Column:
        runs, summed = row["runs"], innings["event_runs"]
        mismatch = F.when(runs != summed, _issue(WARNING, "ballbyball_mismatch", F.concat(
            F.lit("innings "), _shown(row["innings_no"]), F.lit(": events "), _shown(summed), F.lit(" card "), _shown(runs))))
        found = F.concat(_broken(_period_rules(lambda name: row[name])), F.array_compact(F.array(mismatch)))
        return F.flatten(F.array_repeat(found, row["copies"].cast("int")))

    copies = F.array_repeat(
        _issue(ERROR, "duplicate_innings", _shown(innings["innings_no"])), (innings["n"] - 1).cast("int"))
    return F.concat(F.flatten(F.transform(innings["rows"], of_row)), copies)


def _repeated_children(attack: DataFrame, defence: DataFrame, events: DataFrame) -> DataFrame:
    """match_id, repeated: an issue for each child key that comes more than once."""
    kinds = (
        (attack, "player", "duplicate_batting"), (defence, "player", "duplicate_bowling"),
        (events, "ball_seq", "duplicate_delivery"),
    )
    parts = [
        child.groupBy("match_id", "innings_no", key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
            "match_id", _issue(WARNING, code, F.concat_ws(" ", _text("innings_no"), _text(key))).alias("issue"))
        for child, key, code in kinds
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("match_id").agg(F.collect_list("issue").alias("repeated"))


def checked(
    contests: DataFrame,
    periods: DataFrame | None = None,
    attack: DataFrame | None = None,
    defence: DataFrame | None = None,
    events: DataFrame | None = None,
) -> DataFrame:
    """The contests with an array ``issues`` of all rules that they and their children break."""
    none = F.array().cast(ISSUES)
    frame, found = contests, [_broken(_contest_rules())]
    if periods is not None:
        frame = frame.join(_innings(periods, events), "match_id", "left")
        found.append(F.coalesce(F.flatten(F.transform("innings", _innings_issues)), none))
    if attack is not None and defence is not None and events is not None:
        frame = frame.join(_repeated_children(attack, defence, events), "match_id", "left")
        found.append(F.coalesce(F.col("repeated"), none))
    return frame.select(*contests.columns, F.concat(*found).alias("issues"))


def validate(
    contests: DataFrame,
    periods: DataFrame | None = None,
    attack: DataFrame | None = None,
    defence: DataFrame | None = None,
    events: DataFrame | None = None,
) -> DataFrame:
    """All issues of a batch, one row each."""
    return issues_of(checked(contests, periods, attack, defence, events))


def issues_of(found: DataFrame) -> DataFrame:
    """Issue rows of checked contests."""
    return found.select("match_key", F.explode("issues").alias("issue")).select("match_key", "issue.*")


def dedupe(child: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key by ingest position.

    An aggregation rather than a ranked window: copies of a key are reduced in
    the map tasks, so a key with very many copies never gathers in one place. An order
    that names every other column is the row itself, so it is not carried twice.
    """
    rest = [c for c in child.columns if c not in keys]
    row = F.struct(*order)
    first = F.min(row) if set(rest) <= set(order) else F.min_by(F.struct(*rest), row)
    return (
        child.groupBy(*keys)
        .agg(first.alias("__first"))
        .select(*keys, "__first.*")
        .select(*child.columns)
    )


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code").agg(F.count("*").alias("issues"))


def _errors() -> Column:
    return F.size(F.filter("issues", lambda issue: issue["severity"] == ERROR))


def issue_summary(found: DataFrame) -> DataFrame:
    """One row of checked contests: contests and rejected ones, errors and warnings."""
    return found.select(_errors().alias("errors"), F.size("issues").alias("issues")).agg(
        F.count(F.lit(1)).alias("checked"), count_where(F.col("errors") > 0).alias("rejected"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(F.col("issues") - F.col("errors")), F.lit(0)).alias("warnings"),
    )


def is_rejected() -> Column:
    """Whether a checked contest has an error."""
    return _errors() > 0


def split_rejected(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of checked contests: one with any error is rejected, one without a key too."""
    return found.where(~is_rejected()).drop("issues"), found.where(is_rejected()).drop("issues")
