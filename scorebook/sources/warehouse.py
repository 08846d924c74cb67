"""Joined reads over the stored tables.

Dimension sides of the joins carry no hint: they are small in every known league,
Spark broadcasts them while their measured size is under
``spark.sql.autoBroadcastJoinThreshold``, and shuffles them beyond it. Filters are
applied before the joins and a role is joined only when its column is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook import schemas
from scorebook.functions.rates import count_where


WAREHOUSE_TABLES = (
    "sides", "places", "actors", "contests", "periods", "attack_cards", "defence_cards",
    "dismissals", "stands", "events", "rosters",
)


# What a load publishes: a row per table and season, the newest version counts.
CURRENT = "_manifest"
MANIFEST = "version long, table string, season int, path string, published_at timestamp"
# Tables stored in one folder per season.
SEASONAL = (
    "contests", "periods", "attack_cards", "defence_cards", "dismissals", "stands", "events", "rosters",
)


class Warehouse:
    """The stored tables, each a DataFrame with the schema of ``schemas.TABLES``.

    A table is opened when it is first used, so a read that touches three tables
    plans three scans.
    """

    def __init__(self, open_table: Callable[[str], DataFrame]) -> None:
        self._open = open_table
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def at(cls, spark: SparkSession, root: str, below: int | None = None) -> Warehouse:
        """Read a warehouse: what loads have published (before version ``below``), and
        the plain folders of :func:`create_tables` and exports for the rest."""
        paths = published_paths(spark, root, below)

        def open_table(name: str, keep_season: bool = False) -> DataFrame:
            schema = schemas.TABLES[name]
            seasonal = name in SEASONAL
            stored = schema if name == "contests" or not seasonal else f"{schema}, season int"
            if name in paths:
                frame = spark.read.schema(stored).option("basePath", f"{root}/{name}").parquet(*paths[name])
            elif paths or below is not None:
                frame = spark.createDataFrame([], stored)
            else:
                return spark.read.schema(schema).parquet(f"{root}/{name}")
            names = [c.split()[0] for c in stored.split(", ")]
            return frame.select(*names) if keep_season or name == "events" else frame.select(
                *[c.split()[0] for c in schema.split(", ")]
            )

        return cls(open_table)

    def open(self, name: str, **options: bool) -> DataFrame:
        return self._open(name, **options)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in WAREHOUSE_TABLES:
            raise AttributeError(name)
        if name not in self._tables:
            self._tables[name] = self._open(name)
        return self._tables[name]

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in WAREHOUSE_TABLES}


def published_paths(spark: SparkSession, root: str, below: int | None = None) -> dict[str, list[str]]:
    """Folders of every table by the manifest; the manifest has a row per load, table and season."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{root}/{CURRENT}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    if below is not None:
        rows = rows.where(F.col("version") < below)
    last = rows.groupBy("table", "season").agg(
        F.max_by("path", F.struct("version", "published_at", "path")).alias("path")
    )
    found: dict[str, list[str]] = {}
    for row in last.orderBy("table", "season").collect():
        found.setdefault(row["table"], []).append(row["path"])
    return found


def create_tables(spark: SparkSession, root: str, drop_existing: bool = False) -> list[str]:
    """Write every table empty with its schema; existing ones are kept unless asked."""
    mode = "overwrite" if drop_existing else "ignore"
    for name, schema in schemas.TABLES.items():
        spark.createDataFrame([], schema).write.mode(mode).parquet(f"{root}/{name}")
    return list(schemas.TABLES)


# Output column -> foreign key, for the roles a contest can be joined to.
SIDE_ROLES = {
    "team1": "team1_id", "team2": "team2_id", "home_team": "home_team_id",
    "away_team": "away_team_id", "toss_winner": "toss_winner_id",
    "first_batting_team": "first_batting_team_id", "second_batting_team": "second_batting_team_id",
    "winner": "winner_id",
}
CONTEST_FLAGS = (
    "is_completed", "is_playoff", "is_tie", "is_no_result", "is_super_over", "is_dls_applied",
    "is_neutral_venue",
)
CONTEST_COLUMNS = [
    "match_id", "match_key", "season", "match_date", "start_datetime", "match_number", "stage",
    "is_playoff", "source", "city", "is_neutral_venue", "is_completed", "toss_decision",
    "result_type", "win_margin_runs", "win_margin_wickets", "is_tie", "is_no_result",
    "is_super_over", "is_dls_applied", "target_runs", "result_summary", "overs_per_innings",
    "venue", *SIDE_ROLES, "player_of_match",
]


def _name(df: DataFrame, dimension: DataFrame, key: str, output: str, how: str = "left") -> DataFrame:
    names = dimension.select(F.col("id").alias(f"__{output}"), F.col("name").alias(output))
    return df.join(names, F.col(key) == F.col(f"__{output}"), how).drop(f"__{output}")


def _flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(False)) for c in columns if c in df.columns}
    )


def load_contests(
    wh: Warehouse,
    completed_only: bool = False,
    season: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    columns = list(columns or CONTEST_COLUMNS)
    frame = wh.contests
    if completed_only:
        frame = frame.where("is_completed")
    if season is not None:
        frame = frame.where(F.col("season") == season)
    frame = frame.withColumnRenamed("id", "match_id")
    if "venue" in columns:
        frame = _name(frame, wh.places, "venue_id", "venue")
    for role, key in SIDE_ROLES.items():
        if role in columns:
            frame = _name(frame, wh.sides, key, role)
    if "player_of_match" in columns:
        frame = _name(frame, wh.actors, "player_of_match_id", "player_of_match")
    return _flags(frame.select(*columns), CONTEST_FLAGS)


def _context(wh: Warehouse, *extra: str) -> DataFrame:
    return wh.contests.select(F.col("id").alias("match_id"), "season", *extra)


def load_periods(wh: Warehouse) -> DataFrame:
    frame = wh.periods.join(_context(wh, "match_date", "venue_id"), "match_id")
    frame = _name(frame, wh.sides, "batting_team_id", "batting_team")
    frame = _name(frame, wh.sides, "bowling_team_id", "bowling_team")
    frame = _name(frame, wh.places, "venue_id", "venue")
    return frame.drop("batting_team_id", "bowling_team_id", "venue_id", "penalty")


def _load_cards(wh: Warehouse, cards: DataFrame) -> DataFrame:
    """Opposition is the other side of the contest; a card without a side is taken
    to face side 1."""
    context = _context(wh, "match_date", "venue_id", "team1_id", "team2_id")
    frame = cards.join(context, "match_id").withColumn(
        "opposition_id",
        F.when(F.col("team_id") == F.col("team1_id"), F.col("team2_id")).otherwise(
            F.col("team1_id")
        ),
    )
    frame = _name(frame, wh.actors, "player_id", "player", "inner")
    frame = _name(frame, wh.sides, "team_id", "team")
    frame = _name(frame, wh.places, "venue_id", "venue")
    return _name(frame, wh.sides, "opposition_id", "opposition")


def load_attack_cards(wh: Warehouse) -> DataFrame:
    return _flags(
        _load_cards(wh, wh.attack_cards).select(
            "match_id", "innings_no", "batting_position", "runs", "balls", "fours", "sixes",
            "strike_rate", "is_out", "dismissal_kind", "player", "team", "season", "match_date",
            "venue", "opposition",
        ),
        ["is_out"],
    )


def load_defence_cards(wh: Warehouse) -> DataFrame:
    return _load_cards(wh, wh.defence_cards).select(
        "match_id", "innings_no", "overs", "balls", "maidens", "runs_conceded", "wickets", "wides",
        "no_balls", "economy", "dot_balls", "player", "team", "season", "match_date", "venue",
        "opposition",
    )


EVENT_FLAGS = ("is_legal", "is_wide", "is_no_ball", "is_four", "is_six", "is_wicket")


def load_events(
    wh: Warehouse,
    season: int | None = None,
    match_ids: Sequence[int] | DataFrame | None = None,
) -> DataFrame:
    """``match_ids`` may be a list or a frame with a match_id column. None reads
    everything, an empty list nothing.

    Stored events lie in a folder for each season. A season leaves out the other
    folders when the query is planned; contests do so when it runs, as the seasons of
    the wanted contests prune the scan (dynamic partition pruning)."""
    context = _context(wh, "match_date")
    if season is not None:
        context = context.where(F.col("season") == season)
    if match_ids is not None:
        if not isinstance(match_ids, DataFrame):
            wanted = [int(m) for m in match_ids]
            context = context.where(F.col("match_id").isin(wanted) if wanted else F.lit(False))
        else:
            context = context.join(match_ids.select("match_id"), "match_id", "left_semi")
    frame = wh.events
    if "season" in frame.columns:
        frame = frame if season is None else frame.where(F.col("season") == season)
        frame = frame.join(context, ["season", "match_id"])
    else:
        frame = frame.join(context, "match_id")
    frame = _name(frame, wh.sides, "batting_team_id", "batting_team")
    frame = _name(frame, wh.sides, "bowling_team_id", "bowling_team")
    frame = _name(frame, wh.actors, "batter_id", "batter")
    frame = _name(frame, wh.actors, "bowler_id", "bowler")
    return _flags(
        frame.select(
            "match_id", "innings_no", "over_no", "ball_no", "ball_seq", "batter_runs", "extra_runs",
            "total_runs", *EVENT_FLAGS, "wicket_type", "cumulative_runs", "cumulative_wickets",
            "batting_team", "bowling_team", "batter", "bowler", "season", "match_date",
        ),
        EVENT_FLAGS,
    )


def load_rosters(wh: Warehouse) -> DataFrame:
    frame = wh.rosters.join(_context(wh, "match_date"), "match_id")
    frame = _name(frame, wh.actors, "player_id", "player", "inner")
    frame = _name(frame, wh.sides, "team_id", "team", "inner")
    return _flags(
        frame.select(
            "match_id", "is_playing_xi", "is_captain", "is_wicketkeeper", "is_overseas",
            "playing_order", "role", "player", "team", "season", "match_date",
        ),
        ["is_playing_xi", "is_captain", "is_wicketkeeper"],
    )


def load_stands(wh: Warehouse) -> DataFrame:
    frame = wh.stands.join(_context(wh, "match_date"), "match_id")
    frame = _name(frame, wh.actors, "striker_id", "striker")
    frame = _name(frame, wh.actors, "non_striker_id", "non_striker")
    frame = _name(frame, wh.sides, "team_id", "team")
    return frame.select(
        "match_id", "innings_no", "wicket_no", "runs", "balls", "striker_runs", "striker_balls",
        "non_striker_runs", "non_striker_balls", "extras", "start_over", "end_over", "striker",
        "non_striker", "team", "season", "match_date",
    )


def load_dismissals(wh: Warehouse) -> DataFrame:
    frame = wh.dismissals.join(_context(wh), "match_id")
    frame = _name(frame, wh.actors, "player_id", "player")
    frame = _name(frame, wh.sides, "team_id", "team")
    return frame.select(
        "match_id", "innings_no", "wicket_no", "fall_score", "fall_overs", "player", "team", "season"
    )


def table_counts(wh: Warehouse) -> DataFrame:
    """Rows per table and completed contests, in one job."""
    out = None
    for name, table in wh.tables().items():
        frame = table.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table_name"), "rows"
        )
        out = frame if out is None else out.unionByName(frame)
    done = wh.contests.agg(count_where(F.col("is_completed")).alias("rows")).select(
        F.lit("completed_contests").alias("table_name"), "rows"
    )
    return out.unionByName(done)


def season_range(contests: DataFrame) -> DataFrame:
    return contests.agg(F.min("season").alias("first_season"), F.max("season").alias("last_season"))

