import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from scorebook.session import local_session

    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck_connection():
    from check import duck

    return duck(SF_DIR)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


CONTEST_SCHEMA = (
    "match_id long, match_key string, season int, match_date date, stage string, is_playoff boolean, "
    "city string, is_neutral_venue boolean, is_completed boolean, toss_decision string, "
    "win_margin_runs int, win_margin_wickets int, is_tie boolean, is_no_result boolean, "
    "result_summary string, venue string, team1 string, team2 string, home_team string, "
    "away_team string, toss_winner string, first_batting_team string, second_batting_team string, "
    "winner string, player_of_match string"
)


@pytest.fixture(scope="session")
def contests(spark):
    """Seven decided contests of three sides over two seasons; the fourth is a final."""
    import datetime

    pairs = [("A", "B", "A"), ("B", "C", "C"), ("A", "C", "A"), ("A", "B", "B"),
             ("C", "A", "C"), ("B", "A", "A"), ("B", "C", "B")]
    rows = []
    for i, (one, two, winner) in enumerate(pairs, start=1):
        season = 2023 if i <= 4 else 2024
        rows.append(
            (
                i, f"t:{season}:{i}", season, datetime.date(season, 4, i), "Final" if i == 4 else "League",
                i == 4, "Town", False, True, "bat" if i % 2 else "field", 10 + i, None, False, False,
                f"{winner} won by {10 + i} runs", f"Ground {i % 2}", one, two, one, two,
                one if i % 2 else two, one, two, winner, f"{winner}_P1",
            )
        )
    return spark.createDataFrame(rows, CONTEST_SCHEMA)


@pytest.fixture(scope="session")
def events(spark):
    """120 legal balls per innings; a wicket every 24th ball, at most nine."""
    pattern = [1, 0, 4, 1, 2, 6]
    rows = []
    for match_id in range(1, 8):
        for innings in (1, 2):
            wickets = 0
            for ball in range(1, 121):
                runs = pattern[ball % 6]
                out = ball % 24 == 0 and wickets < 9
                wickets += out
                rows.append(
                    (
                        match_id, innings, (ball - 1) // 6 + 1, (ball - 1) % 6 + 1, ball, runs, 0, runs,
                        True, False, False, runs == 4, runs == 6, out, "bowled" if out else None,
                        "A" if innings == 1 else "B", "B" if innings == 1 else "A",
                        f"bat{ball % 3}", f"bat{(ball + 1) % 3}", f"bowl{ball % 2}",
                        f"bat{ball % 3}" if out else None, 2023,
                    )
                )
    return spark.createDataFrame(
        rows,
        "match_id long, innings_no int, over_no int, ball_no int, ball_seq int, batter_runs int, "
        "extra_runs int, total_runs int, is_legal boolean, is_wide boolean, is_no_ball boolean, "
        "is_four boolean, is_six boolean, is_wicket boolean, wicket_type string, batting_team string, "
        "bowling_team string, batter string, non_striker string, bowler string, dismissed string, "
        "season int",
    )
