"""Rules of the contest that operators take as default parameters."""

# Fixed values.
STANDARD_OVERS = 20
BALLS_PER_OVER = 6
FULL_QUOTA_BALLS = STANDARD_OVERS * BALLS_PER_OVER
POWERPLAY_OVERS = 6
DEATH_OVERS_FROM = 16
MAX_WICKETS = 10
POINTS_WIN = 2
POINTS_SHARED = 1
QUALIFYING_SPOTS = 4
MAX_PLAUSIBLE_RUNS = 350
MAX_REQUIRED_RATE = 99.0

# Dismissal kinds credited to the bowler, and kinds that leave the
# batter not out.
CREDITED_KINDS = ("bowled", "caught", "lbw", "stumped", "caught and bowled", "hit wicket")
NOT_OUT_KINDS = ("retired hurt", "retired not out")

# Priors used before an entity has history.
PRIOR_WIN_RATE = 0.5
PRIOR_SCORE = 165.0
PRIOR_BATTING_AVERAGE = 22.0
PRIOR_STRIKE_RATE = 128.0
PRIOR_ECONOMY = 8.2
SHRINKAGE = 5.0
MAX_REST_DAYS = 30
MIN_CAREER_BALLS = 60
TOP_BATTERS = 7
TOP_BOWLERS = 5
FORM_SHORT = 5
FORM_LONG = 10
ERA_WINDOW = 40
PLACE_RECENT_WINDOW = 10

# Weights of the impact scores.
PAR_STRIKE_RATE = 130
WICKET_IMPACT = 20
PAR_ECONOMY = 8
