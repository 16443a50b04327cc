"""Fixed values the results depend on.

Everything in this module is a number, word or table that must stay equal to
the published model's own for results to agree.  No logic lives here.
"""

# --- pairwise rating -------------------------------------------------------
ELO_INIT = 1500.0
ELO_DIVISOR = 400.0
ELO_K = 20.0
ELO_MOV_B = 2.2
ELO_SEASON_CARRY = 0.75
ELO_PER_POINT = 25.0

# --- home advantage and rest ----------------------------------------------
HFA_DEFAULT = 1.95
HFA_SEASONS = 3
HFA_MIN = 0.0
HFA_MAX = 3.5
HFA_MIN_GAMES = 100
HFA_OVERRIDES = {2020: 0.15}
HFA_EXCLUDED_SEASONS = (2020,)
REST_POINTS_PER_DAY = 0.10
REST_CAP_DAYS = 10.0

# --- optional rating term for the listed passer ---------------------------
RATING_PASSER_ALPHA = 0.25
RATING_PASSER_SHRINK = 8.0
RATING_PASSER_POINTS = 45.0
RATING_PASSER_CAP = 6.0
RATING_PASSER_UNKNOWN = 0.03
RATING_PASSER_MIN_WEIGHT = 0.05

# --- dispersion, ties, blending -------------------------------------------
MARGIN_SIGMA = 13.2
TOTAL_SIGMA = 13.3
TIE_CREDIT = 0.5
MARKET_BLEND = 0.10
TOTAL_BLEND = 0.10
MARGIN_SIGMA_BOUNDS = (9.0, 18.0)
TOTAL_SIGMA_BOUNDS = (9.0, 20.0)

# --- rolling team form ----------------------------------------------------
FORM_ALPHA = 0.30
FORM_MIN_PLAYS = 10
FORM_CARRY = 0.55
FORM_FULL_GAMES = 6.0
FORM_CONFIDENCE_CAP = 8.0

# --- passers --------------------------------------------------------------
PASSER_ALPHA = 0.25
PASSER_SHRINK_DROPBACKS = 250.0
PASSER_TEAM_ALPHA = 0.20
PASSER_MIN_DROPBACKS = 5.0
PASSER_CPOE_SCALE = 9.93
PASSER_EPA_SCALE = 0.360

# --- player projections ---------------------------------------------------
PLAYER_ALPHA = 0.35
ROSTER_WINDOW = 4
ROSTER_MIN_APPEARANCES = 1
PLAYER_TRAIN_SEASONS = 10
MIN_RATE_VOLUME = 0.5
RATE_BOUNDS = {
    "form_pass_ypa": (0.0, 20.0),
    "form_rush_ypc": (-5.0, 15.0),
    "form_rec_ypt": (0.0, 30.0),
}
LEAGUE_AVERAGE_POINTS = 22.5

# --- half split fallbacks -------------------------------------------------
HALF_TOTAL_SHARE = 0.504
HALF_MARGIN_SLOPE = 0.554
HALF_MIN_GAMES = 200

# --- fitting thresholds and weights ---------------------------------------
MIN_TRAIN_GAMES = 600
MIN_BOOST_GAMES = 600
MIN_PRICED_GAMES = 200
MIN_SLATE_HISTORY = 200
MIN_PLAYER_ROWS = 500
MIN_PLAYER_BOOST_ROWS = 2000
MIN_PROP_HISTORY = 5000
LOGISTIC_C = 0.5
MARKET_C = 1e4
RIDGE_ALPHA = 10.0
BOOST_DEPTH = 3
BOOST_ROUNDS = 220
BOOST_RATE = 0.045
BOOST_MIN_LEAF = 40
BOOST_L2 = 1.0
WINNER_WEIGHTS = {"logistic": 0.40, "margin": 0.35, "boost": 0.25}
TOTAL_WEIGHTS = {"ridge": 0.60, "boost": 0.40}
PLAYER_WEIGHTS = {"ridge": 0.50, "boost": 0.50}
SEED = 7
BACKTEST_START = 2008

# --- prices ---------------------------------------------------------------
VIG_ODDS = -110
BREAKEVEN = 0.5238
KELLY_FRACTION = 0.25
COINFLIP_BELOW = 0.575
CONFIDENCE_TIERS = (
    (0.75, "HIGH"),
    (0.65, "MEDIUM"),
    (0.575, "LEAN"),
    (0.0, "COINFLIP"),
)
CONVICTION_TIERS = (
    (6.0, "BIG"),
    (4.0, "MODERATE"),
    (2.0, "SLIGHT"),
    (0.0, "NONE"),
)

# (intercept, slope) of win rate on the size of the disagreement
OU_EDGE_FIT = (-0.039792, 0.028793)
ATS_EDGE_FIT = (0.014211, 0.008616)

# (lower bound, sample, realised rate)
CALIBRATION_BANDS = (
    (0.90, 32, 0.969),
    (0.80, 475, 0.866),
    (0.75, 522, 0.757),
    (0.70, 703, 0.771),
    (0.65, 738, 0.670),
    (0.60, 877, 0.605),
    (0.55, 866, 0.571),
    (0.50, 699, 0.534),
)
ATS_BANDS = (
    (6.0, 263, 0.540),
    (4.0, 608, 0.508),
    (2.0, 1491, 0.518),
    (0.0, 2426, 0.500),
)
OU_BANDS = (
    (6.0, 277, 0.538),
    (4.0, 652, 0.521),
    (2.0, 1521, 0.513),
    (0.0, 2403, 0.497),
)
CALIBRATION_EDGES = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.9, 1.0)
ATS_THRESHOLDS = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0)
OU_THRESHOLDS = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0)
LONG_RUN = (
    ("Straight up", "accuracy", 0.6661),
    ("Against the spread", "ats_rate", 0.4960),
    ("Over/under", "ou_rate", 0.5077),
    ("Brier score", "brier", 0.2099),
    ("Total error (points)", "total_mae", 10.460),
)

# --- identifiers ----------------------------------------------------------
FRANCHISE_MAP = {"SD": "LAC", "STL": "LA", "OAK": "LV"}
AVAILABILITY = {"Out": 0.0, "Doubtful": 0.01, "Questionable": 0.69}
INDOOR_ROOFS = ("dome", "closed")
INDOOR_TEMPERATURE = 70.0
WIND_BOUNDS = (0.0, 35.0)
TEMPERATURE_BOUNDS = (-10.0, 110.0)
EXPLOSIVE_YARDS = 20.0
FIRST_PLAY_SEASON = 1999
FIRST_PLAYER_SEASON = 1999
FIRST_REPORT_SEASON = 2009
TEAM_TABLE_GAMES = 17

# --- column contracts -----------------------------------------------------
OFFENCE_STATS = (
    "epa_play", "pass_epa", "rush_epa", "success", "explosive",
    "turnover_rate", "sack_rate",
)
TEAM_STATS = tuple(f"off_{s}" for s in OFFENCE_STATS) + tuple(f"def_{s}" for s in OFFENCE_STATS)
PACE_STATS = ("plays", "drives", "plays_per_drive", "pass_rate")
TOTALS_STATS = (
    ("points_for", "points_against")
    + tuple(f"off_{s}" for s in PACE_STATS)
    + tuple(f"def_{s}" for s in PACE_STATS)
)
ROLLED_STATS = TEAM_STATS + TOTALS_STATS
WINNER_FEATURES = (
    "elo_diff", "epa_edge", "pass_epa_edge", "rush_epa_edge", "success_edge",
    "explosive_edge", "turnover_edge", "sack_edge", "rest_diff", "div_game",
    "neutral", "is_playoff", "form_confidence",
)
PASSER_FEATURES = ("qb_delta", "qb_edge", "availability_edge")
TOTAL_FEATURES = (
    "scoring_sum", "off_epa_sum", "def_epa_sum", "explosive_sum",
    "turnover_sum", "plays_sum", "drives_sum", "plays_per_drive_sum",
    "pass_rate_sum", "wind_speed", "temperature", "is_indoor", "div_game",
    "is_playoff", "form_confidence",
)
MARKET_COLUMNS = ("market_spread", "has_market", "market_total", "has_market_total")
PLAYER_FORM = (
    "form_pass_yards", "form_attempts", "form_pass_ypa",
    "form_rush_yards", "form_carries", "form_rush_ypc",
    "form_rec_yards", "form_targets", "form_rec_ypt", "form_target_share",
    "form_games",
)
PLAYER_CONTEXT = (
    "is_home", "team_proj_points", "opp_proj_points",
    "opp_pass_yards_allowed", "opp_rush_yards_allowed",
)
PLAYER_FEATURES = PLAYER_FORM + PLAYER_CONTEXT
PLAYER_TARGETS = {
    "passing_yards": "attempts",
    "rushing_yards": "carries",
    "receiving_yards": "targets",
}
SLATE_COLUMNS = (
    "game_id", "season", "week", "away_team", "home_team", "pick",
    "pick_prob", "confidence", "prob_home", "model_prob_home",
    "market_prob_home", "pred_margin", "market_spread", "spread_edge",
    "ats_pick", "fair_home_ml", "fair_away_ml", "ml_ev", "kelly",
    "pred_total", "model_total", "market_total", "total_edge",
    "prob_over", "ou_pick",
)
SCORECARD_COLUMNS = (
    "game_id", "season", "week", "away_team", "home_team", "pick",
    "pick_prob", "margin", "hit", "market_spread", "pred_margin",
    "ats_win", "market_total", "model_total", "pred_total",
    "actual_total", "ou_pick", "ou_win", "total_error",
)
