"""Small dimension tables. All are parameters of the operators; these are the defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FEATURES = ("instant_hook", "swipe", "hook", "emotion", "clarity", "quote", "pace", "length", "list", "controversy", "qa")

# fixed values: feature weights per platform, in the order of FEATURES
PLATFORM_WEIGHTS = {
    "tiktok": (0.17, 0.11, 0.20, 0.15, 0.09, 0.08, 0.07, 0.03, 0.02, 0.04, 0.04),
    "reels": (0.15, 0.11, 0.18, 0.17, 0.11, 0.08, 0.07, 0.03, 0.02, 0.04, 0.04),
    "shorts": (0.13, 0.14, 0.16, 0.13, 0.17, 0.07, 0.06, 0.04, 0.02, 0.04, 0.04),
    "generic": (0.14, 0.11, 0.18, 0.15, 0.15, 0.08, 0.06, 0.03, 0.02, 0.04, 0.04),
}

# fixed values: display names of the features
FEATURE_LABELS = {
    "instant_hook": "first 2s hook", "swipe": "swipe resistance", "hook": "hook", "emotion": "emotional payoff",
    "clarity": "standalone clarity", "quote": "quotability", "pace": "pace & energy", "length": "length fit",
    "list": "concrete payoff", "controversy": "controversial — drives comments", "qa": "question-answer pattern",
}


def platform_weights(spark: SparkSession) -> DataFrame:
    cols = ", ".join(["platform string"] + [f"w_{f} double" for f in FEATURES])
    return spark.createDataFrame([(p, *w) for p, w in PLATFORM_WEIGHTS.items()], cols)

# fixed values: audio tuning per game (percentile, gap factor, lead share)
GAME_PROFILES = {
    "generic": (82, 0.6, 0.45), "valorant": (80, 0.45, 0.50), "cs2": (80, 0.45, 0.50), "eafc": (85, 0.85, 0.55),
    "rocketleague": (83, 0.60, 0.50), "horror": (88, 0.90, 0.65),
}

# fixed values: audio feature weights per game
GAME_FEATURES = ("intensity", "sustain", "transient", "spikes")
GAME_WEIGHTS = {
    "generic": (0.50, 0.25, 0.20, 0.05), "valorant": (0.45, 0.15, 0.35, 0.05), "cs2": (0.45, 0.15, 0.35, 0.05),
    "eafc": (0.40, 0.45, 0.10, 0.05), "rocketleague": (0.45, 0.30, 0.20, 0.05), "horror": (0.35, 0.10, 0.50, 0.05),
}

# fixed values: other names of the games
GAME_ALIASES = {"auto": "generic", "cs": "cs2", "fifa": "eafc"}

# fixed values: labels that may chain into one kill streak
KILL_CHAIN = ["kill", "double_kill", "triple_kill", "quad_kill", "ace", "headshot", "one_kill", "two_kills", "three_kills",
              "four_kills", "five_kills"]

# fixed values: words that show a menu is open
MENU_WORDS = ["settings", "inventory", "main menu", "menu", "lobby", "store", "shop", "collection", "loadout", "agent select",
              "matchmaking", "einstellungen", "inventar", "hauptmenu", "hauptmenue", "hauptmenü", "menue", "menü", "laden",
              "sammlung", "ausruestung", "ausrüstung", "agenten"]


def game_profiles(spark: SparkSession) -> DataFrame:
    rows = [(g, p[0] / 100.0, p[1], p[2], *map(float, GAME_WEIGHTS[g])) for g, p in GAME_PROFILES.items()]
    return spark.createDataFrame(rows, "game string, thr_pct double, gap_factor double, lead_frac double, "
                                 + ", ".join(f"w_{f} double" for f in GAME_FEATURES))
