"""Scores, bonuses and reasons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from momentlake.functions.dictionaries import FEATURE_LABELS, FEATURES
from momentlake.functions.text import clamp, first_upper

FACTOR = "struct<label:string,weight:double,detail:string>"


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


def calibrate(points: Column) -> Column:
    return clamp((points - 45.0) * 1.35 + 52.0, 1.0, 99.0)


def score_from_points(points: Column) -> Column:
    return half_even(calibrate(points))


def factor(label, weight: Column, detail) -> Column:
    lab = label if isinstance(label, Column) else F.lit(label)
    det = detail if isinstance(detail, Column) else F.lit(detail)
    return F.struct(lab.alias("label"), weight.cast("double").alias("weight"), det.alias("detail"))


def prepend(cond: Column, new: Column, factors: Column) -> Column:
    return F.when(cond, F.concat(F.array(new), factors)).otherwise(factors)


def top_factors(contribs: Column, min_value: float = 0.25, min_points: float = 4.0, k: int = 4) -> Column:
    """Best reasons of ``array<struct<points,neg_order,label,detail,value>>``: at most ``k`` strong
    ones; when fewer than two, filled with the next distinct labels."""
    ranked = F.sort_array(contribs, asc=False)
    strong = F.slice(F.filter(ranked, lambda c: (c["value"] >= min_value) & (c["points"] >= min_points)), 1, k)
    as_factor = lambda c: F.struct(c["label"].alias("label"), F.round(c["points"], 1).alias("weight"),
                                   c["detail"].alias("detail"))
    picked = F.transform(strong, as_factor)
    filled = F.aggregate(F.transform(ranked, as_factor), picked, lambda acc, c: F.when(
        (F.size(acc) < 2) & ~F.exists(acc, lambda f: f["label"] == c["label"]), F.concat(acc, F.array(c))).otherwise(acc))
    return F.when(F.size(picked) < 2, filled).otherwise(picked)


def feature_reasons() -> dict[str, Column]:
    """Reason per feature, from the feature values themselves."""
    return {
        "instant_hook": F.col("r_instant_hook"), "swipe": F.col("r_swipe"), "hook": F.col("r_hook"),
        "emotion": F.lit("Clear emotional charge"),
        "clarity": F.when(F.col("f_clarity") > 0.95, "Clean standalone story")
        .when(F.abs(F.col("f_clarity") - 0.45) < 0.01, "Resolves cleanly").otherwise("Self-contained"),
        "quote": F.lit("Quotable, punchy line"), "pace": F.lit("Energetic, well-paced delivery"),
        "length": F.lit("Ideal length for the format"), "list": F.lit("Concrete, list-style payoff"),
        "controversy": F.lit("Controversial — drives comments"),
        "qa": F.when(F.col("f_qa") > 0, "Question triggers then answers — drives retention").otherwise(""),
    }


def score_passages(df: DataFrame) -> DataFrame:
    """Add ``score`` and ``factors`` from ``f_*`` and ``w_*`` columns."""
    total = F.lit(0.0)
    items = []
    reasons = feature_reasons()
    for i, f in enumerate(FEATURES):
        pts = F.col(f"f_{f}") * F.coalesce(f"w_{f}", F.lit(0.0)) * 100.0
        total = total + pts
        label = F.when(reasons[f] == "", F.lit(FEATURE_LABELS[f])).otherwise(reasons[f])
        detail = F.concat(first_upper(F.lit(FEATURE_LABELS[f])), F.lit(" scored "),
                          F.floor(F.col(f"f_{f}") * 100).cast("string"), F.lit("/100"))
        items.append(F.struct(pts.alias("points"), F.lit(-i).alias("neg_order"), label.alias("label"),
                              detail.alias("detail"), F.col(f"f_{f}").alias("value")))
    return df.withColumns({"score": score_from_points(total), "factors": top_factors(F.array(*items))})


def _bonus(df: DataFrame, delta: Column, when: Column, label, detail) -> DataFrame:
    d = F.when(when, delta).otherwise(0).cast("int")
    return df.withColumn("_d", F.coalesce(d, F.lit(0))).withColumns({
        "score": F.when(F.col("_d") != 0, F.greatest(F.lit(1), F.least(F.lit(99), F.col("score") + F.col("_d"))))
        .otherwise(F.col("score")),
        "factors": prepend(F.col("_d") != 0, factor(label, F.col("_d"), detail), F.col("factors"))}).drop("_d")


def replay_bonus(df: DataFrame, replay: str = "replay", max_bonus: float = 8.0) -> DataFrame:
    d = half_even(F.col(replay) * max_bonus)
    return _bonus(df, d, d > 0, "Loopable ending", "Loops cleanly — ends on a tight button")


def viral_boost(df: DataFrame, viral: str = "viral", reason: str = "viral_reason", max_swing: float = 12.0) -> DataFrame:
    """Model read in [0, 1] moves the score by at most ``max_swing``; a missing read changes nothing."""
    v = F.col(viral)
    d = half_even((clamp(v) - 0.5) * 2.0 * max_swing)
    label = F.concat(F.lit("AI: "), F.when(F.coalesce(F.col(reason), F.lit("")) == "", "AI virality read").otherwise(F.col(reason)))
    return _bonus(df, d, v.isNotNull(), label,
                  F.concat(F.lit("Local model rated virality "), F.floor(v * 100).cast("string"), F.lit("/100")))


def excitement_bonus(df: DataFrame, arousal: str = "arousal", max_bonus: float = 10.0) -> DataFrame:
    a = F.col(arousal)
    swing = int(max_bonus)
    d = F.greatest(F.lit(-swing), F.least(F.lit(swing), half_even((clamp(a) - 0.45) / 0.55 * max_bonus)))
    return _bonus(df, d, a.isNotNull(), F.when(d > 0, "High-energy delivery").otherwise("Flat delivery"),
                  F.concat(F.lit("Speech-emotion arousal "), F.floor(a * 100).cast("string"), F.lit("/100 (emotion2vec)")))


def event_bonus(df: DataFrame, hype: str = "hype", reason: str = "hype_reason", max_bonus: float = 10.0) -> DataFrame:
    """Clips born from an audio event (``features['audio_event']``) carry that evidence already and are skipped."""
    h = F.col(hype)
    d = half_even(clamp(h) * max_bonus)
    born = F.coalesce(F.try_element_at("features", F.lit("audio_event")), F.lit(0.0)) > 0 if "features" in df.columns else F.lit(False)
    return _bonus(df, d, h.isNotNull() & (d > 0) & ~born, first_upper(F.lower(reason)),
                  F.concat(F.lit("Audio event detection heard "), F.col(reason), F.lit(" ("), F.floor(h * 100).cast("string"), F.lit("/100)")))


def score_band(score) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 75, "high").when(s >= 55, "good").when(s >= 40, "fair").otherwise("low")


def iou_1d(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    inter = F.greatest(F.lit(0), F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo))
    union = (a_hi - a_lo) + (b_hi - b_lo) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def iou_2d(a: Column, b: Column) -> Column:
    ix = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    iy = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    inter = ix * iy
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union > 0, inter / union).otherwise(0.0)
