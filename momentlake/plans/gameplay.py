"""Loudness and detector events to ranked highlights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from momentlake.operators import events as E
from momentlake.operators.selection import priority_merge
from momentlake.skew import durable

COLUMNS = ["media_id", "clip_id", "start_ms", "end_ms", "peak_ms", "kind", "title", "score", "features", "factors", "cue_times", "target_clips"]


def uniform_clips(media: DataFrame) -> DataFrame:
    """Evenly spaced segments in the shape of the other clips."""
    from momentlake.functions.scoring import factor
    u = E.uniform_segments(media).join(media.select("media_id", "target_clips"), "media_id")
    fac = F.array(factor("Evenly sampled segment", F.lit(0.0), "No audio to rank by"))
    return u.select("media_id", F.concat_ws("-", F.lit("even"), "media_id", "start_ms").alias("clip_id"), "start_ms", "end_ms", F.col("start_ms").alias("peak_ms"),
                    F.lit("even").alias("kind"), "title", "score", F.create_map().cast("map<string,double>").alias("features"), fac.alias("factors"),
                    F.array().cast("array<bigint>").alias("cue_times"), "target_clips")


def gameplay_moments(envelope: DataFrame, events: DataFrame, media: DataFrame, *, hop_ms: int = 100, per_unit: float = 1024.0,
                     max_overlap: float = 0.4) -> DataFrame:
    """The strongest highlights of every recording.

    Clips of matched sounds, on-screen texts and audio events (but for those near a menu) go before loudness peaks, or
    before even segments where a recording has no peak. Highlights of recordings with peaks gain from agreeing
    detectors; one weak signal alone may not reach the top. ``envelope(media_id, frame, t_ms, rms)``, ``events`` as the
    detectors give them, ``media`` with limits, game and duration.
    """
    peaks = durable(E.pick_peaks(envelope, media, per_unit))
    heard = peaks.select("media_id").distinct()
    shown = E.suppress_near_menu(events)
    first = E.cue_clips(shown, media).unionByName(E.text_clips(shown, media)).unionByName(E.audio_event_clips(shown, media)).select(*COLUMNS)
    even = uniform_clips(media.join(heard, "media_id", "left_anti"))
    rest = E.peak_clips(envelope, peaks, media, hop_ms, per_unit).select(*COLUMNS).unionByName(even)
    kept = durable(priority_merge(first, rest, max_overlap))
    backed = E.corroborate(kept.join(heard, "media_id", "left_semi"), shown).select(*COLUMNS)
    return backed.unionByName(kept.join(heard, "media_id", "left_anti"))


def finish_highlights(clips: DataFrame) -> DataFrame:
    """Caps for single signals and names for untitled highlights; the last step after all bonuses."""
    return E.title_fallback(E.evidence_caps(clips))
