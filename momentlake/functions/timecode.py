"""Time formats from integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _parts(ms: Column):
    ms = F.greatest(ms.cast("bigint"), F.lit(0).cast("bigint"))
    h = F.floor(ms / 3_600_000)
    m = F.floor(ms % 3_600_000 / 60_000)
    s = F.floor(ms % 60_000 / 1000)
    return h, m, s, ms % 1000


def srt_time(ms) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", *_parts(_col(ms)))


def vtt_time(ms) -> Column:
    return F.format_string("%02d:%02d:%02d.%03d", *_parts(_col(ms)))


def ass_time(ms) -> Column:
    cs = F.bround(_col(ms) / 10.0, 0) * 10
    h, m, s, rest = _parts(cs)
    return F.format_string("%d:%02d:%02d.%02d", h, m, s, F.floor(rest / 10))


def clock(ms) -> Column:
    """M:SS, as in clip titles."""
    s = F.floor(_col(ms) / 1000)
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def long_clock(ms) -> Column:
    """H:MM:SS when an hour or longer, else M:SS."""
    h, m, s, _ = _parts(_col(ms))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def frames(ms, fps: Column) -> Column:
    return F.greatest(F.bround(_col(ms) * fps / 1000.0, 0).cast("bigint"), F.lit(0))


def frame_timecode(n: Column, fps: Column) -> Column:
    sec = F.floor(n / fps)
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(sec / 3600), F.floor(sec / 60) % 60, sec % 60, n % fps)


def whole_fps(fps) -> Column:
    f = _col(fps)
    return F.when(f > 0, F.greatest(F.lit(1), F.least(F.lit(120), F.bround(f, 0).cast("bigint")))).otherwise(30).cast("bigint")
