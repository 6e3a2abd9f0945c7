"""Event operators against plain loops."""

import random

import pytest

from momentlake.operators import events as E


@pytest.mark.parametrize("chunk", [1, 3000, 40_000, 10_000_000])
def test_static_reads(spark, chunk):
    """Slowly drifting hashes: which read is computed depends on the reference far back."""
    rng, rows, want = random.Random(6), [], {}
    for media in (1, 2, 3):
        h, ref, src = rng.getrandbits(60), None, None
        for i in range(120):
            h ^= 1 << rng.randrange(60) if rng.random() < 0.4 else rng.getrandbits(60) if rng.random() < 0.05 else 0
            value = None if rng.random() < 0.03 else h - (1 << 59)
            rows.append((media, "hud", i * 1000, media * 1000 + i, value, f"t{i}", 0.5))
            if ref is None or value is None or ((value ^ ref) & (2**64 - 1)).bit_count() > 3:
                ref, src = value, media * 1000 + i
            want[media * 1000 + i] = (src, f"t{src % 1000}")
    df = spark.createDataFrame(rows, "media_id long, roi string, t_ms long, read_id long, phash long, text string, conf double")
    got = {r.read_id: (r.source_read, r.text) for r in E.reuse_static_reads(df, chunk_ms=chunk).collect()}
    assert got == want


def test_support_without_pairs(spark, monkeypatch):
    """Clips of several anchors and repeated ids among dense events: counts as over all pairs, but no pair is made."""
    rng, made, pairs = random.Random(8), [], E.range_join

    def watched(*args, **kw):
        made.append(pairs(*args, **kw))
        return made[-1]

    monkeypatch.setattr(E, "range_join", watched)
    n = 300
    events = [(m, m * n + i, rng.randrange(20_000), rng.choice(["cue", "ocr", "audio"]), rng.choice(["kill", "victory", "menu", ""]), 0.5) for m in (1, 2) for i in range(n)]
    clips = [(m, f"{m}-{i}", p, max(0, p - 4000), p + 5000, rng.choice([[], [p], [p, p + 1500], [p + 4800, p - 3900]]), rng.randrange(80, 95), rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.5)
             for m in (1, 2) for i in range(n) for p in [rng.randrange(20_000)]]
    e = spark.createDataFrame(events + events[:50], "media_id long, event_id long, t_ms long, source string, label string, confidence double")
    c = spark.createDataFrame(clips, "media_id long, clip_id string, peak_ms long, start_ms long, end_ms long, cue_times array<long>, score int, has_cue boolean, has_ocr boolean, has_audio boolean")
    family = {"kill": "kill", "victory": "round", "menu": "menu", "": ""}
    scores, accepted = {}, {}
    for m, cid, p, lo, hi, cues, score, has_cue, has_ocr, has_audio in clips:
        near = [x for x in events if x[0] == m and lo <= x[2] <= hi and any(abs(x[2] - a) <= 3000 for a in {p, *cues})]
        by = {s: [family[x[4]] for x in near if x[3] == s] for s in ("cue", "ocr", "audio")}
        match = sum(f != "" and f in by["cue"] for f in by["ocr"])
        if by["cue"] and match:
            score = min(99, score + min(14, 6 + 2 * max(len(by["cue"]) + match + len(by["audio"]) - 2, 0) + 2 * bool(by["audio"])))
        elif not by["cue"] and by["ocr"] and by["audio"] and score < 89:
            score = min(89, score + 3)
        scores[cid] = score
        for x in near:
            f = family[x[4]]
            if {"cue": has_cue and (not has_ocr or (f != "" and f in by["ocr"])), "ocr": has_ocr, "audio": has_audio}[x[3]]:
                key = (x[0], x[3], x[4], x[2])
                accepted[key] = min(x[1], accepted.get(key, x[1]))
    assert {r.clip_id: r.score for r in E.corroborate(c, e).collect()} == scores
    assert {r.event_id for r in E.accepted_events(e, c).collect()} == set(accepted.values())
    assert sum(j.count() for j in made) < len(events) + len(clips)
