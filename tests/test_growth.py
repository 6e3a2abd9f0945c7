"""Steps that must not be done per small group, per pair or more than once."""

import random

import pytest
from pyspark.sql import functions as F

from momentlake.functions.text import fold_text
from momentlake.operators import captions as C
from momentlake.operators import events as E
from momentlake.operators import passages as P
from momentlake.operators import selection as S
from momentlake.operators import tracks as K
from momentlake.sources import library as L


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    return inter / (a[2] * a[3] + b[2] * b[3] - inter)


def test_link_boxes_many_clips_in_a_call(spark):
    """Many clips, also with a missing side, equal the plain loop; clips are not handed over one by one."""
    rng = random.Random(5)
    rows = [(1, f"c{c}", f, rng.choice([0.1, 0.12, 0.5, 0.55]) + rng.random() / 50, 0.2, 0.2, 0.3 if rng.random() < 0.95 else None)
            for c in range(40) for f in range(12) for _ in range(rng.randrange(3))]
    df = spark.createDataFrame(rows, "media_id long, clip_id string, frame long, x double, y double, w double, h double")
    made = K.link_boxes(df)
    assert "FlatMapGroups" not in plan(made)
    got = {(r.clip_id, r.frame, r.x): r.track_id for r in made.collect()}
    want = {}
    for c in sorted({r[1] for r in rows}):
        open_, nxt = [], 1
        for f in sorted({r[2] for r in rows if r[1] == c}):
            seen = set()
            for box in sorted(r[3:] for r in rows if r[1] == c and r[2] == f):
                best = max(open_, key=lambda o: iou(o[2], box) if None not in (*o[2], *box) else 0, default=None)
                if best is None or None in (*best[2], *box) or iou(best[2], box) < 0.25:
                    best = [nxt, 0, box]
                    open_.append(best)
                    nxt += 1
                best[1], best[2] = 0, box
                seen.add(best[0])
                want[c, f, box[0]] = best[0]
            for o in open_:
                o[1] += o[0] not in seen
            open_ = [o for o in open_ if o[1] <= 5]
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_nearest_cuts_without_pairs(spark, seed):
    """Equal to trying every cut; clips and cuts meet in one ordered pass, also across an hour."""
    rng = random.Random(seed)
    clips = [(m, f"{m}-{i}", s, s + rng.randrange(1000, 20_000)) for m in (1, 2) for i in range(60) for s in [rng.choice([0, 3_590_000]) + rng.randrange(60_000)]]
    cuts = sorted({(m, rng.choice([0, 3_590_000]) + rng.randrange(0, 70_000, 100)) for m in (1, 2) for _ in range(40)})
    c = spark.createDataFrame([*clips, (None, "n", 0, 9000), (1, "open", None, 9000)], "media_id long, clip_id string, start_ms long, end_ms long")
    t = spark.createDataFrame(cuts, "media_id long, t_ms long")
    for window, least in ((1500, 5000), (9000, 5000)):
        made = C.pick_cutaway(c, t, window, least)
        assert "_bucket" not in plan(made)
        want = {}
        for m, k, s, e in clips:
            met = [x for n, x in cuts if n == m and s <= x <= e - window]
            if e - s >= least and met:
                want[k] = min(met, key=lambda x: (abs(x - (s + e) / 2), x))
        assert {r.clip_id: r.a_ms for r in made.collect()} == want
    snapped = C.snap_to_cuts(c, t)
    assert "_bucket" not in plan(snapped)
    want = {"n": 0, "open": None}
    for m, k, s, e in clips:
        near = min((x for n, x in cuts if n == m and abs(x - s) <= 1500), key=lambda x: (abs(x - s), x), default=None)
        want[k] = near if near is not None and e - near >= 3000 else s
    assert {r.clip_id: r.start_ms for r in snapped.collect()} == want


def test_documents_are_parsed_once(spark):
    docs = spark.createDataFrame([('{"id": "a", "clips": [{"id": "c", "start": 1.0}]}',), ("{broken",)], "data string")
    made = L.read_project_documents(docs)
    assert [r.start_ms for r in made["clips"].collect()] == [1000] and made["bad"].count() == 1
    assert all("from_json" not in plan(x) for x in made.values())
    cues = L.read_cue_documents(spark.createDataFrame([("g", '{"phrases": {"A b": ["One  two", "one two"]}}'), ("o", '{"k": ["x"]}')], "game string, data string"))
    assert sorted(tuple(r) for r in cues["phrases"].collect()) == [("g", "a_b", "One two"), ("o", "k", "x")]
    assert all("from_json" not in plan(x) for x in cues.values())


def test_sentences_are_made_once(spark):
    """The words are read for the sentences, not again by each branch of the scan over them."""
    words = spark.createDataFrame([(1, "en", i, i * 400, 300, "Yes." if i % 5 == 4 else "that") for i in range(50)], "media_id long, lang string, pos long, t_ms long, d_ms long, text string")
    made = P.sentence_features(words, spark.createDataFrame([("en", "hook", "that")], "lang string, role string, term string"), markers=["is"])
    assert "Generate" not in plan(made) and made.count() == 10


def test_greedy_and_phrases_in_few_calls(spark):
    spans = spark.createDataFrame([(m, s, s + 10, float(s % 7)) for m in range(50) for s in range(0, 100, 3)], "media_id long, start_ms long, end_ms long, salience double")
    from momentlake import skew
    made = skew._greedy_round(spans.select("media_id", F.monotonically_increasing_id().alias("_id"), (-F.col("salience")).alias("_r0"), F.col("start_ms").alias("_r1"), F.col("start_ms").alias("_lo"),
                                           F.col("end_ms").alias("_hi"), F.lit(False).alias("_kept"), F.lit(0).alias("_cls")), ["media_id"], ["_r0", "_r1"], skew.overlap_above(0.3), {0: 10}, {0: 1000}, False)
    assert "FlatMapGroups" not in plan(made)
    kept = sorted((r.media_id, r.start_ms) for r in S.nms_iou(spans, max_overlap=0.3, k=None).collect())
    want = []
    for s in sorted(range(0, 100, 3), key=lambda s: (-(s % 7), s)):
        if all(max(0, 10 - abs(s - x)) / (20 - max(0, 10 - abs(s - x))) <= 0.3 for x in want):
            want.append(s)
    assert kept == sorted((m, s) for m in range(50) for s in want)


def test_folding_looks_up_characters_once(spark):
    """No pattern lists every special character."""
    assert "RLIKE" not in str(fold_text("t")).upper()
    assert spark.createDataFrame([("½ ½ ™x ﬁ ﬁ é",)], "t string").select(fold_text("t")).first()[0] == "12 12 tmx fi fi e"


def test_cue_sets_make_each_pair_once(spark):
    """Cues of several profiles, recordings with several rows, nulls and names in common: as the plain union, but no pair is made twice and no pair is shuffled."""
    rng = random.Random(12)
    cues = [(rng.choice([None, *range(30)]), rng.choice([None, "common", "a", "b", "c", "d"])) for _ in range(60)]
    sets = [(rng.choice([None, *range(8)]), rng.choice([None, "common", "a", "b", "c"]), rng.choice([None, [], [rng.choice([None, *range(40)]) for _ in range(6)]])) for _ in range(14)]
    made = E.gather_cue_sets(spark.createDataFrame(cues, "cue_id long, profile string"), spark.createDataFrame(sets, "media_id long, game_profile string, extra_cues array<long>"))
    got = sorted(map(str, map(tuple, made.collect())))
    want = {(m, c) for m, g, x in sets for c, p in cues if p is not None and p in (g, "common") or c is not None and x and c in x}
    assert got == sorted(map(str, want))
    assert made._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
