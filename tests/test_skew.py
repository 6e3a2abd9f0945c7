"""Chunked operators equal their plain definition for every chunk size."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from momentlake.operators import events as E
from momentlake import skew
from momentlake.operators import passages as P
from momentlake.operators import selection as S
from momentlake.operators.selection import nms_gap, nms_iou
from momentlake.skew import chain_marks, chunk_by_pos, percentiles, runs, scan


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def words(spark):
    rng = random.Random(3)
    out = []
    for m in (1, 2):
        t = 0
        for pos in range(120 if m == 1 else 9):
            text = rng.choice(["so", "what", "42", "—", "real", "reason.", "why?", "don't stop", "it's!"])
            d = rng.randint(50, 400)
            out.append((m, "en", pos, t, d, text))
            t += d + rng.choice([0, 10, 700])
    return spark.createDataFrame(out, "media_id bigint, lang string, pos bigint, t_ms bigint, d_ms bigint, text string")


def test_sentences(spark, words):
    want, sid, prev = [], 0, None
    for r in words.orderBy("media_id", "pos").collect():
        if prev is None or prev.media_id != r.media_id:
            sid = 0
        elif prev.text[-1] in ".!?" or r.t_ms - prev.t_ms - prev.d_ms >= 650:
            sid = r.pos
        want.append((r.media_id, r.pos, sid))
        prev = r
    for chunk in (1, 2, 7, 1000):
        assert rows(P.segment_sentences(words, chunk_rows=chunk), "media_id", "pos", "sid") == sorted(want)


def test_sentence_features(spark, words):
    lex = spark.createDataFrame([("en", "hook", "what"), ("en", "emotion", "real"), ("en", "controversy", "real reason"), ("en", "dangling", "so"),
                                 ("en", "second_person", "it's"), ("en", "enumeration", "so what")], "lang string, role string, term string")
    cols = None
    want = None
    for chunk in (1000, 5, 1):
        s = P.sentence_features(words, lex, ["so", "turns out"], chunk_rows=chunk)
        cols = cols or sorted(s.columns)
        got = sorted((tuple(r) for r in s.select(*cols).collect()), key=repr)
        want = want or got
        assert got == want


def test_chunk_width_follows_the_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "CHUNK_ROWS", 50)
    dense = [(1, t * 1000) for t in range(1000)]
    df = spark.createDataFrame(dense + [(2, t * 60_000) for t in range(30)], "media_id bigint, _lo bigint")
    assert skew._chunk_width(df, ["media_id"], 4000) == 32_000
    assert skew._chunk_width(df.where("media_id = 2"), ["media_id"], 4000) >= 1_000_000
    assert skew._chunk_width(df, ["media_id"], 9_000_000) == 9_000_000


def test_greedy_with_long_spans(spark):
    """Lengths from seconds to days: classes with chunks of their own, conflicts between neighbouring classes."""
    rng = random.Random(9)
    cand = [(1, s, s + int(10 ** rng.uniform(3.5, 8.3)), rng.randint(0, 40) / 10) for s in (rng.randrange(0, 400_000_000) for _ in range(500))]
    cand += [(1, s, s + int(3_000_000 * rng.uniform(0.5, 3)), rng.randint(0, 40) / 10) for s in (rng.randrange(0, 20_000_000) for _ in range(200))]
    cand = list({c[:3]: c for c in cand}.values())
    kept = []
    for c in sorted(cand, key=lambda c: (-c[3], c[1], c[2])):
        if all((max(0, min(c[2], k[2]) - max(c[1], k[1]))) <= 0.35 * ((c[2] - c[1]) + (k[2] - k[1]) - max(0, min(c[2], k[2]) - max(c[1], k[1]))) for k in kept):
            kept.append(c)
    df = spark.createDataFrame(cand, "media_id bigint, start_ms bigint, end_ms bigint, salience double")
    assert sorted(tuple(r) for r in S.nms_iou(df, k=None).collect()) == sorted(kept)
    assert S.nms_iou(df.where("false"), k=None).collect() == []


@pytest.mark.parametrize("longest", [20_000, 200_000])
def test_greedy_iou(spark, longest):
    rng = random.Random(5)
    cand = [(m, s, s + rng.randint(3000, longest), rng.randint(0, 40) / 10) for m in (1, 2) for s in (rng.randrange(0, 20 * longest) for _ in range(150))]
    cand = list(dict.fromkeys(cand))
    df = spark.createDataFrame(cand, "media_id bigint, start_ms bigint, end_ms bigint, salience double")

    def iou(a, b):
        inter = max(0, min(a[2], b[2]) - max(a[1], b[1]))
        return inter / ((a[2] - a[1]) + (b[2] - b[1]) - inter)
    want = []
    for m in (1, 2):
        kept = []
        for c in sorted((c for c in cand if c[0] == m), key=lambda c: (-c[3], c[1], c[2])):
            if all(iou(c, k) <= 0.35 for k in kept):
                kept.append(c)
        want += kept
    for chunk in (1, 100_000, 10_000_000):
        got = nms_iou(df, k=None, chunk_ms=chunk)
        assert rows(got, "media_id", "start_ms", "end_ms", "salience") == sorted(want)


def test_greedy_gap(spark):
    rng = random.Random(6)
    pts = [(1, t, rng.random()) for t in rng.sample(range(0, 300_000), 400)]
    df = spark.createDataFrame(pts, "media_id bigint, t_ms bigint, v double")
    kept = []
    for p in sorted(pts, key=lambda p: (-p[2], p[1])):
        if all(abs(p[1] - k[1]) >= 3000 for k in kept):
            kept.append(p)
    for chunk in (1, 50_000, 10_000_000):
        assert rows(nms_gap(df, "v", 3000, chunk_ms=chunk), "t_ms") == sorted((k[1],) for k in kept)


def test_chain(spark):
    rng = random.Random(7)
    t = sorted(rng.randrange(0, 200_000) for _ in range(500))
    df = spark.createDataFrame([(1, x, i) for i, x in enumerate(t)], "media_id bigint, t_ms bigint, event_id bigint")
    want, last = [], None
    for i, x in enumerate(t):
        if last is None or x - last >= 4000:
            want.append((i,))
            last = x
    for chunk in (5_000, 30_000, 10_000_000):
        got = chain_marks(df, "media_id", ["t_ms", "event_id"], "t_ms", 4000, chunk_ms=chunk).where("anchor")
        assert rows(got, "event_id") == want


def test_chain_by_end(spark):
    """Fixed word windows: the next window starts at the first word whose end reaches the target."""
    ws = [(0, 30_000), (30_000, 30_400)] + [(31_000 + 400 * i, 31_340 + 400 * i) for i in range(300)]
    df = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(ws)], "media_id bigint, pos bigint, t_ms bigint, end_ms bigint")
    want, i = [], 0
    while i < len(ws):
        want.append((i,))
        j = i
        while j < len(ws) and ws[j][1] - ws[i][0] < 10_000:
            j += 1
        i = max(j, i + 1)
    for chunk in (15_000, 10_000_000):
        got = chain_marks(df, "media_id", ["t_ms", "pos"], "t_ms", 10_000, value="end_ms", chunk_ms=chunk).where("anchor")
        assert rows(got, "pos") == want


def test_scan_and_runs(spark):
    df = spark.createDataFrame([(1, i, i % 5 if i % 3 else None, i % 4 == 0) for i in range(50)], "k bigint, pos bigint, v bigint, b boolean")
    base = None
    for chunk in (1000, 7, 1):
        c = chunk_by_pos(df, rows=chunk)
        s = scan(c, ["k"], ["pos"], lead={"nx": "pos"}, lag={"pv": "pos"}, before={"lastv": F.col("v")}, after={"nextv": F.col("v")}, sums={"s": F.col("v")}, maxes={"m": F.col("v")})
        r = runs(c, ["k"], ["pos"], F.col("b"))
        got = (sorted(map(repr, rows_any(s, "pos", "nx", "pv", "lastv", "nextv", "s", "m"))), rows(r, "pos", "run_pos", "run_start"))
        base = base or got
        assert got == base
    assert (49, None, 48) in rows_any(s, "pos", "nx", "pv")


def rows_any(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_percentiles(spark):
    import numpy as np
    v = [random.Random(9).random() for _ in range(101)] + [0.5] * 40
    df = spark.createDataFrame([(1, x) for x in v], "k bigint, v double")
    got = percentiles(df, ["k"], "v", {"p": F.lit(0.82)}, F.floor(F.col("v") * 8)).first()
    assert abs(got.p - np.percentile(v, 82)) < 1e-12


def test_streaks_and_dedupe(spark):
    ev = spark.createDataFrame([(1, i, t, "cue", "kill", c) for i, (t, c) in enumerate([(100_000, .8), (104_000, .9), (109_000, .85), (300_000, .9)])],
                               "media_id bigint, event_id bigint, t_ms bigint, source string, label string, confidence double")
    for chunk in (3_600_000, 5_000):
        assert rows(E.group_streaks(ev, chunk_ms=chunk), "event_id", "streak") == [(0, 0), (1, 0), (2, 0), (3, 3)]
    d = spark.createDataFrame([(1, i, t * 1000, "ocr", "kill", .5) for i, t in enumerate((10, 11, 12, 40))], ev.schema)
    assert rows(E.dedupe_events(d), "t_ms") == [(10_000,), (40_000,)]
    mix = [(0, "spike_plant"), (3, "spike_defuse"), (6, "kill")]
    m = spark.createDataFrame([(1, i, (10 + t) * 1000, "cue", lab, .9) for i, (t, lab) in enumerate(mix)], ev.schema)
    assert len({r[0] for r in rows(E.group_streaks(m), "streak")}) == 3


def test_chain_steps_only_for_keys_of_several_chunks(spark):
    """Short keys are marked in one pass: a step table and a carry for each would cost two more."""
    rows = [(m, i, i * 1500) for m in range(20) for i in range(5 if m else 60)] + [(None, 0, 0)]
    df = spark.createDataFrame(rows, "media_id long, event_id long, t_ms long")
    marks = chain_marks(df, "media_id", ["t_ms", "event_id"], "t_ms", 4000, chunk_ms=10_000)
    assert "LeftSemi" in marks._jdf.queryExecution().sparkPlan().toString()
    got = {(r.media_id, r.event_id) for r in marks.where("anchor").collect()}
    assert got == {(m, i) for m in range(20) for i in range(0, 5 if m else 60, 3)}


def test_map_groups_hands_over_whole_sorted_groups(spark):
    """Groups longer than a batch, many small ones and null keys, from few calls."""
    rows = [("big", i * 7919 % 25_000) for i in range(25_000)] + [(f"k{i // 3}", i % 3) for i in range(9_000)] + [(None, 5), (None, 4)]
    df = spark.createDataFrame(rows, "k string, v int")

    def run(table, edges):
        assert edges[0] == 0 and edges[-1] == table.num_rows
        k, v = table["k"].to_pylist(), table["v"].to_pylist()
        made = [(k[a], len(set(k[a:b])), b - a, v[a:b] == sorted(v[a:b]), len(edges) - 1) for a, b in zip(edges, edges[1:])]
        return pa.table([list(c) for c in zip(*made)], schema=pa.schema([("k", pa.string()), ("keys", pa.int64()), ("n", pa.int64()), ("sorted", pa.bool_()), ("calls", pa.int64())]))

    got = skew.map_groups(df, ["k"], ["v"], run, "k string, keys bigint, n bigint, sorted boolean, calls bigint").collect()
    assert sorted((str(r.k), r.n) for r in got) == sorted([("big", 25_000), ("None", 2), *((f"k{i}", 3) for i in range(3_000))])
    assert all(r["keys"] == 1 and r.sorted for r in got) and max(r.calls for r in got) > 50


def test_state_machine_makes_no_map_for_keys_of_one_chunk(spark):
    """Only the key of two chunks is summarised; keys of one start from the starting state; null keys are left out."""
    rows = [(f"k{i}", 0, t) for i in range(5) for t in range(4)] + [("two", t // 3, t) for t in range(6)] + [(None, 0, 1)]
    df = spark.createDataFrame(rows, "k string, _chunk bigint, t bigint")

    def summary(r):
        assert r[0]["k"] == "two"
        return len(r)

    def run(r, state):
        return [(x["t"], state + i) for i, x in enumerate(r)], state + len(r)

    got = skew.state_machine(df, ["k"], ["t"], 100, summary, run, lambda m, s: s + m, "t bigint, n bigint").collect()
    assert sorted((r.k, r.t, r.n) for r in got) == sorted([(k, t, 100 + t) for k, _, t in rows if k is not None])
