"""Blocked products against plain loops."""

import numpy as np
import pytest

from momentlake.operators import signals as G


@pytest.mark.parametrize("block", [1, 3, 100])
def test_best_prompt_over_blocks(spark, block):
    rng = np.random.default_rng(4)
    prompts = [(f"L{i}", "pos" if i % 3 else "neg", rng.normal(size=8).round(3).tolist()) for i in range(10)]
    prompts.append(("Z1", "pos", prompts[1][2]))  # equal to L1: the greater label counts
    windows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(30)] + [(30, None), (31, prompts[1][2])]
    w = spark.createDataFrame(windows, "vec_id int, embedding array<double>")
    p = spark.createDataFrame(prompts, "label string, polarity string, embedding array<double>")
    got = {r.vec_id: r for r in G.embedding_similarity(w, p, block).collect()}
    for i, v in windows:
        for side in ("pos", "neg"):
            if v is None:
                assert got[i][side] is None
                continue
            sims = [(float(np.dot(v, e) / np.linalg.norm(v) / np.linalg.norm(e)), label) for label, s, e in prompts if s == side]
            best = max(round(s, 9) for s, _ in sims)
            assert got[i][side].sim == pytest.approx(best) and got[i][side].label == max(x for s, x in sims if round(s, 9) == best)
    assert all(r.pos is None and r.neg is None for r in G.embedding_similarity(w, p.where("false")).collect())


@pytest.mark.parametrize("block, rows", [(1, 4), (3, 1), (100, 256)])
def test_every_window_meets_every_prompt(spark, block, rows):
    rng = np.random.default_rng(5)
    prompts = [(f"L{i}", "pos" if i % 3 else "neg", rng.normal(size=8).round(3).tolist()) for i in range(7)]
    windows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(30)] + [(30, None), (31, prompts[1][2])]
    w = spark.createDataFrame(windows, "vec_id int, embedding array<double>")
    p = spark.createDataFrame(prompts, "label string, polarity string, embedding array<double>")
    got = {(r.vec_id, r.label): r for r in G.all_similarities(w, p, block, rows).collect()}
    assert len(got) == len(windows) * len(prompts)
    for i, v in windows:
        for label, side, e in prompts:
            r = got[i, label]
            assert r.polarity == side
            assert r.sim is None if v is None else r.sim == pytest.approx(float(np.dot(v, e) / np.linalg.norm(v) / np.linalg.norm(e)), abs=1e-9)
    assert G.all_similarities(w, p.where("false")).isEmpty()


@pytest.mark.parametrize("chunk, block", [(1, 2), (7, 5), (1000, 1000)])
def test_template_over_chunk_edges(spark, chunk, block):
    rng = np.random.default_rng(5)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    cues = {"a": unit(rng.normal(size=(2, 4))), "b": unit(rng.normal(size=(9, 4))), "one": unit(rng.normal(size=(1, 4)))}
    frames = {}
    for m in (1, 2):
        x = unit(rng.normal(size=(120, 4)))
        for at, c in ((3, "a"), (40, "b"), (63, "b"), (110, "b")):
            x[at:at + len(cues[c])] = cues[c]
        frames[m] = {f: v for f, v in enumerate(x) if (m, f) != (1, 66)}  # one frame is missing
    df = spark.createDataFrame([(m, f, v.tolist()) for m, fs in frames.items() for f, v in fs.items()], "media_id int, frame int, vec array<double>")
    cf = spark.createDataFrame([(k, i, v.tolist()) for k, c in cues.items() for i, v in enumerate(c)], "label string, i int, vec array<double>")
    want = set()
    for m, fs in frames.items():
        for k, c in cues.items():
            for f in fs:
                if len(c) >= 2 and all(f + i in fs for i in range(len(c))):
                    s = sum(float(fs[f + i] @ c[i]) for i in range(len(c))) / len(c)
                    if s >= 0.6:
                        want.add((m, k, f, round(s, 9)))
    got = {(r.media_id, r.label, r.frame, round(r.sim, 9)) for r in G.template_hits(df, cf, 0.6, chunk, block).collect()}
    assert got == want and {(1, "b", 40), (2, "b", 63)} <= {x[:3] for x in want} and (1, "b", 63) not in {x[:3] for x in want}
    assert G.template_hits(df, cf.where("label = 'one'"), 0.5).collect() == []
