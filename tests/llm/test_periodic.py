import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from momentlake.llm import periodic, queries
from tests.llm.edge import ROWS, edge_docs, no_docs

SF = "/root/testdata/sf0.001"


def brute(w, least=24, turns=3):
    """All runs by comparing the words with themselves, one period after the other."""
    number = {}
    v = np.array([number.setdefault(x, len(number)) for x in w], np.int64)
    n, out, seen = len(v), [], set()
    for q in range(1, n // turns + 1):
        same = np.r_[False, v[:n - q] == v[q:], False].astype(np.int8)
        edges = np.flatnonzero(np.diff(same))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if j - i + q >= max(least, turns * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j - i + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, plant=True):
    w = [x for x in (text or "").encode().split()]
    n = len(w)
    if plant and doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


@pytest.fixture(scope="module")
def sequences():
    rng, out = random.Random(2), []
    for _ in range(1500):
        k, t = rng.choice([1, 2, 2, 3, 5]), []
        for _ in range(rng.randint(0, 8)):
            u = [rng.randrange(k) for _ in range(rng.randint(1, rng.choice([2, 5, 9, 20, 40])))]
            t += (u * rng.randint(1, rng.choice([1, 4, 9, 30])))[:rng.randint(1, 300)]
        out.append(np.array(t, np.int64))
    return out


@pytest.mark.parametrize("least, turns", [(24, 3), (1, 3), (10, 5)])
def test_runs_of_repetitive_words(sequences, least, turns):
    got = []
    for i in range(0, len(sequences), 100):
        got += periodic.find_runs(sequences[i:i + 100], least, turns)
    want = [brute(t.tolist(), least, turns) for t in sequences]
    assert got == want and sum(map(len, want)) > 500


def test_long_runs():
    """Stretches far longer than the highest kept level, and runs within runs."""
    rng = np.random.default_rng(1)
    unit = rng.integers(0, 50, 700)
    t = np.concatenate((rng.integers(0, 9, 50), np.tile(unit, 20), np.zeros(9000, np.int64), rng.integers(0, 9, 50), np.tile([1, 2], 3000)))
    (got,) = periodic.find_runs([t])
    assert {(q, m // 1000) for _, m, q in got if m > 1000} == {(700, 14), (1, 9), (2, 6)}
    assert all(np.array_equal(t[s:s + m - q], t[s + q:s + m]) for s, m, q in got)
    nested = np.tile(np.concatenate((np.tile([3, 4], 20), [5])), 9)
    assert periodic.find_runs([nested]) == [brute(nested.tolist())]


def test_few_turns_are_refused():
    with pytest.raises(ValueError):
        periodic.find_runs([], min_turns=2)


def test_whole_table(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert got == {r.doc_id: expected(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert any(v[0] for v in got.values())


def test_edge(spark):
    for size in (1, 1 << 19):
        got = periodic.run_digests(periodic.periodic_runs(edge_docs(spark, "runs", "start"), plant=True, batch_words=size)).collect()
        assert sorted(map(repr, ((r[0], *tuple(r)[1:]) for r in got))) == sorted(repr((r[0], *expected(r[0], r[1]))) for r in ROWS)
    assert periodic.run_digests(periodic.periodic_runs(no_docs(spark))).collect() == []


def test_runs_column(spark):
    df = spark.createDataFrame([(1, "a b c " + "x y " * 20 + "end"), (2, "q " * 30)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in periodic.periodic_runs(df).collect()}
    assert [tuple(x) for x in got[1].runs] == [(3, 40, 2)] and got[1].collapsed == "a b c x y end"
    assert [tuple(x) for x in got[2].runs] == [(0, 30, 1)] and got[2].collapsed == "q" and got[2].n_words == 30
