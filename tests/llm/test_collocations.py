import random
import re
from collections import Counter

import numpy as np
import pytest

from momentlake.llm import collocations, queries
from tests.compare import oracle, rows_of
from tests.llm.edge import ROWS, edge_docs, no_docs

SF = "/root/testdata/sf0.001"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, top):
    """Counts of all phrases by a plain loop, then the rules in whole numbers."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(5, len(w) - i) + 1):
                    p = tuple(w[i:i + k])
                    f.setdefault(lang, Counter())[p] += 1
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if a >= least}
        found = []
        for p, a in good.items():
            if len(p) < 2 or any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (good[p[:k]] * good[p[k:]]), k, good[p[:k]], good[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def plain(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = ["the", "of", "New", "york", "city", "hall", "é", "Ä", "a b", "x", "\x01", "zz"]
    rows = []
    for _ in range(300):
        t = ""
        for _ in range(rng.randint(0, 60)):
            t += rng.choice(words[:rng.choice([3, 6, 12])]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","])
        rows.append((rng.choice(["en", "en", "en", "de", None, "a b"]), t))
    rows += [("en", "new york city hall of fame " * 40)] * 5
    return rows


@pytest.mark.parametrize("block, task, rate", [(1 << 19, 1 << 21, 1024), (300, 200, 4), (40, 30, 1)])
def test_against_plain_counting(spark, corpus, monkeypatch, block, task, rate):
    """Small blocks and tasks: many bounds, so that most phrases lie across some of them."""
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
    monkeypatch.setattr(collocations, "TASK_SUFFIXES", task)
    monkeypatch.setattr(collocations, "SAMPLE_RATE", rate)
    monkeypatch.setattr(collocations, "CODED_WORDS", 5 if rate < 1024 else 1 << 17)
    monkeypatch.setattr(collocations, "COUNTED_WORDS", 3 if rate == 1 else 1 << 20)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(corpus)], "doc_id bigint, lang string, text string").repartition(3)
    assert plain(collocations.collocations(df, 20, 40)) == brute(corpus, 20, 40)


def test_whole_table_against_sql(spark):
    df = queries.op12_collocations(spark, SF)
    cur = oracle(SF).execute(queries.ORACLE["op12_collocations"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_edge(spark):
    df = edge_docs(spark, "phrase", "n", "k", "a", "suffix", "task")
    assert plain(collocations.collocations(df, 2, 50)) == brute([(r[2], r[1]) for r in ROWS], 2, 50)
    assert collocations.collocations(no_docs(spark)).collect() == []


def test_counts_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 1, 9 * 10**15), ("en", "b", 1, 10**15), ("en", "a b", 2, 10**15)], "lang string, phrase string, k int, f bigint")
    total = spark.createDataFrame([("en", 9 * 10**15)], "lang string, n bigint")
    (r,) = collocations.score_phrases(counts, total, 100).collect()
    assert r.score == 1000 * 10**15 * 9 * 10**15 // (9 * 10**15 * 10**15)


def test_quicksort_counts_partitions():
    rng = np.random.default_rng(3)
    keys, weight = rng.integers(1, 6, (4000, 3)).astype(np.int32), rng.integers(1, 4, 4000)
    keys[rng.random(4000) < 0.2, 2] = 0
    got = {(c, tuple(keys[row, :c + 1])): m for c, row, m in collocations.multikey_quicksort(keys, weight, 50)}
    want = Counter()
    for k, w in zip(keys.tolist(), weight.tolist()):
        for c in range(3):
            if k[c]:
                want[c, tuple(k[:c + 1])] += w
    low, high = min(map(tuple, keys.tolist())), max(map(tuple, keys.tolist()))
    assert got == {k: v for k, v in want.items() if v >= 50 or k[1] in (low[:k[0] + 1], high[:k[0] + 1])}
