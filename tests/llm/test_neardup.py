import random
import re

import numpy as np

from momentlake.llm import neardup, queries
from tests.llm.edge import edge_docs, no_docs

SF = "/root/testdata/sf0.001"


def sets(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent=80):
    s = [sets(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i))
        out.append((d, len(s[i]), c, c is None if d is None or c is None else d == c))
    return sorted(out, key=repr)


def as_rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert as_rows(queries.op4_near_duplicates(spark, SF)) == brute(rows, 4)


def test_edge(spark):
    rows = [(r.doc_id, r.text) for r in edge_docs(spark).collect()]
    assert as_rows(neardup.near_duplicates(edge_docs(spark, "label", "cid", "th"), width=4)) == brute(rows, 4)
    assert neardup.near_duplicates(no_docs(spark)).collect() == []


def test_chains_and_large_groups(spark):
    """Near copies that drift: neighbours are linked, ends are not, and one group holds most rows."""
    rng, rows = random.Random(1), []
    vocab = [f"w{i}" for i in range(3000)]
    for g in range(4):
        words = [rng.choice(vocab) for _ in range(80)]
        for k in range(60 if g == 0 else 12):
            if k and rng.random() < 0.8:
                words = list(words)
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(words)))
    rows += [(1000 + i, " ".join(rng.choice(vocab) for _ in range(60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4)
    assert as_rows(neardup.near_duplicates(df, width=4)) == want
    assert as_rows(neardup.near_duplicates(df, width=4, tile_rows=5)) == want


def test_borderline_group_by_tiles(spark):
    """Copies with many edits share buckets, but only some are linked."""
    rng, rows = random.Random(9), []
    first = [f"w{rng.randrange(5000)}" for _ in range(120)]
    for k in range(90):
        words = list(first)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4)
    assert 1 < len({r[2] for r in want}) < 90
    for n in (7, 30, 512):
        assert as_rows(neardup.near_duplicates(df, width=4, tile_rows=n)) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 100)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(41), 100, 200, 300]}, **{i: 500 for i in range(500, 560)}}


def test_sequential_test_keeps_what_is_similar():
    least = neardup.least_matches(80, 1e-6)
    assert list(least) == sorted(least) and least[-1] < 0.8 * neardup.HASHES
    rng = np.random.default_rng(0)
    for n, m in zip(range(neardup.BATCH, neardup.HASHES + 1, neardup.BATCH), least, strict=True):
        assert (rng.binomial(n, 0.8, 100_000) < m).mean() < 1e-4


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    got = []
    for _ in range(200):
        u = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
        got.append((neardup.signature(u[:900]) == neardup.signature(u[100:])).mean())
    assert abs(np.mean(got) - 0.8) < 0.01
