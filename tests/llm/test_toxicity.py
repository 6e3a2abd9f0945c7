import random
import zlib

import numpy as np

from momentlake.llm import queries, toxicity
from tests.llm.edge import ROWS, edge_docs, no_docs

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_held_out_rows(spark):
    got = queries.op3_toxicity(spark, LARGER).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    test = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p for y, p in test if y) >= 0.85 * sum(y for y, _ in test)
    assert sum(p for y, p in test if not y) <= 0.02 * len(test)


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score_documents(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_block_max_is_exact():
    rng, dim = random.Random(4), 60
    def vector():
        raw = {rng.randrange(dim): rng.random() for _ in range(rng.randrange(0, 7))}
        size = sum(w * w for w in raw.values()) ** 0.5 or 1
        return sorted((t, w / size) for t, w in raw.items())
    vectors = [vector() for _ in range(700)] + [[(3, 1.0)]] * 90
    index = toxicity.BlockMaxIndex(vectors, dim)
    dense = np.zeros((len(vectors), dim))
    for e, v in enumerate(vectors):
        for t, w in v:
            dense[e, t] = w
    for q in [vector() for _ in range(60)] + [[(3, 1.0)]]:
        x = np.zeros(dim)
        for t, w in q:
            x[t] = w
        sims = np.round(dense @ x, 12)
        want = sorted((-s, e) for e, s in enumerate(sims) if s > 0)[:15]
        assert [e for _, e in index.nearest(q, 15)] == [e for _, e in want]


def test_rare_words_find_copies(spark):
    rows = [(i, f"plain words about gardens number{i}", 0) for i in range(40)] + [(100 + i, f"common insult{i} once{i}", 1) for i in range(12)]
    texts = {d: t for d, t, _ in rows}
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([(d, t) for d, t in texts.items()] + [(1000 + d, t) for d, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    for d, y in ((d, y) for d, _, y in rows if zlib.crc32(str(d).encode()) % 4 != 2):
        r = got[1000 + d]
        assert r.evidence[0] == d and abs(r.similarity[0] - 1) < 1e-9, (d, r)


def test_monotone():
    x, y = toxicity.monotone([0.1, 0.2, 0.3, 0.3, 0.9], np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert y == sorted(y) and x == sorted(x) and y[0] == 0 and y[-1] == 1


def test_edge(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 1), (7, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    got = toxicity.score_documents(edge_docs(spark, "score", "terms", "toxic"), labels).collect()
    assert sorted(r.doc_id or -1 for r in got) == sorted(r[0] or -1 for r in ROWS)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.score_documents(edge_docs(spark), labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_documents(no_docs(spark), labels).collect() == []


def test_counts_by_number():
    texts = ["", "İstanbul Straße straßen STRASSE, the the the", "a_b1 ab", "ΟΔΟΣ οδος Σ", "... \n", "longerword longerwood longe longe longer", "unknown words only"]
    number = {t: i for i, t in enumerate(sorted({t for x in texts[:-1] for t in toxicity.term_counts(x)}, reverse=True))}
    terms, counts = toxicity.numbered_counts(texts, number)
    for text, t, n in zip(texts, terms.to_pylist(), counts.to_pylist(), strict=True):
        assert t == sorted(t) and dict(zip(t, n)) == {number[w]: k for w, k in toxicity.term_counts(text).items() if w in number}
    assert [x.to_pylist() for x in toxicity.numbered_counts([], number)] == [[], []]


def test_words_are_looked_up_once():
    """A word that many texts have costs one look-up for all of them, and the driver's model makes no index."""
    class Asked(dict):
        n = 0
        def get(self, *x):
            Asked.n += 1
            return super().get(*x)
    number = Asked(common=0, **{"commo*": 1})
    terms, counts = toxicity.numbered_counts(["common " * 5] * 200, number)
    assert Asked.n == 2 and set(map(tuple, terms.to_pylist())) == {(0, 1)} and set(map(tuple, counts.to_pylist())) == {(5, 5)}
    made = toxicity.pa.table({"doc_id": [1, 2], "toxic": toxicity.pa.array([0, 1], "int32"), "terms": toxicity.pa.array([[0, 1], [1]], toxicity.pa.list_(toxicity.pa.int32())), "counts": toxicity.pa.array([[2, 1], [3]], toxicity.pa.list_(toxicity.pa.int32()))})
    model = toxicity.Model(made, np.ones(2), 2, 15, 0.5)
    assert "index" not in model.__dict__ and model.index.n == 2
