import numpy as np

from momentlake.llm import cotrain, queries
from tests.llm.edge import ROWS, edge_docs, no_docs

SF = "/root/testdata/sf0.1"


def tables(spark):
    return (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    test = {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    got = [(test[r.doc_id], r.kept, r.score) for r in cotrain.score_documents(docs, labels.where("doc_id % 3 <> 0")).collect() if r.doc_id in test]
    good, bad = [k for y, k, _ in got if y], [k for y, k, _ in got if not y]
    assert sum(good) >= 0.98 * len(good)
    assert sum(not k for k in bad) >= 0.85 * len(bad)
    # calibrated: among rows scored about p, about p are good
    for lo, hi in ((0.0, 0.2), (0.9, 1.01)):
        part = [(y, s) for y, _, s in got if lo <= s < hi]
        assert abs(np.mean([y for y, _ in part]) - np.mean([s for _, s in part])) < 0.12


def test_views_exchange_labels(spark):
    docs, labels = tables(spark)
    model = cotrain.learn(cotrain.features(docs), labels, max_labelled=1500, max_pool=3000)
    assert model.exchanged[1] > 0
    assert model.weights.shape == (3,)


def test_whole_table(spark):
    got = queries.op7_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == list(range(1000))
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got)


def test_edge(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(None, 1), (3, None)], "doc_id long, quality int")
    docs = edge_docs(spark, "score", "shape", "kept", "row")
    got = cotrain.score_documents(docs, labels).collect()
    assert sorted(r.doc_id or -1 for r in got) == sorted(r[0] or -1 for r in ROWS)
    none = cotrain.score_documents(docs.drop("lang", "source", "n_chars"), labels.limit(0)).collect()
    assert {r.score for r in none} == {1.0}
    assert cotrain.score_documents(no_docs(spark), labels).collect() == []
    kept = cotrain.filter_documents(docs, labels, threshold=0.0)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, docs.collect()))


def test_logistic_regression_finds_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    w = cotrain.logistic(x[:, None], y, ridge=1e-3)
    assert abs(w[0] - 2) < 0.25 and abs(w[1] + 1) < 0.2
