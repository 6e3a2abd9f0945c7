"""The distributed gradient steps equal plain ones."""

import numpy as np

from momentlake.operators.learning import learn_weights, logistic_importance

ROWS = [(f"s{i % 2}", float(i % 3 == 0), 1.0 if i % 4 else 0.5, {"a": i % 7 / 7, "b": i % 5 / 5}) for i in range(90)]
SCHEMA = "scope string, label double, weight double, features map<string,double>"


def plain(rows, steps):
    x = np.array([[f["a"], f["b"]] for *_, f in rows])
    y, sw = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    w, b, total = np.zeros(2), 0.0, sw.sum()
    for _ in range(steps):
        g = sw * (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y)
        w, b = w - 0.5 * (x.T @ g + 0.5 * w) / total, b - 0.5 * g.sum() / total
    return np.maximum(w, 0)


def test_gradient_steps(spark):
    got = {(r.scope, r.feature): r.imp for r in logistic_importance(spark.createDataFrame(ROWS, SCHEMA), ["a", "b"], steps=12).collect()}
    for s in ("s0", "s1"):
        want = plain([r for r in ROWS if r[0] == s], 12)
        assert np.allclose([got[s, "a"], got[s, "b"]], want)
    assert logistic_importance(spark.createDataFrame([], SCHEMA), ["a"]).collect() == []


def test_logistic_fit_from_thirty_ratings_on(spark):
    base = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "feature string, w double")
    few = spark.createDataFrame(ROWS[:40], SCHEMA)
    none = spark.createDataFrame([("s0", "a", 9.0), ("s0", "b", 0.0), ("s1", "a", 9.0), ("s1", "b", 0.0)], "scope string, feature string, imp double")
    many = spark.createDataFrame(ROWS, SCHEMA)
    a, b = ({(r.scope, r.feature): round(r.w, 9) for r in learn_weights(x, base, logistic=none).collect()} for x in (few, many))
    assert a["s0", "b"] > 0 and b["s0", "a"] > 0.85  # 17 and 39 in weight
