"""Weights and boundaries learned from ratings and trims."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from momentlake.skew import durable, top_k

STEP_ROWS = 100_000


def _kept(label="label"):
    return F.col(label) >= 0.5


def weighted_feature_means(feedback: DataFrame) -> DataFrame:
    """Weighted mean of each feature over kept and rejected clips, per scope; a missing feature is 0."""
    tot = feedback.groupBy("scope").agg(
        F.sum("weight").alias("n"), F.sum(F.when(_kept(), F.col("weight")).otherwise(0.0)).alias("n_pos"),
        F.sum(F.when(~_kept(), F.col("weight")).otherwise(0.0)).alias("n_neg"),
        F.count_if(_kept()).alias("c_pos"), F.count_if(~_kept()).alias("c_neg"))
    x = feedback.select("scope", "weight", _kept().alias("k"), F.explode("features").alias("feature", "v"))
    s = x.groupBy("scope", "feature").agg(
        F.sum(F.when(F.col("k"), F.col("weight") * F.col("v")).otherwise(0.0)).alias("sp"),
        F.sum(F.when(~F.col("k"), F.col("weight") * F.col("v")).otherwise(0.0)).alias("sn"))
    return s.join(tot, "scope").select("scope", "feature", F.try_divide("sp", "n_pos").alias("pos"), F.try_divide("sn", "n_neg").alias("neg"),
                                       "n", "c_pos", "c_neg")


def logistic_importance(feedback: DataFrame, keys: Sequence[str], steps: int = 300, lam: float = 0.5, lr: float = 0.5) -> DataFrame:
    """Positive part of the coefficients of a weighted, regularised logistic regression per scope.

    Ratings are merged by feature vector into a durable table. A gradient step for all scopes is one pass over it
    without a shuffle: each task sums its rows, and one row of scopes times features per task comes to the driver.
    """
    vec = F.array(*[F.coalesce(F.element_at("features", k), F.lit(0.0)).cast("double") for k in keys])
    d = durable(feedback.where("scope is not null").groupBy("scope", vec.alias("x"), _kept().cast("double").alias("y")).agg(F.sum("weight").alias("w")))
    d = d.coalesce(-(-max(d.count(), 1) // STEP_ROWS))  # a step is short: no more tasks than its rows need
    m, totals = len(keys), sorted((r.scope, max(r.t or 0.0, 1e-9)) for r in d.groupBy("scope").agg(F.sum("w").alias("t")).collect())
    number, total = {s: i for i, (s, _) in enumerate(totals)}, np.array([[t] for _, t in totals])
    coef = np.zeros((len(totals), m + 1))

    def gradient(coef):
        def run(batches):
            acc = np.zeros_like(coef)
            for b in batches:
                s = np.array([number[x] for x in b.column("scope").to_pylist()], np.int64)
                x = np.asarray(b.column("x").flatten()).reshape(len(s), m)
                z = np.clip((x * coef[s, :m]).sum(axis=1) + coef[s, m], -30, 30)
                g = np.asarray(b.column("w")) * (1.0 / (1.0 + np.exp(-z)) - np.asarray(b.column("y")))
                np.add.at(acc, s, np.column_stack([x * g[:, None], g]))
            yield pa.RecordBatch.from_arrays([pa.array([acc.ravel().tolist()], pa.list_(pa.float64()))], ["g"])
        return sum((np.array(r.g) for r in d.mapInArrow(run, "g array<double>").collect()), np.zeros(coef.size)).reshape(coef.shape)

    for _ in range(steps if len(totals) else 0):
        coef = coef - lr * (gradient(coef) + lam * np.column_stack([coef[:, :m], np.zeros(len(totals))])) / total
    found = [(s, k, float(max(coef[i, j], 0.0))) for s, i in number.items() for j, k in enumerate(keys)]
    return feedback.sparkSession.createDataFrame(found, "scope string, feature string, imp double")


def learn_weights(feedback: DataFrame, base: DataFrame, k: float = 8.0, baseline: float = 0.4, logistic_min: float = 30.0,
                  logistic: DataFrame | None = None) -> DataFrame:
    """Blend learned importances into ``base(feature, w)`` per scope.

    Kept against rejected means; kept only minus ``baseline``; the logistic fit (made here unless given) once both
    classes exist and the weights reach ``logistic_min``. Too little data leaves the base.
    """
    if logistic is None:  # the base has one row per feature
        logistic = logistic_importance(feedback, [r.feature for r in base.select("feature").distinct().orderBy("feature").collect()])
    means = weighted_feature_means(feedback)
    scopes = feedback.groupBy("scope").agg(F.sum("weight").alias("n"), F.count_if(_kept()).alias("c_pos"), F.count_if(~_kept()).alias("c_neg"))
    table = base.groupBy().agg(F.collect_list(F.struct("feature", "w"))).scalar()
    g = scopes.withColumn("_b", F.explode(table)).select("scope", "n", "c_pos", "c_neg", F.col("_b.feature").alias("feature"), F.col("_b.w").alias("w0"))
    g = g.join(means.select("scope", "feature", "pos", "neg"), ["scope", "feature"], "left")
    pos, neg = F.coalesce("pos", F.lit(0.0)), F.coalesce("neg", F.lit(0.0))
    imp = F.when((F.col("c_pos") > 0) & (F.col("c_neg") > 0), F.greatest(pos - neg, F.lit(0.0))).when(
        F.col("c_pos") > 0, F.greatest(pos - baseline, F.lit(0.0))).otherwise(0.0)
    usable = logistic.groupBy("scope").agg(F.sum("imp").alias("_t")).where("_t > 1e-6").select("scope", F.lit(True).alias("_ok"))
    g = g.join(logistic, ["scope", "feature"], "left").join(usable, "scope", "left")
    use = (F.col("c_pos") > 0) & (F.col("c_neg") > 0) & (F.col("n") >= logistic_min) & F.coalesce("_ok", F.lit(False))
    imp = F.when(use, F.coalesce("imp", F.lit(0.0))).otherwise(imp)
    per = W.partitionBy("scope")  # a scope has one row per feature here
    g = g.withColumn("_imp", imp).withColumn("_s", F.sum("_imp").over(per))
    alpha = F.col("n") / (F.col("n") + k)
    g = g.withColumn("_mix", (1 - alpha) * F.col("w0") + alpha * F.try_divide("_imp", "_s"))
    g = g.withColumn("_scale", F.sum("w0").over(per) / F.sum("_mix").over(per))
    learned = (F.col("n") >= 1) & (F.col("_s") > 1e-9) & (F.col("c_pos") > 0)
    return g.select("scope", "feature", F.when(learned, F.col("_mix") * F.col("_scale")).otherwise(F.col("w0")).alias("w"))


def boundary_correction(trims: DataFrame, min_n: int = 3, damp: float = 0.8, cap_ms: int = 3000) -> DataFrame:
    """Median trim per scope, damped and capped. Trims beyond 30 s are not recorded, so a scope
    has at most 60001 distinct values per side."""
    t = trims.where((F.abs("ds_ms") <= 30000) & (F.abs("de_ms") <= 30000))
    g = t.groupBy("scope").agg(F.count("*").alias("n"), F.percentile("ds_ms", F.lit(0.5)).alias("a"), F.percentile("de_ms", F.lit(0.5)).alias("b"))

    def shift(c):
        v = F.greatest(F.lit(-float(cap_ms)), F.least(F.lit(float(cap_ms)), F.col(c) * damp))
        return F.when(F.col("n") >= min_n, F.bround(v, 0)).otherwise(0).cast("bigint")
    return g.select("scope", shift("a").alias("ds_ms"), shift("b").alias("de_ms"))


def apply_boundaries(clips: DataFrame, shifts: DataFrame) -> DataFrame:
    """Shift raw bounds where the clip stays long enough; ``clips`` carry scope and min_len_ms."""
    c = clips.join(shifts, "scope", "left")
    a = F.greatest(F.col("start_ms") + F.coalesce("ds_ms", F.lit(0)), F.lit(0))
    b = F.col("end_ms") + F.coalesce("de_ms", F.lit(0))
    ok = b - a >= F.greatest(F.col("min_len_ms") * 0.5, F.lit(1000))
    return c.withColumns({"_a": F.when(ok, a).otherwise(F.col("start_ms")), "_b": F.when(ok, b).otherwise(F.col("end_ms"))}).withColumns(
        {"start_ms": F.col("_a"), "end_ms": F.col("_b")}).select(*clips.columns)


def learning_overview(feedback: DataFrame, trims: DataFrame, weights: DataFrame) -> DataFrame:
    """Totals and the three strongest learned features per scope."""
    fb = feedback.groupBy("scope").agg(F.count("*").alias("ratings"), F.count_if(_kept()).alias("likes"), F.count_if(~_kept()).alias("dislikes"))
    tr = trims.groupBy("scope").agg(F.count("*").alias("trims"))
    top = top_k(weights, ["scope"], [F.desc("w"), F.col("feature")], 3, out="r").groupBy("scope").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "feature"))), lambda x: x["feature"]), ",").alias("top"))
    return fb.join(tr, "scope", "full").join(top, "scope", "left").na.fill(0, ["ratings", "likes", "dislikes", "trims"])
