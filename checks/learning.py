"""Feedback and learning queries."""

from pyspark.sql import functions as F

from checks import ctes, query
from checks.views import NEEDS, SQL_VIEWS, event_clips, ratings, table, trims
from momentlake.operators import learning as L

KEYS = ["hook", "emotion", "clarity"]
BASE = [("hook", 0.5), ("emotion", 0.3), ("clarity", 0.2)]
SQL_VIEWS["rlong"] = " UNION ALL ".join(f"SELECT scope, label, weight, '{k}' AS feature, {k}::DOUBLE AS v FROM ratings" for k in KEYS)
NEEDS["rlong"] = ["ratings"]
SQL_VIEWS["fmeans"] = """SELECT scope, feature, sum(weight*v) FILTER (label >= 0.5) / sum(weight) FILTER (label >= 0.5) AS pos, sum(weight*v) FILTER (label < 0.5) / sum(weight) FILTER (label < 0.5) AS neg,
   sum(weight) AS n, count(*) FILTER (label >= 0.5) AS cp, count(*) FILTER (label < 0.5) AS cn FROM rlong GROUP BY scope, feature"""
NEEDS["fmeans"] = ["rlong"]


@query("weighted_feature_means", ctes("fmeans", then="SELECT scope, feature, round(pos*1000000)::BIGINT AS pos, round(neg*1000000)::BIGINT AS neg FROM fmeans"))
def _(spark, sf):
    return L.weighted_feature_means(ratings(spark, sf)).select("scope", "feature", *[F.round(F.col(c) * 1000000).cast("bigint").alias(c) for c in ("pos", "neg")])


SQL_VIEWS["importance"] = """SELECT scope, ['hook','emotion','clarity'][k] AS feature, greatest(c[k], 0) AS imp FROM (
  WITH r AS (SELECT scope, hook::DOUBLE AS x1, emotion::DOUBLE AS x2, clarity::DOUBLE AS x3, (label >= 0.5)::INT::DOUBLE AS y, weight::DOUBLE AS w FROM ratings),
  t AS (SELECT scope, list({'x1': x1, 'x2': x2, 'x3': x3, 'y': y, 'w': w}) AS rs, sum(w) AS tot FROM r GROUP BY scope),
  gd AS (SELECT scope, list_reduce(list_prepend([0.0, 0.0, 0.0, 0.0]::DOUBLE[], list_transform(range(0, 300), lambda i: []::DOUBLE[])), lambda c, i:
      [c[1] - 0.5*(list_sum(list_transform(rs, lambda q: q.w*(1/(1 + exp(-(q.x1*c[1] + q.x2*c[2] + q.x3*c[3] + c[4]))) - q.y)*q.x1)) + 0.5*c[1])/tot,
       c[2] - 0.5*(list_sum(list_transform(rs, lambda q: q.w*(1/(1 + exp(-(q.x1*c[1] + q.x2*c[2] + q.x3*c[3] + c[4]))) - q.y)*q.x2)) + 0.5*c[2])/tot,
       c[3] - 0.5*(list_sum(list_transform(rs, lambda q: q.w*(1/(1 + exp(-(q.x1*c[1] + q.x2*c[2] + q.x3*c[3] + c[4]))) - q.y)*q.x3)) + 0.5*c[3])/tot,
       c[4] - 0.5*list_sum(list_transform(rs, lambda q: q.w*(1/(1 + exp(-(q.x1*c[1] + q.x2*c[2] + q.x3*c[3] + c[4]))) - q.y)))/tot]) AS c FROM t)
  SELECT * FROM gd), range(1, 4) s(k)"""
NEEDS["importance"] = ["ratings"]


SQL_VIEWS["learned"] = """SELECT scope, feature, CASE WHEN n >= 1 AND s > 1e-9 AND cp > 0 THEN mix * sum(w0) OVER (PARTITION BY scope) / sum(mix) OVER (PARTITION BY scope) ELSE w0 END AS w FROM (
  SELECT *, (1 - n/(n + 8.0))*w0 + n/(n + 8.0)*imp/s AS mix FROM (
    SELECT *, sum(imp) OVER (PARTITION BY scope) AS s FROM (
      SELECT fmeans.*, CASE feature WHEN 'hook' THEN 0.5 WHEN 'emotion' THEN 0.3 ELSE 0.2 END AS w0,
        CASE WHEN cp > 0 AND cn > 0 AND n >= 30 AND sum(importance.imp) OVER (PARTITION BY scope) > 1e-6 THEN importance.imp WHEN cp > 0 AND cn > 0 THEN greatest(pos - neg, 0) WHEN cp > 0 THEN greatest(pos - 0.4, 0) ELSE 0 END AS imp FROM fmeans JOIN importance USING (scope, feature))))"""
NEEDS["learned"] = ["fmeans", "importance"]


def base(spark):
    return spark.createDataFrame(BASE, "feature string, w double")


@query("learn_weights", ctes("learned", then="SELECT scope, feature, round(w*1000000)::BIGINT AS w FROM learned"))
def _(spark, sf):
    return L.learn_weights(ratings(spark, sf), base(spark)).select("scope", "feature", F.round(F.col("w") * 1000000).cast("bigint").alias("w"))




@query("logistic_importance", ctes("importance", then="SELECT scope, feature, round(imp*100000)::BIGINT AS imp FROM importance"))
def _(spark, sf):
    return L.logistic_importance(ratings(spark, sf), KEYS).select("scope", "feature", F.round(F.col("imp") * 100000).cast("bigint").alias("imp"))


@query("boundary_correction", ctes("trims", then="SELECT scope, round_even(greatest(-3000, least(3000, 0.8*median(ds_ms))), 0)::BIGINT AS ds_ms, round_even(greatest(-3000, least(3000, 0.8*median(de_ms))), 0)::BIGINT AS de_ms FROM trims GROUP BY scope"))
def _(spark, sf):
    return L.boundary_correction(trims(spark, sf))


@query("apply_boundaries", ctes("event_clips", then="""
  SELECT clip_id, CASE WHEN ok THEN a ELSE start_ms END AS start_ms, CASE WHEN ok THEN b ELSE end_ms END AS end_ms FROM (
   SELECT *, greatest(start_ms + s, 0) AS a, end_ms + e AS b, end_ms + e - greatest(start_ms + s, 0) >= 10000 AS ok FROM (
     SELECT *, CASE kind WHEN 'cue' THEN 3000 WHEN 'ocr' THEN -800 ELSE 0 END AS s, CASE kind WHEN 'cue' THEN -3000 WHEN 'ocr' THEN 400 ELSE 0 END AS e FROM event_clips))"""))
def _(spark, sf):
    c = event_clips(spark, sf).withColumns({"scope": F.col("kind"), "min_len_ms": F.lit(20000)})
    sh = spark.createDataFrame([("cue", 3000, -3000), ("ocr", -800, 400)], "scope string, ds_ms bigint, de_ms bigint")
    return L.apply_boundaries(c, sh).select("clip_id", "start_ms", "end_ms")


@query("learning_overview", ctes("learned", "ratings", "trims", then="""
  SELECT scope, count(*) AS ratings, count(*) FILTER (label >= 0.5) AS likes, count(*) FILTER (label < 0.5) AS dislikes, any_value(t.n) AS trims, any_value(top) AS top FROM ratings
  JOIN (SELECT scope, count(*) AS n FROM trims GROUP BY scope) t USING (scope) JOIN (SELECT scope, string_agg(feature, ',' ORDER BY w DESC, feature) AS top FROM learned GROUP BY scope) l USING (scope) GROUP BY scope"""))
def _(spark, sf):
    r = ratings(spark, sf)
    return L.learning_overview(r, trims(spark, sf), L.learn_weights(r, base(spark)))
