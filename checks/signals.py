"""Audio signal queries."""

from pyspark.sql import functions as F

from checks import ctes, query
from checks.views import NEEDS, SQL_VIEWS, event_clips, prompts, table, windows_
from momentlake.operators import signals as G

_norm = lambda c: f"list_transform({c}, lambda x: x::DOUBLE / sqrt(list_sum(list_transform({c}, lambda y: y::DOUBLE*y))))"
_dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]*p[2]))"
SQL_VIEWS["sims"] = f"""SELECT w.media_id, w.vec_id, w.t_mid_ms, p.label, p.polarity, {_dot('w.v', 'p.v')} AS sim FROM (SELECT *, {_norm('embedding')} AS v FROM audio_windows) w,
   (SELECT *, {_norm('embedding')} AS v FROM prompts) p"""
NEEDS["sims"] = ["audio_windows", "prompts"]


def sims(spark, sf):
    return G.embedding_similarity(windows_(spark, sf), prompts(spark, sf)).drop("embedding")


@query("embedding_similarity", ctes("sims", then="SELECT vec_id, label, round(sim*1000000)::BIGINT AS sim FROM sims"))
def _(spark, sf):
    return G.all_similarities(windows_(spark, sf), prompts(spark, sf)).select("vec_id", "label", F.round(F.col("sim") * 1000000).cast("bigint").alias("sim"))


@query("prompt_group_max", ctes("sims", then="SELECT vec_id, arg_max(label, sim) FILTER (polarity = 'pos') AS best, arg_max(label, sim) FILTER (polarity = 'neg') AS worst FROM sims GROUP BY vec_id"))
def _(spark, sf):
    s = sims(spark, sf)
    return s.select("vec_id", G.prompt_group_max(s, "pos")["label"].alias("best"), G.prompt_group_max(s, "neg")["label"].alias("worst"))


SQL_VIEWS["gated"] = """SELECT * FROM (SELECT *, CASE WHEN p < 0.20 OR p - n < 0.06 THEN NULL WHEN n < 0.22 THEN hype
    WHEN risk >= greatest(0.45, hype*0.85) OR greatest(0, hype - risk*0.45) < 0.25 THEN NULL ELSE greatest(0, hype - risk*0.45) END AS out FROM (
    SELECT *, greatest(0, least(1, (p - 0.20)/0.28)) AS hype, greatest(0, least(1, (n - 0.22)/0.28)) AS risk FROM (
      SELECT media_id, vec_id, t_mid_ms, max(sim) FILTER (polarity = 'pos') AS p, max(sim) FILTER (polarity = 'neg') AS n, arg_max(label, sim) FILTER (polarity = 'pos') AS reason
      FROM sims GROUP BY ALL))) WHERE out IS NOT NULL"""
NEEDS["gated"] = ["sims"]


@query("zero_shot_gate", ctes("gated", then="SELECT vec_id, reason, round(out*1000000)::BIGINT AS hype FROM gated"))
def _(spark, sf):
    return G.zero_shot_gate(sims(spark, sf)).select("vec_id", "reason", F.round(F.col("hype") * 1000000).cast("bigint").alias("hype"))


TAGS = ["Cheering", "Laughter", "Gunshot, gunfire", "Speech", "Glass", "Shout", "Applause"]
_tags = "[" + ", ".join(repr(t) for t in TAGS) + "]"


@query("hype_from_tags", f"""
  WITH t AS (SELECT doc_id // 5 AS span_id, {_tags}[doc_id % 7 + 1] AS label, (n_chars % 97) / 100.0 AS prob FROM documents),
  g AS (SELECT span_id, CASE WHEN label IN ('Cheering', 'Applause') THEN 'crowd cheering' WHEN label = 'Laughter' THEN 'laughter' WHEN label = 'Shout' THEN 'excited shouting'
     WHEN label LIKE 'Gun%' THEN 'explosive action' WHEN label = 'Glass' THEN 'impact' END AS reason, max(prob)::DOUBLE AS p FROM t WHERE label <> 'Speech' GROUP BY 1, 2)
  SELECT span_id, round((1 - product(1 - p))*1000000)::BIGINT AS hype, max(p) AS top FROM g GROUP BY span_id""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    t = d.select(F.floor(F.col("doc_id") / 5).alias("span_id"), F.element_at(F.array(*[F.lit(x) for x in TAGS]), (F.col("doc_id") % 7 + 1).cast("int")).alias("label"),
                 (F.col("n_chars") % 97 / 100.0).alias("prob"))
    top = t.where("label != 'Speech'").groupBy("span_id").agg(F.max("prob").alias("top"))
    return G.hype_from_tags(t).join(top, "span_id").select("span_id", F.round(F.col("hype") * 1000000).cast("bigint").alias("hype"), "top")


@query("arousal", """SELECT doc_id // 5 AS span_id, round(least(1, coalesce(sum(n_chars % 97) FILTER (lang IN ('en', 'de')), 0) / 400.0)*1000000)::BIGINT AS arousal FROM documents GROUP BY 1""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    e = d.select(F.floor(F.col("doc_id") / 5).alias("span_id"), F.when(F.col("lang").isin("en", "de"), "x/Happy").otherwise("y/neutral").alias("label"), (F.col("n_chars") % 97 / 400.0).alias("prob"))
    return G.arousal(e).select("span_id", F.round(F.col("arousal") * 1000000).cast("bigint").alias("arousal"))


SQL_VIEWS["uframes"] = f"SELECT vec_id % 20 AS media_id, vec_id // 20 AS frame, {_norm('embedding')} AS vec FROM embeddings"


def frames(spark, sf):
    return table(spark, sf, "embeddings").select((F.col("vec_id") % 20).alias("media_id"), F.floor(F.col("vec_id") / 20).alias("frame"), G.unit(F.col("embedding")).alias("vec"))


@query("template_match", ctes("uframes", then=f"""
  , s AS (SELECT f.media_id, f.frame - c.i AS frame, avg({_dot('f.vec', 'c.vec')}) AS sim, count(*) AS n FROM uframes f, (SELECT frame - 4 AS i, vec FROM uframes WHERE media_id = 0 AND frame BETWEEN 4 AND 6) c GROUP BY ALL),
  h AS (SELECT * FROM s WHERE n = 3 AND frame >= 0 AND sim >= 0.1),
  k AS (SELECT media_id, list_reduce(list([{{'v': sim, 'f': frame}}] ORDER BY sim DESC, frame), lambda acc, c: CASE WHEN len(acc) < 24 AND len(list_filter(acc, lambda a: abs(a.f - c[1].f) < 5)) = 0
       THEN list_concat(acc, c) ELSE acc END, CAST([] AS STRUCT(v DOUBLE, f BIGINT)[])) AS kept FROM h GROUP BY media_id)
  SELECT media_id, unnest(list_transform(kept, lambda x: x.f)) AS frame FROM k"""))
def _(spark, sf):
    f = frames(spark, sf)
    cue = f.where("media_id = 0 and frame between 4 and 6").select(F.lit("cue").alias("label"), (F.col("frame") - 4).alias("i"), "vec")
    return G.template_match(f, cue, 0.1, 5).select("media_id", "frame")


@query("reaction_energy", ctes("uframes", then="""
  , d AS (SELECT media_id, frame // 10 AS c, frame, list_avg(list_transform(list_zip(vec, lag(vec) OVER (PARTITION BY media_id, frame // 10 ORDER BY frame)), lambda p: abs(p[1] - p[2]))) AS e FROM uframes)
  SELECT media_id || '-' || c AS clip_id, round(least(avg(e) FILTER (frame % 10 > 0)/0.5, 1.0)*1000000)::BIGINT AS reaction FROM d GROUP BY 1"""))
def _(spark, sf):
    f = frames(spark, sf).withColumn("t_ms", F.col("frame") * 100)
    c = f.select("media_id", F.floor(F.col("frame") / 10).alias("c")).distinct().select(
        "media_id", F.concat_ws("-", "media_id", "c").alias("clip_id"), (F.col("c") * 1000).alias("start_ms"), (F.col("c") * 1000 + 999).alias("end_ms"))
    return G.reaction_energy(f, c, 0.5).select("clip_id", F.round(F.col("reaction") * 1000000).cast("bigint").alias("reaction"))


@query("action_center", """SELECT vec_id, CASE WHEN s > 1e-6 THEN round(greatest(0.32, least(0.68, m/s/63.0))*1000000)::BIGINT END AS cx FROM (
   SELECT vec_id, sum(abs(e::DOUBLE)) AS s, sum(abs(e::DOUBLE)*(i - 1)) AS m FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE i > 8 GROUP BY vec_id)""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 20).alias("media_id"), F.col("vec_id").alias("clip_id"),
                                              F.transform("embedding", lambda x, i: F.when(i >= 8, F.abs(x.cast("double")))).alias("energies"))
    return G.action_center(e).select(F.col("clip_id").alias("vec_id"), F.round(F.col("cx") * 1000000).cast("bigint").alias("cx"))


@query("rms_envelope", """
  WITH s AS (SELECT vec_id % 20 AS media_id, (vec_id // 20)*64 + i - 1 AS k, e::DOUBLE AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)),
  n AS (SELECT media_id, greatest((count(*) - 80)//32, 0) AS n FROM s GROUP BY media_id)
  SELECT media_id, f AS frame, round(sqrt(avg(v*v) + 1e-9)*1000000)::BIGINT AS rms FROM (SELECT media_id, unnest(range(0, n)) AS f FROM n WHERE n >= 3) g JOIN s USING (media_id) WHERE k >= f*32 AND k < f*32 + 80 GROUP BY media_id, f""")
def _(spark, sf):
    p = table(spark, sf, "embeddings").select((F.col("vec_id") % 20).alias("media_id"), (F.floor(F.col("vec_id") / 20) * 64).alias("first_sample"), F.col("embedding").alias("samples"))
    return G.rms_envelope(p, 320).select("media_id", "frame", F.round(F.col("rms") * 1000000).cast("bigint").alias("rms"))


@query("zero_shot_events", ctes("gated", then="""
  , k AS (SELECT media_id, list_reduce(list([{'v': out, 't': t_mid_ms}] ORDER BY out DESC, t_mid_ms), lambda acc, c: CASE WHEN len(acc) < 24 AND len(list_filter(acc, lambda a: abs(a.t - c[1].t) < 150000)) = 0
       THEN list_concat(acc, c) ELSE acc END, CAST([] AS STRUCT(v DOUBLE, t BIGINT)[])) AS kept FROM gated GROUP BY media_id)
  SELECT media_id, unnest(list_transform(kept, lambda x: x.t)) AS t_mid_ms FROM k"""))
def _(spark, sf):
    from momentlake.operators.selection import nms_gap
    g = G.zero_shot_gate(sims(spark, sf))
    return nms_gap(g, "hype", 150_000, 24, t="t_mid_ms", tie=("t_mid_ms",)).select("media_id", "t_mid_ms")
