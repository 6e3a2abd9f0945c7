"""Detector event queries."""

from pyspark.sql import functions as F

from checks import ctes, query
from checks.views import NEEDS, SQL_VIEWS, detections, envelope, event_clips, event_media, peaks, sql_values, text_reads
from momentlake.functions.dictionaries import GAME_PROFILES, GAME_WEIGHTS
from momentlake.operators import events as E
from momentlake.operators import selection as S
from momentlake.plans import finish, gameplay

CHAIN = ["purchase", "signup"]
_fam = "CASE WHEN label IN ('purchase','signup') THEN 'A' WHEN label IN ('click','view') THEN 'B' ELSE label END"


def fam_events(spark, sf):
    """Detections whose labels fall into two families and a menu label."""
    d = detections(spark, sf)
    lab = (F.when(F.col("label") == "purchase", "headshot").when(F.col("label") == "signup", "kill")
           .when(F.col("label") == "click", "victory").when(F.col("label") == "view", "round win").otherwise("menu"))
    return d.withColumn("label", lab)


SQL_VIEWS["fam_events"] = """SELECT * REPLACE (CASE label WHEN 'purchase' THEN 'headshot' WHEN 'signup' THEN 'kill' WHEN 'click' THEN 'victory' WHEN 'view' THEN 'round win' ELSE 'menu' END AS label),
   CASE WHEN label IN ('purchase','signup') THEN 'kill' WHEN label IN ('click','view') THEN 'round' ELSE 'menu' END AS family FROM detections"""
NEEDS["fam_events"] = ["detections"]


@query("union_detections", ctes("detections", then="SELECT media_id, source, count(*) AS n, CAST(sum(t_ms) AS BIGINT) AS t, max(CASE WHEN source = 'cue' THEN label || ' sound' ELSE detail END) AS d FROM detections GROUP BY media_id, source"))
def _(spark, sf):
    d = detections(spark, sf)
    u = E.union_detections(*[d.where(F.col("source") == s) for s in ("cue", "ocr", "audio")])
    return u.groupBy("media_id", "source").agg(F.count("*").alias("n"), F.sum("t_ms").alias("t"), F.max("detail").alias("d"))


@query("event_family", ctes("fam_events", then="SELECT media_id, family, count(*) AS n FROM fam_events GROUP BY media_id, family"))
def _(spark, sf):
    return fam_events(spark, sf).groupBy("media_id", E.event_family("label").alias("family")).agg(F.count("*").alias("n"))


@query("menu_predicate", ctes("fam_events", then="SELECT media_id, count(*) FILTER (label = 'menu') AS menus, count(*) AS n FROM fam_events GROUP BY media_id"))
def _(spark, sf):
    return fam_events(spark, sf).groupBy("media_id").agg(F.count_if(E.menu_predicate()).alias("menus"), F.count("*").alias("n"))


SQL_VIEWS["streaks"] = """
  SELECT *, first_idx + (idx - first_idx)//5*5 AS streak FROM (
    SELECT *, min(idx) OVER (PARTITION BY media_id, isl) AS first_idx FROM (
      SELECT *, sum(brk) OVER (PARTITION BY media_id ORDER BY t_ms, event_id) AS isl FROM (
        SELECT *, row_number() OVER w - 1 AS idx, CASE WHEN t_ms - lag(t_ms) OVER w <= 6000 AND (lag(label) OVER w = label OR
           (lag(label) OVER w IN ('kill','headshot') AND label IN ('kill','headshot'))) THEN 0 ELSE 1 END AS brk
        FROM fam_events WHERE source = 'cue' WINDOW w AS (PARTITION BY media_id ORDER BY t_ms, event_id))))"""
NEEDS["streaks"] = ["fam_events"]


@query("group_streaks", ctes("streaks", then="SELECT media_id, event_id, streak FROM streaks"))
def _(spark, sf):
    return E.group_streaks(fam_events(spark, sf).where("source = 'cue'"), chunk_ms=300_000).select("media_id", "event_id", "streak")


@query("dedupe_events", ctes("detections", then="""
  , o AS (SELECT media_id, list_reduce(list([t_ms] ORDER BY t_ms, event_id), lambda acc, c: CASE WHEN len(acc) = 0 OR c[1] - acc[len(acc)] >= 4000 THEN list_concat(acc, c) ELSE acc END,
        CAST([] AS BIGINT[])) AS anchors FROM detections WHERE source = 'ocr' GROUP BY media_id),
  g AS (SELECT d.*, len(list_filter(anchors, lambda a: a <= d.t_ms)) AS grp FROM detections d JOIN o USING (media_id) WHERE source = 'ocr'),
  r AS (SELECT *, row_number() OVER (PARTITION BY media_id, grp, label ORDER BY confidence DESC, t_ms, event_id) AS rn FROM g)
  SELECT media_id, event_id, t_ms, label FROM r WHERE rn = 1"""))
def _(spark, sf):
    return E.dedupe_events(detections(spark, sf).where("source = 'ocr'"), chunk_ms=120_000).select("media_id", "event_id", "t_ms", "label")


@query("suppress_near_menu", ctes("fam_events", then="""SELECT event_id FROM fam_events e WHERE source <> 'audio' OR NOT EXISTS (
   SELECT 1 FROM fam_events m WHERE m.media_id = e.media_id AND m.source = 'ocr' AND m.label = 'menu' AND abs(m.t_ms - e.t_ms) <= 5000)"""))
def _(spark, sf):
    return E.suppress_near_menu(fam_events(spark, sf)).select("event_id")


SQL_VIEWS["support"] = """
  SELECT DISTINCT c.media_id, c.clip_id, e.event_id, e.source, e.label, e.family, e.t_ms, e.confidence FROM (
    SELECT *, unnest(list_distinct(list_concat([peak_ms], cue_times))) AS a FROM event_clips) c
  JOIN fam_events e ON e.media_id = c.media_id AND e.t_ms BETWEEN c.start_ms AND c.end_ms AND abs(e.t_ms - c.a) <= 3000"""
NEEDS["support"] = ["event_clips", "fam_events"]


@query("corroborate", ctes("support", "event_clips", then="""
  , f AS (SELECT clip_id, family, count(*) FILTER (source = 'cue') AS c, count(*) FILTER (source = 'ocr') AS o, count(*) FILTER (source = 'audio') AS a FROM support GROUP BY clip_id, family),
  g AS (SELECT clip_id, sum(c) AS nc, coalesce(sum(o) FILTER (c > 0), 0) AS nm, sum(o) AS no, sum(a) AS na FROM f GROUP BY clip_id)
  SELECT c.clip_id, CAST(CASE WHEN nc > 0 AND nm > 0 THEN least(99, score + least(14, 6 + 2*greatest(nc + nm + na - 2, 0) + 2*(na > 0)::INT))
     WHEN nc = 0 AND no > 0 AND na > 0 AND score < 89 THEN least(89, score + 3) ELSE score END AS INT) AS score FROM event_clips c LEFT JOIN g USING (clip_id)"""))
def _(spark, sf):
    return E.corroborate(event_clips(spark, sf), fam_events(spark, sf)).select("clip_id", "score")


@query("accepted_events", ctes("support", "event_clips", then="""
  , k AS (SELECT s.*, kind = 'cue' AS has_cue, score % 2 = 0 AS has_ocr, score % 3 = 0 AS has_audio,
     bool_or(s.source = 'ocr') OVER (PARTITION BY s.clip_id, s.family) AS txt FROM support s JOIN event_clips c USING (clip_id))
  SELECT min(event_id) AS event_id FROM k WHERE (source = 'cue' AND has_cue AND (NOT has_ocr OR txt)) OR (source = 'ocr' AND has_ocr) OR (source = 'audio' AND has_audio)
  GROUP BY media_id, source, label, t_ms"""))
def _(spark, sf):
    c = event_clips(spark, sf).withColumns({"has_cue": F.col("kind") == "cue", "has_ocr": F.col("score") % 2 == 0, "has_audio": F.col("score") % 3 == 0})
    return E.accepted_events(fam_events(spark, sf), c).select("event_id")


@query("pending_cue_labels", ctes("detections", then="SELECT media_id, label, min(t_ms) AS t_ms FROM detections WHERE source = 'ocr' AND label NOT IN ('view', 'click') GROUP BY media_id, label"))
def _(spark, sf):
    d = detections(spark, sf)
    have = d.where("source = 'cue' and label in ('view', 'click')").select(F.concat(F.lit("auto_"), "label").alias("label")).distinct()
    return E.pending_cue_labels(d, have)


# ---- clip builders ------------------------------------------------------------------------------
SQL_VIEWS["gprof"] = sql_values([(g, p[0] / 100.0, p[1], p[2], *GAME_WEIGHTS[g]) for g, p in GAME_PROFILES.items()], "game, thr_pct, gap_factor, lead_frac, wi, ws, wt, wp")
SQL_VIEWS["timed"] = """SELECT m.*, thr_pct, gap_factor, wi, ws, wt, wp, 20000*lead_frac AS lead, 20000 - 20000*lead_frac AS tail FROM event_media m
   JOIN gprof ON game = CASE WHEN game_profile = 'league' THEN 'generic' ELSE game_profile END"""
NEEDS["timed"] = ["event_media", "gprof"]


@query("timing_window", ctes("timed", then="SELECT media_id, round(lead)::BIGINT AS lead, round(tail)::BIGINT AS tail FROM timed"))
def _(spark, sf):
    return E.timing_window(event_media(spark, sf)).select("media_id", F.round("lead").cast("bigint").alias("lead"), F.round("tail").cast("bigint").alias("tail"))


@query("cue_clips", ctes("streaks", "timed", then="""
  , g AS (SELECT media_id, streak, min(t_ms) AS t0, max(t_ms) AS t1, count(*) AS n, max(confidence) AS sim, arg_min(label, t_ms*1000000 + event_id) AS lab, count(DISTINCT label) AS kinds FROM streaks GROUP BY media_id, streak),
  a AS (SELECT g.*, greatest(0, t0 - lead) AS s, least(duration_ms, t1 + tail) AS e, min_len_ms, max_len_ms FROM g JOIN timed USING (media_id)),
  b AS (SELECT * REPLACE (CASE WHEN e - s < min_len_ms THEN greatest(0, e - min_len_ms) ELSE s END AS s) FROM a),
  c AS (SELECT * REPLACE (CASE WHEN e - s > max_len_ms THEN greatest(t0 - 2000, e - max_len_ms) ELSE s END AS s) FROM b)
  SELECT media_id, round_even(s, 0)::BIGINT AS start_ms, round_even(e, 0)::BIGINT AS end_ms, greatest(1, least(88, round_even(58 + greatest(0, sim - 0.84)*120 + (n-1)*4, 0)))::INT AS score,
    CASE WHEN n = 1 THEN w WHEN kinds = 1 THEN ['','Double','Triple','Quad','Penta'][n] || ' ' || w ELSE w || ' + ' || (n-1) || ' cues' END || ' — ' || printf('%d:%02d', t0//60000, t0%60000//1000) AS title
  FROM (SELECT *, CASE lab WHEN 'round win' THEN 'Round Win' ELSE upper(lab[1]) || lab[2:] END AS w FROM c)"""))
def _(spark, sf):
    return E.cue_clips(fam_events(spark, sf), event_media(spark, sf)).select("media_id", "start_ms", "end_ms", "score", "title")


_win = """SELECT d.*, greatest(0, t_ms - lead) AS s, least(duration_ms, t_ms + tail) AS e, min_len_ms FROM fam_events d JOIN timed USING (media_id)"""


def _point_sql(src, base, mult, cond):
    return f""", a AS ({_win} WHERE source = '{src}' AND {cond})
      SELECT media_id, round_even(CASE WHEN e - s < min_len_ms THEN greatest(0, e - min_len_ms) ELSE s END, 0)::BIGINT AS start_ms, round_even(e, 0)::BIGINT AS end_ms,
        t_ms AS peak_ms, greatest(1, least(99, round_even({base} + confidence*{mult}, 0)))::INT AS score FROM a"""


@query("text_clips", ctes("fam_events", "timed", then=_point_sql("ocr", 68, 20, "label <> 'menu'")))
def _(spark, sf):
    return E.text_clips(fam_events(spark, sf), event_media(spark, sf)).select("media_id", "start_ms", "end_ms", "peak_ms", "score")


@query("audio_event_clips", ctes("fam_events", "timed", then=_point_sql("audio", 62, 24, "true")))
def _(spark, sf):
    return E.audio_event_clips(fam_events(spark, sf), event_media(spark, sf)).select("media_id", "start_ms", "end_ms", "peak_ms", "score")


SQL_VIEWS["thr"] = """SELECT media_id, quantile_cont(rms, 0.4) AS flo, max(pp) AS p, CASE max(pp) WHEN 0.8 THEN quantile_cont(rms, 0.8) ELSE quantile_cont(rms, 0.82) END AS thr
   FROM (SELECT e.*, thr_pct AS pp FROM envelope e JOIN timed USING (media_id)) GROUP BY media_id"""
NEEDS["thr"] = ["envelope", "timed"]


@query("loudness_thresholds", ctes("thr", then="SELECT media_id, round(thr*10000)::BIGINT AS thr, round(flo*10000)::BIGINT AS flo FROM thr"))
def _(spark, sf):
    return E.loudness_thresholds(envelope(spark, sf), event_media(spark, sf), 0.1).select(
        "media_id", F.round(F.col("thr") * 10000).cast("bigint").alias("thr"), F.round(F.col("floor") * 10000).cast("bigint").alias("flo"))


@query("peak_intensity", ctes("peaks", "envelope", then="""SELECT clip_id, round(i*1000000)::BIGINT AS intensity FROM peaks p JOIN (
   SELECT media_id, frame, cume_dist() OVER (PARTITION BY media_id ORDER BY rms) AS i FROM envelope) e ON e.media_id = p.media_id AND e.frame = p.peak_frame"""))
def _(spark, sf):
    return E.peak_intensity(envelope(spark, sf), peaks(spark, sf), 0.1).select("clip_id", F.round(F.col("intensity") * 1000000).cast("bigint").alias("intensity"))


SQL_VIEWS["shape"] = """SELECT p.media_id, p.clip_id,
   avg((rms > thr)::INT) FILTER (frame >= w0 AND frame < w1) AS sustain,
   count(*) FILTER (frame >= w0 AND frame < w1 AND rms > thr AND (frame = w0 OR prev <= thr)) AS n_spikes,
   max(rms) FILTER (frame = peak_frame) AS pk, avg(rms) FILTER (frame >= greatest(peak_frame - 20, 0) AND frame < greatest(peak_frame - 1, greatest(peak_frame - 20, 0) + 1)) AS base
   FROM (SELECT *, start_ms // 100 AS w0, end_ms // 100 AS w1 FROM peaks) p JOIN thr USING (media_id) JOIN (
     SELECT *, lag(rms) OVER (PARTITION BY media_id ORDER BY frame) AS prev FROM envelope) e ON e.media_id = p.media_id
     AND e.frame BETWEEN least(w0, greatest(peak_frame - 20, 0)) AND greatest(w1, peak_frame) GROUP BY p.media_id, p.clip_id"""
NEEDS["shape"] = ["peaks", "thr", "envelope"]


@query("peak_shape", ctes("shape", then="SELECT clip_id, round(sustain*1000000)::BIGINT AS sustain, n_spikes, round(greatest(0, (pk - base)/(pk + 0.000001))*1000000)::BIGINT AS transient FROM shape"))
def _(spark, sf):
    e = envelope(spark, sf)
    return E.peak_shape(e, peaks(spark, sf), E.loudness_thresholds(e, event_media(spark, sf), 0.1)).select(
        "clip_id", F.round(F.col("sustain") * 1000000).cast("bigint").alias("sustain"), "n_spikes", F.round(F.col("transient") * 1000000).cast("bigint").alias("transient"))




# ---- the whole gameplay flow: each step as in its own twin, on the plan's own windows --------------------
_iou = "greatest(0, least(k.z, c[1].z) - greatest(k.a, c[1].a)) / ((k.z - k.a) + (c[1].z - c[1].a) - greatest(0, least(k.z, c[1].z) - greatest(k.a, c[1].a)))"
SQL_VIEWS["picked"] = """SELECT media_id, unnest(kept) AS x FROM (
   SELECT media_id, list_reduce(list([{'v': rms, 'f': frame, 't': t_ms, 'g': gap}] ORDER BY rms DESC, frame), lambda acc, c: CASE
       WHEN len(acc) < 16 AND len(list_filter(acc, lambda a: abs(a.t - c[1].t) < c[1].g)) = 0 THEN list_concat(acc, c) ELSE acc END,
       CAST([] AS STRUCT(v DOUBLE, f BIGINT, t BIGINT, g BIGINT)[])) AS kept
   FROM (SELECT e.*, greatest(10000*gap_factor, 3000)::BIGINT AS gap FROM envelope e JOIN thr USING (media_id) JOIN timed USING (media_id) WHERE rms >= thr) GROUP BY media_id)"""
NEEDS["picked"] = ["envelope", "thr", "timed"]
SQL_VIEWS["pwin"] = """SELECT media_id, x.f AS peak_frame, x.t AS peak_ms, round_even(CASE WHEN e - s < min_len_ms THEN greatest(0, e - min_len_ms) ELSE s END, 0)::BIGINT AS start_ms, round_even(e, 0)::BIGINT AS end_ms
   FROM (SELECT p.*, min_len_ms, greatest(0, x.t - lead) AS s, least(duration_ms, x.t + tail) AS e FROM picked p JOIN timed USING (media_id))"""
NEEDS["pwin"] = ["picked", "timed"]
SQL_VIEWS["pshape"] = """SELECT p.media_id, peak_frame,
   avg((rms > thr)::INT) FILTER (frame >= w0 AND frame < w1) AS sustain, count(*) FILTER (frame >= w0 AND frame < w1 AND rms > thr AND (frame = w0 OR prev <= thr)) AS n_spikes,
   max(rms) FILTER (frame = peak_frame) AS pk, avg(rms) FILTER (frame >= greatest(peak_frame - 20, 0) AND frame < greatest(peak_frame - 1, greatest(peak_frame - 20, 0) + 1)) AS base
   FROM (SELECT *, start_ms // 100 AS w0, end_ms // 100 AS w1 FROM pwin) p JOIN thr USING (media_id) JOIN (
     SELECT *, lag(rms) OVER (PARTITION BY media_id ORDER BY frame) AS prev FROM envelope) e ON e.media_id = p.media_id
     AND e.frame BETWEEN least(w0, greatest(peak_frame - 20, 0)) AND greatest(w1, peak_frame) GROUP BY p.media_id, peak_frame"""
NEEDS["pshape"] = ["pwin", "thr", "envelope"]
_clock = "printf('%d:%02d', {0}//60000, {0}%60000//1000)"
SQL_VIEWS["pclips"] = f"""SELECT media_id, start_ms, end_ms, peak_ms, 'peak' AS kind, 'Highlight — ' || {_clock.format('peak_ms')} AS title, [peak_ms] AS anchors, 0.0::DOUBLE AS cue, 0.0::DOUBLE AS ocr, 0.0::DOUBLE AS ae,
   greatest(1, least(99, round_even(20 + 80*(wi*round(i, 4) + ws*round(coalesce(sustain, 0), 4) + wt*round(greatest(0, (pk - base)/(pk + 0.000001)), 4) + wp*round(least(n_spikes/5.0, 1.0), 4)), 0)))::INT AS score
   FROM pwin JOIN pshape USING (media_id, peak_frame) JOIN timed USING (media_id) JOIN (
     SELECT media_id, frame AS peak_frame, cume_dist() OVER (PARTITION BY media_id ORDER BY rms) AS i FROM envelope) USING (media_id, peak_frame)"""
NEEDS["pclips"] = ["pwin", "pshape", "timed", "envelope"]
SQL_VIEWS["shown"] = """SELECT * FROM fam_events e WHERE source <> 'audio' OR NOT EXISTS (SELECT 1 FROM fam_events m WHERE m.media_id = e.media_id AND m.source = 'ocr' AND m.label = 'menu' AND abs(m.t_ms - e.t_ms) <= 5000)"""
NEEDS["shown"] = ["fam_events"]
_word = "CASE {0} WHEN 'round win' THEN 'Round Win' ELSE upper({0}[1]) || {0}[2:] END"
SQL_VIEWS["eclips"] = f"""
   SELECT media_id, round_even(s, 0)::BIGINT AS start_ms, round_even(e, 0)::BIGINT AS end_ms, t0 AS peak_ms, 'cue' AS kind,
     CASE WHEN n = 1 THEN w WHEN kinds = 1 THEN ['','Double','Triple','Quad','Penta'][n] || ' ' || w ELSE w || ' + ' || (n-1) || ' cues' END || ' — ' || {_clock.format('t0')} AS title,
     list_distinct(list_prepend(t0, ts)) AS anchors, round(sim, 4) AS cue, 0.0::DOUBLE AS ocr, 0.0::DOUBLE AS ae, greatest(1, least(88, round_even(58 + greatest(0, sim - 0.84)*120 + (n-1)*4, 0)))::INT AS score
   FROM (SELECT * REPLACE (CASE WHEN e - s > max_len_ms THEN greatest(t0 - 2000, e - max_len_ms) ELSE s END AS s), {_word.format('lab')} AS w FROM (
     SELECT * REPLACE (CASE WHEN e - s < min_len_ms THEN greatest(0, e - min_len_ms) ELSE s END AS s) FROM (
       SELECT g.*, greatest(0, t0 - lead) AS s, least(duration_ms, t1 + tail) AS e, min_len_ms, max_len_ms FROM (
         SELECT media_id, streak, min(t_ms) AS t0, max(t_ms) AS t1, list(t_ms) AS ts, count(*) AS n, max(confidence) AS sim, arg_min(label, t_ms*1000000 + event_id) AS lab, count(DISTINCT label) AS kinds
         FROM streaks GROUP BY media_id, streak) g JOIN timed USING (media_id))))
   UNION ALL SELECT media_id, round_even(CASE WHEN e - s < min_len_ms THEN greatest(0, e - min_len_ms) ELSE s END, 0)::BIGINT, round_even(e, 0)::BIGINT, t_ms,
     CASE source WHEN 'ocr' THEN 'text' ELSE 'audio' END, {_word.format('label')} || CASE source WHEN 'ocr' THEN ' — ' ELSE ' - ' END || {_clock.format('t_ms')}, [t_ms], 0.0, CASE source WHEN 'ocr' THEN round(confidence, 4) ELSE 0 END, CASE source WHEN 'audio' THEN round(confidence, 4) ELSE 0 END,
     greatest(1, least(99, round_even(CASE source WHEN 'ocr' THEN 68 + confidence*20 ELSE 62 + confidence*24 END, 0)))::INT
   FROM (SELECT d.*, greatest(0, t_ms - lead) AS s, least(duration_ms, t_ms + tail) AS e, min_len_ms FROM shown d JOIN timed USING (media_id) WHERE source = 'audio' OR (source = 'ocr' AND label <> 'menu'))"""
NEEDS["eclips"] = ["streaks", "shown", "timed"]
SQL_VIEWS["gclips"] = "SELECT *, substr(sha256(concat_ws('|', media_id, start_ms, end_ms, kind, peak_ms, title)), 1, 12) AS clip_id FROM (SELECT * FROM eclips UNION ALL SELECT * FROM pclips)"
NEEDS["gclips"] = ["eclips", "pclips"]
SQL_VIEWS["gkept"] = f"""SELECT g.* FROM gclips g JOIN (SELECT media_id, unnest(list_transform(kept, lambda x: x.i)) AS clip_id FROM (
   SELECT media_id, list_reduce(list([{{'i': clip_id, 'a': start_ms, 'z': end_ms}}] ORDER BY (kind = 'peak'), score DESC, start_ms, end_ms, clip_id),
     lambda acc, c: CASE WHEN len(acc) < 8 AND len(list_filter(acc, lambda k: {_iou} > 0.4)) = 0 THEN list_concat(acc, c) ELSE acc END,
     CAST([] AS STRUCT(i VARCHAR, a BIGINT, z BIGINT)[])) AS kept FROM gclips GROUP BY media_id)) USING (media_id, clip_id)"""
NEEDS["gkept"] = ["gclips"]
SQL_VIEWS["gbacked"] = """SELECT k.* REPLACE (CAST(CASE WHEN nc > 0 AND nm > 0 THEN least(99, score + least(14, 6 + 2*greatest(nc + nm + na - 2, 0) + 2*(na > 0)::INT))
     WHEN nc = 0 AND no > 0 AND na > 0 AND score < 89 THEN least(89, score + 3) ELSE score END AS INT) AS score), coalesce(nc > 0 AND nm > 0, false) AS sure
   FROM gkept k LEFT JOIN (SELECT clip_id, sum(c) AS nc, coalesce(sum(o) FILTER (c > 0), 0) AS nm, sum(o) AS no, sum(a) AS na FROM (
     SELECT clip_id, family, count(*) FILTER (source = 'cue') AS c, count(*) FILTER (source = 'ocr') AS o, count(*) FILTER (source = 'audio') AS a FROM (
       SELECT DISTINCT c.clip_id, e.event_id, e.source, e.family FROM (SELECT *, unnest(anchors) AS at FROM gkept) c
       JOIN shown e ON e.media_id = c.media_id AND e.t_ms BETWEEN c.start_ms AND c.end_ms AND abs(e.t_ms - c.at) <= 3000) GROUP BY ALL) GROUP BY clip_id) USING (clip_id)"""
NEEDS["gbacked"] = ["gkept", "shown"]


@query("pick_peaks", ctes("picked", then="SELECT media_id, x.f AS peak_frame FROM picked"))
def _(spark, sf):
    return E.pick_peaks(envelope(spark, sf), event_media(spark, sf), 0.1)


@query("peak_clips", ctes("pclips", then="SELECT media_id, start_ms, end_ms, peak_ms, title, score FROM pclips"))
def _(spark, sf):
    e, m = envelope(spark, sf), event_media(spark, sf)
    return E.peak_clips(e, E.pick_peaks(e, m, 0.1), m, per_unit=0.1).select("media_id", "start_ms", "end_ms", "peak_ms", "title", "score")


def moments(spark, sf):
    return gameplay.gameplay_moments(envelope(spark, sf), fam_events(spark, sf), event_media(spark, sf), per_unit=0.1)


@query("gameplay_moments", ctes("gbacked", then="SELECT media_id, clip_id, start_ms, end_ms, kind, title, score FROM gbacked"))
def _(spark, sf):
    return moments(spark, sf).select("media_id", "clip_id", "start_ms", "end_ms", "kind", "title", "score")


@query("finish_gameplay", ctes("gbacked", then="""
   , c AS (SELECT *, (score * 3) % 100 / 100.0 AS ex, CASE WHEN peak_ms % 3 <> 0 THEN (peak_ms % 100) / 100.0 END AS hy, greatest(0, start_ms - 400) AS s0, end_ms + 700 AS e0 FROM gbacked),
   d AS (SELECT *, CASE WHEN round_even((ex - 0.45)/0.55*10.0, 0) <> 0 THEN greatest(1, least(99, score + greatest(-10, least(10, round_even((ex - 0.45)/0.55*10.0, 0))))) ELSE score END AS s1 FROM c),
   e AS (SELECT *, CASE WHEN hy IS NOT NULL AND ae <= 0 AND round_even(hy*10, 0) > 0 THEN least(99, s1 + round_even(hy*10, 0)) ELSE s1 END AS s2 FROM d)
   SELECT media_id, clip_id, s0 AS start_ms, least(e0, 2160000) AS end_ms,
     least(s2, CASE WHEN sure THEN 99 WHEN (ae > 0 OR coalesce(hy, 0) > 0) AND cue <= 0 AND ocr <= 0 THEN 86 WHEN cue > 0 THEN 88 ELSE 89 END)::INT AS score FROM e"""))
def _(spark, sf):
    """The flow's tail with speech excitement, heard events and learned shifts of the bounds."""
    m = event_media(spark, sf)
    c = moments(spark, sf).withColumns({"scope": F.lit("g"), "min_len_ms": F.lit(10000)})
    aro = c.select("media_id", "clip_id", (F.col("score") * 3 % 100 / 100).alias("arousal"))
    hype = c.where("peak_ms % 3 != 0").select("media_id", "clip_id", (F.col("peak_ms") % 100 / 100).alias("hype"), F.lit("cheer").alias("hype_reason"))
    shifts = spark.createDataFrame([("g", -400, 700)], "scope string, ds_ms long, de_ms long")
    return finish.finish_clips(c, m, "gameplay", arousal=aro, hype=hype, shifts=shifts).select("media_id", "clip_id", "start_ms", "end_ms", "score")


def all_clips(spark, sf):
    f, m = fam_events(spark, sf), event_media(spark, sf)
    return E.cue_clips(f, m).unionByName(E.text_clips(f, m)).unionByName(E.audio_event_clips(f, m))


@query("evidence_caps", ctes("fam_events", "timed", then="""SELECT media_id, least(86, greatest(1, least(99, round_even(62 + confidence*24, 0))))::INT AS score, count(*) AS n
   FROM fam_events WHERE source = 'audio' AND confidence > 0 GROUP BY 1, 2 UNION ALL
   SELECT media_id, least(89, greatest(1, least(99, round_even(68 + confidence*20, 0))))::INT + 1000, count(*) FROM fam_events WHERE source = 'ocr' AND label <> 'menu' GROUP BY 1, 2"""))
def _(spark, sf):
    f, m = fam_events(spark, sf), event_media(spark, sf)
    a = E.evidence_caps(E.audio_event_clips(f.where("confidence > 0"), m)).select("media_id", "score")
    t = E.evidence_caps(E.text_clips(f, m)).select("media_id", (F.col("score") + 1000).alias("score"))
    return a.unionByName(t).groupBy("media_id", "score").agg(F.count("*").alias("n"))


@query("title_fallback", ctes("shape", "peaks", "envelope", then="""
   SELECT clip_id, CASE WHEN round(greatest(0, (pk - base)/(pk + 0.000001)), 4) > 0.65 OR round(least(n_spikes/5.0, 1.0), 4) > 0.7 THEN 'Sudden Fight' WHEN i > 0.85 THEN 'Loud Fight' ELSE 'Highlight' END
     || ' — ' || printf('%d:%02d', peak_ms//60000, peak_ms%60000//1000) AS title FROM shape JOIN peaks USING (clip_id) JOIN (
   SELECT media_id, frame, cume_dist() OVER (PARTITION BY media_id ORDER BY rms) AS i FROM envelope) e ON e.media_id = peaks.media_id AND e.frame = peaks.peak_frame"""))
def _(spark, sf):
    e, p = envelope(spark, sf), peaks(spark, sf)
    c = p.join(E.peak_intensity(e, p, 0.1).select("clip_id", "intensity"), "clip_id").join(
        E.peak_shape(e, p, E.loudness_thresholds(e, event_media(spark, sf), 0.1)).drop("media_id"), "clip_id")
    c = c.withColumns({"features": F.create_map(*[x for k in ("intensity", "transient", "spikes") for x in (F.lit(k), F.round(k, 4))]),
                       "factors": F.array().cast("array<struct<label:string>>"), "title": F.lit("Highlight")})
    return E.title_fallback(c).select("clip_id", "title")


# ---- selection ----------------------------------------------------------------------------------
@query("nms_gap", ctes("envelope", then="""
  , k AS (SELECT media_id, list_reduce(list([{'v': rms, 'f': frame}] ORDER BY rms DESC, frame), lambda acc, c: CASE WHEN len(acc) < 16 AND len(list_filter(acc, lambda a: abs(a.f - c[1].f) < 30)) = 0
       THEN list_concat(acc, c) ELSE acc END, CAST([] AS STRUCT(v DOUBLE, f BIGINT)[])) AS kept FROM envelope GROUP BY media_id)
  SELECT media_id, unnest(list_transform(kept, lambda x: x.f)) AS frame FROM k"""))
def _(spark, sf):
    return S.nms_gap(envelope(spark, sf), "rms", 3000, 16, chunk_ms=20_000).select("media_id", "frame")


@query("priority_merge", ctes("event_clips", then="""
  , k AS (SELECT media_id, list_reduce(list([{'i': clip_id, 'a': start_ms, 'z': end_ms}] ORDER BY (kind <> 'cue'), score DESC, start_ms, end_ms, clip_id),
      lambda acc, c: CASE WHEN len(acc) < 8 AND len(list_filter(acc, lambda k: greatest(0, least(k.z, c[1].z) - greatest(k.a, c[1].a))
          / ((k.z - k.a) + (c[1].z - c[1].a) - greatest(0, least(k.z, c[1].z) - greatest(k.a, c[1].a))) > 0.4)) = 0 THEN list_concat(acc, c) ELSE acc END,
      CAST([] AS STRUCT(i VARCHAR, a BIGINT, z BIGINT)[])) AS kept FROM event_clips GROUP BY media_id)
  SELECT unnest(list_transform(kept, lambda x: x.i)) AS clip_id FROM k"""))
def _(spark, sf):
    c = event_clips(spark, sf)
    return S.priority_merge(c.where("kind = 'cue'"), c.where("kind != 'cue'"), k=8).select("clip_id")


@query("score_rank", ctes("event_clips", then="SELECT clip_id, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, clip_id) AS rank FROM event_clips"))
def _(spark, sf):
    return S.score_rank(event_clips(spark, sf)).select("clip_id", "rank")


@query("uniform_segments", ctes("event_media", then="SELECT media_id, k*20000 AS start_ms, least(k*20000 + 20000, duration_ms) AS end_ms FROM event_media, range(0, 8) r(k) WHERE k*20000 < duration_ms - 2000"))
def _(spark, sf):
    return E.uniform_segments(event_media(spark, sf)).select("media_id", "start_ms", "end_ms")


@query("sample_times", ctes("media", then="""SELECT media_id, round_even(s*(i + 0.5), 0)::BIGINT AS t_ms FROM (SELECT media_id, duration_ms, greatest(1000.0, duration_ms/2000.0) AS s FROM media) , range(0, 2000) r(i)
   WHERE round(s*(i + 0.5), 6) < duration_ms"""))
def _(spark, sf):
    from checks.views import media
    return E.sample_times(media(spark, sf), 1000)


@query("focused_times", ctes("detections", "event_media", then="""
  , a AS (SELECT media_id, 0 AS p, t_ms AS src, o, least(greatest(t_ms + [-1000, 0, 1500, 3000][o + 1], 250), 2159750) AS t_ms FROM detections, range(0, 4) r(o) WHERE source = 'cue'
     UNION ALL SELECT media_id, 1, s.t, 0, s.t FROM event_media, (SELECT i*12000 + 6000 AS t FROM range(0, 180) r(i)) s),
  b AS (SELECT media_id, round_even(t_ms/750.0, 0) AS bk, arg_min(t_ms, p*100000000000 + src*10 + o) AS t_ms FROM a GROUP BY 1, 2),
  c AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY t_ms, bk) - 1 AS i, count(*) OVER (PARTITION BY media_id) AS n FROM b)
  SELECT media_id, t_ms FROM c WHERE n <= 2000 OR i IN (SELECT j*n//2000 FROM range(0, 2000) r(j))"""))
def _(spark, sf):
    f = detections(spark, sf).where("source = 'cue'").select("media_id", "t_ms")
    return E.focused_times(event_media(spark, sf), f, 1000)


@query("cut_density", ctes("detections", "event_media", then="SELECT media_id, round(greatest(2.0 - least(coalesce(n, 0)/2160.0, 1.0)*1.4, 0.6)*1000000)::BIGINT AS step FROM event_media LEFT JOIN (SELECT media_id, count(*) AS n FROM detections WHERE label = 'view' GROUP BY media_id) USING (media_id)"))
def _(spark, sf):
    return E.cut_density(detections(spark, sf).where("label = 'view'"), event_media(spark, sf)).select("media_id", F.round(F.col("step") * 1000000).cast("bigint").alias("step"))


@query("clamp_to_media", ctes("event_clips", then="SELECT clip_id, greatest(0, least(start_ms, 1000000)) AS start_ms, greatest(0, least(end_ms, 1000000)) AS end_ms FROM event_clips WHERE least(end_ms, 1000000) - least(start_ms, 1000000) >= 1000"))
def _(spark, sf):
    m = event_media(spark, sf).withColumn("duration_ms", F.lit(1_000_000).cast("bigint"))
    return E.clamp_to_media(event_clips(spark, sf), m).select("clip_id", "start_ms", "end_ms")


# ---- on-screen text ------------------------------------------------------------------------------
PHRASES = [("conn", "of the"), ("conn", "de la"), ("conn", "in der"), ("conj", "and"), ("conj", "und"), ("conj", "of the and"), ("long", "que des")]
SQL_VIEWS["folded"] = "SELECT *, ' ' || trim(regexp_replace(strip_accents(lower(replace(replace(text, 'ß', ''), 'ł', ''))), '[^a-z0-9]+', ' ', 'g')) || ' ' AS f FROM text_reads"
NEEDS["folded"] = ["text_reads"]
SQL_VIEWS["kw"] = sql_values(PHRASES, "label, phrase")


@query("fold_text", ctes("folded", then="SELECT read_id, md5(trim(f)) AS h FROM folded"))
def _(spark, sf):
    from momentlake.functions.text import fold_text
    return text_reads(spark, sf).select("read_id", F.md5(fold_text("text")).alias("h"))


@query("match_keywords", ctes("folded", "kw", then="SELECT read_id, label, arg_min(phrase, printf('%04d', 1000 - length(phrase)) || phrase) AS phrase FROM folded, kw WHERE contains(f, ' ' || phrase || ' ') GROUP BY read_id, label"))
def _(spark, sf):
    p = spark.createDataFrame(PHRASES, "label string, phrase string")
    return E.match_keywords(text_reads(spark, sf), p).select("read_id", "label", "phrase")


FUZZY = [("a", "therre"), ("b", "quedes"), ("a", "and"), ("c", "of thes")]


@query("match_keywords_fuzzy", ctes("folded", then=f"""
  , kw2 AS ({sql_values(FUZZY, 'label, phrase')}), t AS (SELECT read_id, unnest(string_split(trim(f), ' ')) AS w, generate_subscripts(string_split(trim(f), ' '), 1) AS i FROM folded WHERE trim(f) <> ''),
  g AS (SELECT DISTINCT read_id, w AS gram, 1 AS n FROM t UNION SELECT DISTINCT a.read_id, a.w || ' ' || b.w, 2 FROM t a JOIN t b ON a.read_id = b.read_id AND b.i = a.i + 1),
  ex AS (SELECT read_id, label, phrase FROM g JOIN kw2 ON gram = phrase),
  d AS (SELECT DISTINCT gram, n FROM g),
  c AS (SELECT gram, label, phrase FROM d JOIN kw2 ON n = len(string_split(phrase, ' ')) AND (n > 1 OR length(phrase) >= 5) AND levenshtein(gram, phrase) <= 0.2*(length(gram) + length(phrase))),
  lcs AS (SELECT *, list_reduce(list_prepend(list_transform(range(0, length(phrase) + 1), lambda z: 0::BIGINT), list_transform(range(1, length(gram) + 1), lambda i: [i])), lambda prev, x:
     list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length(phrase) + 1), lambda j: [j])), lambda acc, y:
       list_append(acc, greatest(prev[y[1] + 1], acc[-1], prev[y[1]] + (gram[x[1]] = phrase[y[1]])::BIGINT))))[-1] AS l FROM c),
  near AS (SELECT gram, label, phrase FROM lcs WHERE 200.0*l/(length(gram) + length(phrase)) >= 80)
  SELECT read_id, label, arg_min(phrase, printf('%04d', 1000 - length(phrase)) || phrase) AS phrase
  FROM (SELECT read_id, label, phrase FROM g JOIN near USING (gram) UNION ALL SELECT * FROM ex) GROUP BY read_id, label"""))
def _(spark, sf):
    p = spark.createDataFrame(FUZZY, "label string, phrase string")
    return E.match_keywords_fuzzy(text_reads(spark, sf), p, 80).select("read_id", "label", "phrase")


@query("drop_false_positives", ctes("folded", "kw", then="""
   SELECT read_id, label FROM (SELECT read_id, label, f, CASE WHEN read_id % 2 = 0 THEN 'g1' ELSE 'g2' END AS game FROM folded, kw WHERE contains(f, ' ' || phrase || ' ') GROUP BY ALL)
   WHERE NOT (contains(f, 'the and') OR (game = 'g1' AND contains(f, 'pour')))"""))
def _(spark, sf):
    p = spark.createDataFrame(PHRASES, "label string, phrase string")
    m = E.match_keywords(text_reads(spark, sf), p).withColumn("game", F.when(F.col("read_id") % 2 == 0, "g1").otherwise("g2"))
    f = spark.createDataFrame([("common", "The and!"), ("g1", "Pour")], "game string, phrase string")
    return E.drop_false_positives(m, f).select("read_id", "label")


@query("manual_matches", ctes("folded", then="SELECT media_id, read_id, 'und der' AS phrase FROM folded WHERE contains(f, ' und der ') AND media_id < 25 UNION ALL SELECT media_id, read_id, 'la' FROM folded WHERE contains(f, ' la ') AND media_id >= 25"))
def _(spark, sf):
    r = text_reads(spark, sf)
    cues = r.select("media_id").distinct().withColumn("phrase", F.when(F.col("media_id") < 25, "und der").otherwise("Là"))
    return E.manual_matches(r, cues).select("media_id", "read_id", "phrase")


@query("garbled_filter", ctes("text_reads", then="SELECT read_id FROM text_reads WHERE length(text) > 0 AND length(regexp_replace(text, '[^\\p{L}\\p{N}''._-]', '', 'g')) / length(text) >= 0.8"))
def _(spark, sf):
    return E.garbled_filter(text_reads(spark, sf), 0.2).select("read_id")


SQL_VIEWS["reads5"] = "SELECT * REPLACE (CASE WHEN read_id % 11 < 5 THEN '' ELSE text END AS text) FROM text_reads"
NEEDS["reads5"] = ["text_reads"]


def _reads5(spark, sf):
    r = text_reads(spark, sf)
    return r.withColumn("text", F.when(F.col("read_id") % 11 < 5, "").otherwise(F.col("text")))


@query("text_change_events", ctes("reads5", then="SELECT read_id, media_id, t_ms FROM (SELECT *, lag(text) OVER (PARTITION BY media_id, roi ORDER BY t_ms) AS prev FROM reads5 WHERE text <> '') WHERE prev IS NOT NULL AND length(text) > 3 AND text <> prev"))
def _(spark, sf):
    return E.text_change_events(_reads5(spark, sf)).select("read_id", "media_id", "t_ms")


@query("dead_region_filter", ctes("reads5", then="""
  , r AS (SELECT *, row_number() OVER (PARTITION BY media_id % 3, roi ORDER BY t_ms) AS i FROM reads5),
  d AS (SELECT a.media_id % 3 AS m, a.roi, min(a.i) AS dead FROM r a JOIN r b ON a.media_id % 3 = b.media_id % 3 AND a.roi = b.roi AND b.i BETWEEN a.i - 2 AND a.i AND b.text = '' GROUP BY a.media_id % 3, a.roi, a.i HAVING count(*) = 3),
  e AS (SELECT m, roi, min(dead) AS dead FROM d GROUP BY m, roi)
  SELECT read_id FROM r LEFT JOIN e ON e.m = r.media_id % 3 AND e.roi = r.roi WHERE dead IS NULL OR i <= dead"""))
def _(spark, sf):
    r = _reads5(spark, sf).withColumn("media_id", F.col("media_id") % 3)
    return E.dead_region_filter(r, 3).select("read_id")


@query("reuse_static_reads", ctes("text_reads", then="""
  , h AS (SELECT media_id, roi, t_ms, read_id, xor(xor(length(roi)*1234567890123, 1::BIGINT << (read_id // 3 % 60)::INT), read_id // 40 * 1234567)::BIGINT AS h FROM text_reads WHERE roi IS NOT NULL),
  r AS (SELECT unnest(list_reduce(list([{'h': h, 'id': read_id, 'ref': h, 'src': read_id}] ORDER BY t_ms, read_id), lambda acc, c: CASE
      WHEN len(acc) = 0 OR bit_count(xor(c[1].h, acc[len(acc)].ref)) > 3 THEN list_concat(acc, c)
      ELSE list_append(acc, {'h': c[1].h, 'id': c[1].id, 'ref': acc[len(acc)].ref, 'src': acc[len(acc)].src}) END,
      CAST([] AS STRUCT(h BIGINT, id BIGINT, ref BIGINT, src BIGINT)[]))) AS x FROM h GROUP BY media_id, roi)
  SELECT x.id AS read_id, x.src AS source_read FROM r"""))
def _(spark, sf):
    h = "cast(length(roi) as bigint) * 1234567890123 ^ shiftleft(cast(1 as bigint), cast(read_id div 3 % 60 as int)) ^ (read_id div 40 * 1234567)"
    return E.reuse_static_reads(text_reads(spark, sf).withColumn("phash", F.expr(h))).select("read_id", "source_read")


MARK = [("game_a", 1, "the"), ("game_a", 2, "tion"), ("game_b", 3, "und"), ("game_b", 4, "sch"), ("game_c", 5, "que")]


@query("detect_profile", ctes("text_reads", then=f"""
  , m AS ({sql_values(MARK, 'profile, ord, marker')}), h AS (SELECT DISTINCT read_id, profile, ord, marker FROM text_reads, m WHERE contains(lower(text), marker)),
  n AS (SELECT read_id, profile, count(*) AS n, min(ord) AS o FROM h GROUP BY read_id, profile)
  SELECT read_id AS media_id, coalesce(profile, 'generic') AS profile FROM (SELECT read_id FROM text_reads) LEFT JOIN (SELECT read_id, arg_max(profile, n*100 - o) AS profile FROM n GROUP BY read_id) USING (read_id)"""))
def _(spark, sf):
    r = text_reads(spark, sf).select(F.col("read_id").alias("media_id"), "text")
    return E.detect_profile(r, spark.createDataFrame(MARK, "profile string, ord int, marker string"))


@query("text_confidence", ctes("text_reads", then="SELECT read_id, round(CASE WHEN conf > 0 THEN round(least(1.0, conf*CASE WHEN roi = 'web' THEN 0.97 ELSE 1.0 END), 4) WHEN roi = 'web' THEN 0.8 ELSE 0.9 END * 10000)::BIGINT AS c FROM text_reads"))
def _(spark, sf):
    r = text_reads(spark, sf).withColumn("roi", F.when(F.col("roi") == "web", "full").otherwise(F.col("roi")))
    return r.select("read_id", F.round(E.text_confidence(F.col("conf"), F.col("roi")) * 10000).cast("bigint").alias("c"))


@query("evidence_text", ctes("text_reads", then="SELECT read_id, 'x' || CASE WHEN t = '' THEN '' ELSE ' | ' || CASE WHEN length(t) > 140 THEN left(t, 137) || '...' ELSE t END END AS e FROM (SELECT read_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM text_reads)"))
def _(spark, sf):
    return text_reads(spark, sf).select("read_id", E.evidence_text(F.lit("x"), F.col("text")).alias("e"))
