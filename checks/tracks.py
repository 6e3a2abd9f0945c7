"""Track and geometry queries."""

from pyspark.sql import functions as F

from checks import ctes, query
from checks.views import NEEDS, SQL_VIEWS, detections, envelope, event_clips, event_media, table
from momentlake.functions.scoring import iou_1d, iou_2d
from momentlake.operators import tracks as K

CL = ["media_id", "clip_id"]


def track(spark, sf):
    """Envelope values as a position series, 50 frames to a clip."""
    e = envelope(spark, sf)
    return e.select("media_id", F.concat_ws("-", "media_id", F.floor(F.col("frame") / 50)).alias("clip_id"), "t_ms", (F.col("rms") % 10 / 10).alias("cx"))


SQL_VIEWS["track"] = "SELECT media_id, media_id || '-' || frame // 50 AS clip_id, t_ms, rms % 10 / 10 AS cx FROM envelope"
NEEDS["track"] = ["envelope"]
_al = lambda c, dt: f"(1.0/(1.0 + (1.0/(2*3.141592653589793*{c}))/{dt}))"
SQL_VIEWS["euro"] = f"""SELECT media_id, clip_id, unnest(list_reduce(list([{{'t': t_ms, 'v': cx, 'd': 0.0::DOUBLE}}] ORDER BY t_ms), lambda acc, c: CASE WHEN len(acc) = 0 THEN c ELSE list_append(acc,
   list_transform([ {{'n': c[1], 'l': acc[len(acc)]}} ], lambda q: list_transform([ {{'n': q.n, 'l': q.l, 'dd': {_al('1.0', '((q.n.t - q.l.t)/1000.0)')}*(q.n.v - q.l.v)/((q.n.t - q.l.t)/1000.0) + (1 - {_al('1.0', '((q.n.t - q.l.t)/1000.0)')})*q.l.d}} ],
      lambda z: {{'t': z.n.t, 'v': {_al('(1.2 + 0.6*abs(z.dd))', '((z.n.t - z.l.t)/1000.0)')}*z.n.v + (1 - {_al('(1.2 + 0.6*abs(z.dd))', '((z.n.t - z.l.t)/1000.0)')})*z.l.v, 'd': z.dd}})[1])[1]) END,
   CAST([] AS STRUCT(t BIGINT, v DOUBLE, d DOUBLE)[]))) AS x FROM track GROUP BY media_id, clip_id"""
NEEDS["euro"] = ["track"]


@query("one_euro", ctes("euro", then="SELECT clip_id, x.t AS t_ms, round(x.v*1000000)::BIGINT AS cx FROM euro"))
def _(spark, sf):
    return K.one_euro(track(spark, sf)).select("clip_id", "t_ms", F.round(F.col("cx") * 1000000).cast("bigint").alias("cx"))


_lo = 0.5 * (9 / 16) / (16 / 9)


@query("smooth_path", ctes("euro", then=f"""
  , s AS (SELECT clip_id, unnest(list_reduce(list([{{'t': x.t, 'v': x.v}}] ORDER BY x.t), lambda acc, c: CASE WHEN len(acc) = 0 THEN [{{'t': c[1].t, 'v': greatest({_lo}, least({1 - _lo}, c[1].v))}}]
    ELSE list_append(acc, {{'t': c[1].t, 'v': greatest({_lo}, least({1 - _lo}, acc[len(acc)].v + greatest(-0.05, least(0.05, c[1].v - acc[len(acc)].v))))}}) END, CAST([] AS STRUCT(t BIGINT, v DOUBLE)[]))) AS x FROM euro GROUP BY clip_id)
  SELECT clip_id, x.t AS t_ms, round(x.v*1000000)::BIGINT AS cx FROM s"""))
def _(spark, sf):
    return K.smooth_path(track(spark, sf)).select("clip_id", "t_ms", F.round(F.col("cx") * 1000000).cast("bigint").alias("cx"))


@query("slice_track", ctes("track", "event_clips", then="SELECT c.clip_id, count(*) AS n, CAST(sum(t.t_ms - c.start_ms) AS BIGINT) AS s FROM track t JOIN event_clips c ON c.media_id = t.media_id AND t.t_ms BETWEEN c.start_ms AND c.end_ms GROUP BY c.clip_id"))
def _(spark, sf):
    t = K.slice_track(track(spark, sf).drop("clip_id"), event_clips(spark, sf))
    return t.groupBy("clip_id").agg(F.count("*").alias("n"), F.sum("t_ms").alias("s"))


@query("carry_last_position", ctes("track", then="""
  SELECT media_id, t_ms, round(c*1000)::BIGINT AS cx FROM (SELECT *, last_value(CASE WHEN cx >= 0.5 THEN cx END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY t_ms) AS c,
     count(*) FILTER (cx >= 0.5) OVER (PARTITION BY media_id) AS h, count(*) OVER (PARTITION BY media_id) AS n FROM track) WHERE c IS NOT NULL AND h >= greatest(2, n*0.15)"""))
def _(spark, sf):
    t = track(spark, sf).select("media_id", "t_ms", F.when(F.col("cx") >= 0.5, F.col("cx")).alias("cx"))
    return K.carry_last_position(t).select("media_id", "t_ms", F.round(F.col("cx") * 1000).cast("bigint").alias("cx"))


@query("crop_position", ctes("track", then="""
  , p AS (SELECT *, lead(t_ms) OVER w AS t1, lead(cx) OVER w AS c1 FROM track WINDOW w AS (PARTITION BY clip_id ORDER BY t_ms)),
  q AS (SELECT clip_id, t_ms + 30 AS t FROM track UNION ALL SELECT clip_id, min(t_ms) - 70 FROM track GROUP BY clip_id)
  SELECT clip_id, t AS t_ms, round((CASE WHEN t1 IS NULL THEN cx ELSE cx + (c1 - cx)*((t - p.t_ms)/(t1 - p.t_ms)) END)*1000000 - 0.0001)::BIGINT AS cx
  FROM q JOIN p USING (clip_id) WHERE p.t_ms <= t AND t < coalesce(t1, 1000000000)
  UNION ALL SELECT clip_id, t, round(c0*1000000 - 0.0001)::BIGINT FROM q JOIN (SELECT clip_id, min(t_ms) AS m, arg_min(cx, t_ms) AS c0 FROM p GROUP BY clip_id) USING (clip_id) WHERE t < m"""))
def _(spark, sf):
    t = track(spark, sf)
    early = t.groupBy(*CL).agg((F.min("t_ms") - 70).alias("t_ms"))
    times = t.select(*CL, (F.col("t_ms") + 30).alias("t_ms")).unionByName(early)
    return K.crop_position(t, times).select("clip_id", "t_ms", F.round(F.col("cx") * 1000000 - 0.0001).cast("bigint").alias("cx"))


def boxes(spark, sf):
    """Two boxes per frame that drift with the envelope; 50 frames to a clip."""
    e = envelope(spark, sf)
    v = F.col("rms") % 1
    base = e.select("media_id", F.concat_ws("-", "media_id", F.floor(F.col("frame") / 50)).alias("clip_id"), "frame", "t_ms", v.alias("v"), "rms")
    a = base.select(*CL, "frame", "t_ms", (0.1 + F.col("v") * 0.05).alias("x"), F.lit(0.2).alias("y"), F.lit(0.2).alias("w"), F.lit(0.3).alias("h"), F.col("v").alias("motion"), F.lit(True).alias("is_person"))
    b = base.where("frame % 3 != 0").select(*CL, "frame", "t_ms", (0.6 + F.col("v") * 0.05).alias("x"), F.lit(0.3).alias("y"), F.lit(0.15).alias("w"), F.lit(0.2).alias("h"), (1 - F.col("v")).alias("motion"), F.lit(False).alias("is_person"))
    return a.unionByName(b)


SQL_VIEWS["boxes"] = """SELECT media_id, media_id || '-' || frame // 50 AS clip_id, frame, t_ms, 0.1 + rms % 1 * 0.05 AS x, 0.2 AS y, 0.2 AS w, 0.3 AS h, rms % 1 AS motion, true AS is_person FROM envelope UNION ALL
   SELECT media_id, media_id || '-' || frame // 50, frame, t_ms, 0.6 + rms % 1 * 0.05, 0.3, 0.15, 0.2, 1 - rms % 1, false FROM envelope WHERE frame % 3 <> 0"""
NEEDS["boxes"] = ["envelope"]


@query("link_boxes", ctes("boxes", then="""SELECT clip_id, frame, is_person, CASE WHEN is_person THEN 1 ELSE 2 END AS track_id FROM boxes"""))
def _(spark, sf):
    return K.link_boxes(boxes(spark, sf)).select("clip_id", "frame", "is_person", "track_id")


# per frame both faces' motion, then one step after the other: state is the followed face and the winning frames
SQL_VIEWS["duel"] = """SELECT *, speech AND NOT coalesce(lag(speech) OVER (PARTITION BY clip_id ORDER BY frame), false) AS onset FROM (
   SELECT clip_id, frame, frame % 20 < 10 AS speech, max(motion) FILTER (is_person) AS m1, max(motion) FILTER (NOT is_person) AS m2,
     max(x + w/2) FILTER (is_person) AS c1, max(x + w/2) FILTER (NOT is_person) AS c2 FROM boxes GROUP BY clip_id, frame)"""
NEEDS["duel"] = ["boxes"]
_lead = "CASE WHEN coalesce(c[1].m2 > c[1].m1, false) THEN 2 ELSE 1 END"
_gone = "(l.tg = 0 OR (l.tg = 2 AND c[1].m2 IS NULL))"
_ahead = "coalesce(CASE l.tg WHEN 1 THEN c[1].m2 > c[1].m1 + 0.35 ELSE c[1].m1 > c[1].m2 + 0.35 END, false)"


@query("choose_speaker_track", ctes("duel", then=f"""
  , s AS (SELECT clip_id, unnest(list_reduce(list([{{'f': frame, 'o': onset, 'm1': m1, 'm2': m2, 'c1': c1, 'c2': c2, 'tg': 0, 'vt': 0}}] ORDER BY frame), lambda acc, c: list_concat(acc,
      list_transform([CASE WHEN len(acc) = 0 THEN {{'tg': 0, 'vt': 0}} ELSE {{'tg': acc[len(acc)].tg, 'vt': acc[len(acc)].vt}} END], lambda l:
        {{'f': c[1].f, 'o': c[1].o, 'm1': c[1].m1, 'm2': c[1].m2, 'c1': c[1].c1, 'c2': c[1].c2,
          'tg': CASE WHEN {_gone} THEN {_lead} WHEN {_ahead} AND (c[1].o OR l.vt >= 2) THEN {_lead} ELSE l.tg END,
          'vt': CASE WHEN {_gone} THEN l.vt WHEN {_ahead} THEN CASE WHEN c[1].o THEN l.vt ELSE l.vt + 1 END ELSE 0 END}})),
      CAST([] AS STRUCT(f BIGINT, o BOOLEAN, m1 DOUBLE, m2 DOUBLE, c1 DOUBLE, c2 DOUBLE, tg INTEGER, vt INTEGER)[]))) AS x FROM duel GROUP BY clip_id)
  SELECT clip_id, x.f AS frame, x.tg::BIGINT AS track_id, round(CASE x.tg WHEN 1 THEN x.c1 ELSE x.c2 END * 1000000)::BIGINT AS cx FROM s"""))
def _(spark, sf):
    b = K.link_boxes(boxes(spark, sf)).withColumn("speech", F.col("frame") % 20 < 10)
    return K.choose_speaker_track(b.select(*CL, "frame", "t_ms", "track_id", (F.col("x") + F.col("w") / 2).alias("cx"), "motion", "speech")).select(
        "clip_id", "frame", "track_id", F.round(F.col("cx") * 1000000).cast("bigint").alias("cx"))


@query("active_speaker_center", ctes("boxes", then="""SELECT clip_id, frame, round_even(frame*40.0, 0)::BIGINT AS t_ms, round(arg_max(x, motion)*1000000)::BIGINT AS cx FROM boxes WHERE motion >= 0.3 AND motion <> 0.5 GROUP BY clip_id, frame"""))
def _(spark, sf):
    b = boxes(spark, sf).where("motion != 0.5").select(*CL, "frame", F.when(F.col("is_person"), 1).otherwise(2).alias("track_id"), F.col("x").alias("cx"), F.col("motion").alias("score"))
    return K.active_speaker_center(b, 0.3, 25.0).select("clip_id", "frame", "t_ms", F.round(F.col("cx") * 1000000).cast("bigint").alias("cx"))


@query("subject_center", ctes("boxes", then="SELECT clip_id, frame, round((x + w/2)*1000000)::BIGINT AS cx FROM boxes WHERE is_person"))
def _(spark, sf):
    return K.subject_center(boxes(spark, sf)).select("clip_id", "frame", F.round(F.col("cx") * 1000000).cast("bigint").alias("cx"))


@query("stable_face_region", ctes("boxes", then="""
  , s AS (SELECT media_id, frame, x, w, h, y, count(*) OVER (PARTITION BY media_id) AS n, row_number() OVER (PARTITION BY media_id ORDER BY x + w/2) - 1 AS r FROM boxes WHERE is_person)
  SELECT media_id, round(((x + w/2) - 0.1)*1000000)::BIGINT AS x FROM s WHERE r = n//2 AND n >= 6 AND media_id IN (SELECT media_id FROM s GROUP BY media_id HAVING stddev_pop(x) <= 0.025)"""))
def _(spark, sf):
    b = boxes(spark, sf).select("media_id", F.col("frame").alias("sample"), F.when(F.col("is_person"), 0).otherwise(1).alias("ord"), "x", "y", "w", "h")
    return K.stable_face_region(b).select("media_id", F.round(F.col("x") * 1000000).cast("bigint").alias("x"))


@query("stable_person_region", ctes("boxes", then="""
  , s AS (SELECT media_id, x, w, y, row_number() OVER (PARTITION BY media_id ORDER BY x + w/2) - 1 AS r, count(*) OVER (PARTITION BY media_id) AS n FROM boxes WHERE NOT is_person)
  SELECT media_id, round((x + w/2 - 0.075)*1000000)::BIGINT AS x, 300000 AS y, 150000 AS w FROM s WHERE r = n//2 AND media_id IN (
    SELECT media_id FROM boxes GROUP BY media_id HAVING count(DISTINCT frame) >= 6 AND stddev_pop(x) FILTER (NOT is_person) <= 0.045
      AND count(*) FILTER (NOT is_person) >= greatest(4, floor(count(DISTINCT frame)*0.35)))"""))
def _(spark, sf):
    """The wide boxes count as samples only: they are over the width of a cutout."""
    wide = F.when(F.col("is_person"), 0.5).otherwise(F.col("w"))
    b = boxes(spark, sf).select("media_id", F.col("frame").alias("sample"), "x", "y", wide.alias("w"), "h")
    return K.stable_person_region(b).select("media_id", *[F.round(F.col(c) * 1000000).cast(t).alias(c) for c, t in (("x", "bigint"), ("y", "int"), ("w", "int"))])


@query("expand_regions", ctes("boxes", then="""SELECT clip_id, frame, is_person, round(greatest(0, least(CASE WHEN is_person THEN x - w*0.2 ELSE x + w/2 - w*2.1/2 END, 1 - least(1.0, CASE WHEN is_person THEN w*1.4 ELSE w*2.1 END)))*1000000)::BIGINT AS x,
   round(greatest(0, least(CASE WHEN is_person THEN y - h*0.08 ELSE y - h*2.5*0.18 END, 1 - CASE WHEN is_person THEN h*1.16 ELSE h*2.5 END))*1000000)::BIGINT AS y FROM boxes"""))
def _(spark, sf):
    r = F.struct("x", "y", "w", "h")
    b = boxes(spark, sf).withColumn("r", F.when(F.col("is_person"), K.expand_person(r)).otherwise(K.expand_face(r)))
    return b.select("clip_id", "frame", "is_person", F.round(F.col("r.x") * 1000000).cast("bigint").alias("x"), F.round(F.col("r.y") * 1000000).cast("bigint").alias("y"))


@query("cut_windows", ctes("detections", then="SELECT media_id, t_ms AS a_ms, least(t_ms + 1200, 2000000) AS b_ms FROM detections WHERE label = 'view' AND t_ms < 2000000 AND least(t_ms + 1200, 2000000) - t_ms >= 300"))
def _(spark, sf):
    m = event_media(spark, sf).withColumn("duration_ms", F.lit(2_000_000).cast("bigint"))
    return K.cut_windows(detections(spark, sf).where("label = 'view'"), m).select("media_id", "a_ms", "b_ms")


SQL_VIEWS["mruns"] = """SELECT media_id, min(t_ms) AS a, max(t_ms) AS z, max(v) AS score, nullif(arg_max(coalesce(nt, -1), t_ms), -1) AS nt, arg_max(coalesce(nv, -1), t_ms) AS nv FROM (
   SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY t_ms) AS g FROM (SELECT *, CASE WHEN pv < 0.4 OR t_ms - pt > 500 OR pv IS NULL THEN 1 ELSE 0 END AS b FROM (
     SELECT media_id, t_ms, v, lag(v) OVER w AS pv, lag(t_ms) OVER w AS pt, lead(v) OVER w AS nv, lead(t_ms) OVER w AS nt
     FROM (SELECT media_id, t_ms + t_ms // 2000 * 700 AS t_ms, rms % 10 / 10 AS v FROM envelope) WINDOW w AS (PARTITION BY media_id ORDER BY t_ms)) WHERE v >= 0.4)) GROUP BY media_id, g"""
NEEDS["mruns"] = ["envelope"]


@query("motion_runs", ctes("mruns", then="SELECT media_id, a AS a_ms, least(CASE WHEN nt IS NULL THEN a + 1000 WHEN nv < 0.4 THEN nt ELSE z END, a + 1000) AS b_ms, round(score*1000)::BIGINT AS score FROM mruns"))
def _(spark, sf):
    m = envelope(spark, sf).select("media_id", (F.col("t_ms") + F.floor(F.col("t_ms") / 2000) * 700).alias("t_ms"), (F.col("rms") % 10 / 10).alias("v"))
    return K.motion_runs(m).select("media_id", "a_ms", "b_ms", F.round(F.col("score") * 1000).cast("bigint").alias("score"))


@query("fill_gaps", ctes("detections", then="""
  , w AS (SELECT media_id, t_ms AS a, t_ms + 800 + event_id % 5 * 100 AS b, (event_id % 97)::DOUBLE AS score FROM detections),
  g AS (SELECT media_id, media_id || '-' || k // 6 AS clip_id, k*30000 AS g0, k*30000 + 20000 AS g1, k FROM (SELECT DISTINCT media_id FROM detections), range(0, 70) r(k)),
  gl AS (SELECT clip_id, g.media_id, g0, g1, list({'a': a, 'b': b} ORDER BY score DESC, a, b) AS ws FROM g JOIN w ON w.media_id = g.media_id AND a >= g0 AND b <= g1 GROUP BY ALL),
  f AS (SELECT clip_id, list_reduce(list([{'a': ws[1].a, 'b': ws[1].b}] ORDER BY g0), lambda acc, c: CASE WHEN len(acc) < 2 THEN list_concat(acc, c) ELSE acc END, CAST([] AS STRUCT(a BIGINT, b BIGINT)[])) AS u FROM gl GROUP BY clip_id)
  SELECT clip_id, x.a AS a_ms, x.b AS b_ms FROM (SELECT clip_id, unnest(u) AS x FROM f)"""))
def _(spark, sf):
    d = detections(spark, sf)
    w = d.select("media_id", F.col("t_ms").alias("a_ms"), (F.col("t_ms") + 800 + F.col("event_id") % 5 * 100).alias("b_ms"), (F.col("event_id") % 97).cast("double").alias("score"))
    g = d.select("media_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(69)))).select(
        "media_id", F.concat_ws("-", "media_id", F.floor(F.col("k") / 6)).alias("clip_id"), (F.col("k") * 30000).cast("bigint").alias("g0_ms"), (F.col("k") * 30000 + 20000).cast("bigint").alias("g1_ms"))
    return K.fill_gaps(w, g).select("clip_id", "a_ms", "b_ms")


@query("select_thumbnail_time", ctes("boxes", then="""
  , f AS (SELECT clip_id, t_ms, count(*)*sum(w*h) AS s FROM boxes WHERE frame // 50 % 2 = 0 GROUP BY ALL), c AS (SELECT DISTINCT clip_id FROM boxes)
  SELECT c.clip_id, coalesce(arg_max(t_ms, round(s*1000)*100000000 - t_ms), 5000)::BIGINT AS t_ms FROM c LEFT JOIN f USING (clip_id) GROUP BY c.clip_id"""))
def _(spark, sf):
    b = boxes(spark, sf)
    c = b.select(*CL).distinct().withColumns({"start_ms": F.lit(0), "end_ms": F.lit(10000)})
    f = b.where(F.floor(F.col("frame") / 50) % 2 == 0)
    return K.select_thumbnail_time(f, c).select("clip_id", F.col("t_ms").cast("bigint").alias("t_ms"))


@query("overlaps", ctes("boxes", then="""
   SELECT clip_id, frame, is_person, round(ix*iy/(w*h + 0.2*h - ix*iy)*1000000)::BIGINT AS area, round(greatest(0, least(t_ms + 300, t_ms + 250) - t_ms - frame % 400)/(greatest(t_ms + 300, t_ms + 250) - t_ms)*1000000)::BIGINT AS span FROM (
     SELECT *, greatest(0, least(x + w, x + 0.05 + 0.2) - greatest(x, x + 0.05)) AS ix, greatest(0, least(y + h, y - 0.02 + h) - greatest(y, y - 0.02)) AS iy FROM boxes) WHERE frame % 400 < 250
   UNION ALL SELECT clip_id, frame, is_person, -1, 0 FROM boxes WHERE frame % 400 >= 250"""))
def _(spark, sf):
    b = boxes(spark, sf)
    area = iou_2d(F.struct("x", "y", "w", "h"), F.struct((F.col("x") + 0.05).alias("x"), (F.col("y") - 0.02).alias("y"), F.lit(0.2).alias("w"), "h"))
    span = iou_1d(F.col("t_ms"), F.col("t_ms") + 300, F.col("t_ms") + F.col("frame") % 400, F.col("t_ms") + 250)
    near = F.col("frame") % 400 < 250
    return b.select("clip_id", "frame", "is_person", F.when(near, F.round(area * 1000000)).otherwise(-1).cast("bigint").alias("area"),
                    F.when(near, F.round(span * 1000000)).otherwise(0).cast("bigint").alias("span"))
