"""Caption, export and word-refinement queries."""

from pyspark.sql import functions as F

from checks import ctes, query
from checks.views import LEXICON, NEEDS, SQL_VIEWS, detections, event_clips, lexicon, speaker_words, sql_values, table, words
from momentlake.operators import captions as C
from momentlake.skew import local_join

CL = ["media_id", "clip_id"]


def spans(w):
    """A 20 s clip at the start of every minute of a recording."""
    last = w.groupBy("media_id").agg(F.max(F.col("t_ms") + F.col("d_ms")).alias("z"))
    k = last.select("media_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("z") / 60000))).alias("k"))
    return k.select("media_id", F.concat_ws("-", "media_id", "k").alias("clip_id"), (F.col("k") * 60000 + 1000).alias("start_ms"),
                    (F.col("k") * 60000 + 21000).alias("end_ms"))


def _spans_sql(src):
    return f"""SELECT media_id, media_id || '-' || k AS clip_id, k*60000 + 1000 AS start_ms, k*60000 + 21000 AS end_ms FROM (
      SELECT media_id, unnest(range(0, z // 60000 + 1)) AS k FROM (SELECT media_id, max(t_ms + d_ms) AS z FROM {src} GROUP BY media_id))"""


_clean = "trim(regexp_replace(trim(w.text), '^[\\s,;:.\\-–—]+', ''))"
SQL_VIEWS["spans"], NEEDS["spans"] = _spans_sql("words"), ["words"]
SQL_VIEWS["sspans"], NEEDS["sspans"] = _spans_sql("speaker_words"), ["speaker_words"]
SQL_VIEWS["caps"] = f"""SELECT s.media_id, s.clip_id, w.pos, w.lang, greatest(w.t_ms - s.start_ms, 0) AS t_ms,
   greatest(least(w.t_ms + w.d_ms - s.start_ms, s.end_ms - s.start_ms) - greatest(w.t_ms - s.start_ms, 0), 40) AS d_ms, {_clean} AS text
   FROM words w JOIN spans s ON w.media_id = s.media_id AND w.t_ms + w.d_ms > s.start_ms AND w.t_ms < s.end_ms
   WHERE regexp_matches({_clean}, '[A-Za-z0-9]')"""
NEEDS["caps"] = ["words", "spans"]
SQL_VIEWS["lined"] = """SELECT *, row_number() OVER (PARTITION BY clip_id, isl ORDER BY pos) - 1 AS r FROM (
   SELECT *, sum(b) OVER (PARTITION BY clip_id ORDER BY pos) AS isl FROM (
     SELECT *, CASE WHEN t_ms - lag(t_ms + d_ms) OVER (PARTITION BY clip_id ORDER BY pos) > 600 THEN 1 ELSE 0 END AS b FROM caps))"""
NEEDS["lined"] = ["caps"]
SQL_VIEWS["lines"] = "SELECT media_id, clip_id, pos, lang, t_ms, d_ms, text, dense_rank() OVER (PARTITION BY clip_id ORDER BY isl, r // 3) AS line FROM lined"
NEEDS["lines"] = ["lined"]


def caps(spark, sf):
    w = words(spark, sf)
    return C.caption_words(w, spans(w))


@query("words_in_span", ctes("words", "spans", then="SELECT s.clip_id, count(*) AS n, min(w.pos) AS lo, max(w.pos) AS hi FROM words w JOIN spans s ON w.media_id = s.media_id AND w.t_ms + w.d_ms > s.start_ms AND w.t_ms < s.end_ms GROUP BY s.clip_id"))
def _(spark, sf):
    w = words(spark, sf)
    return C.words_in_span(w, spans(w)).groupBy("clip_id").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))


@query("caption_words", ctes("caps", then="SELECT clip_id, pos, t_ms, d_ms, text FROM caps"))
def _(spark, sf):
    return caps(spark, sf).select("clip_id", "pos", "t_ms", "d_ms", "text")


@query("caption_lines", ctes("lines", then="SELECT clip_id, pos, line FROM lines"))
def _(spark, sf):
    return C.caption_lines(caps(spark, sf), 3, 600).select("clip_id", "pos", F.col("line").cast("bigint").alias("line"))


EMOJI = [("the", "A"), ("le", "B"), ("der", "C"), ("el", "D")]
_terms = " OR ".join(f"(lang = '{lang}' AND tok IN ({', '.join(repr(t) for r in ('hook', 'emotion', 'second_person', 'quote_extra', 'payoff', 'enumeration') for t in rs[r])}))" for lang, rs in LEXICON.items())


@query("annotate_emphasis", ctes("lines", then=f"""
  , h AS (SELECT *, (regexp_matches(text, '\\d') OR coalesce({_terms}, false))::INT AS hit, (tok IN ('the','le','der','el'))::INT AS em FROM (
      SELECT *, nullif(regexp_extract(lower(text), '[a-zà-ÿ'']+'), '') AS tok FROM lines))
  SELECT clip_id, pos, hit = 1 AND sum(hit) OVER w <= 2 AS emphasis,
    CASE WHEN em = 1 AND sum(em) OVER w <= 1 THEN CASE tok WHEN 'the' THEN 'A' WHEN 'le' THEN 'B' WHEN 'der' THEN 'C' ELSE 'D' END END AS emoji
  FROM h WINDOW w AS (PARTITION BY clip_id, line ORDER BY pos)"""))
def _(spark, sf):
    em = spark.createDataFrame(EMOJI, "term string, emoji string")
    return C.annotate_emphasis(caps(spark, sf), lexicon(spark), em, 3, 600).select("clip_id", "pos", "emphasis", "emoji")


@query("word_display_end", ctes("lines", then="""
  SELECT clip_id, pos, greatest(CASE WHEN coalesce(nx, own) - own > 30 THEN own + 15 ELSE coalesce(nx, own) END, t_ms + 80) AS end_ms FROM (
    SELECT *, t_ms + d_ms AS own, lead(t_ms) OVER (PARTITION BY clip_id, line ORDER BY pos) AS nx FROM lines)"""))
def _(spark, sf):
    return C.word_display_end(C.caption_lines(caps(spark, sf), 3, 600), 30, 15).select("clip_id", "pos", "end_ms")


_ts = lambda x, dot: f"printf('%02d:%02d:%02d{dot}%03d', {x}//3600000, {x}%3600000//60000, {x}%60000//1000, {x}%1000)"
SQL_VIEWS["blocks"] = f"""SELECT clip_id, line, min(t_ms) AS a, arg_max(t_ms + d_ms, pos) AS b, string_agg(text, ' ' ORDER BY pos) AS txt FROM lines GROUP BY clip_id, line"""
NEEDS["blocks"] = ["lines"]


@query("write_srt", ctes("blocks", then=f"SELECT clip_id, string_agg(line || chr(10) || {_ts('a', ',')} || ' --> ' || {_ts('b', ',')} || chr(10) || txt || chr(10), chr(10) ORDER BY line) || chr(10) AS text FROM blocks GROUP BY clip_id"))
def _(spark, sf):
    return C.write_srt(caps(spark, sf), 3, 600).select("clip_id", "text")


@query("write_vtt", ctes("blocks", then=f"SELECT clip_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_ts('a', '.')} || ' --> ' || {_ts('b', '.')} || chr(10) || txt || chr(10), chr(10) ORDER BY line) AS text FROM blocks GROUP BY clip_id"))
def _(spark, sf):
    return C.write_vtt(caps(spark, sf), 3, 600).select("clip_id", "text")


@query("speakers_in_span", ctes("speaker_words", "sspans", then="SELECT s.clip_id, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS speakers FROM speaker_words w JOIN sspans s ON w.media_id = s.media_id AND w.t_ms + w.d_ms > s.start_ms AND w.t_ms < s.end_ms WHERE regexp_matches(text, '[A-Za-z0-9]') GROUP BY s.clip_id"))
def _(spark, sf):
    w = speaker_words(spark, sf)
    return C.speakers_in_span(w, spans(w)).select("clip_id", F.array_join(F.transform("speakers", lambda x: x.cast("string")), ",").alias("speakers"))


@query("speaker_filter", ctes("speaker_words", then="SELECT media_id, count(*) AS n FROM speaker_words WHERE speaker IN (0, 2) GROUP BY media_id"))
def _(spark, sf):
    w = speaker_words(spark, sf).withColumn("speaker", F.when(F.col("speaker") != 0, F.col("speaker")))
    return C.speaker_filter(w, F.array(F.lit(0), F.lit(2))).groupBy("media_id").agg(F.count("*").alias("n"))


# speech intervals: each 20 s clip's first 7 s, each word's neighbourhood is thus cut at 8 s
_speech = "SELECT media_id, start_ms + 130 AS a, start_ms + 7001 AS b FROM spans"


@query("refine_to_speech", ctes("words", "spans", then=f"""
  , sp AS ({_speech}), j AS (SELECT w.media_id, w.pos, w.t_ms, w.d_ms, a, b, least(w.t_ms + w.d_ms, b) - greatest(w.t_ms, a) AS ov
     FROM words w JOIN sp ON w.media_id = sp.media_id AND w.t_ms + w.d_ms > a AND w.t_ms < b),
  best AS (SELECT *, row_number() OVER (PARTITION BY media_id, pos ORDER BY ov DESC, a, b) AS r FROM j WHERE ov >= 100),
  o AS (SELECT media_id, pos, greatest(t_ms, a - 60) AS t_ms, least(t_ms + d_ms, b + 60) AS z FROM best WHERE r = 1)
  SELECT media_id, pos, t_ms, greatest(z, t_ms + 40) - t_ms AS d_ms FROM o
  UNION ALL SELECT media_id, pos, t_ms, d_ms FROM words WHERE media_id NOT IN (SELECT media_id FROM o)"""))
def _(spark, sf):
    w = words(spark, sf)
    sp = spans(w).select("media_id", (F.col("start_ms") + 130).alias("a_ms"), (F.col("start_ms") + 7001).alias("b_ms"))
    return C.refine_to_speech(w, sp).select("media_id", "pos", "t_ms", "d_ms")


@query("mute_spans", ctes("words", "spans", then="SELECT media_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS s FROM words w WHERE NOT EXISTS (SELECT 1 FROM spans m WHERE m.media_id = w.media_id AND w.t_ms < m.start_ms + 2600 AND w.t_ms + w.d_ms > m.start_ms - 400) GROUP BY media_id"))
def _(spark, sf):
    w = words(spark, sf)
    cues = spans(w).select("media_id", F.col("start_ms").alias("t_ms"))
    return C.mute_spans(w, C.cue_mutes(cues)).groupBy("media_id").agg(F.count("*").alias("n"), F.sum("pos").alias("s"))


SQL_VIEWS["segs"] = """SELECT clip_id, media_id, unnest(CASE WHEN n >= 2 AND end_ms - start_ms - sp >= 500 THEN ss ELSE [{'a': start_ms, 'b': end_ms}] END) AS x FROM (
   SELECT s.*, n, sp, ss FROM spans s LEFT JOIN (
     SELECT clip_id, count(*) AS n, sum(b - a) AS sp, list({'a': a, 'b': b} ORDER BY a) AS ss FROM (
       SELECT clip_id, seg, greatest(start_ms, min(a) - 120) AS a, least(end_ms, max(b) + 120) AS b FROM (
         SELECT *, sum(CASE WHEN a - reach > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY pos) AS seg FROM (
           SELECT *, max(b) OVER (PARTITION BY clip_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (
             SELECT s.clip_id, s.start_ms, s.end_ms, w.pos, greatest(w.t_ms, s.start_ms) AS a, least(w.t_ms + w.d_ms, s.end_ms) AS b
             FROM words w JOIN spans s ON w.media_id = s.media_id AND w.t_ms + w.d_ms > s.start_ms AND w.t_ms < s.end_ms)))
       GROUP BY clip_id, start_ms, end_ms, seg) GROUP BY clip_id) g USING (clip_id))"""
NEEDS["segs"] = ["spans", "words"]
SQL_VIEWS["based"] = "SELECT clip_id, media_id, x.a AS a, x.b AS b, coalesce(sum(x.b - x.a) OVER (PARTITION BY clip_id ORDER BY x.a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM segs"
NEEDS["based"] = ["segs"]


def _segs(spark, sf):
    w = words(spark, sf)
    # the pace leaves 742 ms between sentences: a 200 ms gap makes every sentence a segment
    return C.tight_segments(w, spans(w), gap_ms=200)


@query("tight_segments", ctes("segs", then="SELECT clip_id, x.a AS a_ms, x.b AS b_ms FROM segs"))
def _(spark, sf):
    return _segs(spark, sf).select("clip_id", "a_ms", "b_ms")


@query("map_to_tight", ctes("spans", "based", then="""
  SELECT clip_id, t_ms, CAST(coalesce(min(base + greatest(t_ms - a, 0)) FILTER (t_ms <= b), max(base + b - a)) AS BIGINT) AS tight_ms FROM (
    SELECT clip_id, start_ms + 777 * k AS t_ms FROM spans, range(0, 26) r(k)) JOIN based USING (clip_id) GROUP BY clip_id, t_ms"""))
def _(spark, sf):
    t = spans(words(spark, sf)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(25)))).select(*CL, (F.col("start_ms") + 777 * F.col("k")).alias("t_ms"))
    return C.map_to_tight(t, _segs(spark, sf)).select("clip_id", "t_ms", "tight_ms")


@query("caption_words_tight", ctes("based", "words", then=f"""
  SELECT clip_id, pos, CAST(base + greatest(t_ms, a) - a AS BIGINT) AS t_ms, greatest(least(t_ms + d_ms, b) - greatest(t_ms, a), 40) AS d_ms, txt AS text FROM (
    SELECT s.clip_id, s.a, s.b, s.base, w.pos, w.t_ms, w.d_ms, {_clean} AS txt, row_number() OVER (PARTITION BY clip_id, w.pos ORDER BY a) AS r
    FROM based s JOIN words w ON w.media_id = s.media_id AND w.t_ms + w.d_ms > s.a AND w.t_ms < s.b) WHERE r = 1 AND regexp_matches(txt, '[A-Za-z0-9]')"""))
def _(spark, sf):
    return C.caption_words_tight(words(spark, sf), _segs(spark, sf)).select("clip_id", "pos", "t_ms", "d_ms", "text")


PH = ["of the", "de la", "in der", "and"]


@query("remove_phrases", ctes("caps", then="""
  , t AS (SELECT *, regexp_replace(lower(text), '[^a-zà-ÿ0-9]', '', 'g') AS k, row_number() OVER (PARTITION BY clip_id ORDER BY pos) AS i FROM caps),
  h AS (SELECT a.clip_id, a.i, a.i AS j FROM t a WHERE a.k = 'and' UNION ALL
        SELECT a.clip_id, a.i, b.i FROM t a JOIN t b ON a.clip_id = b.clip_id AND b.i = a.i + 1 WHERE a.k || ' ' || b.k IN ('of the', 'de la', 'in der')),
  d AS (SELECT clip_id, i AS x FROM h UNION SELECT clip_id, j FROM h)
  SELECT t.clip_id, t.pos, t.text FROM t WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.clip_id = t.clip_id AND d.x = t.i)"""))
def _(spark, sf):
    return C.remove_phrases(caps(spark, sf), spark.createDataFrame([(p,) for p in PH], "phrase string")).select("clip_id", "pos", "text")


@query("apply_corrections", ctes("words", then="""
  , big AS (SELECT media_id FROM words GROUP BY media_id HAVING count(*) >= 20)
  SELECT w.media_id, count(*) FILTER (text <> nt) AS changed, CAST(sum(length(nt)) AS BIGINT) AS chars FROM (SELECT words.*, CASE WHEN words.media_id IN (SELECT media_id FROM big) AND media_id % 2 = 0
     THEN CASE lower(trim(text)) WHEN 'the' THEN 'THE!' WHEN 'la' THEN '' WHEN 'der' THEN 'dieser' ELSE text END ELSE text END AS nt FROM words) w GROUP BY w.media_id"""))
def _(spark, sf):
    w = words(spark, sf)
    c = table(spark, sf, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("media_id"), F.explode(F.array(*[
        F.struct(F.lit(a).alias("original"), F.lit(b).alias("corrected")) for a, b in ((" The", "THE!"), ("la", ""), ("der", "dieser"), ("y", "Y"))])).alias("x")
    ).select("media_id", "x.*")
    n = C.apply_corrections(w, c).select("media_id", "pos", F.col("text").alias("nt"))
    return local_join(w, n, ["media_id", "pos"]).groupBy("media_id").agg(F.count_if(F.col("text") != F.col("nt")).alias("changed"), F.sum(F.length("nt")).alias("chars"))


@query("zoom_spikes", ctes("caps", then="""
  , e AS (SELECT clip_id, t_ms FROM caps WHERE length(text) > 6),
  k AS (SELECT clip_id, unnest(list_reduce(list([t_ms] ORDER BY t_ms), lambda acc, c: CASE WHEN len(acc) = 0 OR c[1] - acc[len(acc)] >= 600 THEN list_concat(acc, c) ELSE acc END,
        CAST([] AS BIGINT[]))) AS t_ms FROM e GROUP BY clip_id)
  SELECT clip_id, t_ms, 1.12::DOUBLE AS peak, 450 AS span_ms FROM k UNION ALL SELECT clip_id, 5000, 1.08, 300 FROM (SELECT DISTINCT clip_id FROM caps)"""))
def _(spark, sf):
    c = caps(spark, sf).withColumn("emphasis", F.length("text") > 6)
    cuts = c.select(*CL).distinct().withColumn("t_ms", F.lit(5000).cast("bigint"))
    return C.zoom_spikes(c, cuts).select("clip_id", "t_ms", "peak", "span_ms")


def exported(spark, sf):
    c = event_clips(spark, sf)
    n = F.substring("clip_id", 3, 20).cast("bigint")
    return c.withColumn("title", F.concat(F.lit("Clip: the «best» "), "label", F.lit(" / "), n.cast("string"))).withColumn(
        "export_url", F.when(n % 3 != 0, F.concat(F.lit("/exports/"), "clip_id", F.lit(".mp4")))).withColumn(
        "start_ms", F.col("start_ms") + 17)


def edl_media(spark, sf):
    return event_clips(spark, sf).select("media_id").distinct().select(
        "media_id", F.concat(F.lit("Project "), "media_id").alias("name"), F.concat("media_id", F.lit(".mp4")).alias("filename"),
        F.concat(F.lit("/in/"), "media_id", F.lit(".mp4")).alias("path"), F.when(F.col("media_id") % 4 == 0, 0.0).otherwise(25 + F.col("media_id") % 3 * 17.5).alias("fps"))


SQL_VIEWS["exported"] = """SELECT * REPLACE (start_ms + 17 AS start_ms), 'Clip: the «best» ' || label || ' / ' || substring(clip_id, 3) AS title,
   CASE WHEN CAST(substring(clip_id, 3) AS BIGINT) % 3 <> 0 THEN '/exports/' || clip_id || '.mp4' END AS export_url FROM event_clips"""
NEEDS["exported"] = ["event_clips"]
SQL_VIEWS["timeline"] = """SELECT *, coalesce(sum(out_f - in_f) OVER (PARTITION BY media_id ORDER BY score DESC, start_ms, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rec_f,
   row_number() OVER (PARTITION BY media_id ORDER BY score DESC, start_ms, clip_id) AS n FROM (
   SELECT *, greatest(round_even(start_ms*fps/1000.0, 0), 0)::BIGINT AS in_f, greatest(round_even(end_ms*fps/1000.0, 0), round_even(start_ms*fps/1000.0, 0))::BIGINT AS out_f FROM (
     SELECT *, CASE WHEN media_id % 4 = 0 THEN 30 ELSE round_even(25 + media_id % 3 * 17.5, 0) END::BIGINT AS fps FROM exported WHERE export_url IS NOT NULL))"""
NEEDS["timeline"] = ["exported"]


@query("record_timeline", ctes("timeline", then="SELECT clip_id, n, in_f, out_f, rec_f FROM timeline"))
def _(spark, sf):
    c = exported(spark, sf).where("export_url is not null").join(edl_media(spark, sf).select("media_id", "fps"), "media_id")
    return C.record_timeline(c).select("clip_id", F.col("n").cast("bigint").alias("n"), "in_f", "out_f", "rec_f")


_tc = lambda f: f"printf('%02d:%02d:%02d:%02d', {f}//fps//3600, {f}//fps//60%60, {f}//fps%60, {f}%fps)"


@query("write_edl", ctes("timeline", then=f"""SELECT media_id, 'TITLE: Project ' || media_id || chr(10) || 'FCM: NON-DROP FRAME' || chr(10) || chr(10) || string_agg(
    printf('%03d', n) || '  AX       V     C        ' || {_tc('in_f')} || ' ' || {_tc('out_f')} || ' ' || {_tc('rec_f')} || ' ' || {_tc('(rec_f + out_f - in_f)')} || chr(10)
    || '* FROM CLIP NAME: ' || media_id || '.mp4' || chr(10) || '* SOURCE FILE: /in/' || media_id || '.mp4' || chr(10) || '* COMMENT: ' || printf('%02d', score) || ' - ' || title,
    chr(10) || chr(10) ORDER BY n) || chr(10) AS text FROM timeline GROUP BY media_id"""))
def _(spark, sf):
    return C.write_edl(exported(spark, sf), edl_media(spark, sf))


def cuts(spark, sf):
    return detections(spark, sf).where("label = 'view'").select("media_id", "t_ms").distinct()


@query("snap_to_cuts", ctes("event_clips", "detections", then="""
  SELECT c.clip_id, coalesce(arg_min(d.t_ms, abs(d.t_ms - c.start_ms)*10000000 + d.t_ms) FILTER (c.end_ms - d.t_ms >= 3000), c.start_ms) AS start_ms FROM event_clips c
  LEFT JOIN (SELECT DISTINCT media_id, t_ms FROM detections WHERE label = 'view') d ON d.media_id = c.media_id AND abs(d.t_ms - c.start_ms) <= 1500 GROUP BY c.clip_id, c.start_ms"""))
def _(spark, sf):
    return C.snap_to_cuts(event_clips(spark, sf), cuts(spark, sf)).select("clip_id", "start_ms")


@query("pick_cutaway", ctes("event_clips", "detections", then="""
  SELECT c.clip_id, arg_min(d.t_ms, abs(2*d.t_ms - c.start_ms - c.end_ms)*10000000 + d.t_ms) AS a_ms FROM event_clips c
  JOIN (SELECT DISTINCT media_id, t_ms FROM detections WHERE label = 'view') d ON d.media_id = c.media_id AND d.t_ms >= c.start_ms AND d.t_ms + 1500 <= c.end_ms
  WHERE c.end_ms - c.start_ms >= 5000 GROUP BY c.clip_id"""))
def _(spark, sf):
    return C.pick_cutaway(event_clips(spark, sf), cuts(spark, sf)).select("clip_id", "a_ms")
