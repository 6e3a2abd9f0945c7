"""Views over the given tables that play the engine's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

SPLIT = "[ \\t\\r\\n]+"
FIN = "[.!?]$"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Stored bytes of text whose words one task takes: sorted, they need over a hundred times as much memory.
TASK_BYTES = 1 << 20


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """Shuffle whole texts by key before they are exploded: far fewer bytes than their words, and
    the steps that follow need the same partitioning. There are as many tasks as the stored size asks for."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(n, size // TASK_BYTES) if size < 1 << 50 else n, key)  # without files the size is unknown


def words(spark, sf) -> DataFrame:
    """``documents`` as a transcript: one row per word at a fixed pace."""
    docs = spread_rows(table(spark, sf, "documents").select(F.col("doc_id").alias("media_id"), "lang", "text"), "media_id").select(
        "media_id", "lang", F.filter(F.split("text", SPLIT), lambda x: x != "").alias("ws"))
    # sentence ends of the recording (of all its rows, should there be several) cut its words into stretches with one pause
    # count, so that only documents are ordered, never their words
    own = F.filter(F.transform("ws", lambda x, i: F.when(x.rlike(FIN), F.struct(i.alias("at"), F.col("row").alias("row")))), lambda x: x.isNotNull())
    rows = W.partitionBy("media_id")
    d = docs.withColumn("row", F.row_number().over(rows.orderBy("lang"))).withColumn("own", own)
    d = d.withColumn("ends", F.when(F.count("*").over(rows) > 1, F.array_sort(F.flatten(F.collect_list("own").over(rows)))).otherwise(F.col("own")))

    def begin(j):
        end = F.get("ends", j - 1)
        return F.when(j == 0, 0).otherwise(end["at"] + F.when(F.col("row") > end["row"], 0).otherwise(1))

    def stretch(j):
        till = F.when(j < F.size("ends"), begin(j + 1)).otherwise(F.greatest(F.size("ws"), begin(j)))
        return F.struct(begin(j).alias("lo"), j.alias("pauses"), F.slice("ws", begin(j) + 1, till - begin(j)).alias("ws"))

    s = d.select("media_id", "lang", "row", "ends", F.explode(F.transform(F.sequence(F.lit(0), F.size("ends")), stretch)).alias("s"))
    last = F.get("ends", F.col("s.pauses"))
    w = s.select("media_id", "lang", F.col("s.lo").alias("lo"), F.col("s.pauses").alias("pauses"), F.when(last["row"] == F.col("row"), last["at"]).alias("end"),
                 F.posexplode("s.ws").alias("i", "text"))
    pos = (F.col("lo") + F.col("i")).cast("bigint")
    return w.select("media_id", "lang", pos.alias("pos"), (F.lit(420) * pos + F.lit(700) * F.col("pauses").cast("bigint")).alias("t_ms"), F.lit(378).cast("bigint").alias("d_ms"),
                    "text", F.coalesce((F.col("lo") + F.col("i") == F.col("end")).cast("int"), F.lit(0)).alias("fin"))


def speaker_words(spark, sf) -> DataFrame:
    conv = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("media_id"), "turn", "role",
        F.posexplode(F.filter(F.split("text", SPLIT), lambda x: x != "")).alias("p", "text"))
    order = W.partitionBy("media_id").orderBy("turn", "role", "p")
    past = order.rowsBetween(W.unboundedPreceding, -1)
    fin = F.col("text").rlike(FIN).cast("int")
    return (conv.withColumn("pos", (F.row_number().over(order) - 1).cast("bigint"))
            .withColumn("t_ms", F.lit(420) * F.col("pos") + F.lit(700) * F.coalesce(F.sum(fin).over(past), F.lit(0)))
            .select("media_id", "pos", "t_ms", F.lit(378).cast("bigint").alias("d_ms"), "text",
                    F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2)
                    .otherwise(0).alias("speaker")))


def media(spark, sf) -> DataFrame:
    """One row per transcript with its settings."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("media_id"), F.col("lang").alias("language"),
        F.element_at(F.array(*[F.lit(p) for p in ("tiktok", "reels", "shorts", "generic")]),
                     (F.col("doc_id") % 4 + 1).cast("int")).alias("platform"),
        F.lit(15000).cast("bigint").alias("min_len_ms"), F.lit(60000).cast("bigint").alias("max_len_ms"),
        F.lit(10).alias("target_clips"), (F.col("n_chars") * 80).cast("bigint").alias("duration_ms"))


def detections(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events")
    src = F.element_at(F.array(F.lit("cue"), F.lit("ocr"), F.lit("audio")), (F.col("event_id") % 3 + 1).cast("int"))
    ms = (F.hour("ts") * 3600 + F.minute("ts") * 60) * 1000 + F.floor(F.extract(F.lit("SECOND"), "ts") * 1000)
    return ev.select(F.dayofmonth("ts").cast("bigint").alias("media_id"), "event_id",
                     F.floor(ms / 40).cast("bigint").alias("t_ms"), src.alias("source"),
                     F.col("event_type").alias("label"), F.lit("").alias("detail"),
                     F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"))


def event_media(spark, sf) -> DataFrame:
    return (table(spark, sf, "events").select(F.dayofmonth("ts").cast("bigint").alias("media_id")).distinct()
            .select("media_id", F.lit(2_160_000).cast("bigint").alias("duration_ms"),
                    F.lit(10000).cast("bigint").alias("min_len_ms"), F.lit(30000).cast("bigint").alias("max_len_ms"),
                    F.lit(8).alias("target_clips"),
                    F.element_at(F.array(*[F.lit(g) for g in ("generic", "valorant", "cs2", "league")]),
                                 (F.col("media_id") % 4 + 1).cast("int")).alias("game_profile")))


def envelope(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events").select(F.dayofmonth("ts").cast("bigint").alias("media_id"), "ts", "event_id", "value")
    frame = F.row_number().over(W.partitionBy("media_id").orderBy("ts", "event_id")).cast("bigint") - 1
    return ev.select("media_id", frame.alias("frame"), (frame * 100).alias("t_ms"), F.col("value").alias("rms"))


def peaks(spark, sf) -> DataFrame:
    """Every envelope frame as a peak with a clip around it."""
    e = envelope(spark, sf)
    return e.select("media_id", F.concat_ws("-", "media_id", "frame").alias("clip_id"),
                    F.col("frame").alias("peak_frame"), F.col("t_ms").alias("peak_ms"),
                    F.greatest(F.col("t_ms") - 2000, F.lit(0)).alias("start_ms"),
                    (F.col("t_ms") + 3000).alias("end_ms"))


def event_clips(spark, sf) -> DataFrame:
    """Clips around every confident detection, as the gameplay builders would make."""
    d = detections(spark, sf)
    return d.select("media_id", F.concat_ws("-", F.lit("c"), F.col("event_id")).alias("clip_id"),
                    F.greatest(F.col("t_ms") - 12000, F.lit(0)).alias("start_ms"),
                    (F.col("t_ms") + 9000).alias("end_ms"), F.col("t_ms").alias("peak_ms"),
                    F.col("source").alias("kind"), "label", (F.lit(40) + F.col("event_id") % 50).cast("int").alias("score"),
                    F.when(F.col("source") == "cue", F.array("t_ms")).otherwise(F.array().cast("array<bigint>")).alias("cue_times"))


def ratings(spark, sf) -> DataFrame:
    docs, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    fins = F.size(F.filter(F.split("text", SPLIT), lambda x: x.rlike(FIN)))
    n = F.size(F.filter(F.split("text", SPLIT), lambda x: x != ""))
    base = docs.join(lab, "doc_id").select(
        F.col("doc_id").alias("clip_id"), F.concat(F.lit("score:talking:"), "lang").alias("scope"),
        F.create_map(F.lit("hook"), fins / F.greatest(n, F.lit(1)), F.lit("emotion"), F.col("n_chars") % 100 / 100.0,
                     F.lit("clarity"), F.col("doc_id") % 10 / 10.0).alias("features"),
        "quality", "toxic", F.col("doc_id").alias("ts"))
    a = base.select("clip_id", F.lit("explicit").alias("source"), "scope", F.col("quality").cast("double").alias("label"),
                    F.lit(1.0).alias("weight"), "features", "ts")
    b = base.select("clip_id", F.lit("trim").alias("source"), "scope", (1 - F.col("toxic")).cast("double").alias("label"),
                    F.lit(0.5).alias("weight"), "features", "ts")
    return a.unionByName(b)


def trims(spark, sf) -> DataFrame:
    return (table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id")
            .select(F.concat(F.lit("score:talking:"), "lang").alias("scope"),
                    ((F.col("doc_id") % 7 - 3) * 500).alias("ds_ms"), ((F.col("doc_id") % 5 - 2) * 500).alias("de_ms")))


def text_reads(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select((F.col("doc_id") % 50).alias("media_id"), F.col("doc_id").alias("read_id"),
                    (F.col("doc_id") * 1000).alias("t_ms"), F.col("source").alias("roi"),
                    "text", (F.col("n_chars") % 100 / 100.0).alias("conf"))


def windows_(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select((F.col("vec_id") % 20).alias("media_id"), (F.col("vec_id") * 5000).alias("t_mid_ms"),
                    F.col("vec_id"), "embedding")


def prompts(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return (e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
            .select(F.concat(F.lit("L"), F.col("label")).alias("label"),
                    F.when(F.col("label") <= 6, "pos").otherwise("neg").alias("polarity"), "embedding"))


LEXICON = {
    "en": dict(hook=["that"], emotion=["with"], payoff=["for"], dangling=["and"], second_person=["it"],
               quote_extra=["from"], enumeration=["to"], controversy=["by", "of the", "the the the the the"]),
    "fr": dict(hook=["que"], emotion=["pour"], payoff=["par"], dangling=["et"], second_person=["la"],
               quote_extra=["dans"], enumeration=["un"], controversy=["sur", "de la", "la des et"]),
    "de": dict(hook=["das"], emotion=["mit"], payoff=["auf"], dangling=["und"], second_person=["sich"],
               quote_extra=["von"], enumeration=["ein"], controversy=["für", "in der", "der der der"]),
    "es": dict(hook=["que"], emotion=["con"], payoff=["por"], dangling=["y"], second_person=["se"],
               quote_extra=["para"], enumeration=["un"], controversy=["no", "de la"]),
}


def lexicon(spark) -> DataFrame:
    rows = [(lang, role, term) for lang, roles in LEXICON.items() for role, terms in roles.items() for term in terms]
    return spark.createDataFrame(rows, "lang string, role string, term string")


def sql_values(rows, cols) -> str:
    def lit(v):
        return "NULL" if v is None else ("'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v))
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({cols})"


MARKERS = ["is", "est", "ist", "es"]
CLOSE = "regexp_matches(text, '[.!?]$')"

SQL_VIEWS = {
    "words": f"""
  SELECT media_id, lang, pos, 420*pos + 700*CAST(coalesce(sum(fin) OVER (PARTITION BY media_id ORDER BY pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS t_ms, CAST(378 AS BIGINT) AS d_ms, text, fin
  FROM (SELECT media_id, lang, CAST(pos - 1 AS BIGINT) AS pos, text, CAST({CLOSE} AS INT) AS fin FROM (
    SELECT doc_id AS media_id, lang, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '')) AS text,
           generate_subscripts(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> ''), 1) AS pos
    FROM documents))""",
    "speaker_words": f"""
  SELECT media_id, pos, 420*pos + 700*CAST(coalesce(sum(CAST({CLOSE} AS INT)) OVER (PARTITION BY media_id ORDER BY pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS t_ms, CAST(378 AS BIGINT) AS d_ms, text,
         CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END AS speaker
  FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY turn, role, p) - 1 AS pos FROM (
    SELECT conv_id AS media_id, turn, role, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '')) AS text,
           generate_subscripts(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> ''), 1) AS p
    FROM conversations))""",
    "media": """
  SELECT doc_id AS media_id, lang AS language, ['tiktok','reels','shorts','generic'][doc_id % 4 + 1] AS platform,
         CAST(15000 AS BIGINT) AS min_len_ms, CAST(60000 AS BIGINT) AS max_len_ms, 10 AS target_clips,
         CAST(n_chars * 80 AS BIGINT) AS duration_ms FROM documents""",
    "detections": """
  SELECT CAST(day(ts) AS BIGINT) AS media_id, event_id,
         CAST(((hour(ts)*3600 + minute(ts)*60)*1000 + millisecond(ts)) // 40 AS BIGINT) AS t_ms,
         ['cue','ocr','audio'][event_id % 3 + 1] AS source, event_type AS label, '' AS detail,
         least(value/100, 1.0) AS confidence FROM events""",
    "event_media": """
  SELECT DISTINCT CAST(day(ts) AS BIGINT) AS media_id, CAST(2160000 AS BIGINT) AS duration_ms, CAST(10000 AS BIGINT) AS min_len_ms,
         CAST(30000 AS BIGINT) AS max_len_ms, 8 AS target_clips,
         ['generic','valorant','cs2','league'][day(ts) % 4 + 1] AS game_profile FROM events""",
    "envelope": """
  SELECT media_id, frame, frame*100 AS t_ms, rms FROM (
    SELECT CAST(day(ts) AS BIGINT) AS media_id, row_number() OVER (PARTITION BY day(ts) ORDER BY ts, event_id) - 1 AS frame,
           value AS rms FROM events)""",
    "peaks": """
  SELECT media_id, media_id || '-' || frame AS clip_id, frame AS peak_frame, t_ms AS peak_ms,
         greatest(t_ms - 2000, 0) AS start_ms, t_ms + 3000 AS end_ms FROM envelope""",
    "event_clips": """
  SELECT media_id, 'c-' || event_id AS clip_id, greatest(t_ms - 12000, 0) AS start_ms, t_ms + 9000 AS end_ms, t_ms AS peak_ms,
         source AS kind, label, CAST(40 + event_id % 50 AS INT) AS score,
         CASE WHEN source = 'cue' THEN [t_ms] ELSE CAST([] AS BIGINT[]) END AS cue_times FROM detections""",
    "rating_base": """
  SELECT d.doc_id AS clip_id, 'score:talking:' || lang AS scope, quality, toxic,
         len(list_filter(ws, lambda x: regexp_matches(x, '[.!?]$'))) / greatest(len(list_filter(ws, lambda x: x <> '')), 1) AS hook,
         n_chars % 100 / 100.0 AS emotion, d.doc_id % 10 / 10.0 AS clarity
  FROM (SELECT *, regexp_split_to_array(text, '[ \\t\\r\\n]+') AS ws FROM documents) d JOIN labels USING (doc_id)""",
    "ratings": """
  SELECT clip_id, 'explicit' AS source, scope, CAST(quality AS DOUBLE) AS label, 1.0 AS weight, hook, emotion, clarity FROM rating_base
  UNION ALL SELECT clip_id, 'trim', scope, CAST(1 - toxic AS DOUBLE), 0.5, hook, emotion, clarity FROM rating_base""",
    "trims": """
  SELECT 'score:talking:' || lang AS scope, (doc_id % 7 - 3)*500 AS ds_ms, (doc_id % 5 - 2)*500 AS de_ms
  FROM documents JOIN labels USING (doc_id)""",
    "text_reads": """
  SELECT doc_id % 50 AS media_id, doc_id AS read_id, doc_id*1000 AS t_ms, source AS roi, text, n_chars % 100 / 100.0 AS conf
  FROM documents""",
    "audio_windows": """
  SELECT vec_id % 20 AS media_id, vec_id*5000 AS t_mid_ms, vec_id, embedding FROM embeddings""",
    "prompts": """
  SELECT 'L' || label AS label, CASE WHEN label <= 6 THEN 'pos' ELSE 'neg' END AS polarity, arg_min(embedding, vec_id) AS embedding
  FROM embeddings GROUP BY embeddings.label""",
    "lexicon": sql_values([(l, r, t) for l, rs in LEXICON.items() for r, ts in rs.items() for t in ts], "lang, role, term"),
}
NEEDS = {"peaks": ["envelope"], "event_clips": ["detections"], "ratings": ["rating_base"]}
