"""Readers, keyed tables and exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from momentlake.functions.text import clamp
from momentlake.skew import CHUNK, CHUNK_ROWS, chunk_by_pos, durable, local_join, scan, top_k

# fixed values: accepted video file endings
VIDEO_ENDINGS = ["mp4", "mov", "mkv", "webm", "avi", "m4v", "mpg", "mpeg", "flv"]

MANIFEST = (
    "media_id string, filename string, path string, url string, duration double, width int, height int, fps string, "
    "size_bytes bigint, has_audio boolean, has_video boolean, codec string")

WORD = "struct<t:double,d:double,text:string,speaker:int>"
EVENT = "struct<t:double,source:string,label:string,detail:string,confidence:double>"
CLIP_DOC = "struct<id:string,start:double,end:double,title:string,score:int,kind:string,status:string,export_url:string,features:map<string,double>>"
PROJECT = (f"struct<id:string,name:string,status:string,created_at:double,source:struct<filename:string,duration:double,fps:double>,"
           f"transcript:struct<language:string,provider:string,words:array<{WORD}>>,clips:array<{CLIP_DOC}>,events:array<{EVENT}>>")


def ms(seconds) -> Column:
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.bround(c * 1000, 0).cast("bigint")


def parse_fps(text: Column) -> Column:
    """``num/den`` or a number; 30 when it cannot be read."""
    num, den = F.split(text, "/")[0].try_cast("double"), F.coalesce(F.get(F.split(text, "/"), F.lit(1)), F.lit("1")).try_cast("double")
    return F.coalesce(F.when((den > 0) & (num > 0), num / den), F.lit(30.0))


def read_media_manifest(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return media_manifest(spark.read.schema(MANIFEST).format(fmt).load(path))


def media_manifest(raw: DataFrame) -> DataFrame:
    """Probed media with a known ending, a video stream and a positive duration."""
    ending = F.lower(F.regexp_extract("filename", "\\.([^.]+)$", 1))
    ok = ending.isin(VIDEO_ENDINGS) & F.col("has_video") & (F.col("duration") > 0)
    return raw.where(ok).withColumns({"duration_ms": ms("duration"), "fps": parse_fps(F.col("fps"))}).drop("duration")


def read_project_documents(docs: DataFrame, column: str = "data") -> dict[str, DataFrame]:
    """One JSON document per row to flat tables; documents that do not parse go to ``bad``."""
    d = durable(docs.withColumn("p", F.from_json(column, PROJECT, {"mode": "PERMISSIVE"})))  # parsed once for all tables
    bad = d.where(F.col("p.id").isNull()).drop("p")
    p = d.where(F.col("p.id").isNotNull()).select(F.col("p.id").alias("media_id"), "p")
    words = p.select("media_id", F.posexplode("p.transcript.words").alias("pos", "w")).select(
        "media_id", F.col("pos").cast("bigint").alias("pos"), ms(F.col("w.t")).alias("t_ms"), ms(F.col("w.d")).alias("d_ms"), "w.text", F.coalesce("w.speaker", F.lit(0)).alias("speaker"))
    clips = p.select("media_id", F.explode("p.clips").alias("c")).select(
        "media_id", F.col("c.id").alias("clip_id"), ms(F.col("c.start")).alias("start_ms"), ms(F.col("c.end")).alias("end_ms"), "c.title",
        F.coalesce("c.score", F.lit(0)).alias("score"), "c.kind", "c.status", "c.export_url", "c.features")
    events = p.select("media_id", F.posexplode("p.events").alias("event_id", "e")).select(
        "media_id", F.col("event_id").cast("bigint").alias("event_id"), ms(F.col("e.t")).alias("t_ms"), "e.source", "e.label", "e.detail", "e.confidence")
    media = p.select("media_id", "p.name", "p.status", "p.created_at", F.col("p.source.filename").alias("filename"), ms(F.col("p.source.duration")).alias("duration_ms"),
                     F.coalesce("p.source.fps", F.lit(30.0)).alias("fps"), "p.transcript.language", "p.transcript.provider")
    return {"media": media, "words": words, "clips": clips, "events": events, "bad": bad}


def words_from_asr(asr: DataFrame, min_d_ms: int = 20, min_prob: float = 0.3, min_score: float = -10.0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Recogniser output ``(media_id, idx, word, start, end, score, probability, speaker)`` to words:
    doubtful words dropped, speakers numbered from 1 by first appearance, 0 = unlabelled."""
    w = asr.withColumn("text", F.trim(F.coalesce("word", F.lit("")))).where("text != '' and start is not null and end is not null")
    d = F.bround((F.col("end") - F.col("start")) * 1000, 3)
    w = w.where((d >= min_d_ms) & (F.coalesce("score", F.lit(0.0)) >= min_score) & (F.coalesce("probability", F.lit(1.0)) >= min_prob))
    first = w.where(F.coalesce("speaker", F.lit("")) != "").groupBy("media_id", "speaker").agg(F.min("idx").alias("_f"))
    ids = first.withColumn("_id", F.row_number().over(W.partitionBy("media_id").orderBy("_f")))  # speakers of a recording: few
    w = scan(chunk_by_pos(w, "idx", chunk_rows), ["media_id"], ["idx"], sums={"pos": F.lit(1)}, few=True).drop(CHUNK)
    w = local_join(w, ids.drop("_f"), ["media_id", "speaker"], "left")
    return w.select("media_id", F.col("pos").cast("bigint").alias("pos"), ms("start").alias("t_ms"), F.greatest(ms(F.col("end") - F.col("start")), F.lit(10)).alias("d_ms"),
                    "text", F.coalesce("_id", F.lit(0)).alias("speaker"))


def synthetic_words(media: DataFrame, filler: DataFrame, pace_ms: int = 420, pause_ms: int = 700) -> DataFrame:
    """Deterministic filler transcript: a word every ``pace_ms``, sentences of 10 to 14 words.

    Sentence s ends at word e(s); its length follows from the previous end, with a period of a few
    sentences, so the ends come from one fold per recording and words from ``sequence``.
    """
    f = filler.groupBy("language").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "word"))), lambda x: x["word"]).alias("_f"))
    m = media.select("media_id", F.substring(F.lower(F.coalesce("language", F.lit("en"))), 1, 2).alias("language"), F.greatest("duration_ms", F.lit(5000)).alias("_d"))
    known = f.select("language").withColumn("_k", F.lit(True))
    m = m.join(known, "language", "left").withColumn("language", F.when(F.col("_k"), F.col("language")).otherwise("en")).join(f, "language")
    guess = F.sequence(F.lit(1), F.floor(F.col("_d") / (10 * pace_ms + pause_ms)).cast("int") + 1)
    kind = "array<int>"
    ends = F.aggregate(guess, F.array(F.lit(9)).cast(kind), lambda a, i: F.concat(a, F.array((F.element_at(a, -1) + 10 + F.element_at(a, -1) % 5).cast("int"))))
    s = m.withColumn("_e", ends).select("media_id", "_d", "_f", F.posexplode("_e").alias("_s", "_end"), "_e")
    s = s.withColumn("_start", F.when(F.col("_s") == 0, 0).otherwise(F.try_element_at("_e", F.greatest(F.col("_s"), F.lit(1))) + 1)).drop("_e")
    w = s.select("media_id", "_d", "_f", "_s", "_end", F.explode(F.sequence("_start", "_end")).alias("pos"))
    t = F.col("pos").cast("bigint") * pace_ms + F.col("_s") * pause_ms
    text = F.get("_f", F.col("pos") % F.size("_f"))
    return w.where(t + pace_ms <= F.col("_d")).select("media_id", F.col("pos").cast("bigint").alias("pos"), t.alias("t_ms"), F.lit(pace_ms * 9 // 10).cast("bigint").alias("d_ms"),
                                                      F.when(F.col("pos") == F.col("_end"), F.concat(text, F.lit("."))).otherwise(text).alias("text"))


def read_lexicons(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """``lang, role, term`` rows."""
    r = spark.read.schema("lang string, role string, term string").format(fmt)
    return (r.option("header", True) if fmt == "csv" else r).load(path).select("lang", "role", F.lower(F.trim("term")).alias("term")).distinct()


def read_cue_documents(docs: DataFrame) -> dict[str, DataFrame]:
    """Cue documents ``(game, data JSON)`` to phrases, regions and false phrases: cleaned, clamped,
    once each. An older document is a plain map of labels to phrases."""
    kind = "struct<phrases:map<string,array<string>>,regions:map<string,array<struct<x:double,y:double,w:double,h:double>>>,`false`:map<string,array<string>>>"
    docs = docs.select("game", "data").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "game")  # a file may be one task
    d = durable(docs.select("game", F.from_json("data", kind).alias("n"), F.from_json("data", "map<string,array<string>>").alias("o")))  # parsed once
    is_new = F.col("n.phrases").isNotNull() | F.col("n.regions").isNotNull() | F.col("n.false").isNotNull()
    safe = F.substring(F.regexp_replace(F.replace(F.lower("label"), F.lit(" "), F.lit("_")), "[^a-z0-9äöüß_-]", ""), 1, 40)
    safe = F.when(safe == "", "cue").otherwise(safe)

    def phrases(c):
        # what concerns the label is done once a list, and few phrases have blanks within
        x = d.select("game", F.explode(c).alias("label", "ps")).select("game", safe.alias("label"), F.posexplode("ps").alias("ord", "phrase"))
        bare = F.trim("phrase")
        x = x.withColumn("phrase", F.when(bare.rlike("\\s"), F.trim(F.regexp_replace(bare, "\\s+", " "))).otherwise(bare)).where("phrase != ''")
        return x.groupBy("game", "label", F.lower("phrase").alias("_k")).agg(F.min_by("phrase", "ord").alias("phrase")).drop("_k")
    r = d.select("game", F.explode("n.regions").alias("label", "rs")).select("game", "label", F.explode("rs").alias("r"))
    w, h = clamp(F.col("r.w"), 0.02, 1.0), clamp(F.col("r.h"), 0.02, 1.0)
    r = r.select("game", safe.alias("label"), F.greatest(F.lit(0.0), F.least(F.col("r.x"), 1.0 - w)).alias("x"), F.greatest(F.lit(0.0), F.least(F.col("r.y"), 1.0 - h)).alias("y"),
                 w.alias("w"), h.alias("h")).distinct()
    return {"phrases": phrases(F.when(is_new, F.col("n.phrases")).otherwise(F.col("o"))), "regions": r, "false_phrases": phrases(F.col("n.false"))}


def read_styles(builtin: DataFrame, user: DataFrame) -> DataFrame:
    """Built-in caption styles, replaced by user styles of the same id."""
    u = builtin.withColumn("_p", F.lit(0)).unionByName(user.withColumn("_p", F.lit(1)))
    return u.groupBy("style_id").agg(F.max_by(F.struct(*builtin.columns), "_p").alias("s")).select("s.*")


def list_latest(projects: DataFrame, n: int = 100) -> DataFrame:
    """The newest projects, few columns (a top-n, not a full sort)."""
    return projects.select("media_id", "name", "status", "created_at").orderBy(F.desc("created_at"), "media_id").limit(n)


def upsert_latest(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Last write per key; aggregation keeps one row per key before the shuffle. Writes of equal time go by the row's hash."""
    order = F.struct(F.col(ts), F.xxhash64(*[f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def _keyed(df: DataFrame, keys: list[str], buckets: int, gone: bool) -> DataFrame:
    return df.withColumns({"_gone": F.lit(gone), "_bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")})


def write_keyed(rows: DataFrame, folder: str, keys: list[str], ts: str, buckets: int = 64, gone: bool = False) -> None:
    """Merge rows into the keyed table under ``folder``: last write per key.

    The table is partitioned by a bucket of the key. Only buckets that the rows touch are read, merged and replaced by
    Spark's dynamic partition overwrite, so the cost follows the batch and no old version stays behind. Writing the
    same rows again changes nothing. ``gone`` marks keys as deleted from ``ts`` on; the marks keep late rows out.
    ``buckets`` must stay the same for a table.
    """
    spark = rows.sparkSession
    rows = _keyed(rows, keys, buckets, gone)
    touched = [r["_bucket"] for r in rows.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    try:
        old = spark.read.parquet(folder).where(F.col("_bucket").isin(touched))
        rows = old.unionByName(rows, allowMissingColumns=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    merged = upsert_latest(rows, keys, ts).repartition("_bucket")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(folder)


def read_keyed(spark: SparkSession, folder: str) -> DataFrame:
    """Present rows of a keyed table."""
    return spark.read.parquet(folder).where("not _gone").drop("_gone", "_bucket")


def delete_keyed(tombstones: DataFrame, folder: str, keys: list[str], ts: str, buckets: int = 64) -> None:
    """Delete keys of a keyed table as of their ``ts``."""
    write_keyed(tombstones.select(*keys, ts), folder, keys, ts, buckets, gone=True)


def delete_keys(df: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(tombstones.select(*keys).distinct(), keys, "left_anti")


def reset_scope(df: DataFrame, scope: str | None = None) -> DataFrame:
    return df.limit(0) if scope is None else df.where(F.col("scope") != scope)


def write_manifest_csv(clips: DataFrame, path: str) -> None:
    manifest_rows(clips).write.mode("overwrite").partitionBy("media_id").option("header", True).csv(path)


def manifest_rows(clips: DataFrame) -> DataFrame:
    return clips.where("status = 'ready'").select(
        "media_id", "clip_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("score", F.lit(0)).alias("score"),
        (F.col("start_ms") / 1000.0).alias("start_sec"), (F.col("end_ms") / 1000.0).alias("end_sec"), ((F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("duration_sec"))


def safe_name(c: Column, keep: str = " \\-_", limit: int = 60) -> Column:
    s = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"[^\\p{{L}}\\p{{N}}{keep}]", "_"))
    return F.substring(F.when(s == "", "clip").otherwise(s), 1, limit)


def export_names(ranked: DataFrame, pattern: str | None = None) -> DataFrame:
    """File stem of every ranked clip (column ``rank``): ``NN_SS_title`` or the tokens
    {rank}, {title}, {score}, {id}, {duration}."""
    if pattern is None:
        name = F.concat_ws("_", F.lpad(F.col("rank").cast("string"), 2, "0"), F.lpad(F.col("score").cast("string"), 2, "0"), safe_name(F.col("title")))
    else:
        title = F.substring(F.regexp_replace(F.coalesce("title", F.lit("")), "[^\\p{L}\\p{N} _\\-.,()]", "_"), 1, 60)
        name = F.lit(pattern)
        for token, value in (("rank", F.col("rank").cast("string")), ("title", title), ("score", F.col("score").cast("string")), ("id", F.substring("clip_id", 1, 8)),
                             ("duration", F.format_number((F.col("end_ms") - F.col("start_ms")) / 1000.0, 1))):
            name = F.replace(name, F.lit("{" + token + "}"), value)
    return ranked.select("media_id", "clip_id", "rank", name.alias("name"))


def status_snapshot(clips: DataFrame, media: DataFrame) -> DataFrame:
    """Per project: status, rendered clips, and one card row per clip in ``cards``' order."""
    n = clips.groupBy("media_id").agg(F.count("*").alias("clips"), F.count_if(F.col("export_url").isNotNull()).alias("rendered"))
    return media.select("media_id", "status").join(n, "media_id", "left").na.fill(0, ["clips", "rendered"])


def clip_cards(clips: DataFrame) -> DataFrame:
    """Card of a clip: duration is the tightened one when there is one."""
    return clips.select("media_id", "clip_id", "title", "score", "kind",
                        (F.coalesce("tight_ms", F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("duration"), "export_url")


def project_summary(media: DataFrame, clips: DataFrame) -> DataFrame:
    n = clips.groupBy("media_id").agg(F.count("*").alias("clip_count"), F.count_if(F.col("export_url").isNotNull()).alias("ready_count"))
    return media.select("media_id", "duration_ms").join(n, "media_id", "left").na.fill(0, ["clip_count", "ready_count"])


def links_from_pages(pages: DataFrame, endings: str = "mp3|wav|ogg|m4a|aac|flac") -> DataFrame:
    """First absolute link with one of the endings, else the first quoted relative one resolved on
    the page URL."""
    absolute = F.regexp_extract("html", f"(?i)(https?://[^\"'\\s<>]+\\.(?:{endings}))", 1)
    relative = F.regexp_extract("html", f"(?i)[\"']([^\"'\\s<>]+\\.(?:{endings}))[\"']", 1)
    return resolve_links(pages, absolute, relative)


def resolve_links(pages: DataFrame, absolute: Column, relative: Column) -> DataFrame:
    root = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract("url", "^(https?://[^/?#]+(?:/[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    scheme = F.regexp_extract("url", "^(https?:)", 1)
    p = pages.withColumns({"_a": absolute, "_r": relative})
    full = (F.when(F.col("_a") != "", F.col("_a")).when(F.col("_r") == "", None).when(F.col("_r").startswith("//"), F.concat(scheme, "_r"))
            .when(F.col("_r").startswith("/"), F.concat(root, "_r")).otherwise(F.concat(folder, "_r")))
    return p.select("page_id", full.alias("link")).where("link is not null")


def cue_catalogue_status(catalogue: DataFrame, cues: DataFrame) -> DataFrame:
    have = cues.select("game", F.lower("event").alias("event")).distinct().withColumn("_h", F.lit(1))
    c = catalogue.select("game", F.lower("event").alias("event")).join(have, ["game", "event"], "left")
    return c.groupBy("game").agg(F.count("*").alias("total"), F.count("_h").alias("configured"))


def throughput(progress: DataFrame, media: DataFrame) -> DataFrame:
    """Elapsed and remaining seconds from the progress log ``(media_id, ts_s, pct)``."""
    g = progress.groupBy("media_id").agg(F.min("ts_s").alias("_a"), F.max("ts_s").alias("_b"), F.max_by("pct", "ts_s").alias("pct"))
    e = F.col("_b") - F.col("_a")
    return g.join(media.select("media_id", "duration_ms"), "media_id").select(
        "media_id", e.alias("elapsed"), F.when(F.col("pct") >= 3.0, F.greatest(F.lit(0.0), e * (100.0 - F.col("pct")) / F.greatest("pct", F.lit(1e-6)))).alias("eta"),
        F.try_divide(F.col("duration_ms") / 1000.0, e).alias("rate"))


def merge_user_edits(clips: DataFrame, edits: DataFrame, columns=("title", "hashtags", "feedback")) -> DataFrame:
    """User columns win over computed ones."""
    cols = [c for c in columns if c in clips.columns and c in edits.columns]
    e = edits.select("clip_id", *[F.col(c).alias(f"_{c}") for c in cols])
    return clips.join(e, "clip_id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in cols}).select(*clips.columns)


def resolve_montage(montages: DataFrame, clips: DataFrame) -> DataFrame:
    """Ordered ids to exported clips; a montage needs at least two (``montages(montage_id, clip_ids)``,
    hand-picked lists)."""
    m = montages.select("montage_id", F.posexplode("clip_ids").alias("ord", "clip_id"))
    j = m.join(clips.where("export_url is not null"), "clip_id")
    ok = j.groupBy("montage_id").agg(F.count("*").alias("_n")).where("_n >= 2").select("montage_id")
    return j.join(ok, "montage_id", "left_semi")


def score_montage(members: DataFrame) -> DataFrame:
    g = members.groupBy("montage_id").agg(F.min_by("score", "ord").alias("first"), F.avg("score").alias("mean"), F.min("score").alias("low"), F.count("*").alias("n"))
    raw = 0.45 * F.col("first") + 0.55 * F.col("mean")
    factors = F.array_compact(F.array(
        F.when(F.col("first") >= 75, F.lit("Strong opening hook")).when(F.col("first") < 55, F.lit("Weak opener — reorder for a stronger start")),
        F.when(F.col("low") >= 60, F.lit("Consistently strong clips")), F.concat(F.col("n").cast("string"), F.lit(" clips combined"))))
    return g.select("montage_id", F.bround(F.greatest(F.lit(1.0), F.least(F.lit(99.0), raw)), 0).cast("int").alias("score"), factors.alias("factors"))


def auto_length_range(settings: DataFrame) -> DataFrame:
    p = F.col("platform")
    game = F.col("content_type") == "gameplay"
    lo = F.when(game, 12000).when(p.isin("tiktok", "reels"), 12000).when(p == "shorts", 18000).otherwise(15000)
    hi = F.when(game, 35000).when(p.isin("tiktok", "reels"), 42000).when(p == "shorts", 55000).otherwise(60000)
    return settings.withColumns({"min_len_ms": lo.cast("bigint"), "max_len_ms": hi.cast("bigint")})


def clamp_lengths(settings: DataFrame) -> DataFrame:
    a, b = F.least("min_len_ms", "max_len_ms"), F.greatest("min_len_ms", "max_len_ms")
    return settings.withColumns({"_a": F.greatest(F.lit(3000), a), "_b": b}).withColumns({"min_len_ms": F.col("_a"), "max_len_ms": F.col("_b")}).drop("_a", "_b")


def clamp_pad(seconds: Column) -> Column:
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) != float("inf"))
    return F.when(ok, F.bround(F.greatest(F.lit(0.0), F.least(seconds, F.lit(60.0))) * 1000, 0).cast("bigint"))


def min_score_filter(clips: DataFrame, low: int) -> DataFrame:
    return clips.where(F.col("score") >= low)


def exportable_filter(clips: DataFrame) -> DataFrame:
    return clips.where("export_url is not null")


def manual_clip(marks: DataFrame, media: DataFrame, length_ms: int = 30_000) -> DataFrame:
    """Window centred on a mark; at least 10 s when it came out under 5 s, at most 120 s."""
    m = marks.join(media.select("media_id", "duration_ms"), "media_id")
    a = F.greatest(F.col("t_ms") - length_ms // 2, F.lit(0))
    b = F.least(F.col("t_ms") + length_ms // 2, F.col("duration_ms"))
    a = F.when(b - a < 5000, F.greatest(b - 10000, F.lit(0))).otherwise(a)
    m = m.withColumns({"_a": a, "_b": b})
    end = F.when(F.col("_b") - F.col("_a") > 120_000, F.least(F.col("_a") + 120_000, F.col("duration_ms"))).otherwise(F.col("_b"))
    hms = F.format_string("%02d:%02d:%02d", F.floor(F.col("t_ms") / 3_600_000) % 24, F.floor(F.col("t_ms") / 60_000) % 60, F.floor(F.col("t_ms") / 1000) % 60)
    return m.select("media_id", "t_ms", F.col("_a").alias("start_ms"), end.alias("end_ms"), F.concat(F.lit("Highlight @ "), hms).alias("title"))


def edit_clip_bounds(clips: DataFrame, edits: DataFrame, media: DataFrame) -> DataFrame:
    """Apply user trims: clamp to the recording, refuse under 1 s; ``changed`` clips need new scores."""
    e = edits.select("clip_id", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    c = clips.join(e, "clip_id", "left").join(media.select("media_id", F.col("duration_ms").alias("_d")), "media_id")
    a = F.greatest(F.lit(0), F.least(F.coalesce("_s", "start_ms"), "_d"))
    b = F.greatest(F.lit(0), F.least(F.coalesce("_e", "end_ms"), "_d"))
    ok = (F.col("_s").isNotNull() | F.col("_e").isNotNull()) & (b - a >= 1000)
    c = c.withColumns({"_a": F.when(ok, a).otherwise(F.col("start_ms")), "_b": F.when(ok, b).otherwise(F.col("end_ms"))})
    c = c.withColumn("changed", (F.col("_a") != F.col("start_ms")) | (F.col("_b") != F.col("end_ms")))
    return c.withColumns({"start_ms": F.col("_a"), "end_ms": F.col("_b")}).select(*clips.columns, "changed")


def speech_coverage(words: DataFrame, media: DataFrame) -> DataFrame:
    s = words.groupBy("media_id").agg(F.sum("d_ms").alias("_s"))
    return media.join(s, "media_id", "left").select("media_id", F.when(F.col("duration_ms") > 0, F.least(F.coalesce("_s", F.lit(0)) / F.col("duration_ms"), F.lit(1.0))).otherwise(0.0).alias("cov"))


def content_type(coverage: DataFrame, transcripts: DataFrame, face_ratio: DataFrame) -> DataFrame:
    """Talking or gameplay from speech coverage and the share of frames with a face."""
    c = coverage.join(transcripts.select("media_id", "provider"), "media_id", "left").join(face_ratio, "media_id", "left")
    s = F.when(F.col("provider") == "synthetic", 0.0).otherwise(F.col("cov"))
    f = F.coalesce("face_ratio", F.lit(0.5))
    kind = F.when(s >= 0.5, "talking").when((f >= 0.4) & (s >= 0.2), "talking").when((s < 0.15) | (f < 0.15), "gameplay").otherwise("talking")
    return c.select("media_id", kind.alias("kind"))


def cue_word_filter(cues: DataFrame, c: str = "cue") -> DataFrame:
    """Only plain labels of up to 24 characters may reach a prompt."""
    return cues.withColumn(c, F.trim(c)).where(F.col(c).rlike("^[A-Za-z0-9 _-]{1,24}$"))


def token_filter(cues: DataFrame, c: str = "cue") -> DataFrame:
    return cues.withColumn(c, F.trim(c)).where(F.col(c).rlike("^[A-Za-z0-9_+-]{2,20}$"))


def resolve_weights(settings: DataFrame, weights: DataFrame, key: str = "platform", fallback: str = "generic") -> DataFrame:
    """Weights of the setting's platform or game; unknown ones use the fallback row."""
    known = weights.select(F.col(key).alias("_k")).distinct()
    s = settings.join(known, F.lower(F.col(key)) == F.col("_k"), "left").withColumn("_k", F.coalesce("_k", F.lit(fallback)))
    return s.join(weights.withColumnRenamed(key, "_k"), "_k").drop("_k")


def latest_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return top_k(df, keys, order, n)
