"""Words of a clip, caption lines, tightened timelines and text exports.

Windows here are per clip; a clip is bounded in time, so its words are a small group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from momentlake.functions.text import clean_caption_token, has_number, tokens
from momentlake.functions.timecode import frame_timecode, frames, srt_time, vtt_time, whole_fps
from momentlake.operators.passages import emphasis_terms
from momentlake.phrases import phrases_in_stream
from momentlake.skew import CHUNK, CHUNK_MS, chunk_by_time, durable, local_join, overlap_join, scan

CLIP = ("media_id", "clip_id")


def words_in_span(words: DataFrame, spans: DataFrame) -> DataFrame:
    """Words that overlap a span, both ends strict. ``spans(media_id, clip_id, start_ms, end_ms)``."""
    return overlap_join(words, spans.select(*CLIP, "start_ms", "end_ms"), F.col("t_ms"), F.col("t_ms") + F.col("d_ms"),
                        F.col("start_ms"), F.col("end_ms"))


def speaker_filter(words: DataFrame, keep: Column) -> DataFrame:
    """Keep the chosen speakers; a null list keeps all, an unlabelled word counts as speaker 0."""
    return words.where(keep.isNull() | F.array_contains(keep, F.coalesce("speaker", F.lit(0))))


def mute_spans(words: DataFrame, mutes: DataFrame) -> DataFrame:
    """Drop words that overlap any muted span (``mutes(media_id, a_ms, b_ms)``)."""
    hit = overlap_join(words.select("media_id", "pos", "t_ms", "d_ms"), mutes, F.col("t_ms"), F.col("t_ms") + F.col("d_ms"),
                       F.col("a_ms"), F.col("b_ms")).select("media_id", "pos").distinct()
    return words.join(hit, ["media_id", "pos"], "left_anti")


def cue_mutes(cues: DataFrame, before_ms: int = 400, after_ms: int = 2600) -> DataFrame:
    return cues.select("media_id", (F.col("t_ms") - before_ms).alias("a_ms"), (F.col("t_ms") + after_ms).alias("b_ms"))


def caption_words(words: DataFrame, spans: DataFrame, mutes: DataFrame | None = None, keep: Column | None = None) -> DataFrame:
    """Clip-relative caption words: overlap, clamp, at least 40 ms, cleaned text."""
    if mutes is not None:
        words = mute_spans(words, mutes)
    if keep is not None:
        words = speaker_filter(words, keep)
    w = words_in_span(words, spans).withColumn("_clean", clean_caption_token("text")).where("_clean is not null")
    rel = F.greatest(F.col("t_ms") - F.col("start_ms"), F.lit(0))
    dur = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(10))
    stop = F.least(F.col("t_ms") + F.col("d_ms") - F.col("start_ms"), dur)
    extra = [c for c in ("lang", "speaker") if c in w.columns]
    return w.select(*CLIP, "pos", rel.alias("t_ms"), F.greatest(stop - rel, F.lit(40)).alias("d_ms"), F.col("_clean").alias("text"), *extra)


def speakers_in_span(words: DataFrame, spans: DataFrame) -> DataFrame:
    w = words_in_span(words, spans).where(F.col("text").rlike("[A-Za-z0-9]"))
    return w.groupBy(*CLIP).agg(F.sort_array(F.collect_set(F.coalesce("speaker", F.lit(0)))).alias("speakers"))


def tight_segments(words: DataFrame, spans: DataFrame, gap_ms: int = 700, pad_ms: int = 120, min_saving_ms: int = 500) -> DataFrame:
    """Speech segments of each span without the dead air; the whole span when cutting saves too little."""
    w = words_in_span(words, spans).select(*CLIP, "start_ms", "end_ms", "pos",
                                           F.greatest("t_ms", "start_ms").alias("a"), F.least(F.col("t_ms") + F.col("d_ms"), "end_ms").alias("b"))
    order = W.partitionBy(*CLIP).orderBy("pos")
    w = w.withColumn("_reach", F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1)))
    w = w.withColumn("_seg", F.sum(F.coalesce((F.col("a") - F.col("_reach") > gap_ms).cast("int"), F.lit(0))).over(order))
    seg = w.groupBy(*CLIP, "start_ms", "end_ms", "_seg").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    seg = seg.select(*CLIP, "start_ms", "end_ms", F.greatest("start_ms", F.col("a") - pad_ms).alias("a"),
                     F.least("end_ms", F.col("b") + pad_ms).alias("b"))
    per_clip = seg.groupBy(*CLIP).agg(F.count("*").alias("_n"), F.sum(F.col("b") - F.col("a")).alias("_speech"),
                                      F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_s"))
    whole = F.array(F.struct(F.col("start_ms").alias("a"), F.col("end_ms").alias("b")))
    worth = (F.col("_n") >= 2) & (F.col("end_ms") - F.col("start_ms") - F.col("_speech") >= min_saving_ms)
    out = local_join(spans.select(*CLIP, "start_ms", "end_ms"), per_clip, CLIP, "left")
    return out.select(*CLIP, F.posexplode(F.when(F.coalesce(worth, F.lit(False)), F.col("_s")).otherwise(whole)).alias("seg", "_x")
                      ).select(*CLIP, "seg", F.col("_x.a").alias("a_ms"), F.col("_x.b").alias("b_ms"))


def _with_base(segments: DataFrame) -> DataFrame:
    past = W.partitionBy(*CLIP).orderBy("a_ms").rowsBetween(W.unboundedPreceding, -1)
    return segments.withColumn("base_ms", F.coalesce(F.sum(F.col("b_ms") - F.col("a_ms")).over(past), F.lit(0)))


def map_to_tight(times: DataFrame, segments: DataFrame) -> DataFrame:
    """Source time to position on the concatenated segments. ``times(media_id, clip_id, t_ms)``."""
    s = _with_base(segments).groupBy(*CLIP).agg(F.sort_array(F.collect_list(F.struct("a_ms", "b_ms", "base_ms"))).alias("_s"))
    total = F.element_at("_s", -1)["base_ms"] + F.element_at("_s", -1)["b_ms"] - F.element_at("_s", -1)["a_ms"]
    got = F.get(F.filter("_s", lambda x: F.col("t_ms") <= x["b_ms"]), F.lit(0))
    return times.join(s, list(CLIP)).withColumn(
        "tight_ms", F.when(got.isNull(), total).otherwise(got["base_ms"] + F.greatest(F.col("t_ms") - got["a_ms"], F.lit(0)))).drop("_s")


def caption_words_tight(words: DataFrame, segments: DataFrame, keep: Column | None = None) -> DataFrame:
    """Caption words on the tightened timeline, each word once (in its first segment)."""
    if keep is not None:
        words = speaker_filter(words, keep)
    s = _with_base(segments)
    w = overlap_join(words, s, F.col("t_ms"), F.col("t_ms") + F.col("d_ms"), F.col("a_ms"), F.col("b_ms"))
    w = w.withColumn("_clean", clean_caption_token("text")).where("_clean is not null").drop("text")
    once = W.partitionBy(*CLIP, "pos").orderBy("a_ms", "t_ms", "d_ms")
    w = w.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    start = F.greatest(F.col("t_ms"), F.col("a_ms"))
    return w.select(*CLIP, "pos", (F.col("base_ms") + start - F.col("a_ms")).alias("t_ms"),
                    F.greatest(F.least(F.col("t_ms") + F.col("d_ms"), F.col("b_ms")) - start, F.lit(40)).alias("d_ms"),
                    F.col("_clean").alias("text"))


def caption_lines(caps: DataFrame, n: int = 3, gap_ms: int = 900) -> DataFrame:
    """Add ``line``: a new line after ``n`` words or a pause longer than ``gap_ms``."""
    # every step follows the order of the clip's words: one sort
    order = W.partitionBy(*CLIP).orderBy("pos")
    stop = F.lag(F.col("t_ms") + F.col("d_ms")).over(order)
    w = caps.withColumn("_b", F.coalesce((F.col("t_ms") - stop > gap_ms).cast("int"), F.lit(0)))
    w = w.withColumns({"_i": F.sum("_b").over(order), "_n": F.row_number().over(order)})
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    w = w.withColumn("_b", F.coalesce(F.col("_i") != F.lag("_i").over(order), F.lit(True)))
    w = w.withColumn("_f", F.max(F.when(F.col("_b"), F.col("_n"))).over(so_far))
    new = ((F.col("_n") - F.col("_f")) % n == 0).cast("int")
    return w.withColumn("line", F.sum(new).over(so_far).cast("int")).drop("_b", "_i", "_n", "_f")


def annotate_emphasis(caps: DataFrame, lexicon: DataFrame, emoji: DataFrame, n: int = 3, gap_ms: int = 900,
                      max_emphasis: int = 2, max_emoji: int = 1) -> DataFrame:
    """Mark power words and numbers (at most two per line) and one emoji per line."""
    w = caption_lines(caps, n, gap_ms).withColumn("_tok", F.get(tokens("text"), F.lit(0)))
    terms = emphasis_terms(lexicon).select("lang", F.col("term").alias("_tok"), F.lit(True).alias("_power"))
    em = emoji.select(F.col("term").alias("_tok"), F.col("emoji").alias("_emoji"))
    w = w.join(terms, ["lang", "_tok"], "left").join(em, "_tok", "left")
    hit = has_number("text") | F.coalesce("_power", F.lit(False))
    line = W.partitionBy(*CLIP, "line").orderBy("pos")
    w = w.withColumns({"_h": hit.cast("int"), "_e": F.col("_emoji").isNotNull().cast("int")})
    return w.withColumns({"emphasis": (F.col("_h") == 1) & (F.sum("_h").over(line) <= max_emphasis),
                          "emoji": F.when((F.col("_e") == 1) & (F.sum("_e").over(line) <= max_emoji), F.col("_emoji"))}
                         ).drop("_tok", "_power", "_emoji", "_h", "_e")


def word_display_end(lined: DataFrame, silence_ms: int = 350, linger_ms: int = 150, min_ms: int = 80) -> DataFrame:
    """When each word leaves the screen: the next word of the line, cleared early across a silence."""
    line = W.partitionBy(*CLIP, "line").orderBy("pos")
    own = F.col("t_ms") + F.col("d_ms")
    end = F.coalesce(F.lead("t_ms").over(line), own)
    end = F.when(end - own > silence_ms, own + linger_ms).otherwise(end)
    return lined.withColumn("end_ms", F.greatest(end, F.col("t_ms") + min_ms))


def remove_phrases(caps: DataFrame, phrases: DataFrame) -> DataFrame:
    """Drop every word of a matched phrase of any length (``phrases(phrase)``), matched on folded tokens of the clip."""
    tok = F.regexp_replace(F.lower("text"), "[^a-zà-ÿ0-9]", "")
    w = caps.withColumn("_i", F.row_number().over(W.partitionBy(*CLIP).orderBy("pos")))
    met = phrases_in_stream(w.withColumn("_tok", F.array(tok)), CLIP, phrases, "_tok", pos="_i")
    gone = met.select(*CLIP, F.explode(F.sequence("pos_lo", "pos_hi")).alias("_i")).distinct()
    return w.join(gone, [*CLIP, "_i"], "left_anti").select(*caps.columns)


def refine_to_speech(words: DataFrame, speech: DataFrame, pad_ms: int = 60, min_overlap_ms: int = 100) -> DataFrame:
    """Clamp words to the speech interval they overlap most, drop words in silence.
    A media item that would lose every word (or has no intervals) keeps its words."""
    s = speech.select("media_id", F.col("a_ms").alias("_a"), F.col("b_ms").alias("_b"))
    j = overlap_join(words, s, F.col("t_ms"), F.col("t_ms") + F.col("d_ms"), F.col("_a"), F.col("_b"))
    end = F.col("t_ms") + F.col("d_ms")
    ov = F.least(end, F.col("_b")) - F.greatest(F.col("t_ms"), F.col("_a"))
    best = j.withColumn("_ov", ov).groupBy("media_id", "pos").agg(
        F.max("_ov").alias("_ov"), F.max_by(F.struct("_a", "_b"), F.struct(F.col("_ov"), -F.col("_a"), -F.col("_b"))).alias("_s"))
    best = best.where(F.col("_ov") >= min_overlap_ms)
    alive = best.select("media_id").distinct().withColumn("_alive", F.lit(True))
    w = local_join(words, best, ["media_id", "pos"], "left").join(alive, "media_id", "left")
    w = w.where(F.col("_s").isNotNull() | F.col("_alive").isNull())
    ns = F.greatest(F.col("t_ms"), F.col("_s._a") - pad_ms)
    ne = F.least(end, F.col("_s._b") + pad_ms)
    # greatest/least skip nulls, so words that keep their bounds pass through
    return w.withColumns({"_ns": ns, "_ne": F.greatest(ne, ns + 40)}).select(
        *[c for c in words.columns if c not in ("t_ms", "d_ms")], F.when(F.col("_s").isNull(), F.col("t_ms")).otherwise(F.col("_ns")).alias("t_ms"),
        F.when(F.col("_s").isNull(), F.col("d_ms")).otherwise(F.col("_ne") - F.col("_ns")).alias("d_ms"))


def apply_corrections(words: DataFrame, corrections: DataFrame, min_words: int = 20) -> DataFrame:
    """Replace words by their cleaned corrections (media_id, original, corrected); an empty
    correction keeps the time slot. Transcripts under ``min_words`` words are left alone."""
    c = corrections.select("media_id", F.lower(F.trim("original")).alias("_low"), F.trim("corrected").alias("_new"))
    c = c.where((F.col("_low") != "") & F.col("_new").isNotNull() & (F.lower("_new") != F.col("_low"))).dropDuplicates(["media_id", "_low"])
    big = words.groupBy("media_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_words).select("media_id")
    c = c.join(big, "media_id", "left_semi")
    w = words.withColumn("_low", F.lower(F.trim("text")))
    w = local_join(w, c, ["media_id", "_low"], "left")
    return w.withColumn("text", F.coalesce("_new", "text")).select(*words.columns)


def zoom_spikes(caps: DataFrame, cuts: DataFrame, gap_ms: int = 600) -> DataFrame:
    """Emphasised words at least ``gap_ms`` after the last kept one, plus softer spikes on cuts."""
    e = caps.where("emphasis").groupBy(*CLIP).agg(F.sort_array(F.collect_list("t_ms")).alias("_t"))  # a bounded clip
    kept = F.aggregate("_t", F.array().cast("array<bigint>"), lambda acc, t: F.when(
        (F.size(acc) > 0) & (t - F.element_at(acc, -1) < gap_ms), acc).otherwise(F.concat(acc, F.array(t))))
    a = e.select(*CLIP, F.explode(kept).alias("t_ms"), F.lit(1.12).alias("peak"), F.lit(450).alias("span_ms"))
    return a.unionByName(cuts.select(*CLIP, "t_ms", F.lit(1.08).alias("peak"), F.lit(300).alias("span_ms")))


def _line_blocks(caps: DataFrame, n: int, gap_ms: int) -> DataFrame:
    lined = caption_lines(caps, n, gap_ms)
    return lined.groupBy(*CLIP, "line").agg(
        F.min("t_ms").alias("a"), F.max_by(F.col("t_ms") + F.col("d_ms"), "pos").alias("b"),
        F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")).alias("text")
    ).where("text != ''")


def write_srt(caps: DataFrame, n: int = 3, gap_ms: int = 900) -> DataFrame:
    """One SubRip text per clip."""
    b = _line_blocks(caps, n, gap_ms)
    g = b.groupBy(*CLIP).agg(F.sort_array(F.collect_list(F.struct("line", F.concat(
        srt_time("a"), F.lit(" --> "), srt_time("b"), F.lit("\n"), "text", F.lit("\n")).alias("block")))).alias("_l"))
    blocks = F.transform("_l", lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["block"]))
    return g.select(*CLIP, F.concat(F.array_join(blocks, "\n"), F.lit("\n")).alias("text"))


def write_vtt(caps: DataFrame, n: int = 3, gap_ms: int = 900) -> DataFrame:
    """One WebVTT text per clip."""
    b = _line_blocks(caps, n, gap_ms)
    g = b.groupBy(*CLIP).agg(F.sort_array(F.collect_list(F.struct("line", F.concat(
        vtt_time("a"), F.lit(" --> "), vtt_time("b"), F.lit("\n"), "text", F.lit("\n")).alias("block")))).alias("_l"))
    return g.select(*CLIP, F.array_join(F.concat(F.array(F.lit("WEBVTT\n")), F.transform("_l", lambda x: x["block"])), "\n").alias("text"))


def record_timeline(clips: DataFrame, by=("media_id",)) -> DataFrame:
    """Source frames of each clip and its place on the record timeline (running sum of frames)."""
    c = clips.withColumn("fps_i", whole_fps("fps"))
    c = c.withColumns({"in_f": frames("start_ms", F.col("fps_i")), "_o": frames("end_ms", F.col("fps_i"))})
    c = c.withColumn("out_f", F.greatest("in_f", "_o")).drop("_o")
    # best score first; a chunk is an hour of starts of one score, so an item's clips are no single task
    place = -F.coalesce("score", F.lit(-1)).cast("bigint")
    c = c.withColumns({"_place": place, CHUNK: place * (1 << 40) + F.floor(F.col("start_ms") / F.lit(float(CHUNK_MS)))})
    c = scan(c, list(by), ["_place", "start_ms", "clip_id"], sums={"n": F.lit(1), "rec_f": F.col("out_f") - F.col("in_f")})
    return c.withColumn("n", F.col("n") + 1).drop("_place", CHUNK)


def write_edl(clips: DataFrame, media: DataFrame) -> DataFrame:
    """One CMX-3600 edit list per media item from its exported clips. The list of exported clips
    of one item is a hand-picked batch; the document itself is one value."""
    m = media.select("media_id", "name", "filename", "path", "fps")
    c = record_timeline(clips.where("export_url is not null").join(m, "media_id"))
    fps, dur = F.col("fps_i"), F.col("out_f") - F.col("in_f")
    event = F.concat(
        F.format_string("%03d  AX       V     C        ", "n"), F.concat_ws(
            " ", frame_timecode(F.col("in_f"), fps), frame_timecode(F.col("out_f"), fps), frame_timecode(F.col("rec_f"), fps),
            frame_timecode(F.col("rec_f") + dur, fps)),
        F.lit("\n* FROM CLIP NAME: "), "filename", F.lit("\n* SOURCE FILE: "), "path", F.lit("\n* COMMENT: "),
        F.format_string("%02d - ", "score"), F.substring("title", 1, 120))
    g = c.withColumn("_e", event).groupBy("media_id", "name").agg(F.sort_array(F.collect_list(F.struct("n", "_e"))).alias("_l"))
    head = F.concat(F.lit("TITLE: "), F.substring("name", 1, 48), F.lit("\nFCM: NON-DROP FRAME\n\n"))
    return g.select("media_id", F.concat(head, F.array_join(F.transform("_l", lambda x: x["_e"]), "\n\n"), F.lit("\n")).alias("text"))


def _nearest_cut(clips: DataFrame, cuts: DataFrame, aim: Column, turn: Column, lo: Column, hi: Column, out: str) -> DataFrame:
    """Per clip with a cut within ``lo`` to ``hi`` the one nearest to ``aim``, the earlier of two. Only the last cut up to
    ``turn`` (the place next to ``aim`` within the bounds) and the first one behind it can be it: one ordered pass, no pairs."""
    spans = clips.select(*CLIP, aim.alias("_aim"), turn.cast("double").alias("_t"), lo.alias("_lo"), hi.alias("_hi"), F.lit(1).alias("_ask"))
    points = cuts.select("media_id", F.col("t_ms").cast("double").alias("_t"), F.col("t_ms").alias("_cut"), F.lit(0).alias("_ask"))
    both = points.unionByName(spans, allowMissingColumns=True).where("media_id is not null and _t is not null")
    s = scan(chunk_by_time(both, "_t"), ["media_id"], ["_t", "_ask"], before={"_p": F.col("_cut")}, after={"_n": F.col("_cut")}).where("_ask = 1")
    cut = F.col("_x")
    met = s.withColumn("_x", F.explode(F.array("_p", "_n"))).where((cut >= F.col("_lo")) & (cut <= F.col("_hi")))
    return met.groupBy(*CLIP).agg(F.min_by("_x", F.struct(F.abs(cut - F.col("_aim")), cut)).alias(out))


def snap_to_cuts(clips: DataFrame, cuts: DataFrame, window_ms: int = 1500, min_len_ms: int = 3000) -> DataFrame:
    """Open each clip on the nearest cut within the window, if at least ``min_len_ms`` remain."""
    at = F.col("start_ms")
    near = _nearest_cut(clips, cuts, at, at, at - window_ms, at + window_ms, "_near")
    return clips.join(near, list(CLIP), "left").withColumn("start_ms", F.when(
        F.col("end_ms") - F.col("_near") >= min_len_ms, F.col("_near")).otherwise(F.col("start_ms"))).select(*clips.columns)


def pick_cutaway(clips: DataFrame, cuts: DataFrame, window_ms: int = 1500, min_len_ms: int = 5000) -> DataFrame:
    """The cut window wholly inside the clip that starts nearest to its midpoint."""
    long = clips.where(F.col("end_ms") - F.col("start_ms") >= min_len_ms)
    last, mid = F.col("end_ms") - window_ms, (F.col("start_ms") + F.col("end_ms")) / 2
    return _nearest_cut(long, cuts, mid, F.least(mid, last), F.col("start_ms"), last, "a_ms").withColumn("b_ms", F.col("a_ms") + window_ms)


# fixed values: advice on weak openings, by what is missing
ADVICE = {
    ("promise", "en"): "Lead with a question or a payoff promise in the first two seconds (e.g. 'The reason this works…' / 'Nobody tells you…').",
    ("promise", "de"): "Starte mit einer Frage oder einem Versprechen in den ersten zwei Sekunden (z.B. 'Der Grund, warum das funktioniert…').",
    ("shorter", "en"): "Tighten the opener — cut any warm-up and land the hook inside the first 1.5 seconds.",
    ("shorter", "de"): "Straffe den Einstieg — schneide Aufwärmphasen weg und setze den Hook in die ersten 1,5 Sekunden.",
    ("silence", "en"): "Open on speech in the first second — silence kills retention.",
    ("silence", "de"): "Sprich in der ersten Sekunde — Stille killt die Verweildauer.",
}


def hook_analysis(words: DataFrame, clips: DataFrame, lexicon: DataFrame, threshold: float = 0.5, window_ms: int = 3000) -> DataFrame:
    """Strength, verdict, advice and first words of each clip's opening.

    ``clips(media_id, clip_id, start_ms, end_ms, lang, hook)`` carry the opening score; ``lexicon(lang, role, term)`` the
    terms. Words without trailing ``?!,.`` are looked up among quotable terms, lower-case words among payoff terms. A clip
    without words is weak and gets no advice.
    """
    spoken = words_in_span(words.select("media_id", "pos", "t_ms", "d_ms", "text"), clips)
    head = spoken.withColumn("_t", F.min("t_ms").over(W.partitionBy(*CLIP))).where(F.col("t_ms") - F.col("_t") < window_ms)
    # the words are met once; what follows are the few first words of each clip
    text = durable(head.groupBy(*CLIP).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("_said")))
    said = text.join(clips.select(*CLIP, "lang"), [*CLIP]).select(*CLIP, "lang", F.explode("_said").alias("text"))
    text = text.select(*CLIP, F.array_join("_said", " ").alias("_text"))
    quotable = lexicon.where(F.col("role").isin("hook", "emotion", "second_person", "quote_extra")).select("lang", F.col("term").alias("_term")).distinct()
    promised = lexicon.where("role = 'payoff'").select("lang", F.col("term").alias("_term")).distinct()
    met = (said.withColumn("_term", F.regexp_replace("text", "[?!,.]+$", "")).join(quotable, ["lang", "_term"]).select(*CLIP)
           .union(said.withColumn("_term", F.lower("text")).join(promised, ["lang", "_term"]).select(*CLIP))).distinct().withColumn("_met", F.lit(True))
    out = clips.join(text, [*CLIP], "left").join(met, [*CLIP], "left")
    strength = F.when(F.col("_text").isNull(), 0.0).otherwise(F.col("hook"))
    verdict = F.when(strength >= threshold + 0.2, "strong").when(strength >= threshold, "ok").otherwise("weak")

    def advice(what):
        return F.when(F.col("lang") == "de", ADVICE[what, "de"]).otherwise(ADVICE[what, "en"])

    say = F.when(F.col("_text").isNull() | (verdict == "strong"), "").when(F.trim("_text") == "", advice("silence")).when(F.col("_met").isNull(), advice("promise")).otherwise(advice("shorter"))
    return out.select(*CLIP, F.round(strength, 2).alias("strength"), verdict.alias("verdict"), say.alias("suggestion"),
                      F.substring(F.trim(F.coalesce("_text", F.lit(""))), 1, 120).alias("first_words"))
