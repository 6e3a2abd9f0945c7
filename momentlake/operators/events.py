"""Detector events: matching, cleaning, chaining, corroboration and the clips they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from momentlake.functions.dictionaries import GAME_ALIASES, GAME_PROFILES, KILL_CHAIN, MENU_WORDS, game_profiles
from momentlake.functions.scoring import factor, half_even, prepend
from momentlake.functions.text import fold_text
from momentlake.functions.timecode import clock
from momentlake.phrases import phrases_in_texts, texts_without
from momentlake.skew import (CHUNK, CHUNK_MS, bucket_of, chain_marks, chunk_by_pos, chunk_by_time, greedy_select, percentiles, range_join, runs,
                             scan, spread, state_machine, top_k, value_ranks)


# ---- labels ------------------------------------------------------------------------------------
def event_family(label) -> Column:
    """Family of a detector label: kill, objective, round or the label itself."""
    c = F.col(label) if isinstance(label, str) else label
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[- ]", "_")
    s = F.regexp_replace(s, "^auto_", "")
    return (F.when(s.rlike("kill|headshot|eliminiert|eliminated|ace"), "kill")
            .when(s.rlike("spike|plant|defus|entscharf|bomb"), "objective")
            .when(s.rlike("victory|defeat|verloren|gewonnen|round"), "round").otherwise(s))


def menu_predicate(label: str = "label", detail: str = "detail", words=tuple(MENU_WORDS), menu_label: str = "menu") -> Column:
    low = F.lower(F.coalesce(F.col(detail), F.lit("")))
    return (F.lower(F.col(label)) == menu_label) | F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def garbled_filter(reads: DataFrame, max_bad: float = 0.4) -> DataFrame:
    """Drop reads with too few letters, digits and ``' - . _``."""
    clean = F.length(F.regexp_replace("text", "[^\\p{L}\\p{N}'._-]", ""))
    return reads.where((F.length("text") > 0) & (clean / F.length("text") >= 1.0 - max_bad))


def text_confidence(conf: Column, roi: Column) -> Column:
    full = roi == "full"
    return F.when(conf > 0, F.round(F.least(F.lit(1.0), conf * F.when(full, 0.97).otherwise(1.0)), 4)).when(full, 0.8).otherwise(0.9)


def evidence_text(matched: Column, raw: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), "\\s+", " "))
    t = F.when(F.length(t) > 140, F.concat(F.substring(t, 1, 137), F.lit("..."))).otherwise(t)
    return F.when(t == "", matched).otherwise(F.concat(matched, F.lit(" | "), t))


# ---- phrase matching ---------------------------------------------------------------------------
def fold_phrases(phrases: DataFrame) -> DataFrame:
    return phrases.select(*[c for c in phrases.columns if c != "phrase"], fold_text("phrase").alias("phrase")
                          ).where("phrase != ''").distinct()


def phrase_hits(reads: DataFrame, phrases: DataFrame, keys=(), carry=(), near: float | None = None) -> DataFrame:
    """``read_id``, ``carry`` and the columns of ``phrases`` for each folded phrase of any length that a read holds as whole
    words (with equal ``keys``). One automaton pass over the texts; only hits meet the phrases' other columns."""
    p = fold_phrases(phrases)
    return phrases_in_texts(reads.select("read_id", *keys, *carry, "text"), p, near=near).join(p, [*keys, "phrase"])


def longest(hits: DataFrame) -> DataFrame:
    return hits.groupBy("read_id", "label").agg(F.min_by("phrase", F.struct(-F.length("phrase"), "phrase")).alias("phrase"))


def match_keywords(reads: DataFrame, phrases: DataFrame) -> DataFrame:
    """Longest phrase of each label of ``phrases(label, phrase)`` that occurs in the read as whole words."""
    return reads.join(longest(phrase_hits(reads, phrases)), "read_id")


def match_keywords_fuzzy(reads: DataFrame, phrases: DataFrame, min_ratio: float = 86) -> DataFrame:
    """As ``match_keywords``, with near hits pooled: each phrase that a run of as many words is near to counts as well."""
    return reads.join(longest(phrase_hits(reads, phrases, near=min_ratio)), "read_id")


def drop_false_positives(matches: DataFrame, false_phrases: DataFrame) -> DataFrame:
    """Drop matches whose folded text contains a marked phrase of the game or of ``common``: one automaton pass."""
    return texts_without(matches, fold_phrases(false_phrases), "game", "common")


def manual_matches(reads: DataFrame, cues: DataFrame) -> DataFrame:
    """User phrases (media_id, phrase) found as whole words."""
    g = phrase_hits(reads, cues.select("media_id", "phrase"), ["media_id"], ["t_ms"])
    return g.select("media_id", "read_id", "t_ms", F.lit("manual_visual").alias("label"), "phrase").distinct()


def merge_text_lexicon(generic: DataFrame, profile: DataFrame, saved: DataFrame) -> DataFrame:
    """Phrases per (game, label): generic, profile and saved ones, first source wins its place."""
    names = profile.select("game").union(saved.select("game")).where("game != 'common'").groupBy().agg(F.collect_set("game")).scalar()

    def for_all(df):
        """The names of the games, one short list, go to the phrases, not the phrases to the games."""
        return df.select("label", "phrase").withColumn("game", F.explode(names))

    g, common = for_all(generic), for_all(saved.where("game = 'common'"))
    parts = [(g, 0), (profile, 1), (common, 2), (saved.where("game != 'common'"), 3)]
    u = None
    for df, p in parts:
        x = df.select("game", "label", "phrase", F.lit(p).alias("priority"))
        u = x if u is None else u.unionByName(x)
    return u.groupBy("game", "label", "phrase").agg(F.min("priority").alias("priority"))


# ---- read streams ------------------------------------------------------------------------------
def text_change_events(reads: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """A region whose non-empty text differs from its previous one (``label`` = first keyword
    of the read if given in ``labels(read_id, label)``, else ``scoreboard``)."""
    r = chunk_by_time(reads.where("text != ''"))
    r = scan(r, ["media_id", "roi"], ["t_ms", "read_id"], lag={"prev": "text"}).drop(CHUNK)
    ch = r.where(F.col("prev").isNotNull() & (F.length("text") > 3) & (F.col("text") != F.col("prev")))
    if labels is not None:
        ch = ch.join(labels.groupBy("read_id").agg(F.min("label").alias("_l")), "read_id", "left")
    else:
        ch = ch.withColumn("_l", F.lit(None).cast("string"))
    shown = F.concat(F.lit("changed: "), "prev", F.lit(" → "), "text")
    return ch.select("media_id", "read_id", "t_ms", "roi", F.coalesce("_l", F.lit("scoreboard")).alias("label"),
                     evidence_text(shown, F.col("text")).alias("detail"),
                     F.least(F.lit(1.0), text_confidence(F.col("conf"), F.col("roi")) * 0.9).alias("confidence"))


def dead_region_filter(reads: DataFrame, n: int = 4, revive: bool = False) -> DataFrame:
    """Drop the reads of a region after ``n`` consecutive empty ones."""
    empty = F.col("text") == ""
    r = runs(chunk_by_time(reads), ["media_id", "roi"], ["t_ms", "read_id"], ~empty)
    streak = F.when(empty, F.when(F.col("run_start") == 0, F.col("run_pos") + F.col("_lead")).otherwise(F.col("run_pos"))).otherwise(0)
    # a run starts on a non-empty read, except the first one, which may start empty
    first = r.groupBy("media_id", "roi").agg(F.min_by(F.col("text") == "", F.struct("t_ms", "read_id")).alias("_fe"))
    r = r.join(first, ["media_id", "roi"]).withColumn("_lead", F.col("_fe").cast("int")).withColumn("_streak", streak)
    if revive:
        return r.where(F.col("_streak") <= n).select(*reads.columns)
    dead = r.where(F.col("_streak") >= n).groupBy("media_id", "roi").agg(F.min(F.struct("t_ms", "read_id")).alias("_dead"))
    k = r.join(dead, ["media_id", "roi"], "left")
    return k.where(F.col("_dead").isNull() | (F.struct("t_ms", "read_id") <= F.col("_dead"))).select(*reads.columns)


def reuse_static_reads(reads: DataFrame, tol: float = 0.05, bits: int = 64, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Give a read the text of the last computed read of its region whose hash (``phash`` BIGINT)
    differs by at most ``tol``.

    Which read is computed depends on the reference that a chunk is entered with, but only up to the first computed
    one: the chunk's map lists its distinct hashes with the reference that is left behind if that hash is the first one
    too far from the entering reference. A hash further than twice the tolerance from its predecessor, or a missing one,
    is computed in any case and ends the list.
    """
    limit = int(tol * bits)

    def far(a, b):
        return a is None or b is None or ((a ^ b) & ((1 << 64) - 1)).bit_count() > limit

    def run(rows, state):
        ref, source = state
        made = []
        for r in rows:
            if far(r["phash"], ref):
                ref, source = r["phash"], r["read_id"]
            made.append((r["read_id"], source))
        return made, [ref, source]

    def summary(rows):
        heads, seen, last = [], set(), None
        for i, r in enumerate(rows):
            h = r["phash"]
            always = h is None or (i > 0 and (last is None or ((h ^ last) & ((1 << 64) - 1)).bit_count() > 2 * limit))
            if always or h not in seen:
                heads.append([h, always, run(rows[i:], [None, None])[1]])
                seen.add(h)
            if always:
                break
            last = h
        return heads

    def settle(heads, state):
        return next((left for h, always, left in heads if always or far(h, state[0])), state)

    lean = chunk_by_time(reads.select("media_id", "roi", F.col("t_ms").cast("bigint").alias("t_ms"), F.col("read_id").cast("bigint").alias("read_id"), "phash"), ms=chunk_ms)
    f = state_machine(lean, ["media_id", "roi"], ["t_ms", "read_id"], [None, None], summary, run, settle, "read_id bigint, source_read bigint")
    texts = reads.select("media_id", "roi", F.col("read_id").alias("source_read"), F.col("text").alias("_t"), F.col("conf").alias("_c"))
    return (reads.join(f, ["media_id", "roi", "read_id"]).join(texts, ["media_id", "roi", "source_read"])
            .withColumns({"text": F.col("_t"), "conf": F.col("_c")}).select(*reads.columns, "source_read"))


# ---- event streams -----------------------------------------------------------------------------
def union_detections(cue: DataFrame, ocr: DataFrame, audio: DataFrame) -> DataFrame:
    """Three producers, one schema."""
    cols = ["media_id", "event_id", "t_ms", "source", "label", "detail", "confidence"]
    return (cue.withColumn("source", F.lit("cue")).withColumn("detail", F.concat("label", F.lit(" sound"))).select(*cols)
            .unionByName(ocr.withColumn("source", F.lit("ocr")).select(*cols))
            .unionByName(audio.withColumn("source", F.lit("audio")).select(*cols)))


def group_streaks(events: DataFrame, window_ms: int = 6000, cap: int = 5, chain=tuple(KILL_CHAIN), chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Chain events at most ``window_ms`` apart with compatible labels, five to a streak.
    ``streak`` is the index of the streak's first event in its recording."""
    e = chunk_by_time(events.withColumn("_tl", F.struct("t_ms", "label")), ms=chunk_ms)
    e = scan(e, ["media_id"], ["t_ms", "event_id"], lag={"_p": "_tl"})
    same = (F.col("_p.label") == F.col("label")) | (F.col("_p.label").isin(*chain) & F.col("label").isin(*chain))
    e = runs(e, ["media_id"], ["t_ms", "event_id"], (F.col("t_ms") - F.col("_p.t_ms") > window_ms) | ~same)
    return e.select(*events.columns, (F.col("run_start") + F.floor(F.col("run_pos") / cap) * cap).alias("streak"))


def dedupe_events(events: DataFrame, gap_ms: int = 4000, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Best event per label inside groups anchored at their first event of any label."""
    order = ["t_ms", "event_id"]
    lean = events.select("media_id", *order)
    marks = chain_marks(lean, "media_id", order, "t_ms", gap_ms, chunk_ms=chunk_ms)
    m = chunk_by_time(marks, ms=chunk_ms).withColumn("_own", F.when(F.col("anchor"), F.col("event_id")))
    m = scan(m, ["media_id"], order, before={"_past": F.col("_own")})
    g = m.select("media_id", "event_id", F.coalesce("_own", "_past").alias("grp"))
    e = events.join(g, ["media_id", "event_id"])
    best = e.groupBy("media_id", "grp", "label").agg(
        F.max_by(F.struct(*events.columns), F.struct(F.col("confidence"), -F.col("t_ms"), -F.col("event_id"))).alias("_b"))
    return best.select("_b.*")


def suppress_near_menu(events: DataFrame, window_ms: int = 5000, is_menu: Column | None = None) -> DataFrame:
    """Drop audio events within ``window_ms`` of a menu text event."""
    menu = events.where((F.col("source") == "ocr") & (menu_predicate() if is_menu is None else is_menu)).select("media_id", F.col("t_ms").alias("_m")).distinct()
    near = range_join(events.where("source = 'audio'"), menu, "t_ms", F.col("_m") - window_ms, F.col("_m") + window_ms, how="left_anti")
    return events.where("source != 'audio'").unionByName(near.select(*events.columns))


def _anchored(clips: DataFrame, window_ms: int) -> DataFrame:
    """``media_id, clip_id, _s, _e``: the parts of a clip near one of its anchors."""
    base = F.coalesce(F.col("evidence_ms"), F.col("peak_ms")) if "evidence_ms" in clips.columns else F.col("peak_ms")
    a = clips.select("media_id", "clip_id", "start_ms", "end_ms", F.explode(F.array_distinct(F.concat(
        F.array(base), F.coalesce("cue_times", F.array().cast("array<bigint>"))))).alias("_a"))
    a = a.select("media_id", "clip_id", F.greatest("start_ms", F.col("_a") - window_ms).alias("_s"), F.least("end_ms", F.col("_a") + window_ms).alias("_e"))
    return a.where("_s <= _e")


def _family_counts(clips: DataFrame, events: DataFrame, window_ms: int, near: str) -> DataFrame:
    """``media_id, clip_id, family, c, o, a``: distinct supporting events of a clip by source, per family with a ``near``
    event around the clip, and of all families (``family`` null).

    No pair of clip and event is made: the bounds of the clips' parts and the events of a family are ordered by time, and
    a bound takes the number of events before it. Only events whose id is missing or stands for different events are
    paired with clips, to count once per clip.
    """
    at = W.partitionBy("media_id", "clip_id").orderBy("_s", "_e")
    parts = _anchored(clips, window_ms).withColumn("_top", F.max("_e").over(at.rowsBetween(W.unboundedPreceding, -1)))
    parts = parts.withColumn("_i", F.sum(F.when(F.col("_s") > F.col("_top"), 1).otherwise(0)).over(at))
    parts = parts.groupBy("media_id", "clip_id", "_i").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e")).drop("_i")
    e = events.select("media_id", "event_id", F.struct("t_ms", "source", event_family("label").alias("family")).alias("_x"))
    ids = e.where("event_id is not null").groupBy("media_id", "event_id").agg(F.collect_set("_x").alias("_x"))
    plain = ids.where(F.size("_x") == 1).select("media_id", F.element_at("_x", 1).alias("_x")).select("media_id", "_x.*").where("t_ms is not null")
    odd = ids.where(F.size("_x") > 1).select("media_id", "event_id", F.explode("_x").alias("_x")).unionByName(e.where("event_id is null")).select("media_id", "event_id", "_x.*")
    width = 60_000
    around = e.where((F.col("_x.source") == near) & (F.col("_x.family") != "")).select(
        "media_id", F.col("_x.family").alias("family"), bucket_of(F.col("_x.t_ms"), width).alias("_bucket")).distinct()
    of_family = spread(parts, F.col("_s"), F.col("_e"), width).join(around, ["media_id", "_bucket"]).select(*parts.columns, "family").distinct()
    none, one = F.lit(None).cast("string"), {"c": "cue", "o": "ocr", "a": "audio"}
    asked = parts.withColumn("family", none).unionByName(of_family)
    asked = asked.select("media_id", "clip_id", "family", F.explode(F.array(
        F.struct(F.col("_s").alias("t"), F.lit(0).alias("r"), F.lit(-1).alias("sign")), F.struct(F.col("_e").alias("t"), F.lit(2).alias("r"), F.lit(1).alias("sign")))).alias("_b"))
    asked = asked.select("media_id", "family", "_b.*", "clip_id", *[F.lit(0).alias(n) for n in one])
    seen = plain.select("media_id", F.explode(F.array(F.col("family"), none)).alias("family"), F.col("t_ms").alias("t"), F.lit(1).alias("r"), F.lit(0).alias("sign"),
                        F.lit(None).cast(clips.schema["clip_id"].dataType).alias("clip_id"), *[F.coalesce((F.col("source") == s).cast("int"), F.lit(0)).alias(n) for n, s in one.items()])
    rows = asked.unionByName(seen).withColumn("_f", F.concat(F.lit("="), "family")).withColumn("_f", F.coalesce("_f", F.lit("")))
    rows = scan(chunk_by_time(rows, "t", width), ["media_id", "_f"], ["t", "r"], sums={f"_{n}": F.col(n) for n in one}).where("sign != 0")
    counted = rows.select("media_id", "clip_id", "family", *[(F.col("sign") * F.col(f"_{n}")).alias(n) for n in one])
    once = range_join(odd, parts, "t_ms", F.col("_s"), F.col("_e")).dropDuplicates(["media_id", "clip_id", "event_id"])
    once = once.select("media_id", "clip_id", F.explode(F.array(F.col("family"), none)).alias("family"), *[(F.col("source") == s).cast("bigint").alias(n) for n, s in one.items()])
    return counted.unionByName(once).groupBy("media_id", "clip_id", "family").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in one])


def corroborate(clips: DataFrame, events: DataFrame, window_ms: int = 3000) -> DataFrame:
    """Lift clips backed by several detectors: +6..14 when a cue and a text of one family agree,
    +3 (up to 89) when text and generic audio agree without a cue."""
    fam = _family_counts(clips, events, window_ms, "cue")
    whole = F.col("family").isNull()
    agree = ~whole & (F.col("c") > 0) & (F.col("family") != "")
    g = fam.groupBy("media_id", "clip_id").agg(
        *[F.sum(F.when(whole, F.col(n)).otherwise(0)).alias(o) for n, o in (("c", "n_cue"), ("o", "n_ocr"), ("a", "n_audio"))],
        F.sum(F.when(agree, F.col("o")).otherwise(0)).alias("n_match"))
    if "features" in clips.columns:  # only here the strongest cue of each clip is asked for
        cues = events.where("source = 'cue'").select("media_id", "t_ms", "confidence")
        sim = range_join(cues, _anchored(clips, window_ms), "t_ms", F.col("_s"), F.col("_e")).groupBy("media_id", "clip_id").agg(F.max("confidence").alias("cue_sim"))
        g = g.join(sim, ["media_id", "clip_id"], "left")
    c = clips.join(g, ["media_id", "clip_id"], "left").fillna(0, ["n_cue", "n_match", "n_ocr", "n_audio"])
    exact = (F.col("n_cue") > 0) & (F.col("n_match") > 0)
    soft = (F.col("n_cue") == 0) & (F.col("n_ocr") > 0) & (F.col("n_audio") > 0) & (F.col("score") < 89)
    count = F.col("n_cue") + F.col("n_match") + F.col("n_audio")
    bonus = F.least(F.lit(14), 6 + 2 * F.greatest(count - 2, F.lit(0)) + 2 * (F.col("n_audio") > 0).cast("int"))
    c = c.withColumns({"_exact": exact, "_soft": soft, "_bonus": bonus.cast("int")})
    score = (F.when(F.col("_exact"), F.greatest(F.lit(1), F.least(F.lit(99), F.col("score") + F.col("_bonus"))))
             .when(F.col("_soft"), F.least(F.lit(89), F.col("score") + 3)).otherwise(F.col("score")).cast("int"))
    out = {"score": score, "corroborated": F.col("_exact"), "supporting_audio": F.col("_soft")}
    if "factors" in clips.columns:
        out["factors"] = prepend(F.col("_exact"), factor("Multimodal confirm", F.col("_bonus"),
                                                         "A matching game sound and matching on-screen text fire here"),
                                 prepend(F.col("_soft"), factor("Audio supports OCR", F.lit(3),
                                         "Generic audio energy lines up with on-screen text, but no exact cue matched"), F.col("factors")))
    if "features" in clips.columns:
        out["features"] = set_feature(F.when(F.col("_exact"), set_feature(set_feature(F.col("features"), "corroborated", F.lit(1.0)), "cue", F.greatest(
            F.coalesce(F.element_at("features", "cue"), F.lit(0.0)), "cue_sim"))).otherwise(F.col("features")), "supporting_audio",
            F.when(F.col("_soft"), 1.0).otherwise(F.coalesce(F.element_at("features", "supporting_audio"), F.lit(0.0))))
    return c.withColumns(out).drop("_exact", "_soft", "_bonus", "n_cue", "n_match", "n_ocr", "n_audio", "cue_sim")


def set_feature(m: Column, key: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(F.lit(key), value.cast("double")))


def accepted_events(events: DataFrame, clips: DataFrame, window_ms: int = 3000) -> DataFrame:
    """Events that support a final clip. ``clips`` carry has_cue, has_ocr and has_audio."""
    text = F.coalesce("has_ocr", F.lit(True))
    flags = clips.groupBy("media_id", "clip_id").agg(*[F.max(c).alias(n) for n, c in (
        ("ocr", F.col("has_ocr")), ("audio", F.col("has_audio")), ("cue", F.col("has_cue") & ~text), ("cue+", F.col("has_cue") & text))])
    parts = _anchored(clips, window_ms).join(flags, ["media_id", "clip_id"])
    plain = parts.select("media_id", "_s", "_e", F.explode(F.filter(F.array(*[F.when(F.col(n), F.lit(n)) for n in ("ocr", "audio", "cue")]), lambda x: x.isNotNull())).alias("_f"))
    said = _family_counts(clips.join(flags.where("`cue+`").select("media_id", "clip_id"), ["media_id", "clip_id"], "left_semi"), events, window_ms, "ocr")
    said = said.where("family != '' and o > 0").select("media_id", "clip_id", F.concat(F.lit("cue+"), "family").alias("_f"))
    spans = plain.unionByName(parts.where("`cue+`").join(said, ["media_id", "clip_id"]).select("media_id", "_s", "_e", "_f"))
    # an event is in some span of its kind if the furthest end of those that began before it reaches it
    cue, ocr = F.col("source") == "cue", F.col("source") == "ocr"
    kinds = F.when(cue, F.array(F.lit("cue"), F.concat(F.lit("cue+"), event_family("label")))).when(ocr, F.array(F.lit("ocr"))).otherwise(F.array(F.lit("audio")))
    asked = events.select("media_id", "event_id", "source", "label", "t_ms", F.explode(kinds).alias("_f"))
    rows = asked.withColumns({"t": F.col("t_ms"), "r": F.lit(1), "_e": F.lit(None).cast("bigint")}).unionByName(
        spans.groupBy("media_id", "_f", F.col("_s").alias("t")).agg(F.max("_e").cast("bigint").alias("_e")).withColumn("r", F.lit(0)), allowMissingColumns=True)
    rows = scan(chunk_by_time(rows, "t", 60_000), ["media_id", "_f"], ["t", "r"], maxes={"_reach": F.col("_e")})
    keep = rows.where("r = 1 and _reach >= t").groupBy("media_id", "source", "label", "t_ms").agg(F.min("event_id").alias("event_id"))
    return events.join(keep.select("media_id", "event_id"), ["media_id", "event_id"], "left_semi")


def pending_cue_labels(events: DataFrame, cues: DataFrame) -> DataFrame:
    """Text labels that no audio cue covers yet, with their first time."""
    have = cues.select(F.regexp_replace(F.lower("label"), "^auto_", "").alias("label")).distinct()
    low = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    e = events.where("source = 'ocr'").select("media_id", low.alias("label"), "t_ms").where("label != ''")
    return e.groupBy("media_id", "label").agg(F.min("t_ms").alias("t_ms")).join(have, "label", "left_anti")


# ---- loudness ----------------------------------------------------------------------------------
def rms_bucket(value: str = "rms", per_unit: float = 1.0) -> Column:
    return F.floor(F.col(value) * per_unit)


def loudness_thresholds(envelope: DataFrame, media: DataFrame, per_unit: float = 1024.0) -> DataFrame:
    """Action threshold (profile percentile) and floor (40th percentile) per recording, exact."""
    p = with_profile(media).select("media_id", "thr_pct")
    return percentiles(envelope.join(p, "media_id"), ["media_id"], "rms", {"thr": F.col("thr_pct"), "floor": F.lit(0.4)},
                       rms_bucket(per_unit=per_unit))


def with_profile(media: DataFrame) -> DataFrame:
    """Join the tuning of the game (aliases, unknown games fall back to generic)."""
    name = F.regexp_replace(F.lower(F.coalesce("game_profile", F.lit("generic"))), " ", "")
    for alias, game in GAME_ALIASES.items():
        name = F.when(name == alias, game).otherwise(name)
    prof = game_profiles(media.sparkSession)
    return media.withColumn("game", F.when(name.isin(*GAME_PROFILES), name).otherwise("generic")).join(prof, "game", "left")


def peak_intensity(envelope: DataFrame, peaks: DataFrame, per_unit: float = 1024.0) -> DataFrame:
    """Share of frames that are at most as loud as the peak."""
    r = value_ranks(envelope, ["media_id"], "rms", rms_bucket(per_unit=per_unit))
    total = envelope.groupBy("media_id").agg(F.count("*").alias("_total"))
    at = envelope.select("media_id", F.col("frame").alias("peak_frame"), "rms")
    return (peaks.join(at, ["media_id", "peak_frame"]).join(r, ["media_id", "rms"]).join(total, "media_id")
            .withColumn("intensity", (F.col("below") + F.col("n")) / F.col("_total")).select(*peaks.columns, "intensity"))


def peak_shape(envelope: DataFrame, peaks: DataFrame, thresholds: DataFrame, hop_ms: int = 100, chunk_frames: int = 1 << 14) -> DataFrame:
    """Sustain, number of spikes and transient of each peak: running totals, read at the bounds of its clip, and the frames
    next to the peak. No pairs of clips and frames; a chunk of frames also sees the last ones of the chunk before."""
    at = F.col("frame")
    env = envelope.join(thresholds, "media_id").where("frame is not null").select("media_id", "frame", "rms", (F.col("rms") > F.col("thr")).alias("_ab"))
    env = chunk_by_pos(env.withColumn("_row", F.struct(at.alias("frame"), F.coalesce("_ab", F.lit(False)).alias("ab"))), "frame", chunk_frames)
    env = scan(env, ["media_id"], ["frame"], lag={"_prev": "_row"}, few=True)
    again = F.coalesce(F.col("_prev.ab"), F.lit(False))
    env = env.withColumns({"_n": F.col("_ab").isNotNull().cast("int"), "_a": F.coalesce(F.col("_ab").cast("int"), F.lit(0)),
                           "_e": F.coalesce((F.col("_ab") & ~again).cast("int"), F.lit(0)),
                           "_next": F.struct(at.alias("frame"), (F.col("_row.ab") & again).alias("goes_on"), F.col("_prev.frame").alias("before"))})
    here = F.struct(F.col(CHUNK).alias("chunk"), F.lit(1).alias("own"))
    halo = F.when(at % chunk_frames >= chunk_frames - 20, F.array(here, F.struct((F.col(CHUNK) + 1).alias("chunk"), F.lit(0).alias("own")))).otherwise(F.array(here))
    env = env.withColumn("_h", F.explode(halo)).select(
        "media_id", "frame", "rms", F.lit(1).alias("_r"), F.col("_h.chunk").alias(CHUNK), *[(F.col(c) * F.col("_h.own")).alias(c) for c in ("_n", "_a", "_e")],
        F.when(F.col("_h.own") == 1, F.col("_next")).alias("_next"))
    lo = F.greatest(F.col("peak_frame") - 20, F.lit(0))
    p = peaks.select("media_id", F.struct("clip_id", "peak_frame", F.floor(F.col("start_ms") / hop_ms).alias("w0"), F.floor(F.col("end_ms") / hop_ms).alias("w1"), lo.alias("lo")).alias("_p"))
    w0, w1, peak = F.col("_p.w0"), F.col("_p.w1"), F.col("_p.peak_frame")
    first, last = F.least(w0, F.col("_p.lo")), F.greatest(w1, peak)
    asked = p.select("media_id", "_p", F.explode(F.array_distinct(F.array(*[x.cast("bigint") for x in (first, w0, w1, peak)]))).alias("frame")).where("frame is not null")
    rows = env.unionByName(chunk_by_pos(asked.withColumn("_r", F.lit(0)), "frame", chunk_frames), allowMissingColumns=True)
    near = W.partitionBy("media_id", CHUNK).orderBy("frame")
    # a peak at one of the first two frames is held against the first one
    rows = rows.withColumns({"_own": F.max("rms").over(near.rangeBetween(0, 0)), "_base": F.avg("rms").over(near.rangeBetween(-20, -2)),
                             "_base0": F.avg(F.when(at == 0, F.col("rms"))).over(near.rangeBetween(-1, 0))})
    rows = scan(rows, ["media_id"], ["frame", "_r"], sums={"_sn": F.col("_n"), "_sa": F.col("_a"), "_se": F.col("_e")}, after={"_nx": F.col("_next")}, few=True).where("_r = 0")

    def read(c, x):
        return F.max(F.when(at == x, F.col(c)))

    g = rows.groupBy("media_id", "_p").agg(
        *[(read(c, w1) - read(c, w0)).alias(o) for c, o in (("_sn", "_n"), ("_sa", "_a"), ("_se", "_e"))], read("_nx.frame", first).alias("_from"), read("_nx", w0).alias("_f"),
        read("_own", peak).alias("_peak"), read("_base", peak).alias("_base"), read("_base0", peak).alias("_base0"))
    # the first frame of a clip's window is a spike of its own, also where the loudness goes on
    opens = F.col("_f.goes_on") & (F.col("_f.frame") < w1) & ((F.col("_f.frame") == w0) | (F.col("_f.before") < first))
    g = g.where(F.col("_from") <= last).select("media_id", F.col("_p.clip_id").alias("clip_id"), "_n", "_a", (F.col("_e") + F.coalesce(opens.cast("int"), F.lit(0))).alias("_e"),
                                               "_peak", F.when(peak <= 1, F.col("_base0")).otherwise(F.col("_base")).alias("_base"))
    g = g.groupBy("media_id", "clip_id").agg(*[F.sum(c).alias(c) for c in ("_n", "_a", "_e")], F.max("_peak").alias("_peak"), F.avg("_base").alias("_base"))
    g = g.join(thresholds.select("media_id", F.col("floor").alias("_floor")), "media_id")
    g = g.withColumns({"n_spikes": F.greatest(F.coalesce("_e", F.lit(0)), F.lit(0)).cast("bigint"), "_base": F.coalesce("_base", "_floor")})
    return g.select("media_id", "clip_id", F.when(F.col("_n") > 0, F.col("_a") / F.col("_n")).otherwise(0.0).alias("sustain"), "n_spikes", F.least(F.col("n_spikes") / 5.0, F.lit(1.0)).alias("spikes"),
                    F.greatest(F.lit(0.0), (F.col("_peak") - F.col("_base")) / (F.col("_peak") + 1e-6)).alias("transient"))


def pick_peaks(envelope: DataFrame, media: DataFrame, per_unit: float = 1024.0) -> DataFrame:
    """Loudest frames at or over the action threshold, a profile's gap (3 s at least) apart, at most two for each wanted
    clip: ``media_id, peak_frame``. Equally loud frames go in order of time."""
    m = with_profile(media).select("media_id", F.greatest(F.col("min_len_ms") * F.col("gap_factor"), F.lit(3000)).cast("bigint").alias("_gap"), (F.col("target_clips") * 2).alias("_k"))
    reach = m.agg(F.max("_gap")).first()[0]
    if reach is None:
        return envelope.select("media_id", F.col("frame").alias("peak_frame")).where("false")
    loud = envelope.join(loudness_thresholds(envelope, media, per_unit).select("media_id", "thr"), "media_id").where("rms >= thr")
    e = loud.select("media_id", "frame", F.col("t_ms").cast("bigint").alias("t_ms"), "rms").join(m, "media_id").withColumn("_till", F.col("t_ms") + F.col("_gap"))

    def too_close(lo, hi, los, his):
        return abs(los - lo) < hi - lo  # a span is as long as its recording's gap

    kept = greedy_select(e, ["media_id"], [-F.col("rms"), F.col("frame")], "t_ms", "_till", too_close, int(reach))
    return top_k(kept, ["media_id"], [F.desc("rms"), F.col("frame")], "_k").select("media_id", F.col("frame").alias("peak_frame"))


# ---- clip builders -----------------------------------------------------------------------------
def timing_window(settings: DataFrame) -> DataFrame:
    """Milliseconds before and after an event, from the profile or the user's wish, scaled to the limits."""
    s = with_profile(settings)
    target = (F.col("min_len_ms") + F.col("max_len_ms")) / 2
    d_lead = target * F.col("lead_frac")
    d_tail = target - d_lead
    wish_l = F.col("lead_ms") if "lead_ms" in settings.columns else F.lit(None)
    wish_t = F.col("tail_ms") if "tail_ms" in settings.columns else F.lit(None)
    s = s.withColumns({"_l": F.greatest(F.lit(0.0), F.coalesce(wish_l, d_lead)), "_t": F.greatest(F.lit(0.0), F.coalesce(wish_t, d_tail)),
                       "_dl": d_lead, "_dt": d_tail})
    tiny = F.col("_l") + F.col("_t") <= 200
    s = s.withColumns({"_l": F.when(tiny, F.col("_dl")).otherwise(F.col("_l")), "_t": F.when(tiny, F.col("_dt")).otherwise(F.col("_t"))})
    over = F.col("_l") + F.col("_t") > F.col("max_len_ms")
    k = F.col("max_len_ms") / F.greatest(F.col("_l") + F.col("_t"), F.lit(0.001))
    s = s.withColumns({"_l": F.when(over, F.col("_l") * k).otherwise(F.col("_l")), "_t": F.when(over, F.col("_t") * k).otherwise(F.col("_t"))})
    tail = F.when(F.col("_l") + F.col("_t") < F.col("min_len_ms"), F.greatest("_t", F.col("min_len_ms") - F.col("_l"))).otherwise(F.col("_t"))
    return s.select(*settings.columns, F.col("_l").alias("lead"), tail.alias("tail"))


def _around(df: DataFrame, first: Column, last: Column, *, cap: str | None) -> DataFrame:
    start = F.greatest(F.lit(0.0), first - F.col("lead"))
    end = F.least(F.col("duration_ms").cast("double"), last + F.col("tail"))
    start = F.when(end - start < F.col("min_len_ms"), F.greatest(F.lit(0.0), end - F.col("min_len_ms"))).otherwise(start)
    d = df.withColumns({"_st": start, "_en": end})
    if cap:
        low = F.greatest(F.lit(0.0), F.col("_en") - F.col("max_len_ms")) if cap == "zero" else F.greatest(first - 2000, F.col("_en") - F.col("max_len_ms"))
        d = d.withColumn("_st", F.when(F.col("_en") - F.col("_st") > F.col("max_len_ms"), low).otherwise(F.col("_st")))
    return d.withColumns({"start_ms": F.bround("_st", 0).cast("bigint"), "end_ms": F.bround("_en", 0).cast("bigint")}).drop("_st", "_en")


def title_label(label: Column) -> Column:
    return F.initcap(F.regexp_replace(label, "_", " "))


def _clip(df: DataFrame, kind: str, peak: Column, title: Column, score: Column, features: dict, factors: Column, cue_times: Column | None = None) -> DataFrame:
    fm = F.create_map(*[x for k, v in features.items() for x in (F.lit(k), v.cast("double"))])
    return df.select("media_id", F.substring(F.sha2(F.concat_ws("|", "media_id", "start_ms", "end_ms", F.lit(kind), peak, title), 256), 1, 12).alias("clip_id"),
                     "start_ms", "end_ms", peak.alias("peak_ms"), F.lit(kind).alias("kind"), title.alias("title"),
                     F.greatest(F.lit(1), F.least(F.lit(99), half_even(score))).cast("int").alias("score"), fm.alias("features"), factors.alias("factors"),
                     (cue_times if cue_times is not None else F.array().cast("array<bigint>")).alias("cue_times"), "target_clips")


def cue_clips(events: DataFrame, media: DataFrame, chain=tuple(KILL_CHAIN)) -> DataFrame:
    """One clip per streak of cue events (a streak has at most five)."""
    g = group_streaks(events.where("source = 'cue'"), chain=chain).groupBy("media_id", "streak").agg(
        F.sort_array(F.collect_list(F.struct("t_ms", "event_id", "label"))).alias("_e"), F.max("confidence").alias("sim"))
    n, first, last = F.size("_e"), F.element_at("_e", 1), F.element_at("_e", -1)
    g = g.withColumns({"_t0": first["t_ms"], "_t1": last["t_ms"], "_label": first["label"], "n": n,
                       "kinds": F.size(F.array_distinct(F.transform("_e", lambda x: x["label"])))})
    c = _around(g.join(timing_window(media), "media_id"), F.col("_t0"), F.col("_t1"), cap="first")
    lab = title_label(F.col("_label"))
    word = F.element_at(F.array(*[F.lit(w) for w in ("", "Double", "Triple", "Quad", "Penta")]), F.col("n"))
    title = F.concat(F.when(F.col("n") == 1, lab).when(F.col("kinds") == 1, F.concat_ws(" ", word, lab))
                     .otherwise(F.concat(lab, F.lit(" + "), (F.col("n") - 1).cast("string"), F.lit(" cues"))), F.lit(" — "), clock("_t0"))
    score = F.least(F.lit(88.0), 58 + F.greatest(F.lit(0.0), F.col("sim") - 0.84) * 120 + (F.col("n") - 1) * 4)
    fac = F.array(factor(F.concat(F.lit("Matched '"), "_label", F.lit("' sound")), F.round(F.greatest(F.lit(0.0), F.col("sim") - 0.80) * 50, 1),
                         F.concat(F.floor(F.col("sim") * 100).cast("string"), F.lit("% audio match to your reference cue"))))
    span = F.greatest((F.col("_t1") - F.col("_t0")) / 1000.0, F.lit(1.0))
    fac = prepend(F.col("n") >= 2, factor(F.concat(F.col("n").cast("string"), F.lit(" events in "), F.bround(span, 0).cast("int").cast("string"), F.lit("s — streak")),
                                          (F.col("n") - 1) * 4, "Chained action holds viewers to the end (multi-kill effect)"), fac)
    return _clip(c, "cue", F.col("_t0"), title, score, {"cue": F.round("sim", 4), "streak": F.least(F.col("n") / 5.0, F.lit(1.0))}, fac,
                 F.transform("_e", lambda x: x["t_ms"]))


def text_clips(events: DataFrame, media: DataFrame, is_menu: Column | None = None) -> DataFrame:
    e = events.where(F.col("source") == "ocr").where(~(menu_predicate() if is_menu is None else is_menu))
    c = _around(e.join(timing_window(media), "media_id"), F.col("t_ms"), F.col("t_ms"), cap="zero")
    fac = F.array(factor(F.concat(F.lit("On-screen '"), "detail", F.lit("'")), F.round(F.col("confidence") * 20, 1),
                         "Detected viral on-screen text (OCR) — a guaranteed beat"))
    return _clip(c, "text", F.col("t_ms"), F.concat(title_label(F.col("label")), F.lit(" — "), clock("t_ms")), 68 + F.col("confidence") * 20,
                 {"ocr": F.round("confidence", 4)}, fac)


def audio_event_clips(events: DataFrame, media: DataFrame) -> DataFrame:
    c = _around(events.where("source = 'audio'").join(timing_window(media), "media_id"), F.col("t_ms"), F.col("t_ms"), cap="zero")
    detail = F.when(F.coalesce("detail", F.lit("")) == "", "CLAP matched a high-energy audio cue").otherwise(F.col("detail"))
    fac = F.array(factor("Zero-shot audio cue", F.round(F.col("confidence") * 24, 1), detail))
    return _clip(c, "audio", F.col("t_ms"), F.concat(title_label(F.col("label")), F.lit(" - "), clock("t_ms")), 62 + F.col("confidence") * 24,
                 {"audio_event": F.round("confidence", 4)}, fac)


def score_audio(clips: DataFrame) -> DataFrame:
    """Score from loudness features and game weights; with a reaction the others weigh 0.8."""
    has = "reaction" in clips.columns
    k = F.when(F.col("reaction").isNotNull(), 0.8).otherwise(1.0) if has else F.lit(1.0)
    total = F.lit(0.0)
    parts = {}
    for f in ("intensity", "sustain", "transient", "spikes"):
        parts[f] = F.col(f) * F.col(f"w_{f}") * k
        total = total + parts[f]
    if has:
        parts["reaction"] = F.coalesce(F.col("reaction") * 0.2, F.lit(0.0))
        total = total + parts["reaction"]
    labels = {  # fixed values: reasons of the loudness features
        "intensity": ("High audio intensity", F.concat(F.lit("Louder than "), F.floor(F.col("intensity") * 100).cast("string"), F.lit("% of the footage"))),
        "transient": ("Sudden spike", F.lit("Loud burst after quiet (jump-scare / gunfire)")),
        "sustain": ("Sustained action", F.lit("High-energy stretch (goal / team-fight)")),
        "spikes": ("Multiple action spikes", F.lit("Several loud events (multi-kill / build-up)")),
        "reaction": ("Streamer reacts hard", F.lit("Big facecam reaction during the moment"))}
    items = F.array(*[F.struct(p.alias("points"), F.lit(f).alias("key"), F.lit(labels[f][0]).alias("label"), labels[f][1].alias("detail"),
                               F.coalesce(F.col(f), F.lit(0.0)).alias("value")) for f, p in parts.items()])
    return clips.withColumns({"score": F.greatest(F.lit(1), F.least(F.lit(99), half_even(20 + total * 80))).cast("int"),
                              "factors": top_game_factors(items, total)})


def top_game_factors(items: Column, total: Column, k: int = 3) -> Column:
    good = F.slice(F.filter(F.sort_array(items, asc=False), lambda c: (c["value"] >= 0.2) & (c["points"] >= 0.04)), 1, k)
    out = F.transform(good, lambda c: F.struct(c["label"].alias("label"), F.round(c["points"] * 80, 1).alias("weight"), c["detail"].alias("detail")))
    return F.when(F.size(out) == 0, F.array(factor("Audio activity", F.round(total * 80, 1), ""))).otherwise(out)


def peak_clips(envelope: DataFrame, peaks: DataFrame, media: DataFrame, hop_ms: int = 100, per_unit: float = 1024.0) -> DataFrame:
    """Clips around loudness peaks ``(media_id, peak_frame)`` with features and score."""
    m = timing_window(media).join(with_profile(media).select("media_id", "w_intensity", "w_sustain", "w_transient", "w_spikes"), "media_id")
    p = _around(peaks.select("media_id", "peak_frame", (F.col("peak_frame") * hop_ms).alias("peak_ms")).join(m, "media_id"),
                F.col("peak_ms"), F.col("peak_ms"), cap=None)
    p = p.withColumn("clip_id", F.concat_ws("-", F.lit("peak"), "media_id", "peak_frame"))
    thr = loudness_thresholds(envelope, media, per_unit)
    keys = ["media_id", "clip_id"]
    f = p.join(peak_intensity(envelope, p.select(*keys, "peak_frame"), per_unit).select(*keys, "intensity"), keys).join(
        peak_shape(envelope, p, thr, hop_ms), keys)
    for c in ("intensity", "sustain", "transient", "spikes"):
        f = f.withColumn(c, F.round(c, 4))
    s = score_audio(f)
    return _clip(s.withColumn("_sc", F.col("score").cast("double")), "peak", F.col("peak_ms"), F.concat(F.lit("Highlight — "), clock("peak_ms")), F.col("_sc"),
                 {c: F.col(c) for c in ("intensity", "sustain", "transient", "spikes")}, F.col("factors"))


def evidence_caps(clips: DataFrame) -> DataFrame:
    """One weak signal may not max the score: 89, 88 for a cue, 86 for audio only."""
    def v(k):
        return F.coalesce(F.element_at("features", k), F.lit(0.0))
    great = ((v("corroborated") > 0) | ((v("cue") >= 0.88) & (v("ocr") >= 0.82))
             | ((v("reaction") >= 0.55) & ((v("ocr") >= 0.82) | (v("excitement") >= 0.72) | (v("cue") >= 0.88))))
    audio_only = (v("audio_event") > 0) & (v("cue") <= 0) & (v("ocr") <= 0) & (v("reaction") < 0.55)
    cap = F.when(great, 99).when(audio_only, 86).when(v("cue") > 0, 88).otherwise(89)
    return clips.withColumn("score", F.least("score", cap).cast("int"))


def title_fallback(clips: DataFrame) -> DataFrame:
    """Replace generic highlight titles by the strongest feature's name."""
    def v(k):
        return F.coalesce(F.element_at("features", k), F.lit(0.0))
    hit = F.get(F.filter(F.transform("factors", lambda f: F.lower(f["label"])), lambda x: x.rlike("explosive|cheer|crowd|laugh|impact")), F.lit(0))
    audio = (F.when(F.contains(hit, F.lit("explosive")), "Explosive Fight").when(hit.rlike("cheer|crowd"), "Crowd Pop")
             .when(F.contains(hit, F.lit("laugh")), "Funny Moment").when(F.contains(hit, F.lit("impact")), "Impact Moment").otherwise("Audio Moment"))
    name = (F.when(v("reaction") > 0.55, "Big Reaction").when((v("transient") > 0.65) | (v("spikes") > 0.7), "Sudden Fight")
            .when(v("intensity") > 0.85, "Loud Fight").when(v("audio_event") > 0.25, audio).when(v("vlm_viral") > 0.55, "Visual Moment").otherwise("Highlight"))
    tail = F.trim(F.substring_index("title", "—", -1))
    when = F.when(F.contains("title", F.lit("—")) & (tail != ""), tail).otherwise(clock(F.coalesce("peak_ms", "start_ms")))
    return clips.withColumn("title", F.when(F.lower("title").startswith("highlight"), F.concat(name, F.lit(" — "), when)).otherwise(F.col("title")))


def uniform_segments(media: DataFrame) -> DataFrame:
    """Evenly spaced clips for recordings without usable audio, stopping 2 s before the end."""
    target = (F.col("min_len_ms") + F.col("max_len_ms")) / 2
    n = F.least(F.ceil((F.col("duration_ms") - 2000) / target), F.col("target_clips")).cast("int")
    m = media.where("duration_ms > 2000").select("media_id", "duration_ms", target.alias("_len"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    start = F.col("i") * F.col("_len")
    return m.select("media_id", F.bround(start, 0).cast("bigint").alias("start_ms"), F.bround(F.least(start + F.col("_len"), F.col("duration_ms")), 0).cast("bigint").alias("end_ms"),
                    F.lit(50).alias("score"), F.concat(F.lit("Segment "), (F.col("i") + 1).cast("string"), F.lit(" — "), clock(start)).alias("title"))


# ---- sampling ----------------------------------------------------------------------------------
def sample_times(media: DataFrame, every_ms: int = 1000, max_n: int = 2000) -> DataFrame:
    """Evenly spaced times, the first at half a step."""
    step = F.greatest(F.lit(float(every_ms)), F.col("duration_ms") / max_n)
    n = F.least(F.lit(max_n), F.ceil(F.round(F.col("duration_ms") / step - 0.5, 6))).cast("int")
    m = media.select("media_id", step.alias("_s"), n.alias("_n")).where("_n > 0")
    return m.select("media_id", "_s", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i")).select(
        "media_id", F.bround(F.col("_s") * (F.col("_i") + 0.5), 0).cast("bigint").alias("t_ms"))


def focused_times(media: DataFrame, focus: DataFrame, every_ms: int = 1000, max_n: int = 2000) -> DataFrame:
    """Times around focus points (one per 0.75 s bucket) plus a sparse sweep, evenly thinned to
    ``max_n``; recordings without focus points fall back to ``sample_times``."""
    m = media.select("media_id", "duration_ms")
    f = focus.join(m, "media_id").where((F.col("t_ms") >= 0) & (F.col("t_ms") <= F.col("duration_ms")))
    edge = F.greatest(F.col("duration_ms") - 250, F.lit(250))
    a = f.select("media_id", F.explode(F.array(*[
        F.struct(F.col("t_ms").alias("src"), F.lit(i).alias("o"), F.least(F.greatest(F.col("t_ms") + off, F.lit(250)), edge).alias("t_ms"))
        for i, off in enumerate((-1000, 0, 1500, 3000))])).alias("x")).select("media_id", F.lit(0).alias("p"), "x.src", "x.o", "x.t_ms")
    has = focus.select("media_id").distinct()
    sweep = sample_times(media.join(has, "media_id", "left_semi"), max(every_ms * 5, 12000), max_n // 4)
    b = sweep.select("media_id", F.lit(1).alias("p"), F.col("t_ms").alias("src"), F.lit(0).alias("o"), "t_ms")
    u = a.unionByName(b).withColumn("bucket", F.bround(F.col("t_ms") / 750.0, 0).cast("bigint"))
    one = u.groupBy("media_id", "bucket").agg(F.min_by("t_ms", F.struct("p", "src", "o")).alias("t_ms"))
    total = one.groupBy("media_id").agg(F.count("*").alias("_n"))
    idx = scan(chunk_by_time(one), ["media_id"], ["t_ms", "bucket"], sums={"_i": F.lit(1)}).drop(CHUNK)
    k = idx.join(total, "media_id")
    # place i survives when some j < max_n has floor(j * n / max_n) = i
    j = F.ceil(F.col("_i") * F.lit(float(max_n)) / F.col("_n"))
    keep = (F.col("_n") <= max_n) | ((j < max_n) & (F.floor(j * F.col("_n") / F.lit(float(max_n))) == F.col("_i")))
    out = k.where(keep).select("media_id", "t_ms")
    return out.unionByName(sample_times(media.join(has, "media_id", "left_anti"), every_ms, max_n))


def cut_density(cuts: DataFrame, media: DataFrame) -> DataFrame:
    """Text sampling step from the number of cuts per second."""
    n = cuts.groupBy("media_id").agg(F.count("*").alias("_n"))
    d = F.least(F.coalesce("_n", F.lit(0)) / F.greatest(F.col("duration_ms") / 1000.0, F.lit(1.0)), F.lit(1.0))
    return media.join(n, "media_id", "left").select("media_id", F.greatest(2.0 - d * 1.4, F.lit(0.6)).alias("step"))


def detect_profile(reads: DataFrame, markers: DataFrame) -> DataFrame:
    """Game with the most distinct markers found in the reads; ties by the markers' order.

    Markers are loose substrings of any number, met in one automaton pass; only hits are shuffled."""
    m = markers.select("profile", "ord", F.lower("marker").alias("phrase"))
    found = phrases_in_texts(reads.select("media_id", "text"), m, whole=False, form=str.lower)
    hits = found.distinct().join(m, "phrase").select("media_id", "profile", "ord", "phrase").distinct()
    n = hits.groupBy("media_id", "profile").agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    best = n.groupBy("media_id").agg(F.max_by("profile", F.struct(F.col("n"), -F.col("o"))).alias("profile"))
    return reads.select("media_id").distinct().join(best, "media_id", "left").select("media_id", F.coalesce("profile", F.lit("generic")).alias("profile"))


def clamp_to_media(clips: DataFrame, media: DataFrame, min_len_ms: int = 1000) -> DataFrame:
    d = media.select("media_id", F.col("duration_ms").alias("_d"))
    c = clips.join(d, "media_id").withColumns({
        "start_ms": F.greatest(F.lit(0), F.least("start_ms", "_d")), "end_ms": F.greatest(F.lit(0), F.least("end_ms", "_d"))})
    return c.where(F.col("end_ms") - F.col("start_ms") >= min_len_ms).select(*clips.columns)


def template_quality(cues: DataFrame, rate: int = 16000) -> DataFrame:
    """Keep cue snippets that are long, loud and not one steady noise. ``pcm ARRAY<FLOAT>``."""
    x = F.col("pcm")
    peak = F.array_max(F.transform(x, lambda v: F.abs(v)))
    ms = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x)
    active = F.size(F.filter(x, lambda v: F.abs(v) > F.greatest(peak * 0.20, F.lit(0.015)))) / F.size(x)
    return cues.where((F.size(x) >= rate * 0.25) & (peak >= 0.025) & (F.sqrt(ms) >= 0.004) & (active <= 0.92))


#: Lists into which cues of equal profiles are dealt, at least, and the cues of a list: written for recording after recording,
#: short lists are still in sight of the compression when they come again.
CUE_SHARES, CUE_LIST = 64, 512


def gather_cue_sets(cues: DataFrame, settings: DataFrame) -> DataFrame:
    """Cues of the recording's game, common cues and cues its project names, once each.

    Pairs are made once instead of being made distinct: a pair comes from the first profile that cue and recording
    share, a named one only where they share none. Cues of equal profiles meet a recording as ``CUE_SHARES`` lists or more,
    dealt over all tasks however few the profiles are.
    """
    most = cues.groupBy("profile").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    shares = max(CUE_SHARES, -(-most // CUE_LIST))
    n = int(cues.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = cues.groupBy("cue_id").agg(F.sort_array(F.collect_set("profile")).alias("profiles"))
    games = F.sort_array(F.array_union(F.collect_set("game_profile").over(W.partitionBy("media_id")), F.array(F.lit("common"))))
    s = settings.select("media_id", games.alias("games"), "extra_cues")
    own = s.select("media_id", "games").distinct().select("media_id", "games", F.explode("games").alias("profile"))
    own = own.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    offered = kinds.groupBy("profiles", F.pmod(F.xxhash64("cue_id"), F.lit(shares)).cast("int").alias("share")).agg(F.collect_list(F.struct("cue_id")).alias("x"))
    offered = offered.withColumn("profile", F.explode("profiles"))
    met = own.repartition(n, "profile", "share").join(offered.repartition(n, "profile", "share"), ["profile", "share"])
    met = met.where(F.array_min(F.array_intersect("profiles", "games")) == F.col("profile")).select("media_id", F.inline("x"))
    named = s.select("media_id", "games", F.explode(F.array_distinct("extra_cues")).alias("cue_id")).distinct().join(kinds, "cue_id").where(~F.arrays_overlap("profiles", "games"))
    return met.union(named.select("media_id", "cue_id"))
