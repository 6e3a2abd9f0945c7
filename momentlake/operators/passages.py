"""Sentences, candidate passages and their explainable text features.

Features of a passage come from three places, so that no passage is ever exploded into its
words: the opening seconds (once per sentence), the last word (once per sentence) and
running totals per sentence, of which a passage needs the difference of two.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from momentlake.functions.text import ANSWER_MARKERS, clamp, ends_complete, ends_sentence, tokens
from momentlake.operators import sentences as S
from momentlake.phrases import phrases_in_stream
from momentlake.skew import CHUNK, CHUNK_MS, CHUNK_ROWS, chain_marks, chunk_by_pos, durable, local_join, map_groups, pin, range_join, scan, share_shuffle

ROLES = ("hook", "emotion", "payoff", "dangling", "second_person", "quote_extra", "enumeration", "controversy")
FEATURES = ("instant_hook", "swipe", "hook", "emotion", "clarity", "quote", "pace", "length", "list",
            "controversy", "qa")


def resolve_language(df: DataFrame, lexicon: DataFrame, column: str = "lang") -> DataFrame:
    """Two-letter language of the lexicon to use; unknown languages fall back to English.

    The few languages go to the rows: shuffled by language, all words of one would meet in one task."""
    known = lexicon.select(F.col("lang").alias("_known")).distinct()
    asked = F.substring(F.lower(F.coalesce(F.col(column), F.lit("en"))), 1, 2)
    asked = F.when(asked == "ja", F.lit("jp")).otherwise(asked)
    return (df.withColumn("_asked", asked).join(F.broadcast(known), F.col("_asked") == F.col("_known"), "left")
            .withColumn(column, F.coalesce("_known", F.lit("en"))).drop("_asked", "_known"))


def pivot_lexicon(lexicon: DataFrame) -> DataFrame:
    """One row per (lang, term) with a 0/1 flag per role, plus the quotable union."""
    flags = [F.max((F.col("role") == r).cast("int")).alias(r) for r in ROLES]
    quote = F.max(F.col("role").isin("hook", "emotion", "second_person", "quote_extra").cast("int")).alias("quote")
    return lexicon.groupBy("lang", "term").agg(*flags, quote)


def transcript_scan(words: DataFrame, pause_ms: int = 650, horizon_ms: int = 3000,
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One ordered pass over the words. Adds

    sid                     position of the first word of the sentence (a sentence ends at ``. ! ?``
                            or before a pause of ``pause_ms``; words with a column ``last_word``
                            end where it says)
    toks                    lower-case tokens
    prev_tok, prev_tok_pos  last token before the word
    prev_text               previous word
    heads                   sentences that started at most ``horizon_ms`` ago

    Every column is computed per chunk; what crosses a chunk edge is carried by a scan over one
    summary row per chunk.
    """
    fin = F.col("last_word") if "last_word" in words.columns else ends_sentence("text")
    keys = ["media_id", CHUNK]
    part = W.partitionBy(*keys).orderBy("pos")
    recent = W.partitionBy(*keys).orderBy("t_ms").rangeBetween(1 - horizon_ms, 0)
    tok = F.when(F.size("toks") > 0, F.struct(F.element_at("toks", -1).alias("tok"), F.col("pos").alias("pos")))
    row = F.struct(F.col("_fin").alias("fin"), F.col("_end").alias("end"), F.col("text").alias("text"))
    starts = F.when(F.col("_p").isNotNull(), F.col("_p.fin") | (F.col("t_ms") - F.col("_p.end") >= pause_ms))

    def marked(df: DataFrame) -> DataFrame:
        w = chunk_by_pos(df, rows=chunk_rows).withColumns({"toks": tokens("text"), "_fin": fin, "_end": F.col("t_ms") + F.col("d_ms")})
        w = w.select("*", F.lag(row).over(part).alias("_p"), tok.alias("_tok"), F.first("pos").over(part).alias("_pos0"),
                     F.last(tok, True).over(part.rowsBetween(W.unboundedPreceding, -1)).alias("_pt")).withColumn("_st", starts)
        return w.select("*", F.last(F.when(F.col("_st"), F.col("pos")), True).over(part.rowsBetween(W.unboundedPreceding, 0)).alias("_ls"),
                        F.collect_list(F.when(F.coalesce("_st", F.lit(True)), F.struct("pos", "t_ms"))).over(recent).alias("_recent"))

    w = marked(words)
    # only recordings that go on behind their first chunk have edges; there are fewer of them than chunks
    long = words.where(F.expr(f"pos div {chunk_rows} > 0")).select("media_id").distinct()
    summary = marked(words.join(F.broadcast(long), "media_id", "left_semi")).groupBy(*keys).agg(
        F.min_by(F.struct("pos", "t_ms"), "pos").alias("_first"), F.max_by(row, "pos").alias("_last"),
        F.max(F.when(F.col("_st"), F.col("pos"))).alias("_start"), F.max_by("_recent", "pos").alias("_tail"),
        F.max_by("_tok", F.when(F.col("_tok").isNotNull(), F.col("pos"))).alias("_tok"),
        pin(words.columns + ["toks"]))
    summary = share_shuffle(summary)
    over = W.partitionBy("media_id").orderBy(CHUNK)
    before = over.rowsBetween(W.unboundedPreceding, -1)
    c = summary.select("*", F.lag("_last").over(over).alias("_cl"), F.last("_tok", True).over(before).alias("_ct"))
    edge = F.coalesce(F.col("_cl.fin") | (F.col("_first.t_ms") - F.col("_cl.end") >= pause_ms), F.lit(True))
    c = c.withColumn("_edge", edge)
    own = F.coalesce("_start", F.when(F.col("_edge"), F.col("_first.pos")))
    tail = F.filter("_tail", lambda x: F.col("_edge") | (x["pos"] != F.col("_first.pos")))
    c = c.select(*keys, "_cl", "_ct", "_edge", F.last(own, True).over(before).alias("_cs"), F.lag(tail).over(over).alias("_pt"),
                 F.col("_first.t_ms").alias("_t0"))
    # the chunk before this one, and before every chunk that began within the horizon
    close = W.partitionBy("media_id").orderBy("_t0").rangeBetween(-horizon_ms, 0)
    c = c.select(*keys, "_cl", "_ct", "_edge", "_cs", F.flatten(F.collect_list("_pt").over(close)).alias("_cr"))
    # one small row per chunk behind a recording's first: the words stay where they are
    j = w.join(F.broadcast(c.where(F.col(CHUNK) > 0)), keys, "left")
    at_edge = F.coalesce("_edge", F.lit(True))
    known = F.when(F.col("_cr").isNull(), F.col("_recent")).otherwise(F.concat("_cr", "_recent"))
    heads = F.filter(F.array_distinct(known), lambda x: (x["pos"] <= F.col("pos")) & (F.col("t_ms") - x["t_ms"] < horizon_ms)
                     & (at_edge | (x["pos"] != F.col("_pos0"))))
    return j.select(*words.columns, CHUNK, "toks",
                    F.coalesce("_ls", F.when(at_edge, F.col("_pos0")).otherwise(F.col("_cs"))).alias("sid"),
                    F.coalesce("_pt.tok", "_ct.tok").alias("prev_tok"), F.coalesce("_pt.pos", "_ct.pos").alias("prev_tok_pos"),
                    F.coalesce("_p.text", "_cl.text").alias("prev_text"), heads.alias("heads"))


def segment_sentences(words: DataFrame, pause_ms: int = 650, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the sentence id ``sid`` (position of the sentence's first word) to every word."""
    return transcript_scan(words, pause_ms, chunk_rows=chunk_rows).select(*words.columns, "sid")


def sentence_table(sentences: DataFrame) -> DataFrame:
    return sentences.groupBy("media_id", "sid").agg(
        F.min_by("t_ms", "pos").alias("start_ms"), F.max_by(F.col("t_ms") + F.col("d_ms"), "pos").alias("end_ms"),
        F.min("pos").alias("pos_lo"), F.max("pos").alias("pos_hi"))


def explode_tokens(stream: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per token and per adjacent pair (one empty row for a word without tokens). A pair
    belongs to its second token; ``cross`` marks the pair that starts in an earlier word.
    ``k`` is 1 on the first row of a word."""
    t, none = F.col("toks"), F.lit(None).cast("string")
    blank = F.array(F.struct(F.lit(1).alias("k"), none.alias("a"), none.alias("token"), F.lit(False).alias("pair"),
                             F.lit(False).alias("cross")))
    return stream.withColumn("_t", F.explode(F.when(F.size(t) > 0, _token_items()).otherwise(blank))).select(
        *keep, F.size(t).alias("n_toks"), "_t.k", "_t.a", "_t.token", "_t.pair", "_t.cross")


def _token_items() -> Column:
    """Tokens and adjacent pairs of a word, as ``explode_tokens`` lists them."""
    t, none = F.col("toks"), F.lit(None).cast("string")
    chain = F.when(F.col("prev_tok").isNotNull() & (F.size(t) > 0), F.concat(F.array("prev_tok"), t)).otherwise(t)
    item = "struct<k:int,a:string,token:string,pair:boolean,cross:boolean>"
    singles = F.transform(t, lambda x, i: F.struct((i + 1).cast("int").alias("k"), none.alias("a"), x.alias("token"),
                                                   F.lit(False).alias("pair"), F.lit(False).alias("cross")))
    pairs = F.when(F.size(chain) > 1, F.transform(
        F.sequence(F.lit(2), F.size(chain)),
        lambda i: F.struct((i + 1000).cast("int").alias("k"), F.element_at(chain, i - 1).alias("a"),
                           F.concat_ws(" ", F.element_at(chain, i - 1), F.element_at(chain, i)).alias("token"),
                           F.lit(True).alias("pair"),
                           ((i == 2) & F.col("prev_tok").isNotNull()).alias("cross")))
                   ).otherwise(F.array().cast(f"array<{item}>"))
    return F.concat(singles, pairs)


def lexicon_hits(toks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Flag every token with the lexicon roles of its language (0 when it is no term). The lexicon, a dictionary, goes to
    the tokens: shuffled by token, each frequent word would fill one task."""
    lx = pivot_lexicon(lexicon).withColumnRenamed("term", "token")
    out = toks.join(F.broadcast(lx), ["lang", "token"], "left")
    return out.withColumns({r: F.coalesce(r, F.lit(0)) for r in (*ROLES, "quote")})


EDGE = ("x_pair", "x_emotion", "x_quote", "x_enumeration", "x_controversy")


def sentence_features(words: DataFrame, lexicon: DataFrame, markers: Sequence[str] = tuple(ANSWER_MARKERS), question: str = "?",
                      pause_ms: int = 650, chunk_rows: int = CHUNK_ROWS, horizon_ms: int = 3000) -> DataFrame:
    """One row per sentence: features of the seconds after its start, flags of its last word and
    running totals. The words are read once, in chunks (``sentences.sentence_parts``); only chunks behind a recording's first
    are read again, with what the chunks before them carry over. ``mk_last`` is the first word of the last answer
    marker that ended up to here; phrases come with ``phrase_starts``. The result is on shared storage.

    Opening features are exact for passages of at least 3 s, which is the shortest allowed.
    """
    one, more = [m for m in markers if " " not in m], [m for m in markers if " " in m]
    terms = [tuple(r) for r in pivot_lexicon(lexicon).where("lang is not null and term is not null").select("lang", "term", *S.LEXICON_ROLES).collect()]
    columns = ["media_id", "lang", *[F.col(c).cast("bigint").alias(c) for c in ("pos", "t_ms", "d_ms")], "text", *[c for c in ("last_word",) if c in words.columns]]
    w = chunk_by_pos(resolve_language(words, lexicon).select(*columns), rows=chunk_rows)
    keys = ["media_id", CHUNK]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in w.select(*keys).schema)
    schema = T.StructType.fromDDL(f"{kinds}, {S.COLUMNS}")
    target = to_arrow_schema(schema)

    def parts(chunks: DataFrame, carried: bool) -> DataFrame:
        held: list[S.Texts] = []  # built once per task

        def run(table, edges):
            if not held:
                held.append(S.Texts(terms, one, question))
            return S.as_table(S.sentence_parts(table, edges, held[0], pause_ms, horizon_ms, carried), table, keys, target)

        return map_groups(chunks, keys, ["pos"], run, schema)

    found = durable(parts(w, False))
    s = found.where("summary is null").drop("summary")
    later = found.where(f"summary is not null and media_id is not null and {CHUNK} > 0")
    long = not later.isEmpty()
    if long:
        said = found.where("summary is not null").select(*keys, "summary").join(later.select("media_id").distinct(), "media_id", "left_semi")
        carry = durable(said.groupBy("media_id").applyInArrow(lambda table: S.carries(table, pause_ms, horizon_ms), f"{kinds}, {S.CARRY}"))
        again = parts(w.join(F.broadcast(carry), keys), True).drop("summary")
        s = s.join(F.broadcast(carry.select(*keys)), keys, "left_anti").unionByName(again)
        s = s.groupBy("media_id", "sid").agg(
            *[F.max_by(c, "pos_hi").alias(c) for c in ("end_ms", "complete")], *[F.max(c).alias(c) for c in ("start_ms", "pos_hi", "m_mk")],
            *[F.min(c).alias(c) for c in ("_q", "_code")], *[F.sum(c).alias(c) for c in (*[f"s_{c}" for c in S.ADDITIVE], *S.OPENING_SUMS)], F.bit_or("bits").alias("bits"))
    if more:
        s = _longer_markers(words, s, more, chunk_rows)
    if long or more:
        s = _running(durable(s.drop(CHUNK, *S.TOTALS)), chunk_rows)
    s = s.withColumns({b: F.shiftright("bits", i).bitwiseAND(1).cast("int") for i, b in enumerate(S.BITS)})
    edge = {x: F.shiftright("first_code", i).bitwiseAND(1) for i, x in enumerate(EDGE)}
    return _opening(s).select(
        "media_id", "sid", "start_ms", "end_ms", F.col("sid").alias("pos_lo"), "pos_hi", "complete", F.col("m_dang").alias("first_dangling"),
        "end_max", "f_hook", "f_instant_hook", "f_swipe", "r_hook", "r_instant_hook", "r_swipe", "next_q",
        "mk_last", *[c.alias(x) for x, c in edge.items()],
        *[f"b_{c}" for c in S.ADDITIVE], *[(F.col(f"b_{c}") + F.col(f"s_{c}")).alias(f"e_{c}") for c in S.ADDITIVE])


def _running(s: DataFrame, chunk_rows: int) -> DataFrame:
    """What the sentences before and after add up to, for recordings of several chunks."""
    sc = scan(chunk_by_pos(s, "sid", chunk_rows), ["media_id"], ["sid"],
              sums={f"b_{c}": F.col(f"s_{c}") for c in S.ADDITIVE},
              maxes={"_end_b": F.col("end_ms"), "_mk_b": F.col("m_mk")},
              after={"_q_a": F.col("_q"), "_code_a": F.col("_code")})
    none = F.lit(-1).cast("bigint")
    return sc.withColumns({"end_max": F.greatest("end_ms", "_end_b"), "next_q": F.coalesce("_q", "_q_a"), "first_code": F.coalesce("_code", "_code_a", F.lit(0)),
                           "mk_last": F.greatest(F.coalesce("m_mk", none), F.coalesce("_mk_b", none))})


def _in_sentences(hits: DataFrame, sents: DataFrame) -> DataFrame:
    """Hits with ``sid`` and ``start_ms`` of the sentence that their last word is in."""
    spans = sents.select("media_id", "sid", "start_ms", F.col("pos_hi").alias("_z"))
    return range_join(hits, spans, "pos_hi", F.col("sid"), F.col("_z"), width=1024).drop("_z")


def _longer_markers(words: DataFrame, sents: DataFrame, markers: Sequence[str], chunk_rows: int) -> DataFrame:
    """Markers of several words: the last one that ends in a sentence counts by its first word."""
    book = words.sparkSession.createDataFrame([(m,) for m in markers], "phrase string")
    hits = phrases_in_stream(words, ["media_id"], book, F.array(F.lower("text")), whole=False, chunk_rows=chunk_rows)
    last = _in_sentences(hits.select("media_id", "pos_lo", "pos_hi"), sents).groupBy("media_id", "sid").agg(F.max("pos_lo").alias("_mk"))
    return sents.join(last, ["media_id", "sid"], "left").withColumn("m_mk", F.greatest("m_mk", "_mk")).drop("_mk")


def phrase_starts(words: DataFrame, sents: DataFrame, lexicon: DataFrame, settings: DataFrame, role: str = "controversy",
                  chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``starts`` to the sentences: of each phrase of several words of the language's ``role`` terms the first word of its
    last place that ends up to here, within the reach of the longest passage. A passage from word a on holds as many
    distinct phrases as entries are a or more. Phrases may begin and end within a word, as in a text search.
    """
    terms = lexicon.where((F.col("role") == role) & F.contains("term", F.lit(" "))).select("lang", F.col("term").alias("phrase")).distinct()
    w = resolve_language(words, lexicon).select("media_id", "lang", "pos", "text")
    hits = phrases_in_stream(w, ["media_id", "lang"], terms, "text", whole=False, chunk_rows=chunk_rows, split=S.text_tokens).join(terms, ["lang", "phrase"], "left_semi")
    reach = settings.groupBy("media_id").agg(F.max("max_len_ms").alias("_reach"))
    placed = _in_sentences(hits.select("media_id", "phrase", "pos_lo", "pos_hi"), sents).join(reach, "media_id")
    placed = placed.select("media_id", "phrase", "pos_lo", F.col("sid").alias("_from"), F.col("start_ms").alias("_t"), "_reach")
    seen = range_join(sents.select("media_id", "sid", "start_ms"), placed, "start_ms", F.col("_t"), F.col("_t") + F.col("_reach")).where("sid >= _from")
    last = seen.groupBy("media_id", "sid", "phrase").agg(F.max("pos_lo").alias("_s")).groupBy("media_id", "sid").agg(F.collect_list("_s").alias("starts"))
    return sents.join(last, ["media_id", "sid"], "left").withColumn("starts", F.coalesce("starts", F.array().cast("array<bigint>")))


def _opening(g: DataFrame) -> DataFrame:
    """Hook strength, instant hook and swipe resistance with their reasons."""
    hook = clamp(0.30 * F.least("g_hooks", F.lit(2)) / 2 + 0.18 * F.least("g_you", F.lit(2)) / 2
                 + 0.24 * F.col("g_q3") + 0.12 * F.col("g_num3") + 0.16 * F.col("g_early"))
    soft = F.col("g_weak") == 1
    instant = clamp(0.30 * F.col("g_hook2") + 0.22 * F.col("g_you2") + 0.22 * F.col("g_q2") + 0.18 * F.col("g_num2")
                    + F.when(soft, -0.20).otherwise(0.10))
    wps = F.col("g_words2") / 2.0
    instant = F.when(F.col("g_n2") > 0, instant).otherwise(0.0)
    swipe = (0.55 * instant + 0.25 * F.when(wps.between(1.4, 4.8), 1.0).otherwise(0.35)
             + 0.20 * F.when(F.col("g_words2") >= 3, 1.0).otherwise(0.45) - F.when(soft, 0.25).otherwise(0.0))
    return g.withColumns({
        "f_hook": F.when(F.col("g_n3") > 0, hook).otherwise(0.0), "f_instant_hook": instant, "f_swipe": clamp(swipe),
        "r_hook": F.when(F.col("g_n3") == 0, "")
        .when((F.col("g_early") == 1) & ((F.col("g_hooks") > 0) | (F.col("g_q3") + F.col("g_num3") > 0)), "Hooks in the first 1.5s")
        .when(F.col("g_q3") == 1, "Opens with a question").when(F.col("g_hooks") > 0, "Curiosity hook up front")
        .when(F.col("g_you") > 0, "Speaks directly to the viewer").otherwise("Opens on a concrete detail"),
        "r_instant_hook": F.when(F.col("g_n2") == 0, "")
        .when(F.col("g_hook2") + F.col("g_you2") + F.col("g_q2") + F.col("g_num2") > 0, "First 2s hook lands")
        .when(~soft, "Clean opening beat").otherwise("Soft opening beat"),
        "r_swipe": F.when(swipe >= 0.55, "Low swipe-away risk").otherwise("Opening may lose viewers")})


def closing_features(words: DataFrame, lexicon: DataFrame, spans: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Replay value per span: clean end, strong last four words, concise, no dangling last token.
    ``spans(media_id, span_id, pos_lo, pos_hi, start_ms, end_ms)``. Only the last four words of
    each span are looked at."""
    low = F.greatest("pos_lo", F.col("pos_hi") - 3)
    tail = spans.select("media_id", "span_id", (F.col("end_ms") - F.col("start_ms")).alias("_d"), F.col("pos_hi").alias("_hi"),
                        low.alias("_lo"), F.explode(F.sequence(low, F.col("pos_hi"))).alias("pos"))
    w = resolve_language(local_join(words, tail, ["media_id", "pos"]), lexicon)
    per_span = W.partitionBy("media_id", "span_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    w = w.withColumn("toks", tokens("text"))
    w = w.withColumn("prev_tok", F.last(F.when(F.size("toks") > 0, F.element_at("toks", -1)), True).over(per_span))
    t = lexicon_hits(explode_tokens(w, ["media_id", "lang", "span_id", "pos", "_d", "_hi", "text"]), lexicon)
    is_last = F.col("pos") == F.col("_hi")
    strong = (F.col("hook") + F.col("emotion") + F.col("quote_extra") > 0).cast("int")
    last_single = is_last & ~F.col("pair") & (F.col("k") == F.col("n_toks"))
    g = t.groupBy("media_id", "span_id", "_d").agg(
        F.max((is_last & ends_complete("text")).cast("int")).alias("c"), F.max(strong).alias("s"),
        F.max((last_single & (F.col("dangling") == 1)).cast("int")).alias("d"))
    raw = (0.5 * F.col("c") + 0.25 * F.col("s") + F.when(F.col("_d") <= 35000, 0.25).otherwise(0.0) - 0.35 * F.col("d"))
    return g.select("media_id", "span_id", clamp(raw).alias("replay"))


def candidate_spans(sents: DataFrame, settings: DataFrame, width_ms: int = 60_000) -> DataFrame:
    """All runs of whole sentences whose length lies in the allowed range (bucketed self-join)."""
    lim = settings.select("media_id", "platform", "min_len_ms", "max_len_ms", "target_clips")
    extra = [c for c in sents.columns if c not in ("media_id",)]
    a = sents.join(lim, "media_id")
    a = a.select("media_id", "platform", "min_len_ms", "max_len_ms", "target_clips",
                 *[F.col(c).alias(f"a_{c}") for c in extra])
    b = sents.select("media_id", *[F.col(c).alias(f"z_{c}") for c in extra])
    j = range_join(b, a, "z_start_ms", F.col("a_start_ms"), F.col("a_start_ms") + F.col("max_len_ms"), width=width_ms)
    tall = "z_end_max" if "end_max" in extra else "z_end_ms"
    return j.where((F.col("z_sid") >= F.col("a_sid"))
                   & (F.col("z_end_ms") - F.col("a_start_ms") >= F.col("min_len_ms"))
                   & (F.col(tall) - F.col("a_start_ms") <= F.col("max_len_ms")))


def fixed_windows(words: DataFrame, settings: DataFrame, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Consecutive windows of about half the sum of the length limits, snapped to words; for
    recordings whose sentences never fit. Always advances by at least one word."""
    lim = settings.select("media_id", ((F.col("min_len_ms") + F.col("max_len_ms")) / 2).cast("bigint").alias("_target"))
    w = words.select("media_id", "pos", "t_ms", (F.col("t_ms") + F.col("d_ms")).alias("end")).join(lim, "media_id")
    m = chain_marks(w, "media_id", ["t_ms", "pos"], "t_ms", F.col("_target"), value="end", out="_first", chunk_ms=chunk_ms)
    m = chunk_by_pos(m).withColumn("_own", F.when(F.col("_first"), F.col("pos")))
    m = scan(m, ["media_id"], ["pos"], before={"_past": F.col("_own")})
    return m.groupBy("media_id", F.coalesce("_own", "_past").alias("pos_lo")).agg(
        F.max("pos").alias("pos_hi"), F.min_by("t_ms", "pos").alias("start_ms"), F.max_by("end", "pos").alias("end_ms"))


def window_sentences(words: DataFrame, lexicon: DataFrame, settings: DataFrame, markers: Sequence[str] = tuple(ANSWER_MARKERS), question: str = "?",
                     chunk_rows: int = CHUNK_ROWS, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Fixed windows as sentences with their features; a window is a passage by itself."""
    win = fixed_windows(words, settings, chunk_ms).select("media_id", F.col("pos_hi").alias("pos"), F.lit(True).alias("_last"))
    w = words.join(win, ["media_id", "pos"], "left").withColumn("last_word", F.coalesce("_last", F.lit(False))).drop("_last")
    return sentence_features(w, lexicon, markers, question, pause_ms=1 << 60, chunk_rows=chunk_rows)


def own_spans(sents: DataFrame, settings: DataFrame) -> DataFrame:
    """Each sentence as a candidate by itself, whatever its length."""
    lim = settings.select("media_id", "platform", "min_len_ms", "max_len_ms", "target_clips")
    extra = [c for c in sents.columns if c != "media_id"]
    return sents.join(lim, "media_id").select("media_id", "platform", "min_len_ms", "max_len_ms", "target_clips",
                                              *[F.col(c).alias(f"{p}_{c}") for p in ("a", "z") for c in extra])


def passage_features(cands: DataFrame) -> DataFrame:
    """Turn joined sentence pairs into candidates with the eleven features ``f_*``."""
    def span(c, x=None):
        v = F.col(f"z_e_{c}") - F.col(f"a_b_{c}")
        return v - F.col(f"a_{x}") if x else v

    n_words = F.col("z_pos_hi") - F.col("a_pos_lo") + 1
    dur = (F.col("z_end_ms") - F.col("a_start_ms")) / 1000.0
    singles = span("n_single")
    toks = singles + span("n_pair", "x_pair")
    has_toks = singles > 0
    emotion = F.when(has_toks, clamp(span("h_emotion", "x_emotion") / toks * 9.0)).otherwise(0.0)
    quote = clamp(0.5 * F.least(span("h_quote", "x_quote"), F.lit(4)) / 4 + F.when(n_words <= 28, 0.5).otherwise(0.2))
    enum = has_toks & (span("h_enumeration", "x_enumeration") > 0)
    listy = clamp(0.6 * (span("digit") > 0).cast("int") + 0.6 * enum.cast("int"))
    hits = span("h_controversy", "x_controversy") + 2 * F.size(F.filter("z_starts", lambda x: x >= F.col("a_pos_lo")))
    contr = F.when(has_toks, clamp(hits / toks * 15.0)).otherwise(0.0)
    wps = n_words / dur
    pace = F.when(dur <= 0, 0.0).otherwise(clamp(F.when((wps < 1.4) | (wps > 4.5), 0.2).otherwise(1.0 - F.abs(wps - 2.8) / 2.0)))
    lo, hi = F.col("min_len_ms") / 1000.0, F.col("max_len_ms") / 1000.0
    length = clamp(1.0 - F.abs(dur - (lo + hi) / 2.0) / (F.greatest((hi - lo) / 2.0, F.lit(1.0)) * 1.6))
    dangling = F.coalesce(F.col("a_first_dangling"), F.lit(0)) == 1
    clarity = F.when(dangling, 0.0).otherwise(0.55) + F.when(F.col("z_complete"), 0.45).otherwise(0.0)
    split = F.col("a_pos_lo") + F.greatest(F.floor(n_words / 5), F.lit(3))
    asks = F.coalesce((F.col("a_next_q") < split) & (F.col("a_next_q") <= F.col("z_pos_hi")), F.lit(False))
    answers = F.col("z_mk_last") >= split
    qa = F.when(~asks, 0.0).when(answers, 0.8).otherwise(0.4)
    return cands.select(
        "media_id", "platform", "min_len_ms", "max_len_ms", "target_clips", F.col("a_start_ms").alias("start_ms"), F.col("z_end_ms").alias("end_ms"),
        F.col("a_pos_lo").alias("pos_lo"), F.col("z_pos_hi").alias("pos_hi"), n_words.alias("n_words"),
        F.col("a_f_instant_hook").alias("f_instant_hook"), F.col("a_f_swipe").alias("f_swipe"), F.col("a_f_hook").alias("f_hook"),
        emotion.alias("f_emotion"), clamp(clarity).alias("f_clarity"), quote.alias("f_quote"), pace.alias("f_pace"),
        length.alias("f_length"), listy.alias("f_list"), contr.alias("f_controversy"), qa.alias("f_qa"),
        F.col("a_r_hook").alias("r_hook"), F.col("a_r_instant_hook").alias("r_instant_hook"), F.col("a_r_swipe").alias("r_swipe"))


def span_counts(cands: DataFrame) -> DataFrame:
    """Per candidate: words, tokens and hits per role, from running totals only."""
    def span(c, x=None):
        v = F.col(f"z_e_{c}") - F.col(f"a_b_{c}")
        return v - F.col(f"a_{x}") if x else v
    some = span("n_single") > 0
    return cands.select(
        "media_id", F.col("a_pos_lo").alias("pos_lo"), F.col("z_pos_hi").alias("pos_hi"),
        (F.col("z_pos_hi") - F.col("a_pos_lo") + 1).alias("n_words"),
        *[F.when(some, e).otherwise(0).alias(n) for n, e in (
            ("n_tokens", span("n_single") + span("n_pair", "x_pair")), ("emotion", span("h_emotion", "x_emotion")),
            ("quote", span("h_quote", "x_quote")), ("enumeration", span("h_enumeration", "x_enumeration")),
            ("controversy", span("h_controversy", "x_controversy")))],
        span("digit").alias("digits"))


def salience(features: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Ranking value: dot product with the weights of the platform (``weights(platform, w_*)``),
    or the default blend without weights."""
    if weights is not None:
        df = features.join(weights, "platform", "left")
        parts = [F.col(f"f_{f}") * F.coalesce(f"w_{f}", F.lit(0.0)) for f in FEATURES]
    else:
        df = features
        # fixed values: default blend
        blend = {"instant_hook": 0.18, "swipe": 0.12, "hook": 0.16, "emotion": 0.12, "clarity": 0.14, "quote": 0.08,
                 "length": 0.04, "pace": 0.04, "list": 0.06, "controversy": 0.03, "qa": 0.03}
        parts = [F.col(f"f_{f}") * w for f, w in blend.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.withColumn("salience", total)


def role_terms(lexicon: DataFrame, *roles: str) -> DataFrame:
    """Distinct terms of a language over several roles (quote terms, emphasis terms)."""
    return lexicon.where(F.col("role").isin(*roles)).select("lang", "term").distinct()


def quote_terms(lexicon: DataFrame) -> DataFrame:
    return role_terms(lexicon, "hook", "emotion", "second_person", "quote_extra")


def emphasis_terms(lexicon: DataFrame) -> DataFrame:
    return role_terms(lexicon, "hook", "emotion", "second_person", "quote_extra", "payoff", "enumeration")
