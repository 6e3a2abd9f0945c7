"""Steps that leave the words of a recording where they are, and peaks without pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from checks import captions as Q, views
from momentlake import skew
from momentlake.operators import captions as C, events as E, passages as P
from momentlake.sources import library as L

LEX = "lang string, role string, term string"


def exchanges(df):
    """Columns by which rows with texts are shuffled. Broadcasts are off, as for large tables."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", re.sub(r"#\d+L?", "", plan))


@pytest.fixture
def large(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.fixture
def words(large, tmp_path):
    text = " ".join(f"Word{i}{'.' if i % 5 == 4 else ''}" for i in range(400))
    large.createDataFrame([(i, text, "en") for i in range(4)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return views.words(large, str(tmp_path))


def test_words_of_repeated_documents(spark, tmp_path):
    """Equal to counting the sentence ends before each word, also when a document comes twice or has no text."""
    rng = random.Random(1)
    docs = [(m, " ".join(rng.choice(["a", "b.", "c!", "d"]) for _ in range(rng.randrange(9))) + rng.choice(["", " ", "\n"]), lang)
            for m, lang in ((1, "en"), (2, "de"), (2, "en"), (2, "fr"), (None, "en"), (4, "es"))] + [(5, None, "en"), (2, "x. y. z", "de")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    made = views.words(spark, str(tmp_path))
    assert not re.search(r"Sort \[[^\]]*pos", made._jdf.queryExecution().executedPlan().toString())
    want = {}
    for m in {d[0] for d in docs}:
        rows = sorted((i, w[-1] in ".!?") for d, t, _ in docs if d == m and t for i, w in enumerate(t.split()))
        want[m] = sorted(420 * i + 700 * sum(f for _, f in rows[:k]) for k, (i, _) in enumerate(rows))
    got = made.collect()
    for m, times in want.items():
        mine = [r for r in got if r.media_id == m]
        assert sum(r.fin for r in mine) == sum(r.text[-1] in ".!?" for r in mine) and len(mine) == len(times)
        if sum(d[0] == m for d in docs) == 1:
            assert sorted(r.t_ms for r in mine) == times
    assert sorted((r.pos, r.text) for r in got if r.media_id == 2) == sorted((i, w) for d, t, _ in docs if d == 2 and t for i, w in enumerate(t.split()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_local_join(spark, how):
    left = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (None, 1, "d"), (2, None, "e")], "m long, k long, x string")
    right = spark.createDataFrame([(1, 1, 7), (1, 1, 8), (None, 1, 9), (2, None, 10), (3, 3, 11)], "m long, k long, y long")
    key = lambda rows: sorted(map(str, rows))
    assert key(skew.local_join(left, right, ["m", "k"], how).collect()) == key(left.join(right, ["m", "k"], how).collect())


def test_captions_leave_words_in_place(words):
    """keyword_frequency, hashtags, write_srt, word_display_end, caption_words_tight."""
    sp = Q.spans(words)
    caps = C.caption_words(words, sp)
    for made in (C.word_display_end(C.caption_lines(caps)), C.write_srt(caps), C.caption_words_tight(words, C.tight_segments(words, sp, gap_ms=200))):
        assert set(exchanges(made)) == {"media_id"}
        assert made.count() > 0


def test_refine_and_corrections_leave_words_in_place(words):
    speech = Q.spans(words).select("media_id", F.col("start_ms").alias("a_ms"), (F.col("start_ms") + 7000).alias("b_ms"))
    assert set(exchanges(C.refine_to_speech(words, speech))) == {"media_id"}
    c = words.sparkSession.createDataFrame([(1, "word7", "X"), (2, "word9.", ""), (None, "word1", "Y")], "media_id long, original string, corrected string")
    made = C.apply_corrections(words, c)
    assert exchanges(made).count("media_id, _low") == 1  # the corrections, once each; not the words
    assert sorted((r.media_id, r.pos, r.text) for r in made.where("text not like 'Word%'").collect()) == [(1, 7, "X"), (2, 9, "")]


def test_asr_and_closing_leave_words_in_place(words):
    asr = words.select("media_id", F.col("pos").alias("idx"), F.col("text").alias("word"), (F.col("t_ms") / 1000).alias("start"), ((F.col("t_ms") + 300) / 1000).alias("end"),
                       F.lit(None).cast("double").alias("score"), F.lit(0.9).alias("probability"), F.when(F.col("pos") % 3 == 1, "B").when(F.col("pos") % 3 == 2, "A").alias("speaker"))
    made = L.words_from_asr(asr)
    assert set(exchanges(made)) == {"media_id"}
    assert {(r.pos % 3, r.speaker) for r in made.collect()} == {(0, 0), (1, 1), (2, 2)}
    s = P.sentence_table(P.segment_sentences(words)).withColumnRenamed("sid", "span_id")
    made = P.closing_features(words, words.sparkSession.createDataFrame([("en", "hook", "word")], LEX), s)
    assert not any("pos" in x for x in exchanges(made)) and made.count() == 4 * 80


def test_hook_meets_words_once(words):
    c = Q.spans(words).withColumns({"lang": F.lit("en"), "hook": F.lit(0.6)})
    made = C.hook_analysis(words, c, words.sparkSession.createDataFrame([("en", "hook", "Word2")], LEX))
    assert not any("_bucket" in x for x in exchanges(made))
    first = {r.clip_id: r for r in made.collect()}["0-0"]
    assert first.verdict == "ok" and first.first_words.startswith("Word2 Word3") and first.suggestion == C.ADVICE["shorter", "en"]


@pytest.mark.parametrize("chunk", [32, 1 << 14])
def test_peak_shape_without_pairs(spark, chunk):
    """Equal to the plain loop over each clip's frames, with gaps and over edges of chunks."""
    rng = random.Random(3)
    env = [(m, f, f * 100, float(rng.randrange(10))) for m in (1, 2) for f in range(150) if m == 1 or rng.random() < 0.8]
    peaks = [(m, f"{m}-{f}", f, max(0, f * 100 - rng.randrange(6000)), f * 100 + rng.randrange(6000)) for m in (1, 2, 3) for f in range(0, 150, 3)]
    thr = spark.createDataFrame([(1, 5.0, 2.0), (2, 4.0, 1.0)], "media_id long, thr double, floor double")
    made = E.peak_shape(spark.createDataFrame(env, "media_id long, frame long, t_ms long, rms double"),
                        spark.createDataFrame(peaks, "media_id long, clip_id string, peak_frame long, start_ms long, end_ms long"), thr, chunk_frames=chunk)
    assert "_bucket" not in made._jdf.queryExecution().executedPlan().toString()
    want = {}
    for m, k, pf, a, z in peaks:
        limit, base = {1: (5.0, 2.0), 2: (4.0, 1.0)}.get(m, (None, None))
        w0, w1, lo = a // 100, z // 100, max(pf - 20, 0)
        rows = [(f, r) for n, f, _, r in env if n == m and min(w0, lo) <= f <= max(w1, pf)]
        if not rows or limit is None:
            continue
        inside = [r > limit for f, r in rows if w0 <= f < w1]
        spikes = sum(r > limit and w0 <= f < w1 and (f == w0 or i == 0 or rows[i - 1][1] <= limit) for i, (f, r) in enumerate(rows))
        pre = [r for f, r in rows if lo <= f < max(pf - 1, lo + 1)]
        top = next((r for f, r in rows if f == pf), None)
        b = sum(pre) / len(pre) if pre else base
        want[k] = (round(sum(inside) / len(inside), 6) if inside else 0.0, spikes, round(max(0.0, (top - b) / (top + 1e-6)), 6) if top is not None else 0.0)
    assert {r.clip_id: (round(r.sustain, 6), r.n_spikes, round(r.transient, 6)) for r in made.collect()} == want


def counted(df):
    """The same rows, and how many of them were made."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    return df.mapInArrow(run, df.schema), made


def test_sentence_features_read_the_words_once(spark):
    words = spark.createDataFrame([(m, "en", i, i * 400, 300, f"w{i}{'.' if i % 4 == 3 else ''}") for m in (1, 2) for i in range(40)],
                                  "media_id long, lang string, pos long, t_ms long, d_ms long, text string")
    once, made = counted(words)
    assert P.sentence_features(once, spark.createDataFrame([("en", "hook", "w")], LEX), ["so"]).count() == 20
    assert made.value == 80


def test_sentence_features_of_repeated_words_and_backward_times(spark):
    """Repeated words share their hits; a word said before its sentence began is none of its opening."""
    rows = [(1, "en", 0, 1000, 300, "real"), (1, "en", 0, 1000, 300, "real"), (1, "en", 1, 400, 100, "real."), (None, "en", 0, 0, 100, "real")]
    words = spark.createDataFrame(rows, "media_id long, lang string, pos long, t_ms long, d_ms long, text string")
    got = P.sentence_features(words, spark.createDataFrame([("en", "emotion", "real"), ("en", "hook", "real")], LEX))
    got = {(r.media_id, r.sid): (r.start_ms, r.end_ms, r.end_max, r.e_h_emotion, r.e_n_single, round(r.f_hook, 2)) for r in got.collect()}
    assert got == {(1, 0): (1000, 500, 500, 5, 3, 0.46), (None, 0): (0, 100, 100, 0, 1, 0.0)}


def test_rows_of_kept_ids(spark):
    """Whole rows of the ids, repeated ids and rows included; the plan drops most others before it shuffles."""
    rows = spark.range(5000).selectExpr("id div 2 as _id", "id as v", "string(id) as t")
    ids = spark.createDataFrame([(7,), (7,), (2000,), (9999,)], "_id long")
    assert sorted(r.v for r in skew.rows_of(rows, ids).collect()) == [14, 15, 4000, 4001]
    assert skew.rows_of(rows, ids.limit(0)).collect() == []


def test_stored_rows(spark):
    df = spark.createDataFrame([(1, "a", [1]), (None, None, None)], "k long, t string, xs array<long>").withColumn("nothing", F.lit(None))
    for x in (df, df.drop("nothing")):
        back = skew.stored(x)
        assert back.schema.simpleString() == x.schema.simpleString() and sorted(map(repr, back.collect())) == sorted(map(repr, x.collect()))


def test_texts_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    """A task gets so many bytes of text, not a fixed part of it."""
    monkeypatch.setattr(views, "TASK_BYTES", 100)
    spark.createDataFrame([(i, f"a b{i}. c", "en") for i in range(3000)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = views.words(spark, str(tmp_path))
    assert max(int(x) for x in re.findall(r"REPARTITION_BY_NUM|hashpartitioning\([^)]*, (\d+)\)", made._jdf.queryExecution().executedPlan().toString()) if x) > 4 * n
    assert made.count() == 9000


def test_dense_clips_of_equal_length(spark):
    """Many clips within the reach of a chunk's edge: equal to the plain loop, with chunks that need several rounds."""
    rng = random.Random(4)
    rows = [(1, f"c{i}", s, s + 2000, rng.randrange(50)) for i, s in enumerate(rng.randrange(60_000) for _ in range(1500))]
    df = spark.createDataFrame(rows, "media_id long, clip_id string, start_ms long, end_ms long, score int")
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[2], r[3], r[1])):
        inter = [max(0, min(r[3], k[3]) - max(r[2], k[2])) for k in kept]
        if all(x <= 0.4 * (4000 - x) for x in inter):
            kept.append(r)
    from momentlake.operators import selection as S
    rule = skew.overlap_above(0.4)
    assert rule.shift_ratio == 0.6
    assert sorted(r.clip_id for r in S.priority_merge(df, df.limit(0), k=None).collect()) == sorted(r[1] for r in kept)
    rank = [-F.col("score"), F.col("start_ms"), F.col("end_ms"), F.col("clip_id")]
    for chunk in (1, 9000):
        assert sorted(r.clip_id for r in skew.greedy_select(df, ["media_id"], rank, "start_ms", "end_ms", rule, chunk_ms=chunk).collect()) == sorted(r[1] for r in kept)


def test_cue_lists_stay_short(spark, monkeypatch):
    monkeypatch.setattr(E, "CUE_LIST", 2)
    cues = spark.createDataFrame([(i, "a" if i % 3 else "common") for i in range(300)], "cue_id long, profile string")
    sets = spark.createDataFrame([(1, "a", [5, 999]), (2, "b", [4, 4]), (2, None, None)], "media_id long, game_profile string, extra_cues array<long>")
    made = E.gather_cue_sets(cues, sets)
    got = [tuple(r) for r in made.collect()]
    assert sorted(got) == sorted([(1, i) for i in range(300)] + [(2, i) for i in range(0, 300, 3)] + [(2, 4)])


def test_cue_phrases_with_blanks(spark):
    docs = spark.createDataFrame([("g", '{"phrases": {"My  Label": ["\\tA  b ", "a b", " x", null, " "], "my__label": ["X"]}}'), ("o", '{"K!": ["y\\n", "Y z"]}')], "game string, data string")
    got = L.read_cue_documents(docs)["phrases"].collect()
    assert sorted((r.game, r.label, r.phrase) for r in got) == [("g", "my__label", "A b"), ("g", "my__label", "X"), ("o", "k", "Y z"), ("o", "k", "y")]
