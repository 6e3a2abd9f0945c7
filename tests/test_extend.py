import pytest
from pyspark.sql import functions as F

from checks.views import MARKERS, lexicon, media, words
from momentlake.plans import extend, talking

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def clean():
    yield
    for table in (extend.STAGES, extend.SINKS, extend.FEATURES):
        table.clear()


def moments(spark):
    w = words(spark, SF).where("media_id < 12")
    return talking.best_moments(w, media(spark, SF), lexicon(spark), markers=MARKERS, question="!")


def test_hooks_features_and_sinks(spark):
    seen, plain = [], moments(spark)
    extend.register_stage("select", before=lambda d: d.where("start_ms >= 10000"), after=lambda d: d.withColumn("mark", F.lit(1)))
    extend.register_feature("late", (F.col("start_ms") > 20000).cast("double"), 100.0)
    extend.register_sink("list", lambda d: seen.extend(d.collect()))
    changed = moments(spark)
    extend.write_to(changed, "list")
    assert seen and all(r.mark == 1 and r.start_ms >= 10000 for r in seen)
    assert {r.f_late for r in seen} == {0.0, 1.0}
    assert plain.where("start_ms < 10000").count() > 0 and "f_late" not in plain.columns
    with pytest.raises(KeyError):
        extend.write_to(plain, "list", "nowhere")
    assert len(seen) == changed.count()


def test_words_stay_by_recording(spark):
    """No word is shuffled by its language or as a term: frequent ones would fill one task."""
    from checks.views import LEXICON
    from momentlake.operators import passages as P
    lexicon = spark.createDataFrame([(lang, role, t) for lang, roles in LEXICON.items() for role, ts in roles.items() for t in ts], "lang string, role string, term string")
    text = "and that of the it is. and with it"
    w = spark.createDataFrame([(m, "en", i, i * 400, 300, t) for m in range(3) for i, t in enumerate(text.split())],
                              "media_id long, lang string, pos long, t_ms long, d_ms long, text string")
    hits = P.lexicon_hits(P.explode_tokens(P.transcript_scan(P.resolve_language(w, lexicon)), ["media_id", "lang", "pos"]), lexicon)
    sents = P.sentence_features(w, lexicon)
    for df in (hits, sents):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin [_asked" not in plan and "SortMergeJoin [lang" not in plan
    got = {(r.media_id, r.sid): (r.e_h_emotion - r.b_h_emotion, r.first_dangling) for r in sents.collect()}
    assert got == {(m, s): (int(s == 6), 1) for m in range(3) for s in (0, 6)}
