import random

import pytest
from pyspark.sql import functions as F

from momentlake import phrases as PH
from momentlake.functions.text import fold_text
from momentlake.operators import captions as C, events as E

READS = [(1, 7, 10, "Kill  DOUBLE kil, you did it again my dear friend"), (2, 7, 20, "the spikee was planted"), (3, 8, 30, "Chiến thắng!"), (4, 8, 40, None), (5, 8, 50, "")]
PHRASES = [("kill", "kill"), ("kill", "double kill"), ("plant", "spike"), ("long", "you did it again my dear"), ("win", "chien thang"), ("no", "did it you")]


def reads(spark):
    return spark.createDataFrame(READS, "read_id long, media_id long, t_ms long, text string")


def test_phrases_of_any_length(spark):
    p = spark.createDataFrame(PHRASES, "label string, phrase string")
    got = {(r.read_id, r.label): r.phrase for r in E.match_keywords(reads(spark), p).collect()}
    assert got == {(1, "kill"): "kill", (1, "long"): "you did it again my dear", (3, "win"): "chien thang"}


def test_near_phrases_are_pooled(spark):
    """A near hit on a longer phrase beats an exact one on a shorter; one letter more on five is a ratio of 91."""
    p = spark.createDataFrame(PHRASES, "label string, phrase string")
    got = {(r.read_id, r.label): r.phrase for r in E.match_keywords_fuzzy(reads(spark), p).collect()}
    assert got == {(1, "kill"): "double kill", (1, "long"): "you did it again my dear", (2, "plant"): "spike", (3, "win"): "chien thang"}


def test_user_phrases(spark):
    cues = spark.createDataFrame([(7, "You did it again, my dear!"), (8, "you did")], "media_id long, phrase string")
    assert [(r.media_id, r.read_id, r.t_ms, r.phrase) for r in E.manual_matches(reads(spark), cues).collect()] == [(7, 1, 10, "you did it again my dear")]


def test_removed_phrases(spark):
    words = "one two three four five six seven one two".split()
    caps = spark.createDataFrame([(1, "c", i, w) for i, w in enumerate(words)], "media_id long, clip_id string, pos long, text string")
    left = C.remove_phrases(caps, spark.createDataFrame([("two three four five six seven",), ("one two one",)], "phrase string"))
    assert [r.text for r in left.orderBy("pos").collect()] == ["one", "one", "two"]


def test_folding(spark):
    import re
    import unicodedata
    texts = ["Chiến thắng", "ＶＩＣＴＯＲＹ １２", "ﬁnal ½ №5 ™ x…y", "ß Ł İ K ǆ", "e\u0301té", "𝕏 𝟙", None, "日本 a"]
    got = [r.f for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(fold_text("t").alias("f")).collect()]

    def want(t):
        plain = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()
        return re.sub("[^a-z0-9]+", " ", plain).strip()
    assert got == [None if t is None else want(t) for t in texts]
    assert [None if t is None else PH.fold(t) for t in texts] == got


def places(toks, phrases, whole):
    """Every place of every phrase in (position, token) pairs by plain comparison."""
    out = set()
    for p in phrases:
        w = p.split(" ")
        for i in range(len(toks) - len(w) + 1):
            t = [x for _, x in toks[i:i + len(w)]]
            if whole or len(w) > 1:
                ok = t[1:-1] == w[1:-1] and (t == w if whole else t[0].endswith(w[0]) and t[-1].startswith(w[-1]))
            else:
                ok = w[0] in t[0]
            if ok:
                out.add((p, toks[i][0], toks[i + len(w) - 1][0]))
    return out


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("chunk, block", [(1, 2), (2, 100), (7, 1), (1000, 100)])
def test_phrases_across_chunks(spark, whole, chunk, block, monkeypatch):
    """Rows with none, one or several tokens; chunks shorter than the phrases; dictionaries of several blocks."""
    monkeypatch.setattr(PH, "DICTIONARY_BLOCK", block)
    monkeypatch.setattr(PH.read_blocks, "__defaults__", ("phrase", block))
    rng = random.Random(chunk)
    rows = [(m, i, [rng.choice(["a", "b", "ab", "ba"]) for _ in range(rng.choice([0, 0, 1, 1, 2, 3]))]) for m in (1, 2) for i in range(60)]
    phrases = ["a", "ab", "a b", "b a b", "a a a a a", "ab ba", "b b a a b ab a", "a b"]
    df = spark.createDataFrame(rows, "media_id int, pos long, toks array<string>")
    book = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    got = {(r.media_id, r.phrase, r.pos_lo, r.pos_hi) for r in PH.phrases_in_stream(df, ["media_id"], book, whole=whole, chunk_rows=chunk).collect()}
    want = set()
    for m in (1, 2):
        want |= {(m, *h) for h in places([(i, t) for k, i, ts in rows if k == m for t in ts], set(phrases), whole)}
    assert got == want and len(want) > 20


def test_no_phrases(spark):
    df = spark.createDataFrame([(1, 0, ["a"])], "media_id int, pos long, toks array<string>")
    none = spark.createDataFrame([("",), (None,)], "phrase string")
    assert PH.phrases_in_stream(df, ["media_id"], none).collect() == []
    assert PH.phrases_in_texts(df.select("media_id", F.lit("a").alias("text")), none).collect() == []


def plain_near(phrase, text, ratio=86):
    """The ratio of every run of as many words by the usual table."""
    n, words = phrase.count(" ") + 1, text.split(" ") if text else []
    if n == 1 and len(phrase) < 5:
        return False
    for i in range(len(words) - n + 1):
        x, row = " ".join(words[i:i + n]), [0] * (len(phrase) + 1)
        for c in x:
            last = 0
            for j, d in enumerate(phrase, 1):
                last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
        if 200.0 * row[-1] / (len(x) + len(phrase)) >= ratio:
            return True
    return False


@pytest.mark.parametrize("ratio", [86, 70, 95])
def test_near_phrases_are_all_found(ratio):
    """Random edits of letters and blanks against the plain loop: nothing missed, nothing extra."""
    rng = random.Random(ratio)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 8)))
    phrases = list({" ".join(word() for _ in range(rng.choice([1, 1, 2, 3, 6]))) for _ in range(60)})
    book, hits = PH.NearDictionary(phrases, ratio), 0
    for _ in range(400):
        t = list(" ".join([word(), rng.choice(phrases), word()]))
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(t))
            t[k:k + rng.choice([0, 1])] = rng.choice(["", "a", "e", " "])
        text = PH.fold("".join(t))
        want = {i for i, p in enumerate(phrases) if plain_near(p, text, ratio)}
        assert book.find(text) == want
        hits += len(want)
    assert hits > 100


def test_false_phrases_in_any_part(spark):
    rows = spark.createDataFrame([(1, "cs", "the bomb squadron"), (2, "cs", "nothing"), (3, "val", "bomb squad"), (4, "val", "free ADS here"), (5, None, None)], "read_id int, game string, text string")
    false = spark.createDataFrame([("cs", "Bomb squad"), ("common", "ads")], "game string, phrase string")
    assert sorted(r.read_id for r in E.drop_false_positives(rows, false).collect()) == [2, 3, 5]
