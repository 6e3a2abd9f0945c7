"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

Each word of a text weighs as often as it occurs. For each of ``samples`` positions a word draws, from hashes of word
and position alone, gamma numbers r and c and a uniform b; with t = floor(ln(weight) / r + b) its hash value is
ln(c) - r * (t - b + 1). The smallest value over the words, known by word and t, is the sample: two texts share it with
the probability of their generalised Jaccard similarity, sum of minima over sum of maxima.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from momentlake.llm.common import BLANK, durable, whole_text

SAMPLES = 16
HALF = float(1 << 32)


def sample_value(word: Column, weight: Column, k: int) -> Column:
    """A long that orders words as their hash values do; its low bits tell word and t apart."""
    x, y, z = (F.xxhash64(word, F.lit(3 * k + j)) for j in range(3))

    def uniform(h, low):  # in (0, 1)
        part = h.bitwiseAND(F.lit((1 << 32) - 1)) if low else F.shiftrightunsigned(h, 32)
        return (part + F.lit(0.5)) / F.lit(HALF)

    r = -F.log(uniform(x, True) * uniform(x, False))
    ln_c = F.log(-F.log(uniform(y, True) * uniform(y, False)))
    b = uniform(z, True)
    t = F.floor(F.log(weight) / r + b)
    value = ln_c - r * (t - b + F.lit(1.0))
    # ln_c lies in (-24, 4) and r * (t - b + 1) in (-1, ln(weight) + 46): a value is over -200 and under 8
    steps = ((value + F.lit(256.0)) * F.lit(float(1 << 30))).cast("bigint")
    return F.shiftleft(steps, 24).bitwiseOR(F.xxhash64(word, t).bitwiseAND(F.lit((1 << 24) - 1)))


def fingerprints(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``sig`` (array<long>, null for texts without words) for each row of ``texts``; the keys name a row.

    A text's words are sorted as hashes and counted within the row; the samples of a row are aggregated where it lies,
    so that one short row per text is shuffled.
    """
    cut = F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    rows = texts.withColumn("_w", F.when(F.length(cut) > 0, F.split(cut, f"[{BLANK}]+")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_h", F.sort_array(F.transform("_w", lambda x: F.xxhash64(x))))
    last = F.size("_h") - 1
    # places where a run of equal hashes ends
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.get("_h", i) != F.get("_h", i + 1), F.lit(True)))
    rows = rows.withColumn("_e", F.when(F.size("_h") > 0, ends))
    runs = F.transform("_e", lambda e, i: F.struct(F.get("_h", e).alias("h"), (e - F.coalesce(F.get("_e", i - 1), F.lit(-1))).cast("double").alias("n")))
    words = rows.select(*keys, F.explode_outer(runs).alias("_x")).select(*keys, F.col("_x.h").alias("h"), F.col("_x.n").alias("n"))
    mins = words.groupBy(*keys).agg(*[F.min(sample_value(F.col("h"), F.col("n"), k)).alias(f"_{k}") for k in range(samples)])
    return mins.select(*keys, F.when(F.col("_0").isNotNull(), F.array(*[F.col(f"_{k}") for k in range(samples)])).alias("sig"))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of equal samples; two texts without words are alike, one without words is like no other."""
    same = reduce(lambda x, y: x + y, [F.when(F.get(a, F.lit(k)) == F.get(b, F.lit(k)), 1).otherwise(0) for k in range(samples)])
    return F.when(F.col(a).isNull() | F.col(b).isNull(), F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).otherwise(0.0)).otherwise(same / F.lit(float(samples)))


def following(names: DataFrame) -> DataFrame:
    """``chunk, _to``: the next larger chunk that exists, for the largest the smallest. Chunks are ordered in groups of
    4096 numbers; only the groups' first chunks, a millionth of the rows, are ordered in one place."""
    names = names.withColumn("_g", F.shiftright("chunk", 12))
    near = names.select("*", F.lead("chunk").over(W.partitionBy("_g").orderBy("chunk")).alias("_near"))
    groups = names.groupBy("_g").agg(F.min("chunk").alias("_head"))
    every = W.orderBy("_g")
    groups = groups.select("_g", F.coalesce(F.lead("_head").over(every), F.first("_head").over(every)).alias("_far"))
    return near.join(groups, "_g").select("chunk", F.coalesce("_near", "_far").alias("_to"))


def with_next(rows: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """Adds ``next_<value>``: the values of the row that follows by ``order``, after the last row those of the first.

    Rows are cut into chunks of neighbouring ids (``chunk``, rising with the order). Within a chunk a window looks one
    row ahead; a chunk's last row gets the first row of the next chunk that exists.
    """
    inside = W.partitionBy("chunk").orderBy(*order)
    ahead = rows.select("*", F.lead(F.struct(*values)).over(inside).alias("_ahead"), F.lead(F.lit(1)).over(inside).isNull().alias("_last"))
    first = rows.groupBy("chunk").agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_first"))
    follow = following(rows.select("chunk").distinct())
    carry = follow.join(first.withColumnRenamed("chunk", "_to"), "_to").select("chunk", "_first")
    out = ahead.join(carry, "chunk")
    value = F.when(F.col("_last"), F.col("_first")).otherwise(F.col("_ahead"))
    return out.select(*rows.columns, *[value[v].alias(f"next_{v}") for v in values])


def fingerprint_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row of ``docs``.

    The edited text has the last quarter of the text's code points replaced by as many from the start of the next
    document, by doc_id (of equal ids by text; a missing id comes last), after the last the first; a table of one row
    follows itself. Null texts are empty. Repeated rows are kept each. Other columns are not read; an empty table gives
    an empty result.
    """
    rows = docs.select("doc_id", whole_text().alias("text"), F.monotonically_increasing_id().alias("uid")).withColumn(
        "chunk", F.coalesce(F.shiftright(F.col("doc_id").cast("bigint"), 8), F.lit((1 << 63) - 1)))
    pairs = with_next(rows, ["chunk", "doc_id", "text", "uid"], ["text", "uid"])
    quarter = "cast(length(text) div 4 as int)"
    edited = F.concat(F.expr(f"substring(text, 1, length(text) - {quarter})"), F.expr(f"substring(next_text, 1, {quarter})"))
    texts = F.array(F.struct(F.lit(0).alias("which"), F.col("text"), F.lit(None).cast("binary").alias("sha")),
                    F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"), F.unhex(F.sha2("edited", 256)).alias("sha")))
    pairs = pairs.select("doc_id", "uid", "next_uid", F.length("text").cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
    both = pairs.select("doc_id", "uid", "next_uid", "n_chars", F.explode(texts).alias("x")).select("doc_id", "uid", "next_uid", "n_chars", "x.*")
    sigs = durable(fingerprints(both, ["uid", "which", "doc_id", "next_uid", "n_chars", "sha"], samples))
    own = sigs.where("which = 0").select("uid", "next_uid", "doc_id", "n_chars", "sig")
    new = sigs.where("which = 1").select("uid", F.lower(F.hex("sha")).alias("edited_sha256"), F.col("sig").alias("edited_sig"))
    after = own.select(F.col("uid").alias("next_uid"), F.col("sig").alias("next_sig"))
    out = own.join(new, "uid").join(after, "next_uid")

    def text_of(sig):
        return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lower(F.hex(x))), "-"), F.lit(""))

    return out.select("doc_id", "n_chars", "edited_sha256", text_of("sig").alias("fingerprint"), text_of("edited_sig").alias("edited_fingerprint"),
                      likeness("sig", "edited_sig", samples).alias("near_edited"), likeness("sig", "next_sig", samples).alias("near_next"))
