"""Audio tags, embeddings, templates and envelopes (all from input tables)."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from momentlake.functions.text import clamp
from momentlake.operators.selection import nms_gap
from momentlake.skew import range_join

# fixed values: audio class substrings per highlight reason, in order
HYPE_GROUPS = {
    "crowd cheering": ["cheering", "crowd", "applause", "clapping"],
    "laughter": ["laughter", "giggle", "chuckle"],
    "excited shouting": ["screaming", "shout", "yell", "children shouting"],
    "explosive action": ["explosion", "gunshot", "gunfire", "machine gun", "artillery", "boom"],
    "impact": ["smash", "crash", "shatter", "glass", "slam"],
}

# fixed values: high-arousal emotion labels
HIGH_AROUSAL = ["happy", "angry", "surprised", "fearful", "excited", "disgusted"]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.greatest(F.sqrt(dot(v, v)), F.lit(1e-6))


def unit(v: Column) -> Column:
    # the outer transform binds the norm once; inlined it would be computed for every element
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1)


def hype_from_tags(tags: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Strongest member per highlight group, groups combined by probabilistic or.
    ``tags(span_id, label, prob)``."""
    groups = groups or HYPE_GROUPS
    low = F.lower("label")
    best = [F.max(F.when(F.exists(F.array(*[F.lit(n) for n in needles]), lambda n: F.contains(low, n)), F.col("prob"))).alias(f"g{i}")
            for i, needles in enumerate(groups.values())]
    g = tags.groupBy("span_id").agg(*best)
    arr = F.filter(F.array(*[F.struct(F.col(f"g{i}").alias("p"), F.lit(-i).alias("o"), F.lit(r).alias("reason")) for i, r in enumerate(groups)]),
                   lambda x: x["p"].isNotNull())
    g = g.withColumn("_a", arr).where(F.size("_a") > 0)
    hype = F.aggregate("_a", F.lit(0.0), lambda s, x: s + x["p"] - s * x["p"])
    return g.select("span_id", clamp(hype).alias("hype"), F.array_max("_a")["reason"].alias("reason"))


def arousal(emotions: DataFrame, labels=tuple(HIGH_AROUSAL)) -> DataFrame:
    """Sum of the probabilities of high-arousal labels per span."""
    short = F.substring_index(F.substring_index(F.lower("label"), "/", -1), "_", -1)
    hit = F.exists(F.array(*[F.lit(x) for x in labels]), lambda h: F.contains(short, h))
    return emotions.groupBy("span_id").agg(clamp(F.sum(F.when(hit, F.col("prob")).otherwise(0.0))).alias("arousal"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows; null lists become zeros."""
    if not len(column):
        return np.zeros((0, 0))
    width = int(pc.max(pc.list_value_length(column)).as_py() or 0)
    out = np.zeros((len(column), width))
    out[column.is_valid().to_numpy(zero_copy_only=False)] = np.asarray(column.flatten(), dtype=float).reshape(-1, width)
    return out


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-6)


BEST = "struct<sim:double,label:string>"


def embedding_similarity(windows: DataFrame, prompts: DataFrame, block: int = 4096) -> DataFrame:
    """Best cosine of every window per polarity with its label: columns ``pos`` and ``neg``, null without prompts of the
    polarity or without an embedding. Equal cosines go to the greater label.

    Prompts are read in blocks. A block and an Arrow batch of windows make one matrix product, of which only the best
    per polarity stays and is merged with that of the blocks before; windows are never shuffled, pairs never listed.
    """
    spark = windows.sparkSession
    names = [c for c in windows.columns if c not in ("pos", "neg")]
    out = windows.select(*names, F.lit(None).cast(BEST).alias("pos"), F.lit(None).cast(BEST).alias("neg"))
    schema = out.schema
    kind = pa.struct([("sim", pa.float64()), ("label", pa.string())])

    def better(labels, matrices):
        def run(batches):
            book = matrices.value
            for b in batches:
                x = _units(_matrix(b.column("embedding")))
                there = b.column("embedding").is_valid().to_pylist()
                cols = [b.column(c) for c in names]
                for side in ("pos", "neg"):
                    best = b.column(side).to_pylist()
                    if labels[side] and len(x):
                        sims = np.round(x @ book[side].T, 12)  # products of equal vectors may differ in the last bit
                        at = sims.shape[1] - 1 - np.argmax(sims[:, ::-1], axis=1)  # labels rise, so the last best one counts
                        for i, (k, v) in enumerate(zip(at.tolist(), sims[np.arange(len(x)), at].tolist(), strict=True)):
                            if there[i] and (best[i] is None or (v, labels[side][k]) > (best[i]["sim"], best[i]["label"])):
                                best[i] = {"sim": v, "label": labels[side][k]}
                    cols.append(pa.array(best, kind))
                yield pa.RecordBatch.from_arrays(cols, schema.names)
        return run

    part: list = []
    rows = prompts.select("label", "polarity", "embedding").orderBy("label").toLocalIterator()
    while part := list(islice(rows, block)):
        mine = {side: [r for r in part if r.polarity == side] for side in ("pos", "neg")}
        labels = {side: [r.label for r in rs] for side, rs in mine.items()}
        matrices = spark.sparkContext.broadcast({side: _units(np.array([r.embedding for r in rs], dtype=float)) if rs else None for side, rs in mine.items()})
        out = out.mapInArrow(better(labels, matrices), schema)
    return out


def all_similarities(windows: DataFrame, prompts: DataFrame, block: int = 4096, rows: int = 256) -> DataFrame:
    """Cosine of every window with every prompt: the columns of ``windows`` but the embedding, then ``label``, ``polarity``
    and ``sim`` (null without an embedding).

    Prompts are read in blocks as in ``embedding_similarity``; ``rows`` windows times a block are one matrix product that
    leaves the task at once.
    """
    spark = windows.sparkSession
    names = [c for c in windows.columns if c != "embedding"]
    schema = T.StructType([*[windows.schema[c] for c in names], *T.StructType.fromDDL("label string, polarity string, sim double").fields])

    def product(labels, sides, matrix):
        def run(batches):
            known, side = pa.array(labels, pa.string()), pa.array(sides, pa.string())
            for whole in batches:
                for b in (whole.slice(i, rows) for i in range(0, whole.num_rows, rows)):
                    there = b.column("embedding").is_valid().to_numpy(zero_copy_only=False)
                    sims = _units(_matrix(b.column("embedding"))) @ matrix.value.T if there.any() else np.zeros((b.num_rows, len(labels)))
                    at = np.repeat(np.arange(b.num_rows), len(labels))
                    which = np.tile(np.arange(len(labels)), b.num_rows)
                    cosine = pa.array(np.round(sims, 12).ravel(), mask=np.repeat(~there, len(labels)))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in names), known.take(pa.array(which)), side.take(pa.array(which)), cosine], schema.names)
        return run

    out = None
    read = prompts.select("label", "polarity", "embedding").orderBy("label").toLocalIterator()
    while part := list(islice(read, block)):
        matrix = spark.sparkContext.broadcast(_units(np.array([r.embedding for r in part], dtype=float)))
        pairs = windows.mapInArrow(product([r.label for r in part], [r.polarity for r in part], matrix), schema)
        out = pairs if out is None else out.unionByName(pairs)
    return spark.createDataFrame([], schema) if out is None else out


def prompt_group_max(sims: DataFrame, polarity: str) -> Column:
    """Best similarity of a polarity and its label: ``struct<sim, label>``; null without prompts."""
    return sims[polarity]


def zero_shot_gate(sims: DataFrame) -> DataFrame:
    """Positive prompt against negative prompts: floors, margin and risk gate."""
    p, n = F.col("pos.sim"), F.coalesce(F.col("neg.sim"), F.lit(-1.0))
    hype = clamp((p - 0.20) / 0.28)
    risk = F.when(n >= 0.22, clamp((n - 0.22) / 0.28))
    left = F.greatest(F.lit(0.0), hype - risk * 0.45)
    out = (F.when(p.isNull() | (p < 0.20) | (p - n < 0.06), None).when(risk.isNull(), hype)
           .when((risk >= F.greatest(F.lit(0.45), hype * 0.85)) | (left < 0.25), None).otherwise(left))
    return sims.withColumns({"hype": out, "reason": F.col("pos.label")}).where("hype is not null").drop("pos", "neg")


def template_hits(frames: DataFrame, cue_frames: DataFrame, threshold: float, chunk_frames: int = 4096, block_frames: int = 4096) -> DataFrame:
    """``media_id, label, frame, sim``: every frame at which a cue of two frames or more lies wholly over present frames
    with a mean product of ``threshold``.

    Overlap-save: a chunk of frames gets the first frames of the next one as a halo, as many as the longest cue needs.
    Cues are read in blocks; a chunk times a cue is one matrix product whose diagonals are summed, and only hits leave
    the task.
    """
    spark = frames.sparkSession
    sizes = [(r.label, r.n) for r in cue_frames.groupBy("label").agg(F.count("*").alias("n")).where("n >= 2").orderBy("label").toLocalIterator()]
    schema = T.StructType([frames.schema["media_id"], T.StructField("label", T.StringType()), T.StructField("frame", T.LongType()), T.StructField("sim", T.DoubleType())])
    if not sizes:
        return spark.createDataFrame([], schema)
    halo = max(n for _, n in sizes) - 1
    chunk = max(chunk_frames, 4 * halo)
    blocks, held = [[]], 0
    for label, n in sizes:
        if held and held + n > block_frames:
            blocks.append([])
            held = 0
        blocks[-1].append(label)
        held += n
    here = F.floor(F.col("frame") / chunk)
    both = F.when((F.col("frame") % chunk < halo) & (here > 0), F.array(here - 1, here)).otherwise(F.array(here))
    placed = frames.select("media_id", F.col("frame").cast("bigint").alias("frame"), "vec", F.explode(both).alias("_at"))

    def correlate(cues: dict[str, np.ndarray]):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("frame").combine_chunks()
            at, x = table["frame"].to_numpy(), _matrix(table["vec"].combine_chunks())
            own = at // chunk == table["_at"][0].as_py()
            found = []
            for label, cue in cues.items():
                n = len(cue)
                if len(at) < n:
                    continue
                last = len(at) - n + 1
                product = x @ cue.T
                sim = sum(product[i:last + i, i] for i in range(n)) / n
                ok = (at[n - 1:] - at[:last] == n - 1) & own[:last] & (sim >= threshold)
                found += [(label, int(at[k]), float(sim[k])) for k in np.flatnonzero(ok)]
            media = table["media_id"].take(pa.array([0] * len(found), pa.int64()))
            return pa.table([media, *(pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.int64(), pa.float64())))], names=schema.names)
        return run

    parts = []
    for labels in blocks:
        cues: dict[str, list] = {}
        for r in cue_frames.where(F.col("label").isin(labels)).select("label", "i", "vec").orderBy("label", "i").collect():  # at most block_frames, or one cue
            cues.setdefault(r.label, []).append(r.vec)
        parts.append(placed.groupBy("media_id", "_at").applyInArrow(correlate({k: np.array(v, dtype=float) for k, v in cues.items()}), schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def template_match(frames: DataFrame, cue_frames: DataFrame, threshold: float = 0.84, gap_frames: int = 94, k: int = 24,
                   chunk_frames: int = 4096) -> DataFrame:
    """Positions where a cue (``cue_frames(label, i, vec)``, unit vectors) correlates with the frames
    (``frames(media_id, frame, vec)``), strongest first and ``gap_frames`` apart."""
    hits = template_hits(frames, cue_frames, threshold, chunk_frames)
    return nms_gap(hits, "sim", gap_frames, k, t="frame", tie=("frame",), keys=("media_id", "label"))


def reaction_energy(frames: DataFrame, clips: DataFrame, scale: float = 0.04) -> DataFrame:
    """Mean absolute change between consecutive frame vectors inside a clip; null under two frames."""
    j = range_join(frames.select("media_id", "t_ms", "vec"), clips.select("media_id", "clip_id", "start_ms", "end_ms"), "t_ms", F.col("start_ms"), F.col("end_ms"))
    j = j.withColumn("_p", F.lag("vec").over(W.partitionBy("media_id", "clip_id").orderBy("t_ms")))
    diff = F.aggregate(F.zip_with("vec", "_p", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v) / F.size("vec")
    g = j.groupBy("media_id", "clip_id").agg(F.avg(F.when(F.col("_p").isNotNull(), diff)).alias("_e"))
    return clips.select("media_id", "clip_id").join(g, ["media_id", "clip_id"], "left").withColumn("reaction", F.least(F.col("_e") / scale, F.lit(1.0))).drop("_e")


def action_center(columns: DataFrame, lo: float = 0.32, hi: float = 0.68) -> DataFrame:
    """Motion-weighted horizontal centre per clip from ``(media_id, clip_id, energies ARRAY)``;
    a masked column carries null."""
    x = columns.select("media_id", "clip_id", F.size("energies").alias("n"), F.posexplode("energies").alias("c", "e")).where("e is not null")
    g = x.groupBy("media_id", "clip_id").agg(F.sum("e").alias("s"), (F.sum(F.col("e") * F.col("c")) / F.greatest(F.max("n") - 1, F.lit(1))).alias("m"))
    return g.select("media_id", "clip_id", F.when(F.col("s") > 1e-6, clamp(F.col("m") / F.col("s"), lo, hi)).alias("cx"))


def rms_envelope(pcm: DataFrame, rate: int, win_ms: int = 250, hop_ms: int = 100) -> DataFrame:
    """Short-time loudness from sample chunks ``(media_id, first_sample, samples)``.

    Sums of squares per common divisor of window and hop are added into the frames they touch;
    plain aggregation, so a long recording spreads over all tasks.
    """
    step = rate * 50 // 1000
    win, hop = win_ms // 50, hop_ms // 50
    x = pcm.select("media_id", "first_sample", F.posexplode("samples").alias("i", "v"))
    b = x.groupBy("media_id", F.floor((F.col("first_sample") + F.col("i")) / step).alias("block")).agg(
        F.sum(F.col("v").cast("double") * F.col("v").cast("double")).alias("s"), F.count("*").alias("c"))
    total = b.groupBy("media_id").agg(F.sum("c").alias("_t"))
    n = F.greatest(F.floor((F.col("_t") - win * step) / (hop * step)), F.lit(0))
    total = total.select("media_id", n.alias("_n")).where("_n >= 3")
    f = b.withColumn("frame", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("block") - (win - 1)) / hop)), F.floor(F.col("block") / hop))))
    g = f.groupBy("media_id", "frame").agg(F.sum("s").alias("s")).join(total, "media_id").where(F.col("frame") < F.col("_n"))
    return g.select("media_id", "frame", (F.col("frame") * hop_ms).alias("t_ms"), F.sqrt(F.col("s") / (win * step) + 1e-9).alias("rms"))


# fixed values: descriptions for short user cues
PROMPT_EXPANSIONS = {
    "gunfire": "gunfire, sharp transient burst of automatic weapons fire",
    "gunshot": "gunshot, single sharp ballistic impact sound",
    "explosion": "explosion, deep sustained boom with long decay",
    "goal": "goal celebration, crowd cheering and commentator screaming goal",
    "ace": "ace call, triumphant announcer line after a clean round win",
    "kill": "kill confirmation sound, short metallic ding after an elimination",
    "headshot": "headshot sound, sharp metallic ping on a precision kill",
    "cheer": "crowd cheering, sustained applause and excited shouting",
    "applause": "applause, rhythmic clapping from a crowd",
    "laughter": "laughter, people laughing loudly at a funny moment",
    "whistle": "referee whistle, sharp trilling blast",
    "siren": "siren, long sustained wailing tone",
    "bell": "bell, resonant metallic ring",
    "buzz": "buzzer, harsh sustained electric vibration",
    "scream": "scream, loud excited human vocal reaction",
    "roar": "crowd roar, sustained loud cheering after a big moment",
    "ding": "metallic ding, short high-pitched confirmation tone",
    "fanfare": "victory fanfare, triumphant brass musical sting",
}


def build_prompt_set(base: DataFrame, game: DataFrame, language: DataFrame, custom: DataFrame, min_words: int = 3) -> DataFrame:
    """Union of prompt tables ``(label, polarity, prompt)``. A positive custom prompt of fewer than
    ``min_words`` words also appears in a described form."""
    p = F.trim("prompt")
    c = custom.withColumn("prompt", p).where("prompt != ''").withColumn(
        "label", F.when(F.col("polarity") == "pos", "custom cue").otherwise("custom non-highlight"))
    known = F.create_map(*[F.lit(x) for kv in PROMPT_EXPANSIONS.items() for x in kv])
    key = F.regexp_replace(F.lower("prompt"), "[.,;:!?]+$", "")
    long = F.coalesce(F.try_element_at(known, key), F.concat("prompt", F.lit(" sound effect, a clear and distinct "), "prompt"))
    short = c.where((F.col("polarity") == "pos") & (F.size(F.split("prompt", "\\s+")) < min_words)).withColumn("prompt", long)
    extra = c.unionByName(short).groupBy("label", "polarity", F.lower("prompt").alias("_k")).agg(F.min("prompt").alias("prompt")).drop("_k")
    u = base
    for d in (game, language, extra):
        u = u.unionByName(d)
    return u.dropDuplicates(["label", "polarity", "prompt"])
