"""Near-duplicate documents: MinHash bands give candidates, sequential Bayesian tests prune them, full sets decide.

1. One pass makes a lean row per document: key of its shingle set, set size, MinHash signature.
2. Documents with equal sets form a class; only classes go on, so exact copies cost nothing more.
3. Classes meet in band buckets. Each member is compared with its bucket's first class (a star, not all pairs).
   Components of these links leave few buckets with more than one component; there, and only there, members outside
   the bucket's largest component are compared with the others, tile by tile: a task holds two tiles of bounded size
   and emits links, never pairs. Every pair that shares a bucket is then either in one component or was compared.
4. A comparison looks at the signatures batch by batch and stops when the posterior probability of reaching the
   threshold falls under ``miss``; survivors are decided on their full shingle sets, made again from their texts.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from momentlake.llm.common import durable, slices, text_bytes, whole_text

BANDS, ROWS, BATCH = 32, 5, 32
HASHES = BANDS * ROWS
_rng = np.random.default_rng(20240229)
MULTIPLY = _rng.integers(1 << 62, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2)
BAND_MULTIPLY = _rng.integers(1 << 62, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_ADD = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Distinct word shingles of UTF-8 texts as sorted 64-bit hashes; A-Z count as a-z, words end at ASCII blanks."""

    def __init__(self, width: int, limit: int = 400_000):
        self.width, self.limit, self.seen = width, limit, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # for bytes: A-Z only, and exactly the blanks \\x20 and \\x09-\\x0D
        if not words:
            return np.zeros(0, np.uint64)
        seen = self.seen
        try:
            h = [seen[w] for w in words]
        except KeyError:
            if len(seen) > self.limit:
                seen.clear()
            for w in words:
                if w not in seen:
                    seen[w] = xxhash.xxh3_64_intdigest(w)
            h = [seen[w] for w in words]
        h = np.array(h, np.uint64)
        width = min(self.width, len(h))
        n = len(h) - width + 1
        x = np.full(n, width, np.uint64)  # a short text's one sequence never equals a full shingle
        for k in range(width):
            x = x * STEP + h[k:k + n]
        return np.unique(mix(x))


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(low, ((shingles[at:at + 2048, None] ^ FLIP) * MULTIPLY).min(axis=0), out=low)
    return (mix(low) >> np.uint64(48)).astype("<u2")


@lru_cache(maxsize=16)
def least_matches(percent: int, miss: float) -> tuple[int, ...]:
    """For each number of hashes looked at, the fewest matches with which P(similarity >= threshold | matches) >= miss.
    The prior is uniform, so the posterior is a beta distribution, whose tail is a binomial sum."""
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss and m <= n:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, th, n_shingles, set_key, sig`` per row; set_key and sig are null for texts without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        shingle = Shingler(width)
        for b in slices(batches):
            n, keys, sigs = [], [], []
            for t in text_bytes(b):
                s = shingle(t)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                                             ["doc_id", "th", "n_shingles", "set_key", "sig"])

    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("th", F.xxhash64("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, th bigint, n_shingles bigint, set_key binary, sig binary")


def buckets(classes: DataFrame) -> DataFrame:
    """``bucket, band, cid``: a row per class and band."""
    def run(batches):
        for b in slices(batches, 1024):
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = mix((sig * BAND_MULTIPLY).sum(axis=2, dtype=np.uint64) + BAND_ADD)
            cid = np.repeat(b.column("cid").to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int16), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(band), pa.array(cid)], ["bucket", "band", "cid"])

    return classes.select("cid", "sig").mapInArrow(run, "bucket bigint, band smallint, cid bigint")


def likely(pairs: DataFrame, classes: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) that the sequential tests leave."""
    least = least_matches(percent, miss)

    def run(batches):
        for b in slices(batches, 2048):
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            alive, matches = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for k, m in enumerate(least):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (x[alive, cut] == y[alive, cut]).sum(axis=1)
                stay = matches >= m
                alive, matches = alive[stay], matches[stay]
                if not len(alive):
                    break
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(alive)), b.column("b").take(pa.array(alive))], ["a", "b"])

    sigs = classes.select("cid", "sig")
    full = (pairs.join(sigs.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b")), "b")
            .join(sigs.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a")), "a"))
    return full.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint")


def texts_of(classes: DataFrame, cids: DataFrame, docs: DataFrame) -> DataFrame:
    """``cid, text`` for the classes in ``cids``, read again by each class's one row."""
    need = classes.select("cid", "rep.*").join(cids, "cid", "left_semi").select("cid", F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("th", F.xxhash64("text"))
    texts = rows.join(need, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("cid", "text")
    return durable(texts.dropDuplicates(["cid"]))


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    same = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * same >= percent * (len(x) + len(y) - same)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity."""
    def run(batches):
        shingle, held = Shingler(width), (None, None)
        for b in slices(batches, 256):
            a, c, links = b.column("a").to_pylist(), b.column("b").to_pylist(), []
            for k, (ta, tb) in enumerate(zip(text_bytes(b, "text_a"), text_bytes(b, "text_b"), strict=True)):
                if held[0] != a[k]:
                    held = (a[k], shingle(ta))
                if alike(held[1], shingle(tb), percent):
                    links.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in links], pa.int64()), pa.array([c[k] for k in links], pa.int64())], ["a", "b"])

    full = (pairs.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a"))
    return full.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def tiles(inside: DataFrame, rows: int) -> DataFrame:
    """``bucket, band, i, j, cid, label, odd`` for buckets with several components: members outside the largest component
    (odd) are cut into tiles of about ``rows``, so are the others; (i, j) names a pair of tiles to compare. j under 0 is
    tile -j - 1 of the odd ones. A bucket of at most ``rows`` members is one tile."""
    sizes = inside.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    mixed = mixed.select("bucket", F.col("top.label").alias("top"), F.col("n").alias("_all"), F.ceil((F.col("n") - F.col("top.n")) / rows).alias("_o"), F.ceil(F.col("top.n") / rows).alias("_p"))
    x = inside.join(mixed, "bucket").withColumn("odd", F.col("label") != F.col("top"))
    x = x.withColumn("_t", F.pmod(F.xxhash64("cid"), F.when(F.col("odd"), F.col("_o")).otherwise(F.col("_p"))))
    others = F.transform(F.sequence(F.lit(0), F.col("_o") - 1), lambda u: F.struct(F.greatest(u, F.col("_t")).alias("i"), (-F.least(u, F.col("_t")) - 1).alias("j")))
    tops = F.transform(F.sequence(F.lit(0), F.col("_p") - 1), lambda u: F.struct(F.col("_t").alias("i"), u.alias("j")))
    mine = F.transform(F.sequence(F.lit(0), F.col("_o") - 1), lambda u: F.struct(u.alias("i"), F.col("_t").alias("j")))
    one = F.array(F.struct(F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j")))
    cells = F.when(F.col("_all") <= rows, one).when(F.col("odd"), F.concat(others, tops)).otherwise(mine)
    return x.select("bucket", "band", "cid", "label", "odd", "_t", "_all", F.explode(cells).alias("c")).select("bucket", "band", "c.i", "c.j", "cid", "label", "odd", "_t", (F.col("_all") <= rows).alias("whole"))


def tile_links(cells: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int, miss: float) -> DataFrame:
    """Links (a, b) within the pairs of tiles: sequential tests, then full sets, all where the tiles lie. A pair is tested in
    its first common band only."""
    least = least_matches(percent, miss)
    cells = cells.join(classes.select("cid", "sig"), "cid").join(texts, "cid")
    n = max(1, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = cells.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").select("bucket", "i", "j", "band", "whole", "cid", "label", "odd", "_t", "sig", "text")

    def compare(cell, shingle):
        band, whole, j = cell[0][3], cell[0][4], cell[0][2]
        cid, label, odd, tile = (np.array([r[k] for r in cell]) for k in (5, 6, 7, 8))
        sig, sets = np.frombuffer(b"".join(r[9] for r in cell), "<u2").reshape(-1, HASHES), {}
        out = []
        for a in np.flatnonzero(odd):
            rest = (label != label[a]) & ((np.arange(len(cid)) > a) | ~odd)  # two odd ones once
            if not whole:
                rest &= (odd & ((tile != tile[a]) | (cell[0][1] == -j - 1))) if j < 0 else ~odd
            alive = np.flatnonzero(rest)
            matches = np.zeros(len(alive), np.int64)
            for k, m in enumerate(least):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (sig[alive, cut] == sig[a, cut]).sum(axis=1)
                alive, matches = alive[matches >= m], matches[matches >= m]
                if not len(alive):
                    break
            if len(alive):
                bands = (sig[alive] == sig[a]).reshape(-1, BANDS, ROWS).all(axis=2)
                alive = alive[bands.argmax(axis=1) == band]
            for b in alive:
                for r in (a, b):
                    if r not in sets:
                        sets[r] = shingle(cell[r][10].encode())
                if alike(sets[a], sets[b], percent):
                    out.append((int(cid[a]), int(cid[b])))
        return out

    def run(batches):
        shingle, cell = Shingler(width), []
        for b in slices(batches, 512):
            links = []
            for row in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True):
                if cell and cell[0][:3] != row[:3]:
                    links += compare(cell, shingle)
                    cell = []
                cell.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])
        links = compare(cell, shingle) if cell else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return cells.mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node reachable, for each node with a link. Alternating large and small stars; a
    round costs a few aggregates and joins over the links, and their number falls to one per node."""
    def state(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        first = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(first, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(small.union(first.select("u", F.col("m").alias("v"))).distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-6, tile_rows: int = 512) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs`` (needs doc_id and text).

    Texts without words (null, empty, blank) have no shingles and are alone. A text of fewer than ``width`` words is
    one shingle. Repeated rows are linked as copies; ``kept`` is ``doc_id = component_id``. Rows without doc_id are
    linked but never name a component; a component of such rows only has a null id and keeps them. Other columns are
    not read; an empty table gives an empty result.
    """
    base = durable(fingerprints(docs, width))
    classes = durable(base.where("n_shingles > 0").groupBy("set_key").agg(
        F.min("doc_id").alias("first_id"), F.max(F.struct("doc_id", "th")).alias("rep"), F.first("sig").alias("sig"))
        .withColumn("cid", F.monotonically_increasing_id()))
    shared = buckets(classes)
    multi = shared.groupBy("bucket").agg(F.min("cid").alias("first"), F.max("cid").alias("last")).where("first < last")
    members = durable(shared.join(multi.select("bucket", "first"), "bucket"))
    star = members.where("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b")).distinct()
    texts = texts_of(classes, members.select("cid").distinct(), docs)
    links = durable(confirmed(likely(star, classes, percent, miss), texts, width, percent))
    labels = components(links)
    inside = members.select("bucket", "band", "cid").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    more = durable(tile_links(tiles(durable(inside), tile_rows), classes, texts, width, percent, miss))
    if not more.isEmpty():
        labels = components(links.union(more))

    named = classes.select("set_key", "cid", "first_id").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    named = durable(named.select("set_key", "label", "first_id"))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "label").select("set_key", "component_id")
    lean = base.select("doc_id", "n_shingles", "set_key")
    linked = lean.where("n_shingles > 0").join(named, "set_key").select("doc_id", "n_shingles", "component_id")
    alone = lean.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
