"""Toxicity by the nearest labelled examples: exact cosine of weighted TF-IDF vectors over an index of the examples.

The examples are a bounded sample of the labelled rows (``max_toxic`` and ``max_clean``, by hash of doc_id; equal texts
count once); the index is therefore bounded whatever the corpus, and goes to every task. Terms are words and the first
five characters of longer words. All terms of the examples span the vectors; those that the examples tie to toxic texts
weigh more. Their document frequencies are counted over all documents. Votes of the nearest examples, weighted by similarity, are calibrated by
monotone regression on votes that leave out the example itself.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import cached_property
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from momentlake.llm.common import durable, slices, whole_text

TOKEN = re.compile(r"\w+")
STEM = 5
BLOCK = 64
#: At most so many terms, each of over one in ``OFTEN`` examples, have a column of the dense matrix.
DENSE = 1024
OFTEN = 16
#: Texts searched at a time.
QUERIES = 128
#: Beyond the rounding of scores in single precision.
SLACK = 1e-5
#: A term's weight grows with its tie to toxic texts up to so many nats.
MOST_EVIDENCE = 60.0


def term_counts(text: str) -> Counter:
    """Words in lower case, and the stems of longer ones under a name of their own."""
    words = Counter(TOKEN.findall(text.lower()))
    stems: Counter = Counter()
    for w, n in words.items():
        if len(w) > STEM:
            stems[w[:STEM] + "*"] += n
    words.update(stems)
    return words


def numbered_counts(texts: list[str], number: dict[str, int]) -> tuple[pa.ListArray, pa.ListArray]:
    """What ``term_counts`` finds, of the terms that have a number: these in order, and how often. Each distinct word is
    looked up once for all texts."""
    found = [TOKEN.findall(t.lower()) for t in texts]
    sizes = [len(f) for f in found]
    place = defaultdict(count().__next__)
    at = np.fromiter(map(place.__getitem__, chain.from_iterable(found)), np.int64, sum(sizes))
    word = np.fromiter((number.get(w, -1) for w in place), np.int64, len(place))
    stem = np.fromiter((number.get(w[:STEM] + "*", -1) if len(w) > STEM else -1 for w in place), np.int64, len(place))
    row = np.repeat(np.arange(len(texts)) << 32, sizes)
    keys, n = np.unique(np.concatenate([(row + x[at])[x[at] >= 0] for x in (word, stem)]), return_counts=True)
    ends = pa.array(np.searchsorted(keys, np.arange(len(texts) + 1) << 32), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array((keys & 0xFFFFFFFF).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))


class BlockMaxIndex:
    """Unit vectors by term: terms of many vectors in a dense matrix, the others in inverted lists. The largest scores of
    blocks of vectors bound the search for the best ones, whose similarities are then summed in double precision."""

    def __init__(self, vectors: list[list[tuple[int, float]]], terms: int):
        self._keep(np.cumsum([0, *map(len, vectors)]), np.array([t for v in vectors for t, _ in v], np.int32), np.array([w for v in vectors for _, w in v], np.float64), terms)

    @classmethod
    def of_rows(cls, ends: np.ndarray, ids: np.ndarray, weights: np.ndarray, terms: int) -> BlockMaxIndex:
        """The vectors one after the other; ``ends`` begins with 0."""
        made = cls.__new__(cls)
        made._keep(ends, ids, weights, terms)
        return made

    def _keep(self, ends, ids, weights, terms):
        self.ends, self.ids, self.weights, self.terms, self.n = ends, ids, weights, terms, len(ends) - 1
        self.lists = None

    def _build(self):
        often = np.bincount(self.ids, minlength=self.terms)
        dense = np.argsort(-often, kind="stable")[:DENSE]
        dense = dense[often[dense] * OFTEN > self.n]
        place = np.full(self.terms, -1, np.int32)
        place[dense] = np.arange(len(dense))
        row, at = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.ends)), place[self.ids]
        matrix = np.zeros((-(-self.n // BLOCK) * BLOCK, len(dense)), np.float32)
        matrix[row[at >= 0], at[at >= 0]] = self.weights[at >= 0]
        rest = np.flatnonzero(at < 0)
        rest = rest[np.argsort(self.ids[rest], kind="stable")]
        starts = np.concatenate([[0], np.cumsum(np.where(place < 0, often, 0))])
        posts = np.empty((len(rest), 2), np.int32)
        posts[:, 0], posts[:, 1] = row[rest], self.weights[rest].astype(np.float32).view(np.int32)
        self.lists = place, matrix, starts, posts.view(np.int64).reshape(-1)  # number and weight side by side

    def search(self, ends: np.ndarray, ids: np.ndarray, weights: np.ndarray, k: int, skip: list | None = None) -> list[list[tuple[float, int]]]:
        """For each query (laid out as in ``of_rows``) what ``nearest`` gives."""
        if not self.n:
            return [[] for _ in ends[1:]]
        if self.lists is None:
            self._build()
        place, matrix, starts, posts = self.lists
        asked, col = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), place[ids]
        q = np.zeros((len(ends) - 1, matrix.shape[1]), np.float32)
        q[asked[col >= 0], col[col >= 0]] = weights[col >= 0]
        scores, out, full = q @ matrix.T, [], np.zeros(self.terms)
        for i, score in enumerate(scores):
            t, w = ids[ends[i]:ends[i + 1]], weights[ends[i]:ends[i + 1]]
            lo, hi = starts[t], starts[t + 1]  # equal for terms of the matrix
            lists = [posts[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if a < b]
            if lists:
                met = np.concatenate(lists).view(np.int32)
                score += np.bincount(met[::2], met[1::2].view(np.float32) * np.repeat(w, hi - lo), len(score))
            left_out = skip[i] if skip else ()
            need = k + len(left_out)
            blocks = score.reshape(-1, BLOCK).max(axis=1)
            floor = np.partition(blocks, -need)[-need] if len(blocks) >= need else 0.0
            found = np.flatnonzero((score >= floor - SLACK) & (score > 0))
            if len(found) > need:
                found = found[score[found] >= np.partition(score[found], -need)[-need] - SLACK]
            full[t] = w
            best = sorted((-s, e) for s, e in zip(self.similarities(full, found), found.tolist(), strict=True) if e not in left_out)
            full[t] = 0
            out.append([(-s, e) for s, e in best if s < 0][:k])
        return out

    def similarities(self, full: np.ndarray, found: np.ndarray) -> list[float]:
        """Of the vectors ``found`` (each has terms) to one that has its weights at its terms' places."""
        if not len(found):
            return []
        rows = [slice(a, b) for a, b in zip(self.ends[found].tolist(), self.ends[found + 1].tolist(), strict=True)]
        parts = full[np.concatenate([self.ids[x] for x in rows])] * np.concatenate([self.weights[x] for x in rows])
        return np.round(np.add.reduceat(parts, np.cumsum([0, *(x.stop - x.start for x in rows[:-1])])), 12).tolist()

    def nearest(self, query: list[tuple[int, float]], k: int, skip: frozenset[int] | set[int] = frozenset()) -> list[tuple[float, int]]:
        """The exact ``k`` most similar examples as (similarity, number), ties by number; only similarities over 0."""
        return self.search(np.array([0, len(query)]), np.array([t for t, _ in query], np.int32), np.array([w for _, w in query], np.float64), k, [skip])[0]


def evidence(toxic: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """How far the toxic share of terms (``toxic`` of ``n`` examples) is above ``share``: n times the Kullback-Leibler divergence, in nats."""
    p = toxic / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > share, n * (p * np.log(p / share) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - share)), 0)), 0.0)


class Model:
    """Index over all terms of the examples, and their labels; bounded by the examples."""

    def __init__(self, made: pa.Table, df: np.ndarray, n_docs: int, k: int, share: float):
        self.ids, self.labels, self.k, self.share = made["doc_id"].to_pylist(), made["toxic"].to_numpy().astype(float), k, share
        ends, ids, counts = rows_of(made["terms"].combine_chunks(), made["counts"].combine_chunks())
        order = np.lexsort((ids, np.repeat(np.arange(len(ends) - 1), np.diff(ends))))
        self.ends, self.terms, self.counts = ends, ids[order], counts[order]
        n, toxic = np.bincount(ids, minlength=len(df)), np.bincount(ids, np.repeat(self.labels, np.diff(ends)), len(df))
        self.factor = np.log((n_docs + 1) / (df + 1)) + 1
        if 0 < self.labels.sum() < len(self.labels):
            self.factor *= 1 + np.minimum(evidence(toxic, n, self.labels.mean()), MOST_EVIDENCE)

    @cached_property
    def index(self) -> BlockMaxIndex:
        """Made where it is searched; weighed some rows at a time."""
        weights = np.empty(len(self.terms))
        for at in range(0, len(self.labels), 1024):
            ends = self.ends[at:at + 1025]
            a, b = ends[0], ends[-1]
            weights[a:b] = self.weigh(ends - a, self.terms[a:b], self.counts[a:b])
        return BlockMaxIndex.of_rows(self.ends, self.terms, weights, len(self.factor))

    def __getstate__(self):
        # each executor keeps a copy on its disk: steps between the terms of a row and counts are small numbers
        return {k: v for k, v in self.__dict__.items() if k != "index"} | {"terms": packed(np.diff(self.terms, prepend=0)), "counts": packed(self.counts)}

    def __setstate__(self, state):
        n = int(state["ends"][-1])
        self.__dict__ |= state | {"terms": np.cumsum(unpacked(state["terms"], n), dtype=np.int32), "counts": unpacked(state["counts"], n)}

    def weigh(self, ends: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights of unit vectors."""
        w = (1 + np.log(counts)) * self.factor[ids]
        size = np.sqrt(np.bincount(np.repeat(np.arange(len(ends) - 1), np.diff(ends)), w * w, len(ends) - 1))
        return w / np.repeat(size, np.diff(ends))

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of toxic labels weighted by similarity, drawn to the prior where neighbours are few or far."""
        return (sum(s * self.labels[e] for s, e in near) + self.share) / (sum(s for s, _ in near) + 1)

    def left_out_votes(self, numbers: np.ndarray) -> list[float]:
        """Votes of the others on the examples ``numbers`` (in sequence)."""
        a, b = self.index.ends[numbers[0]], self.index.ends[numbers[-1] + 1]
        ends = self.index.ends[numbers[0]:numbers[-1] + 2] - a
        return [self.vote(x) for x in self.index.search(ends, self.index.ids[a:b], self.index.weights[a:b], self.k, [{int(e)} for e in numbers])]

    def calibrated(self, votes: list[float]) -> tuple[list[float], list[float]]:
        n_pos = self.labels.sum()
        if not votes:
            return [0.0], [self.share]
        # examples stand for as many rows as their class has
        weight = np.where(self.labels == 1, self.share / n_pos, (1 - self.share) / (len(self.labels) - n_pos))
        return monotone(votes, self.labels, weight)


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes, those of equal rank together."""
    return pa.compress(np.ascontiguousarray(x.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(x: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(x, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).T).view(np.int32).reshape(n)


class Numbers(dict):
    """Terms (none has a line break) and their numbers; sent compressed."""

    def __init__(self, terms: list[str]):
        super().__init__(zip(terms, range(len(terms)), strict=True))

    def __reduce__(self):
        text = "\n".join(self).encode()
        return Numbers.read, (pa.compress(text, codec="zstd", asbytes=True), len(text))

    @staticmethod
    def read(x: bytes, size: int) -> Numbers:
        return Numbers(pa.decompress(x, size, codec="zstd", asbytes=True).decode().split("\n") if size else [])


def rows_of(terms: pa.ListArray, counts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the rows, beginning with 0, and all their numbers."""
    sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), terms.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)


def monotone(x: list[float], y: np.ndarray, weight: np.ndarray) -> tuple[list[float], list[float]]:
    """Pool adjacent violators: rising steps (place, value)."""
    pools: list[list[float]] = []  # weight, mean of y, mean of x
    for i in np.argsort(x, kind="stable"):
        pools.append([weight[i], y[i], x[i]])
        while len(pools) > 1 and (pools[-2][1] >= pools[-1][1] or pools[-2][2] == pools[-1][2]):
            w, b, c = pools.pop()
            u, v, z = pools[-1]
            pools[-1] = [u + w, (u * v + w * b) / (u + w), (u * z + w * c) / (u + w)]
    return [p[2] for p in pools], [p[1] for p in pools]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def examples_of(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> tuple[DataFrame, float]:
    """``doc_id, toxic, text`` of the sampled labelled documents, and the share of toxic labels. Equal texts of a class
    are one example."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    sample = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((0, max_clean), (1, max_toxic))]
    # at most max_toxic + max_clean rows of two numbers: safe to send to every task
    found = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(sample[0].union(sample[1])), "doc_id")
    once = found.groupBy(F.sha2("text", 256).alias("same"), "toxic").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("x"))
    return durable(once.select("x.doc_id", "toxic", "x.text")), share


def terms_of(examples: DataFrame) -> list[str]:
    """All terms of the examples, the more frequent first: their numbers, and what is kept by number, lie close together."""
    def run(batches):
        n: Counter = Counter()
        for b in slices(batches):
            n.update(term_counts("\n".join(b.column("text").to_pylist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["t", "n"])

    found = examples.select("text").mapInArrow(run, "t string, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    return found.sort_by([("n", "descending"), ("t", "ascending")])["t"].to_pylist()


def score_documents(docs: DataFrame, labels: DataFrame, max_toxic: int = 4000, max_clean: int = 16000, k: int = 15, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence, similarity`` per row of ``docs`` (needs doc_id, an integer, and text).

    Null and empty texts, and texts without a term of any example, have no neighbours and the calibrated share of such
    examples as their score; repeated rows are scored each; a null doc_id is not held out. A doc_id with several labels counts
    as toxic if one says so; null labels and held-out rows are not learned from; with no usable labels the score is
    0. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    examples, share = examples_of(docs, labels, max_toxic, max_clean)
    terms = terms_of(examples)
    size, number = len(terms), spark.sparkContext.broadcast(Numbers(terms))

    def run(batches):
        for b in slices(batches):
            found = numbered_counts(b.column("text").to_pylist(), number.value)
            yield pa.RecordBatch.from_arrays([*(c.cast(pa.int64()) if n == "doc_id" else c for n, c in zip(b.schema.names, b.columns, strict=True) if n != "text"), *found],
                                             [*(n for n in b.schema.names if n != "text"), "terms", "counts"])

    def tally(batches):
        n = np.zeros(size, np.int64)
        for b in batches:
            n += np.bincount(b.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
        t = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(n[t], pa.int64())], ["t", "n"])

    vectors = durable(docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id bigint, terms array<int>, counts array<int>"))
    df, counted = np.zeros(size), vectors.select("terms").mapInArrow(tally, "t int, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    df[counted["t"].to_numpy()] = counted["n"].to_numpy()
    known = examples.mapInArrow(run, "doc_id bigint, toxic int, terms array<int>, counts array<int>").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    made = Model(known, df, vectors.count(), k, share)
    del known, counted, df, terms
    model = spark.sparkContext.broadcast(made)

    def left_out(batches):
        for b in slices(batches, QUERIES):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.value.left_out_votes(b.column("id").to_numpy()), pa.float64())], ["id", "vote"])

    both = 0 < made.labels.sum() < len(made.labels)
    votes = spark.range(0, len(made.labels), 1, -(-len(made.labels) // 512)).mapInArrow(left_out, "id bigint, vote double").collect() if both else []
    steps, values = made.calibrated([r.vote for r in sorted(votes)])

    def score(batches):
        for b in slices(batches, QUERIES):
            m = model.value
            ends, ids, counts = rows_of(b.column("terms"), b.column("counts"))
            near = m.index.search(ends, ids, m.weigh(ends, ids, counts), m.k)
            out = np.clip(np.interp([m.vote(x) for x in near], steps, values), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64()), pa.array([[m.ids[e] for _, e in x] for x in near], pa.list_(pa.int64())),
                                              pa.array([[s for s, _ in x] for x in near], pa.list_(pa.float64()))], ["doc_id", "score", "evidence", "similarity"])

    scored = vectors.mapInArrow(score, "doc_id bigint, score double, evidence array<bigint>, similarity array<double>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "similarity")
