"""Periodic runs of words by online dyadic square catching.

Words are appended block by block. When a block of 2^k words is complete, a *catcher* is set up for it; while the next
2^(k+1) words arrive it compares the suffix of 2^k words that ends at each of them with its block. A hit at a distance d
from 2^k to 2^(k+1)-1 may be the middle of a square of period d; its common stretch is followed to both sides by
doubling steps over the names of dyadic stretches, and if it is long enough the square is reported. Squares of one
stretch merge into one run. Each run of period d and length 3d or more holds a whole block of level floor(log2 d) and
the block's copy, so none is missed. Hits inside a known run whose period divides the distance are no news.

The catchers of one level, over all texts of a batch, advance together: the names of the suffixes that end in a block
are one row of a matrix, so each row is compared with the block before it. A level costs one pass over the words.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from momentlake.llm.common import text_bytes

MIN_WORDS, MIN_TURNS = 24, 3
BATCH_WORDS = 1 << 19
STEP_LEVELS = 10
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29))


def _pair_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit names of joined stretches. They only steer the search: reported runs are compared word by word."""
    x = a * ODD[0] ^ (b + (b << np.uint64(17)) + ODD[1]) * ODD[1]
    x ^= x >> ODD[2]
    x *= ODD[0]
    return x ^ (x >> np.uint64(32))


class Catchers:
    """Catchers over one sequence of numbered words: ``names[k][i]`` names the 2^k words from i on. Levels over
    ``STEP_LEVELS`` keep their names only until the next one, so memory is about 100 bytes a word."""

    def __init__(self, words: np.ndarray, min_words: int, min_turns: int):
        self.words, self.min_words, self.min_turns = words, min_words, min_turns
        self.current = words.astype(np.uint64) + np.uint64(1)
        self.names = [self.current]
        none = np.zeros(0, np.int64)
        self.start, self.end, self.period = none, none, none

    def advance(self, level: int, upto: int) -> None:
        """Let the catchers of a level see the words before ``upto``; levels come in rising order."""
        size = 1 << level
        if level:
            self.current = _pair_names(self.current[:-(size >> 1)], self.current[size >> 1:])
            if level < STEP_LEVELS:
                self.names.append(self.current)
        name = self.current[:max(0, upto - size + 1)]
        blocks = len(name) // size
        if blocks < 2:
            return
        rows = name[:blocks * size].reshape(blocks, size)
        if level < 3:  # short rows: one comparison per distance is quicker than one per block
            hits = [np.flatnonzero(rows[:-1, 0] == rows[1:, d]) * size * size + d for d in range(size)]
            flat = np.concatenate(hits)
        else:
            flat = np.flatnonzero((rows[1:] == rows[:-1, :1]).ravel())
        block = flat // size if level >= 3 else flat // (size * size)
        at = block * size
        far = size + (flat % size if level >= 3 else flat % (size * size))
        tail = name[blocks * size:]  # copies in the block that is not complete yet
        if len(tail):
            more = np.flatnonzero(tail == rows[-1, 0])
            at = np.concatenate((at, np.full(len(more), (blocks - 1) * size)))
            far = np.concatenate((far, size + more))
        self._report(at, far, size)

    def _report(self, at: np.ndarray, far: np.ndarray, size: int) -> None:
        """Squares of the hits, merged into runs."""
        if len(self.start) and len(at):
            known = self._covering(at, at + far + size)
            news = (known < 0) | (far % self.period[known] != 0)
            at, far = at[news], far[news]
        if not len(at):
            return
        # of hits in neighbouring blocks at one distance the first stands for all: they share a stretch
        order = np.lexsort((at, far))
        at, far = at[order], far[order]
        first = np.r_[True, (far[1:] != far[:-1]) | (at[1:] - at[:-1] != size)]
        at, far = at[first], far[first]
        lo, hi = self._left(at, far), self._right(at, far)
        good = (hi - lo >= (self.min_turns - 1) * far) & (hi - lo + far >= self.min_words)
        runs = np.unique(np.stack((lo[good], hi[good] + far[good], far[good]), 1), axis=0)
        w = self.words
        for s, e, q in runs:
            if not np.array_equal(w[s:e - q], w[s + q:e]) or (s and w[s - 1] == w[s - 1 + q]) or (e < len(w) and w[e] == w[e - q]):
                raise ArithmeticError("two stretches share a name")
        if len(runs):
            order = np.argsort(np.concatenate((self.start, runs[:, 0])), kind="stable")
            self.start, self.end, self.period = (np.concatenate(x)[order] for x in (
                (self.start, runs[:, 0]), (self.end, runs[:, 1]), (self.period, runs[:, 2])))

    def _covering(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Index of the run around each stretch, or -1. Of the runs that begin before it the one that reaches farthest
        is the only candidate, because two runs share less than the sum of their periods."""
        reach = np.maximum.accumulate(self.end)
        best = np.maximum.accumulate(np.where(self.end == reach, np.arange(len(reach)), 0))
        k = np.searchsorted(self.start, lo, side="right") - 1
        found = best[np.maximum(k, 0)]
        return np.where((k >= 0) & (self.end[found] >= hi), found, -1)

    def _right(self, at: np.ndarray, far: np.ndarray) -> np.ndarray:
        """First place from ``at`` on that differs from its copy ``far`` words on."""
        pos, n = at.copy(), len(self.words)
        for level in range(len(self.names) - 1, -1, -1):
            step, name = 1 << level, self.names[level]
            live = np.arange(len(pos))
            while len(live):
                p = pos[live]
                ok = p + far[live] + step <= n
                live, p = live[ok], p[ok]
                live = live[name[p] == name[p + far[live]]]
                pos[live] += step
                if level < len(self.names) - 1:
                    break  # under the top level a second step would have been a step above
        return pos

    def _left(self, at: np.ndarray, far: np.ndarray) -> np.ndarray:
        """First place of the common stretch that holds ``at``."""
        pos = at.copy()
        for level in range(len(self.names) - 1, -1, -1):
            step, name = 1 << level, self.names[level]
            live = np.arange(len(pos))
            while len(live):
                p = pos[live] - step
                ok = p >= 0
                live, p = live[ok], p[ok]
                live = live[name[p] == name[p + far[live]]]
                pos[live] -= step
                if level < len(self.names) - 1:
                    break
        return pos


def find_runs(texts: list[np.ndarray], min_words: int = MIN_WORDS, min_turns: int = MIN_TURNS) -> list[list[tuple[int, int, int]]]:
    """Per sequence of word numbers (0 or more) its runs ``(start, length, period)``, sorted. ``min_turns`` is at least 3.

    The sequences are laid behind each other, the longest first, with a mark of its own after each, so that a level
    ends where the sequences get too short for it.
    """
    if min_turns < 3:
        raise ValueError("runs of under three turns need not hold a block and its copy")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = [i for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])) if len(texts[i]) >= max(min_words, min_turns)]
    if not order:
        return out
    top = max(int(texts[i].max()) for i in order) + 1
    parts, begins, at = [], [], 0
    for k, i in enumerate(order):
        parts += [texts[i], [top + k]]
        begins.append(at)
        at += len(texts[i]) + 1
    words = np.concatenate(parts).astype(np.int64)
    begins, sizes = np.array(begins), np.array([len(texts[i]) for i in order])
    catchers, level = Catchers(words, min_words, min_turns), 0
    while True:
        fit = int(np.searchsorted(-sizes, -(min_turns << level), side="right"))  # sequences with room for this level
        if not fit:
            break
        catchers.advance(level, int(begins[fit - 1] + sizes[fit - 1] + 1))
        level += 1
    owner = np.searchsorted(begins, catchers.start, side="right") - 1
    found = zip(owner.tolist(), (catchers.start - begins[owner]).tolist(), (catchers.end - catchers.start).tolist(), catchers.period.tolist())
    for k, start, length, period in found:
        out[order[k]].append((start, length, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def planted(words: list, doc_id) -> list:
    """The words with the period that the contract plants in one document of ten; a null doc_id plants none."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turn = words[a:a + p]
    return words[:a] + (turn * (-(-(n - a) // p)))[:n - a]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without the repeats of the runs: each run keeps its first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def _batches(batches, limit: int):
    """Arrow slices of about ``limit`` bytes of text; a longer text comes alone."""
    for b in batches:
        ends = np.cumsum(b.column("size").to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield b.slice(at, upto - at)
            at = upto


def periodic_runs(docs: DataFrame, plant: bool = False, min_words: int = MIN_WORDS, min_turns: int = MIN_TURNS,
                  batch_words: int = BATCH_WORDS) -> DataFrame:
    """``doc_id, n_words, runs (array of start, length, period), collapsed`` per row of ``docs`` (needs doc_id and text).

    ``plant`` plants the contract's periods first. Null, empty and blank texts have no words and no runs; repeated rows
    come out each; other columns are not read; an empty table gives an empty result. A batch holds about
    ``batch_words`` words; a longer text is a batch of its own.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for b in _batches(batches, 6 * batch_words):
            texts = [t.split() for t in text_bytes(b)]
            if plant:
                texts = [planted(w, i) for w, i in zip(texts, b.column("doc_id").to_pylist(), strict=True)]
            number: dict[bytes, int] = {}
            ids = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in texts]
            found = find_runs(ids, min_words, min_turns)
            listed = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(w) for w in texts], pa.int64()), pa.array(listed, pa.list_(item)),
                 pa.array([collapse(w, r).decode("utf-8", "replace") for w, r in zip(texts, found, strict=True)], pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.selectExpr("doc_id", "coalesce(text, '') AS text", "octet_length(coalesce(text, '')) AS size")
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the run of greatest exponent and the digests of all runs and of the collapsed text."""
    kind = found.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def run(batches):
        for b in batches:
            cols = []
            for runs, text in zip(b.column("runs").to_pylist(), text_bytes(b, "collapsed"), strict=True):
                best = max(runs, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None)
                lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
                top = (best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4
                cols.append((len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([c[i] for c in cols], t) for i, t in enumerate(kinds))], names)

    return found.mapInArrow(run, f"doc_id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")
