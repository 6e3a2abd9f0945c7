"""Quality classifier by co-training: one view sees the text, the other the page's metadata.

Each view is a logistic regression over binned features, fitted on a bounded sample of labelled rows. In each round a
view gives the rows of an unlabelled pool that it is sure about to the other view as pseudo-labels. Afterwards each
view is calibrated on labelled rows that neither trained on, and a logistic combination of both scores all documents.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from momentlake.llm.common import durable, slices, text_bytes, whole_text

TEXT = ("words", "word_len", "distinct", "repeats", "top_share", "symbols", "shouts", "upper", "digits", "pipes", "line_words", "dup_lines", "stops")
METADATA = {"lang": "string", "source": "string", "n_chars": "bigint"}
SYMBOLS, UPPER, DIGITS = b"#*$%&|<>{}[]\\^~=_@+", bytes(range(65, 91)), b"0123456789"


def text_features(text: bytes) -> tuple[float, ...]:
    """Shape of a text; an empty one gives zeros."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    if not n:
        return (0.0,) * len(TEXT)
    lines = [x for x in text.split(b"\n") if x.strip()]

    def share(chars):
        return (len(text) - len(text.translate(None, chars))) / size

    counts = Counter(words)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return (float(n), (size - n) / n, len(counts) / n, repeats / n, max(counts.values()) / n, share(SYMBOLS), text.count(b"!") / n, share(UPPER), share(DIGITS),
            text.count(b"|") / n, n / len(lines), 1 - len(set(lines)) / len(lines), sum(w[-1:] in b".?!;:" for w in words) / n)


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, shape, lang, source, n_chars`` per row; ``shape`` has the text view's numbers."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # an absent metadata column counts as nulls
    meta = [(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in METADATA.items()]
    rows = docs.select("doc_id", *meta, whole_text().alias("text"))

    def run(batches):
        for b in slices(batches):
            shape = pa.array([text_features(t) for t in text_bytes(b)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "lang", "source", "n_chars")), shape], ["doc_id", "lang", "source", "n_chars", "shape"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang string, source string, n_chars bigint, shape array<float>")


@dataclass
class View:
    """Bins and weights of a logistic regression; ``bins`` has cut points, or the known values of a category."""

    bins: list
    weights: np.ndarray | None = None
    platt: tuple[float, float] = (1.0, 0.0)

    def cells(self, columns: list) -> np.ndarray:
        """For each row the weights' numbers that are on, one per feature."""
        out, base = [], 1
        for values, known in zip(columns, self.bins, strict=True):
            if isinstance(known, dict):
                out.append(base + np.array([known.get(v, 0) for v in values], np.int64))
                base += len(known) + 1
            else:
                out.append(base + np.searchsorted(known, np.asarray(values, np.float64), side="right"))
                base += len(known) + 1
        return np.stack(out, axis=1)

    def size(self) -> int:
        return 1 + sum(len(b) + 1 for b in self.bins)

    def fit(self, cells: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> None:
        x = np.zeros((len(y), self.size()), np.float64)
        x[np.arange(len(y))[:, None], cells] = 1
        x[:, 0] = 1
        w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(steps):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - y) + penalty * w
            hess = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def raw(self, cells: np.ndarray) -> np.ndarray:
        return self.weights[cells].sum(axis=1) + self.weights[0]

    def logit(self, cells: np.ndarray) -> np.ndarray:
        return self.platt[0] * self.raw(cells) + self.platt[1]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a small logistic regression with intercept (last), drawn to 1 for each column and 0 for the intercept."""
    x = np.column_stack([x, np.ones(len(y))])
    prior = np.append(np.ones(x.shape[1] - 1), 0.0)
    w, penalty = prior.copy(), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * (w - prior)
        hess = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    text: View | None = None
    meta: View | None = None
    weights: np.ndarray | None = None
    constant: float = 1.0
    exchanged: tuple[int, int] = (0, 0)

    def score(self, shape: np.ndarray, lang: list, source: list, n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of the combination, of the text view and of the metadata view."""
        n = len(lang)
        if self.text is None:
            return (np.full(n, self.constant),) * 3
        a = self.text.logit(self.text.cells(list(shape.T)))
        b = self.meta.logit(self.meta.cells([lang, source, numbers(n_chars)]))
        both = self.weights[0] * a + self.weights[1] * b + self.weights[2]
        return tuple(1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (both, a, b))


def numbers(values: list) -> np.ndarray:
    """Missing counts as -1, a bin of their own."""
    return np.array([-1 if v is None else v for v in values], np.float64)


def cut_points(values: np.ndarray, bins: int = 20) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def known_values(values: list, most: int = 200) -> dict:
    """Numbers for the most frequent values; the others share number 0."""
    return {v: i + 1 for i, (v, _) in enumerate(sorted(Counter(values).items(), key=lambda x: (-x[1], str(x[0])))[:most])}


def train(labelled: list, pool: list, rounds: int, sure: float, per_round: int) -> Model:
    """Co-training on rows (shape, lang, source, n_chars, good); a quarter of the labelled rows is kept for calibration."""
    good = np.array([r.good for r in labelled], float)
    model = Model(constant=float(good.mean()) if len(good) else 1.0)
    held = np.arange(len(good)) % 4 == 0
    if any(len(set(good[part])) < 2 for part in (held, ~held)):
        return model
    rows = [*labelled, *pool]
    shape = np.array([r["shape"] for r in rows], np.float64)
    meta_columns = [[r.lang for r in rows], [r.source for r in rows], numbers([r.n_chars for r in rows])]
    text = View([cut_points(shape[:, j]) for j in range(shape.shape[1])])
    meta = View([known_values(meta_columns[0]), known_values(meta_columns[1]), cut_points(meta_columns[2])])
    cells = [text.cells(list(shape.T)), meta.cells(meta_columns)]
    start = np.flatnonzero(~held)
    train_rows, train_y = [list(start), list(start)], [list(good[start]), list(good[start])]
    free = [np.arange(len(labelled), len(rows)) for _ in range(2)]  # what each view may still be given
    given = [0, 0]
    for _ in range(rounds):
        for v, view in enumerate((text, meta)):
            view.fit(cells[v][train_rows[v]], np.array(train_y[v]))
        for v, view in enumerate((text, meta)):
            other = 1 - v
            if not len(free[other]):
                continue
            p = 1 / (1 + np.exp(-np.clip(view.raw(cells[v][free[other]]), -30, 30)))
            # in the proportion of the labels, or the surer class would drown the other
            for side, share in ((p, model.constant), (1 - p, 1 - model.constant)):
                best = np.argsort(-side, kind="stable")[: max(1, int(per_round * share))]
                best = best[side[best] >= sure]
                train_rows[other] += list(free[other][best])
                train_y[other] += [float(side is p)] * len(best)
                given[other] += len(best)
            free[other] = np.setdiff1d(free[other], train_rows[other])
    for v, view in enumerate((text, meta)):
        view.fit(cells[v][train_rows[v]], np.array(train_y[v]))
        a = logistic(view.raw(cells[v][:len(good)][held])[:, None], good[held])
        view.platt = (float(a[0]), float(a[1]))
    both = np.column_stack([view.logit(cells[v][:len(good)][held]) for v, view in enumerate((text, meta))])
    # the prior is in both views: start from text alone plus what metadata adds to the prior
    prior = np.log(max(model.constant, 1e-6) / max(1 - model.constant, 1e-6))
    model.weights = logistic(both - np.array([0, prior]), good[held])
    model.weights[2] -= model.weights[1] * prior
    model.text, model.meta, model.exchanged = text, meta, tuple(given)
    return model


def learn(feats: DataFrame, labels: DataFrame, max_labelled: int = 20000, max_pool: int = 20000, rounds: int = 4, sure: float = 0.98, per_round: int = 2000) -> Model:
    """A model from a bounded sample (by hash of doc_id): ``max_labelled`` labelled and ``max_pool`` other rows go to the driver.
    A doc_id with several labels counts as good if one says so; null labels and ids are left out."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("good"))
    rows = feats.where("doc_id is not null").dropDuplicates(["doc_id"])
    pick = [F.xxhash64("doc_id"), F.col("doc_id")]
    labelled = rows.join(marks, "doc_id").orderBy(*pick).limit(max_labelled).collect()
    pool = rows.join(marks, "doc_id", "left_anti").orderBy(*pick).limit(max_pool).collect()
    return train(labelled, pool, rounds, sure, per_round)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **sample) -> DataFrame:
    """``doc_id, score, text_score, meta_score, kept`` per row of ``docs`` (needs doc_id and text; lang, source and n_chars
    where present).

    Null and empty texts have features of zeros; null metadata is a value of its own; repeated rows are scored each.
    Without labels of both classes every score is the labels' share of good rows (1 without labels). Other columns are
    not read; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    feats = durable(features(docs))
    model = learn(feats, labels, **sample)

    def run(batches):
        for b in slices(batches, 2048):
            shape = np.asarray(b.column("shape").flatten(), np.float64).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(TEXT)))
            out = model.score(shape, *(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.float64()) for x in out)], ["doc_id", "score", "text_score", "meta_score"])

    scored = feats.mapInArrow(run, f"doc_id {kind}, score double, text_score double, meta_score double")
    return scored.withColumn("kept", F.col("score") >= threshold)


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **sample) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns."""
    model = learn(durable(features(docs)), labels, **sample)
    meta = [(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in METADATA.items()]
    seen = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole_text().alias("text"), *meta)

    def run(batches):
        for b in slices(batches):
            shape = np.array([text_features(t) for t in text_bytes(b)]).reshape(b.num_rows, len(TEXT))
            score = model.score(shape, *(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")))[0]
            kept = b.filter(pa.array(score >= threshold)).column("row")
            yield pa.RecordBatch.from_arrays(kept.flatten(), [f.name for f in kept.type])

    return seen.mapInArrow(run, docs.schema)
