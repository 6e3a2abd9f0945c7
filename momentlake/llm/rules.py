"""Quality rules: an ordered list of threshold conjunctions learned from labelled statistics by sequential covering.

Statistics are DataFrame expressions over whole texts. A rule grows by the literal with the best information gain,
counted in one Spark aggregate per step over binned features, is pruned on rows held back from growing, and its rows
are then taken away. The list becomes one ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from momentlake.llm.common import BLANK, durable, whole_text

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
FEATURES = ("word_len", "symbol_rate", "upper_rate", "shout_rate", "digit_rate", "distinct_rate", "repeat_rate", "dup_line_rate", "words_per_line", "n_words")


def free_prefix(docs: DataFrame, prefix: str = "q_") -> str:
    """A prefix that no column of ``docs`` has."""
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def with_stats(docs: DataFrame, q: str) -> DataFrame:
    """Adds the base counts and the features of ``text`` as columns named with prefix ``q``. Other columns are kept."""
    t, w, h, g, s, p = (f"{q}_{x}" for x in "twhgsp")
    blanks = " \t\n\x0b\x0c\r"
    df = docs.withColumn(t, whole_text())
    cut = F.btrim(F.col(t), F.lit(blanks))
    df = df.withColumn(w, F.when(F.length(cut) > 0, F.split(cut, f"[{BLANK}]+")).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    # hashes of the windows of five words, by the position of their first word
    df = df.withColumn(g, F.transform(
        F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)])))
    twice = F.size(F.array_distinct(g)) < F.size(g)
    df = df.withColumn(s, F.when(twice, F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    last = F.size(s) - 1

    def hash_at(i):
        return F.get(s, i)["x"]

    # get() outside the array is null, and null equals nothing
    again = F.filter(F.sequence(F.lit(0), last), lambda i: F.coalesce(hash_at(i) == hash_at(i - 1), F.lit(False)) | F.coalesce(hash_at(i) == hash_at(i + 1), F.lit(False)))
    df = df.withColumn(p, F.when(F.size(s) > 0, F.sort_array(F.transform(again, lambda i: F.get(s, i)["i"]))))
    covered = F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(WINDOW), lambda acc, i: acc + F.least(F.lit(WINDOW), F.get(p, i) - F.get(p, i - 1)))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{BLANK}]"))
    n, chars = F.size(w), F.length(F.array_join(w, ""))

    def count(pattern):
        return F.length(t) - F.length(F.regexp_replace(t, pattern, ""))

    base = {"n_words": n, "word_chars": chars, "n_symbols": count(SYMBOLS), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": F.when(F.size(p) > 1, covered).otherwise(0), "n_lines": F.size(lines), "n_distinct": F.size(F.array_distinct(h)),
            "n_upper": count("\\p{Lu}"), "n_shout": count("!"), "n_digits": count("[0-9]")}
    # plain columns, not a struct: Catalyst would copy a struct's expensive fields into each of their uses
    # The row number keeps filters above this step: below it they would hold copies of all these expressions.
    df = df.withColumns({q + k: v.cast("bigint") for k, v in base.items()} | {q + "row": F.monotonically_increasing_id()}).drop(t, w, h, g, s, p)
    c = lambda k: F.col(q + k)
    words, chars, lines = (F.greatest(c(k), F.lit(1)) for k in ("n_words", "word_chars", "n_lines"))
    return df.withColumns({
        f"{q}word_len": c("word_chars") / words, f"{q}symbol_rate": c("n_symbols") / chars, f"{q}upper_rate": c("n_upper") / chars,
        f"{q}shout_rate": c("n_shout") / words, f"{q}digit_rate": c("n_digits") / chars, f"{q}distinct_rate": c("n_distinct") / words,
        f"{q}repeat_rate": c("n_repeat_words") / words, f"{q}dup_line_rate": c("n_dup_lines") / lines, f"{q}words_per_line": c("n_words") / lines,
        f"{q}base_failed": (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))})


def stats_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics, without prefix, as a durable table."""
    df = with_stats(docs.select("doc_id", "text"), "q_")
    return durable(df.select("doc_id", *[F.col(x).alias(x[2:]) for x in df.columns if x.startswith("q_") and x != "q_row"]))


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self, prefix: str = "") -> Column:
        x = F.col(prefix + self.feature)
        return x >= self.threshold if self.above else x < self.threshold

    def __str__(self):
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


@dataclass
class DecisionList:
    """Rules in order; a row is decided by the first one that holds. Rows that no rule holds for are kept."""

    rules: list[list[Literal]] = field(default_factory=list)

    def number(self, prefix: str = "") -> Column:
        """Number of the first rule that holds, or null."""
        out = None
        for k, rule in enumerate(self.rules):
            cond = F.coalesce(reduce(lambda a, b: a & b, [x.column(prefix) for x in rule]), F.lit(False))
            out = F.when(cond, F.lit(k + 1)) if out is None else out.when(cond, F.lit(k + 1))
        return F.lit(None).cast("int") if out is None else out

    def keeps(self, prefix: str = "") -> Column:
        return self.number(prefix).isNull()

    def __str__(self):
        return "\n".join(f"{k + 1}. reject if " + " and ".join(map(str, r)) for k, r in enumerate(self.rules)) or "keep all"


def learn(rows: DataFrame, features: tuple[str, ...] = FEATURES, max_rules: int = 8, max_literals: int = 4, bins: int = 24,
          min_precision: float = 0.97, min_rows: int = 4) -> DecisionList:
    """Rules for rejection from ``rows`` (``doc_id``, ``bad`` boolean and the features), all of them.

    Thresholds are approximate quantiles of the good and of the bad rows. A third of the rows (by hash of doc_id) is
    held back for pruning. Rows with a null ``bad`` are left out; no rows, or one class, give an empty list.
    """
    # both classes set thresholds, else a small class would get none of its own
    quantiles = [k / bins for k in range(1, bins)]
    cells = {}
    for r in rows.where("bad is not null").groupBy("bad").agg(*[F.percentile_approx(f, quantiles, 2000).alias(f) for f in features], F.count("*").alias("n")).collect():
        cells[r.bad] = r
    found = DecisionList()
    if set(cells) != {True, False}:
        return found
    cuts = {f: sorted({v for r in cells.values() for v in (r[f] or []) if v is not None}) for f in features}
    binned = rows.where("bad is not null").select(
        "bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"),
        *[_bin(F.col(f), cuts[f]).alias(f) for f in features])
    binned = durable(binned)
    total_bad = cells[True].n

    def matches(rule):
        return reduce(lambda a, b: a & b, [F.col(f) >= k if above else F.col(f) < k for f, above, k in rule], F.lit(True))

    left, taken = binned, []
    while len(found.rules) < max_rules:
        rule: list[tuple[str, bool, int]] = []
        grow = left.where("not held")
        while len(rule) < max_literals:
            step = grow.where(matches(rule)).select("bad", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in features])).alias("x"))
            counts = step.groupBy("x.f", "x.b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            best = _best_literal(counts, cuts)
            if best is None:
                break
            rule.append(best[1])
            if best[0] >= 0.999:
                break
        if not rule:
            break
        prefixes = [matches(rule[:k]) for k in range(1, len(rule) + 1)]
        held = left.where("held").agg(*[F.count_if(m & F.col("bad")).alias(f"p{k}") for k, m in enumerate(prefixes)],
                                      *[F.count_if(m & ~F.col("bad")).alias(f"n{k}") for k, m in enumerate(prefixes)]).first()
        # a shorter rule wins ties: the last literals must pay on rows they were not chosen on
        value, size = max(((held[f"p{k}"] - held[f"n{k}"]) / max(1, held[f"p{k}"] + held[f"n{k}"]), -k) for k in range(len(rule)))
        k = -size
        p, n = held[f"p{k}"], held[f"n{k}"]
        if p + n < min(min_rows, 1 + total_bad // 50) or p < min_precision * (p + n):
            break
        rule = rule[:k + 1]
        found.rules.append([Literal(f, above, float(cuts[f][b - 1])) for f, above, b in rule])
        taken.append(matches(rule))
        left = binned.where(~reduce(lambda a, b: a | b, taken))
    return found


def _bin(x: Column, cuts: list[float]) -> Column:
    """How many cuts lie at or under ``x``."""
    return F.size(F.filter(F.lit([float(v) for v in cuts]).cast("array<double>"), lambda v: v <= x))


def _best_literal(counts, cuts):
    """(precision, literal) with the best gain p * (log2 precision after - log2 precision before), or None."""
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r.f, {})[r.b] = (r.p, r.n)
    if not by:
        return None
    p0, n0 = (sum(x[i] for x in next(iter(by.values())).values()) for i in (0, 1))
    if not p0 or not n0:
        return None
    best = None
    for f in sorted(by):
        below = [0, 0]
        for b in range(1, len(cuts[f]) + 1):
            p, n = by[f].get(b - 1, (0, 0))
            below = [below[0] + p, below[1] + n]
            for above, (q, m) in ((True, (p0 - below[0], n0 - below[1])), (False, tuple(below))):
                if q:
                    gain = q * (log2(q / (q + m)) - log2(p0 / (p0 + n0)))
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, q / (q + m), (f, above, b))
    return best and best[1:]


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows to learn from: statistics (flat) of documents with a quality label that the base rules leave. A doc_id with
    several labels counts as good if one says so; null labels and null ids are left out."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") == 0).alias("bad"))
    return stats.where("not base_failed").join(marks, "doc_id")


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, the features, ``base_failed``, ``rule`` (number or null) and ``kept`` per row of ``docs``.

    Null, empty and blank texts have counts 0 and fail the base rules; repeated rows are judged each; other columns
    are not read; without usable labels only the base rules reject.
    """
    stats = stats_of(docs)
    rules = learn(labelled(stats, labels))
    return stats.withColumn("rule", F.when(~F.col("base_failed"), rules.number())).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that base rules and learned rules keep, with all their columns."""
    q = free_prefix(docs)
    known = labels.where("quality is not null").select("doc_id").distinct()
    found = learn(labelled(stats_of(docs.join(known, "doc_id", "left_semi")), labels))
    return with_stats(docs, q).where(~F.col(f"{q}base_failed") & found.keeps(q) & (F.col(q + "row") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])
