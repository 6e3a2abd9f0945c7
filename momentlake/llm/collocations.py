"""Collocations of two to five words, exactly counted per language by a multikey quicksort of suffix pointers.

1. Words are counted per language. A phrase cannot be frequent if one of its words is not, so suffixes end at such
   words. Tasks recognise frequent words by a bit table of fixed size; a false hit costs time, never a wrong count.
2. Every word position is a suffix of up to five words. A task merges equal suffixes of its block of texts, sorts
   them and deals them out by their leading words: the bounds between tasks are quantiles of a sample of suffixes, so a
   hot word or word pair is spread over as many tasks as its rows need.
3. Within a task a three-way quicksort partitions the pointers by one word at a time. A partition equal to its pivot
   is one phrase, its size the count, and goes on with the next word; partitions below the threshold are abandoned,
   unless they touch the task's bounds, where the neighbour holds the rest. Counts from both sides of a bound are added.
4. Cuts, scores and containment are joins over the frequent phrases.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from momentlake.llm.common import durable, slices, text_bytes

MAX_WORDS = 5
BLOCK_WORDS = 1 << 19
TASK_SUFFIXES = 1 << 21
MAX_TASKS = 1 << 17  # bounds the broadcast; over 2.7e11 words a task gets more suffixes than TASK_SUFFIXES
TABLE_BITS = 1 << 25
COUNTED_WORDS = 1 << 20
CODED_WORDS = 1 << 17
SAMPLE_RATE = 1 << 10
SAMPLE_PER_TASK = 64
BREAK = b"\xff"  # no byte of UTF-8
MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", BREAK * 10 + b" ")


def piece_words(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lowered, with a break between pieces and at the end."""
    return (text.lower().translate(MARKS) + BREAK).replace(BREAK, b" \xff ").split()


def _blocks(batches, limit: int):
    """Blocks of texts with about ``limit`` words: languages and words of each text. A longer text is a block of its own."""
    langs, texts, held = [], [], 0
    for b in batches:
        for part in slices([b]):
            for lang, text in zip(part.column("lang").to_pylist(), text_bytes(part), strict=True):
                words = piece_words(text)
                if held and held + len(words) > limit:
                    yield langs, texts
                    langs, texts, held = [], [], 0
                langs.append(lang)
                texts.append(words)
                held += len(words)
    if langs:
        yield langs, texts


def _slot(lang: str, word: bytes) -> int:
    return zlib.crc32(word, zlib.crc32(lang.encode() + b" ")) % TABLE_BITS


def _suffixes(numbers: np.ndarray, breaks: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of the suffixes of a block, one column a suffix, 0 beyond its end, and where each begins; only those
    of two words or more."""
    n = len(numbers)
    numbers = np.concatenate((np.where(breaks, 0, numbers), np.zeros(depth, numbers.dtype)))
    cols = [numbers[:n]]
    for j in range(1, depth):
        cols.append(np.where(cols[-1] > 0, numbers[j:n + j], 0))
    rows = np.flatnonzero(cols[min(1, depth - 1)])
    return np.stack([c[rows] for c in cols]), rows


def _merge_equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the distinct columns of ``keys`` (most significant row first) and how often each occurs."""
    packed, room = [], 0
    for row in keys:  # as many rows as fit go into one sort key
        bits = max(1, int(row.max()).bit_length()) if len(row) else 1
        if not packed or room + bits > 62:
            packed.append(row.copy())
            room = bits
        else:
            packed[-1] = packed[-1] << bits | row
            room += bits
    order = np.lexsort(packed[::-1])
    new = np.zeros(len(order), bool)
    for p in packed:
        s = p[order]
        new[1:] |= s[1:] != s[:-1]
    if len(new):
        new[0] = True
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def count_words(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per language and word its count, and a sample of suffixes ``lang, word_1..``: one position in ``SAMPLE_RATE``."""
    def table(out):
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["lang", "word", "n", "sample"])

    def counted(found):
        return table([(lang, w.decode("utf-8", "replace"), n, False) for lang, c in found.items() for w, n in c.items() if w != BREAK])

    def run(batches):
        found: dict[str, Counter] = {}
        for langs, texts in _blocks(batches, BLOCK_WORDS):
            out = []
            for lang, words in zip(langs, texts, strict=True):
                found.setdefault(lang, Counter()).update(words)
                seed = zlib.crc32(b" ".join(words[:64]))
                for i in range(seed % SAMPLE_RATE, len(words), SAMPLE_RATE):
                    stop = next((j for j in range(i, min(i + MAX_WORDS, len(words))) if words[j] == BREAK), min(i + MAX_WORDS, len(words)))
                    if stop - i > 1:
                        out.append((lang, b" ".join(words[i:stop]).decode("utf-8", "replace"), (seed + i * 2654435761) % (1 << 32), True))
            yield table(out)
            if sum(map(len, found.values())) > COUNTED_WORDS:  # partial counts leave the task's memory
                yield counted(found)
                found = {}
        yield counted(found)

    rows = durable(docs.mapInArrow(run, "lang string, word string, n bigint, sample boolean"))
    return durable(rows.where("not sample").groupBy("lang", "word").agg(F.sum("n").alias("n"))), rows.where("sample")


def _bit_table(words: DataFrame) -> bytes:
    """Bits of the given words, packed: a table of ``TABLE_BITS`` bits at any size of the corpus."""
    def run(batches):
        bits = np.zeros(TABLE_BITS, bool)
        for b in batches:
            for lang, word in zip(b.column("lang").to_pylist(), b.column("word").to_pylist(), strict=True):
                bits[_slot(lang, word.encode())] = True
        packed = np.packbits(bits).reshape(-1, 4096)
        full = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([packed[i].tobytes() for i in full], pa.binary())], ["page", "bits"])

    def either(table: pa.Table) -> pa.Table:
        whole = np.zeros(4096, np.uint8)
        for raw in table["bits"].to_pylist():
            whole |= np.frombuffer(raw, np.uint8)
        return pa.table({"page": table["page"][:1], "bits": pa.array([whole.tobytes()], pa.binary())})

    pages = words.coalesce(256).mapInArrow(run, "page bigint, bits binary").groupBy("page").applyInArrow(either, "page bigint, bits binary")
    out = np.zeros((TABLE_BITS // 8 // 4096, 4096), np.uint8)
    for r in pages.toLocalIterator():
        out[r.page] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def _bounds(sample: DataFrame, tasks: int) -> list[tuple]:
    """First suffixes of the tasks but the first one, as (lang, word, ...), from about 64 sampled suffixes a task."""
    size = sample.count()
    share = min(1.0, tasks * SAMPLE_PER_TASK / max(1, size))
    rows = sample.where(F.col("n") < int(share * (1 << 32))).select("lang", "word").collect()
    keys = sorted((r.lang.encode(), *r.word.encode().split(b" ")) for r in rows)
    return sorted({keys[len(keys) * i // tasks] for i in range(1, tasks)}) if keys else []


def frequent_phrases(docs: DataFrame, min_count: int, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, k, f`` of all phrases of 1 to ``max_words`` words that occur ``min_count`` times, and ``lang, n``.

    ``docs`` has lang and text, both not null.
    """
    spark = docs.sparkSession
    words, sample = count_words(docs)
    often = words.where(F.col("n") >= min_count)
    total = durable(words.groupBy("lang").agg(F.sum("n").alias("n")))
    positions = total.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-positions // TASK_SUFFIXES), MAX_TASKS))
    bounds, coded = _bounds(sample, tasks), _code_words(often)
    # 4 MB of bits, at most MAX_TASKS suffixes and CODED_WORDS words
    shared = spark.sparkContext.broadcast((_bit_table(often), bounds, coded))

    def route(batches):
        table, cuts, book = shared.value
        bits = np.unpackbits(np.frombuffer(table, np.uint8)).astype(bool)
        code = {w: i + 1 for i, w in enumerate(book)}
        for langs, texts in _blocks(batches, BLOCK_WORDS):
            yield from _route_block(langs, texts, bits, cuts, code, max_words)

    def count(batches):
        return _count_task(batches, shared.value[2], min_count, max_words)

    routed = docs.mapInArrow(route, "task int, lang string, size int, spelled string, rows binary").repartitionById(tasks, "task")
    counted = routed.mapInArrow(count, "lang string, phrase string, k int, f bigint")
    longer = counted.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    single = often.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), F.col("n").alias("f"))
    return durable(longer.unionByName(single)), total


def _code_words(often: DataFrame) -> list[bytes]:
    """At most ``CODED_WORDS`` of the most frequent words, in byte order. They travel as numbers, all others spelled out."""
    best = often.groupBy("word").agg(F.max("n").alias("n")).withColumn("level", F.floor(F.log2("n") * 8))
    sizes, least, held = best.groupBy("level").agg(F.count("*").alias("c")).orderBy(F.desc("level")).collect(), None, 0
    for r in sizes:
        held += r.c
        if held > CODED_WORDS:
            break
        least = r.level
    return sorted(r.word.encode() for r in best.where(F.col("level") >= least).select("word").collect()) if least is not None else []


def _pack(cells: np.ndarray) -> bytes:
    """Rows of numbers, column by column and byte by byte: most bytes repeat, so the codec finds little to keep."""
    planes = np.ascontiguousarray(cells.T.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, size: int, width: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * size * width, codec="zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(width, size).T.astype(np.int64)


def _route_block(langs, texts, bits, cuts, code, depth):
    """The block's distinct suffixes in order with their counts, one packed row for each language and task."""
    flat = [w for t in texts for w in t]
    if not flat:
        return
    vocabulary = sorted(set(flat))
    number = {w: i + 1 for i, w in enumerate(vocabulary)}
    numbers = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    names = sorted(set(langs))
    place = {x: i for i, x in enumerate(names)}
    which = np.repeat([place[x] for x in langs], [len(t) for t in texts])
    keyed = which * (len(vocabulary) + 1) + numbers
    pairs = np.unique(keyed)
    rare = np.array([not bits[_slot(names[p // (len(vocabulary) + 1)], vocabulary[p % (len(vocabulary) + 1) - 1])] for p in pairs.tolist()])
    breaks = rare[np.searchsorted(pairs, keyed)] | (numbers == number.get(BREAK, 0))
    cols, rows = _suffixes(numbers, breaks, depth)
    if not cols.shape[1]:
        return
    keys = np.concatenate((which[rows][None, :], cols))
    first, n = _merge_equal(keys)
    keys = keys[:, first]
    coded = [x.encode() for x in names]

    def key(i):
        return (coded[keys[0, i]], *(vocabulary[x - 1] for x in keys[1:, i] if x))

    at = [bisect_left(range(keys.shape[1]), c, key=key) for c in cuts]
    task = np.repeat(np.arange(len(cuts) + 1), np.diff([0, *at, keys.shape[1]]))
    global_code = np.array([0, *(code.get(w, -i - 1) for i, w in enumerate(vocabulary))], np.int64)
    starts = np.flatnonzero(np.r_[True, (task[1:] != task[:-1]) | (keys[0, 1:] != keys[0, :-1])])
    out = []
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(task)], strict=True):
        cells = global_code[keys[1:, lo:hi].T]
        extra = np.unique(cells[cells < 0])[::-1]  # words without a code: numbered behind the codes, in this row's order
        cells = np.where(cells < 0, len(code) + 1 + np.searchsorted(-extra, -cells), cells)
        spelled = b" ".join(vocabulary[-x - 1] for x in extra.tolist()).decode("utf-8", "replace")
        out.append((int(task[lo]), names[keys[0, lo]], hi - lo, spelled, _pack(np.concatenate((cells, n[lo:hi, None]), 1))))
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["task", "lang", "size", "spelled", "rows"])


def _count_task(batches, book: list[bytes], min_count: int, depth: int):
    """Phrases of a task's suffixes with their counts: the frequent ones and those that touch the task's bounds."""
    spelled: dict[bytes, int] = {}
    names: dict[str, int] = {}
    parts, weights = [], []
    for b in batches:
        for lang, size, extra, raw in zip(*(b.column(c).to_pylist() for c in ("lang", "size", "spelled", "rows")), strict=True):
            cells = _unpack(raw, size, depth + 1)
            weights.append(cells[:, -1])
            cells = cells[:, :-1].astype(np.int32)
            if extra:
                own = np.array([spelled.setdefault(w, len(book) + 1 + len(spelled)) for w in extra.encode().split(b" ")], np.int32)
                cells = np.where(cells > len(book), own[np.maximum(cells - len(book) - 1, 0)], cells)
            tongue = names.setdefault(lang, len(names))
            parts.append(np.concatenate((np.full((size, 1), tongue, np.int32), cells), 1))
    if not parts:
        return
    keys, weight = np.concatenate(parts), np.concatenate(weights)
    del parts, weights
    # numbers in byte order, so that the least and the greatest suffix are those at the task's bounds
    words = [b"", *book, *spelled]
    used = np.unique(keys[:, 1:])
    order = used[sorted(range(len(used)), key=lambda i: words[used[i]])]  # the empty word, 0, stays first
    rank = np.zeros(len(words), np.int32)
    rank[order] = np.arange(len(order)) + (0 if used[0] == 0 else 1)
    by_rank = {int(rank[x]): words[x] for x in order.tolist()}
    tongues = sorted(names, key=str.encode)
    turn = np.zeros(len(names), np.int32)
    turn[[names[x] for x in tongues]] = np.arange(1, len(names) + 1)
    for j in range(1, depth + 1):
        keys[:, j] = rank[keys[:, j]]
    keys[:, 0] = turn[keys[:, 0]]
    out = []
    for level, row, count in multikey_quicksort(keys, weight, min_count):
        if level >= 2:
            head = keys[row, :level + 1].tolist()
            out.append((tongues[head[0] - 1], b" ".join(by_rank[x] for x in head[1:]).decode("utf-8", "replace"), level, int(count)))
    cols = list(zip(*out, strict=True)) if out else [[]] * 4
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["lang", "phrase", "k", "f"])


def multikey_quicksort(keys: np.ndarray, weight: np.ndarray, min_count: int):
    """Partitions equal in their first columns, as (column, one of their rows, weight), over the rows of ``keys`` (0: no more words).

    All open partitions are split at once: each takes the word of its middle pointer as pivot and falls into smaller,
    equal and greater rows. An equal partition is reported and goes on with its next column; one lighter than
    ``min_count`` is abandoned, unless it holds the least or the greatest row at a bound of the task.
    """
    n, depth = keys.shape
    edges = [int(np.lexsort(keys.T[::-1])[i]) for i in (0, -1)] if n else []
    rows = np.arange(n)
    begins, column = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(rows):
        sizes = np.diff(np.append(begins, len(rows)))
        part = np.repeat(np.arange(len(begins)), sizes)
        value = keys[rows, column[part]]
        pivot = value[begins + sizes // 2]
        side = np.sign(value - pivot[part]) + 1
        slot = part * 3 + side
        order = np.argsort(slot, kind="stable")
        rows, slot, value = rows[order], slot[order], value[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        ends = np.append(first[1:], len(rows))
        part, side = slot[first] // 3, slot[first] % 3
        mass = np.add.reduceat(weight[rows], first)
        at_edge = np.zeros(len(first), bool)
        for e in edges:
            where = np.flatnonzero(rows == e)
            if len(where):
                at_edge[np.searchsorted(first, where[0], side="right") - 1] = True
        equal = side == 1
        alive = ((mass >= min_count) | at_edge) & ~(equal & (value[first] == 0))
        for i in np.flatnonzero(alive & equal):
            yield int(column[part[i]]), int(rows[first[i]]), int(mass[i])
        next_column = column[part] + equal
        alive &= next_column < depth
        keep = np.repeat(alive, ends - first)
        rows = rows[keep]
        column = next_column[alive]
        begins = np.concatenate(([0], np.cumsum((ends - first)[alive])))[:-1]


def collocations(docs: DataFrame, min_count: int = 100, top: int = 2000, max_words: int = MAX_WORDS, inside_percent: int = 100) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best phrases per language of ``docs`` (needs lang and text).

    Null texts count as empty, a null lang as ``und``; repeated rows count each; other columns are not read; an empty
    table gives an empty result. Ties go by count, then phrase, in byte order.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts, total = frequent_phrases(rows, min_count, max_words)
    ranked = score_phrases(counts, total, inside_percent)
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def score_phrases(counts: DataFrame, total: DataFrame, inside_percent: int) -> DataFrame:
    """Lowest-scoring cut of every phrase of two words or more that no longer one stands for."""
    cand = counts.where("k >= 2").select("lang", "phrase", F.split("phrase", " ").alias("w"), "k", F.col("f").alias("a"))
    cuts = cand.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("head"), F.expr("array_join(slice(w, cut + 1, k - cut), ' ')").alias("rest"))
    parts = counts.select("lang", F.col("phrase").alias("part"), "f")
    cuts = cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(total, "lang")
    # decimals of 38 digits: counts have up to 16 digits, so 1000 * a * n and l * r stay exact
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    cuts = cuts.withColumn("score", score.cast("bigint"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("m")).select("lang", "phrase", "m.a", "m.l", "m.r", "m.n", "m.score")
    inner = cand.where("k >= 3").select("lang", "w", "k", "a", F.explode(F.expr("sequence(2, k - 1)")).alias("size"))
    inner = inner.select("lang", "w", "a", "size", F.explode(F.expr("sequence(1, k - size + 1)")).alias("at"))
    inner = inner.select("lang", F.expr("array_join(slice(w, at, size), ' ')").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(inner, ["lang", "phrase"], "left")
    return kept.where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a"))).drop("longer")
