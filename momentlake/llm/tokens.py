"""Exact token ids and counts of whole texts, long ones by overlapping chunks.

Texts of up to one chunk: the tokenizer drops white space before it looks for pieces, so a run of ASCII white space is a
boundary that no token and no normalisation crosses (``splits_at_blanks`` proves it from the tokenizer's file).
Each distinct word is then encoded once per worker by the library and remembered.

Texts over one chunk are cut into overlapping chunks that are dealt out to tasks and encoded by the library with offsets.
Neighbours are spliced where their encodings agree on a boundary and on everything between two stable
boundaries; where they do not, the overlap is widened and the text is cut again, in the end to one chunk.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from momentlake.llm.common import durable, slices, text_bytes, whole_text

HUGE_BYTES = 1 << 14
CHUNK_CHARS = 1 << 14
OVERLAP_CHARS = 1 << 9
CLOSING = (b".", b",", b";", b":", b"!", b"?")
BLANKS = " \t\n\r\x0b\x0c"
WORDS = re.compile(f"[^{BLANKS}]+")
ALPHABET_STEPS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def splits_at_blanks(path: str) -> bool:
    """Whether texts may be encoded word by word: no added token holds or strips a blank, each normalising step acts
    within words, and the first splitting pattern removes everything that it does not match and matches no blank."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"]):
        return False
    if spec.get("truncation") or spec.get("padding"):
        return False
    norm = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    for step in norm.get("normalizers", [norm]):
        replaces_blanks = step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " "
        if step["type"] not in ALPHABET_STEPS and not replaces_blanks:
            return False
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    return _matches_no_blank(first["pattern"].get("Regex", ""))


def _matches_no_blank(pattern: str) -> bool:
    """Each alternative is a plain string, or one class of letters, digits or of anything but blanks."""
    classes = {"[\\p{L}]", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]"}
    return bool(pattern) and all(
        a.rstrip("+") in classes or (a.replace("'", "").isalpha() and a.isascii()) for a in pattern.split("|"))


class WordMemo:
    """Ids of words as little-endian 32-bit bytes, from the library, remembered up to ``limit_bytes`` of words and ids.

    Unknown words go to the library together, with a special token between them: the library splits at it before
    anything else, so each word is encoded as if alone. Where the tokenizer lowers letters anyway, A-Z are lowered
    first (not beside combining marks or special tokens), and a closing mark after a letter is a piece of its own.
    """

    def __init__(self, path: str, limit_bytes: int = 160_000_000):
        self.path, self.limit, self.held, self.ids = path, limit_bytes, 0, {}
        self.tokenizer, self.by_word = load(path), splits_at_blanks(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = spec.get("normalizer") or {}
        self.lowers = any(x["type"] == "Lowercase" for x in norm.get("normalizers", [norm]) if x)
        self.special = next(((t["content"], t["id"]) for t in spec["added_tokens"] if t["special"]), None)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [array("I", e.ids).tobytes() for e in found]
        split = [self.lower(t).split() for t in texts]
        self.learn(set(chain.from_iterable(split)))
        get = self.ids.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def lower(self, text: bytes) -> bytes:
        """A-Z as a-z. U+0300 to U+036F, the marks that compose with letters, are written with bytes CC and CD."""
        return text.lower() if self.lowers and b"\xcc" not in text and b"\xcd" not in text and b"<" not in text else text

    def learn(self, every: set[bytes]) -> None:
        if self.held > self.limit:
            self.ids, self.held = {}, 0
        new = [w for w in every if w not in self.ids]
        closed = {w: w[:-1] for w in new if w[-1:] in CLOSING and w[:-1].isalnum() and w.isascii()}
        bare = {b for b in closed.values() if b not in self.ids} | {w[-1:] for w in closed if w[-1:] not in self.ids}
        self.ask(list({w for w in new if w not in closed} | bare))
        for w, base in closed.items():
            self.put(w, self.ids[base] + self.ids[w[-1:]])

    def put(self, word: bytes, ids: bytes) -> None:
        self.ids[word] = ids
        self.held += 130 + len(word) + len(ids)

    def ask(self, words: list[bytes]) -> None:
        alone = words if self.special is None else [w for w in words if b"<" in w]
        for at in range(0, len(alone), 4096):
            part = alone[at:at + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            for w, e in zip(part, found, strict=True):
                self.put(w, array("I", e.ids).tobytes())
        if self.special is None:
            return
        between, number = self.special
        rest = [w for w in words if b"<" not in w]
        groups = [rest[at:at + 512] for at in range(0, len(rest), 512)]
        found = self.tokenizer.encode_batch_fast([between.join(w.decode("utf-8", "replace") for w in g) for g in groups], add_special_tokens=False)
        for g, e in zip(groups, found, strict=True):
            ids = np.array(e.ids, "<u4")
            raw, ends = ids.tobytes(), [4 * int(x) for x in np.flatnonzero(ids == number)]
            for w, lo, hi in zip(g, [0, *(x + 4 for x in ends)], [*ends, len(raw)], strict=True):
                self.put(w, raw[lo:hi])


@lru_cache(maxsize=2)
def memo_of(path: str) -> WordMemo:
    """One memo per Python worker: it outlives a task where Spark reuses its workers."""
    return WordMemo(path)


def count_tokens(docs: DataFrame, path: str, max_tokens: int = 2048, huge_bytes: int = HUGE_BYTES,
                 chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, n_chunks`` per row of ``docs`` (needs doc_id and text).

    Null and empty texts have 0 tokens; repeated rows are counted each; a null doc_id stays null; other columns
    are not read; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def small(batches):
        memo = memo_of(path)
        for b in slices(batches):
            texts = text_bytes(b)
            n = [len(x) // 4 for x in memo.encode(texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", whole_text().alias("text"))
    short = rows.where(F.octet_length("text") <= huge_bytes).mapInArrow(small, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    long = rows.where(F.octet_length("text") > huge_bytes).select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("key"), "text")
    counts = count_by_chunks(long.select("key", "text"), path, chunk_chars, overlap_chars)
    long = long.select("doc_id", "n_bytes", "key").join(counts, "key").select("doc_id", "n_bytes", "n_tokens", "n_chunks")
    return (short.withColumn("n_chunks", F.lit(1)).unionByName(long)
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"), "n_chunks"))


def count_by_chunks(texts: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``key, n_tokens, n_chunks`` per distinct ``key`` of ``texts`` (key names the text).

    A round cuts the texts, encodes the chunks and splices neighbours. Texts with a failed splice go to the next
    round with four times the chunk and the overlap; one that fits into a chunk cannot fail, so the rounds end.
    """
    spark, done = texts.sparkSession, None
    pending = durable(texts.dropDuplicates(["key"]))
    while not pending.isEmpty():
        chunks = pending.mapInArrow(_cutter(chunk_chars, overlap_chars), "key string, i int, n int, start bigint, text string")
        tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        # dealt out by (key, i): the chunks of one text go to many tasks
        coded = durable(chunks.repartition(tasks, "key", "i").mapInArrow(
            _encoder(path, overlap_chars), "key string, i int, n int, tokens bigint, head array<bigint>, tail array<bigint>"))
        left = coded.where("i < n - 1").select("key", "i", "tail")
        right = coded.where("i > 0").select("key", (F.col("i") - 1).alias("i"), "head")
        cuts = left.join(right, ["key", "i"]).mapInPandas(_splice, "key string, drop bigint, failed int")
        parts = coded.select("key", "tokens", F.lit(0).alias("failed"), F.lit(1).alias("chunk")).unionByName(
            cuts.select("key", (-F.col("drop")).alias("tokens"), "failed", F.lit(0).alias("chunk")))
        sums = durable(parts.groupBy("key").agg(F.sum("tokens").alias("n_tokens"), F.sum("failed").alias("failed"), F.sum("chunk").cast("int").alias("n_chunks")))
        good = sums.where("failed = 0").select("key", "n_tokens", "n_chunks")
        done = good if done is None else done.unionByName(good)
        pending = pending.join(sums.where("failed > 0").select("key"), "key", "left_semi")
        chunk_chars, overlap_chars = 4 * chunk_chars, 4 * overlap_chars
    return done if done is not None else spark.createDataFrame([], "key string, n_tokens bigint, n_chunks int")


def _cutter(chunk: int, overlap: int):
    def cut(batches):
        for b in slices(batches, 8):
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                n = max(1, -(-len(text) // chunk))
                for i in range(n):
                    start = max(0, i * chunk - overlap)
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([i], pa.int32()), pa.array([n], pa.int32()), pa.array([start], pa.int64()),
                                                      pa.array([text[start:(i + 1) * chunk + overlap]])], ["key", "i", "n", "start", "text"])
    return cut


def _encoder(path: str, overlap: int):
    """A chunk's tokens, and for each overlap flat triples (boundary, tokens beyond it to the chunk's end or before it,
    hash of the tokens from it to the last stable boundary both chunks can see)."""
    def encode(batches):
        memo, width = memo_of(path), 2 * overlap
        for b in slices(batches, 16):
            out = []
            rows = list(zip(*(b.column(c).to_pylist() for c in ("key", "i", "n", "start", "text")), strict=True))
            # where blanks part tokens, words begin at stable boundaries and are known from the memo
            whole = memo.encode([r[4].encode() for r in rows]) if memo.by_word else [None] * len(rows)
            for (key, i, n, start, text), known in zip(rows, whole, strict=True):
                if memo.by_word:
                    size = len(known) // 4
                    head = _word_boundaries(memo, text, start, 0, width, before=True) if i else []
                    tail = _word_boundaries(memo, text, start, max(0, len(text) - width), len(text), before=False) if i < n - 1 else []
                else:
                    e = memo.tokenizer.encode(text, add_special_tokens=False)
                    at, ids, size = [o[0] for o in e.offsets], e.ids, len(e.ids)
                    head = _boundaries(text, at, ids, start, 0, width, before=True) if i else []
                    tail = _boundaries(text, at, ids, start, len(text) - width, len(text), before=False) if i < n - 1 else []
                out.append((key, i, n, size, head, tail))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key", "i", "n", "tokens", "head", "tail"])
    return encode


def _word_boundaries(memo: WordMemo, text: str, start: int, lo: int, hi: int, before: bool) -> list[int]:
    """As ``_boundaries`` for a tokenizer whose tokens cross no blank: a word begins at a stable boundary. The hash of the
    words up to the last boundary is carried backwards from it."""
    found = []
    for m in WORDS.finditer(text, lo):
        if m.start() >= hi:
            break
        found.append((m.start(), m.group().encode()))
    if not found:
        return []
    ids = memo.encode([w for _, w in found])
    sums = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).tolist()
    inside = [k for k, (p, _) in enumerate(found) if lo < p]
    triples: list[tuple[int, int, int]] = []
    seen = 0
    for k in reversed(inside):
        p = start + found[k][0]
        if k < inside[-1]:
            seen = (seen * 6364136223846793005 + zlib.crc32(ids[k]) * 1442695040888963407 + p) & 0x7FFFFFFFFFFFFFFF
        triples.append((p, sums[k] if before else sums[-1] - sums[k], seen))
    return list(chain.from_iterable(reversed(triples)))


def _boundaries(text: str, at: list[int], ids: list[int], start: int, lo: int, hi: int, before: bool) -> list[int]:
    """Stable boundaries in text[lo:hi]: a token begins there right after a blank. A hash covers the ids and places
    up to the last one, so two equal hashes are two equal encodings of what lies between."""
    lo = max(0, lo)
    inside = [k for k, p in enumerate(at) if lo < p < hi and text[p - 1] in BLANKS and (k == 0 or at[k - 1] < p)]
    out: list[int] = []
    if inside:
        last = inside[-1]
        for k in inside:
            seen = hash(tuple((ids[j], start + at[j]) for j in range(k, last)))
            out += [start + at[k], k if before else len(ids) - k, seen]
    return out


def _splice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per pair of neighbours the tokens counted twice or wrongly; failed where no boundary agrees."""
    for pdf in batches:
        drop, failed = [], []
        for tail, head in zip(pdf["tail"], pdf["head"], strict=True):
            after = {int(p): (int(n), int(h)) for p, n, h in zip(tail[0::3], tail[1::3], tail[2::3], strict=True)}
            # the first common boundary that is not the last one: at least one stretch of tokens has been seen twice
            found = next(((after[int(p)][0], int(n)) for p, n, h in zip(head[0::3], head[1::3], head[2::3], strict=True)
                          if int(p) in after and after[int(p)][1] == int(h) and int(p) < max(after)), None)
            drop.append(sum(found) if found else 0)
            failed.append(0 if found else 1)
        yield pd.DataFrame({"key": pdf["key"], "drop": drop, "failed": failed}).astype({"drop": "int64", "failed": "int32"})
