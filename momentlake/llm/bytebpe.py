"""Byte-level BPE: exact token ids by backtracking over longest matches, and texts from ids by an offset table.

Merging pairs by rank gives exactly those token sequences in which every two neighbours are *compatible*: the merges
of the joined bytes would not cross the border between them. So a word is encoded left to right. An Aho-Corasick
automaton over the reversed tokens finds the longest token that begins at each place; the encoder takes it where it is
compatible with the token before, else the next shorter one, else it steps back one token and marks the place as a
dead end. Each place is closed at most once, so the time is linear in the word.

The library's pre-tokenizer decides what a word is. A boundary lies before every blank that a visible character
follows, so texts are cut there and each distinct piece is encoded once per worker.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from momentlake.llm.common import slices, whole_text

PIECE = re.compile(r"(?= \S)")
LOOSE_BLANK = re.compile(r" (?:\s|\Z)")
# Fixed value: the splitting pattern of byte-level BPE. Used for ASCII only, where no Unicode version matters.
ASCII_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
MEMO_CHARS = 128
CLOSING = frozenset(".,;:!?")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of one tokenizer file. Raises ValueError for files that are no plain byte-level BPE."""

    def __init__(self, path: str, limit_bytes: int = 160_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._require_plain(spec)
        letters, model = byte_letters(), spec["model"]
        tokens = {t: i for t, i in model["vocab"].items()}
        size = 1 + max([*tokens.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes = [b""] * size
        for text, i in tokens.items():
            self.bytes[i] = bytes(letters[c] for c in text)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.specials.items():
            self.bytes[i] = text.encode()
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.starts = np.concatenate(([0], np.cumsum([len(b) for b in self.bytes]))).astype(np.int64)  # the offset table
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._read_merges(model["merges"], tokens)
        self._build_matches(tokens.values())
        from tokenizers import Tokenizer
        self.words = Tokenizer.from_file(path).pre_tokenizer
        self.after, self.alone, self.held, self.limit = {}, {}, 0, limit_bytes

    @staticmethod
    def _require_plain(spec: dict) -> None:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec.get("normalizer") or spec.get("truncation") or spec.get("padding"):
            raise ValueError("no plain byte-level BPE")
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("words are not split at byte level")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take blanks along")

    def _read_merges(self, merges: list, tokens: dict[str, int]) -> None:
        """Rank and parts of each merged token; each is made by one merge, from parts made earlier."""
        self.rank: dict[tuple[int, int], int] = {}
        born = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = tokens[left], tokens[right], tokens[left + right]
            if made in self.parts or len(self.bytes[made]) < 2 or any(len(self.bytes[x]) > 1 and x not in born for x in (a, b)):
                raise ValueError("merges that are not ordered")
            self.rank[a, b], self.parts[made], born[made] = r, (a, b), r
        self.born = born
        self.fits: dict[tuple[int, int], bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens on one edge of a token with the rank at which each is merged away, from the token itself down."""
        out, gone = [], 1 << 60
        while True:
            out.append((token, gone))
            if token not in self.parts:
                return out
            gone = self.born[token]
            token = self.parts[token][side]

    def _crossed(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether a merge of rank under ``before`` joins something across the border of a and b: both parts must stand
        at its rank. Of equal merges the left one comes first."""
        right = self._spine(b, 0)
        for x, x_gone in self._spine(a, 1):
            for y, y_gone in right:
                r = self.rank.get((x, y))
                if r is not None and r < x_gone and r <= y_gone and r < before:
                    return True
        return False

    def compatible(self, a: int, b: int) -> bool:
        """Entry (a, b) of the pair-compatibility table, filled as pairs occur."""
        ok = self.fits.get((a, b))
        if ok is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            ok = self.fits[a, b] = not self._crossed(a, b)
        return ok

    def _build_matches(self, ids) -> None:
        import ahocorasick
        single = {self.bytes[i]: i for i in ids if len(self.bytes[i]) == 1}
        if len(single) < 256:
            raise ValueError("bytes without a token")
        self.single = single
        good = set(single.values())
        for t, (a, b) in self.parts.items():  # in order of rank: a token counts if its own bytes merge into it
            if a in good and b in good and not self._crossed(a, b, self.born[t]):
                good.add(t)
        by_bytes = {self.bytes[t]: t for t in good}
        self.whole, self.shorter = by_bytes, {}
        self.longest = ahocorasick.Automaton()
        for raw, t in by_bytes.items():
            self.longest.add_word(raw[::-1].decode("latin-1"), t)
            self.shorter[t] = next((by_bytes[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in by_bytes), -1)
        self.longest.make_automaton()

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word of the pre-tokenizer."""
        whole = self.whole.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        at = [-1] * n
        for end, token in self.longest.iter(word[::-1].decode("latin-1")):  # the longest match of an end comes first
            if at[n - 1 - end] < 0:
                at[n - 1 - end] = token
        out: list[int] = []
        dead = bytearray(n + 1)
        pos, token, sizes, shorter, compatible = 0, at[0] if n else -1, self.bytes, self.shorter, self.compatible
        while pos < n:
            end = pos + len(sizes[token])
            if not dead[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                pos = end
                token = at[pos] if pos < n else -1
                continue
            token = shorter[token]
            if token < 0:
                dead[pos] = 1
                token = out.pop()
                pos -= len(sizes[token])
        return out

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece as little-endian 32-bit numbers."""
        if piece.isascii():
            found = ASCII_WORD.findall(piece)
        else:
            found = [piece[lo:hi] for _, (lo, hi) in self.words.pre_tokenize_str(piece)]
        return b"".join([self.alone.get(w) or self._word(w) for w in found])

    def _word(self, word: str) -> bytes:
        ids = array("I", self.encode_word(word.encode())).tobytes()
        if len(word) <= MEMO_CHARS:
            self._hold(self.alone, word, ids)
        return ids

    def _hold(self, memo: dict, key: str, ids: bytes) -> None:
        if self.held > self.limit:
            self.after.clear()
            self.alone.clear()
            self.held = 0
        memo[key] = ids
        self.held += 180 + 2 * len(key) + len(ids)

    def _plain(self, text: str) -> bytes:
        if LOOSE_BLANK.search(text):
            return b"".join(map(self._piece_of, PIECE.split(text)))
        first, *rest = text.split(" ")  # every blank begins a piece; the memo's keys leave it out
        get, out = self.after.get, [self._piece_of(first)]
        for p in rest:
            ids = get(p)
            out.append(self._spaced(p) if ids is None else ids)
        return b"".join(out)

    def _spaced(self, p: str) -> bytes:
        """Ids of a blank and the visible piece ``p``; letters alone are a word, a closing mark after them another."""
        if p.isascii() and p.isalpha():
            ids = array("I", self.encode_word(b" " + p.encode())).tobytes()
        elif p[-1:] in CLOSING and p.isascii() and p[:-1].isalpha():
            ids = (self.after.get(p[:-1]) or self._spaced(p[:-1])) + (self.alone.get(p[-1]) or self._word(p[-1]))
        else:
            ids = self._piece(" " + p)
        if len(p) <= MEMO_CHARS:
            self._hold(self.after, p, ids)
        return ids

    def _piece_of(self, piece: str) -> bytes:
        if piece[:1] == " " and piece != " ":
            ids = self.after.get(piece[1:])
            return self._spaced(piece[1:]) if ids is None else ids
        return self._piece(piece)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers; strings of special tokens become those tokens."""
        if self.special is None or not any(s in text for s in self.specials):
            return self._plain(text)
        return b"".join(array("I", [self.specials[x]]).tobytes() if i % 2 else self._plain(x) for i, x in enumerate(self.special.split(text)))

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of the ids, gathered from the offset table, and where each id's bytes end."""
        first = self.starts[ids]
        ends = np.cumsum(self.starts[ids + 1] - first)
        if not len(ids):
            return b"", ends
        sizes = np.diff(ends, prepend=0)
        take = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.blob[take].tobytes(), ends


@lru_cache(maxsize=2)
def bpe_of(path: str) -> ByteBpe:
    """One per Python worker."""
    return ByteBpe(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with a column ``ids`` (array of int); a clashing column of that name is replaced.

    Null texts count as empty and give an empty array; repeated rows are encoded each; other columns pass through.
    """
    kept = [c for c in docs.columns if c != "ids"]

    def run(batches):
        bpe = bpe_of(path)
        for b in slices(batches):
            raw = [bpe.encode(t or "") for t in b.column(text).to_pylist()]
            ends = np.cumsum([0] + [len(r) // 4 for r in raw]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), ids], [*kept, "ids"])

    return docs.select(*kept).mapInArrow(run, T.StructType([*docs.select(*kept).schema, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_documents(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with a column ``text`` made from the ids (null ids: null); broken UTF-8 becomes U+FFFD."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches):
        bpe = bpe_of(path)
        for b in slices(batches):
            lists = b.column(ids)
            texts = _texts(bpe, [np.asarray(x.values, np.int64) if x.is_valid else np.zeros(0, np.int64) for x in lists])
            out = pa.array([t.decode("utf-8", "replace") if x.is_valid else None for t, x in zip(texts, lists, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), out], [*kept, "text"])

    return rows.mapInArrow(run, T.StructType([*rows.select(*kept).schema, T.StructField("text", T.StringType())]))


def _texts(bpe: ByteBpe, lists: list[np.ndarray]) -> list[bytes]:
    """Bytes of several id lists by one gather."""
    raw, ends = bpe.decode(np.concatenate(lists) if lists else np.zeros(0, np.int64))
    at = np.concatenate(([0], ends))[np.cumsum([0] + [len(x) for x in lists])].tolist()
    return [raw[lo:hi] for lo, hi in zip(at, at[1:])]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row of ``docs`` (needs doc_id and text): encoded, decoded again.

    Null and empty texts have no tokens; repeated rows come out each; a null doc_id stays null; other columns are not
    read; an empty table gives an empty result. Texts of any length are encoded whole, in time linear in their length.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = bpe_of(path)
        for b in slices(batches):
            raw = [bpe.encode(t) for t in b.column("text").to_pylist()]
            texts = _texts(bpe, [np.frombuffer(r, "<u4").astype(np.int64) for r in raw])
            whole = [t.decode("utf-8", "replace").encode() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
                 pa.array([hashlib.sha256(t).hexdigest() for t in whole])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
