"""SentencePiece models on the tokenizers library: the protobuf is parsed here, the pipeline rebuilt, parity verified.

No piece holds the space marker after another character (checked), so a normalised text falls apart before each
run of markers and its segments can be encoded alone. Each distinct segment is encoded once per worker in
multithreaded batches and compared with the sentencepiece library, so parity is known for every row.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from momentlake.llm.common import slices, whole_text

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the format
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def fields(data: bytes):
    """(number, value) of a protobuf message: ints for varints, bytes for the others."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or varint()
        yield tag >> 3, data[at:at + size]
        at += size


class Model:
    """What a ``.model`` file says: pieces (text, score, type), kind (1 unigram, 2 BPE) and the normaliser's switches."""

    def __init__(self, path: str):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.charsmap = 1, False, b""
        self.dummy_prefix = self.remove_extra = self.escape = True
        self.suffix = False
        with open(path, "rb") as f:
            data = f.read()
        for number, value in fields(data):
            if number == 1:
                part = dict(fields(value))
                score = struct.unpack("<f", part[2])[0] if 2 in part else 0.0
                self.pieces.append((part[1].decode(), score, part.get(3, NORMAL)))
            elif number == 2:
                part = dict(fields(value))
                self.kind, self.byte_fallback, self.suffix = part.get(3, 1), bool(part.get(35, 0)), bool(part.get(24, 0))
            elif number == 3:
                part = dict(fields(value))
                self.charsmap = part.get(2, b"")
                self.dummy_prefix, self.remove_extra, self.escape = (bool(part.get(k, 1)) for k in (3, 4, 5))
        if self.kind not in (1, 2) or self.suffix:
            raise ValueError("unigram and BPE models with leading space markers are supported")
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def crosses_words(self) -> bool:
        return any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))

    def merges(self) -> list[tuple[str, str]]:
        """Pairs that make a piece, best score first."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        found = [(-score, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for p, score, kind in self.pieces if kind == NORMAL
                 for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        return [(a, b) for *_, a, b in sorted(found)]

    def tokenizer(self):
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers
        if self.kind == 1:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        else:
            core = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(),
                              unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        tok = Tokenizer(core)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_extra:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        tok.normalizer = normalizers.Sequence(steps)
        if not self.crosses_words():
            tok.pre_tokenizer = pre_tokenizers.Split(Regex(SEGMENT.pattern), "isolated")
        tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        tok.add_tokens([AddedToken(p, normalized=False) for p, _, kind in self.pieces if kind == USER])
        return tok

    def piece_bytes(self) -> list[bytes]:
        """Bytes that each id stands for; control pieces stand for nothing."""
        def one(p, kind):
            if kind == BYTE:
                return bytes([int(p[3:5], 16)])
            return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode()
        return [one(p, kind) for p, _, kind in self.pieces]


class Encoder:
    """Batches of texts to ids, distinct segments through the library; ``odd`` holds segments without parity."""

    def __init__(self, path: str, threads: int, limit_bytes: int = 96_000_000):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        import sentencepiece
        self.model = Model(path)
        self.whole = self.model.tokenizer()
        self.plain = not (self.model.charsmap or self.model.remove_extra or self.model.crosses_words()) and self.model.escape
        self.parts = self.model.tokenizer()
        self.parts.normalizer = self.parts.pre_tokenizer = None  # segments are whole already
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.threads, self.limit, self.held = threads, limit_bytes, 0
        self.ids: dict[str, bytes] = {}
        self.odd: set[str] = set()

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        if self.plain:
            return SEGMENT.findall((MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK))
        normal = self.whole.normalizer.normalize_str(text)
        return SEGMENT.findall(normal) if not self.model.crosses_words() else [normal]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        split = [self.segments(t) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        get, odd = self.ids.__getitem__, self.odd
        ids = [b"".join(map(get, s)) for s in split]
        if self.plain:
            return ids, [not odd or odd.isdisjoint(s) for s in split]
        # a normaliser may work across segments: the whole texts are compared
        wanted = self.reference.encode(texts, num_threads=self.threads)
        return ids, [np.array(w, "<u4").tobytes() == i for w, i in zip(wanted, ids, strict=True)]

    def learn(self, every: set[str]) -> None:
        new = [s for s in every if s not in self.ids]
        if self.held > self.limit:
            self.ids, self.odd, self.held, new = {}, set(), 0, list(every)
        for at in range(0, len(new), 4096):
            part = new[at:at + 4096]
            found = [e.ids for e in self.parts.encode_batch_fast(part, add_special_tokens=False)]
            # one array for all ids of the part, cut where the segments end
            sizes = [*map(len, found)]
            raw, ends = np.fromiter(chain.from_iterable(found), "<u4", sum(sizes)).tobytes(), [*accumulate(sizes, initial=0)]
            self.ids.update((s, raw[4 * a:4 * z]) for s, a, z in zip(part, ends, ends[1:], strict=False))
            self.held += 150 * len(part) + 2 * sum(map(len, part)) + 4 * ends[-1]
            # the reference puts a marker before a text, so it gets the segment without its first one
            led = [k for k, s in enumerate(part) if s[0] == MARK] if self.model.dummy_prefix else []
            wanted = self.reference.encode_as_ids([part[k][1:].replace(MARK, " ") for k in led], num_threads=self.threads)
            self.odd.update(part[k] for k, ids in zip(led, wanted, strict=True) if ids != found[k] and self.plain and part[k] != MARK)


def encode(docs: DataFrame, path: str, threads: int = 2) -> DataFrame:
    """``doc_id, ids array<int>, parity`` per row of ``docs`` (needs doc_id and text).

    Null and empty texts have no ids; repeated rows are encoded each; a null doc_id stays null; other columns are
    not read. ``parity``: each segment, or with a model whose normaliser changes texts the whole text, has the ids that
    the sentencepiece library gives.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = Encoder(path, threads)
        for b in slices(batches):
            ids, same = enc.encode([t or "" for t in b.column("text").to_pylist()])
            ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(same)], ["doc_id", "ids", "parity"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, parity boolean")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """Adds ``text`` to rows with ``ids``: pieces joined, markers as spaces, bytes put together, the first space off.
    Null ids give a null text; invalid bytes become U+FFFD each; other columns are kept (one named text is replaced)."""
    out = coded.drop("text")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in out.schema)}, text string"

    def run(batches):
        model = Model(path)
        piece, cut = model.piece_bytes(), model.dummy_prefix
        for b in slices(batches):
            texts = []
            for ids in b.column("ids"):
                if not ids.is_valid:
                    texts.append(None)
                    continue
                raw = b"".join(map(piece.__getitem__, ids.values.to_pylist()))
                raw = raw[1:] if cut and raw[:1] == b" " else raw
                try:
                    texts.append(raw.decode())
                except UnicodeDecodeError:
                    texts.append(raw.decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "text"])

    return out.mapInArrow(run, schema)


class Pieces:
    """Bytes of ids by one gather from a table of all pieces' bytes and their offsets."""

    def __init__(self, model: Model):
        raw = model.piece_bytes()
        self.starts = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.cut = model.dummy_prefix

    def texts(self, ids: list[bytes]) -> list[str]:
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        first = self.starts[flat]
        sizes = self.starts[flat + 1] - first
        ends = np.cumsum(sizes)
        take = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        whole = self.blob[take].tobytes()
        at = np.concatenate(([0], ends))[np.cumsum([0] + [len(x) // 4 for x in ids])].tolist()
        return [self._text(whole[lo:hi]) for lo, hi in zip(at, at[1:])]

    def _text(self, raw: bytes) -> str:
        return (raw[1:] if self.cut and raw[:1] == b" " else raw).decode(errors="replace")


def round_trip(docs: DataFrame, path: str, threads: int = 2) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, parity, n_chars, decoded_sha256`` per row of ``docs`` (needs doc_id and text):
    encoded, then decoded from the ids, in one pass. ``ids_crc32`` is taken of the ids in decimal, joined by blanks.

    Null and empty texts have no ids and decode to the empty text; repeated rows come out each; a null doc_id stays
    null; other columns are not read; an empty table gives an empty result; long texts are coded whole.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_crc32", "parity", "n_chars", "decoded_sha256"]

    def run(batches):
        enc = Encoder(path, threads)
        pieces, digits = Pieces(enc.model), [b"%d" % i for i in range(len(enc.model.pieces))]
        for b in slices(batches):
            ids, same = enc.encode(b.column("text").to_pylist())
            crcs = [zlib.crc32(b" ".join(map(digits.__getitem__, memoryview(x).cast("I")))) for x in ids]
            texts = pieces.texts(ids)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(crcs, pa.int64()), pa.array(same),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])], names)

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_crc32 bigint, parity boolean, n_chars bigint, decoded_sha256 string")
