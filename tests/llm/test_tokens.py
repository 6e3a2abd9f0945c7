import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from momentlake.llm import packing, queries, spiece, tokens
from tests.llm.edge import LONG, ROWS, edge_docs, no_docs

WORD, PIECE, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


def ids(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_blank_rule():
    assert tokens.splits_at_blanks(WORD)
    assert not tokens.splits_at_blanks(BYTE)


def test_words_alone_and_together(word):
    """Case, closing marks, composing marks and special tokens change nothing."""
    texts = ["J\u030c J\u030cA.", "A, a. A! it's IT'S! x.. e\u0301, É, İ I\u0307 ΑΣ ΑΣ.", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>B", "a<b <|x", "ﬁ K \u212a ½ 1,5 x2,", "..., ?! ,", "\u2000 \u3000 x\u00a0y\u2028z \u200b"]
    memo = tokens.WordMemo(WORD)
    for batch in (texts, [t * 2 for t in texts], [t.upper() for t in texts]):
        got = memo.encode([t.encode() for t in batch])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids(word, t) for t in batch]


def test_counts_of_whole_table(spark, word):
    got = {r.doc_id: r for r in queries.op5_token_counts(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        n = len(ids(word, t))
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((t or "").encode()), n > 2048)


def test_texts_over_a_chunk_take_the_chunked_way(spark):
    """Every text over 16384 letters is cut; no text of up to that many bytes is."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    longest = max(texts, key=lambda k: len(texts[k]))
    df = spark.createDataFrame([*texts.items(), (-1, texts[longest] * (1 + 40000 // len(texts[longest])))], "doc_id long, text string")
    got = {r.doc_id: r.n_chunks for r in tokens.count_tokens(df, WORD).collect()}
    want = {k: -(-len(t) // tokens.CHUNK_CHARS) or 1 for k, t in [*texts.items(), (-1, texts[longest] * (1 + 40000 // len(texts[longest])))]}
    assert got == want and got[-1] >= 3


def test_counts_edge(spark, word):
    got = tokens.count_tokens(edge_docs(spark, "n_tokens", "key", "i"), WORD, chunk_chars=3000, overlap_chars=40).collect()
    want = sorted((r[0] or -1, len((r[1] or "").encode()), len(ids(word, r[1]))) for r in ROWS)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert max(r.n_chunks for r in got if r.doc_id == 5) > 5
    assert tokens.count_tokens(no_docs(spark), WORD).collect() == []


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_chunks_resynchronise(spark, path):
    rng, tok = random.Random(3), Tokenizer.from_file(path)
    vocab = ["alpha", "beta,", "it's", "Été", "12345", "\n\n", "é", "😀😀", "naïve", "a" * 90, "  ", "<|endoftext|>"]
    texts = {f"k{i}": " ".join(rng.choice(vocab) for _ in range(n)) for i, n in enumerate((1, 40, 700, 3000))}
    texts["solid"] = "ab" * 4000
    df = spark.createDataFrame(list(texts.items()), "key string, text string")
    got = {r.key: r for r in tokens.count_by_chunks(df, path, 400, 20).collect()}
    assert {k: r.n_tokens for k, r in got.items()} == {k: len(ids(tok, t)) for k, t in texts.items()}
    assert got["solid"].n_chunks < 20 < got["k3"].n_chunks or path == BYTE


def test_pieces_and_packing(spark, word):
    got = queries.op9_packing(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = set()
    for d, t in texts.items():
        full = ids(word, t) + [0]
        for k, at in enumerate(range(0, len(full), 2048)):
            part = full[at:at + 2048]
            want.add((d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    check_packing(got)
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= -(-total // 2048) + 2


def check_packing(rows, size=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size


def test_packing_edge(spark):
    pieces = packing.cut_pieces(edge_docs(spark, "length", "sequence_id"), WORD)
    got = packing.pack(pieces, group_rows=6, islands=3).collect()
    assert len(got) == pieces.count()
    check_packing(got)
    assert packing.pack(packing.cut_pieces(no_docs(spark), WORD)).collect() == []


def test_packing_many_groups(spark):
    rng = random.Random(5)
    lengths = [min(2048, int(rng.paretovariate(1.1) * 60)) for _ in range(3000)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    got = packing.pack(df, group_rows=300).collect()
    assert sorted(r.length for r in got) == sorted(lengths)
    check_packing(got)
    assert len({r.sequence_id for r in got}) <= -(-sum(lengths) // 2048) * 1.01 + 1


def test_sentencepiece_parity(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    coded = spiece.encode(docs, PIECE)
    got = {r.doc_id: r for r in coded.collect()}
    assert all(list(got[k].ids) == sp.encode(t) and got[k].parity for k, t in texts.items())
    back = {r.doc_id: r.text for r in spiece.decode(coded, PIECE).collect()}
    assert back == texts
    whole = spiece.Model(PIECE).tokenizer()
    for k, t in list(texts.items())[:40]:
        assert whole.encode(t, add_special_tokens=False).ids == list(got[k].ids)
        assert whole.decode(list(got[k].ids)) == t


def test_sentencepiece_edge(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = spiece.encode(edge_docs(spark, "ids", "parity"), PIECE).collect()
    assert sorted((r.doc_id or -1, tuple(r.ids)) for r in rows) == sorted((r[0] or -1, tuple(sp.encode(r[1] or ""))) for r in ROWS)
    back = spiece.decode(spiece.encode(edge_docs(spark), PIECE), PIECE).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((r[0] or -1, sp.decode(sp.encode(r[1] or ""))) for r in ROWS)
    assert spiece.round_trip(no_docs(spark), PIECE).collect() == []
    assert LONG in {r.text for r in back}


def test_round_trip_columns(spark):
    """Each column against the sentencepiece library, on the table and on odd rows."""
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)

    def want(doc_id, text):
        i = sp.encode(text or "")
        back = sp.decode(i)
        return (doc_id or -1, len(i), zlib.crc32(" ".join(map(str, i)).encode()), True, len(back), hashlib.sha256(back.encode()).hexdigest())

    for df in (spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), edge_docs(spark, "ids", "parity", "n_tokens").select("doc_id", "text", "ids", "parity")):
        got = [(r.doc_id or -1, r.n_tokens, r.ids_crc32, r.parity, r.n_chars, r.decoded_sha256) for r in spiece.round_trip(df, PIECE).collect()]
        assert sorted(got) == sorted(want(r.doc_id, r.text) for r in df.collect())


def test_unigram_model_is_rebuilt(tmp_path):
    """A unigram model file written by hand: same ids as the sentencepiece library."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(k, v):
        return varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v

    import struct
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [("▁", -3.0, 1), ("▁he", -4.0, 1), ("llo", -5.0, 1), ("▁hello", -6.5, 1), ("h", -8.0, 1), ("e", -8.1, 1), ("l", -8.2, 1), ("o", -8.3, 1), ("▁w", -7.0, 1)]
    data = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + field(3, k)) for p, s, k in pieces)
    data += field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1))
    path = str(tmp_path / "u.model")
    open(path, "wb").write(data)
    sp, enc = sentencepiece.SentencePieceProcessor(model_file=path), spiece.Encoder(path, 1)
    texts = ["hello  hello", "héllo w", " hell  ", "", "wello\nh"]
    got, same = enc.encode(texts)
    assert [list(np.frombuffer(g, "<u4")) for g in got] == [sp.encode(t) for t in texts] and same == [True] * len(texts)
    enc.ids = {k: v[4:] for k, v in enc.ids.items()}  # a wrong id is seen
    assert enc.encode(texts)[1] == [not t for t in texts]
