import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from momentlake.llm import bytebpe, queries
from tests.llm.edge import ROWS, edge_docs, no_docs

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bytebpe.ByteBpe(PATH)


def digest(library, text):
    e = library.encode(text or "", add_special_tokens=False)
    raw = np.array(e.ids, "<u4").tobytes()
    return len(e.ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_whole_table(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_byte_bpe(spark, SF).collect()}
    want = {r.doc_id: digest(library, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got == want


def test_edge(spark, library):
    got = bytebpe.round_trip(edge_docs(spark, "ids", "n_tokens"), PATH).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((r[0] or -1, *digest(library, r[1])) for r in ROWS)
    assert bytebpe.round_trip(no_docs(spark), PATH).collect() == []


def test_encode_and_decode_columns(spark, library):
    ids = bytebpe.encode_documents(edge_docs(spark, "ids"), PATH)
    back = bytebpe.decode_documents(ids.drop("text"), PATH).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((r[0] or -1, r[1] or "") for r in ROWS)


def test_random_texts(own, library):
    """Blanks, new and old letters, special tokens, words of two letters that need steps back."""
    rng = random.Random(5)
    parts = ["a", "b", "aa", " ", "  ", "\n", "é", "😀", "中", "1", "２", "'s", "'t", "<|endoftext|>", "<|endo", "\x1c", "\x85", " ", "　",
             "\U0003fc2c", "՘", "the", "ing", "\t", "'LL", "..", "\x00", "end.", "x,y"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(0, 300))) for _ in range(500)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 127), rng.randint(0, 0x2fff), rng.randint(0x10000, 0x10ffff)])) for _ in range(40)) for _ in range(500)]
    texts += ["x" * 70000, "ab" * 30000, "=-" * 5000, " " * 999, "\n" * 999 + "a", "é" * 3000]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:60]


def test_every_token_alone(own, library):
    for raw in own.bytes[:-1]:
        if len(raw) > 1:
            ids = own.encode_word(raw)
            assert b"".join(own.bytes[i] for i in ids) == raw and all(own.compatible(a, b) for a, b in zip(ids, ids[1:]))


def test_pairs_are_what_merging_leaves(own):
    """The pair table against plain merging by rank, over neighbours and strangers."""
    def merge(raw):
        ids = [own.single[raw[i:i + 1]] for i in range(len(raw))]
        while True:
            found = [(own.rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in own.rank]
            if not found:
                return ids
            _, i = min(found)
            ids[i:i + 2] = [made[ids[i], ids[i + 1]]]

    made = {p: t for t, p in own.parts.items()}
    rng = random.Random(1)
    tokens = [t for t in own.parts if len(own.bytes[t]) < 8]
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert own.compatible(a, b) == (merge(own.bytes[a] + own.bytes[b]) == [a, b])


def test_other_files_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["normalizer"] = {"type": "NFC"}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bytebpe.ByteBpe(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        bytebpe.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))
