import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from momentlake.llm.common import durable
from tests.llm.edge import edge_docs, no_docs
from tests.llm.test_neardup import brute
from tests.llm.test_rules import base
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    """Each stage against a plain computation over the rows that its predecessor kept."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, SF))
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    a, b, c, d = seen.values()
    good = [k for k in before if labels.get(k) == 1]
    assert sum(k in a for k in good) >= 0.97 * len(good) and sum(k in a for k in before if labels.get(k) == 0) <= 0.3 * sum(v == 0 for v in labels.values())
    assert b.items() <= a.items() and not any(base(t)[-1] for t in b.values())
    assert sum(k in b for k in good) >= 0.97 * sum(k in a and not base(a[k])[-1] for k in good)
    assert c.keys() == {r[0] for r in brute(list(b.items()), 5) if r[3]} and c.items() <= b.items()
    assert d.keys() == c.keys() and any(d[k] != c[k] for k in d)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tok, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for k, t in d.items():
        full = tok.encode(t, add_special_tokens=False).ids + [0]
        want |= {(k, i, at, len(full[at:at + 2048]), zlib.crc32(np.array(full[at:at + 2048], "<u4").tobytes())) for i, at in enumerate(range(0, len(full), 2048))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out} == want
    check_packing(out)


def test_edge(spark):
    docs = edge_docs(spark, "score", "label")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, "/root/testdata/sf0.001"))
        assert docs.columns == edge_docs(spark, "score", "label").columns
    empty = no_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        empty = durable(stage(spark, empty, "/root/testdata/sf0.001"))
        assert empty.count() == 0


def test_repeated_rows_leave_once(spark):
    docs = edge_docs(spark)
    kept = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, 1, 2, 3, 4, 5, 6, 7, 9]
