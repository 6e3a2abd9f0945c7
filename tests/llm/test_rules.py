import re
from collections import Counter

import pytest

from momentlake.llm import queries, rules
from tests.llm.edge import edge_docs, no_docs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, r = len(words), len(hit)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n)


def got(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()))


def want(docs):
    return sorted((r.doc_id if r.doc_id is not None else -1, *base(r.text)) for r in docs.collect())


def test_base_counts(spark):
    assert got(queries.op6_quality_rules(spark, SF)) == want(spark.read.parquet(f"{SF}/documents.parquet"))


def test_edge(spark):
    odd = spark.createDataFrame([(20, "a b c d e a b c d e a b c d e f"), (21, "x " * 40), (22, "l1 b\n \nl1 b\nl1 b\n#<>"), (23, "a b c d e f g h i j k l a b c d e"), (24, "1 2 3 4 5 6 1 2 3 4 5 6 7")], "doc_id long, text string")
    docs = edge_docs(spark, "w", "n_words", "q", "kept").unionByName(odd, allowMissingColumns=True)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert got(rules.apply_rules(docs, labels)) == want(docs)
    assert rules.apply_rules(no_docs(spark), labels.limit(0)).collect() == []
    kept = rules.filter_documents(docs, labels.limit(0))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in want(docs) if not r[-1])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_learned_rules_hold_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 3 <> 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    judged = [r for r in rules.apply_rules(docs, train).collect() if r.doc_id in test]
    good = [r for r in judged if test[r.doc_id] == 1 and not r.base_failed]
    bad = [r for r in judged if test[r.doc_id] == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_list_is_ordered_and_pruned(spark):
    rows = [(i, float(i % 100), float(i % 7), (i % 100) >= 80 or (i % 7 == 3 and i % 100 < 10)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, a double, b double, bad boolean")
    found = rules.learn(df, ("a", "b"))
    assert found.rules[0] == [rules.Literal("a", True, 80.0)]
    assert len(found.rules) == 2 and len(found.rules[1]) <= 4
    judged = df.withColumn("k", found.keeps()).where("k = bad").count()
    assert judged < 60
    assert str(found).startswith("1. reject if a >= 80")
    assert rules.learn(df.limit(0), ("a", "b")).rules == [] == rules.learn(df.where("bad"), ("a", "b")).rules
