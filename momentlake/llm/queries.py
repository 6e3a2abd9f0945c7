"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from momentlake.llm import bytebpe, collocations, cotrain, fingerprint, neardup, packing, periodic, pseudonyms, rules, spiece, tokens, toxicity, warc
from momentlake.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))




@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


PII_KEY = "a key for the registered query; real ones come from the caller"


@query
def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_and_read(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.periodic_runs(table(spark, sf_dir, "documents"), plant=True))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


ORACLE["op2_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT t, max(page_id) AS first FROM p GROUP BY t),
d AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, 5*i + 1, 5))::BIGINT) AS v FROM p JOIN f USING (t))
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0],
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> k & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""

ORACLE["op12_collocations"] = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM (SELECT *, row_number() OVER () AS doc FROM documents)),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
grams AS (SELECT lang, i, w, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM places),
counts AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE k >= 2),
cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS cut FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, cut,
    ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN total t USING (lang)
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:c.k], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
sizes AS (SELECT lang, w, k, a, unnest(range(2, k)) AS size FROM cand WHERE k >= 3),
inner_parts AS (SELECT lang, w, a, size, unnest(range(1, k - size + 2)) AS p FROM sizes),
longer AS (SELECT lang, array_to_string(w[p:p + size - 1], ' ') AS phrase, max(a) AS b FROM inner_parts GROUP BY ALL),
kept AS (SELECT o.* FROM lowest o LEFT JOIN longer USING (lang, phrase) WHERE b IS NULL OR 100 * b < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
