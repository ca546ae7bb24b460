"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audio, licenses, mixing, neardup, packing, pii, quality, tokens, toxicity
from .common import held_out, load


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(load(spark, sf_dir, "documents"), path, longest=4096, with_ids=False)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents")).drop("spans")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = quality.learn(docs, load(spark, sf_dir, "labels"))
    return quality.score(docs, model, 0.3).withColumn("held_out", held_out())


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(load(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.learn(docs, load(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, 0.5).withColumn("held_out", held_out())


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(load(spark, sf_dir, "documents")))


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_roundtrip(load(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), rate=0.5, alpha=0.7)


def queries() -> dict:
    return {f.__name__: f for f in (op1_nearest_neighbours, op2_packing, op3_licenses, op4_quality, op5_near_duplicates, op6_toxicity, op7_personal_data, op8_mpeg_audio, op9_token_counts, op10_mixing)}


#: Token ids, media bytes, learned scores, template automata and hashed draws aren't SQL; DuckDB's expressions have no
#: lookarounds, which spans of personal data need; nearest neighbours are approximate. Those are tested against brute force.
ORACLES: dict[str, str] = {
    "op5_near_duplicates": r"""
WITH RECURSIVE words AS (
  SELECT DISTINCT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 75 * (m.n + n.n - count(*))),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.y, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN least l ON l.x = d.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
