"""A training corpus from documents: drop toxic ones, keep one of each near-duplicate group, mask
personal data, sample sources to target weights, and pack what is left into sequences.

Each stage takes all rows its predecessor kept; run() writes each stage as a Parquet table in the
shared folder and rereads it, so a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import mixing, neardup, packing, pii, toxicity
from spindrift.llm.common import load, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Part of the tokens that mixing keeps, and the power that flattens the shares of sources, languages and topics.
RATE, ALPHA = 0.8, 0.7
#: Words that a packing worker keeps, fewer than alone: it shares its executor with what earlier stages left in the heap.
#: Bytes of text that it takes at a time, for the same reason.
REMEMBER, PORTION = 150_000, 2_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from the labelled ones among them. Null texts come out empty."""
    docs = docs.select(*COLUMNS)
    model = toxicity.learn(docs, load(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, 0.5, "lang", "source", "n_chars").filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; repeated rows become one; rows without an id stay."""
    docs = docs.select(*COLUMNS)
    kept = neardup.link(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    # the join deals rows by id, and so serves the rows of one id as well
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.filter("doc_id is null")).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by their kind in brackets, n_chars counted anew. Null texts come out empty."""
    return pii.redact(docs, "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities that bring source, language and topic to flatter shares of the tokens."""
    return mixing.mix(docs, "text", "lang", "source", "n_chars", rate=RATE, alpha=ALPHA).filter("mix_kept").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their token ids, each a sequence of its own."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), longest=4096, remember=REMEMBER, portion=PORTION)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores and token ids aren't SQL; tests hold run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
