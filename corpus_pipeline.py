"""From raw documents to token ids: quality, near duplicates, secrets, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of `documents`. No SQL can express the near-duplicate clusters, the random mix and the tokenizer together, so
ORACLE_SQL is None and the stages are tested against brute force.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pandwerk.llm import bpe, mixing, ngram_join, quality, secrets
from pandwerk.llm.common import checkpointed, read_table, recording, release

ORACLE_SQL = None

#: Near copies of the corpus share this share of their five-word shingles; op8_ngram_jaccard has its own rule.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Rounds in which the documents are signed, so that one round's share of the signatures is on disk at a time.
ROUNDS = 4


def stage(work):
    """A stage first deletes what earlier stages wrote for themselves, unless its input still reads it."""
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, docs)
        with recording():
            return work(spark, docs, sf_dir)
    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie outside the fences of their language and source go."""
    return quality.judged(docs).where("kept").select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id."""
    return ngram_join.deduplicated(docs, "doc_id", n=NEAR_WORDS, percent=NEAR_PERCENT, rounds=ROUNDS)


@stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are replaced by a mark; widely copied examples stay. Every document stays."""
    found = secrets.secret_spans(docs, owner=[F.col("source")], repo=[F.col("source"), F.col("lang")],
                                 carry=tuple(docs.columns))
    live = F.filter("secrets", lambda s: s["verdict"] == "live")
    clean = F.when(F.size(live) > 0, secrets.redact(F.col("text"), live)).otherwise(F.col("text"))
    out = found.withColumn("text", clean).withColumn(
        "n_chars", F.when(F.exists("secrets", lambda s: s["verdict"] == "live"), F.length("text").cast("long"))
        .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none to three times."""
    return mixing.mixed(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of the ids and of the text they decode to."""
    import public_tokenizers

    coded = bpe.encode_decode(docs, carry=("doc_id", "lang", "source"), path=public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan),
          ("source_mix", source_mix), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
