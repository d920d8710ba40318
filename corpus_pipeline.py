"""The corpus pipeline: five operators in a row over the documents, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents.

Defined cases, in all stages: rows without an id, and rows that share one, are judged each by its own text; of
equal rows the quality stage keeps or drops all, the Jaccard join keeps one.  Null and empty texts fall to the quality rules
(under 50 words); where they reach a later stage they pass it unchanged, and encode to no ids.  Empty tables give
empty results with the same columns; without labels only the base rules hold, without benchmark items nothing
leaks.  Columns beside doc_id and text are carried along, whatever they are named.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fallowgrid.llm import decontaminate, jaccard_join, quality_rules, sentencepiece_codec, substring_dedup
from fallowgrid.llm.common import shared_dir, stored, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the base rules or the learned list reject go.  Rules are learned from all labelled documents."""
    rules = quality_rules.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    stats = quality_rules.text_statistics(docs.select(F.struct("*").alias("doc"), "text"), keep=["doc"])
    # the filter asks for a row number, too, which keeps it above the statistics: pushed down, it would compute each of them once for every mention
    judged = stats.select("doc", (~quality_rules.base_failed() & ~rules.rejects()).alias("kept"), F.monotonically_increasing_id().alias("row"))
    return judged.where("kept AND row >= 0").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the one with the smallest id stays; of equal rows one stays."""
    return jaccard_join.keep_one(docs).select(docs.columns)


def cut_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: passages that an earlier document has are cut out; n_chars follows the text."""
    passages = stored(substring_dedup.find_passages(docs), "passages")
    cut = substring_dedup.cut_passages(docs, passages)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark passage go, each row judged by its own text, whatever its id."""
    key = F.xxhash64("doc_id", "text")
    leaks = stored(decontaminate.find_leaks(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__key")).distinct(), "leaks")
    return docs.withColumn("__key", key).join(leaks, "__key", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: ids of every text, and whether decoding gives the text again."""
    return sentencepiece_codec.encode(docs).select("doc_id", "n_tokens", "n_bytes", "round_trip", "ids")


STAGES = [
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_shared_passages),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding", encode),
]

#: Learned rules, similarity classes and chained passages have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/fallowgrid/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
