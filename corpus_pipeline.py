"""A corpus pipeline of five operators, each stage written and reread.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``;
all but the last return the columns of ``documents``. Texts of any length are
worked on whole, and an empty table gives no rows. Rows without text: the first
stage rejects them, the others keep them (near_dedup alone each, secret_scans as
they are, source_mixing as often as their source's rate says, best_fit_packing
as an end id). Repeated rows: near_dedup keeps or drops rows of one id alike,
the others treat each as a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.common import Scratch
from barspark.llm.mixing import emit_mix
from barspark.llm.near_dup import near_duplicates
from barspark.llm.packing import pack_documents
from barspark.llm.quality import keep_by_policy
from barspark.llm.queries import tokenizer_path
from barspark.llm.secret_scan import redact_documents

#: Ids of removed documents are broadcast up to this many (16 MB of longs).
MOST_BROADCAST_IDS = 2_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy v2 rejects go; it holds no least length but a word."""
    return keep_by_policy(docs, "v2")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: that of smallest id."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    if gone.limit(MOST_BROADCAST_IDS + 1).count() <= MOST_BROADCAST_IDS:  # else both sides are exchanged
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; all documents stay."""
    return redact_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return emit_mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their places in sequences."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot tokenize or pack; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
