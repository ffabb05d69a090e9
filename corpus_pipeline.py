"""A corpus from raw documents to packed token sequences.

Four stages, each on all rows that the one before kept: quality rules by compression bands, SimHash near-dedup, secret
redaction, packing.  Each result is written as Parquet to the folder of ``spark.checkpoint.dir`` and read again, so
a lost executor costs part of one stage.

Rows with a null id or text, repeated rows, ties and empty tables are treated as each stage's operator says: null and
short texts fail the quality rules, of rows that repeat an id one stays, an empty table stays empty.  Columns beyond
those of ``documents`` are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.compression import compression_bands
from tallyspark.llm.packing import pack_documents
from tallyspark.llm.queries import WORD_BPE, tokenizer
from tallyspark.llm.secret_scan import redacted
from tallyspark.llm.simhash import keep_one_of_each
from tallyspark.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the compression bands."""
    verdict = "quality_verdict"
    while verdict in docs.columns:
        verdict += "_"
    return compression_bands(docs, out=verdict).where(F.col(verdict)["kept"]).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return keep_one_of_each(docs, shingle=4, max_bits=4)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets blanked out, and ``n_chars`` as it then is."""
    out = redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack_documents(docs, tokenizer(WORD_BPE), end_id=2, capacity=4096)


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("secret_scan", secret_scan),
          ("packing", packing)]

#: SQL has no zstandard, XXH64 with a seed, or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), spark, f"pipeline-{name}")
    return docs
