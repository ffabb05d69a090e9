"""The registered queries: each applies one operator to its whole table and returns the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import read

WORD_BPE, BYTE_BPE, PIECE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.suffix_tree import suffix_tree_scores

    return suffix_tree_scores(read(spark, sf_dir, "documents"))


def op2_contiguous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.sharding import contiguous_shards

    return contiguous_shards(read(spark, sf_dir, "documents"), n_shards=8)


def op3_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.rp_forest import nearest

    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.license_scan import license_notices

    return license_notices(read(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.bpe import encode_documents

    coded = encode_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer(BYTE_BPE))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.chat import recover_roles

    return recover_roles(read(spark, sf_dir, "conversations"))


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.compression import compression_bands

    return compression_bands(read(spark, sf_dir, "documents")).select("doc_id", "quality.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.simhash import simhash_components

    return simhash_components(read(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), tokenizer(WORD_BPE), end_id=2, capacity=4096)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.secret_scan import KINDS, secret_spans, spans_text

    found = secret_spans(read(spark, sf_dir, "documents"))

    def number(rank: int):
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    return found.select("doc_id", *map(number, range(3)),
                        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
                        spans_text(F.col("spans")).alias("spans"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Of ids whose crc32 is divisible by 10 the text's words, from one of them on, repeat a stretch of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n), " ")
    return docs.withColumn("text", F.when((h % 10 == 0) & (n > 0), planted).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.periodic_runs import periodic_runs

    docs = with_planted_runs(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs(docs, least_length=6, least_exponent=4, out="found").select("doc_id", "found.*")
    run = "struct<start: bigint, length: bigint, period: bigint>"
    longest = F.aggregate(
        "runs", F.lit(None).cast(run),
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r)
        .otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"),
                        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")) \
        .select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                "runs_sha256", "collapsed_sha256", "n_words")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.prefix_trie import prefix_trie

    c = F.col("conv_id")
    return prefix_trie(read(spark, sf_dir, "conversations"), base_of=c - c % 100,
                       head_turns=F.crc32(c.cast("string")) % 6)


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.llm.sentence_pieces import piece_documents

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_documents(docs, tokenizer(PIECE_BPE), out="coded", packed=True)
    return coded.select("doc_id", (F.octet_length("coded.ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("coded.ids", 256).alias("ids_sha256"),
                        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
                        F.col("coded.agrees").alias("library_agrees"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_suffix_tree, op2_contiguous_shards, op3_rp_forest, op4_license_notices, op5_bpe, op6_transcript_roles,
           op7_compression_bands, op8_simhash, op9_packing, op10_secrets, op11_periodic_runs,
           op12_prefix_trie, op13_sentence_pieces]
    return {f.__name__: f for f in own}
