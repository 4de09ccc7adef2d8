"""The numbered operators over the whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralapse.llm import align, decontaminate, lang_id, ngram_join, packing, pieces, prefix_trie, quality, repeats, token_counts, toxicity, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(of: int):
    """crc32 of the id's decimal digits, modulo ``of``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(fold(5) != 0)
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted", "neighbours", "cosines", "terms")


#: The rules of the contract.
URL_RULES = [
    url_filter.Rule("com/en/", "block"),
    url_filter.Rule("example.com/en/7", "allow"),
    url_filter.Rule("net/de/", "allow"),
    url_filter.Rule("example.net/de/8", "block"),
    url_filter.Rule("org/es/", "block"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lang_id.identify(docs, docs.where(fold(4) != 2))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.align(table(spark, sf_dir, "documents"), *paths).documents


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


NUMBERED = (op1_quality, op2_warc, op3_ngram_join, op4_toxicity, op5_url_filter, op6_language, op7_sentencepiece, op8_repeats, op9_token_counts, op10_decontaminate, op11_prefix_trie, op12_align, op13_packing)


def queries() -> dict:
    return {f.__name__: f for f in NUMBERED}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": quality.ORACLE, "op2_warc": warc.ORACLE, "op3_ngram_join": ngram_join.ORACLE, "op8_repeats": repeats.ORACLE, "op10_decontaminate": decontaminate.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE}
