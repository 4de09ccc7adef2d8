"""A corpus from documents: language, near copies, repeated passages, benchmark items, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

Every stage keeps all columns of its input, however they are named (but names that differ from
``doc_id`` or ``text`` by case alone, which Spark can't tell apart). Repeated rows meet the
same fate. A row without an id can't be named as dropped, so it stays (its text is cut like
others); null and empty texts are rejected by the first stage, as no language is told, and
stay in the others. An empty table gives an empty one.

No SQL can express the pipeline (its first stage is a compressor), so ORACLE_SQL is None and
tests hold run() against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralapse.llm import decontaminate, lang_id, ngram_join, pieces, repeats
from terralapse.llm.queries import fold, table
from terralapse.plans.storage import stored

MAX_BROADCAST = 500_000
#: Words that a worker remembers while it encodes; its cache stays beside the other stages' work.
CACHE_ENTRIES = 1 << 18


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id isn't among ``ids``, which are broadcast only if they are few."""
    ids = stored(ids.select("doc_id").distinct(), "dropped")
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids
    # By a condition, so that all columns stay in their order and none needs to be named.
    return docs.join(ids, docs["doc_id"] == ids["doc_id"], "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly."""
    found = lang_id.identify(docs, docs.where(fold(4) != 2))
    return without(docs, found.where("rejected"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    found = ngram_join.near_copies(docs)
    return without(docs, found.where("doc_id != component_id"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what an earlier document has too. A character that loses some of its bytes goes as a whole."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    # In one column and by number, so that no name can clash.
    row = [F.struct(*(F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(rest))).alias("row")] if rest else []
    found = repeats.without_repeats(docs.select("doc_id", "text", *row), carry=("row",) if rest else (), as_text=True)
    own = {c: F.col("row")[f"c{i}"] for i, c in enumerate(rest)} | {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*(own[c].alias(c) for c in docs.columns))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item inside."""
    return without(docs, decontaminate.contained(docs, table(spark, sf_dir, "benchmark")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what stays."""
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"), cache_entries=CACHE_ENTRIES)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", passages),
    ("benchmark decontamination", benchmark_free),
    ("SentencePiece encoding and decoding", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
