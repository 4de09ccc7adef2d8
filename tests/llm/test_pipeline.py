"""The pipeline against plain versions of its stages."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

pytest.importorskip("terralapse.llm")

import public_tokenizers  # noqa: E402

import corpus_pipeline  # noqa: E402
from terralapse.llm import lang_id, pieces  # noqa: E402
from terralapse.llm.queries import fold  # noqa: E402

from .test_operators import brute_components, brute_repeats, shingle_set  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = {r.item_id: shingle_set(r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    rejected = {r.doc_id for r in lang_id.identify(docs, docs.where(fold(4) != 2)).where("rejected").collect()}
    left = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in rejected}
    component = brute_components({k: shingle_set(t) for k, t in left.items()})
    left = {k: t for k, t in left.items() if component[k] == k}
    kept, seen = {}, set()
    for k in sorted(left):
        b = left[k].encode()
        windows = [b[i : i + 50] for i in range(len(b) - 49)]
        cover = bytearray(len(b))
        for i, w in enumerate(windows):
            if w in seen:
                cover[i : i + 50] = b"\1" * 50
        seen.update(windows)
        kept[k] = bytes(x for x, c in zip(b, cover) if not c).decode("utf-8", "ignore")
    assert sum(x[1] for x in brute_repeats(left, 50).values()) > 0
    sets = {k: shingle_set(t.lower()) for k, t in kept.items()}
    left = {k: t for k, t in kept.items() if not any(i and 100 * len(sets[k] & i) >= 75 * len(i) for i in items.values())}
    library = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model")).library
    want = {}
    for k, t in left.items():
        ids = library.encode(t)
        want[k] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(got) < docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), SF).columns == docs.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_further_columns_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for name in ("kept", "given", "n_removed", "row"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    got = corpus_pipeline.passages(spark, docs, SF)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == 30 and all((r.kept, r.given, r.n_removed, r.row) == tuple(f"{n}{r.doc_id}" for n in ("kept", "given", "n_removed", "row")) for r in rows)
    assert all(len(r.text) == r.n_chars and r.lang for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_on_odd_tables(spark):
    """Nulls in any column, empty, repeated and very long texts, a clashing column, no rows: each stage ends, and rows without an id stay."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(25)
    long = " ".join(r.text for r in base.collect() if r.text) * 4
    odd = [(9_000_001, None, None, None, None), (9_000_002, "", "en", "s", 0), (9_000_003, long, "en", "s", len(long)), (9_000_003, long, "en", "s", len(long)), (None, "one two three", "de", None, 13), (None, None, None, None, None)]
    docs = base.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.withColumn("row", F.lit("x")).withColumn("kept", F.col("n_chars")).withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit(2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert sum(r.doc_id is None for r in rows) == 2 and len(rows) <= docs.count()
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()}.isdisjoint({9_000_001, 9_000_002})
    copies = corpus_pipeline.near_copies(spark, docs, SF)
    assert copies.where("doc_id = 9000003").count() == 2
    cut = {r.doc_id: r for r in corpus_pipeline.passages(spark, docs, SF).collect()}
    assert cut[9_000_002].text == "" and len(cut[9_000_003].text) < len(long) // 3
    last = corpus_pipeline.encoded(spark, docs, SF)
    assert last.count() == docs.count() and last.where("doc_id = 9000001").first().n_tokens == 0
