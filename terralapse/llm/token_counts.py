"""Token counts by a map-side lookup in two tiers.

The tokenizer drops white space and never joins text across it (others are
refused), so the tokens of a text are those of its words (runs without ASCII white space), one word at a
time. Tier one is a compact table of frequent words and their token counts,
broadcast to every worker. What it lacks goes to tier two, a bounded cache in
each Python worker, and only what that lacks too is encoded by the tokenizers
library, a batch of misses at a time. Words are never shuffled.

The table speeds the count up and never changes it: it is filled from a bounded
sample of documents (``sample_docs``), and a word that it lacks is encoded.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted one by
one, as given. Further columns of the input are ignored, so their names can't
clash. An empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralapse.llm._arrow import Recent, as_bytes, slices, small_batches


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _cache(path: str, size: int) -> Recent:
    return Recent(size)


def _encoded(path: str, words: list[bytes]) -> list[int]:
    found = _tokenizer(path).encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
    return [len(x.ids) for x in found]


#: White space of every kind beside letters, marks and the ends of a text.
PROBES = ("", " ", "a b", " a  b ", "a\tb\nc\r\nd", "a\x0bb\x0cc", "it's  10 % (of\tit) .", "é \u00a0 ü\n\n x")


def check_words(path: str) -> None:
    """Refuses a tokenizer for which the tokens of a text aren't those of its words."""
    for text in PROBES:
        whole, words = _encoded(path, [text.encode()])[0], text.encode().split()
        if whole != sum(_encoded(path, words)):
            raise ValueError(f"{path}: this tokenizer doesn't drop white space, or joins text across it ({text!r})")


def frequent_words(docs: DataFrame, text_col: str, path: str, entries: int, sample_docs: int) -> tuple[bytes, list[int]]:
    """The most frequent words of a random sample of about ``sample_docs`` rows, joined by spaces, and their token counts."""
    share = min(1.0, sample_docs / max(docs.count(), 1))
    sample = docs.select(F.col(text_col).alias("text"))
    sample = sample.sample(share, seed=1) if share < 1 else sample

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            seen = Counter(w for text in as_bytes(batch.column(0)) for w in (text or b"").split() if len(w) <= 64)
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    counts = sample.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [bytes(r.word) for r in counts.where("n > 1").orderBy(F.desc("n"), "word").limit(entries).collect()]  # at most so many
    return b" ".join(words), _encoded(path, words)


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    table_entries: int = 1 << 16,
    sample_docs: int = 2000,
    cache_entries: int = 1 << 19,
) -> DataFrame:
    """One row per document: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``)."""
    small_batches(docs.sparkSession)
    check_words(tokenizer_path)
    words, lengths = frequent_words(docs, text_col, tokenizer_path, table_entries, sample_docs)
    table = docs.sparkSession.sparkContext.broadcast((words, bytes(min(n, 255) for n in lengths)))
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, sizes = table.value
        first = {w: n for w, n in zip(joined.split(), sizes) if n < 255}
        second = _cache(tokenizer_path, cache_entries)
        for batch in slices(batches, text_col):
            texts = [t or b"" for t in as_bytes(batch.column(text_col))]
            known, rest, missing = [], [], {}
            for text in texts:
                found = list(map(first.get, parts := text.split()))
                left = [w for w, n in zip(parts, found) if n is None] if None in found else []
                known.append(sum(n for n in found if n is not None) if left else sum(found))
                rest.append(left)
                for w in left:
                    if w not in missing:
                        missing[w] = second.get(w)
            if ask := [w for w, n in missing.items() if n is None]:
                for w, n in zip(ask, _encoded(tokenizer_path, ask)):
                    missing[w] = n
                    if len(w) <= 64:
                        second.put(w, n)
            counts = pa.array([n + sum(map(missing.__getitem__, left)) for n, left in zip(known, rest)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([len(t) for t in texts], pa.int64()), counts], names=[id_col, "n_bytes", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
