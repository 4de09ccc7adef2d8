"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of training texts. A
text is cut into blocks, every block is compressed with each dictionary, and the
language whose blocks take the fewest bytes in all wins. Where the best and the
second differ by less than ``min_margin`` of the best, ``rejected`` is true. The margin is
set from held-out labelled texts (README): of texts in languages it learnt it loses few, of texts in
others it rejects most.

The dictionaries come from a bounded sample: about ``train_docs`` different texts a
language, those with the least hashes; of the segments (``segment`` characters each) of
these whole texts, those with the least hashes, until a dictionary has ``dict_bytes``.
Whole texts are classified.

Null text, and text without a letter, is ``und`` with score 0 and rejected. So is
every text if nothing can be learnt from. Ties go to the name that sorts first.
Repeated rows are classified one by one. Further columns of the input are ignored,
so their names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralapse.llm._arrow import slices, small_batches
from terralapse.plans.storage import stored

WORDLIKE = re.compile(r"[^\W\d_]")
#: Hashes of training texts and segments, as whole numbers below this.
SPAN = 1 << 62


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's categories L is there; signs such as ½ and Ⅷ are numbers."""
    return any(m.group().isalpha() for m in WORDLIKE.finditer(text))


def _place(seed: int, *columns) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 2)


def _least(rows: DataFrame, lang: str, wanted: dict[str, int], of: dict[str, int], seed: int, column: str) -> DataFrame:
    """For each language about ``wanted`` of its ``of`` different values of a column, half as many more to be sure: those with the least hashes."""
    below = F.lit(0)
    for name, n in of.items():
        below = F.when(F.col(lang) == name, F.lit(int(SPAN * min(1.0, 1.5 * wanted[name] / n)))).otherwise(below)
    return rows.withColumn("at", _place(seed, F.col(column))).where(F.col("at") < below)


def learnt(train: DataFrame, text_col: str, lang_col: str, train_docs: int, dict_bytes: int, segment: int, max_languages: int) -> dict[str, bytes]:
    """A dictionary's content for each language."""
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # A row per language; more than max_languages of them are refused below.
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"))
    texts = {r[0]: max(r[1], 1) for r in counts.limit(max_languages + 1).collect()}
    if len(texts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not texts:
        return {}
    chosen = _least(rows, "lang", dict.fromkeys(texts, train_docs), texts, 7, "text").groupBy("lang", "at").agg(F.min("text").alias("text"))
    # Of about train_docs whole texts: every one of their segments, and of these a bounded number.
    each = stored(chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"(?s).{{1,{segment}}}"), F.lit(0))).alias("text")).distinct(), "language-segments")
    segments = {r[0]: r[1] for r in each.groupBy("lang").count().collect()}  # a row per language
    enough = dict.fromkeys(segments, -(-dict_bytes // segment))
    found: dict[str, bytes] = {}
    for row in sorted(_least(each, "lang", enough, segments, 11, "text").collect(), key=lambda r: (r.lang, r.at, r.text)):
        if len(have := found.get(row.lang, b"")) < dict_bytes:
            found[row.lang] = have + row.text.encode() + b"\n"
    return {k: v[:dict_bytes] for k, v in found.items()}


def identify(
    docs: DataFrame,
    train: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train_docs: int = 200,
    segment: int = 64,
    dict_bytes: int = 1 << 15,
    level: int = 6,
    block_bytes: int = 1 << 13,
    min_margin: float = 0.02,
    max_languages: int = 64,
) -> DataFrame:
    """id, ``lang_pred``, ``score`` (0 to 1) and ``rejected``: one row per document."""
    small_batches(docs.sparkSession)
    content = learnt(train, text_col, lang_col, train_docs, dict_bytes, segment, max_languages)
    given = docs.sparkSession.sparkContext.broadcast(content)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        names, by = sorted(given.value), []
        for name in names:
            d = zstandard.ZstdCompressionDict(given.value[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            by.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

        def of(text: str | None) -> tuple[str, float, bool]:
            if not text or not names or not has_letter(text):
                return "und", 0.0, True
            raw = text.lower().encode()
            blocks = [raw[i : i + block_bytes] for i in range(0, len(raw), block_bytes)]
            sizes = sorted((sum(len(f(b)) for b in blocks), name) for f, name in zip(by, names))
            best, name = sizes[0]
            if len(sizes) == 1:
                return name, 1.0, False
            margin = (sizes[1][0] - best) / best
            return name, min(1.0, 0.5 + 4 * margin), margin < min_margin

        for batch in slices(batches, text_col):
            found = [of(t) for t in batch.column(text_col).to_pylist()]
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *columns], names=[id_col, "lang_pred", "score", "rejected"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")
