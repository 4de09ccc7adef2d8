"""Quality rules as a short-circuit cascade.

Two base rules and the counts that they need are worked out for every text. What
passes them meets further rules, one after another; the first rule that rejects
ends the work on that text. The order comes from a random sample of about
``sample_docs`` rows: each rule is timed there, its rejections are noted (both are added up
by Spark for each set of rules that reject together), and the order takes the rule with the most rejections per second first, counted over what
the rules before it left. The order changes the time only: a text is kept if no
rule rejects it, whichever comes first.

Words are runs of characters outside space and U+0009 to U+000D. Null text has no
words. Repeated rows are judged one by one. Further columns of the input are
ignored, so their names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralapse.llm._arrow import as_bytes, slices, small_batches

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Second and further bytes of a UTF-8 character.
INNER = bytes(range(0x80, 0xC0))
#: Common function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that it for on was be with as by this are from or "
    "der die und das den von zu mit ist des im ein eine nicht auch auf für sich dem es "
    "le la les de des et un une que qui dans pour est au il par sur en pas plus "
    "el los las del y que en un una por con para se no es lo su al como".encode().split()
)
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


class Text:
    """One text and what the rules count in it, each worked out when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, SPACES + INNER))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a window of three that the text has twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        often = {x for x, n in Counter(windows).items() if n > 1}
        total, end = 0, 0
        for i, x in enumerate(windows):
            if x in often:
                total += i + 3 - max(i, end)
                end = i + 3
        return total


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("word_length", lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 12 * t.n_words),
    Rule("dup_lines", lambda t: 100 * t.n_dup_lines > 30 * len(t.lines)),
    Rule("letters", lambda t: 100 * sum(1 for w in t.words if LETTER.search(w)) < 70 * t.n_words),
    Rule("capitals", lambda t: 100 * sum(1 for w in t.words if w.isupper() and len(w) > 1) > 50 * t.n_words),
    Rule("stop_words", lambda t: not any(w in STOP_WORDS for w in t.raw.lower().split())),
)


def base_failed(t: Text) -> bool:
    return t.n_words < 50 or 100 * t.n_repeat_words > 50 * t.n_words


def cascade_order(docs: DataFrame, text_col: str, rules: tuple[Rule, ...], sample_docs: int) -> list[int]:
    """Positions of the rules, that with the most rejections per second first."""
    share = min(1.0, sample_docs / max(docs.count(), 1))
    sample = docs.select(F.col(text_col).alias("text"))
    sample = sample.sample(share, seed=1) if share < 1 else sample

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[float]] = {}  # which rules reject: texts, seconds spent in each rule
        for batch in slices(batches, "text"):
            for raw in as_bytes(batch.column(0)):
                if base_failed(t := Text(raw or b"")):
                    continue
                mask, spent = 0, []
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    mask |= rule.rejects(t) << i
                    spent.append(time.perf_counter() - began)
                found[mask] = [x + y for x, y in zip(found.get(mask, [0.0] * (len(rules) + 1)), [1.0, *spent])]
        yield pa.RecordBatch.from_pydict({"mask": pa.array(list(found), pa.int64()), "sums": pa.array(list(found.values()), pa.list_(pa.float64()))})

    seen = sample.mapInArrow(judge, "mask long, sums array<double>").groupBy("mask").agg(*(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(len(rules) + 1)))
    masks = {r[0]: r[1:] for r in seen.collect()}  # a row for each set of rules that reject together
    total = sum(x[0] for x in masks.values())
    cost = [sum(x[i + 1] for x in masks.values()) / max(total, 1) + 1e-9 for i in range(len(rules))]
    left, order, passed = set(range(len(rules))), [], {m: x[0] for m, x in masks.items()}
    while left:
        best = max(left, key=lambda i: ((sum(n for m, n in passed.items() if m >> i & 1) + 1e-3) / cost[i], -i))
        left.remove(best)
        order.append(best)
        passed = {m: n for m, n in passed.items() if not m >> best & 1}
    return order


def quality(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    sample_docs: int = 1000,
) -> DataFrame:
    """id, the five counts, ``base_failed`` and ``kept``: one row per document."""
    small_batches(docs.sparkSession)
    order = [rules[i] for i in cascade_order(docs, text_col, rules, sample_docs)]
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            rows, failed, kept = [], [], []
            for raw in as_bytes(batch.column(text_col)):
                t = Text(raw or b"")
                rows.append([getattr(t, c) for c in counts])
                failed.append(bad := base_failed(t))
                kept.append(not bad and not any(r.rejects(t) for r in order))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *columns, pa.array(failed), pa.array(kept)], names=[id_col, *counts, "base_failed", "kept"])

    return docs.select(id_col, text_col).mapInArrow(judge, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean")


def _sql() -> str:
    space, stop = r"[\x20\x09-\x0D]+", ", ".join(f"'{w.decode()}'" for w in sorted(STOP_WORDS))
    return rf"""
    WITH a AS (
      SELECT doc_id, coalesce(text, '') AS t,
        list_filter(regexp_split_to_array(coalesce(text, ''), '{space}'), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM documents),
    b AS (
      SELECT *, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '{space}', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines
      FROM a),
    win AS (
      SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a WHERE len(w) >= 3)),
    often AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    marked AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM often, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
    c AS (
      SELECT b.*, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
        n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed
      FROM b LEFT JOIN marked USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND NOT (
        10 * n_symbols > 3 * n_words
        OR word_chars < 2 * n_words OR word_chars > 12 * n_words
        OR 100 * n_dup_lines > 30 * len(lines)
        OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) < 70 * n_words
        OR 100 * len(list_filter(w, lambda x: octet_length(encode(x)) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) > 50 * n_words
        OR len(list_filter(w, lambda x: list_contains([{stop}], translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) = 0) AS kept
    FROM c"""


ORACLE = _sql()
