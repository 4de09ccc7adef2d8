"""URL filters: rules by host and path, and a model of segmented names for the rest.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end,
with A-Z in lower case; the path follows, up to ``?``, ``#`` or the end. Null
urls, and urls without ``://``, have neither. A rule such as ``net/de/`` fits its
host and all subdomains if the path starts with the rule's; the longest wins.

Urls that no rule fits are judged by a multinomial naive Bayes model over the
tokens of host and path. Concatenated names are split into words first: a unigram
Viterbi search takes the split with the highest probability under the counts of
words in the pages' own html, to which ``SEEDS`` are added. There are no labelled
urls, so the seeds make them: a url whose host has a seed among its words is an
example to block, any other to allow, and the model carries this over to the words
that come with seeds; ``rest_odds`` tells what the words that are no seeds say alone.

Nothing is cut off: a name meets the counts of the words inside it by a join, the words of all
names are counted, and tokens meet their weights by a join. What is joined is broadcast
only if it has at most ``max_broadcast`` rows. Only different names, and different pairs of host
and path, are worked on; each counts as often as the table has it.

With nothing to block, or in a tie, a url is allowed. Repeated rows are judged alike. Further
columns of the input are ignored, so their names can't clash. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralapse.llm._arrow import small_batches
from terralapse.plans.storage import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of hosts that are commonly kept out of training data.
SEEDS = frozenset(
    "casino poker bet bets betting slots jackpot gambling lottery roulette "
    "pills viagra cialis pharmacy porn porno xxx sex adult escort escorts camgirls "
    "payday loans replica warez torrent torrents crack keygen spam ads adserver malware phishing".split()
)
#: Letters of the longest word that a name is split into.
LONGEST = 20
#: Rules stand in the plan as one expression, so there must not be very many.
MAX_RULES = 1000


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule's text; on ties the one that sorts first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    fits: Column = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = F.when(((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path)), F.lit(r.text)).otherwise(fits)
    return fits


class Segmenter:
    """Splits a name into words by the most probable path under unigram counts."""

    def __init__(self, counts: dict[str, int], longest: int = LONGEST, total: int | None = None):
        self.total = total or sum(counts.values()) or 1
        self.cost = {w: -math.log(n / self.total) for w, n in counts.items()}
        self.longest = longest

    def _unknown(self, size: int) -> float:
        return math.log(self.total) + 2.3 * size

    def split(self, name: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            found = min((best[start] + self.cost.get(word := name[start:end], self._unknown(len(word))), -start) for start in range(max(0, end - self.longest), end))
            best.append(found[0])
            back.append(-found[1])
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return tuple(reversed(words))


NAME = re.compile(r"[^\W\d_]+|\d+")
URLS = ["host", "path"]


def names_of(urls: DataFrame) -> DataFrame:
    """(host, path, n, at, kind, name): the names of each url in order, of the host (``h:``) and the path (``p:``); numbers read 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, texts in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())):
                names = [(kind, x) for kind, text in zip(("h:", "p:"), texts) for x in NAME.findall(text.lower())]
                found += [(i, at, kind, "0" if x[0].isdigit() else x) for at, (kind, x) in enumerate(names)]
            rows = batch.select(["host", "path", "n"]).take(pa.array([f[0] for f in found], pa.int64()))
            columns = [pa.array([f[i] for f in found], t) for i, t in ((1, pa.int32()), (2, pa.string()), (3, pa.string()))]
            yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=["host", "path", "n", "at", "kind", "name"])

    return urls.mapInArrow(run, "host string, path string, n long, at int, kind string, name string")


def word_counts(html: DataFrame, column: str) -> DataFrame:
    """(word, n): words of 2 to 20 letters a-z outside tags, over all rows."""
    plain = F.regexp_replace(F.lower(F.col(column)), "<[^>]*>", " ")
    words = html.select(F.explode(F.split(plain, "[^a-z]+")).alias("word")).where(F.length("word").between(2, LONGEST))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words): each name split by the counts of the words that it holds."""
    total, often = counts.agg(F.sum("n"), F.max("n")).first()
    total, least = total or 1, (often or 1) // 1000 + 1

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(name, w) for name in batch.column("name").to_pylist() for w in {name[i:j] for i in range(len(name)) for j in range(i + 2, min(len(name), i + LONGEST) + 1)}]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["name", "word"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, known in zip(batch.column("name").to_pylist(), batch.column("known").to_pylist()):
                own = {k["word"]: k["n"] for k in known or ()}
                own |= {w: max(own.get(w, 0), least) for w in SEEDS if w in name}
                out.append(list(Segmenter(own, total=total).split(name)))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])

    known = names.mapInArrow(inside, "name string, word string").join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return names.join(known, "name", "left").select("name", "known").mapInArrow(split, "name string, words array<string>")


def judge(
    pages: DataFrame,
    rules: list[Rule],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    max_broadcast: int = 200_000,
) -> DataFrame:
    """id, ``host``, ``path``, ``rule``, ``verdict``; and, null under a rule: the model's ``log_odds`` of block, ``rest_odds`` (without seeds in the host) and the ``tokens`` it saw."""
    small_batches(pages.sparkSession)
    few = lambda df: F.broadcast(df) if df.count() <= max_broadcast else df
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    each = stored(urls.groupBy(*URLS).agg(F.count(F.lit(1)).alias("n")), "urls")
    names = stored(names_of(each), "url-names")
    counts = stored(word_counts(pages, html_col), "page-words")
    words = stored(segmented(names.select("name").where("name <> '0'").distinct(), counts), "name-words")

    parts = names.join(few(words), "name", "left").select(*URLS, "n", F.struct("at", "kind", F.coalesce("words", F.array(F.lit("0"))).alias("words")).alias("part"))
    seeds = F.array(*map(F.lit, sorted(SEEDS)))
    tokens = stored(
        parts.groupBy(*URLS, "n").agg(F.array_sort(F.collect_list("part")).alias("parts")).select(
            *URLS, "n", F.flatten(F.transform("parts", lambda p: F.transform(p["words"], lambda w: F.concat(p["kind"], w)))).alias("tokens"),
            F.exists("parts", lambda p: (p["kind"] == "h:") & F.arrays_overlap(p["words"], seeds)).alias("block"),
        ),
        "url-tokens",
    )
    n_block = tokens.where("block").agg(F.sum("n")).first()[0] or 0
    n_allow = (each.agg(F.sum("n")).first()[0] or 0) - n_block
    exploded = tokens.select(*URLS, "n", "block", F.explode("tokens").alias("token"))
    learnt = stored(exploded.groupBy("token").agg(F.sum(F.when(F.col("block"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(~F.col("block"), F.col("n")).otherwise(0)).alias("a")), "url-model")
    total_b, total_a, size = learnt.agg(F.sum("b"), F.sum("a"), F.count(F.lit(1))).first()
    bias = math.log((n_block + 1) / (n_allow + 1)) if n_block else -math.inf
    weight = F.log((F.col("b") + 1) / F.lit((total_b or 0) + max(size, 1))) - F.log((F.col("a") + 1) / F.lit((total_a or 0) + max(size, 1)))
    weights = learnt.select("token", weight.alias("weight"), (F.col("token").startswith("h:") & F.substring("token", 3, LONGEST).isin(*SEEDS)).alias("seed"))
    sums = exploded.join(few(weights), "token").groupBy(*URLS).agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("seed"), 0.0).otherwise(F.col("weight"))).alias("rest"))
    known = tokens.join(sums, URLS).select(*URLS, "tokens", "all", "rest")

    odds = lambda c: F.when(F.col("rule").isNull(), F.lit(bias) + F.coalesce(F.col(c), F.lit(0.0)))
    verdict = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    for r in rules:
        verdict = F.when(F.col("rule") == r.text, r.verdict).otherwise(verdict)
    out = urls.join(known, URLS, "left").withColumn("rule", ruled(F.col("host"), F.col("path"), rules)).withColumns({"log_odds": odds("all"), "rest_odds": odds("rest")})
    seen = F.when(F.col("rule").isNull(), F.coalesce("tokens", F.array().cast("array<string>")))
    return out.select(id_col, *URLS, "rule", verdict.alias("verdict"), "log_odds", "rest_odds", seen.alias("tokens"))
