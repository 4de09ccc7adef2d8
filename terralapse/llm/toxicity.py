"""Toxicity by the nearest labelled examples.

Examples and texts are TF-IDF vectors over a chosen vocabulary of words and word
beginnings, and one more term that counts the words without any of these; the ``k`` examples
with the highest cosine vote, each with its cosine (and its class weight), which
gives a score between 0 and 1; the voters and the terms in common are the evidence.

Calibration: each example is scored by the others, as if it weren't one, and the log-odds of the
votes are mapped by the line that fits these scores to the labels (``fitted``).

The search is exact. Examples lie in an inverted index in blocks of ``block`` rows,
and for each term and block the index holds the largest weight. The dot product of a
text with these is a bound on every example of the block; a block is passed over for
every text whose k-th best cosine is above its bound. Blocks are taken from the highest bounds
(over a batch of texts) down.

Learning is bounded: at most ``per_class`` labelled documents of each class, chosen
by a hash of their id and weighted back to their share of all labels; the vocabulary
is every term that goes with label 1, is met in ``min_df`` examples and has a chi-squared
statistic of ``min_chi2`` at least. A word counts once, as the one of its terms with the highest
statistic (the longest on ties). For these counts, examples
with the same least hash over runs of four words count as one, so that a term is not
chosen for standing in many copies of one text. Document frequencies are those of the
examples, weighted. Index and vocabulary are broadcast; the examples bound their size, however
large the tables are.

A text without a word (null and empty texts too) gets the smoothed share of label 1
among all labels. Without any labels every score is 0.5. Among
neighbours with equal cosines those come first that do so in the order of labels and terms. Repeated rows are scored
one by one; a document with several labels counts once, with the highest. Further
columns of the input are ignored, so their names can't clash. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralapse.llm._arrow import Recent, slices, small_batches
from terralapse.plans.storage import stored

WORD = re.compile(r"[^\W\d_]+")


#: The term that stands for all words without a term of the vocabulary.
REST = "<rest>"
#: Its weight in place of an inverse document frequency: it tells how thinly the other terms are spread.
REST_WEIGHT = 1.0
#: Entries of the matrix of vectors that are searched for together.
AT_ONCE = 1 << 19


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def terms_of(word: str) -> list[str]:
    """The word itself and, for inflected and compound words, its beginnings of three to seven letters."""
    return [word[:40], *(f"^{word[:n]}" for n in range(3, min(8, len(word))))]


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def expit(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def fitted(odds: np.ndarray, labels: np.ndarray, weights: np.ndarray, hold: float = 1.0) -> tuple[float, float]:
    """Slope and shift that make log-odds fit labels best (logistic regression, Platt 1999), drawn to 1 and 0 with the force of ``hold`` examples.

    With fewer than 20 examples of a class, or a slope that isn't positive, they stay as they are.
    """
    if min((labels == y).sum() for y in (0, 1)) < 20:
        return 1.0, 0.0
    weights = weights * (len(weights) / weights.sum())
    start = np.array([1.0, 0.0])
    at, x = start, np.stack([odds, np.ones(len(odds))], 1)

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float(weights @ (np.logaddexp(0, z) - labels * z)) + hold * float(((at - start) ** 2).sum()) / 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (weights * (p - labels)) + hold * (at - start)
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + hold * np.eye(2), slope)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):  # a full step may overshoot
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


@dataclass
class Index:
    """Examples in blocks. Postings of (term, block) are a slice of ``rows`` and ``weights``."""

    names: list[str]
    idf: np.ndarray
    ids: list[int]
    labels: np.ndarray
    class_weight: np.ndarray
    block: int
    starts: np.ndarray  # [term, block] to [term, block + 1]
    rows: np.ndarray
    weights: np.ndarray
    most: np.ndarray  # [term, block]
    prior: float
    #: Slope and shift of the log-odds of votes, see ``fitted``.
    curve: tuple[float, float] = (1.0, 0.0)

    def __post_init__(self):
        self.vocabulary = {t: i for i, t in enumerate(self.names[:-1])}
        self.rest, self.blocks, self.cache = len(self.names) - 1, {}, Recent(1 << 17)

    def __reduce__(self):
        return type(self), tuple(getattr(self, f.name) for f in fields(self))

    @classmethod
    def build(cls, names: list[str], df: list[float], total: float, examples: list[tuple[int, int, list[int], list[int]]], weight: dict[int, float], block: int) -> Index:
        """names and df: of the vocabulary, with REST last. examples: id, label, terms, times."""
        idf = np.log((1 + total) / (1 + np.array(df, float))) + 1
        idf[-1] = REST_WEIGHT
        prior = (sum(weight[e[1]] for e in examples if e[1]) + 0.5) / (sum(weight[e[1]] for e in examples) + 1)
        # Like examples together, so that bounds differ between blocks.
        # Their ids only order examples that are equal in all else, so they never enter a score.
        full = sorted((e for e in examples if e[2]), key=lambda e: (e[1], max((idf[t] * n, t) for t, n in zip(e[2], e[3])), list(e[2]), list(e[3]), e[0]))
        n_blocks = -(-len(full) // block)
        posting = []
        for row, (_, _, terms, tf) in enumerate(full):
            w = (1 + np.log(tf)) * idf[terms]
            w /= math.sqrt(float(w @ w))
            posting += [(t, row // block, row % block, x) for t, x in zip(terms, w)]
        posting.sort()
        keys = np.array([t * n_blocks + b for t, b, _, _ in posting], np.int64)
        starts = np.searchsorted(keys, np.arange(len(names) * n_blocks + 1))
        most = np.zeros((len(names), n_blocks))
        for t, b, _, x in posting:
            most[t, b] = max(most[t, b], x)
        labels = np.array([e[1] for e in full], np.int64)
        weights = np.array([weight[y] for y in labels.tolist()], np.float64)
        return cls(names, idf, [e[0] for e in full], labels, weights, block, starts, np.array([r for _, _, r, _ in posting], np.int64), np.array([x for *_, x in posting], np.float64), most, prior)

    def _block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a block, and their weights as a matrix of (term, row)."""
        if b not in self.blocks:
            n_blocks = self.most.shape[1]
            terms = np.flatnonzero(self.most[:, b] > 0)
            weights = np.zeros((len(terms), self.block))
            for i, t in enumerate(terms):
                lo, hi = self.starts[t * n_blocks + b], self.starts[t * n_blocks + b + 1]
                weights[i, self.rows[lo:hi]] = self.weights[lo:hi]
            self.blocks[b] = terms, weights
        return self.blocks[b]

    def nearest_many(self, vectors: list[list[tuple[int, int]]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector of (term, times): rows of the k examples with the highest positive cosine, and the cosines; lower rows first on ties.

        A block is multiplied with those vectors alone whose bound there reaches their k-th best cosine.
        """
        out: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, AT_ONCE // len(self.names))
        n_blocks = self.most.shape[1]
        bits = max(1, n_blocks * self.block).bit_length()
        if bits > 20:
            raise ValueError("too many examples for one index")
        for first in range(0, len(vectors), step):
            part = vectors[first : first + step]
            q = np.zeros((len(part), len(self.names)))
            for i, v in enumerate(part):
                for t, n in v:
                    q[i, t] = (1 + math.log(n)) * self.idf[t]
            q /= np.maximum(np.sqrt((q * q).sum(1)), 1e-300)[:, None]
            bounds = q @ self.most
            # Cosine (12 decimals) and row in one number: the largest are the nearest, and lower rows win ties.
            best = np.full((len(part), k), -1, np.int64)
            for b in np.argsort(-bounds.sum(0), kind="stable").tolist():
                least = (best[:, 0] >> bits) * 1e-12
                ask = np.flatnonzero((bounds[:, b] > 0) & (bounds[:, b] >= least - 2e-12))
                if not len(ask):
                    continue
                terms, weights = self._block(b)
                cosine = np.rint((q[np.ix_(ask, terms)] @ weights) * 1e12).astype(np.int64)
                row = b * self.block + np.arange(self.block)
                found = np.where(cosine > 0, (cosine << bits) | ((1 << bits) - 1 - row), -1)
                every = np.concatenate([best[ask], found], 1)
                best[ask] = np.partition(every, every.shape[1] - k, 1)[:, -k:]
            best = -np.sort(-best, 1)
            for line in best:
                line = line[line >= 0]
                out.append(((1 << bits) - 1 - (line & ((1 << bits) - 1)), (line >> bits) * 1e-12))
        return out

    def nearest(self, terms: list[int], tf: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_many([list(zip(terms, tf))], k)[0]

    def counted(self, text: str | None) -> list[tuple[int, int]]:
        """(term, times) of a text, in order of term; the cache keeps the terms of words met lately. A word counts once, as the first of its terms."""
        found: Counter = Counter()
        cache = self.cache
        for w, n in Counter(words_of(text or "")).items():
            if (term := cache.get(w)) is None:
                cache.put(w, term := min((self.vocabulary[t] for t in terms_of(w) if t in self.vocabulary), default=self.rest))
            found[term] += n
        return sorted(found.items())

    def share(self, rows: np.ndarray, near: np.ndarray, strength: float) -> float:
        """The part of the votes that is for label 1, with ``strength`` votes for the prior."""
        vote = near * self.class_weight[rows]
        return (float(vote @ self.labels[rows]) + strength * self.prior) / (float(vote.sum()) + strength)

    def shares_without(self, vectors: list[list[tuple[int, int]]], labels: list[int], k: int, strength: float) -> list[float]:
        """The same for examples, each as if it weren't one."""
        out = []
        for label, (rows, near) in zip(labels, self.nearest_many(vectors, k + 1)):
            own = np.flatnonzero((near > 1 - 1e-9) & (self.labels[rows] == label))[:1]
            out.append(self.share(np.delete(rows, own)[:k], np.delete(near, own)[:k], strength))
        return out

    def scores(self, texts: list[str | None], k: int, strength: float) -> list[tuple[float, list[int], list[float], list[str]]]:
        """Score, neighbours, their cosines, and the text's vocabulary terms."""
        each = [self.counted(t) for t in texts]
        # Texts without a term all have one direction, however long they are.
        lines = [[(self.rest, 1)] if len(v) == 1 and v[0][0] == self.rest else v for v in each]
        distinct = list({tuple(v): None for v in lines if v})
        slope, shift = self.curve
        known = {}
        for v, (rows, near) in zip(distinct, self.nearest_many([list(v) for v in distinct], k)):
            score = expit(slope * logit(self.share(rows, near, strength)) + shift)
            known[v] = score, [self.ids[r] for r in rows], [round(float(x), 6) for x in near], [self.names[t] for t, _ in v if t != self.rest]
        return [known[tuple(v)] if v else (self.prior, [], [], []) for v in lines]


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, per_class: int, min_df: int, min_chi2: float, block: int, k: int, strength: float) -> Index:
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1))
    counts = {r[0]: r[1] for r in known.groupBy(label_col).count().collect()}  # two rows
    picked = None
    for y, n in counts.items():
        # Half as many more by hash, to be sure; of these the first per_class, whatever the partitions.
        at = F.shiftrightunsigned(F.xxhash64(id_col), 2)
        near = known.where((F.col(label_col) == y) & (at < int((1 << 62) * min(1.0, 1.5 * per_class / n)))).select(id_col, F.col(label_col).alias("y"), at.alias("at"))
        part = near.orderBy("at", id_col).limit(per_class).drop("at")
        picked = part if picked is None else picked.union(part)
    if picked is None:
        return Index.build([REST], [0.0], 0.0, [], {}, block)
    picked = picked.groupBy(id_col).agg(F.max("y").alias("y"))
    # Bounded by two times per_class rows.
    sample = stored(docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(picked), id_col).groupBy(id_col, "y").agg(F.max("text").alias("text")), "toxicity-sample")
    taken = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    weight = {y: counts[y] / n for y, n in taken.items()}

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                words = words_of(text or "")
                kin = min((crc32(" ".join(words[i : i + 4]).encode()) for i in range(len(words))), default=0)
                rows += [(t, y, kin) for t in {t for w in set(words) for t in terms_of(w)}]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_pydict({"term": pa.array(columns[0], pa.string()), "y": pa.array(columns[1], pa.int32()), "kin": pa.array(columns[2], pa.int64())})

    with_y, n1, n0 = F.col("with_y"), float(taken.get(1, 0)), float(taken.get(0, 0))
    a, b = with_y, F.col("df") - with_y
    c, d = F.lit(n1) - a, F.lit(n0) - b
    chi2 = F.try_divide((n1 + n0) * F.pow(a * d - b * c, 2), (a + b) * (c + d) * n1 * n0)
    vocabulary = (
        sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(met, "term string, y int, kin long")
        .groupBy("term", "kin").agg(F.max("y").alias("y"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("with_y")).where(F.col("df") >= min_df)
        .withColumn("chi2", chi2).where((F.col("chi2") >= min_chi2) & (a * n0 > b * n1))
        .orderBy(F.desc("chi2"), F.desc(F.length(F.ltrim(F.col("term"), F.lit("^")))), "term").collect()  # at most the terms that the examples hold min_df times
    )
    names = [*(r.term for r in vocabulary), REST]
    df = [*(r.with_y * weight.get(1, 0) + (r.df - r.with_y) * weight.get(0, 0) for r in vocabulary), float(sum(counts.values()))]
    place = spark.sparkContext.broadcast(Index.build(names, df, 0.0, [], {}, block))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [place.value.counted(text) for text in batch.column("text").to_pylist()]
            columns = [pa.array([[x[i] for x in f] for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), *columns], names=["id", "y", "terms", "tf"])

    # At most two times per_class rows of at most as many entries as the vocabulary has.
    vector = stored(sample.select(F.col(id_col).cast("long").alias("id"), F.col("y").cast("int").alias("y"), "text").mapInArrow(vectors, "id long, y int, terms array<int>, tf array<int>"), "toxicity-vectors")
    index = Index.build(names, df, float(sum(counts.values())), [(r.id, r.y, r.terms, r.tf) for r in vector.collect()], weight, block)
    given = spark.sparkContext.broadcast(index)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_pylist()
            vectors = [list(zip(t, n)) for t, n in zip(batch.column("terms").to_pylist(), batch.column("tf").to_pylist())]
            odds = [logit(x) for x in given.value.shares_without(vectors, y, k, strength)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(odds, pa.float64())], names=["y", "odds"])

    # What the others say of each example, in groups of equal ones: no more rows than examples.
    told = vector.where(F.size("terms") > 0).mapInArrow(left_out, "y int, odds double").groupBy("y", F.round("odds", 3).alias("odds")).count().orderBy("odds", "y").collect()
    y, odds, n = (np.array([r[i] for r in told], float) for i in range(3))
    index.curve = fitted(np.repeat(odds, n.astype(int)), np.repeat(y, n.astype(int)), np.repeat([weight[int(v)] for v in y], n.astype(int))) if len(told) else (1.0, 0.0)
    return index


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    k: int = 15,
    strength: float = 0.5,
    per_class: int = 6000,
    min_df: int = 4,
    min_chi2: float = 30.0,
    block: int = 128,
) -> DataFrame:
    """id, ``score``, ``predicted``, and the evidence: ``neighbours``, ``cosines``, ``terms``. One row per document."""
    small_batches(docs.sparkSession)
    index = learn(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, per_class=per_class, min_df=min_df, min_chi2=min_chi2, block=block, k=k, strength=strength)
    given = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = given.value
        for batch in slices(batches, text_col):
            found = index.scores(batch.column(text_col).to_pylist(), k, strength)
            types = (pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.string()))
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *columns], names=[id_col, "score", "neighbours", "cosines", "terms"])

    scored = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, neighbours array<long>, cosines array<double>, terms array<string>")
    return scored.select(id_col, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "cosines", "terms")
