"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least ``threshold``.

Words are runs of characters outside space and U+0009 to U+000D, with A-Z in lower
case; a document's set is its distinct shingles of ``width`` words, with fewer words the
whole sequence as one. Without words it is empty and linked with nothing.

**Universe partition.** Sets are put into bands by size, which double. In a band, every
shingle is hashed to one of m segments of the universe. Two linked sets x and y, x the
larger, differ in at most H = (1 - t) / (1 + t) * 2 |x| shingles. Give each of x's
segments an allowance v: 0 passes it over, 1 finds the sets that are equal there, 2 also
those that differ by one shingle. If the allowances sum to more than H, some segment
must find y (pigeonhole; Deng, Li, Wen and Feng, An Efficient Partition Based Method for
Exact Set Similarity Joins, 2015). Indexed are the subsets of all segments that aren't
empty, and the one-deletion neighbourhoods of the designated ones (all segments of small
bands, one in ``one_in`` of the others). A set whose partners may lie in the band below
looks there too.

**Allocation by cost.** Subsets met once cost nothing. What is met by several sets makes
a list, whose hub is the member with the most company. First each set is compared with one
hub, which joins copies into components; lists inside one component cost nothing more. Of
the others each set passes over the dearest, as long as its allowances still sum to more
than H.

**Around a hub.** A crowd of sets that are all near one hub, and mostly just too far from
one another, would still make all pairs. So each member x of a hub's lists is told by its
difference D(x) from the hub. Two sets differ by |D(x)| + |D(y)| - 2 |D(x) & D(y)|, so
linked ones must share at least a = (|D(x)| + |D(y)| - q (|x| + |y|)) / 2 of their
differences, with q = (1 - t) / (1 + t). Members linked with the hub are one component
already; for the other pairs a is positive, and the first |D| - a + 1 differences of both,
in one order for the hub, must have one in common (prefix filter). Only these pairs, of
different components, are compared. Any order is right; a good one has rare differences
first, so what a few members of a large hub show to be common there goes last.

Sets whose allowances can't reach the sum (a matter of chance in hashing) are looked up by
prefix: a linked set holds one of the first n - ceil(t n) + 1 shingles of the set, n its size.

**Exactness.** Every candidate pair is verified on the two whole sets. Shingles are 64-bit
hashes under a key that is drawn anew for each call (see ``_shingles``): words of up to
eight bytes never collide, and two different shingles of a pair of texts are taken for one
with a chance of about 2^-64; equal sets are told by 128 bits of blake2b over the sorted
hashes. Texts made to collide can't be prepared, as the key isn't known beforehand.

Equal sets are one node, so groups of copies never make pairs. ``component_id`` is the
smallest id reachable by links. Null and empty texts have ``n_shingles`` 0 and are their
own component. Repeated rows are given back as often; equal ids should have equal texts.
Further columns of the input are ignored, so their names can't clash. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralapse.llm._arrow import as_bytes, flat, given_back, slices, small_batches
from terralapse.llm._shingles import drawn_key, flat_sets, groups, mix, shingle_sets
from terralapse.plans.graph import components
from terralapse.plans.storage import dropped, stored

U = np.uint64
#: The band below which all segments are designated.
SMALL = 64
#: Marks, in the sizes of a packet, sets that look into the band below their own.
LOWER = 1 << 31


def digest(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def node_of(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def segmented(tokens: np.ndarray, ends: np.ndarray, band: np.ndarray, one_in: int, least_segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some sets (sorted, one after another; ``ends`` has where each starts and the last ends), in a band for each:

    the signatures, their lowest bit telling designated segments; the set of each; and the sum of each set's allowances.
    """
    n = np.diff(ends)
    owner = np.repeat(np.arange(len(n)), n)
    m = np.maximum(np.int64(1) << band, least_segments).astype(np.uint64)
    segment = ((tokens >> U(32)) * m[owner]) >> U(32)
    new = np.ones(len(tokens), bool)
    new[1:] = (segment[1:] != segment[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    counts, of = np.diff(np.append(first, len(tokens))), owner[first]
    value = mix(tokens ^ U(0xA5A5A5A5A5A5A5A5))
    subset = np.add.reduceat(value, first) if len(first) else value
    place = mix(segment[first] * U(64) + band[of].astype(np.uint64))
    chosen = (place % U(one_in) == 0) | ((np.int64(1) << band[of]) < SMALL)
    signatures = (mix(subset ^ place) & ~U(1)) | chosen.astype(np.uint64)
    twice = chosen & (counts > 1)
    per_token = np.repeat(twice, counts)
    less = np.repeat(subset, counts)[per_token] - value[per_token]
    fewer = mix(less ^ np.repeat(place, counts)[per_token]) | U(1)
    allowances = np.bincount(of, minlength=len(n)) + np.bincount(of[twice], minlength=len(n))
    return np.concatenate([signatures, fewer]), np.concatenate([of, owner[per_token]]), allowances


def band_of(n: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(n, 1))[1].astype(np.int64) - 1


def looks_lower(n: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether a partner may be small enough for the band below."""
    return -(-n * t.numerator // t.denominator) < np.int64(1) << band_of(n)


def most_differing(n: np.ndarray, t: Fraction) -> np.ndarray:
    least = 2 * (1 - t) / (1 + t)
    return n * least.numerator // least.denominator


def batches_of_sets(batches: Iterator[pa.RecordBatch], width: int, key: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with a text, a few at a time, with the sets of their shingles."""
    for batch in slices(batches, "text"):
        raw, offsets = flat(batch.column("text"))
        for i, j in groups(offsets):
            yield batch.slice(i, j - i), *flat_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width, key)


def sets_of(docs: DataFrame, width: int, key: int, t: Fraction, one_in: int, least_segments: int) -> DataFrame:
    """(id, n, digest, node, slack, slack_lower): a row per document; digest is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, tokens, ends in batches_of_sets(batches, width, key):
            n = np.diff(ends)
            need = most_differing(n, t) + 1
            slack = np.where(n >= 3, segmented(tokens, ends, band_of(n), one_in, least_segments)[2] - need, 0)
            lower = segmented(tokens, ends, np.maximum(band_of(n) - 1, 0), one_in, least_segments)[2] - need
            ds = [digest(tokens[a:b]) if b > a else None for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            columns = [
                pa.array(n), pa.array(ds, pa.binary()), pa.array([None if d is None else node_of(d) for d in ds], pa.int64()),
                pa.array(slack.astype(np.int32), mask=n == 0), pa.array(lower.astype(np.int32), mask=(n < 3) | ~looks_lower(n, t)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "n", "digest", "node", "slack", "slack_lower"])

    return docs.mapInArrow(run, "id long, n long, digest binary, node long, slack int, slack_lower int")


PACKET = ["bucket", "nodes", "sizes", "runs", "signatures"]


def packets(docs: DataFrame, width: int, key: int, t: Fraction, one_in: int, least_segments: int, buckets: int, entries: int = 1 << 18) -> DataFrame:
    """(bucket, nodes, sizes, runs, signatures): the signatures of many sets, packed by bucket of the signature."""

    def packed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        nodes, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        before = np.cumsum([0] + [len(h[0]) for h in held])
        owner = np.concatenate([h[2] + k for h, k in zip(held, before)])
        signatures = np.concatenate([h[3] for h in held])
        bucket = ((signatures >> U(33)) * U(buckets) >> U(31)).astype(np.int32)
        order = np.lexsort((owner, bucket))
        bucket, owner, signatures = bucket[order], owner[order], signatures[order].astype(np.uint32)
        ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1
        out = []
        for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
            at = np.flatnonzero(np.concatenate([[True], owner[a + 1 : b] != owner[a : b - 1]]))
            of = owner[a:b][at]
            runs = np.diff(np.append(at, b - a)).astype(np.uint32)
            out.append((int(bucket[a]), nodes[of].tobytes(), sizes[of].tobytes(), runs.tobytes(), signatures[a:b].tobytes()))
        types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(types)], names=PACKET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, size = [], set(), 0
        for _, tokens, ends in batches_of_sets(batches, width, key):
            n = np.diff(ends)
            nodes, fresh = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
            for i in np.flatnonzero(n >= 3).tolist():  # smaller sets are linked with equal ones only
                d = digest(tokens[ends[i] : ends[i + 1]])
                if d not in seen:
                    seen.add(d)
                    nodes[i], fresh[i] = node_of(d), True
            for step, mark in ((0, 0), (1, LOWER)):
                take = fresh & looks_lower(n, t) if mark else fresh
                if take.any():
                    own = tokens[np.repeat(take, n)]
                    signatures, owner, _ = segmented(own, np.concatenate([[0], np.cumsum(n[take])]), band_of(n[take]) - step, one_in, least_segments)
                    held.append((nodes[take], (n[take] | mark).astype(np.uint32), owner, signatures))
                    size += len(signatures)
            if size >= entries:
                yield packed(held)
                held, seen, size = [], set(), 0
        if held:
            yield packed(held)

    return docs.select("text").mapInArrow(run, "bucket int, nodes binary, sizes binary, runs binary, signatures binary")


LISTS = "list long, node long, lower boolean, weight int"


def lists_of(rows: DataFrame) -> DataFrame:
    """The lists of the partitions of ``packets``: signatures met by several sets; those with the same members are one, its weight the sum.

    Weight 2 stands for a signature in a designated segment: passing it over may cost so much allowance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list] = {c: [] for c in PACKET}
        for batch in batches:
            for c in PACKET[1:]:
                columns[c] += batch.column(c).to_pylist()
        joined = lambda c, kind: np.frombuffer(b"".join(columns[c]), kind)
        runs = joined("runs", np.uint32)
        node, size, signature = np.repeat(joined("nodes", np.int64), runs), np.repeat(joined("sizes", np.uint32), runs), joined("signatures", np.uint32)
        columns.clear()
        order = np.argsort(signature, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], signature[order][1:] != signature[order][:-1]])) if len(order) else order
        counts = np.diff(np.append(starts, len(order)))
        order = order[np.repeat(counts > 1, counts)]
        node, signature, lower = node[order], signature[order], (size[order] & np.uint32(LOWER)).astype(bool)
        # By signature, then node; a node that comes twice (copies in other packets) stays once.
        order = np.lexsort((lower, node, signature))
        node, signature, lower = node[order], signature[order], lower[order]
        once = np.ones(len(node), bool)
        once[1:] = (signature[1:] != signature[:-1]) | (node[1:] != node[:-1])
        node, signature, lower = node[once], signature[once], lower[once]
        starts = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]])) if len(node) else order
        ends = np.append(starts[1:], len(node))
        found: dict[bytes, list] = {}  # by a digest of the members: where they stand, and the weight
        for a, b in zip(starts.tolist(), ends.tolist()):
            if b - a > 1 and not lower[a:b].all():  # two sets that both look from above meet in their own band
                key = blake2b(node[a:b].tobytes() + lower[a:b].tobytes(), digest_size=16).digest()
                found.setdefault(key, [a, b, 0])[2] += 2 if signature[a] & 1 else 1
        names = list(found)
        for i in range(0, len(names), 4096):
            part = [(int.from_bytes(k[:8], "little", signed=True), *found[k]) for k in names[i : i + 4096]]
            sizes = [b - a for _, a, b, _ in part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([p[0] for p in part], np.int64), sizes)),
                    pa.array(np.concatenate([node[a:b] for _, a, b, _ in part])),
                    pa.array(np.concatenate([lower[a:b] for _, a, b, _ in part])),
                    pa.array(np.repeat(np.array([p[3] for p in part], np.int32), sizes)),
                ],
                names=["list", "node", "lower", "weight"],
            )
        given_back()

    return rows.mapInArrow(run, LISTS)


def with_texts(pairs: DataFrame, texts: DataFrame, max_broadcast: int, members: int = 64) -> DataFrame:
    """pairs (a, b, ...) with text_a and text_b, rows of one a together. Texts are read again for the ids in pairs only.

    An a with many pairs is dealt to several places, each with about ``members`` of them and its text once.
    """
    few = pairs.count() <= max_broadcast
    places = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / members).alias("places"))
    pairs = pairs.join(F.broadcast(places) if few else places, "a").withColumn("place", F.pmod(F.xxhash64("b"), F.col("places"))).drop("places")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    one = wanted.withColumnsRenamed({"id": "b", "text": "text_b"}).join(F.broadcast(pairs) if few else pairs, "b")
    hubs = places.select(F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))
    own = texts.join(F.broadcast(hubs) if few else hubs, "id").withColumnsRenamed({"id": "a", "text": "text_a"})
    return one.join(own.hint("merge"), ["a", "place"]).drop("place")


class Hubs:
    """The set of the row's a, kept while a stays the same."""

    def __init__(self, width: int, key: int):
        self.width, self.key, self.last, self.set = width, key, None, None

    def of(self, a: int, text: bytes | None) -> np.ndarray:
        if self.last != a:
            self.last, self.set = a, shingle_sets([text or b""], self.width, self.key)[0]
        return self.set


def linked(pairs: DataFrame, texts: DataFrame, width: int, key: int, t: Fraction, max_broadcast: int, tag: str) -> DataFrame:
    """The pairs (a, b) of ids whose sets reach the threshold."""
    pairs = stored(pairs, tag)
    both = with_texts(pairs, texts, max_broadcast).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs = Hubs(width, key)
        for batch in slices(batches, "text_b"):
            a, keep = batch.column("a").to_pylist(), []
            texts = as_bytes(batch.column("text_a"))
            for i, theirs in enumerate(shingle_sets([x or b"" for x in as_bytes(batch.column("text_b"))], width, key)):
                own = hubs.of(a[i], texts[i])
                common = len(np.intersect1d(own, theirs, assume_unique=True))
                every = len(own) + len(theirs) - common
                keep.append(every > 0 and common * t.denominator >= every * t.numerator)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = stored(both.mapInArrow(run, "a long, b long"), f"{tag}-linked")
    dropped(pairs)
    return out


DIFFERENCES = "a long, b long, n int, asked boolean, c long, d int, e long, small int, large int, place int, token long"


def differences(members: DataFrame, texts: DataFrame, width: int, key: int, t: Fraction, max_broadcast: int) -> DataFrame:
    """The differences of each member b from its hub a that a prefix may need, of (a, b, n, asked, c, common).

    ``e`` is |D| - q |b| in units of the denominator of q: linked ones share at least
    (e + e') / 2. ``small`` and ``large`` are how many of the first differences count if the
    other's e is at least, or at most, as large; large is 0 for members linked with the hub.
    A row with place 0 stands for the link with the hub itself.
    """
    q = (1 - t) / (1 + t)
    up, down = q.numerator, q.denominator
    both = with_texts(members, texts, max_broadcast).select("a", "b", "n", "asked", "c", "common", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs = Hubs(width, key)
        for batch in slices(batches, "text_b", 1 << 20):
            a, common, texts = batch.column("a").to_pylist(), batch.column("common"), as_bytes(batch.column("text_a"))
            which, rows, tokens, places = [], [], [], []
            for i, theirs in enumerate(shingle_sets([x or b"" for x in as_bytes(batch.column("text_b"))], width, key)):
                own = hubs.of(a[i], texts[i])
                # First what the hub lacks, which is rarer among the members than what they lack of it.
                more = np.setdiff1d(theirs, own, assume_unique=True)
                often = np.isin(more, np.array(common[i].as_py(), np.int64).view(np.uint64)) if common[i].is_valid else np.zeros(len(more), bool)
                d = np.concatenate([more[~often], np.setdiff1d(own, theirs, assume_unique=True), more[often]])
                n, size = len(theirs), len(d)
                e = size * down - n * up
                far = size * down > up * (n + len(own))
                need = max(2 * e, up * len(own) + e)  # the other isn't linked with the hub, and no nearer
                small = size - max(1, -(-need // (2 * down))) + 1 if size else 0
                # The least e that another of a fitting size can have; by the triangle inequality it can't be much nearer the hub.
                most = n * t.denominator // t.numerator
                least = max(down, size * down - up * (n + most)) - up * most
                large = size - max(1, -(-(e + least) // (2 * down))) + 1 if far else 0
                count = max(small, large)
                head = (n, size, e, max(small, 0), max(large, 0))
                places.append(np.arange(0 if not far else 1, count + 1, dtype=np.int32))
                tokens.append(np.concatenate([np.zeros(0 if far else 1, np.int64), d[: max(count, 0)].view(np.int64)]))
                which.append(np.full(len(places[-1]), i))
                rows.append(head)
            at, head = np.concatenate(which), np.array(rows, np.int64)
            take = batch.select(["a", "b", "asked", "c"]).take(pa.array(at))
            n, size, e, small, large = head[at].T
            columns = [take.column("a"), take.column("b"), pa.array(n.astype(np.int32)), take.column("asked"), take.column("c"), *(pa.array(x.astype(k)) for x, k in ((size, np.int32), (e, np.int64), (small, np.int32), (large, np.int32))), pa.array(np.concatenate(places)), pa.array(np.concatenate(tokens))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DIFFERENCES.split(", ")])

    return both.mapInArrow(run, DIFFERENCES)


def common_of_hubs(members: DataFrame, texts: DataFrame, width: int, key: int, max_broadcast: int, large: int = 64, asked: int = 32, least: int = 4) -> DataFrame:
    """(a, common): what ``least`` of about ``asked`` members of a hub with many members have and the hub lacks. It decides an order, never a result."""
    big = members.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= large)
    # There are at most so many of them.
    big = F.broadcast(big) if members.count() // large <= max_broadcast else big
    few = stored(members.select("a", "b").join(big, "a").where(F.pmod(F.xxhash64("a", "b"), F.col("k")) < asked).select("a", "b"), "hub-samples")
    both = with_texts(few, texts, max_broadcast).select("a", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs = Hubs(width, key)
        for batch in slices(batches, "text_b"):
            a, texts, at, tokens = batch.column("a").to_pylist(), as_bytes(batch.column("text_a")), [], []
            for i, theirs in enumerate(shingle_sets([x or b"" for x in as_bytes(batch.column("text_b"))], width, key)):
                tokens.append(np.setdiff1d(theirs, hubs.of(a[i], texts[i]), assume_unique=True).view(np.int64))
                at.append(np.full(len(tokens[-1]), a[i]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.array(np.concatenate(tokens))], names=["a", "token"])

    seen = both.mapInArrow(run, "a long, token long").groupBy("a", "token").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least)
    return seen.groupBy("a").agg(F.collect_list("token").alias("common"))


def by_prefix(short: DataFrame, docs: DataFrame, width: int, key: int, t: Fraction) -> DataFrame:
    """(a, b): sets of ``short`` and those of docs that hold one of their first shingles, as many as one linked with them can't all lack."""

    def run(prefix: bool):
        def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, tokens, ends in batches_of_sets(batches, width, key):
                n = np.diff(ends)
                take = n - -(-n * t.numerator // t.denominator) + (n > 0) if prefix else n
                at = np.repeat(ends[:-1], take) + np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take)
                owner = np.repeat(np.arange(len(n)), take)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner)), pa.array(tokens[at].view(np.int64))], names=["id", "token"])

        return tokens_of

    few = short.mapInArrow(run(True), "id long, token long").withColumnRenamed("id", "a")
    every = docs.mapInArrow(run(False), "id long, token long").withColumnRenamed("id", "b")
    return few.join(every, "token").select("a", "b").distinct()


def near_copies(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: str = "3/4",
    one_in: int = 16,
    least_segments: int = 64,
    bucket_bytes: int = 8 << 20,
    max_broadcast: int = 200_000,
) -> DataFrame:
    """id, ``n_shingles`` and ``component_id``: one row per document."""
    t, key = Fraction(threshold), drawn_key()
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    sets = stored(sets_of(docs, width, key, t, one_in, least_segments), "sets")
    reps = stored(
        sets.where("n > 0").groupBy("digest", "node").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("slack").alias("slack"), F.min("slack_lower").alias("slack_lower")),
        "representatives",
    )
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    lists = lists_of(packets(docs, width, key, t, one_in, least_segments, buckets).repartitionById(buckets, F.col("bucket")))
    lists = lists.groupBy("list", "node", "lower").agg(F.sum("weight").cast("int").alias("weight"))
    member = stored(lists.join(reps.select("node", "rep", "n", "slack", "slack_lower"), "node").select("list", "rep", "n", "lower", "weight", F.when(F.col("lower"), F.col("slack_lower")).otherwise(F.col("slack")).alias("slack")), "lists")
    sizes = member.groupBy("list").agg(F.count(F.lit(1)).alias("size"))
    company = member.join(sizes, "list").groupBy("rep").agg(F.sum(F.col("weight") * F.col("size")).alias("company"))
    hubs = stored(member.where(~F.col("lower")).join(company, "rep").groupBy("list").agg(F.max_by("rep", F.struct("company", "rep")).alias("a")), "hubs")

    q = (1 - t) / (1 + t)
    size_fits = (F.col("na") * t.numerator <= F.col("nb") * t.denominator) & (F.col("nb") * t.numerator <= F.col("na") * t.denominator)
    numbers = reps.select("rep", "n")
    # First the hub that a set has most in common with.
    met = member.join(hubs, "list").where("a != rep").groupBy("rep", "a").agg(F.sum("weight").alias("w"))
    nearest = met.groupBy(F.col("rep").alias("b")).agg(F.max_by("a", F.struct("w", "a")).alias("a"))
    pairs = nearest.join(numbers.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b").join(numbers.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a").where(size_fits).select("a", "b")
    links = linked(pairs, docs, width, key, t, max_broadcast, "hub-pairs")
    known = components(links, "a", "b").withColumnRenamed("node", "rep")

    # Then the lists that still hold several components, without the dearest of each set.
    lists = member
    member = member.join(known, "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    mixed = member.groupBy("list").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("cost")).where("c0 != c1").select("list", "cost")
    by_cost = Window.partitionBy("rep", "lower").orderBy(F.desc("cost"), "list").rowsBetween(Window.unboundedPreceding, 0)
    open_ = stored(member.join(mixed, "list").withColumn("asked", F.sum("weight").over(by_cost) > F.col("slack")), "open-lists")
    some = open_.groupBy("list").agg(F.max("asked").alias("any")).where("any").select("list").join(hubs, "list")
    around = open_.join(some, "list").where("a != rep").groupBy("a", F.col("rep").alias("b")).agg(F.max("n").alias("n"), F.max("asked").alias("asked"), F.max("c").alias("c"))
    around = stored(around, "around-hubs")
    dropped(lists, hubs, open_)
    around, bare = stored(around.join(common_of_hubs(around, docs, width, key, max_broadcast), "a", "left"), "ordered-hubs"), around
    told = stored(differences(around, docs, width, key, t, max_broadcast), "differences")
    dropped(bare, around)
    links = links.union(told.where("place = 0").select("a", "b"))
    mark = lambda role, of: told.where(F.col("place").between(1, F.col(of))).select("a", "token", *(F.col(c).alias(c + role) for c in ("b", "n", "asked", "c", "d", "e", "place")))
    share = F.ceil((F.col("e0") + F.col("e1")) / (2 * q.denominator))
    reached = (F.col("place0") <= F.col("d0") - share + 1) & (F.col("place1") <= F.col("d1") - share + 1)
    fits = (F.col("n0") * t.numerator <= F.col("n1") * t.denominator) & (F.col("n1") * t.numerator <= F.col("n0") * t.denominator)
    nearer = (F.col("e0") < F.col("e1")) | (F.col("e0") == F.col("e1")) & (F.col("b0") < F.col("b1"))
    pairs = (
        mark("0", "small").join(mark("1", "large"), ["a", "token"])
        .where((F.col("c0") != F.col("c1")) & (F.col("asked0") | F.col("asked1")) & nearer & fits & reached)
        .select(F.least("b0", "b1").alias("a"), F.greatest("b0", "b1").alias("b")).distinct()
    )
    short = reps.where("slack < 0 or slack_lower < 0").select("rep", "n")
    if not short.isEmpty():
        met = by_prefix(docs.join(short.withColumnRenamed("rep", "id"), "id").select("id", "text"), docs.join(reps.select(F.col("rep").alias("id")), "id", "left_semi"), width, key, t)
        met = met.join(numbers.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a").join(numbers.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b")
        pairs = pairs.union(met.where(size_fits & (F.col("a") != F.col("b"))).select("a", "b")).distinct()
    links = links.union(linked(pairs, docs, width, key, t, max_broadcast, "list-pairs"))
    found = components(links, "a", "b")
    dropped(told)

    named = sets.join(reps.select("digest", "rep"), "digest", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)
"""
