"""Removes every byte covered by a ``length``-byte string that also starts in an earlier document.

Earlier means a smaller id; the first copy stays. Strings are compared as UTF-8 bytes and
never cross documents; matches are judged on the input.

**Meeting.** All copies of a string must meet in one task, without every string being sent.
Each window of ``length`` bytes names the gram inside it with the least hash; copies name
the same one. A *context* is a run of neighbouring windows that name one gram, as a string of
bytes; every window is in one context. Documents send a hash of the gram and a seal of the
context, packed by bucket of the gram; of the copies that a packet of documents holds only
the first goes there, the others are known to be covered. In a bucket, a context that an
earlier document has too is covered whole. Where a gram has several contexts, the first
document of each is asked for its bytes, and told about every place where it has them.

**Seals.** Whether two contexts are equal is decided by a seal of 124 bits: the values of
their bytes, as polynomials over the field of 2^31 - 1 elements, at four random points that
the driver draws anew for each call. Whatever the texts are, two different contexts (at most
80 bytes, and their length) have equal seals with a chance of at most (81 / 2^31)^4 < 2^-98.
Text made to collide can't be prepared, as the points aren't known beforehand.

**Suffix order.** The bytes of these contexts, in order of document, make a buffer for each
bucket. The suffixes that are windows are sorted to a depth of ``length`` bytes, eight at a
time, which also gives the common prefix of neighbours. The previous and the next smaller
value in suffix order (the nearest suffixes of an earlier document) and the least common
prefix on the way give the longest-previous-factor array; a window is covered if its entry
reaches ``length``.

**Removal.** What is covered goes back to the documents, whose bytes are read again.

Null text is empty: nothing to remove, and the digest of no bytes. Repeated rows, having
equal ids, are no copies of one another; null ids come after all others. Further columns of
the input are ignored, so their names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralapse.llm._arrow import flat, given_back, slices, small_batches
from terralapse.llm._shingles import BASE, BYTE, INVERSE, mix, powers
from terralapse.plans.storage import stored

U = np.uint64
GRAM = 20
#: Bytes handled at once; longer texts are cut into pieces that overlap.
PIECE = 1 << 17
NO_ID = (1 << 63) - 1
FIELD, LANES = (1 << 31) - 1, 4
#: Mask of a context whose windows are all covered.
WHOLE = -1


@dataclass(frozen=True)
class Points:
    """Where seals are taken: a point for the bytes and one for the size, for each lane."""

    at: tuple[tuple[int, int], ...]

    @classmethod
    def drawn(cls) -> Points:
        return cls(tuple((secrets.randbelow(FIELD - 2) + 2, secrets.randbelow(FIELD - 2) + 2) for _ in range(LANES)))


@lru_cache(maxsize=2 * LANES)
def field_powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) in the field."""
    out = np.ones(1, U)
    while len(out) < n:
        out = np.concatenate([out, out * U(pow(base, len(out), FIELD)) % U(FIELD)])
    return out[:n].astype(np.uint32)


class Contexts:
    """The contexts of some texts: their bounds [low, high), gram hashes, texts, and seals."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, length: int, points: Points | None = None):
        """raw: texts one after another; bounds: where they start, and the end."""
        self.raw, self.bounds, n, reach = raw, bounds, len(raw), length - GRAM
        self.low = self.high = self.owner = np.zeros(0, np.int64)
        self.gram, self.seal = np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64)
        if n < length:
            return
        size = max(PIECE + 8 * length, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[raw] * powers(BASE, size)[:n], out=sums[1:])
        grams = (sums[GRAM:] - sums[:-GRAM]) * powers(INVERSE, size)[: n - GRAM + 1]
        grams ^= grams >> U(29)
        grams *= U(0xBF58476D1CE4E5B9)
        key = (grams & ~U(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        # The least of reach + 1 neighbours, by doubling.
        span, least = 1, key
        while 2 * span <= reach + 1:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if (rest := reach + 1 - span) > 0:
            least = np.minimum(least[:-rest], least[rest:])
        named = least.astype(np.uint32)
        # Windows inside one text: those that start in its last length - 1 bytes aren't.
        inside = np.ones(len(named) + 1, bool)
        inside[-1] = False
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            inside[max(a, b - length + 1) : b] = False
        edge = np.ones(len(named) + 1, bool)
        edge[1:-1] = named[1:] != named[:-1]
        first = np.flatnonzero(inside[:-1] & (edge[:-1] | ~np.concatenate([[False], inside[:-2]])))
        last = np.flatnonzero(inside[:-1] & (edge[1:] | ~inside[1:]))
        self.low, self.high = first, last + length
        self.gram = mix(grams[named[first]])
        self.owner = np.searchsorted(bounds, first, side="right") - 1
        if points:
            lanes = []
            wide = raw.astype(np.uint64)
            for base, other in points.at:
                power = field_powers(base, size)
                np.cumsum(wide * power[:n], out=sums[1:])
                value = (sums[self.high] - sums[self.low]) % U(FIELD) * power[size - 1 - self.low] % U(FIELD)
                lanes.append((value + (self.high - self.low).astype(np.uint64) * U(other)) % U(FIELD))
            self.seal = np.stack([lanes[0] << U(31) | lanes[1], lanes[2] << U(31) | lanes[3]], 1)


def pieces(raw: np.ndarray, offsets: np.ndarray, length: int, points: Points | None = None, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Contexts]]:
    """Texts in groups of about PIECE bytes, long ones in overlapping pieces; without groups that have no ``wanted`` text.

    Gives, for each group: the number of each text in it, where its piece starts in ``raw``,
    how many contexts earlier pieces of it had, and the contexts.
    """
    n, margin, i = len(offsets) - 1, 2 * length, 0
    while i < n:
        a = int(offsets[i])
        if offsets[i + 1] - a <= PIECE:
            j = max(i + 1, int(np.searchsorted(offsets, a + PIECE, side="right")) - 1)
            if wanted is None or wanted[i:j].any():
                yield np.arange(i, j), offsets[i:j], np.zeros(j - i, np.int64), Contexts(raw[a : offsets[j]], offsets[i : j + 1] - a, length, points)
            i = j
            continue
        end, seen = int(offsets[i + 1]), 0
        for start in range(a, end, PIECE) if wanted is None or wanted[i] else ():
            low, high = max(a, start - margin), min(end, start + PIECE + margin)
            c = Contexts(raw[low:high], np.array([0, high - low]), length, points)
            yield np.array([i]), np.array([low]), np.array([seen]), c
            seen += len(c.low)
            if high == end:
                break
        i += 1


def numbered(c: Contexts, before: np.ndarray) -> np.ndarray:
    """The number of each context in its text."""
    at, counts = runs_of(c.owner)
    return np.arange(len(c.owner)) - np.repeat(at, counts) + before[c.owner]


def runs_of(*values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    n = len(values[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, n))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(hashes.astype(np.uint64, copy=False)) >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """As pmod gives it in Spark; keys are hashes already."""
    return keys % parts


def packed(place: np.ndarray, owner: tuple[np.ndarray, ...], columns: list[np.ndarray]) -> list[tuple]:
    """Rows (place, each of ``owner`` once for a run of it, the runs' lengths, columns) as bytes; a row for each place."""
    order = np.lexsort((owner[-1], place))
    place, owner, columns = place[order], [o[order] for o in owner], [c[order] for c in columns]
    starts, counts = runs_of(place)
    out = []
    for a, b in zip(starts.tolist(), (starts + counts).tolist()):
        at, k = runs_of(owner[-1][a:b])
        out.append((int(place[a]), *(o[a:b][at].tobytes() for o in owner), k.astype(np.uint32).tobytes(), *(c[a:b].tobytes() for c in columns)))
    return out


def batch_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if isinstance(rows[0][i], bytes) else pa.int32()) for i in range(len(names))], names=names)


def joined(rows: list, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind)


SENT = ["bucket", "ids", "keys", "counts", "numbers", "grams", "seals"]


def sent(docs: DataFrame, length: int, points: Points, buckets: int, entries: int = 1 << 17) -> DataFrame:
    """What documents send of their contexts, packed by bucket; rows without grams tell of contexts that are covered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def combined() -> pa.RecordBatch:
            doc_id, doc_key, number, gram, one, two = (np.concatenate([h[i] for h in held]) for i in range(6))
            order = np.lexsort((doc_id, two, one))
            at, counts = runs_of(one[order], two[order])
            later = np.zeros(len(one), bool)
            later[order] = doc_id[order] > np.repeat(doc_id[order[at]], counts)
            rows = []
            if later.any():
                of = np.flatnonzero(later)
                rows += [(b, b"", *rest, b"", b"") for b, *rest in packed(part_of(doc_key[of], buckets), (doc_key[of],), [number[of]])]
            of = np.flatnonzero(~later)
            seal = np.stack([one[of], two[of]], 1)
            rows += packed(bucket_of(gram[of], buckets), (doc_id[of], doc_key[of]), [number[of], gram[of].astype(np.uint32), seal])
            return batch_of(rows, SENT)

        for batch in slices(batches, "text"):
            doc_id, doc_key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key"))
            for texts, _, before, c in pieces(*flat(batch.column("text")), length, points):
                if len(c.low):
                    of = texts[c.owner]
                    held.append((doc_id[of], doc_key[of], numbered(c, before).astype(np.uint32), c.gram, c.seal[:, 0], c.seal[:, 1]))
                    size += len(of)
                if size >= entries:
                    yield combined()
                    held, size = [], 0
        if held:
            yield combined()

    return docs.mapInArrow(run, "bucket int, ids binary, keys binary, counts binary, numbers binary, grams binary, seals binary")


FOUND = ["part", "kind", "keys", "counts", "numbers"]
COVERED, ASKED = 0, 1


def compared(rows: DataFrame, parts: int) -> DataFrame:
    """For each part of the documents, of the partitions of ``sent``: contexts covered whole (kind 0), and those whose bytes are asked for (1)."""

    def of_parts(kind: int, keys: np.ndarray, numbers: np.ndarray) -> list[tuple]:
        return [(p, kind, *rest) for p, *rest in packed(part_of(keys, parts), (keys,), [numbers])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list] = {c: [] for c in SENT}
        for batch in batches:
            known = batch.filter(pa.compute.equal(pa.compute.binary_length(batch.column("grams")), 0))
            if known.num_rows:
                keys, counts, numbers = (known.column(c).to_pylist() for c in ("keys", "counts", "numbers"))
                yield batch_of(of_parts(COVERED, np.repeat(joined(keys, np.int64), joined(counts, np.uint32)), joined(numbers, np.uint32)), FOUND)
            batch = batch.filter(pa.compute.greater(pa.compute.binary_length(batch.column("grams")), 0))
            for c in SENT[1:]:
                columns[c] += batch.column(c).to_pylist()
        if not columns["ids"]:
            return
        counts = joined(columns["counts"], np.uint32)
        ids, keys = (np.repeat(joined(columns[c], np.int64), counts) for c in ("ids", "keys"))
        numbers, gram, seal = joined(columns["numbers"], np.uint32), joined(columns["grams"], np.uint32), joined(columns["seals"], np.uint64).reshape(-1, 2)
        columns.clear()
        order = np.lexsort((ids, seal[:, 1], seal[:, 0], gram))
        ids, keys, numbers, gram, seal = ids[order], keys[order], numbers[order], gram[order], seal[order]
        first, counts = runs_of(gram, seal[:, 0], seal[:, 1])
        covered = np.flatnonzero(ids > np.repeat(ids[first], counts))
        # Grams with several contexts that don't all start in one document: the first document of each is asked, for every place where it has the context.
        starts, many = runs_of(gram[first])
        low, high = np.minimum.reduceat(ids[first], starts), np.maximum.reduceat(ids[first], starts)
        asked = np.flatnonzero((ids == np.repeat(ids[first], counts)) & np.repeat(np.repeat(low < high, many), counts))
        for kind, of in ((COVERED, covered), (ASKED, asked)):
            if len(of):
                yield batch_of(of_parts(kind, keys[of], numbers[of]), FOUND)
        given_back()

    return rows.mapInArrow(run, "part int, kind int, keys binary, counts binary, numbers binary")


ABOUT = ["keys", "counts", "numbers", "masks"]


class Marks:
    """Numbers of contexts, and a mask for each (WHOLE without one), by document; of rows packed as above."""

    def __init__(self, rows: dict[str, list]):
        key, number = np.repeat(joined(rows["keys"], np.int64), joined(rows["counts"], np.uint32)), joined(rows["numbers"], np.uint32)
        mask = joined([np.full(len(n) // 4, WHOLE, np.int32).tobytes() if m is None else m for n, m in zip(rows["numbers"], rows["masks"])], np.int32)
        order = np.lexsort((number, key))
        self.number, self.mask = number[order], mask[order]
        starts, many = runs_of(key[order])
        self.slots = dict(zip(key[order][starts].tolist(), zip(starts.tolist(), (starts + many).tolist())))

    def of(self, keys: list[int], texts: np.ndarray, before: np.ndarray, c: Contexts) -> tuple[np.ndarray, np.ndarray]:
        """The marked contexts, and their masks."""
        which, masks = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for first, n in zip(*(x.tolist() for x in runs_of(c.owner))):
            owner = c.owner[first]
            a, b = self.slots.get(keys[texts[owner]], (0, 0))
            if a < b:
                low = int(before[owner])
                a, b = (a + int(x) for x in np.searchsorted(self.number[a:b], (low, low + n)))
                which.append(self.number[a:b].astype(np.int64) + (first - low))
                masks.append(self.mask[a:b])
        return np.concatenate(which), np.concatenate(masks)


def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Marks, list[int], pa.RecordBatch]]:
    """The documents of a partition of ``by_document``, a few at a time, with their keys and the marks of all."""
    rows: dict[str, list] = {c: [] for c in ABOUT}
    marks = None
    for batch in batches:
        n = batch.num_rows - int(batch.column("place").to_numpy(zero_copy_only=False).sum())
        for c in ABOUT if n else ():
            rows[c] += batch.column(c).slice(0, n).to_pylist()
        if batch.num_rows > n:
            marks = marks or Marks(rows)
            rows = {c: [] for c in ABOUT}
            for part in slices(iter([batch.slice(n)]), "text"):
                yield marks, part.column("key").to_pylist(), part


def by_document(about: DataFrame, docs: DataFrame, parts: int) -> DataFrame:
    """Documents and the rows about them, brought together by part; in a partition those rows come first.

    A text is sorted by Spark and never held with others; what is known about a part's
    documents is bounded by their texts.
    """
    of_docs = docs.select(F.pmod("key", F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("place"), "*", *(F.lit(None).cast("binary").alias(c) for c in ABOUT))
    rows = about.select("part", F.lit(0).alias("place"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema), *ABOUT)
    return rows.union(of_docs).repartitionById(parts, F.col("part")).sortWithinPartitions("place").drop("part")


GIVEN = ["bucket", "ids", "keys", "counts", "numbers", "sizes", "bytes"]


def given(docs: DataFrame, length: int, buckets: int, entries: int = 1 << 15) -> DataFrame:
    """The bytes that were asked for, of ``by_document``, packed by bucket of the gram; size 0 for a context that equals the one before it in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts_held, size = [], [], 0

        def combined() -> pa.RecordBatch:
            doc_id, doc_key, number, gram, sizes = (np.concatenate([h[i] for h in held]) for i in range(5))
            # What a document has in several places is sent once.
            names: dict[bytes, int] = {}
            name = np.array([names.setdefault(x, len(names)) for x in texts_held])
            beside_equal = np.lexsort((name, doc_key))
            at, _ = runs_of(doc_key[beside_equal], name[beside_equal])
            doc_id, doc_key, number, gram = (x[beside_equal] for x in (doc_id, doc_key, number, gram))
            sizes, ours = np.zeros_like(sizes), sizes[beside_equal]
            sizes[at] = ours[at]
            texts = [b""] * len(sizes)
            for i, j in zip(at.tolist(), beside_equal[at].tolist()):
                texts[i] = texts_held[j]
            place = bucket_of(gram, buckets)
            order = np.lexsort((doc_key, place))
            starts, counts = runs_of(place[order])
            rows = packed(place, (doc_id, doc_key), [number, sizes])
            return batch_of([(*r, b"".join([texts[i] for i in order[a : a + k].tolist()])) for r, a, k in zip(rows, starts, counts)], GIVEN)

        for marks, keys, batch in beside(batches):
            doc_id, doc_key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key"))
            wanted = np.array([k in marks.slots for k in keys])
            for texts, _, before, c in pieces(*flat(batch.column("text")), length, wanted=wanted):
                of = np.unique(marks.of(keys, texts, before, c)[0])
                if len(of):
                    own = texts[c.owner[of]]
                    held.append((doc_id[own], doc_key[own], numbered(c, before)[of].astype(np.uint32), c.gram[of], (c.high - c.low)[of].astype(np.uint8)))
                    raw = c.raw.tobytes()
                    texts_held += [raw[a:b] for a, b in zip(c.low[of].tolist(), c.high[of].tolist())]
                    size += len(of)
                if size >= entries:
                    yield combined()
                    held, texts_held, size = [], [], 0
        if held:
            yield combined()

    return docs.mapInArrow(run, "bucket int, ids binary, keys binary, counts binary, numbers binary, sizes binary, bytes binary")


def suffix_order(buffer: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of some suffixes by their first ``depth`` bytes (earlier in ``starts`` first on ties), and the common prefix of each with the one before it, at most ``depth``.

    Sorts by eight bytes at a time; each round only what is equal so far. The buffer goes on for ``depth`` bytes after each start.
    """
    n = len(starts)
    order, common = np.arange(n), np.zeros(n, np.int64)
    bytes_at = np.concatenate([buffer, np.zeros(8, np.uint8)])
    words = np.ndarray((len(buffer) + 1,), ">u8", bytes_at, 0, (1,))
    open_, group = np.arange(n), np.zeros(n, np.int64)  # places still equal, and the place where their group starts
    for at in range(0, depth, 8):
        if not len(open_):
            break
        word = words[starts[order[open_]] + at].astype(np.uint64)
        if depth - at < 8:
            word &= U((1 << 64) - (1 << 8 * (8 - depth + at)))
        inner = np.lexsort((order[open_], word, group))
        word, order[open_] = word[inner], order[open_][inner]
        follows = np.zeros(len(open_), bool)
        follows[1:] = group[1:] == group[:-1]
        differ = np.zeros(len(open_), np.uint64)
        differ[1:] = word[1:] ^ word[:-1]
        same = follows & (differ == 0)
        # Bytes that agree in a word: zero bytes at its head.
        heads = sum((differ < (U(1) << U(8 * k))).astype(np.int64) for k in range(1, 8)) + (differ == 0)
        common[open_[follows]] = at + np.minimum(heads, depth - at)[follows]
        new = ~same
        leader = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        keep = same | np.concatenate([same[1:], [False]])
        open_, group = open_[keep], leader[keep]
    return order, common


def nearest_smaller(value: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each place, the common prefix with the nearest place before it that has a smaller value (0: none, or under ``least``).

    All places jump at once: what lies between a place and the one that it points to is no smaller.
    """
    to, shared = np.arange(-1, len(value) - 1), common.copy()
    active = np.flatnonzero((to >= 0) & (shared >= least))
    shared[(to < 0) | (shared < least)] = 0
    while len(active := active[value[to[active]] >= value[active]]):
        next_, less = to[to[active]], np.minimum(shared[active], shared[to[active]])
        less[(next_ < 0) | (less < least)] = 0
        to[active], shared[active] = next_, less
        active = active[less > 0]
    return shared


def previous_factors(buffer: np.ndarray, starts: np.ndarray, value: np.ndarray, depth: int, least: int = 1) -> np.ndarray:
    """The longest-previous-factor array: how much of each suffix (at most ``depth``) another with a smaller value starts with; 0 for less than ``least``."""
    order, common = suffix_order(buffer, starts, depth)
    of = value[order]
    before = nearest_smaller(of, common, least)
    after = nearest_smaller(of[::-1], np.concatenate([common[1:], [0]])[::-1], least)[::-1]
    out = np.zeros(len(starts), np.int64)
    out[order] = np.maximum(before, after)
    return out


def ordered(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """For each part of the documents: masks of the contexts in the partitions of ``given``; bit j tells that window j is covered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list] = {c: [] for c in GIVEN}
        for batch in batches:
            for c in GIVEN[1:]:
                columns[c] += batch.column(c).to_pylist()
        if not columns["ids"]:
            return
        counts = joined(columns["counts"], np.uint32)
        ids, keys = (np.repeat(joined(columns[c], np.int64), counts) for c in ("ids", "keys"))
        numbers, size = joined(columns["numbers"], np.uint32), joined(columns["sizes"], np.uint8).astype(np.int64)
        buffer = joined(columns["bytes"], np.uint8)
        columns.clear()
        sent_once = size > 0
        ids, size = ids[sent_once], size[sent_once]
        order = np.argsort(ids, kind="stable")
        windows = (size - length + 1)[order]
        first = (np.cumsum(size) - size)[order]
        inner = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        factor = previous_factors(buffer, np.repeat(first, windows) + inner, np.repeat(ids[order], windows), length, length)
        hit = np.flatnonzero(factor == length)
        owner = np.repeat(order, windows)[hit]
        mask = np.zeros(len(size), np.int64)
        np.bitwise_or.at(mask, owner, np.int64(1) << inner[hit])
        mask = mask[np.cumsum(sent_once) - 1]
        some = np.flatnonzero(mask)
        if len(some):
            yield batch_of(packed(part_of(keys[some], parts), (keys[some],), [numbers[some], mask[some].astype(np.int32)]), ["part", "keys", "counts", "numbers", "masks"])
        given_back()

    assert GRAM < length <= GRAM + 30, "a mask has a bit for each window of a context"
    return rows.mapInArrow(run, "part int, keys binary, counts binary, numbers binary, masks binary")


def covered_bytes(marks: Marks, keys: list[int], raw: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of some texts are covered."""
    out = np.zeros(len(raw), bool)
    wanted = np.array([k in marks.slots for k in keys], bool)
    for texts, at, before, c in pieces(raw, offsets, length, wanted=wanted) if wanted.any() else ():
        which, mask = marks.of(keys, texts, before, c)
        whole = which[mask == WHOLE]
        low, high = [c.low[whole]], [c.high[whole]]
        which, mask = which[mask != WHOLE], mask[mask != WHOLE]
        for j in range(length - GRAM + 1):
            of = c.low[which[(mask >> j & 1).astype(bool)]] + j
            low.append(of)
            high.append(of + length)
        n = len(c.raw)
        depth = np.cumsum(np.bincount(np.concatenate(low), minlength=n + 1) - np.bincount(np.concatenate(high), minlength=n + 1))
        out[at[0] : at[0] + n] |= depth[:n] > 0
    return out


def without_repeats(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 50,
    carry: tuple[str, ...] = (),
    as_text: bool = False,
    bucket_bytes: int = 8 << 20,
) -> DataFrame:
    """id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the bytes that stay, one after another): one row per document.

    ``carry``: further columns to give back, none named like these. ``as_text``: kept is a
    string, without the rest of characters that lost some of their bytes.
    """
    spark, points = docs.sparkSession, Points.drawn()
    small_batches(spark)
    given_ = docs.select(F.struct(id_col, *carry).alias("given"), F.col(text_col).alias("text"))
    rows = given_.select(F.coalesce(F.col("given")[id_col].cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"), "given")
    # Rows are told apart by id and text, for there may be several without an id.
    rows = rows.select("id", F.xxhash64(F.lit(points.at[0][0]), "id", "text").alias("key"), "text", "given")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    own = rows.select("id", "key", "text")

    found = stored(compared(sent(own, length, points, parts).repartitionById(parts, F.col("bucket")), parts), "contexts")
    no_mask = F.lit(None).cast("binary").alias("masks")
    about = found.where(F.col("kind") == COVERED).select("part", "keys", "counts", "numbers", no_mask)
    asked = found.where(F.col("kind") == ASKED).select("part", "keys", "counts", "numbers", no_mask)
    if not asked.isEmpty():
        # A context has many suffixes, so these buckets are smaller.
        theirs = given(by_document(asked, own, parts), length, 4 * parts).repartitionById(4 * parts, F.col("bucket"))
        about = about.union(stored(ordered(theirs, length, parts), "masks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for marks, keys, batch in beside(batches):
            raw, offsets = flat(batch.column("text"))
            cover = covered_bytes(marks, keys, raw, offsets, length)
            opens = cover.copy()
            opens[1:] &= ~cover[:-1]
            heads = offsets[:-1][offsets[:-1] < len(raw)]
            opens[heads] = cover[heads]
            gone, spans = (np.concatenate([[0], np.cumsum(x)])[offsets] for x in (cover, opens))
            left = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((offsets - gone).astype(np.int32)), pa.py_buffer(raw[~cover])])
            removed = np.diff(gone)
            if as_text:
                left = pa.array([x.decode("utf-8", "ignore" if k else "strict") for x, k in zip(left.to_pylist(), removed)], pa.string())
            columns = [batch.column("given"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.diff(spans)), left]
            yield pa.RecordBatch.from_arrays(columns, names=["given", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = given_.schema["given"].dataType.simpleString()
    out = by_document(about, rows, parts).mapInArrow(run, f"given {kind}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
    return out.select("given.*", "n_bytes", "n_removed", "n_spans", "kept")


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    out = without_repeats(docs, id_col=id_col, text_col=text_col, length=length)
    return out.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM d WHERE n >= 50)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM w) WHERE first < doc_id),
step AS (SELECT doc_id, i, CASE WHEN i > 50 + lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS new FROM hit),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM step),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, k),
gap AS (
  SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM span
  UNION ALL SELECT doc_id, 0, min(a) FROM span GROUP BY 1),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (coalesce(b, n) - a) AS BIGINT)), '' ORDER BY a) AS h FROM gap JOIN d USING (doc_id) GROUP BY 1),
total AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM span GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN total USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
