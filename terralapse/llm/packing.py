"""Packing of documents into sequences of a fixed length, by hierarchical best fit.

1. Documents are encoded where they are read; only those longer than a sequence are cut.
   Pieces are packed best-fit-decreasing by windows of a task's own pieces, so no text and no ids move.
2. Nearly full sequences (``slack`` tokens left at most) are done. The rest are items of the
   next round: rounds join the items of ``fan_in`` times fewer tasks each, and pack them by best fit again,
   until one task has them all, or until tasks hold ``per_task`` items each and a new deal brings
   almost nothing. Sequences that not even the smallest item would fit into leave before each round.
3. A round says into which sequence an item went and how far from its start; these tables are
   joined backwards, and last to the pieces of sequences that moved.

Two sequences that are at most half full always fit together, so a window leaves at most one
such; what the rounds add is to bring these, and other remnants, together with fuller ones of other tasks.

Tokenizers must drop white space and never join text across it (others are refused), so the ids
of a text are those of its words, which each worker keeps as bytes.

Defined cases: null text is empty, hence a piece with the end token alone. Repeated rows are
documents of their own. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralapse.llm._arrow import Recent, as_bytes, slices, small_batches
from terralapse.llm.token_counts import _tokenizer, check_words
from terralapse.plans.storage import stored

#: Sequences of one task, and how many windows of pieces a task packs apart.
TASK_BITS = 40
#: A mark at the end of a word that stands as a token of its own after such a letter or digit (others may get a mark as they are normalized).
TAIL = re.compile(rb"[.,;:!?](?=\s|\Z)(?:(?<=[A-Za-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")
#: A further deal of as many tasks is made while it saves this share of the sequences.
WORTH = 0.01


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and place in it of each length (longest first, into the fullest bin that takes it), and the used part of each bin."""
    bins, places, used = [0] * len(lengths), [0] * len(lengths), []
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0  # of rooms that a bin has
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        if fits := mask >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = size, len(used)
            used.append(0)
        bins[i], places[i] = b, size - room
        used[b] += n
        if room := room - n:
            rooms[room].append(b)
            mask |= 1 << room
    return bins, places, used


class Words:
    """Ids of a text as little-endian bytes, by way of its words."""

    def __init__(self, path: str, cache_entries: int):
        self.library, self.cache = _tokenizer(path), Recent(cache_entries)
        # Where a mark at a word's end is a token of its own and case is nothing, words are remembered without both.
        apart = lambda a, b: self.encoded([a + b])[0] == b"".join(self.encoded([a, b]))
        self.tails = all(apart(w, m) for w in (b"word", "élé".encode(), b"x1", b"Abc") for m in (b".", b",", b";", b":", b"!", b"?"))
        self.folds = self.encoded([b"Word", b"ABC", b"xYz"]) == self.encoded([b"word", b"abc", b"xyz"])
        self.special = [t.content.encode().lower() for t in self.library.get_added_tokens_decoder().values()]

    def encoded(self, words: list[bytes]) -> list[bytes]:
        found = self.library.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def plain(self, text: bytes) -> bytes:
        """The text with the same ids whose words are fewer: small letters, and marks apart."""
        if self.folds:
            low = text.lower()  # of ASCII alone
            if not any(t in low for t in self.special):
                text = low
        return TAIL.sub(rb" \g<0>", text) if self.tails else text

    def ids(self, texts: list[bytes]) -> list[bytes]:
        split = [self.plain(t).split() for t in texts]
        known = self.cache.with_all(set().union(*split), self.encoded)
        return [b"".join(map(known.__getitem__, words)) for words in split]


@lru_cache(maxsize=2)
def _words(path: str, cache_entries: int) -> Words:
    return Words(path, cache_entries)


def packed_pieces(docs: DataFrame, path: str, end_id: int, size: int, slack: int, window: int, cache_entries: int) -> DataFrame:
    """id, piece, start, length, ids_crc32, bin, offset, used (tokens in the bin): packed by windows of each task's own pieces."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["piece", "start", "length", "ids_crc32", "bin", "offset", "used"]
    types = [pa.int32(), *[pa.int64()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _words(path, cache_entries), end_id.to_bytes(4, "little")
        first = TaskContext.get().partitionId() << TASK_BITS

        def flushed():
            bins, places, used = best_fit([r[3] for r in held], size)
            columns = [*zip(*held)]
            given = pa.array(columns[0], id_type)
            found = [columns[1], columns[2], columns[3], columns[4], [first + b for b in bins], places, [used[b] for b in bins]]
            for i in range(0, len(held), 8192):
                yield pa.RecordBatch.from_arrays([given[i : i + 8192], *(pa.array(c[i : i + 8192], t) for c, t in zip(found, types))], names=["id", *names])
            return len(used)

        held: list[tuple] = []
        for batch in slices(batches, "text"):
            id_type = batch.column(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), words.ids([t or b"" for t in as_bytes(batch.column(1))])):
                ids += end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, size)):
                    mine = ids[4 * start : 4 * (start + size)]
                    held.append((doc, k, start, len(mine) // 4, crc32(mine)))
                if len(held) >= window:
                    first += yield from flushed()
                    held = []
        if held:
            yield from flushed()

    return stored(docs.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, bin long, offset long, used long"), "pack-pieces")


def packed_again(items: DataFrame, tasks: int, turn: int, fan_in: int, size: int, per_task: int) -> DataFrame:
    """bin, used, into, shift, total: one round of best fit over bins as items, by ``tasks`` tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed():
            bins, places, used = best_fit(lengths, size)
            head: dict[int, int] = {}
            for name, b, place in zip(names, bins, places):
                if place == 0:
                    head[b] = name
            columns = [names, lengths, [head[b] for b in bins], places, [used[b] for b in bins]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["bin", "used", "into", "shift", "total"])

        names: list[int] = []
        lengths: list[int] = []
        for batch in batches:
            names += batch.column(0).to_pylist()
            lengths += batch.column(1).to_pylist()
            if len(names) >= per_task:
                yield flushed()
                names, lengths = [], []
        if names:
            yield flushed()

    origin = F.shiftright("bin", TASK_BITS)
    # Neighbours in the tree first; once every task is full, a new deal each time.
    node = F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(tasks)) if fan_in == 0 else F.floor(origin / fan_in)
    return stored(items.select("bin", "used").repartition(tasks, node).mapInArrow(run, "bin long, used long, into long, shift long, total long"), "pack-round")


def rounds(items: DataFrame, size: int, slack: int, fan_in: int, per_task: int) -> list[DataFrame]:
    """The rounds over items (bin, used) that aren't nearly full: each says where its items went."""
    done: list[DataFrame] = []
    open_items, reach, turn, last = items.where(F.col("used") < size - slack), 1, 0, False
    while True:
        told = open_items.agg(F.count(F.lit(1)).alias("n"), F.min("used").alias("least"), F.max(F.shiftright("bin", TASK_BITS)).alias("tasks")).first()
        if not told.n:
            return done
        open_items = open_items.where(F.col("used") + told.least <= size)
        n = open_items.count()
        if n < 2 or last:
            return done
        reach *= fan_in
        full = -(-n // per_task)
        tasks = max(full, told.tasks // reach + 1)
        dealt = 0 if tasks == full and full > 1 else reach
        found = packed_again(open_items, tasks, turn, dealt, size, per_task)
        done.append(found)
        turn += 1
        saved = found.where("shift > 0").count()
        last = tasks == 1 or (tasks == full and saved < WORTH * n)
        open_items = found.where("shift = 0").select("bin", F.col("total").alias("used")).where(F.col("used") < size - slack)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4096,
    end_id: int = 1,
    slack: int = 0,
    window: int = 1 << 16,
    fan_in: int = 8,
    per_task: int = 1 << 18,
    cache_entries: int = 1 << 20,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    small_batches(docs.sparkSession)
    check_words(tokenizer_path)
    name = lambda c: F.col(f"`{c.replace('`', '``')}`")
    given = docs.select(name(id_col).alias("id"), name(text_col).alias("text"))
    pieces = packed_pieces(given, tokenizer_path, end_id, size, slack, window, cache_entries)
    moved = None
    for found in reversed(rounds(pieces.where("offset = 0").select("bin", "used"), size, slack, fan_in, per_task)):
        now = found.where("shift > 0").select("bin", "into", "shift")
        if moved is not None:
            onward = moved.select(F.col("bin").alias("into"), F.col("into").alias("last"), F.col("shift").alias("more"))
            now = now.join(onward, "into", "left").select("bin", F.coalesce("last", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")).union(moved)
        moved = now
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32"]
    if moved is None:
        return pieces.select(*columns, F.col("bin").alias("sequence_id"), "offset")
    found = pieces.join(moved, "bin", "left")
    return found.select(*columns, F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
