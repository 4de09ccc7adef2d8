"""Alignment of two tokenizers over a corpus: which tokens of one stand for which of the other.

Tokens are byte intervals of the same text. Texts are cut where neither tokenizer can have a token go on (before a
space or line end that follows something else than white space), so no group crosses a cut, and a part is aligned once
for all the texts that have it. In every Arrow batch the two token tables of the parts not met lately go
to DuckDB: an ASOF join of ends finds the places where both tokenizers end a token, a window
sum gives each token of A its group, an ASOF join (a range join with the groups' ends) each token of B,
and a join by group gives the parts' links. A join of the texts' parts with these gives the texts' links.
The batch then yields a row for each document and one with the batch's
own count of documents for each id pair; Spark adds up these partial counts.

Each document's links then look up their pair's count: first in a broadcast table of the
most frequent pairs (``frequent``, a tier and no cut), and what that lacks in a join with all pairs.
A pair outside the tier is rare, so no key of that join is hot.

Tokenizer A is a byte-level one of the tokenizers library, B a SentencePiece model with byte
pieces that puts a space before each text; A gets that space too. Each worker keeps the parts met lately. The bytes
and ends of every part's tokens are checked; texts with a part that fails, and all texts where the tokenizers
don't allow cuts, are encoded and aligned as they are.

Defined cases: texts that are null or empty, or whose token bytes aren't those of the text after a space,
have no tokens, zeros and an empty ``groups``. Repeated rows are documents of their own.
Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralapse.llm import pieces
from terralapse.llm._arrow import flat, slices, small_batches
from terralapse.plans.storage import stored

ROW_BITS = 40
#: Stand before parts that aren't words but given as they are, and before texts that aren't cut; no characters.
RAW, WHOLE = "\ufffe", "\uffff"
#: A space or line end before which a text can't be cut, and places where it can.
UNCUT, CUT = re.compile(r"\s[ \n]"), re.compile(r"(?<=\S)(?=[ \n])")
#: Stands before parts when they are encoded.
FILL = " a"
#: Parts of at most so many characters are encoded and kept with others, so many at once.
SHORT, TOGETHER = 64, 256
#: Fixed value: how byte-level tokenizers of the library cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of texts; ``entries``: the bytes of each id."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.sizes = np.array([len(e) for e in entries], np.int32)
        self.strings = pa.array(entries, pa.large_binary())

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text after a space."""
        raise NotImplementedError

    def counted(self, ids: np.ndarray, raw: bytes, ends: np.ndarray) -> np.ndarray | None:
        """How many of the ids make up each part of ``raw`` (parts end at ``ends``); none if their bytes are others or a token crosses an end."""
        if flat(self.strings.take(pa.array(ids)))[0].tobytes() != raw:
            return None
        e = np.cumsum(self.sizes[ids])
        at = np.searchsorted(e, ends)
        return np.diff(at + 1, prepend=0) if (e[at] == ends).all() else None


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: visible ones for themselves, the rest from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel(Encoder):
    """A byte-level tokenizer of the tokenizers library; where its file allows, tiktoken does the work on the same vocabulary.

    That needs an own ``normalizer`` of none, words cut by WORDS, and ids in the order of merges (checked).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        said = json.loads(self.library.to_str())
        split, model = said["pre_tokenizer"] or {}, said["model"]
        if split.get("type") != "ByteLevel":
            raise ValueError(f"{path}: not a byte-level tokenizer")
        letters = byte_letters()
        words = self.library.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            entries[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
        super().__init__(entries)
        vocabulary = model["vocab"]
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        singles = [vocabulary[c] for c in letters]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self.fast = None
        if plain and split.get("use_regex") and not split.get("add_prefix_space") and not said["normalizer"] and made == sorted(set(made)) and max(singles) < made[0]:
            from tiktoken import Encoding

            self.fast = Encoding("own", pat_str=WORDS, mergeable_ranks={entries[i]: i for i in [*singles, *made]}, special_tokens={})

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [self.one(" " + t) for t in texts]

    def one(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
            except ValueError:  # white space too long for its pattern
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)


class Pieces(Encoder):
    """A SentencePiece model."""

    def __init__(self, path: str):
        model = pieces.vocabulary(path)
        self.library = library = model.library
        super().__init__([bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace(pieces.SPACE, " ").encode() for i, p in ((i, library.id_to_piece(i)) for i in range(library.vocab_size()))])
        # No piece goes on after a space mark that follows another character, and line ends stand alone.
        self.cuts = model.cut is not None and not any("\n" in p and len(p) > 1 for p in model.ids)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int32) for x in self.library.encode(texts, num_threads=1)]


@lru_cache(maxsize=1)
def _database():
    return duckdb.connect(config={"threads": 1})


def intervals(joined: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """Tokens of all parts one after another: part (``doc``), id and where they end, by bytes from the start of the first (a token starts where the one before ends)."""
    e = np.cumsum(sizes[joined], dtype=np.int64)
    return pa.table({"doc": np.repeat(np.arange(len(counts), dtype=np.int32), counts), "id": joined, "e": e.astype(np.int32) if len(e) and e[-1] < 1 << 31 else e})


#: More tokens of one side make a group large.
LARGE = 8
#: Parts end where both tokenizers end a token, so groups never cross them and one number serves all parts of a call.
#: Tokens of large groups are counted by id before they are paired; the others, nearly all, are paired as they are.
STEPS = (
    "CREATE OR REPLACE TEMP TABLE met AS SELECT a.doc, a.id, a.e, coalesce(b.e = a.e, false) AS cut FROM a ASOF LEFT JOIN b ON a.e >= b.e",
    "CREATE OR REPLACE TEMP TABLE ga AS SELECT doc, id, e, cut, CAST(sum(CAST(cut AS INTEGER)) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING) - CAST(cut AS INTEGER) AS INTEGER) AS g FROM met",
    "CREATE OR REPLACE TEMP TABLE gb AS SELECT b.id, g.g FROM b ASOF JOIN (SELECT e, g FROM ga WHERE cut) g ON b.e <= g.e",
    "CREATE OR REPLACE TEMP TABLE links AS SELECT doc, a, b, CAST(sum(n) AS BIGINT) AS n FROM ("
    " SELECT x.doc, x.id AS a, y.id AS b, 1 AS n FROM ga x JOIN gb y ON x.g = y.g WHERE x.g NOT IN (FROM large)"
    " UNION ALL SELECT x.doc, x.id, y.id, x.n * y.n FROM (SELECT doc, g, id, count(*) AS n FROM ga WHERE g IN (FROM large) GROUP BY ALL) x"
    " JOIN (SELECT g, id, count(*) AS n FROM gb WHERE g IN (FROM large) GROUP BY ALL) y ON x.g = y.g) GROUP BY ALL",
)
#: The links of each text: those of its parts.
TEXTS = "CREATE OR REPLACE TEMP TABLE texts AS SELECT doc, pair, CAST(sum(o.n * l.n) AS BIGINT) AS n FROM (SELECT doc, part, count(*) AS n FROM parts GROUP BY ALL) o JOIN held l USING (part) GROUP BY ALL"


def shown(a: pa.Table, b: pa.Table, groups: list[np.ndarray], sizes: list[np.ndarray], parts: int, table: tuple[pa.Array, int]) -> tuple[np.ndarray, np.ndarray]:
    """Each part's groups as `;a1,a2|b1;a3|b2,b3`: all bytes, and where each part starts and the last ends. ``groups`` of all tokens and their ``sizes`` on each side. ``table``: each id after each of `,;|`."""
    words, width = table
    (doc_a, ids_a), (doc_b, ids_b) = ((t["doc"].to_numpy(), t["id"].to_numpy()) for t in (a, b))
    (group_a, group_b), (sizes_a, sizes_b) = groups, sizes
    first_a, first_b = np.diff(group_a, prepend=-1) != 0, np.diff(group_b, prepend=-1) != 0
    # Both sides come in order: a token's place is its own number and that of the other side's tokens before it.
    index = np.empty(len(ids_a) + len(ids_b), np.int64)
    index[np.arange(len(ids_a)) + (np.cumsum(sizes_b) - sizes_b)[group_a]] = ids_a + width * first_a
    index[np.arange(len(ids_b)) + np.cumsum(sizes_a)[group_b]] = ids_b + 2 * width * first_b
    every = np.arange(parts + 1)
    at = np.searchsorted(doc_a, every) + np.searchsorted(doc_b, every)
    raw, starts = flat(words.take(pa.array(index)))  # the bytes of all tokens, one after another
    return raw, starts[at]


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.held, self.n = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.held):
            wide = np.empty(2 * n, self.held.dtype)  # takes memory as it is filled
            wide[: self.n] = self.values
            self.held = wide
        self.held[self.n : n] = values
        self.n = n

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.n]


class Known:
    """Parts of texts with their alignment; those met first are aligned by DuckDB, and all are forgotten once ``room`` is taken."""

    def __init__(self, a: ByteLevel, b: Pieces, room: int):
        self.a, self.b, self.room = a, b, room
        self.cuts = a.fast is not None and b.cuts
        width = max(len(a.entries), len(b.entries))
        self.table = pa.array([f"{mark}{i}" for mark in ",;|" for i in range(width)], pa.large_string()), width
        self.forget()

    def forget(self) -> None:
        self.number, self.odd, self.long = {}, set(), set()
        #: n_a, n_b, n_groups of each part; where its shown groups and its links end; these.
        self.sums = [Grown(np.int64) for _ in range(3)]
        self.text_ends, self.link_ends = Grown(np.int64), Grown(np.int64)
        self.text, self.pair, self.n = Grown(np.uint8), Grown(np.int64), Grown(np.int64)
        for ends in (self.text_ends, self.link_ends):
            ends.add(np.zeros(1, np.int64))

    def parts(self, text: str) -> list[str]:
        """Words that a space precedes, lines' first words after their line end, or parts after RAW or WHOLE."""
        if not text:
            return []
        if not self.cuts or pieces.SPACE in text:
            return [WHOLE + text]
        if text[0] in " \n" or UNCUT.search(text) or RAW in text or WHOLE in text:
            return [RAW + p for p in CUT.split(" " + text)]
        return text.replace("\n", " \n").split(" ")

    def encoded(self, parts: list[str]) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
        """The parts whose tokens have their bytes, in some order, and for each side their ids and how many each part has."""
        told = {p: p[1:] if p[:1] == RAW else p if p[:1] == "\n" else " " + p for p in parts if p[:1] != WHOLE}
        # White space at an end isn't followed by another part: the two could share a token.
        many = [p for p, t in told.items() if len(t) <= SHORT and not t[-1].isspace()]
        alone = set(parts).difference(many)
        left = [many[i : i + TOGETHER] for i in range(0, len(many), TOGETHER)] + [[p] for p in parts if p in alone]
        good, ids, counts = [], ([np.zeros(0, np.int32)], [np.zeros(0, np.int32)]), ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        while left:
            runs, left = left, []
            strings = [[" " + x[0][1:]] if x[0][:1] == WHOLE else [FILL, *map(told.__getitem__, x)] for x in runs]
            texts = ["".join(x)[1:] for x in strings]
            for run, string, *both in zip(runs, strings, self.a.ids(texts), self.b.ids(texts)):
                each = [t.encode() for t in string]
                raw, ends = b"".join(each), np.cumsum([len(t) for t in each])
                found = [side.counted(x, raw, ends) for side, x in zip((self.a, self.b), both)]
                if any(n is None for n in found):
                    left += [[p] for p in run] if len(run) > 1 else []
                    continue
                good += run
                filled = len(string) - len(run)
                for side, (x, n) in enumerate(zip(both, found)):
                    ids[side].append(x[n[:filled].sum() :])
                    counts[side].append(n[filled:])
        return good, [(np.concatenate(x), np.concatenate(n)) for x, n in zip(ids, counts)]

    def learn(self, parts: list[str]) -> None:
        good, sides = self.encoded(parts)
        bad = list(set(parts).difference(good))
        self.odd.update(p for p in bad if p[:1] != WHOLE)
        self.long.update(p for p in parts if len(p) > SHORT)
        con, tokens = _database(), [intervals(*x, side.sizes) for x, side in zip(sides, (self.a, self.b))]
        for side, given in zip("ab", tokens):
            con.register(side, given)
        for step in STEPS[:-1]:
            con.execute(step)
        ends = con.execute("SELECT e FROM ga WHERE cut ORDER BY e").fetchnumpy()["e"]
        groups = [np.searchsorted(ends, t["e"].to_numpy()) for t in tokens]
        sizes = [np.bincount(g, minlength=len(ends)) for g in groups]
        con.register("large", pa.table({"g": np.flatnonzero(np.maximum(*sizes) > LARGE).astype(np.int32)}))
        con.execute(STEPS[-1])
        links = con.execute("SELECT doc, (CAST(a AS BIGINT) << 32) | b AS pair, n FROM links ORDER BY doc").fetchnumpy()
        for name in ("a", "b", "large"):
            con.unregister(name)
        text, starts = shown(*tokens, groups, sizes, len(good), self.table)
        n_groups = np.bincount(tokens[0]["doc"].to_numpy()[np.diff(groups[0], prepend=-1) != 0], minlength=len(good))
        none = np.zeros(len(bad), np.int64)
        for held, n in zip(self.sums, (sides[0][1], sides[1][1], n_groups)):
            held.add(np.concatenate([n, none]))
        self.text_ends.add(self.text.n + np.concatenate([starts[1:], none + len(text)]))
        self.link_ends.add(self.pair.n + np.searchsorted(links["doc"], np.arange(len(parts)), side="right"))
        self.text.add(text)
        self.pair.add(links["pair"])
        self.n.add(links["n"])
        first = self.sums[0].n - len(parts)
        self.number.update(zip([*good, *bad], range(first, self.sums[0].n)))

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' parts, one after another, and where each text's start and the last's end."""
        if max(self.sums[0].n, self.pair.n // 8, self.text.n // 64) >= self.room:
            self.forget()
        split, left = [self.parts(t) for t in texts], list(range(len(texts)))
        while left:
            if new := set().union(*(split[i] for i in left)).difference(self.number):
                self.learn(list(new))
            left = [i for i in left if not self.odd.isdisjoint(split[i])] if self.odd else []
            for i in left:
                split[i] = [WHOLE + texts[i]]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in split], dtype=np.int64)])
        found = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int32, starts[-1])
        # Long parts are for this call alone.
        for p in self.long:
            del self.number[p]
        self.odd -= self.long
        self.long = set()
        return found, starts

    def texts(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``shown`` gave for these parts: all bytes, and where each starts and the last ends."""
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.text_ends.n - 1, [None, pa.py_buffer(self.text_ends.values), pa.py_buffer(self.text.values)])
        return flat(held.take(pa.array(numbers)))

    def links(self, numbers: np.ndarray) -> pa.Table:
        """part, pair and n of the parts with these numbers."""
        ends = self.link_ends.values
        parts = np.flatnonzero(np.bincount(numbers))
        sizes = ends[parts + 1] - ends[parts]
        at = np.repeat(ends[parts] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return pa.table({"part": np.repeat(parts, sizes).astype(np.int32), "pair": self.pair.values[at], "n": self.n.values[at]})


@lru_cache(maxsize=2)
def known(a_path: str, b_path: str, cache_entries: int) -> Known:
    return Known(ByteLevel(a_path), Pieces(b_path), cache_entries)


def encoders(a_path: str, b_path: str, cache_entries: int) -> tuple[ByteLevel, Pieces]:
    held = known(a_path, b_path, cache_entries)
    return held.a, held.b


DOCUMENT = "row long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, partial boolean, a array<int>, b array<int>, n array<long>"


def aligned_batch(texts: list[str | None], known: Known, keep_groups: bool) -> tuple[dict, tuple]:
    """Columns of DOCUMENT for each text, and the batch's pairs with their numbers of documents."""
    numbers, starts = known.numbers([t or "" for t in texts])
    con, docs = _database(), np.arange(len(texts), dtype=np.int32)
    con.register("held", known.links(numbers))
    con.register("parts", pa.table({"doc": np.repeat(docs, np.diff(starts)), "part": numbers}))
    con.execute(TEXTS)
    links = con.sql("SELECT doc, list(CAST(pair >> 32 AS INTEGER)) AS a, list(CAST(pair & 4294967295 AS INTEGER)) AS b, list(n) AS n, CAST(sum(n) AS BIGINT) AS total FROM texts GROUP BY doc ORDER BY doc").to_arrow_table()
    pairs = con.execute("SELECT CAST(pair >> 32 AS INTEGER) AS a, CAST(pair & 4294967295 AS INTEGER) AS b, n FROM (SELECT pair, count(*) AS n FROM texts GROUP BY pair)").fetchnumpy()
    for name in ("held", "parts"):
        con.unregister(name)
    rows = {c: np.diff(np.concatenate([[0], np.cumsum(x.values[numbers])])[starts]) for c, x in zip(("n_a", "n_b", "n_groups"), known.sums)}
    raw, at = known.texts(numbers)
    text = [raw[i:j].tobytes()[1:] for i, j in zip(at[starts], at[starts[1:]])]
    rows["groups_sha256"] = [sha256(x).hexdigest() if x else "" for x in text]
    rows["groups"] = [x.decode() if keep_groups else None for x in text]
    # Texts without tokens have empty lists among the others.
    of, lists = links["doc"].to_numpy(), {c: links[c].combine_chunks() for c in ("a", "b", "n")}
    rows["n_links"], held = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    rows["n_links"][of] = links["total"].to_numpy()
    held[of] = np.diff(lists["a"].offsets.to_numpy())
    offsets = pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32))
    rows |= {c: pa.ListArray.from_arrays(offsets, x.flatten()) for c, x in lists.items()}
    return rows, (pairs["a"], pairs["b"], pairs["n"])


@dataclass(frozen=True)
class Alignment:
    #: id, n_a, n_b, n_groups, n_links, groups (if kept), groups_sha256, n_best, count_sum
    documents: DataFrame
    #: a, b, docs (how many documents hold the pair linked), best (no other b has more with this a)
    pairs: DataFrame


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False, frequent: int = 1 << 18, cache_entries: int = 1 << 19) -> Alignment:
    spark = docs.sparkSession
    small_batches(spark)
    name = lambda c: F.col(f"`{c.replace('`', '``')}`")
    given = docs.select(name(id_col).alias("id"), name(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    types = {"row": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(), "groups_sha256": pa.string(), "partial": pa.bool_(), "a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "n": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = known(a_path, b_path, cache_entries)
        row = TaskContext.get().partitionId() << ROW_BITS
        for batch in slices(batches, "text", 1 << 20):
            columns, pairs = aligned_batch(batch.column(1).to_pylist(), parts, keep_groups)
            n = batch.num_rows
            columns |= {"row": list(range(row, row + n)), "partial": [False] * n}
            row += n
            found = [columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], t) for c, t in types.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=["id", *types])
            if len(pairs[0]):
                last = {"partial": [True], "a": [pairs[0]], "b": [pairs[1]], "n": [pairs[2]]}
                yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.column(0).type), *(pa.array(last.get(c, [None]), t) for c, t in types.items())], names=["id", *types])

    both = stored(given.mapInArrow(run, f"id {kind}, {DOCUMENT}"), "align-documents")
    each = F.explode(F.arrays_zip("a", "b", "n")).alias("x")
    counts = both.where("partial").select(each).select("x.*").groupBy("a", "b").agg(F.sum("n").alias("docs"))
    counts = stored(counts, "align-counts")
    best = counts.groupBy("a").agg(F.max("docs").alias("most"))  # as many rows as A has ids at most
    pairs = stored(counts.join(F.broadcast(best), "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best")), "align-pairs")

    top = pairs.orderBy(F.desc("docs"), "a", "b").limit(frequent).toArrow()  # a tier: the rest is joined below
    keys = top["a"].to_numpy().astype(np.int64) << 32 | top["b"].to_numpy()
    order = np.argsort(keys)
    tier = spark.sparkContext.broadcast((np.append(keys[order], np.iinfo(np.int64).max), np.append(top["docs"].to_numpy()[order], 0), np.append(top["best"].to_numpy(zero_copy_only=False)[order], False)))
    kept = ["row", "n_a", "n_b", "n_groups", "n_links", *(["groups"] if keep_groups else []), "groups_sha256"]

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs_of, best_of = tier.value
        for batch in batches:
            lists = batch.column("a")
            sizes = np.diff(lists.offsets.to_numpy())
            of = np.repeat(np.arange(batch.num_rows), sizes)
            a, b, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("a", "b", "n"))
            key = a.astype(np.int64) << 32 | b
            at = np.searchsorted(keys, key)
            hit = keys[at] == key
            total, good = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, of[hit], n[hit] * docs_of[at[hit]])
            np.add.at(good, of[hit], n[hit] * best_of[at[hit]])
            miss = ~hit
            ends = np.concatenate([[0], np.cumsum(np.bincount(of[miss], minlength=batch.num_rows))]).astype(np.int32)
            left = [pa.ListArray.from_arrays(ends, pa.array(x[miss])) for x in (a, b, n)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(c) for c in kept), pa.array(good), pa.array(total), *left], names=["id", *kept, "n_best", "count_sum", "a", "b", "n"])

    told = ", ".join(f"{c} {'string' if c.startswith('groups') else 'long'}" for c in kept)
    hits = both.where("not partial").select("id", *kept, "a", "b", "n").mapInArrow(looked_up, f"id {kind}, {told}, n_best long, count_sum long, a array<int>, b array<int>, n array<long>")
    hits = stored(hits, "align-hits")
    rare = hits.select("row", each).select("row", "x.*").join(pairs, ["a", "b"])
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.col("docs")).alias("rare_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("rare_best"))
    found = hits.drop("a", "b", "n").join(rare, "row", "left")
    count = (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum")
    return Alignment(found.select(F.col("id").alias(id_col), *kept[1:], (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"), count), pairs)
