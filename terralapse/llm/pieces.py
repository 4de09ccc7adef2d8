"""Encoding and decoding with SentencePiece vocabularies of the merge type.

A text becomes symbols, one per character; an agenda holds each pair of adjacent
symbols whose joined string is in the vocabulary, ordered by score and then from
the left; the best pair is joined, its new neighbours enter the agenda, and pairs
that are no longer there are passed over. Characters outside the vocabulary
become byte pieces. Long parts of a text, and those with such characters, have a
heap each; the agendas of all short parts of a batch are rows of one matrix, and
every step joins the best pair of each row.

No piece goes on after a space mark that follows another character, so no pair
can cross such a place: a text is cut there (and at line ends, and between letters
and marks, where no piece has the two side by side), and every part is encoded alone. A bounded cache in each Python
worker keeps the parts met lately. In each Arrow batch, all parts that the cache
lacked go through the sentencepiece library too, and a difference fails the task.
Vocabularies for which the cut would be wrong are encoded whole.

Vocabularies must have the space mark and a piece for every byte; others are refused.

Null text counts as empty: no ids, and the empty string comes back. Repeated rows
are encoded one by one. Further columns of the input are ignored, so their names
can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terralapse.llm._arrow import Recent, slices

SPACE = "▁"
#: More than any piece's number, and the longest part whose agenda is a row.
FAR, ROW = 1 << 31, 24
LETTER = re.compile(r"[^\W\d_]")


class Vocabulary:
    """The pieces of a model file, and what to cut texts by."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = model = SentencePieceProcessor(model_file=path)
        pieces = [(i, model.id_to_piece(i)) for i in range(model.vocab_size())]
        self.ids = {p: i for i, p in pieces if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))}
        self.scores = {p: -model.get_score(i) for p, i in self.ids.items()}
        # One object each, however often the cache holds it.
        self.digits, self.numbers = [str(i) for i, _ in pieces], [i for i, _ in pieces]
        self.bytes = {int(p[3:5], 16): i for i, p in pieces if model.is_byte(i)}
        if SPACE not in self.ids or len(self.bytes) < 256:
            raise ValueError(f"{path} lacks the space mark or pieces for bytes")
        joined = "".join(p for p in self.ids if len(p) > 1)
        # Line ends and tabs stand alone if no longer piece has them.
        alone = "".join(c for c in "\n\t\r" if c not in joined)
        # Marks that no piece has beside a letter.
        beside = {c for p in self.ids for a, b in zip(p, p[1:]) for c, d in ((a, b), (b, a)) if LETTER.match(d)}
        marks = "".join(re.escape(c) for c in {p for p in self.ids if len(p) == 1} - beside if not LETTER.match(c) and c != SPACE and c not in alone)
        self.cut = None
        if not any(SPACE in p.lstrip(SPACE) for p in self.ids):
            other = f"(?![^{SPACE}{alone}{marks}])"
            word = rf"[^\W\d_]++{other}"
            mark = rf"|[{marks}]++(?:(?=[^\W\d_])|{other})" if marks else ""
            self.cut = re.compile((f"[{alone}]|" if alone else "") + f"{SPACE}*+(?:{word}{mark}|[^{SPACE}{alone}]+)|{SPACE}+")

        single = {p: i for p, i in self.ids.items() if len(p) == 1}
        self.by_char = np.full(0x110000, -1, np.int32)
        self.by_char[[ord(c) for c in single]] = list(single.values())
        # Pairs of pieces that make a piece: their key, what they make, and its place in the order of scores.
        place = {s: i for i, s in enumerate(sorted(set(self.scores.values())))}
        pairs = sorted((self.ids[p[:i]] * FAR + self.ids[p[i:]], n, place[self.scores[p]]) for p, n in self.ids.items() for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids)
        self.keys, self.made, self.place = (np.array([x[i] for x in pairs] + [last], np.int64) for i, last in enumerate((FAR * FAR, -1, FAR)))

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return self.cut.findall(marked) if self.cut else [marked]

    def encode(self, part: str) -> list[int]:
        """Ids of one part by the agenda."""
        symbols: list[str] = list(part)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        scores = self.scores
        agenda = [(s, i, i + 1, 2) for i in range(n - 1) if (s := scores.get(symbols[i] + symbols[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            _, i, j, size = heappop(agenda)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := scores.get(both := symbols[i] + symbols[k])) is not None:
                    heappush(agenda, (s, i, k, len(both)))
            if (h := before[i]) >= 0 and (s := scores.get(both := symbols[h] + symbols[i])) is not None:
                heappush(agenda, (s, h, i, len(both)))
        out = []
        for symbol in symbols:
            if symbol:
                if (number := self.ids.get(symbol)) is not None:
                    out.append(number)
                else:
                    out.extend(self.bytes[b] for b in symbol.encode())
        return out

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the order of scores (FAR: no piece) and piece of each pair; negative symbols are none."""
        key = left.astype(np.int64) * FAR + right
        at = np.searchsorted(self.keys, key)
        good = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(good, self.place[at], FAR), np.where(good, self.made[at], -1)

    def encode_rows(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts of one to ROW characters, all of them in the vocabulary."""
        sizes = np.array([len(p) for p in parts])
        width = int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        symbols = np.full((len(parts), width), -1, np.int32)
        symbols[inside] = self.by_char[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
        done: list = [None] * len(parts)
        rows = np.arange(len(parts))
        place, made = self.looked_up(symbols[:, :-1], symbols[:, 1:])
        while True:
            n, width = symbols.shape
            best = place.argmin(1) if width > 1 else np.zeros(n, np.int64)
            live = place[np.arange(n), best] < FAR if width > 1 else np.zeros(n, bool)
            for row, ids in zip(rows[~live].tolist(), symbols[~live].tolist()):
                done[row] = [x for x in ids if x >= 0]
            if not live.any():
                return done
            rows, symbols, place, made, best = rows[live], symbols[live], place[live], made[live], best[live]
            every, columns = np.arange(len(rows)), np.arange(width - 1)
            symbols[every, best] = made[every, best]
            # The right symbol of the pair goes, and with it the pair; its neighbours are looked up anew.
            symbols = np.take_along_axis(symbols, columns + (columns > best[:, None]), 1)
            gone = columns[:-1] + (columns[:-1] >= best[:, None])
            place, made = np.take_along_axis(place, gone, 1), np.take_along_axis(made, gone, 1)
            for at in (best - 1, best):
                ok = (at >= 0) & (at < width - 2)
                r, c = every[ok], at[ok]
                place[r, c], made[r, c] = self.looked_up(symbols[r, c], symbols[r, c + 1])

    def encode_all(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part; short ones in rows, by length."""
        out: list = [None] * len(parts)
        short = [i for i, p in enumerate(parts) if 0 < len(p) <= ROW]
        sizes = np.array([len(parts[i]) for i in short], np.int64)
        if short:
            known = self.by_char[np.frombuffer("".join(parts[i] for i in short).encode("utf-32-le"), np.uint32)]
            plain = np.minimum.reduceat(known, np.cumsum(sizes) - sizes) >= 0
            places, groups = np.array(short)[plain], -(-sizes[plain] // 4)
            for group in np.unique(groups):
                of = places[groups == group].tolist()
                for i, ids in zip(of, self.encode_rows([parts[i] for i in of])):
                    out[i] = ids
        return [self.encode(p) if ids is None else ids for p, ids in zip(parts, out)]

    def check(self, parts: list[str], encoded: list[list[int]]) -> None:
        """Each part alone, as the library encodes it; its own mark at the start of a text is taken off."""
        mark = self.ids[SPACE]
        # A line end first keeps the library's own mark apart from the part.
        given = self.library.encode(["\n" + p for p in parts], num_threads=1)
        head = [mark, self.bytes[10]] if "\n" not in self.ids else [mark, self.ids["\n"]]
        for part, ours, theirs in zip(parts, encoded, given):
            if theirs != head + ours:
                raise ValueError(f"the agenda and the library differ on {part!r}: {ours} and {theirs[2:]}")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def _cache(path: str, size: int) -> Recent:
    return Recent(size)


def encode_batch(path: str, texts: list[str], cache_entries: int) -> list[list[tuple[str, tuple[int, ...]]]]:
    """For each text its parts, as (ids joined by commas, ids)."""
    model, cache = vocabulary(path), _cache(path, cache_entries)
    split, known, ask = [model.parts(t) for t in texts], {}, []
    for part in set(chain.from_iterable(split)):
        if (value := cache.get(part)) is None:
            ask.append(part)
        else:
            known[part] = value
    if ask:
        encoded = model.encode_all(ask)
        if model.cut:
            model.check(ask, encoded)
        else:
            for part, ours in zip(ask, encoded):
                if model.library.encode(part[1:]) != ours:
                    raise ValueError(f"the agenda and the library differ on {part[:80]!r}")
        for part, ids in zip(ask, encoded):
            known[part] = value = (",".join([model.digits[i] for i in ids]), tuple([model.numbers[i] for i in ids]))
            if len(part) <= 64:
                cache.put(part, value)
    return [[known[p] for p in parts] for parts in split]


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", cache_entries: int = 1 << 20) -> DataFrame:
    """id, ``ids array<int>``: the token ids of every text, without begin or end ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 20):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            ids = [list(chain.from_iterable(x[1] for x in parts)) for parts in encode_batch(model_path, texts, cache_entries)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(ids: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ``decoded string``: the library's decode(ids); null ids give the empty string."""
    kind = ids.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = vocabulary(model_path).library.decode([x or [] for x in part.column(ids_col).to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    return ids.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded string")


def digests(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", cache_entries: int = 1 << 20) -> DataFrame:
    """id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encoding and decoding in one pass, so that ids never leave the worker."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = vocabulary(model_path).library
        for batch in slices(batches, text_col, 1 << 20):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            encoded = encode_batch(model_path, texts, cache_entries)
            ids = [list(chain.from_iterable(x[1] for x in parts)) for parts in encoded]
            back = library.decode(ids, num_threads=1) if ids else []
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([sha256(",".join(x[0] for x in parts).encode()).hexdigest() for parts in encoded], pa.string()),
                    pa.array([sha256(x.encode()).hexdigest() for x in back], pa.string()),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
