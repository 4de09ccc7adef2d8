"""Sets of word shingles as 64-bit hashes, for many texts at a time.

Words are hashed eight bytes at a time by a chain of keyed bijections, so words of up to
eight bytes never collide and longer ones do with a chance of about 2^-64; shingles are sums
of their words' hashes with keyed odd factors, mixed again. The key is drawn anew for each
call of an operator, so texts that collide can't be prepared.
"""

from __future__ import annotations

import secrets
from functools import lru_cache
from hashlib import blake2b

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
#: Words of more bytes are hashed by blake2b, one by one.
LONG = 256
#: Bytes of text hashed at once, each of which takes some tens of bytes; a longer text is handled alone, in chunks of words.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits (the finalizer of SplitMix64)."""
    x = x + U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(256, dtype=np.uint64) + U(1 << 32))
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def drawn_key() -> int:
    return secrets.randbits(64)


@lru_cache(maxsize=2)
def factors(key: int, width: int) -> np.ndarray:
    """Odd numbers made of the key: one for each place of a shingle."""
    return mix(U(key) ^ (np.arange(1, width + 2, dtype=np.uint64) << U(40))) | U(1)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, in order, and where each text's words start and the last ones end."""
    n = len(raw)
    lower = np.concatenate([LOWER[raw], np.zeros(8, np.uint8)])
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SPACE[raw]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]  # a text's end parts words too
    opens[inner] = inside[1:-1][inner]
    closes[inner - 1] = inside[1:-1][inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    size = ends - starts
    blocks = np.ndarray((n + 1,), "<u8", lower, 0, (1,))
    out = mix(size.astype(np.uint64) ^ U(key))
    at, of = 0, np.flatnonzero(size <= LONG)
    while len(of):
        left = size[of] - at
        block = blocks[starts[of] + at]
        short = left < 8
        block[short] &= (U(1) << (U(8) * left[short].astype(np.uint64))) - U(1)
        out[of] = mix(out[of] ^ block)
        at += 8
        of = of[left > 8]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(blake2b(lower[starts[i] : ends[i]].tobytes(), key=key.to_bytes(8, "little"), digest_size=8).digest(), "little")
    return out, np.searchsorted(starts, offsets)


def words_of(raw: np.ndarray, offsets: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes``, of one long text in chunks that end at white space."""
    if len(raw) <= 2 * CHUNK or len(offsets) > 2:
        return word_hashes(raw, offsets, key)
    out, at = [], 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        while end < len(raw) and not len(gap := np.flatnonzero(SPACE[raw[end : end + CHUNK]])):
            end = min(end + CHUNK, len(raw))
        end = end if end == len(raw) else end + int(gap[0])
        out.append(word_hashes(raw[at:end], np.array([0, end - at]), key)[0])
        at = end
    every = np.concatenate(out)
    return every, np.array([0, len(every)])


def flat_sets(raw: np.ndarray, offsets: np.ndarray, width: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after another; and where each text's start and the last end.

    With fewer words than ``width`` the whole sequence is one.
    """
    w, first = words_of(raw, offsets, key)
    factor, counts = factors(key, width), np.diff(first)
    places = np.maximum(counts - width + 1, 0)
    sums = np.zeros(max(len(w) - width + 1, 0), np.uint64)
    for k in range(width):
        sums += w[k : k + len(sums)] * factor[k]
    # Of the places where a shingle starts, those whose words are all of one text; texts with few words get one of their own.
    few = np.flatnonzero((counts > 0) & (counts < width))
    places[few] = 1
    ends = np.concatenate([[0], np.cumsum(places)])
    inner = np.arange(ends[-1]) - np.repeat(ends[:-1], places)
    at = np.repeat(first[:-1], places) + inner
    whole = np.zeros(len(at), np.uint64)
    many = np.repeat(counts >= width, places)
    whole[many] = sums[at[many]]
    for n in range(1, width):
        of = few[counts[few] == n]
        if len(of):
            whole[ends[of]] = sum(w[first[of] + k] * factor[k] for k in range(n)) + U(n) * factor[width:]
    tokens = mix(whole)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        tokens[a:b].sort()
    keep = np.ones(len(tokens), bool)
    keep[1:] = tokens[1:] != tokens[:-1]
    keep[ends[:-1][ends[:-1] < len(tokens)]] = True
    return tokens[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def groups(offsets: np.ndarray, size: int = CHUNK):
    """Texts [i, j) of about ``size`` bytes together; a longer one alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j
        i = j


def shingle_sets(texts: list[bytes], width: int, key: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    out = []
    for i, j in groups(offsets):
        tokens, ends = flat_sets(np.frombuffer(b"".join(texts[i:j]), np.uint8), offsets[i : j + 1] - offsets[i], width, key)
        out += [tokens[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return out
