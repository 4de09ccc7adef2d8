"""Alignment of two tokenizers against a brute-force one, with odd texts and any tier."""

import random
from collections import Counter
from hashlib import sha256

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
align = pytest.importorskip("terralapse.llm.align")

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = list("aaeeiinrstth    ..,,!'-_%$#|\n\t\r0159()[]<>\"&*/\\:;?@^~`+=éñüß▁“”…²　  \x85\x1c\x1f中日é̂\U0001f600\x00ﬁ") + ["  ", " \n", "\n ", "\t ", "<|endoftext|>", "<s>", "<0x0A>", "'s", "don't", "xxxxx", " 10", "the "]


def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def tokens(text):
    """((id, bytes), ...) of each side, or nothing."""
    a, b = libraries.cached
    if not text:
        return [], []
    letters = align.byte_letters()
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    return (left, right) if b"".join(x[1] for x in left) == whole == b"".join(x[1] for x in right) else ([], [])


libraries.cached = libraries()


def grouped(text):
    left, right = tokens(text)
    ends = lambda side: [sum(len(x[1]) for x in side[: k + 1]) for k in range(len(side))]
    ea, eb = ends(left), ends(right)
    out, last = [], 0
    for cut in sorted(set(ea) & set(eb)):
        out.append(([x[0] for x, e in zip(left, ea) if last < e <= cut], [x[0] for x, e in zip(right, eb) if last < e <= cut]))
        last = cut
    return out


def brute(texts):
    groups = {k: grouped(t) for k, t in texts.items()}
    links = {k: [(a, b) for x, y in g for a in x for b in y] for k, g in groups.items()}
    counts = Counter(p for x in links.values() for p in set(x))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    out = {}
    for k, g in groups.items():
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out[k] = (sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links[k]), text, sha256(text.encode()).hexdigest() if g else "", sum(counts[p] == most[p[0]] for p in links[k]), sum(counts[p] for p in links[k]))
    return out, counts, most


def given():
    rng = random.Random(4)
    texts = [None, "", " ", "\n", "▁", "a ▁ b", "x" * 700, "中" * 50, "The cat's 10 mats.", "The cat's 10 mats.", "  two  spaces \t\n end ", "tail\x1c", "!\x1c!"]
    texts += ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(150)]
    return dict(enumerate(texts))


@pytest.mark.parametrize("frequent, cache, parts", [(1 << 18, 1 << 18, 2), (5, 4, 3), (0, 1, 1)])
def test_align(spark, frequent, cache, parts):
    texts = given()
    want, counts, most = brute(texts)
    table = spark.createDataFrame([(k, t, 1, "x", [1]) for k, t in texts.items()], "doc_id long, text string, row long, `a.b` string, n array<int>").repartition(parts)
    found = align.align(table, A, B, keep_groups=True, frequent=frequent, cache_entries=cache)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.groups_sha256, r.n_best, r.count_sum) for r in found.documents.collect()}
    assert got == want
    assert {(r.a, r.b): (r.docs, r.best) for r in found.pairs.collect()} == {p: (n, n == most[p[0]]) for p, n in counts.items()}


def test_odd_tables(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), A, B).documents.count() == 0
    some = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "`d.i` string, `te``xt` string")
    got = align.align(some, A, B, id_col="d.i", text_col="te`xt").documents
    assert got.columns == ["d.i", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted((r["d.i"], r.n_a, r.count_sum) for r in got.collect()) == [(None, 0, 0), (None, 2, 4), (None, 2, 4)]
    with pytest.raises(ValueError, match="byte-level"):
        align.ByteLevel(public_tokenizers.path("word_bpe_49k.json"))


def test_cuts_fuzz():
    rng = random.Random(8)
    a, b = align.encoders(A, B, 1 << 12)
    left, right = libraries.cached
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts = [t for t in texts if t] + ["\n\nnext\nline\n", "a\n\nb", "end \nx", "\n", " " * 300_000, "\ufffea b", "-b c", "b -c"]
    assert a.fast
    for text, x, y in zip(texts, a.ids(texts), b.ids(texts)):
        assert x.tolist() == left.encode(" " + text, add_special_tokens=False).ids, text
        assert y.tolist() == right.encode(text), text


def shown(text):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in grouped(text))


def test_parts_meet_duckdb_once(monkeypatch):
    given, intervals = [], align.intervals
    monkeypatch.setattr(align, "intervals", lambda *a: given.append(t := intervals(*a)) or t)
    held = align.Known(align.ByteLevel(A), align.Pieces(B), 1 << 12)
    texts = ["The cat's on 10 mats.\nThe mats", "mats.\nThe cat's", "10 10 10 on", ""] * 30
    want = [shown(t) for t in texts]
    for _ in range(2):
        rows, pairs = align.aligned_batch(texts, held, True)
        assert rows["groups"] == want
    # Seven parts in 420 places: the tokens of each are joined once.
    assert sum(t.num_rows for t in given) == sum(len(side) for side in tokens("The cat's on 10 mats. mats\nThe"))
    assert len(given) == 2


@pytest.mark.parametrize("room", [1 << 12, 50, 1])
def test_parts_fuzz(room):
    rng = random.Random(room)
    held = align.Known(align.ByteLevel(A), align.Pieces(B), room)
    letters = LETTERS + ["\n\n", "\n\n\n", "￾", "￿", " ￾", "\n￿", "x" * 70, " " * 5]
    for _ in range(4):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(300)] + ["a\n", "a ", "a\n\n", "\n" * 90 + "b"]
        rows, pairs = align.aligned_batch(texts, held, True)
        assert rows["groups"] == [shown(t) for t in texts]
        counts = Counter(p for t in texts for p in {(a, b) for x, y in grouped(t) for a in x for b in y})
        assert {(a, b): n for a, b, n in zip(*(x.tolist() for x in pairs))} == counts


def test_parts_with_other_bytes():
    a = align.ByteLevel(A)
    (one,) = a.ids(["cat"])
    a.strings = align.pa.array([b"dog" if [i] == one.tolist() else e for i, e in enumerate(a.entries)], align.pa.large_binary())
    held = align.Known(a, align.Pieces(B), 1 << 12)
    texts = ["the cat sat", "the dog sat", "cat", "dog cat dog", "sat"]
    for _ in range(2):
        rows, _ = align.aligned_batch(texts, held, True)
        assert rows["groups"] == ["", shown("the dog sat"), "", "", shown("sat")]
        assert rows["n_a"].tolist() == [0, 3, 0, 0, len(tokens("sat")[0])] and rows["groups_sha256"][0] == ""
