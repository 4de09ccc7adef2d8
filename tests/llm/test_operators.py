"""The text operators against brute force, round trips and held-out labels, on small tables with every awkward row."""

import gzip
import hashlib
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
llm = pytest.importorskip("terralapse.llm")

from terralapse.llm import _shingles, decontaminate, lang_id, ngram_join, pieces, quality, repeats, token_counts, toxicity, url_filter, warc  # noqa: E402
from terralapse.llm.queries import fold  # noqa: E402

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, score double, node long, id string, h long, marks string"
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def words(rng, n, vocabulary=600):
    return " ".join(f"{'abcdefghij'[k % 10]}{'xyzuvwrst'[k % 9]}{k}" for k in (rng.randrange(vocabulary) for _ in range(n)))


def changed(rng, text, share):
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base, passage, crowd = words(rng, 200), words(rng, 70), words(rng, 120)
    out = [None, "", " \n\t ", "one two", "One TWO", "a b c d e", "Ünïcode — “quotes” 中文 é̂ \u2581x\u00a0y 10% don't", base, base, base.upper()]
    out += [changed(rng, base, s) for s in (0.01, 0.02, 0.03, 0.05, 0.08)]
    out += [changed(rng, crowd, 0.02 + 0.002 * i) for i in range(25)]
    out += [words(rng, rng.randrange(3, 90)) + " " + passage + " " + words(rng, rng.randrange(3, 90)) for _ in range(12)]
    out += [words(rng, rng.randrange(1, 12), 6) for _ in range(40)]
    out += [words(rng, rng.randrange(60, 400)) for _ in range(30)]
    out += ["x" * 5000, "word " * 300, "line one here\nline two here\nline one here\n" * 10, words(rng, 20_000), "SHOUT " * 60 + "### $$$"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(3 * i + 1, t, "en", "s", 1, 0.5, 7, "x", 1, "m") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[7:9], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def by_id(texts):
    return {3 * i + 1: t for i, t in enumerate(texts)}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_token_counts(docs, by_id, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    special = "a<|endoftext|>b <|startoftext|> c"
    rows = docs.sparkSession.createDataFrame([(9000, special), (9001, "İstanbul ΣΑΣ\x1c\x85x"), (9002, "\x0b\x0c")], "doc_id long, text string")
    for table, known in ((docs, by_id), (rows, {r.doc_id: r.text for r in rows.collect()})):
        for entries in (1 << 16, 1):
            got = token_counts.token_counts(table, BPE, table_entries=entries, cache_entries=8 if entries == 1 else 1 << 16).collect()
            assert len(got) == table.count()
            for r in got:
                text = known[r.doc_id] or ""
                n = len(library.encode(text, add_special_tokens=False).ids)
                assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)
    assert token_counts.token_counts(empty, BPE).count() == 0


def test_pieces(docs, by_id, empty):
    library = pieces.vocabulary(PIECES).library
    got = pieces.digests(docs, PIECES, cache_entries=64).collect()
    ids = {r.doc_id: r.ids for r in pieces.encode(docs, PIECES).collect()}
    back = {r.doc_id: r.decoded for r in pieces.decode(pieces.encode(docs, PIECES), PIECES).collect()}
    assert len(got) == docs.count()
    for r in got:
        want = library.encode(by_id[r.doc_id] or "")
        assert ids[r.doc_id] == want and back[r.doc_id] == library.decode(want)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), sha(",".join(map(str, want))), sha(library.decode(want)))
    assert pieces.digests(empty, PIECES).count() == 0 and pieces.encode(empty, PIECES).count() == 0


def test_pieces_fuzz():
    rng, model = random.Random(3), pieces.vocabulary(PIECES)
    letters = list("aaeeiinrstth   ..,,!'-_%$#|\n\t\r0159()[]<>\"&*/\\:;?@^~`+=éñüß▁“”…²\u3000中日é̂\U0001f600\x00ﬁ")
    some = ["word.", "U.S.", "e.g.", "www.abc.com", "a_b", "10%", "THE", "l'été", "foo(bar)", "x" * 40, "<s>", "<0x0A>"]
    given = ["".join(rng.choice(letters) if rng.random() < 0.6 else rng.choice(some) for _ in range(rng.randrange(30))) for _ in range(3000)]
    got = pieces.encode_batch(PIECES, given, 1 << 16)
    for text, parts, want in zip(given, got, model.library.encode(given)):
        assert [i for p in parts for i in p[1]] == want
        for part in model.parts(text):
            if 0 < len(part) <= pieces.ROW:
                assert model.encode_all([part])[0] == model.encode(part)


def test_quality(docs, by_id, empty):
    got = {r.doc_id: r for r in quality.quality(docs, sample_docs=20).collect()}
    for k, text in by_id.items():
        w = (text or "").encode().split()
        windows = Counter(zip(w, w[1:], w[2:]))
        inside = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        chars = sum(len(x.decode()) for x in w)
        bad = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        want = (len(w), chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), bad)
        assert (got[k].n_words, got[k].word_chars, got[k].n_symbols, got[k].n_dup_lines, got[k].n_repeat_words, got[k].base_failed) == want
        assert got[k].kept == (not bad and not any(r.rejects(quality.Text((text or "").encode())) for r in quality.RULES))
    assert quality.quality(empty).count() == 0


def shingle_set(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(sets):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("options", [{}, {"one_in": 1, "max_broadcast": 0, "bucket_bytes": 1 << 14}])
def test_near_copies(docs, by_id, empty, options):
    sets = {k: shingle_set(t) for k, t in by_id.items()}
    want = brute_components(sets)
    got = ngram_join.near_copies(docs, **options).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    assert len(set(want.values())) < len(want) - 10
    if not options:
        assert ngram_join.near_copies(empty).count() == 0


def test_a_set_without_allowance(spark):
    """Sets whose segments can't hold the pigeonhole are compared with all of their sizes."""
    rng = random.Random(8)
    base = [words(rng, 12) for _ in range(30)]
    near = [b + " tail" for b in base]
    docs = spark.createDataFrame(list(enumerate(base + near)), "doc_id long, text string")
    original = ngram_join.most_differing
    sets = {k: shingle_set(t) for k, t in enumerate(base + near)}
    want = brute_components(sets)
    for options in ({}, {"least_segments": 1, "one_in": 1 << 40}, {"least_segments": 1, "one_in": 1 << 40, "max_broadcast": 0}):
        got = {r.doc_id: r.component_id for r in ngram_join.near_copies(docs, **options).collect()}
        assert got == want and original(8, ngram_join.Fraction(3, 4)) == 2


def test_words_that_a_power_of_two_cannot_tell(spark):
    """Two words on which every polynomial modulo 2^64 agrees (Thue and Morse), and words of a few letters."""
    rows, word = [], "a"
    while len(word) < 4096:
        word += (other := word.translate(str.maketrans("ab", "ba")))
        if len(word) >= 1024:
            rows += [word, word.translate(str.maketrans("ab", "ba"))]
    rows += ["é", "è", "a", "b", "ab", "ba", "aaaaaaaa", "aaaaaaaab", "baaaaaaaa"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = ngram_join.near_copies(docs).collect()
    assert len(got) == len(rows) > 12 and all(r.component_id == r.doc_id and r.n_shingles == 1 for r in got)


@pytest.mark.parametrize("chunk", [1 << 18, 64])
def test_shingle_sets(chunk, monkeypatch):
    monkeypatch.setattr(_shingles, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(60):
        pick = lambda: rng.choice("aB \n\tcé") if rng.random() < 0.5 else rng.choice(["word", "wordword" * 3, "x" * 300, "y" * 600, " "])  # noqa: B023, E731
        given = ["".join(pick() for _ in range(rng.choice([0, 1, 2, 4, 5, 6, 20, 300]))) for _ in range(rng.randrange(8))]
        sets = _shingles.shingle_sets([t.encode() for t in given], 5, _shingles.drawn_key())
        plain = [shingle_set(t) for t in given]
        assert [len(x) for x in sets] == [len(x) for x in plain] and all((x[1:] > x[:-1]).all() for x in sets)
        assert all(len(set(x) & set(y)) == len(a & b) for x, a in zip(sets, plain) for y, b in zip(sets, plain))


def brute_repeats(by_id, length):
    seen, out = set(), {}
    for k in sorted(by_id):
        b = (by_id[k] or "").encode()
        windows = [b[i : i + length] for i in range(len(b) - length + 1)]
        cover = bytearray(len(b))
        for i, w in enumerate(windows):
            if w in seen:
                cover[i : i + length] = b"\1" * length
        seen.update(windows)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out[k] = (len(b), sum(cover), spans, sha(bytes(x for x, c in zip(b, cover) if not c)))
    return out


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 1 << 14}])
def test_repeats(docs, by_id, empty, options, monkeypatch):
    if options:
        monkeypatch.setattr(repeats, "PIECE", 1 << 12)
    want = brute_repeats(by_id, 50)
    got = repeats.without_repeats(docs, **options).collect()
    assert len(got) == docs.count() and sum(x[1] for x in want.values()) > 1000
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) == want[r.doc_id]
    if not options:
        assert repeats.digests(empty).count() == 0
        carried = repeats.without_repeats(docs, carry=("lang", "source"), as_text=True)
        assert carried.columns == ["doc_id", "lang", "source", "n_bytes", "n_removed", "n_spans", "kept"] and carried.where("lang != 'en'").count() == 0


def test_repeats_of_contexts_that_a_document_has_twice(spark):
    """A document's own repeats aren't removed, but what an earlier one has of them is: in every place."""
    rng = random.Random(16)
    base = ["".join(rng.choice("abcdefgh ijkl\n") for _ in range(rng.randint(30, 300))) for _ in range(8)] + ["ab" * 40, "abc" * 60]
    rows = {}
    for k in range(60):
        parts = [rng.choice(base) for _ in range(rng.randint(0, 6))]
        text = "".join(p[rng.randint(0, len(p) // 2) :][: rng.randint(1, 200)] for p in parts)
        rows[k * 7 - 100] = text + "x" + text
    want = brute_repeats(rows, 50)
    got = repeats.digests(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and sum(x[1] for x in want.values()) > 1000


def test_repeats_without_ids(spark):
    """Rows without an id come after all others and are no copies of one another, whatever their texts."""
    rng = random.Random(6)
    shared, own = words(rng, 40), [words(rng, 40) for _ in range(3)]
    rows = [(None, own[0] + " " + shared), (None, own[1]), (4, shared), (None, own[1] + " " + own[2]), (9, own[2]), (9, own[2])]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = {(r.doc_id, r.n_bytes): r.n_removed for r in got}
    size = lambda t: len(t.encode())
    assert len(got) == 6 and removed[(4, size(shared))] == removed[(9, size(own[2]))] == removed[(None, size(own[1]))] == 0
    assert removed[(None, size(rows[0][1]))] >= size(shared) and removed[(None, size(rows[3][1]))] >= size(own[2])


def brute_factors(buffer, starts, value, depth):
    strings = [bytes(buffer[s : s + depth]) for s in starts]
    shared = lambda a, b: next((k for k in range(depth) if a[k] != b[k]), depth)
    return [max((shared(a, b) for b, w in zip(strings, value) if w < v), default=0) for a, v in zip(strings, value)]


@pytest.mark.parametrize("kind", ["random", "periodic", "rare"])
def test_previous_factors(kind):
    import numpy as np

    rng = random.Random(kind)
    for _ in range(120):
        n, depth, period = rng.randrange(1, 60), rng.choice([1, 3, 7, 8, 9, 15, 16, 17, 20]), rng.choice([1, 2, 3])
        letter = {"random": lambda i: rng.randrange(2), "periodic": lambda i: i % period, "rare": lambda i: rng.randrange(256) if rng.random() < 0.1 else 7}[kind]
        buffer, starts = np.array([letter(i) for i in range(n + depth)], np.uint8), np.arange(n)
        value = np.array([rng.randrange(rng.choice([2, 5, 100])) for _ in range(n)])
        want = brute_factors(buffer, starts, value, depth)
        assert repeats.previous_factors(buffer, starts, value, depth).tolist() == want
        assert repeats.previous_factors(buffer, starts, value, depth, depth).tolist() == [x if x == depth else 0 for x in want]


def test_seals_tell_what_a_power_of_two_cannot():
    """Strings on which any polynomial modulo 2^64 agrees (Thue and Morse), and others that differ in one byte or in length."""
    import numpy as np

    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    points = repeats.Points.drawn()
    seen = {}
    for text in (word, other, "a" * 60, "a" * 61, "a" * 59 + "b", "\0" * 60, "\0" * 61):
        raw = np.frombuffer(text.encode(), np.uint8)
        c = repeats.Contexts(raw, np.array([0, len(raw)]), 50, points)
        for a, b, seal in zip(c.low, c.high, c.seal.tolist()):
            assert seen.setdefault(tuple(seal), raw[a:b].tobytes()) == raw[a:b].tobytes()
    assert len(seen) == len(set(seen.values())) > 20


def test_contained(spark, docs, by_id, empty):
    rng = random.Random(4)
    long = by_id[max(k for k, t in by_id.items() if t and t.count(" ") > 10_000)].split(" ")
    items = [(1, " ".join(long[500:530])), (2, " ".join(long[900:925]) + " other words"), (3, words(rng, 40)), (4, None), (5, ""), (6, "one two"), (7, " ".join(long[50:90:2])), (1, " ".join(long[500:530]))]
    table = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, id string")
    sets = {k: {" ".join(x.decode() for x in s) for s in shingle_set((t or "").lower())} for k, t in by_id.items()}
    own = {i: {" ".join(x.decode() for x in s) for s in shingle_set((t or "").lower())} for i, t in items}
    want = {(d, i): (len(s & o), len(o)) for d, s in sets.items() for i, o in own.items() if o and 100 * len(s & o) >= 75 * len(o)}
    for limit in (200_000, 0):
        got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontaminate.contained(docs, table, max_broadcast=limit).collect()}
        assert got == want
    assert {i for _, i in want} == {1, 2, 6}
    assert decontaminate.contained(empty, table).count() == 0 and decontaminate.contained(docs, table.where("false")).count() == 0


def test_languages(spark, empty):
    rng = random.Random(6)
    parts = {"en": ["th", "and", "ing", "er", "ou"], "de": ["sch", "ung", "ein", "ich", "ä"], "fr": ["eau", "que", "è", "oi", "ment"]}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, make(lang, rng.randrange(30, 200)), lang) for i, lang in enumerate(rng.choice(list(parts)) for _ in range(240))]
    odd = [(900, None, "en"), (901, "", "de"), (902, "12 %%", "fr"), (903, make("de", 3000), None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    train = docs.where("doc_id % 4 != 2")
    got = {r.doc_id: r for r in lang_id.identify(docs, train).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"] and got[900].rejected and all(0 <= r.score <= 1 for r in got.values())
    assert lang_id.identify(empty, train).count() == 0 and {r.lang_pred for r in lang_id.identify(docs, train.where("false")).collect()} == {"und"}
    with pytest.raises(ValueError, match="languages"):
        lang_id.identify(docs, train, max_languages=1)


def test_numbers_are_no_letters(spark):
    train = spark.createDataFrame([("und so weiter und so fort", "de"), ("and so on and so forth", "en")], "text string, lang string")
    docs = spark.createDataFrame([(1, "½ ②"), (2, "Ⅷ ² ¾ ₅"), (3, "ª"), (4, "² and"), (5, "١٢٣"), (6, "中文")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in lang_id.identify(docs, train).collect()}
    assert [got[i] == "und" for i in range(1, 7)] == [True, True, False, False, True, False]


def test_languages_by_plain_compression(spark, docs, by_id):
    """Every dictionary against every block, without Spark; and dictionaries that don't depend on how rows are dealt."""
    import zstandard

    rng = random.Random(16)
    stems = {"en": ["the", "ing", "and"], "de": ["sch", "ung", "und"], "xx": ["qua", "vix", "zop"]}
    rows = [("".join(rng.choice(stems[lang]) + rng.choice(["", " "]) for _ in range(rng.randrange(20, 200))), lang) for lang in stems for _ in range(60)]
    rows += rows[:40] * 3  # one group of copies
    train = spark.createDataFrame([*rows, (None, "en"), ("text", None)], "text string, lang string")
    some = {"train_docs": 20, "dict_bytes": 2000, "segment": 16, "max_languages": 9}
    content = lang_id.learnt(train, "text", "lang", **some)
    assert content == lang_id.learnt(train.repartition(7, "text"), "text", "lang", **some) and all(500 < len(c) <= 2000 for c in content.values())
    got = {r.doc_id: r for r in lang_id.identify(docs, train, train_docs=20, dict_bytes=2000, segment=16, block_bytes=500).collect()}
    for k, text in by_id.items():
        if not any(c.isalpha() for c in text or ""):
            assert (got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True)
            continue
        raw, sizes = text.lower().encode(), []
        for name in sorted(content):
            d = zstandard.ZstdCompressionDict(content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            pack = zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append((sum(len(pack.compress(raw[i : i + 500])) for i in range(0, len(raw), 500)), name))
        (best, name), (second, _) = sorted(sizes)[:2]
        assert got[k].lang_pred == name and got[k].rejected == ((second - best) / best < 0.02)


def test_samples_are_bounded(spark):
    """One text in most of the rows, and more partitions than rows: no more jobs, and no raw rows for the driver."""
    hot = spark.createDataFrame([(i, words(random.Random(i % 3), 60)) for i in range(300)], "doc_id long, text string")
    tracker, counts = spark.sparkContext.statusTracker(), []
    for n in (2, 64):
        spark.sparkContext.setJobGroup(f"words-{n}", "")
        text, lengths = token_counts.frequent_words(hot.repartition(n), "text", BPE, 100, 50)
        counts.append(len(tracker.getJobIdsForGroup(f"words-{n}")))
        assert len(text.split()) == len(lengths) <= 100
    spark.sparkContext.setJobGroup("rest", "")
    assert counts[0] == counts[1]
    assert sorted(quality.cascade_order(hot, "text", quality.RULES, 30)) == list(range(len(quality.RULES)))


def test_another_tokenizer_is_refused(spark, tmp_path):
    from tokenizers import Tokenizer, models

    pieces_ = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz \t\n.%()'0123456789éü\u00a0\r\x0b\x0c")}
    Tokenizer(models.BPE(pieces_, [])).save(str(tmp_path / "spaces.json"))
    with pytest.raises(ValueError, match="white space"):
        token_counts.check_words(str(tmp_path / "spaces.json"))
    token_counts.check_words(BPE)


def test_toxicity(spark, empty):
    rng = random.Random(9)
    plain = lambda n: words(rng, n).split(" ")

    def text(bad):
        w = plain(rng.randrange(40, 120))
        for _ in range(rng.randrange(3, 7) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "moron", "Clown"]))
        return " ".join(w)

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)] + [(900, None, 0), (901, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = table.drop("toxic"), table.where("doc_id % 5 != 0").select("doc_id", "toxic")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels.union(labels.limit(3))).collect()}
    held = [r for r in rows if r[0] % 5 == 0 and r[0] < 900]
    assert all(got[i].predicted == y for i, _, y in held) and len(got) == len(rows)
    assert got[900].predicted == 0 and 0 <= got[901].score < 0.5 and got[0].neighbours and "idiot" in {t for r in got.values() for t in r.terms}
    assert {r.score for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0.5}
    assert toxicity.toxicity(empty, labels).count() == 0


def test_nearest_is_exact():
    import numpy as np

    rng = random.Random(11)
    names = [f"t{i}" for i in range(30)] + [toxicity.REST]
    examples = [(i, rng.randrange(2), t := sorted(rng.sample(range(31), rng.randrange(1, 9))), [rng.randrange(1, 5) for _ in t]) for i in range(500)]
    index = toxicity.Index.build(names, [float(rng.randrange(1, 200)) for _ in names], 500.0, examples, {0: 1.0, 1: 2.0}, 16)
    of = {e[0]: e for e in examples}

    def vector(terms, tf):
        v = np.zeros(31)
        v[terms] = (1 + np.log(tf)) * index.idf[terms]
        return v / np.linalg.norm(v)

    for _ in range(60):
        terms = sorted(rng.sample(range(31), rng.randrange(1, 6)))
        tf = [rng.randrange(1, 4) for _ in terms]
        rows, near = index.nearest(terms, tf, 10)
        q = vector(terms, tf)
        every = sorted((float(q @ vector(e[2], e[3])) for e in examples), reverse=True)[:10]
        assert near == pytest.approx([x for x in every if x > 0][: len(near)]) and len(near) == min(10, sum(x > 0 for x in every))
        assert near == pytest.approx([float(q @ vector(*of[index.ids[r]][2:])) for r in rows])


def test_urls(spark):
    rules = [url_filter.Rule(*r) for r in (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"))]
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7x?q", "https://x.com/en/", "https://notcom/en/", "http://com/en/1", "http://example.net/de/81#f", "http://x.net/de/8", "ftp://x.org", "http://a://b/c"]
    urls += [f"http://www.{n}.org/p{i}" for i in range(40) for n in ("casino-win", "quietgarden")] + ["http://cheapcasino.org/", "http://win.org/q"]
    pages = spark.createDataFrame([(i, u, "<p>quiet garden words win cheap</p>", "z") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.judge(pages, rules).collect()}
    assert [(got[i].host, got[i].path) for i in range(11)] == [("", ""), ("", ""), ("", ""), ("a.example.com", "/en/7x"), ("x.com", "/en/"), ("notcom", "/en/"), ("com", "/en/1"), ("example.net", "/de/81"), ("x.net", "/de/8"), ("x.org", ""), ("a:", "//b/c")]
    assert [(got[i].rule, got[i].verdict) for i in range(3, 9)] == [("example.com/en/7", "allow"), ("com/en/", "block"), (None, "allow"), ("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "allow")]
    verdicts = {u: got[i].verdict for i, u in enumerate(urls) if u and ".org" in u}
    assert all((v == "block") == ("casino" in u or "win" in u) for u, v in verdicts.items())
    assert "h:garden" in got[12].tokens and url_filter.judge(pages.where("false"), rules).count() == 0


def test_segments():
    s = url_filter.Segmenter({"quiet": 50, "garden": 40, "a": 30, "gar": 1, "den": 2})
    assert s.split("quietgarden") == ("quiet", "garden") and s.split("") == () and "".join(s.split("zzquietzz")) == "zzquietzz"


def test_loser_tree():
    rng = random.Random(2)
    for _ in range(200):
        runs = [sorted(((rng.randrange(20),), i) for _ in range(rng.randrange(6))) for i in range(rng.randrange(9))]
        assert list(warc.loser_tree(runs)) == sorted(x for r in runs for x in r)


def test_archives(spark, tmp_path):
    rng = random.Random(7)
    shared, small = words(rng, 400), "tiny"
    html = [None, "", small, small, shared, shared, shared, "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" + shared, "é" * 700, "é" * 700, "x\r\n\r\n" * 300]
    rows = [(i, None if i == 3 else f"http://b{i % 3}.example.org/p?x={i}\n", h, "k") for i, h in enumerate(html * 4)]
    rows += [(50, "http://b0.example.org/big", "<p>" + words(rng, 250_000), "k"), (51, "http://b0.example.org/null", "\0" * 1500, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(4)
    by_page = {r[0]: r for r in rows}
    last = {r[2] or "": r[0] for r in rows}
    for size in (16 << 20, 2000):
        got = warc.archive(pages, str(tmp_path / f"warc-{size}"), records_per_file=5, range_bytes=size).collect()
        assert len(got) == len(rows)
        for r in got:
            raw = (by_page[r.page_id][2] or "").encode()
            to = last[raw.decode()] if len(raw) >= 1000 and last[raw.decode()] != r.page_id else None
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to is not None else "response", to)
            # A reader that seeks finds the record, alone.
            with open(r.run.removeprefix("file:"), "rb") as f:
                f.seek(r.offset)
                record = gzip.decompress(f.read(r.length))
            assert f"<urn:page:{r.page_id}>".encode() in record and record.endswith((b"" if to is not None else raw) + b"\r\n\r\n")
        order = [(r.url_key, r.ts, r.page_id) for r in sorted(got, key=lambda r: r.position)]
        assert order == sorted(order) and sorted(r.position for r in got) == list(range(len(rows)))
    assert len({r.run for r in got}) > 5
    assert warc.archive(pages.where("false"), str(tmp_path / "none")).count() == 0


def test_archives_of_odd_rows(spark, tmp_path):
    """Null and repeated ids; a payload damaged on disk."""
    page = "<p>" + "same page " * 200
    pages = spark.createDataFrame([(None, "http://a.org", page), (None, None, None), (7, "http://a.org", page), (7, "http://a.org", page), (3, "http://a.org", page)], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.archive(pages).collect())
    assert got == [(0, "response", None), (0, "revisit", 7), (3, "revisit", 7), (7, "response", None), (7, "response", None)]
    packed = warc.member(b"WARC/1.1\r\nWARC-Type: response\r\nX-URL-Key: k\r\nWARC-Date: d\r\nWARC-Record-ID: <urn:page:1>\r\nX-Payload-Length: 3\r\nContent-Length: 3\r\nWARC-Payload-Digest: sha1:0\r\n\r\nabc\r\n\r\n") + b"\0"
    with pytest.raises(ValueError, match="isn't what its head says"):
        list(warc.parsed("one", packed))
    with pytest.raises(ValueError, match="breaks off"):
        list(warc.members(packed[:-9]))
    whole = warc.member(b"x" * (1 << 24)) + b"\0"
    assert [len(c) for *_, c in warc.members(whole + packed)] == [1 << 24, len(gzip.decompress(packed))]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_texts_in_no_learnt_language_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(1)
    letters = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10)))
    odd = spark.createDataFrame([(i, " ".join(letters() for _ in range(150))) for i in range(50)], "doc_id long, text string")
    train, held = docs.where(fold(4) != 2), docs.where((fold(4) == 2) & F.col("text").rlike(r"\p{L}"))
    assert lang_id.identify(odd, train).where("rejected").count() >= 45
    clean = held.select("doc_id", "lang").join(lang_id.identify(held, train), "doc_id").collect()
    assert sum(r.lang_pred == r.lang and r.rejected for r in clean) <= 0.02 * len(clean)
    unlearnt = lang_id.identify(held.where("lang = 'fr'"), train.where("lang != 'fr'")).collect()
    assert len(unlearnt) > 20 and sum(r.rejected for r in unlearnt) >= 0.8 * len(unlearnt)


def test_toxicity_knows_every_telling_word(spark):
    """More toxic words than a short vocabulary holds, each in a dozen texts."""
    rng = random.Random(12)
    bad = ["".join(rng.choice("klmnopq") for _ in range(9)) for _ in range(40)]
    plain = [(i, words(rng, 20), 0) for i in range(4000)]
    toxic = [(10_000 + 100 * k + j, f"{words(rng, 8)} {w} {words(rng, 4)} {w} {words(rng, 4)}", 1) for k, w in enumerate(bad) for j in range(12)]
    table = spark.createDataFrame(plain + toxic, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(table.drop("toxic"), table.where("doc_id % 5 != 0").select("doc_id", "toxic")).collect()}
    held = [r for r in plain + toxic if r[0] % 5 == 0]
    assert all(got[i].predicted == y for i, _, y in held) and all(got[10_000 + 100 * k].terms for k in range(40))


def brute_toxicity(rows, min_df, min_chi2, strength):
    """Scores of (id, text, label or None) with every example a neighbour: vocabulary, vectors and votes in plain Python."""
    import math
    from zlib import crc32

    known = [(t or "", y) for _, t, y in rows if y is not None]
    seen = {}
    for t, y in known:
        w = toxicity.words_of(t)
        kin = min((crc32(" ".join(w[i : i + 4]).encode()) for i in range(len(w))), default=0)
        for term in {x for v in w for x in toxicity.terms_of(v)}:
            seen[term, kin] = max(y, seen.get((term, kin), 0))
    df, with_y = Counter(t for t, _ in seen), Counter(t for (t, _), y in seen.items() if y)
    n1 = sum(y for _, y in known)
    n0 = len(known) - n1

    def chi2(t):
        a, b = with_y[t], df[t] - with_y[t]
        c, d = n1 - a, n0 - b
        return (n1 + n0) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * n1 * n0) if (a + b) * (c + d) else 0.0

    names = sorted((t for t in df if df[t] >= min_df and chi2(t) >= min_chi2 and with_y[t] * n0 > (df[t] - with_y[t]) * n1), key=lambda t: (-chi2(t), -len(t.lstrip("^")), t))
    idf = {t: math.log((1 + len(known)) / (1 + df[t])) + 1 for t in names} | {toxicity.REST: toxicity.REST_WEIGHT}
    place = {t: i for i, t in enumerate(names)}

    def vector(text):
        tf = Counter(min((t for t in toxicity.terms_of(w) if t in place), key=place.get, default=toxicity.REST) for w in toxicity.words_of(text or ""))
        v = {t: (1 + math.log(n)) * idf[t] for t, n in tf.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    examples = [(v, y) for t, y in known if (v := vector(t))]
    prior, out = (sum(y for _, y in known) + 0.5) / (len(known) + 1), {}
    for i, t, _ in rows:
        if not (v := vector(t)):
            out[i] = prior
            continue
        near = [(sum(x * v.get(w, 0.0) for w, x in e.items()), y) for e, y in examples]
        out[i] = (sum(c for c, y in near if y) + strength * prior) / (sum(c for c, _ in near) + strength)
    return out


def test_toxicity_by_brute_force(spark):
    """All examples vote (fewer than 20 of a class, so the curve is straight); very long texts, copies, and a clashing name among them."""
    rng = random.Random(23)
    bad = ["idiot", "scum", "moron"]
    make = lambda y: " ".join([words(rng, rng.randrange(5, 30), 40), *(rng.choice(bad) for _ in range(3 * y)), words(rng, 4, 40)])
    rows = [(i, make(int(i % 4 == 0)), int(i % 4 == 0)) for i in range(70)]
    rows += [(100, None, 0), (101, "", None), (102, "12 345", None), (103, "idiot " * 50_000, None), (104, rows[0][1], None), (105, words(rng, 60), None)]
    want = brute_toxicity(rows, 3, 5.0, 0.5)
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = table.where("toxic is not null").select("doc_id", "toxic")
    options = {"k": 1000, "min_df": 3, "min_chi2": 5.0, "block": 8}
    got = {r.doc_id: r.score for r in toxicity.toxicity(table.withColumnRenamed("toxic", "score"), labels, **options).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_toxicity_of_other_ids(spark):
    """The same texts under other ids, dealt otherwise, have the same scores; repeated rows too."""
    rng = random.Random(24)
    texts = [words(rng, 12, 30) + (" scum " + rng.choice(["moron", "clown", "scum"]) if i % 3 == 0 else "") for i in range(150)]
    texts += texts[:30]
    scores = []
    for ids in (range(len(texts)), rng.sample(range(10**6), len(texts))):
        table = spark.createDataFrame([(i, t, int("scum" in t)) for i, t in zip(ids, texts)], "doc_id long, text string, toxic int").repartition(1 + len(scores) * 5)
        got = toxicity.toxicity(table.select("doc_id", "text"), table.select("doc_id", "toxic"), k=5).collect()
        of = {r.doc_id: r.score for r in got}
        scores.append([of[i] for i in ids])
    assert scores[0] == pytest.approx(scores[1], abs=1e-12) and scores[0][:30] == scores[0][-30:]


def test_toxicity_is_calibrated():
    import numpy as np

    rng = np.random.default_rng(4)
    truth = rng.random(4000)
    labels, odds = (rng.random(4000) < truth).astype(float), 3 * np.log(truth / (1 - truth)) + 1
    slope, shift = toxicity.fitted(odds, labels, np.ones(4000))
    assert slope == pytest.approx(1 / 3, abs=0.03) and shift == pytest.approx(-1 / 3, abs=0.1)
    assert toxicity.fitted(odds, np.zeros(4000), np.ones(4000)) == (1.0, 0.0) == toxicity.fitted(-odds, labels, np.ones(4000))


def test_urls_by_brute_force(spark):
    """Counts, splits and weights in plain Python; a host in most rows, rows repeated, very long names."""
    import math
    import re

    rng = random.Random(31)
    parts, seeds = ["quiet", "garden", "win", "news", "shop", "free", "blue"], ["casino", "bet", "loans"]
    host = lambda: "".join(rng.choice(parts + seeds) for _ in range(rng.randrange(1, 4))) + rng.choice([".org", ".net", "-x.com"])
    rows = [(i, f"http://{'hot.example.org' if i % 3 else host()}/{rng.choice(parts)}{rng.choice(parts)}/{i % 7}?q", " ".join(rng.choice(parts) for _ in range(20))) for i in range(150)]
    rows += [rows[4], (200, None, None), (201, "http://" + "quietgarden" * 300 + "/", "<b casino>zz</b>"), (202, "nothing", ""), (203, "http://casinowin.org", "<p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    counts = Counter(w for *_, h in rows for w in re.split("[^a-z]+", re.sub("<[^>]*>", " ", (h or "").lower())) if 2 <= len(w) <= 20)
    total, least = sum(counts.values()), max(counts.values()) // 1000 + 1
    split = url_filter.Segmenter(counts | {w: max(counts.get(w, 0), least) for w in url_filter.SEEDS}, total=total).split

    def tokens(url):
        m = re.search("://([^/?#]*)([^?#]*)", url or "")
        return [kind + w for kind, text in zip(("h:", "p:"), m.groups() if m else ()) for x in url_filter.NAME.findall(text.lower()) for w in (["0"] if x[0].isdigit() else split(x))]

    each = [tokens(u) for _, u, _ in rows]
    block = [any(t[:2] == "h:" and t[2:] in url_filter.SEEDS for t in x) for x in each]
    b, a = (Counter(t for x, y in zip(each, block) if y == side for t in x) for side in (True, False))
    names = set(b) | set(a)
    weight = {t: math.log((b[t] + 1) / (sum(b.values()) + len(names))) - math.log((a[t] + 1) / (sum(a.values()) + len(names))) for t in names}
    bias = math.log((sum(block) + 1) / (len(block) - sum(block) + 1))
    for few in (200_000, 0):
        got = {r.page_id: r for r in url_filter.judge(pages, [], max_broadcast=few).collect()}
        for (i, *_), x in zip(rows, each):
            odds = bias + sum(weight[t] for t in x)
            assert got[i].tokens == x and got[i].log_odds == pytest.approx(odds) and got[i].verdict == ("block" if odds > 0 else "allow")
            assert got[i].rest_odds == pytest.approx(bias + sum(weight[t] for t in x if not (t[:2] == "h:" and t[2:] in url_filter.SEEDS)))
    assert 10 < sum(block) < 60 and url_filter.judge(pages, []).count() == len(rows)
