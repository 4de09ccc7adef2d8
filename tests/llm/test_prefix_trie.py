"""The trie of conversation prefixes against a brute-force one, with long, hot, odd and missing conversations."""

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest

prefix_trie = pytest.importorskip("terralapse.llm.prefix_trie")

SCHEMA = "conv_id long, turn long, role string, text string, depth long, key string, members int, base long, `a.b` int, part int"


def fmod(c):
    return c - 5 * int(c / 5)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = crc32(str(c).encode()) % 9
        path = tuple(own.get(c - fmod(c), [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out, sums = [], {}
    for path in sorted(members, key=len, reverse=True):
        own_saved = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        below = [sums[k] for k in children[path]]
        sums[path] = (sum(x[0] for x in below) or 1, own_saved + sum(x[1] for x in below))
        out.append((members[path][0], len(path), members[path[:-1]][0] if path else None, len(members[path]), len(children[path]), *sums[path], sha256(",".join(map(str, ends[path])).encode()).hexdigest()))
    return sorted(out, key=repr)


def given():
    rng = random.Random(11)
    say = lambda: rng.choice(["", "ja", "né", None, "hello\x00", "x" * 300])
    rows = []
    for c in [*range(0, 60), 71, 99, -3, -5, -7]:
        if c % 11 == 3:
            continue
        rows += [(c, rng.choice([None, t, t, t]), rng.choice(["user", "system", None]), say()) for t in range(rng.randrange(0, 14))]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 200) for t in range(10)]  # exact copies, some with other ids' heads
    rows += [(c, 0, "user", "same 0") for c in range(200, 260)]
    rows += [(300, t, "user", f"t{t % 7}") for t in range(500)] + [(301, t, "user", f"t{t % 7}") for t in range(500)] + [(305, 1, "user", "twice")] * 300
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("cut, many", [(4096, 4096), (9, 4), (64, 20)])
def test_prefix_trie(spark, monkeypatch, cut, many):
    rows = given()
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame([(*r, 5, "k", 3, 9, 1, 2) for r in rows], SCHEMA).repartition(5)
    monkeypatch.setattr(prefix_trie, "MANY_ENDS", many)
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    got = prefix_trie.prefix_trie(table, cut=cut)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_odd_tables(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")).count() == 0
    renamed = spark.createDataFrame([(0, 1, "user", "x")], "`c.v` long, `t``n` long, r string, x string")
    (_, leaf) = sorted(map(tuple, prefix_trie.prefix_trie(renamed, conv_col="c.v", turn_col="t`n", role_col="r", text_col="x").collect()), key=lambda r: r[1])
    assert leaf[:7] == (0, 1, 0, 1, 0, 1, 0)
    with pytest.raises(ValueError, match="cut"):
        prefix_trie.prefix_trie(renamed, cut=8)
