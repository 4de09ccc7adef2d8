"""The trie of conversation prefixes, built family by family and merged once.

A conversation is rebuilt from the first turns of its family's first conversation (its base)
and its own later turns. The steps:

1. Turns are dealt by ranges of (conversation, turn, role, text), numbered and hashed; from
   here on a turn is a hash and a count of bytes, and no text moves again.
2. Conversations are cogrouped with the heads of their bases. A task rebuilds a family and
   builds its small trie; each node has its members as a bit mask.
3. Only these combined nodes are shuffled: one aggregate by prefix hash gives the global trie.
4. Sums over subtrees need no walk. Each node is owned by its smallest member, and the nodes
   of a conversation's own are the last part of its path. So the sum over a subtree is that of
   the totals of its members, less what the node's owner owns above it; members are already
   known by family, so the totals go to the families and come back by prefix hash.

Prefixes are values of polynomials over the field of 2^127 - 1 at a random point, whose
coefficients are hashes of turns under a random key: two different prefixes agree with a
chance below 2^-90, whatever the texts. Such values can be shifted and joined, so a conversation with very many
turns need not be in one task: a family takes at most ``cut`` turns of a conversation, and
later turns get their prefixes where they are, from what the family says of the place of the cut.

Defined cases: turns are ordered by turn (null first), then role, then text; null role or text
counts as empty; repeated rows are turns of their own. Rows without a conversation id belong to
none and are left out. An empty table has no nodes. Further columns are ignored.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from hashlib import blake2b, sha256
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralapse.llm._arrow import as_bytes, slices, small_batches
from terralapse.plans.storage import stored

PRIME = (1 << 127) - 1
#: Conversations of a family, and how far a base reaches into them at most.
FAMILY, HEAD = 5, 8
ROOT = 1
#: Ids of a chunk of a node's ends.
CHUNK = 8192
#: A node with more ends than this and than the NODE_SHARE-th part of all ends is hashed in chunks; likewise parents of many.
MANY_ENDS, NODE_SHARE = 512, 5000

NODE = "base long, conv_id long, key binary, parent binary, depth long, bytes long, least long, members int, ends int, shift binary"


def packed(n: int) -> bytes:
    return n.to_bytes(16, "big")


def number(b: bytes) -> int:
    return int.from_bytes(b, "big")


def own_head(conv: int) -> int:
    """How many of the base's turns come first."""
    return crc32(str(conv).encode()) % (HEAD + 1)


def base_of(conv: Column) -> Column:
    return conv - conv % FAMILY


def measured(turns: DataFrame, point: int, secret: bytes) -> DataFrame:
    """conv_id, part, nth (in its part), hash, prefix (of the part's turns up to this one), bytes: sorted runs of turns."""
    spark = turns.sparkSession
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    dealt = turns.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, nth, prefix = TaskContext.get().partitionId(), None, 0, 0
        for batch in slices(batches, "text"):
            ids = batch.column(0).to_pylist()
            nths, hashes, prefixes, sizes = [], [], [], []
            for c, role, text in zip(ids, as_bytes(batch.column(1)), as_bytes(batch.column(2))):
                if c != conv:
                    conv, nth, prefix = c, 0, 0
                value = number(blake2b(b"%d " % len(role) + role + text, digest_size=16, key=secret).digest()) % PRIME
                nth, prefix = nth + 1, (prefix * point + value) % PRIME
                nths.append(nth)
                hashes.append(packed(value))
                prefixes.append(packed(prefix))
                sizes.append(len(text))
            n = pa.array([part] * len(ids), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(nths, pa.int64()), pa.array(hashes, pa.binary()), pa.array(prefixes, pa.binary()), pa.array(sizes, pa.int64())], names=["conv_id", "part", "nth", "hash", "prefix", "bytes"])

    runs = dealt.sortWithinPartitions(*order).select("conv_id", "role", "text")
    return stored(runs.mapInArrow(run, "conv_id long, part int, nth long, hash binary, prefix binary, bytes long"), "trie-turns")


def placed(turns: DataFrame, point: int) -> tuple[DataFrame, int]:
    """The same with ``pos`` in the whole conversation and the prefix before its part; and a bound of the longest one's turns.

    Only the first conversation of a part can have begun in an earlier one: the driver adds up one row for each part.
    """
    edges = turns.groupBy("part").agg(F.min(F.struct("conv_id", (-F.col("nth")).alias("n"), "prefix")).alias("first"), F.max(F.struct("conv_id", "nth", "prefix")).alias("last"), F.max("nth").alias("longest")).orderBy("part").collect()
    known, conv, count, prefix, longest = [], None, 0, 0, 0
    for e in edges:
        n, value = -e.first.n, number(e.first.prefix)
        if e.first.conv_id == conv:
            known.append((e.part, conv, count, packed(prefix)))
            longest = max(longest, count + n)
            n, value = count + n, (prefix * pow(point, n, PRIME) + value) % PRIME
        longest = max(longest, e.longest)
        conv, count, prefix = (conv, n, value) if e.first.conv_id == e.last.conv_id == conv else (e.last.conv_id, e.last.nth, number(e.last.prefix))
    spark = turns.sparkSession
    before = spark.createDataFrame(known, "part int, conv_id long, before long, prefix_before binary")
    found = turns.join(F.broadcast(before), ["part", "conv_id"], "left").withColumn("pos", F.col("nth") + F.coalesce("before", F.lit(0)))
    return found, longest


def family_nodes(point: int, cut: int):
    """The trie of one family, as rows of NODE; a conversation that goes on past the cut also gets a row with ``shift``."""

    def run(heads: pa.Table, turns: pa.Table) -> pa.Table:
        if not turns.num_rows:
            return pa.Table.from_pylist([], schema=SCHEMA)
        base = turns.column("base")[0].as_py()
        first = [(number(h), n) for _, h, n in sorted(zip(*(heads.column(f"base_{c}").to_pylist() for c in ("pos", "hash", "bytes"))))]
        own: dict[int, list] = {}
        for conv, _, h, n in sorted(zip(*(turns.column(c).to_pylist() for c in ("conv_id", "pos", "hash", "bytes")))):
            own.setdefault(conv, []).append((number(h), n))
        nodes: dict[tuple[int, int], list] = {}
        rows = []
        for conv, path in own.items():
            bit, h = 1 << (conv - base + FAMILY - 1), own_head(conv)
            key, depth, node = ROOT, 0, nodes.setdefault((0, ROOT), [None, 0, conv, 0, 0])
            node[3] |= bit
            for value, size in first[:h] + path[h:cut]:
                above, key, depth = key, (key * point + value) % PRIME, depth + 1
                node = nodes.setdefault((depth, key), [above, size, conv, 0, 0])
                node[3] |= bit
            if len(path) > cut:
                prefix = 0
                for value, _ in path[:cut]:
                    prefix = (prefix * point + value) % PRIME
                rows.append((base, conv, None, None, depth, 0, None, 0, 0, packed((key - prefix) % PRIME)))
            else:
                node[4] |= bit
        rows += [(base, None, packed(key), None if above is None else packed(above), depth, size, least, members, ends, None) for (depth, key), (above, size, least, members, ends) in nodes.items()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)

    return run


SCHEMA = pa.schema([("base", pa.int64()), ("conv_id", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("bytes", pa.int64()), ("least", pa.int64()), ("members", pa.int32()), ("ends", pa.int32()), ("shift", pa.binary())])


def in_blocks(per_conv: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each block of a long conversation, so that it meets its turns in many tasks."""
    return per_conv.join(lengths, "conv_id").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks"))))


def block(of: str, cut: int) -> Column:
    return F.floor(F.col(of) / cut).cast("long")


def later_nodes(turns: DataFrame, cuts: DataFrame, lengths: DataFrame, point: int, cut: int) -> DataFrame:
    """Nodes of the turns past the cut, each where its turn is."""
    inverse = pow(point, -1, PRIME)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                local = number(r["prefix"])
                before = number(r["prefix_before"]) if r["prefix_before"] else 0
                whole = before * pow(point, r["nth"], PRIME) + local
                key = (whole + number(r["shift"]) * pow(point, r["pos"] - cut, PRIME)) % PRIME
                above = (key - number(r["hash"])) * inverse % PRIME
                bit = 1 << (r["conv_id"] - r["base"] + FAMILY - 1)
                rows.append((r["base"], r["conv_id"], packed(key), packed(above), r["depth"] + r["pos"] - cut, r["bytes"], r["conv_id"], bit, bit if r["pos"] == r["turns"] else 0, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)

    late = turns.where(F.col("pos") > cut).withColumn("block", block("pos", cut))
    met = late.join(in_blocks(cuts.select("conv_id", "shift", "depth"), lengths), ["conv_id", "block"])
    return met.select("conv_id", "base", "nth", "pos", "turns", "hash", "prefix", "prefix_before", "bytes", "shift", "depth").mapInArrow(run, NODE)


def ends_hashed(ends: DataFrame, nodes: DataFrame, n_convs: int) -> DataFrame:
    """key, ends_sha256 of nodes where conversations end (``ends``: key, conv_id).

    Ids of a node are gathered if they are few. The ids of others are sorted over all tasks and
    joined in chunks, and one task feeds a node's chunks to its hash, one at a time.
    """
    many = max(MANY_ENDS, n_convs // NODE_SHARE)
    hot = nodes.where(F.col("n_ends") > many).select("key")  # fewer than NODE_SHARE
    few = ends.join(F.broadcast(hot), "key", "left_anti").groupBy("key").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    few = few.select("key", F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256).alias("ends_sha256"))
    if hot.isEmpty():
        return few

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "first": pa.array([ids[0]], pa.int64()), "ids": pa.array([",".join(map(str, ids))], pa.string())})

        key, ids = None, []
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (k != key or len(ids) == CHUNK):
                    yield row()
                    ids = []
                key = k
                ids.append(c)
        if ids:
            yield row()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": [state.hexdigest()]})

        key, state = None, None
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if state:
                        yield row()
                    key, state = k, sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state:
            yield row()

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = stored(ends.join(F.broadcast(hot), "key", "left_semi"), "trie-ends").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = large.select("key", "conv_id").mapInArrow(chunks, "key binary, first long, ids string")
    return few.union(joined.repartition(n, "key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(hashed, "key binary, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", cut: int = 4096) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    if cut <= HEAD:
        raise ValueError(f"cut must be over {HEAD}")
    spark: SparkSession = conversations.sparkSession
    small_batches(spark)
    point, secret = 2 + secrets.randbelow(PRIME - 2), secrets.token_bytes(32)
    name = lambda c: F.col(f"`{c.replace('`', '``')}`")
    given = conversations.select(name(conv_col).cast("long").alias("conv_id"), name(turn_col).alias("turn"), F.coalesce(name(role_col), F.lit("")).alias("role"), F.coalesce(name(text_col), F.lit("")).alias("text"))
    turns, longest = placed(measured(given.where("conv_id is not null"), point, secret), point)
    turns = turns.withColumn("base", base_of(F.col("conv_id")))

    # Families: at most `cut` turns of a conversation, and one more to tell that it goes on.
    columns = ["base", "conv_id", "pos", "hash", "bytes"]
    heads = turns.where((F.col("conv_id") == F.col("base")) & (F.col("pos") <= HEAD)).select(*(F.col(c).alias(f"base_{c}") for c in columns))
    near = turns.where(F.col("pos") <= cut + 1).select(*columns)
    combined = heads.groupBy("base_base").cogroup(near.groupBy("base")).applyInArrow(family_nodes(point, cut), NODE)
    families = stored(combined, "trie-families")
    later = lengths = None
    if longest > cut:
        lengths = turns.where(F.col("pos") > cut).groupBy("conv_id").agg(F.max("pos").alias("turns")).withColumn("blocks", block("turns", cut))
        lengths = stored(lengths, "trie-lengths")
        later = stored(later_nodes(turns, families.where("shift is not null"), lengths, point, cut), "trie-later")
    families = families.where("shift is null")

    # The global trie: one aggregate, combined before the shuffle.
    local = families if later is None else families.union(later)
    merged = local.groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"), F.min("least").alias("conv_id"), F.sum(F.bit_count("members")).alias("n_convs"), F.sum(F.bit_count("ends")).alias("n_ends"))
    merged = stored(merged, "trie-merged")
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = merged.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))
    nodes = stored(nodes, "trie-nodes")

    # What each conversation owns: the end of its path.
    owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("total"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.min_by("key", "depth").alias("key"), F.min_by("parent", "depth").alias("parent"))
    owned = stored(owned, "trie-owned")

    # Totals of members, by family and then by node.
    base = base_of(F.col("conv_id"))
    slot = (F.col("conv_id") - base + FAMILY - 1).cast("int")
    totals = owned.groupBy(base.alias("base")).agg(F.collect_list(F.struct(slot.alias("slot"), "total", "leaves")).alias("of"))
    inside = "filter(coalesce(of, array()), m -> getbit(members, m.slot) = 1)"
    shares = families.join(totals, "base", "left").select("key", *(F.expr(f"aggregate({inside}, 0L, (s, m) -> s + m.{c})").alias(c) for c in ("total", "leaves")))
    if later is not None:
        long_ones = in_blocks(owned.select("conv_id", "total", "leaves"), lengths)
        shares = shares.union(later.withColumn("block", block("depth", cut)).join(long_ones, ["conv_id", "block"]).select("key", "total", "leaves"))
    sums = shares.groupBy("key").agg(F.sum("total").alias("total"), F.sum("leaves").alias("n_leaves"))

    # What a node's owner owns above it.
    path = Window.partitionBy("conv_id", *([] if later is None else ["block"])).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.withColumn("block", block("depth", cut)).withColumn("before", F.coalesce(F.sum("saved").over(path), F.lit(0)))
    if later is not None:
        held = rows.groupBy("conv_id", "block").agg(F.sum("saved").alias("held"))
        sooner = F.sum("held").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.join(held.select("conv_id", "block", sooner.alias("sooner")), ["conv_id", "block"]).withColumn("before", F.col("before") + F.coalesce("sooner", F.lit(0)))

    # The parent is the owner's too, but for the first node that it owns.
    firsts, n_owners = owned.where("parent is not null").select("key", "parent"), owned.count()
    ids = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    many = firsts.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(MANY_ENDS, n_owners // NODE_SHARE)).select("parent")  # fewer than NODE_SHARE
    hot = stored(ids.join(F.broadcast(many), "parent"), "trie-hot")
    parents = firsts.join(F.broadcast(hot), "parent").select("key", "above").union(firsts.join(F.broadcast(hot), "parent", "left_anti").join(ids, "parent").select("key", "above"))

    ending = local.where("ends != 0").select("key", "base", F.explode(F.sequence(F.lit(0), F.lit(2 * FAMILY - 2))).alias("slot"), "ends").where("getbit(ends, slot) = 1")
    ends = ends_hashed(ending.select("key", (F.col("base") + F.col("slot") - FAMILY + 1).alias("conv_id")), nodes, n_owners)
    found = rows.join(sums, "key").join(parents, "key", "left").join(ends, "key", "left")
    return found.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("total") - F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )


#: The same rows by DuckDB, over every conversation.
ORACLE = """WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(length(CAST(c AS VARCHAR))),
      lambda i: list_transform(range(8), lambda b: CAST((ascii(substr(CAST(c AS VARCHAR), CAST(i + 1 AS INTEGER), 1)) >> CAST(b AS INTEGER)) & 1 AS BIGINT))))),
    lambda acc, bit: xor(acc >> 1, 3988292384 * (xor(acc, bit) & 1))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT v.c, list(t.t ORDER BY t.c != v.base OR t.p > v.h, t.p) FILTER (t.t IS NOT NULL) AS seq
  FROM convs v LEFT JOIN turns t ON (t.c = v.base AND t.p <= v.h) OR (t.c = v.c AND t.p > v.h) GROUP BY v.c),
paths AS (
  SELECT c, d, coalesce(len(seq), 0) AS n, CASE WHEN d > 0 THEN strlen(seq[d].text) ELSE 0 END AS size, min(c) OVER (PARTITION BY coalesce(seq, [])[1:d]) AS own
  FROM (SELECT c, seq, unnest(range(coalesce(len(seq), 0) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT own, d, count(*) AS n_convs, any_value(size) AS size, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends
  FROM paths GROUP BY own, d),
tied AS (
  SELECT n.own, n.d, n.n_convs, n.ends, (n.n_convs - 1) * n.size AS saved, p.own AS parent
  FROM nodes n LEFT JOIN paths p ON p.c = n.own AND p.d = n.d - 1),
children AS (SELECT parent AS own, d - 1 AS d, count(*) AS n FROM tied WHERE d > 0 GROUP BY 1, 2),
below AS (
  SELECT p.own, p.d, sum(t.saved) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM tied t JOIN paths p ON p.c = t.own AND p.d <= t.d LEFT JOIN children k ON k.own = t.own AND k.d = t.d GROUP BY 1, 2)
SELECT t.own AS conv_id, CAST(t.d AS BIGINT) AS depth, t.parent AS parent_conv_id, t.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
  CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(t.ends) AS ends_sha256
FROM tied t JOIN below b ON b.own = t.own AND b.d = t.d LEFT JOIN children k ON k.own = t.own AND k.d = t.d"""
