"""WARC archives of pages, read back, and one index of their captures.

Writing: each page becomes a record of WARC 1.1. Among records with equal payloads of at
least ``min_revisit`` bytes, that with the largest id is the response and the others are
revisits of it. A record is one gzip member, as readers that seek expect it; members stand
one after another in files that Spark's text writer makes on any store it can reach. (It ends
every row with a separator: a member ends with the high byte of its length, so that byte, 0,
is the separator. A record of 16 MiB or more is followed by an empty member, which ends so.)
A file has at most ``records_per_file`` records, one if its payload is larger than ``large``.

Reading: each archive is parsed once, member by member. Length and digest of a response are
taken from the payload itself, and must be what its head says. A revisit has no payload: its
head tells both. The captures of an archive, sorted by (url key, timestamp, id), are a run;
the runs are stored.

Merging: the stored runs are dealt out by ranges of (url key, timestamp, id) of about
``range_bytes``, so that even one url's captures may be split; in each range its shares of the
sorted runs are merged by a loser tree. The ranges' counts, one row each, turn places within
a range into ``position``, the place in the whole history.

Null html is an empty payload; null urls become ``urn:page:<id>``. Ids should be unique; with
repeated ids the rows are kept, and each is a record. A null id stays null, counts as less
than any other, and stands at second 0. Further columns of the input are ignored, so their
names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralapse.llm._arrow import as_bytes, slices, small_batches
from terralapse.plans.storage import new_path, stored

CRLF = "\r\n"
CAPTURE = "url_key string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, offset long, length long"
FIELDS = [x.split()[0] for x in CAPTURE.split(", ")]
TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
#: A gzip member without content.
EMPTY = zlib.compress(b"", 9, 31)


def capture_time(page_id: Column) -> Column:
    """When the page was fetched. The table holds no times: ids count seconds from 2020."""
    return F.date_format(F.timestamp_seconds(F.lit(1_577_836_800) + F.coalesce(page_id, F.lit(0)) % 1_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def url_key(url: Column) -> Column:
    """Host labels from the right, then the rest: ``com,example,www)/path``."""
    host = F.lower(F.regexp_extract(url, "://([^/?#]*)", 1))
    rest = F.lower(F.regexp_extract(url, "://[^/?#]*(.*)", 1))
    return F.when(F.contains(url, F.lit("://")), F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)).otherwise(F.lower(url))


def with_roles(pages: DataFrame, min_revisit: int, max_broadcast: int) -> DataFrame:
    """page_id, url, html, digest, n and refers_to (null for responses).

    Digests are pre-aggregated before they are shuffled, and only those met twice are
    joined back: broadcast if they are few, else by a join in which payloads too small to be
    revisits have keys of their own. A digest with very many pages is a skewed join then, which Spark splits.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    rows = pages.select("page_id", F.coalesce("url", F.concat(F.lit("urn:page:"), name)).alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    keys = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= min_revisit)
    last = keys.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("times")).where("times > 1").select(F.col("digest").alias("key"), "last")
    last = stored(last, "payloads")
    keyed = rows.withColumn("key", F.when(F.col("n") >= min_revisit, F.col("digest")).otherwise(F.concat(F.lit("-"), name)))
    found = keyed.join(F.broadcast(last) if last.count() <= max_broadcast else last, "key", "left")
    return found.withColumn("refers_to", F.when(F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id")), F.col("last"))).drop("key", "last")


def records(pages: DataFrame, min_revisit: int, max_broadcast: int) -> DataFrame:
    """(head, text, n): the record of each page, revisits without their text."""
    is_revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(x).cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", capture_time(F.col("page_id"))),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "")),
        line("X-URL-Key", F.regexp_replace(url_key(F.col("url")), "[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("X-Payload-Length", F.col("n").cast("string")),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn("refers_to")))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(is_revisit, "0").otherwise(F.col("n").cast("string"))),
        F.lit(CRLF),
    )
    return with_roles(pages, min_revisit, max_broadcast).select(head.alias("head"), F.when(is_revisit, "").otherwise(F.col("html")).alias("text"), "n")


def member(record: bytes) -> bytes:
    """A record packed, without the zero that the writer adds."""
    packed = zlib.compress(record, 6, 31)
    return (packed if packed.endswith(b"\0") else packed + EMPTY)[:-1]


def write_archives(pages: DataFrame, path: str, *, min_revisit: int = 1000, records_per_file: int = 1000, large: int = 1 << 20, max_broadcast: int = 200_000) -> list[str]:
    """Writes archives below ``path``; gives the folders that hold some."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = [member(h + t + b"\r\n\r\n") for h, t in zip(as_bytes(batch.column("head")), as_bytes(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows, out = records(pages, min_revisit, max_broadcast), []
    biggest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    for name, most, part in (("records", records_per_file, rows.where(F.col("n") <= large)), ("large", 1, rows.where(F.col("n") > large))):
        if name == "records" or biggest > large:
            out.append(f"{path}/{name}")
            packed = part.select("head", "text").mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
            packed.write.option("lineSep", "\0").option("maxRecordsPerFile", most).mode("overwrite").text(out[-1])
    return out


def members(packed: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member that isn't empty."""
    view, at = memoryview(packed), 0
    while at < len(view):
        unzip, parts, end = zlib.decompressobj(31), [], at
        while not unzip.eof:
            if end >= len(view):
                raise ValueError(f"a member breaks off at {at}")
            parts.append(unzip.decompress(view[end : end + (1 << 14)]))
            end += len(view[end : end + (1 << 14)])
        end -= len(unzip.unused_data)
        if content := b"".join(parts):
            yield at, end - at, content
        at = end


def parsed(name: str, packed: bytes) -> Iterator[tuple]:
    """The captures of one archive, in its order."""
    number = lambda x: None if (n := x.strip("<>").rpartition(":")[2]) == "null" else int(n)
    for at, length, record in members(packed):
        stop = record.find(b"\r\n\r\n")
        if stop < 0:
            raise ValueError(f"{name}: no record at {at}")
        head = dict(x.split(": ", 1) for x in record[:stop].decode().split(CRLF)[1:])
        payload = record[stop + 4 : -4]
        size, digest, kind = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
        if len(payload) != int(head["Content-Length"]) or kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
            raise ValueError(f"{name}: the payload of the record at {at} isn't what its head says")
        refers = head.get("WARC-Refers-To")
        yield (head["X-URL-Key"], head["WARC-Date"], number(head["WARC-Record-ID"]), size, digest, kind, refers and number(refers), name, at, length)


def order_of(row: tuple) -> tuple:
    """By (url_key, ts, page_id), a null id first."""
    return (*row[:2], row[2] is not None, row[2] or 0)


def read_archives(spark, paths: list[str]) -> DataFrame:
    """The captures of all archives in some folders: a sorted run for each archive, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column("path")[i].as_py()
                rows = sorted(parsed(name, batch.column("content")[i].as_py()), key=order_of)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(FIELDS), TYPES)], names=FIELDS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(paths)
    return stored(files.select("path", "content").mapInArrow(run, CAPTURE), "runs")


def loser_tree(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merges sorted runs of (key, row), earlier runs first on ties: inner nodes hold the loser of each match, so a new row plays one path only."""
    k = len(runs)
    if not k:
        return
    heads, at = [r[0] if r else None for r in runs], [0] * k

    def beats(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        return (heads[a][0], a) < (heads[b][0], b)

    tree, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while heads[best] is not None:
        yield heads[best]
        at[best] += 1
        heads[best] = runs[best][at[best]] if at[best] < len(runs[best]) else None
        node = (best + k) // 2
        while node:
            if beats(tree[node], best):
                tree[node], best = best, tree[node]
            node //= 2


def merged_index(runs: DataFrame, range_bytes: int = 16 << 20) -> DataFrame:
    """The captures of stored runs in global order, numbered by ``position`` from 0."""
    n, size = runs.agg(F.count(F.lit(1)), F.sum(F.octet_length("url_key") + F.octet_length("run") + 150)).first()
    ranges = max(1, -(-(size or 0) // range_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares: dict[str, list[tuple]] = {}  # of a range: what each run has there
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in FIELDS)):
                shares.setdefault(row[7], []).append((order_of(row), row))
        for name, rows in shares.items():
            # A run that two tasks read comes in two pieces, in any order.
            if any(b[0] < a[0] for a, b in zip(rows, rows[1:])):
                shares[name] = sorted(rows, key=lambda r: r[0])
        out, done = [], 0
        for _, row in loser_tree([shares[name] for name in sorted(shares)]):
            out.append(row)
            if len(out) == 10_000:
                yield emit(out, done)
                done, out = done + len(out), []
        if out:
            yield emit(out, done)

    def emit(rows: list[tuple], done: int) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), TYPES)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(range(done, done + len(rows)), pa.int64())], names=[*FIELDS, "inside"])

    dealt = runs.repartitionByRange(ranges, "url_key", "ts", "page_id")
    merged = stored(dealt.mapInArrow(run, f"{CAPTURE}, inside long").withColumn("range", F.spark_partition_id()), "index")
    # A row for each range.
    before = merged.groupBy("range").agg(F.count(F.lit(1)).alias("k")).withColumn("before", F.sum("k").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    return merged.join(F.broadcast(before.select("range", F.coalesce("before", F.lit(0)).alias("before"))), "range").withColumn("position", F.col("before") + F.col("inside")).select(*FIELDS, "position")


def archive(pages: DataFrame, path: str | None = None, *, min_revisit: int = 1000, records_per_file: int = 1000, range_bytes: int = 16 << 20) -> DataFrame:
    """Writes the pages to archives, reads them back and returns the merged index."""
    spark = pages.sparkSession
    small_batches(spark)
    folders = write_archives(pages, path or new_path(spark, "warc"), min_revisit=min_revisit, records_per_file=records_per_file)
    return merged_index(read_archives(spark, folders), range_bytes)


ORACLE = r"""
WITH p AS (SELECT page_id, html, coalesce(url, 'urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'null')) AS url, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
k AS (
  SELECT *, octet_length(encode(coalesce(html, ''))) AS n,
    regexp_replace(CASE WHEN contains(url, '://') THEN array_to_string(list_reverse(string_split(lower(regexp_extract(url, '://([^/?#]*)', 1)), '.')), ',') || ')' || lower(regexp_extract(url, '://[^/?#]*(.*)', 1, 's')) ELSE lower(url) END, '[\r\n]', '', 'g') AS url_key
  FROM p)
SELECT page_id, n AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to,
  row_number() OVER (ORDER BY url_key, coalesce(page_id, 0) % 1000000000, page_id NULLS FIRST) - 1 AS position
FROM k
"""
