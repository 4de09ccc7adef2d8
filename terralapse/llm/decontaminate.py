"""Test items inside documents, by MinHash sketches and exact containment.

Words are runs of characters outside space and U+0009 to U+000D, in lower case. A text's set is its distinct runs of ``width`` words; with fewer words, the
whole sequence as one; without words it is empty. An item is inside a document if the
document's set holds at least ``threshold`` of the item's.

Items are partitioned by the size of their sets, in classes that double. An item's
sketch is its k smallest shingle hashes, and the class's upper bound u sets k to
u - ceil(threshold * u) + 1: a document that lacks all of these lacks too many, so a
document with enough of the item always meets the sketch, however long it is. (Bands
of several independent minima, the usual form, miss short items in long documents,
whose Jaccard similarity is near 0.) Documents too small for an item are passed over.

Candidates are then verified by counting shared shingles as strings. Everything is
built from Spark's own functions. The sketches are broadcast if they have at most
``max_broadcast`` rows, and joined by a shuffle beyond that; so are the candidates. The items'
shingles are broadcast if they also have at most ``max_bytes``. An item of fewer than
``width`` words is one shingle, so only a document that equals it has it inside.

Null and empty texts, of items or documents, match nothing. Repeated items count once;
repeated documents give the same rows, once for each (id, item). Further columns of the inputs
are ignored, so their names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralapse.plans.storage import stored

SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Of a text with a word."""
    return F.split(F.btrim(F.lower(text), F.lit(SPACES)), "[ \\t-\\r]+")


def shingles(rows: DataFrame, width: int) -> DataFrame:
    """A row per place, repeats included: from (id, text) to (id, size, h, w, i)."""
    # Asked of the text and not of its words, which Spark would work out once more for it.
    split = rows.where(F.col("text").rlike("[^ \\t-\\r]")).select("id", words(F.col("text")).alias("w"))
    places = split.select("id", "w", F.size("w").alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))).alias("i"))
    each = F.xxhash64(*(F.get("w", F.col("i") + k) for k in range(width)))
    return places.withColumn("h", F.when(F.col("n") >= width, each).otherwise(F.xxhash64(F.array_join("w", " "))))


def as_string(width: int) -> Column:
    return F.when(F.col("n") >= width, F.concat_ws(" ", *(F.get("w", F.col("i") + k) for k in range(width)))).otherwise(F.array_join("w", " "))


def needed(size: Column, threshold: float) -> Column:
    return F.ceil(F.lit(threshold).cast("decimal(6,4)") * size)


def sketches(items: DataFrame, width: int, threshold: float) -> DataFrame:
    """(item_id, size, h): the class's k smallest hashes of each item."""
    sets = shingles(items.select(F.col("item_id").alias("id"), "text"), width).groupBy("id").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    size = F.size("hs")
    bound = F.pow(F.lit(2), F.floor(F.log2(size)) + 1).cast("int") - 1
    k = (bound - needed(bound, threshold) + 1).cast("int")
    return sets.select(F.col("id").alias("item_id"), size.alias("size"), F.explode(F.slice("hs", F.lit(1), F.least(k, size))).alias("h"))


def contained(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    threshold: float = 0.75,
    max_broadcast: int = 200_000,
    max_bytes: int = 64 << 20,
) -> DataFrame:
    """(id, item, ``n_shared``, ``n_item``, ``containment``): one row per document and item inside it."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    sketch = stored(sketches(items, width, threshold), "item-sketches")
    small = sketch.count() <= max_broadcast
    places = shingles(docs, width).select("id", "n", "h")
    met = places.join(F.broadcast(sketch) if small else sketch, "h").where(F.greatest(F.col("n") - (width - 1), F.lit(1)) >= needed(F.col("size"), threshold))
    found = stored(met.select("id", "item_id").distinct(), "item-candidates")
    few = found.count() <= max_broadcast

    # Only candidates are read again, and their shingles compared as strings.
    ids = found.select("id").distinct()
    again = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    theirs = shingles(again, width).select("id", "h", as_string(width).alias("s"))
    own = stored(shingles(items.select(F.col("item_id").alias("id"), "text"), width).select(F.col("id").alias("item_id"), "h", as_string(width).alias("s")).distinct(), "item-shingles")
    own_bytes = own.agg(F.sum(F.octet_length("s") + 32)).first()[0] or 0
    sizes = own.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    shared = theirs.join(F.broadcast(own) if small and own_bytes <= max_bytes else own, ["h", "s"]).select("id", "item_id", "s").distinct()
    counts = shared.groupBy("id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    return (
        counts.join(F.broadcast(sizes) if small else sizes, "item_id")
        .where(F.col("n_shared") >= needed(F.col("n_item"), threshold))
        .select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    )


ORACLE = r"""
WITH t AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT DISTINCT 1, item_id, text FROM benchmark),
w AS (
  SELECT kind, id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM t WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT kind, id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS s
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id AS item_id, count(*) AS n_item FROM s WHERE kind = 1 GROUP BY 1)
SELECT a.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM s a JOIN s b ON a.s = b.s AND a.kind = 0 AND b.kind = 1 JOIN n ON n.item_id = b.id
GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * any_value(n_item)
"""
