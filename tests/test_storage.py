"""What is stored for later steps, and what goes with them."""

import os
import time

from pyspark.sql import functions as F

from terralapse.llm import ngram_join, repeats
from terralapse.plans.graph import components
from terralapse.plans.storage import CLEANUP, shared_dir, stored


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for i in range(files.size()) if "shuffle_" in (f := files.apply(i).getName())}


def folders(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def test_shuffle_files_go_when_a_table_is_stored(spark):
    had, before = shuffle_files(spark), spark.conf.get(CLEANUP)
    got = stored(spark.range(20_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if not (left := shuffle_files(spark) - had):
            break
        time.sleep(0.1)
    assert not left and got.count() == 7 and spark.conf.get(CLEANUP) == before


def test_rounds_of_components_are_removed(spark):
    had = folders(spark)
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components(edges, "a", "b")
    assert len(folders(spark) - had) == 1 and {r.component for r in found.collect()} == {0} and found.count() == 41


def test_near_copies_keep_only_what_their_result_reads(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words[: 60 + i % 3], f"x{i}", *words[200 : 260 + i % 5]])) for i in range(40)] + [(90, "alone"), (91, None)]
    had = folders(spark)
    found = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), max_broadcast=5)
    kept = {f.rpartition("-")[0] for f in folders(spark) - had}
    assert not kept & {"lists", "hubs", "open-lists", "around-hubs", "ordered-hubs", "differences", "hub-pairs", "list-pairs"}
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: 0 for i in range(40)} | {90: 90, 91: 91}


def test_repeats_bring_one_shuffle_of_texts_to_the_result(spark):
    """Contexts and masks are made before, so their shuffles don't lie beside that of the result."""
    had = shuffle_files(spark)
    text = " ".join(f"w{i}" for i in range(60))
    found = repeats.without_repeats(spark.createDataFrame([(1, "a" + text), (2, "b" + text), (3, "c" + text[20:])], "doc_id long, text string"))
    for _ in range(50):
        if not (left := shuffle_files(spark) - had):
            break
        time.sleep(0.1)
    assert not left and found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id: r.n_removed for r in found.collect()} == {1: 0, 2: len(text), 3: len(text) - 20}
