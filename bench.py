"""Times the headline queries; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

from terralapse.plans.queries import QUERIES  # noqa: E402
from terralapse.session import local_session  # noqa: E402

HEADLINE = [
    "transition_matrix_blocks",
    "attribute_suppliers",
    "zone_suppliers",
    "clip_suppliers",
    "area_by_class_year", "transition_matrix", "transition_patch_min", "patches_all", "patches_changes_only", "attribute_largest",
    "consensus_confidence", "net_change_pivot", "index_kndvi_monthly", "trend_slope", "break_dates", "break_dates_stable_history", "attribute_points", "attribute_lines", "clip_aoi",
]


def dense_raster(spark, side: int = 2000, block: int = 20):
    """A pair of class rasters of side x side cells in blocks, a twentieth of the cells changed."""
    from pyspark.sql import functions as F

    cells = spark.range(side * side, numPartitions=16).select((F.col("id") / side).cast("int").alias("row"), (F.col("id") % side).cast("int").alias("col"))
    codes = F.array(*(F.lit(c) for c in (2, 5, 7, 8, 11)))
    block_of = lambda seed: F.pmod(F.xxhash64(F.lit(seed), F.floor(F.col("row") / block), F.floor(F.col("col") / block)), F.lit(1000))
    pick = lambda k: F.element_at(codes, (k % 5 + 1).cast("int"))
    before = pick(block_of(1))
    after = F.when(block_of(2) < 50, pick(block_of(3))).otherwise(before)
    both = cells.withColumn("b", before).withColumn("a", after)
    return both.selectExpr("row", "col", "stack(2, 'before', 0, b, 'after', 1, a) AS (layer, layer_ix, code)")


def sparse_transition(spark, nrow: int, ncol: int, block: int = 10, share: float = 0.02):
    """Transitions on about ``share`` of a grid, in blocks; 48 pairs of classes. Stored, so that only what follows is timed."""
    from pyspark.sql import functions as F

    from terralapse.grid import GridSpec
    from terralapse.operators.transition import Transition
    from terralapse.plans.storage import stored

    across = -(-ncol // block)
    blocks = spark.range(-(-nrow // block) * across, numPartitions=16).where(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1_000_000)) < int(share * 1_000_000))
    inner = blocks.select("id", F.explode(F.sequence(F.lit(0), F.lit(block * block - 1))).alias("k"), F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(48)).alias("pair"))
    cells = inner.select(
        (F.floor(F.col("id") / across) * block + F.floor(F.col("k") / block)).cast("int").alias("row"), (F.col("id") % across * block + F.col("k") % block).cast("int").alias("col"),
        F.floor(F.col("pair") / 7).cast("int").alias("from_code"), (F.col("pair") % 7).cast("int").alias("to_code"),
    )
    cells = stored(cells.withColumn("code", F.col("from_code") * 1000 + F.col("to_code")), "bench-cells")
    return Transition(cells, cells.limit(0), cells.limit(0), None, GridSpec(0.0, nrow * 10.0, 10.0, 10.0, nrow, ncol))


def long_stack(spark, pixels: int = 102_400, months: int = 72):
    """A stack of noisy seasons, some of which drop at the end, stored."""
    from pyspark.sql import functions as F

    from terralapse.plans.storage import stored

    each = spark.range(pixels, numPartitions=16).select("id", F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("m"))
    noise = F.pmod(F.xxhash64("id", "m"), F.lit(1000)) / 20_000.0
    drop = F.when((F.col("id") % 5 == 0) & (F.col("m") > 54), -0.3).otherwise(0.0)
    y = F.when(F.pmod(F.xxhash64("m", "id"), F.lit(10)) > 0, 0.6 + 0.15 * F.sin(F.col("m") * 3.141592653589793 / 6) + noise + drop)
    return stored(each.select((F.col("id") / 320).cast("int").alias("row"), (F.col("id") % 320).cast("int").alias("col"), F.add_months(F.lit("2018-01-01").cast("date"), F.col("m")).alias("t"), y.alias("y")), "bench-stack")


def dense_blocks(spark, rows: int = 34, cols: int = 47, size: int = 256):
    """Two layers of blocks (104 million cells), every cell with a code."""
    import numpy as np
    import pyarrow as pa

    from terralapse.operators import blocks as bl
    from terralapse.plans.storage import stored

    def make(batches):
        for batch in batches:
            out = []
            for i in batch.column(0).to_pylist():
                rng = np.random.default_rng(i)
                before = np.kron(rng.choice([1, 2, 5, 7, 11], (size // 8, size // 8)), np.ones((8, 8), int))
                after = np.where(np.kron(rng.random((size // 8, size // 8)) < 0.05, np.ones((8, 8), bool)), 5, before)
                for k, (layer, codes) in enumerate((("before", before), ("after", after))):
                    wide, counts, data = bl.packed(codes, np.ones(codes.shape, bool))
                    out.append({"layer": layer, "layer_ix": k, "tr": i // cols, "tc": i % cols, "size": size, "wide": wide, "counts": [{"code": c, "n": n} for c, n in counts], "data": data})
            yield from pa.Table.from_pylist(out, schema=bl.SCHEMA).to_batches()

    return stored(spark.range(rows * cols, numPartitions=16).mapInArrow(make, bl.BLOCK), "bench-blocks")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, make) -> None:
        best = float("inf")
        for _ in range(2):
            began = time.time()
            make().write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        took[name] = round(best, 3)

    for name in HEADLINE:
        timed(name, lambda name=name: QUERIES[name](spark, sf))
    from terralapse.grid import GridSpec
    from terralapse.operators.transition import patches, transition
    from terralapse.sources.classes import class_table

    grid, table = GridSpec(0.0, 20_000.0, 10.0, 10.0, 2000, 2000), class_table(spark)
    timed("vectors_4m_cells", lambda: patches(transition(dense_raster(spark), grid, "before", "after", table), table, changes_only=True))
    # The operators alone, on inputs that are stored before.
    from terralapse.operators.breaks import break_monitor

    for name, size in (("patches_alone_24m_cells", (4899, 4899)), ("patches_alone_102m_cells", (8637, 11_875))):
        sparse = sparse_transition(spark, *size)
        timed(name, lambda sparse=sparse: patches(sparse, table))
    from terralapse.operators.blocks import patches_of_blocks, summarize_blocks, transition_blocks

    dense, wide = dense_blocks(spark), GridSpec(0.0, 90_000.0, 10.0, 10.0, 34 * 256, 47 * 256)
    timed("block_areas_104m_dense_cells", lambda: summarize_blocks(dense, wide, table))
    timed("block_transition_104m_dense_cells", lambda: transition_blocks(dense, wide, "before", "after", table).summary)
    timed("block_patches_104m_dense_cells", lambda: patches_of_blocks(transition_blocks(dense, wide, "before", "after", table), table, changes_only=True))
    stack = long_stack(spark)
    timed("break_alone_102k_pixels", lambda: break_monitor(stack))
    timed("break_stable_history_102k_pixels", lambda: break_monitor(stack, history="ROC"))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
