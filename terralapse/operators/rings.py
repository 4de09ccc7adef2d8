"""Outlines of patches of any size, as points in order: no task holds more than a tile of a patch.

The straight pieces of a boundary (``attribute.sides``) are dealt to tiles by the corner they
leave from. In a tile each piece is followed by the one that leaves its end, so pieces become
chains: closed rings, or chains from one of the tile's sides to another. Only the ends of open
chains meet in joins; which ring a chain is of, and how far along, comes from pointer doubling: every
chain learns the least chain number and the number of corners of twice as many chains in each round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralapse.grid import GridSpec
from terralapse.operators.attribute import sides
from terralapse.plans.storage import stored

#: East, north, west, south: a turn to the left is the next one.
WAYS = 4
CHAIN = "chain long, patch_id int, closed boolean, on_left long, on_right long, n int, r array<int>, c array<int>"


def piece_number(r, c, way):
    """Of the piece that leaves a corner one way; no two patches share one."""
    return ((r << 31) + c) * WAYS + way


def chains_of_tile(patch: np.ndarray, r0: np.ndarray, c0: np.ndarray, r1: np.ndarray, c1: np.ndarray) -> list[tuple]:
    """Rows of CHAIN of the pieces that leave the corners of one tile."""
    way = np.where(r0 == r1, np.where(c1 > c0, 0, 2), np.where(r1 < r0, 1, 3))
    number = piece_number(r0, c0, way)
    order = np.argsort(number)
    patch, r0, c0, r1, c1, way, number = (x[order] for x in (patch, r0, c0, r1, c1, way, number))
    ahead = [piece_number(r1, c1, (way + turn) % WAYS) for turn in (1, 3)]
    follows = np.full(len(number), -1)
    for wanted in reversed(ahead):  # a turn to the left comes before one to the right
        at = np.minimum(np.searchsorted(number, wanted), len(number) - 1)
        good = (number[at] == wanted) & (patch[at] == patch)
        follows[good] = at[good]
    begins = np.ones(len(number), bool)
    begins[follows[follows >= 0]] = False
    seen, following, out = np.zeros(len(number), bool), follows.tolist(), []
    # Open chains from their first piece, and then what is left, rings, from their least one.
    for i in [*np.flatnonzero(begins).tolist(), *range(len(number))]:
        if seen[i]:
            continue
        path, at = [], i
        while at >= 0 and not seen[at]:
            seen[at] = True
            path.append(at)
            at = following[at]
        last = path[-1]
        out.append((int(number[i]), int(patch[i]), at >= 0, int(ahead[0][last]), int(ahead[1][last]), len(path), r0[path], c0[path]))
    return out


def doubled(chains: DataFrame) -> DataFrame:
    """(chain, ring, before): the least chain of each open chain's ring, and how many corners lie between that one's start and its own. ``chains``: chain, follower, n."""

    def counted(df: DataFrame, value) -> tuple[DataFrame, int]:
        kept = stored(df, "ring-rounds")
        return kept, kept.agg(value).first()[0]

    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    now, told = counted(chains.select("chain", "follower", F.least("chain", "follower").alias("ring")), total("ring"))
    while True:
        ahead = now.select(F.col("chain").alias("follower"), F.col("follower").alias("jump"), F.col("ring").alias("other"))
        further = now.join(ahead, "follower").select("chain", F.col("jump").alias("follower"), F.least("ring", "other").alias("ring"))
        before, (now, told) = told, counted(further, total("ring"))
        if told == before:
            break
    ring = now.select("chain", "ring")
    # From each chain on to the ring's first one, which ends the list.
    line = chains.join(ring, "chain").withColumn("to", F.when(F.col("follower") != F.col("ring"), F.col("follower")))
    start = line.select("chain", "ring", F.col("to").alias("follower"), F.col("n").cast("long").alias("far"))
    now, told = counted(start, F.count("follower"))
    while told:
        ahead = now.select(F.col("chain").alias("follower"), F.col("follower").alias("jump"), F.col("far").alias("more"))
        further = now.join(ahead, "follower", "left").select("chain", "ring", F.col("jump").alias("follower"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
        now, told = counted(further, F.count("follower"))
    whole = now.where("chain = ring").select("ring", F.col("far").alias("whole"))
    return now.join(whole, "ring").select("chain", "ring", (F.col("whole") - F.col("far")).alias("before"))


def outline_points(cells: DataFrame, grid: GridSpec, *, tile: int = 256) -> DataFrame:
    """(patch_id, ring, ordinal, x, y): the corners of each patch's rings, in order, of cells (patch_id, row, col), each in one patch. Rings go with the cells to the left, so holes go the other way."""

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = [pdf[c].to_numpy().astype(np.int64) for c in ("patch_id", "r0", "c0", "r1", "c1")]
        return pd.DataFrame(chains_of_tile(*columns), columns=["chain", "patch_id", "closed", "on_left", "on_right", "n", "r", "c"])

    place = lambda x: F.floor(F.col(x) / tile)
    chains = stored(sides(cells).groupBy(place("r0").alias("tr"), place("c0").alias("tc")).applyInPandas(trace, CHAIN), "ring-chains")
    open_ = chains.where("not closed")
    heads = open_.select(F.col("chain").alias("follower"), F.col("patch_id"))
    by = lambda side: heads.select(F.col("follower").alias(side), "patch_id", F.col("follower").alias(f"found_{side}"))
    met = open_.select("chain", "patch_id", "n", "on_left", "on_right").join(by("on_left"), ["on_left", "patch_id"], "left").join(by("on_right"), ["on_right", "patch_id"], "left")
    ranked = doubled(stored(met.select("chain", F.coalesce("found_on_left", "found_on_right").alias("follower"), "n"), "ring-ends"))
    every = chains.join(ranked, "chain", "left").select("patch_id", F.coalesce("ring", "chain").alias("ring"), F.coalesce("before", F.lit(0)).alias("before"), F.posexplode(F.arrays_zip("r", "c")))
    return every.select("patch_id", "ring", (F.col("before") + F.col("pos")).alias("ordinal"), (F.lit(grid.xmin) + F.col("col.c") * grid.resx).alias("x"), (F.lit(grid.ymax) - F.col("col.r") * grid.resy).alias("y"))
