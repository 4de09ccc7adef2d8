"""Rasters in blocks: a row holds a tile of a layer as one packed array.

A row of cells takes some 20 bytes and a hash for a code of one byte. A block takes a byte for
each cell (four where codes don't fit), before compression, and says beside it which codes it has and how
often, so that areas need no pixels at all and class filters skip whole blocks.

Blocks are rows of (layer, layer_ix, tr, tc, size, wide, counts, data): tile row and column, the
cells of a side, whether codes take four bytes, (code, n) of the codes in it, and the codes row
by row, with 255 or the least 32-bit number where there is none. Two layers meet tile by tile, and the work within
a tile is numpy on whole arrays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralapse.grid import GridSpec, check_crs, check_patch_area
from terralapse.operators.patches import label_tile, seamed
from terralapse.operators.summarize import areas
from terralapse.operators.transition import PAIR, check_layers, labels, matrix, numbered, of_values
from terralapse.plans.storage import stored

SIZE = 256
NONE, WIDE_NONE = 255, -(1 << 31)
BLOCK = "layer string, layer_ix int, tr int, tc int, size int, wide boolean, counts array<struct<code:int,n:int>>, data binary"


def packed(codes: np.ndarray, known: np.ndarray) -> tuple[bool, list[tuple[int, int]], bytes]:
    """wide, counts and data of a square of codes; ``known`` tells which cells have one."""
    found, n = np.unique(codes[known], return_counts=True)
    wide = bool(len(found)) and (found[0] < 0 or found[-1] >= NONE)
    data = np.where(known, codes, WIDE_NONE).astype("<i4") if wide else np.where(known, codes, NONE).astype(np.uint8)
    return wide, list(zip(found.tolist(), n.tolist())), data.tobytes()


def unpacked(data: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes, and which cells have one."""
    codes = np.frombuffer(data, "<i4" if wide else np.uint8)
    return codes, codes != (WIDE_NONE if wide else NONE)


def blocks(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks of (layer, layer_ix, row, col, code). Of a cell that comes twice the greater code stays; null codes are none."""

    def pack(table: pa.Table) -> pa.Table:
        row, col, code = (table.column(c).to_numpy() for c in ("row", "col", "code"))
        order = np.argsort(code, kind="stable")
        square, known = np.zeros((size, size), np.int64), np.zeros((size, size), bool)
        at = row[order] % size, col[order] % size
        square[at], known[at] = code[order], True
        wide, counts, data = packed(square, known)
        first = {c: table.column(c)[0].as_py() for c in ("layer", "layer_ix", "tr", "tc")}
        return pa.Table.from_pylist([{**first, "size": size, "wide": wide, "counts": [{"code": c, "n": n} for c, n in counts], "data": data}], schema=SCHEMA)

    tile = lambda c: F.floor(F.col(c) / size).cast("int")
    given = cells.where("code is not null").select("layer", "layer_ix", "row", "col", "code", tile("row").alias("tr"), tile("col").alias("tc"))
    return given.groupBy("layer", "tr", "tc").applyInArrow(pack, BLOCK)


SCHEMA = pa.schema([("layer", pa.string()), ("layer_ix", pa.int32()), ("tr", pa.int32()), ("tc", pa.int32()), ("size", pa.int32()), ("wide", pa.bool_()), ("counts", pa.list_(pa.struct([("code", pa.int32()), ("n", pa.int32())]))), ("data", pa.binary())])


def cells(rows: DataFrame) -> DataFrame:
    """(layer, layer_ix, row, col, code) of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                codes, known = unpacked(b["data"], b["wide"])
                at = np.flatnonzero(known)
                n = len(at)
                row, col = b["tr"] * b["size"] + at // b["size"], b["tc"] * b["size"] + at % b["size"]
                same = [pa.array([b[c]] * n, t) for c, t in (("layer", pa.string()), ("layer_ix", pa.int32()))]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array(x.astype(np.int32)) for x in (row, col, codes[at]))], names=["layer", "layer_ix", "row", "col", "code"])

    return rows.select("layer", "layer_ix", "tr", "tc", "size", "wide", "data").mapInArrow(run, "layer string, layer_ix int, row int, col int, code int")


def has_code(codes: list[int]) -> Column:
    """Whether a block has one of the codes; its pixels aren't read for that."""
    return F.arrays_overlap("counts.code", F.array(*(F.lit(c) for c in codes)).cast("array<int>"))


def summarize_blocks(rows: DataFrame, grid: GridSpec, table: DataFrame, unit: str = "ha") -> DataFrame:
    """``summarize`` by the blocks' own counts: the scan reads no pixels."""
    check_crs(grid, "summarize")
    each = rows.select("layer", F.inline("counts"))
    return areas(each.groupBy("layer", "code").agg(F.sum("n").alias("n")), grid, table, unit)


def paired(rows: DataFrame, from_layer: str, to_layer: str, from_codes: list[int] | None = None, to_codes: list[int] | None = None) -> DataFrame:
    """(tr, tc, size, a, a_wide, b, b_wide): the tiles that both layers have; codes that are asked for skip blocks without them."""

    def side(layer: str, codes: list[int] | None, name: str) -> DataFrame:
        own = rows.where(F.col("layer") == layer)
        own = own if codes is None else own.where(has_code(codes) if codes else F.lit(False))
        return own.select("tr", "tc", F.col("size").alias(f"{name}_size"), F.col("data").alias(name), F.col("wide").alias(f"{name}_wide"))

    both = side(from_layer, from_codes, "a").join(side(to_layer, to_codes, "b"), ["tr", "tc"])
    return both.withColumn("size", F.when(F.col("a_size") == F.col("b_size"), F.col("a_size")).otherwise(F.raise_error(F.lit("blocks differ in size")))).drop("a_size", "b_size")


def both_known(b: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (by number) that both layers have, and their codes."""
    (x, kx), (y, ky) = unpacked(b["a"], b["a_wide"]), unpacked(b["b"], b["b_wide"])
    at = np.flatnonzero(kx & ky)
    return at, x[at].astype(np.int64), y[at].astype(np.int64)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(from_code, to_code, n): each task counts its tiles, and sends one row for a pair of codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        narrow, other = np.zeros(1 << 16, np.int64), Counter()
        for batch in batches:
            for b in batch.to_pylist():
                if b["a_wide"] or b["b_wide"]:
                    _, x, y = both_known(b)
                    found, n = np.unique(x * PAIR + y, return_counts=True)
                    other.update(dict(zip(found.tolist(), n.tolist())))
                else:
                    x, y = np.frombuffer(b["a"], np.uint8), np.frombuffer(b["b"], np.uint8)
                    narrow += np.bincount(x.astype(np.uint16) << 8 | y, minlength=1 << 16)
        at = np.flatnonzero(narrow)
        at = at[(at >> 8 != NONE) & (at & 255 != NONE)]
        other.update({int(i >> 8) * PAIR + int(i & 255): int(narrow[i]) for i in at})
        yield pa.RecordBatch.from_pydict({"value": pa.array(list(other), pa.int64()), "n": pa.array(list(other.values()), pa.int64())})

    counts = pairs.mapInArrow(run, "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    return of_values(counts).select("from_code", "to_code", "n")


@dataclass(frozen=True)
class BlockTransition:
    #: tr, tc, size, a, a_wide, b, b_wide: the pairs of blocks
    pairs: DataFrame
    levels: DataFrame
    summary: DataFrame
    from_codes: list[int] | None
    to_codes: list[int] | None
    grid: GridSpec


def codes_of(names: list[str] | None, table: DataFrame) -> list[int] | None:
    """Codes of the named classes; None for all."""
    return None if names is None else [r.code for r in table.where(F.col("class_name").isin(list(names))).collect()]  # a class table


def transition_blocks(rows: DataFrame, grid: GridSpec, from_layer: str, to_layer: str, table: DataFrame, *, from_class: list[str] | None = None, to_class: list[str] | None = None, unit: str = "ha") -> BlockTransition:
    """``transition`` of two layers of blocks, without a threshold: the same levels and summary."""
    check_crs(grid, "transition")
    wanted = codes_of(from_class, table), codes_of(to_class, table)
    pairs = paired(rows, from_layer, to_layer, *wanted)
    counts = stored(pair_counts(pairs), "block-counts")
    if counts.isEmpty():
        check_layers(rows, from_layer, to_layer)
    for column, codes in zip(("from_code", "to_code"), wanted):
        counts = counts if codes is None else counts.where(F.col(column).isin(codes) if codes else F.lit(False))
    return BlockTransition(pairs, *matrix(counts, grid, table, unit), *wanted, grid)


def patches_of_blocks(found: BlockTransition, table: DataFrame, *, changes_only: bool = False, patch_area_min: float | None = None) -> DataFrame:
    """``patches`` of blocks: each tile is labelled as an array; only its labels and the cells at its edges leave the task."""
    check_patch_area(patch_area_min)
    from_codes, to_codes = found.from_codes, found.to_codes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                at, x, y = both_known(b)
                keep = x != y if changes_only else np.ones(len(x), bool)
                for codes, of in ((from_codes, x), (to_codes, y)):
                    keep = keep if codes is None else keep & np.isin(of, codes)
                at, value, size = at[keep], (x * PAIR + y)[keep], b["size"]
                if not len(at):
                    continue
                r, c = at // size, at % size
                row, col = r + b["tr"] * size, c + b["tc"] * size
                label = label_tile(row, col, value)
                own, first, n = np.unique(label, return_index=True, return_counts=True)
                edge = (r == 0) | (r == size - 1) | (c == 0) | (c == size - 1)
                none = np.full(len(own), -1)
                columns = [np.concatenate(p) for p in ((none, row[edge]), (none, col[edge]), (value[first], value[edge]), (own, label[edge]), (n, np.zeros(edge.sum(), np.int64)))]
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(t)) for v, t in zip(columns, (np.int32, np.int32, np.int64, np.int64, np.int64))], names=["row", "col", "value", "label", "n"])

    told = stored(found.pairs.mapInArrow(run, "row int, col int, value long, label long, n long"), "block-labels")
    parts = seamed(told.where("n = 0").drop("n"), told.where("n > 0").select("label", "n", "value"), same_value=True)
    whole = parts.groupBy("patch").agg(F.sum("n").alias("n"), F.min("value").alias("value"))
    whole = whole.where(F.col("n") * found.grid.cell_area >= patch_area_min) if patch_area_min else whole
    named = labels(of_values(numbered(stored(whole, "block-patches"), "patch")), table)
    return named.select("patch_id", F.concat("from_class", F.lit(" -> "), "to_class").alias("transition"), (F.col("n") * F.lit(found.grid.cell_area * 1e-4)).alias("area_ha"), F.col("n").cast("int").alias("n_cells"))


def consensus_of_blocks(rows: DataFrame) -> DataFrame:
    """``consensus`` of all layers of blocks: (row, col, code, confidence) by the votes of a tile's layers, the first layer's code on ties."""

    def run(table: pa.Table) -> pa.Table:
        own = sorted(table.select(["layer_ix", "wide", "data"]).to_pylist(), key=lambda b: b["layer_ix"])
        size, tr, tc = (table.column(c)[0].as_py() for c in ("size", "tr", "tc"))
        layers = [unpacked(b["data"], b["wide"]) for b in own]
        found = np.unique(np.concatenate([codes[known] for codes, known in layers]).astype(np.int64))
        best, most, total, first = (np.full(size * size, v, np.int64) for v in (0, 0, 0, len(layers)))
        for code in found:
            votes, seen = np.zeros(size * size, np.int64), np.full(size * size, len(layers), np.int64)
            for k, (codes, known) in enumerate(layers):
                here = known & (codes == code)
                votes += here
                seen = np.where(here & (seen == len(layers)), k, seen)
            total += votes
            better = (votes > most) | ((votes == most) & (votes > 0) & (seen < first))
            best, first, most = np.where(better, code, best), np.where(better, seen, first), np.where(better, votes, most)
        at = np.flatnonzero(total)
        columns = [(tr * size + at // size).astype(np.int32), (tc * size + at % size).astype(np.int32), best[at].astype(np.int32), most[at] / total[at]]
        return pa.Table.from_arrays([pa.array(c) for c in columns], names=["row", "col", "code", "confidence"])

    return rows.select("layer_ix", "tr", "tc", "size", "wide", "data").groupBy("tr", "tc").applyInArrow(run, "row int, col int, code int, confidence double")
