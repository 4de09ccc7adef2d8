"""Small helpers for functions that get Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: The most bytes of an Arrow batch (but for a single longer row).
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets no Arrow batch take more than BATCH_BYTES, in this session from now on: by their number alone, rows of long texts make very large ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(BATCH_BYTES))


def given_back() -> None:
    """Returns freed memory to the system: a worker waits for its next task holding only what it uses."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``max_bytes`` at most; a longer row comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)
    given_back()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, one after another and without a copy, and where each starts and the last ends. Nulls are empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def as_bytes(column: pa.Array) -> list[bytes | None]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


class Recent:
    """A mapping of bounded size: entries not asked for during a whole generation go."""

    def __init__(self, size: int):
        self.size, self.young, self.old = max(1, size // 2), {}, {}

    def get(self, key):
        if (value := self.young.get(key)) is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value

    def with_all(self, keys: set, found) -> dict:
        """A mapping that has all of ``keys``; those that are new come from ``found`` (of a list of keys)."""
        young = self.young
        if new := keys.difference(young):
            known = {k: v for k in new if (v := self.old.get(k)) is not None} if self.old else {}
            if ask := [k for k in new if k not in known]:
                known |= zip(ask, found(ask))
            young.update(known)
            long = [k for k in ask if len(k) > 64]
            if long or len(young) >= self.size:
                # Long keys are for this call alone; a full generation grows old after it.
                kept = {k: v for k, v in young.items() if len(k) <= 64} if long else young
                self.young, self.old = ({}, kept) if len(kept) >= self.size else (kept, self.old)
        return young
