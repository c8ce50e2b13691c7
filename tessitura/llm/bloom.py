"""A Bloom filter of 64-bit values with a fixed largest size: built on the executors in sections, broadcast to later scans.

It only ever saves work: what passes it is decided exactly afterwards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import lean

_ODD = np.uint64(0x165667B19E3779F9)
_SECTION = 1 << 16  # bytes


def _slots(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    spread = values * _ODD
    return (spread >> np.uint64(9)) & mask, ((spread ^ (values >> np.uint64(31))) * _ODD >> np.uint64(20)) & mask


def build(values: DataFrame, max_bytes: int, bits_per_value: int = 16) -> np.ndarray:
    """values: one column of bigint. The driver gets the filter alone, max_bytes at most."""
    (name,) = values.columns
    n = values.count()
    bits = 1 << 13
    while bits < bits_per_value * n and bits < 8 * max_bytes:
        bits *= 2
    width = 8 * min(_SECTION, bits // 8)
    parts = bits // width

    @lean
    def slots(batches):
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.unique(np.concatenate(_slots(v, bits)))
            which = (at // np.uint64(width)).astype(np.int64)
            cuts = np.searchsorted(which, np.arange(parts + 1))
            rows = [(i, (at[a:z] % np.uint64(width)).astype("<u4").tobytes()) for i, (a, z) in enumerate(zip(cuts, cuts[1:])) if a < z]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary()), strict=True)], ["section", "slots"])

    def fill(table: pa.Table) -> pa.Table:
        part = np.zeros(width, bool)
        for x in table["slots"].to_pylist():
            part[np.frombuffer(x, "<u4")] = True
        return pa.table({"section": pa.array([table["section"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(part).tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    rows = values.select(F.col(name).cast("long")).mapInArrow(slots, "section int, slots binary").groupBy("section").applyInArrow(fill, "section int, bits binary")
    for r in rows.toLocalIterator():
        at = r["section"] * (width // 8)
        out[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def hits(bloom: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each of the 64-bit values whether the filter has it, or seems to."""
    out = np.ones(len(values), bool)
    for slot in _slots(values, 8 * len(bloom)):
        out &= (bloom[slot >> np.uint64(3)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return out
