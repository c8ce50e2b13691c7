"""Folds over the rows of each track, for what depends on the row before."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

TYPES = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def fold_tracks(rows: DataFrame, fold: Callable[[int, list[tuple]], Iterable[tuple]], schema: str, rows_each: int = 20_000) -> DataFrame:
    """What fold(track, rows) gives of each track, its rows being tuples of the other columns in no order.

    Tracks are dealt to all shuffle partitions by key and sorted there, and a task takes its tracks from one stream of batches: a
    group of its own costs milliseconds, whatever it holds, and tracks are many and short. A task holds one track's rows and at
    most rows_each results and one track's more. rows: track_id and further columns."""
    others = [c for c in rows.columns if c != "track_id"]
    fields = [f.split() for f in schema.split(", ")]
    shape = pa.schema([(name, TYPES[kind]) for name, kind in fields])

    def run(batches):
        track, held, out = None, [], []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

        for b in batches:
            keys = b.column(0).to_pylist()
            values = list(zip(*(b.column(i).to_pylist() for i in range(1, b.num_columns)), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if keys[a] != track and held:
                    out.extend(fold(track, held))
                    held = []
                track = keys[a]
                held.extend(values[a:z])
            if len(out) >= rows_each:
                yield batch()
                out = []
        if held:
            out.extend(fold(track, held))
        if out:
            yield batch()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("track_id", *others).repartition(parts, "track_id").sortWithinPartitions("track_id").mapInArrow(run, schema)
