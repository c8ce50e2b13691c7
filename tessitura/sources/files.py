"""Files that tasks write to a folder which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranged import file_system


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; unset, a session in one process gets one of its own, and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessitura-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save_files(rows: DataFrame, folder: str) -> int:
    """Write each row (name, content BINARY) to a file in folder; how many there are. A file gets its name when it is whole, so a
    task that runs twice leaves what a task that runs once does."""

    def run(batches):
        system, inner, _ = file_system(folder)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = f"{inner}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                system.move(part, f"{inner}/{name}")
            yield pa.RecordBatch.from_pydict({"written": [batch.num_rows]}, pa.schema([("written", pa.int64())]))

    return rows.select("name", "content").mapInArrow(run, "written bigint").agg(F.sum("written")).first()[0] or 0
