"""WAV and FLAC files as a Spark data source that reads byte ranges: ``audio_blocks``, ``audio_probe`` and the stream ``audio_chunks``.

A partition is a run of blocks of one file; planning lists names and sizes alone, and a task reads the header and then only the
bytes of the blocks it gives. Filters on path, block_no, start_frame and start_sec reach the source, so a preview of a long file
reads the preview. Files are opened through Arrow's file systems (local, s3, hdfs, ...), by the scheme of the path.

Files that cannot be read become one row with an error; a damaged FLAC frame becomes a row with an error, and its samples are
zeros, so that the grid of blocks holds. A file without samples has no block."""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader

from . import flac
from .wav import fold_to_stereo, scaled

BLOCKS = "path string, block_no int, start_frame bigint, start_sec double, sample_rate int, channels int, samples array<float>, error string"
PROBE = "path string, sample_rate int, channels int, n_frames bigint, seconds double, tags map<string, string>, error string"
PLAN = "path string, event string, chunk_no int, start_frame bigint, behind bigint, sample_rate int, channels int, error string"
# RIFF INFO chunks by the key they stand for.
INFO_KEYS = {b"INAM": "title", b"IART": "artist", b"IPRD": "album", b"ICRD": "date", b"IGNR": "genre"}
SUFFIXES = (".wav", ".flac")
HEAD = 4096
_BLOCK_TYPES = pa.schema([("path", pa.string()), ("block_no", pa.int32()), ("start_frame", pa.int64()), ("start_sec", pa.float64()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])


def file_system(path: str):
    """(file system, path in it, what to put before a path of it)."""
    from pyarrow import fs

    scheme = re.match(r"^([a-z][a-z0-9+.-]*):", path)
    if scheme is None:
        return fs.LocalFileSystem(), path, ""
    if scheme[1] == "file":
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path), "file:"
    system, inner = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else f"{scheme[1]}://"


def list_files(path: str, most_bytes: int = 10 << 30, suffixes=SUFFIXES) -> list[tuple[str, int, int]]:
    """(path, bytes, modified) of the supported files at or under a path, by name."""
    from pyarrow import fs

    system, inner, before = file_system(path)
    found = system.get_file_info(inner)
    if found.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    elif found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    else:
        found = [found]
    return sorted((before + f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffixes) and f.size <= most_bytes)


class Ranges:
    """Reads of one file by place, the first bytes kept; bytes_read counts what was asked of the file system."""

    bytes_read = 0

    def __init__(self, path: str):
        system, inner, _ = file_system(path)
        self.file = system.open_input_file(inner)
        self.length = self.file.size()
        self.head = self._fetch(0, HEAD)

    def _fetch(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.length - at))
        Ranges.bytes_read += n
        return self.file.read_at(n, at) if n else b""

    def __call__(self, at: int, n: int) -> bytes:
        return self.head[at : at + n] if at + n <= len(self.head) else self._fetch(at, n)

    def close(self) -> None:
        self.file.close()


@dataclass(frozen=True)
class Wav:
    rate: int
    channels: int
    code: int
    bits: int
    frames: int
    begin: int
    tags: dict

    def samples(self, read, length, first, behind):
        """(start, size, float samples x channels, error) of a range, at most 65536 frames at a time."""
        width = self.channels * self.bits // 8
        for at in range(first, min(behind, self.frames), 65_536):
            size = min(65_536, behind - at, self.frames - at)
            yield at, size, scaled(read(self.begin + at * width, size * width), self.code, self.bits).reshape(-1, self.channels), None


@dataclass(frozen=True)
class Flac:
    info: flac.Info

    rate = property(lambda self: self.info.rate)
    channels = property(lambda self: self.info.channels)
    frames = property(lambda self: self.info.frames)
    tags = property(lambda self: self.info.tags)

    def samples(self, read, length, first, behind):
        for start, size, x, error in flac.decode_range(read, length, self.info, first, min(behind, self.frames)):
            yield start, size, None if x is None else (x / 2.0 ** (self.info.bits - 1)).astype(np.float32), error


def read_header(read, length: int) -> Wav | Flac:
    """What a file says of itself, from its headers alone. Chunks are passed by their sizes."""
    head = read(0, 12)
    if head[:4] == b"fLaC":
        return Flac(flac.read_info(read))
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form, place, size, tags = 12, None, None, 0, {}
    while at + 8 <= length:
        kind, (n,) = (h := read(at, 8))[:4], struct.unpack("<I", h[4:])
        if kind == b"fmt ":
            body = read(at + 8, min(n, 40))
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            form = (struct.unpack("<H", body[24:26])[0] if code == 0xFFFE and len(body) >= 26 else code, channels, rate, bits)
        elif kind == b"data" and place is None:
            place, size = at + 8, min(n, length - at - 8)
        elif kind == b"LIST" and n <= 1 << 20 and read(at + 8, 4) == b"INFO":
            tags |= _info(read(at + 12, n - 4))
        at += 8 + n + n % 2
    if form is None:
        raise ValueError("no fmt chunk")
    if place is None:
        raise ValueError("no data chunk")
    code, channels, rate, bits = form
    if not channels or not rate or (code, bits) not in {(1, 16), (1, 24), (1, 32), (3, 32), (3, 64)}:
        raise ValueError(f"format {code} of {bits} bits and {channels} channels is not supported")
    return Wav(rate, channels, code, bits, size // (channels * bits // 8), place, tags)


def _info(body: bytes) -> dict[str, str]:
    tags, at = {}, 0
    while at + 8 <= len(body):
        key, (n,) = body[at : at + 4], struct.unpack("<I", body[at + 4 : at + 8])
        tags[INFO_KEYS.get(key, key.decode("latin-1").lower())] = body[at + 8 : at + 8 + n].split(b"\0")[0].decode("utf-8", "replace")
        at += 8 + n + n % 2
    return tags


def folded(x: np.ndarray, mono: bool) -> np.ndarray:
    return x.mean(1, dtype=np.float64).astype(np.float32) if mono else fold_to_stereo(x).reshape(-1)


def block_rows(path: str, read, length: int, media, first: int, behind: int, block: int, mono: bool):
    """Rows of blocks first to behind - 1 of a file; a damaged stretch gives its row and zeros."""
    wide = 1 if mono else 2
    number, at = first, first * block
    stop = min(behind * block, media.frames)
    held = np.zeros(max(0, min(block, stop - at)) * wide, np.float32)

    def row(no, samples, error=None, start=None):
        start = no * block if start is None else start
        return (path, no, start, start / media.rate, media.rate, media.channels, samples, error)

    for start, size, x, error in media.samples(read, length, at, stop):
        if error:
            yield row(start // block, None, error, start)
        y = None if x is None else folded(x, mono)
        low, high = max(start, first * block), min(start + size, stop)
        while low < high:
            no = low // block
            while number < no:  # the block before is full
                yield row(number, held)
                number += 1
                held = np.zeros(min(block, stop - number * block) * wide, np.float32)
            end = min(high, (no + 1) * block)
            if y is not None:
                held[(low - no * block) * wide : (end - no * block) * wide] = y[(low - start) * wide : (end - start) * wide]
            low = end
    while number * block < stop:
        yield row(number, held)
        number += 1
        held = np.zeros(max(0, min(block, stop - number * block)) * wide, np.float32)


class Bounds:
    """Closed intervals and sets of values by column, from the filters that Spark offers."""

    def __init__(self):
        self.low, self.high, self.among = {}, {}, {}

    def add(self, f) -> None:
        name, value = getattr(f, "attribute", (None,)), getattr(f, "value", None)
        if len(name) != 1 or isinstance(value, bool):
            return
        (name,) = name
        if isinstance(f, In):
            self.among[name] = set(f.value) & self.among.get(name, set(f.value))
        elif isinstance(f, EqualTo) and isinstance(value, str):
            self.among[name] = {value} & self.among.get(name, {value})
        elif isinstance(value, (int, float)):
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low[name] = max(value, self.low.get(name, value))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high[name] = min(value, self.high.get(name, value))

    def blocks(self, first: int, behind: int, block: int, rate: int) -> tuple[int, int]:
        """The blocks of a range that may pass: bounds are widened to whole blocks, Spark tests the rows again."""
        for name, unit in (("block_no", 1.0), ("start_frame", 1.0 / block), ("start_sec", rate / block)):
            if name in self.low:
                first = max(first, int(np.floor(self.low[name] * unit)) - (unit != 1.0))
            if name in self.high:
                behind = min(behind, int(np.floor(self.high[name] * unit)) + 2)
        return first, max(first, behind)


class BlockReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.block, self.mono = options["path"], int(options.get("block", 65_536)), options.get("mono", "true").lower() == "true"
        self.most_bytes, self.part_bytes = int(options.get("mostBytes", 10 << 30)), int(options.get("partitionBytes", 64 << 20))
        self.bounds = Bounds()

    def pushFilters(self, filters):
        for f in filters:
            self.bounds.add(f)
        return filters  # Spark tests them on the rows as well: what is skipped here is whole blocks

    def partitions(self):
        wanted = self.bounds.among.get("path")
        parts = []
        for path, size, _ in list_files(self.path, self.most_bytes):
            if wanted is None or path in wanted:
                of = max(1, -(-size // self.part_bytes))
                parts += [InputPartition((path, n, of)) for n in range(of)]
        return parts or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        path, part, of = partition.value
        try:
            read = Ranges(path)
            media = read_header(read, read.length)
        except (ValueError, OSError, struct.error) as e:
            if part == 0:
                yield _batch([(path, 0, 0, None, None, None, None, str(e))])
            return
        blocks = -(-media.frames // self.block)
        first, behind = self.bounds.blocks(blocks * part // of, blocks * (part + 1) // of, self.block, media.rate)
        for row in block_rows(path, read, read.length, media, first, behind, self.block, self.mono) if first < behind else ():
            yield _batch([row])
        read.close()


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOCK_TYPES)], schema=_BLOCK_TYPES)


class AudioBlocks(DataSource):
    """spark.read.format("audio_blocks").option("block", 65536).option("mono", True).load(path)."""

    @classmethod
    def name(cls):
        return "audio_blocks"

    def schema(self):
        return BLOCKS

    def reader(self, schema):
        return BlockReader(self.options)


class ProbeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.most_bytes, self.each = options["path"], int(options.get("mostBytes", 10 << 30)), int(options.get("filesEach", 64))

    def partitions(self):
        names = [path for path, _, _ in list_files(self.path, self.most_bytes)]
        return [InputPartition(names[i : i + self.each]) for i in range(0, len(names), self.each)] or [InputPartition([])]

    def read(self, partition):
        for path in partition.value:
            try:
                read = Ranges(path)
                m = read_header(read, read.length)
                read.close()
                yield path, m.rate, m.channels, m.frames, m.frames / m.rate, m.tags, None
            except (ValueError, OSError, struct.error) as e:
                yield path, None, None, None, None, {}, str(e)


class AudioProbe(DataSource):
    """One row a file: rate, channels, frames, seconds and tags, from headers alone."""

    @classmethod
    def name(cls):
        return "audio_probe"

    def schema(self):
        return PROBE

    def reader(self, schema):
        return ProbeReader(self.options)


class ChunkPlan(SimpleDataSourceStreamReader):
    """Which chunks come next, as small rows; the offset is the last file begun, in order of its time and name, and its next frame.

    Each trigger plans at most chunksPerTrigger chunks, so a long file is many micro-batches, and a stream that starts again goes
    on within a file. Files must arrive in the order of their times. A file whose name lies in the cancel folder gets no further
    chunk and no end."""

    def __init__(self, options):
        self.path, self.chunk = options["path"], max(int(options.get("chunk", 65_536)), 16_384)
        self.most, self.cancel = int(options.get("chunksPerTrigger", 64)), options.get("cancel")

    def initialOffset(self):
        return {"time": -1, "path": "", "frame": -1}

    def read(self, start):
        rows, end = self._plan(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start, end):
        return iter(self._plan(start, end)[0])

    def _plan(self, start, end):
        """Rows from one offset to another, or as many as a trigger gives; frame -1 is a file that ended."""
        at, left, rows = dict(start), self.most, []
        for path, _, time in sorted(list_files(self.path), key=lambda f: (f[2], f[0])):
            place = (time, path)
            if place < (at["time"], at["path"]) or (place == (at["time"], at["path"]) and at["frame"] < 0):
                continue
            if (end is None and left <= 0) or (end is not None and place > (end["time"], end["path"])):
                break
            frame = at["frame"] if place == (at["time"], at["path"]) else 0
            stop = end["frame"] if end is not None and place == (end["time"], end["path"]) else -1
            rows_of, frame, left = self._file(path, frame, stop, left if end is None else 1 << 60)
            rows += rows_of
            at = {"time": time, "path": path, "frame": frame}
        return rows, at if end is None else end

    def _file(self, path, frame, stop, left):
        try:
            read = Ranges(path)
            media = read_header(read, read.length)
            read.close()
        except (ValueError, OSError, struct.error) as e:
            return [(path, "error", None, 0, None, None, None, str(e))], -1, left - 1
        rows = [] if frame else [(path, "started", None, 0, media.frames, media.rate, media.channels, None)]
        until = media.frames if stop < 0 else stop
        while frame < until and left > 0 and not self._cancelled(path):
            behind = min(frame + self.chunk, media.frames)
            rows.append((path, "chunk", frame // self.chunk, frame, behind, media.rate, media.channels, None))
            frame, left = behind, left - 1
        if self._cancelled(path):
            return rows, -1, left
        if frame >= media.frames and stop < 0 and left > 0:
            rows += [(path, event, None, media.frames, media.frames, media.rate, media.channels, None) for event in ("finished", "source_hash")]
            return rows, -1, left - 1
        return rows, frame, left

    def _cancelled(self, path):
        if not self.cancel:
            return False
        from pyarrow import fs

        system, inner, _ = file_system(self.cancel)
        return system.get_file_info(f"{inner.rstrip('/')}/{path.rpartition('/')[2]}").type == fs.FileType.File


class AudioChunks(DataSource):
    """spark.readStream.format("audio_chunks"): the plan of chunks of the files that arrive in a folder."""

    @classmethod
    def name(cls):
        return "audio_chunks"

    def schema(self):
        return PLAN

    def simpleStreamReader(self, schema):
        return ChunkPlan(self.options)


def register_audio(spark: SparkSession) -> None:
    """Make the formats known to a session and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (AudioBlocks, AudioProbe, AudioChunks):
        spark.dataSource.register(source)


def chunk_events(plan: DataFrame, mono: bool = True) -> DataFrame:
    """The rows of an ``audio_chunks`` plan with their samples: each chunk's task reads the chunk's bytes. A damaged stretch is
    zeros, and its error stands in the chunk's row. source_hash rows have the file's SHA-256 in error's place, read in pieces."""
    schema = PLAN.replace("behind bigint, ", "").replace("error string", "samples array<float>, error string")

    def run(batches):
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.string())
        for batch in batches:
            for row in batch.to_pylist():
                samples = None
                if row["event"] in ("chunk", "source_hash"):
                    try:
                        read = Ranges(row["path"])
                        if row["event"] == "chunk":
                            samples, row["error"] = _chunk(read, row, mono)
                        else:
                            digest = hashlib.sha256()
                            for at in range(0, read.length, 1 << 20):
                                digest.update(read(at, 1 << 20))
                            row["error"] = digest.hexdigest()
                        read.close()
                    except (ValueError, OSError, struct.error) as e:  # the file went or changed after it was planned
                        row["event"], row["error"] = "error", str(e)
                values = (row["path"], row["event"], row["chunk_no"], row["start_frame"], row["sample_rate"], row["channels"], samples, row["error"])
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in schema.split(", ")])

    return plan.mapInArrow(run, schema)


def _chunk(read, row, mono):
    media, size = read_header(read, read.length), row["behind"] - row["start_frame"]
    errors, out = [], np.zeros(size * (1 if mono else 2), np.float32)
    for start, n, x, error in media.samples(read, read.length, row["start_frame"], row["behind"]):
        if error:
            errors.append(error)
            continue
        low, high = max(start, row["start_frame"]), min(start + n, row["behind"])
        wide, y = 1 if mono else 2, folded(x, mono)
        out[(low - row["start_frame"]) * wide : (high - row["start_frame"]) * wide] = y[(low - start) * wide : (high - start) * wide]
    return out, "; ".join(errors) or None


def preview(blocks: DataFrame, start_sec: float, seconds: float, block: int = 65_536, least_rate: int = 8_000) -> DataFrame:
    """The part of each file that a preview of 0.25 to 30 seconds plays: (path, sample_rate, samples), whole files' blocks cut to it.

    blocks come from ``audio_blocks`` (mono) with this block size; bounds on start_sec reach the source. least_rate says how long
    a block can last."""
    seconds, start_sec = min(30.0, max(0.25, seconds)), max(0.0, start_sec)
    near = blocks.where((F.col("start_sec") < start_sec + seconds) & (F.col("start_sec") >= start_sec - block / least_rate) & F.col("samples").isNotNull())
    first = F.floor(F.lit(start_sec) * F.col("sample_rate")).cast("bigint")
    low = F.greatest(F.lit(0), first - F.col("start_frame"))
    high = F.least(F.size("samples").cast("bigint"), first + F.ceil(F.lit(seconds) * F.col("sample_rate")).cast("bigint") - F.col("start_frame"))
    parts = near.where(high > low).select("path", "sample_rate", "start_frame", F.slice("samples", (low + 1).cast("int"), (high - low).cast("int")).alias("part"))
    joined = parts.groupBy("path", "sample_rate").agg(F.array_sort(F.collect_list(F.struct("start_frame", "part"))).alias("parts"))
    return joined.select("path", "sample_rate", F.flatten(F.transform("parts", lambda p: p["part"])).alias("samples"))
