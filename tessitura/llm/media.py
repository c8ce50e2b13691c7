"""Media columns: content-addressed payloads in tar shards.

A text becomes an image: its UTF-8 bytes, padded with spaces to whole rows of 192, are the samples of an 8-bit grey PNG,
which is lossless. Each distinct payload is stored once, under its SHA-256, in a tar shard; the index holds digest, shard,
offset and length. Reading starts with a range read of the header alone, which fills the metadata columns; the payload
itself is read where features are asked for.

No payload moves through a shuffle: digests are dealt, each gets one owner among its rows, and the owner's map task stores
the payload. A payload that a third of all rows share is thus one row's work. A shard's name holds the task attempt: a lost task leaves an orphan, and only the
index that Spark commits says which shards count. Shards go through pyarrow's file systems to the shared folder.

Defined cases: null text is empty and becomes one row of spaces; repeated rows share a payload; a null id is kept; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import build, hits
from .common import materialize

WIDTH = 192
HEADER_BYTES = 33  # signature and the first chunk, which has the size
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
INDEX_SCHEMA = "digest binary, shard string, offset bigint, length bigint"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder as Spark names it; the S3 connectors' schemes mean the same store."""
    scheme, mark, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else uri)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit grey PNG whose samples are the payload's bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    size = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", size) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> dict:
    """Width, height and bit depth from an image's first HEADER_BYTES bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return {"width": width, "height": height, "bit_depth": depth}


def decode_image(media: bytes) -> bytes:
    head, at, data = read_header(media[:HEADER_BYTES]), 8, []
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(head["height"], head["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("only filter type 0 is written")
    return lines[:, 1:].tobytes()


def payload_feature(payload: bytes) -> str:
    """Sample statistics as text: equal payloads give equal strings."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    return f"sum={int(samples.sum(dtype=np.int64))};kinds={int((counts > 0).sum())};mode={int(counts.argmax())};adler32={zlib.adler32(payload):08x}"


def with_payload(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload, its digest, and a key of the row; all in the JVM."""
    raw = documents.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))
    sized = raw.withColumn("n_bytes", F.length("raw").cast("long")).withColumn("padded", F.expr(f"cast(greatest(1, ceil(n_bytes / {WIDTH})) * {WIDTH} as int)"))
    rows = sized.select("doc_id", "n_bytes", F.expr("rpad(raw, padded, X'20')").alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    return rows.withColumn("key", F.xxhash64("doc_id", "digest"))


def _write(payloads: DataFrame, root: str, path: str, skip: np.ndarray, take: bool, shard_bytes: int) -> None:
    """Store the payloads whose key the filter skip does not have (with take: has) in this task's shards; write their index."""
    shared = payloads.sparkSession.sparkContext.broadcast(skip)

    def write(batches):
        files, top = open_folder(root)
        files.create_dir(top, recursive=True)
        task = TaskContext.get()
        seen: set[bytes] = set()  # 32 bytes a row of this partition
        shard, n = None, 0
        for batch in batches:
            rows = []
            keys = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i in np.flatnonzero(hits(shared.value, keys) == take):
                digest = batch.column(0)[int(i)].as_py()
                if digest in seen:
                    continue
                seen.add(digest)
                media = encode_image(batch.column(1)[int(i)].as_py())
                if shard is None or shard[1].offset >= shard_bytes:
                    if shard:
                        shard[1].close()
                        shard[2].close()
                    name = f"shard-{task.stageId():05d}-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.tar"
                    sink = files.open_output_stream(f"{top}/{name}")
                    shard, n = (name, tarfile.open(mode="w|", fileobj=sink, format=tarfile.USTAR_FORMAT), sink), n + 1
                info = tarfile.TarInfo(f"{digest.hex()[:2]}/{digest.hex()}.png")
                info.size = len(media)
                at = shard[1].offset + tarfile.BLOCKSIZE  # the member follows its header block
                shard[1].addfile(info, io.BytesIO(media))
                rows.append((digest, shard[0], at, len(media)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["digest", "shard", "offset", "length"])
        if shard:
            shard[1].close()
            shard[2].close()

    payloads.select("digest", "payload", "key").mapInArrow(write, INDEX_SCHEMA).write.mode("append").parquet(path)


def write_shards(payloads: DataFrame, slim: DataFrame, root: str, shard_bytes: int = 256 << 20, filter_bytes: int = 64 << 20) -> DataFrame:
    """Store each distinct payload once below root; the index table, written and read back.

    Each digest has an owner, its row of least key. The keys of all other rows make a Bloom filter: a row it doesn't have owns
    its payload, and its map task stores it. The few owners that the filter has by chance follow in a second pass."""
    spark = payloads.sparkSession
    owners = materialize(slim.groupBy("digest").agg(F.min("key").alias("owner")), "owners")
    copies = slim.join(owners, "digest").where("key != owner").select("key").distinct()
    skip = build(copies, filter_bytes)
    _write(payloads, root, f"{root}/index", skip, False, shard_bytes)
    shared = spark.sparkContext.broadcast(skip)

    def chance(batches):
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[hits(shared.value, keys.view(np.uint64))])], ["owner"])

    doubtful = materialize(owners.select("owner").mapInArrow(chance, "owner bigint"), "doubtful")
    if not doubtful.isEmpty():
        again = spark.sparkContext.broadcast(build(doubtful, filter_bytes))

        def likely(batches):
            for b in batches:
                keys = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                yield b.filter(pa.array(hits(again.value, keys)))

        rest = payloads.select("digest", "payload", "key").mapInArrow(likely, "digest binary, payload binary, key bigint")
        _write(rest.join(doubtful, rest["key"] == doubtful["owner"], "left_semi"), root, f"{root}/index", skip, True, shard_bytes)
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{root}/index")
    # rows that repeat id and text have one key, and may have stored a payload in more than one task
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.shard", "at.offset", "at.length")


def read_media(index: DataFrame, root: str, payload_columns: bool = True) -> DataFrame:
    """Metadata of each stored payload by a range read of its header; with payload_columns also what its bytes give.

    Neighbours in a shard are read by one task, 16 MB of a shard at a time."""
    kinds = "digest binary, width int, height int, bit_depth int, media_bytes bigint"
    if payload_columns:
        kinds += ", payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_sha256 string, feature string"
    names = [c.split()[0] for c in kinds.split(", ")]
    types = {"binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}

    def read(batches):
        files, top = open_folder(root)
        name, source = None, None
        for batch in batches:
            rows = []
            for digest, shard, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != name:
                    if source:
                        source.close()
                    name, source = shard, files.open_input_file(f"{top}/{shard}")
                source.seek(offset)
                head = read_header(source.read(HEADER_BYTES))
                row = [digest, head["width"], head["height"], head["bit_depth"], length]
                if payload_columns:
                    source.seek(offset)
                    media = source.read(length)
                    payload = decode_image(media)
                    row += [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(media).hexdigest(), payload_feature(payload)]
                rows.append(row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, types[k.split()[1]]) for c, k in zip(zip(*rows, strict=True), kinds.split(", "), strict=True)], names)
        if source:
            source.close()

    near = index.withColumn("block", F.floor(F.col("offset") / (16 << 20))).repartition("shard", "block").sortWithinPartitions("shard", "offset")
    return near.select("digest", "shard", "offset", "length").mapInArrow(read, kinds)


def media_columns(documents: DataFrame, root: str) -> DataFrame:
    """Each row with where its payload lies and what its stored form says."""
    rows = with_payload(documents)
    slim = materialize(rows.select("doc_id", "n_bytes", "digest", "key"), "digests")
    index = materialize(write_shards(rows, slim, root), "media-index")
    placed = materialize(index.join(read_media(index, root), "digest"), "media")
    return slim.select("doc_id", "n_bytes", "digest").join(placed, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth", "shard", "offset", "length"
    )
