"""Media columns: payloads in tar shards, addressed by their content.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, become the samples of an 8-bit greyscale PNG
image 64 wide, which loses nothing and deflates the bytes. `ingest` writes each task's images to tar shards in a
shared folder, one entry for each digest, named by it; rows carry digest, shard, offset and length. All rows of a
digest then point to one entry, the first, so that equal payloads have equal addresses; entries of the same digest in
other shards, one a shard at most, are left unreferenced. Payloads are never shuffled. `headers` fills width, height
and depth from range reads of the first 33 bytes alone; `read_back` reads whole entries, each digest once. Both deal
entries out by the bytes that are stored, at most READ_BYTES of a shard to a task.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import BATCH_ROWS, SLICE_BYTES, documents, shared_folder, slices, table

WIDTH = 64
#: Bytes after which a task starts another shard; bytes of signature and header of an image.
SHARD_BYTES, HEADER_BYTES = 256 << 20, 33
#: Stored bytes of one shard that one task reads.
READ_BYTES = 64 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> tuple[bytes, int]:
    """The padded bytes of a text (null: empty) and their number before padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(samples: bytes, level: int = 4) -> bytes:
    """A greyscale image of rows of WIDTH samples of 8 bits, unfiltered."""
    rows = np.zeros((len(samples) // WIDTH, WIDTH + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(raw: bytes) -> tuple[int, int, int]:
    """Width, height and depth from the first HEADER_BYTES of an image."""
    if raw[:8] != SIGNATURE or raw[12:16] != b"IHDR" or zlib.crc32(raw[12:29]) != struct.unpack(">I", raw[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", raw[16:25])


def from_png(raw: bytes) -> bytes:
    """The samples of an image that to_png made; checks all chunks."""
    width, height, _ = png_header(raw[:HEADER_BYTES])
    at, packed = 8, []
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        data = raw[at + 8 : at + 8 + size]
        if zlib.crc32(data, zlib.crc32(kind)) != struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        packed += [data] if kind == b"IDAT" else []
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def features(samples: bytes, shape: tuple[int, int, int]) -> str:
    """Shape, mean, entropy of the histogram in bits, and the share of samples from 128 up."""
    n = np.bincount(np.frombuffer(samples, dtype=np.uint8), minlength=256).astype(np.float64)
    p = n[n > 0] / n.sum()
    return f"{shape[0]}x{shape[1]}x{shape[2]} mean {n @ np.arange(256) / n.sum():.3f} entropy {max(0.0, -(p * np.log2(p)).sum()):.4f} high {n[128:].sum() / n.sum():.4f}"


# -- shards ---------------------------------------------------------------------------------------------------------


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI and the folder's path there, as any executor sees it."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


class Shards:
    """A task's tar files. A repeated attempt writes files of its own, to which only its own rows point."""

    def __init__(self, folder: str, partition: int):
        self.system, self.folder = filesystem(folder)
        self.prefix, self.number, self.out, self.seen = f"shard-{partition:06d}-{uuid.uuid4().hex}", 0, None, {}

    def put(self, digest: str, make) -> tuple[str, int, int]:
        """The address of the entry named `digest`, which holds the bytes `make()` returns and is written once."""
        if digest not in self.seen:
            if self.out is None:
                self.name, self.at = f"{self.prefix}-{self.number:04d}.tar", 0
                self.system.create_dir(self.folder, recursive=True)
                self.out = self.system.open_output_stream(f"{self.folder}/{self.name}")
            data = make()
            entry = tarfile.TarInfo(f"{digest}.png")
            entry.size = len(data)
            head = entry.tobuf(tarfile.GNU_FORMAT)
            self.out.write(head + data + bytes(-len(data) % 512))
            self.seen[digest] = (self.name, self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % 512
            found = self.seen[digest]
            if self.at >= SHARD_BYTES:
                self.close()
            return found
        return self.seen[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out, self.seen, self.number = None, {}, self.number + 1


def ingest(docs: DataFrame, folder: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes the payloads to shards in `folder`. Two tables: doc_id, n_bytes and digest (of the payload) for every row, and
    digest, shard, offset and length of the one entry to which all rows of a digest point."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    source = docs.select("doc_id", F.col(text).cast("string").alias("__text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder, TaskContext.get().partitionId())
        try:
            for whole in batches:
                for part in slices(whole, "__text", SLICE_BYTES):
                    rows = []
                    for samples, n in map(payload, part.column("__text").to_pylist()):
                        digest = hashlib.sha256(samples)
                        rows.append((n, digest.digest(), *shards.put(digest.hexdigest(), lambda samples=samples: to_png(samples))))
                    n, digest, shard, offset, length = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest), pa.array(shard), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            shards.close()

    made = table(source.mapInArrow(write, f"doc_id {kind}, n_bytes long, digest binary, shard string, offset long, length long"), "payloads")
    first = made.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return made.select("doc_id", "n_bytes", "digest"), table(first.select("digest", "at.*"), "entries")


def range_reads(rows: Iterator[tuple], system: fs.FileSystem, root: str, work: Callable) -> Iterator[tuple]:
    """Rows (shard, offset, length, ...) with what work(read, row) makes of each, where read(n) gives an entry's first n bytes; a shard stays open while rows are its own."""
    name, source = None, None
    for row in rows:
        if row[0] != name:
            if source is not None:
                source.close()
            name, source = row[0], system.open_input_file(f"{root}/{row[0]}")
        yield (*row, *work(lambda n, at=row[1]: source.read_at(n, at), row))
    if source is not None:
        source.close()


def _ranged(entries: DataFrame, folder: str, fields: str, work: Callable) -> DataFrame:
    """`entries` and what range_reads makes of each, by blocks of shards in the order of their places."""
    columns = ["shard", "offset", "length", *(c for c in entries.columns if c not in ("shard", "offset", "length"))]
    block = F.floor(F.col("offset") / READ_BYTES)
    blocks = entries.select("shard", block).distinct().count()
    names = [*columns, *(f.split()[0] for f in fields.split(", "))]
    source = entries.select(*columns).repartition(max(1, blocks), "shard", block).sortWithinPartitions("shard", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(len(columns))), strict=True))
        found = range_reads(rows, system, root, work)
        while some := list(islice(found, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*some, strict=True)], names=names)

    kinds = ", ".join(f"{c} {entries.schema[c].dataType.simpleString()}" for c in columns)
    return source.mapInArrow(run, f"{kinds}, {fields}")


def headers(entries: DataFrame, folder: str) -> DataFrame:
    """`entries` with width, height and depth, from range reads of their first HEADER_BYTES alone."""
    return _ranged(entries, folder, "width long, height long, depth long", lambda read, row: png_header(read(HEADER_BYTES)))


def read_back(entries: DataFrame, folder: str) -> DataFrame:
    """`entries` and what the stored bytes hold: sizes, digests and features."""

    def work(read, row: tuple) -> tuple:
        raw = read(row[2])
        samples = from_png(raw)
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), features(samples, png_header(raw[:HEADER_BYTES]))

    return _ranged(entries, folder, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", work)


def media_columns(docs: DataFrame, folder: str, text: str = "text") -> DataFrame:
    """Every row's doc_id and n_bytes, its address, the metadata in the header and what is read back from the store.

    A null or empty text is a payload of 64 zeros; a very long one is an entry like any other, in memory in proportion to
    it. Repeated rows share an entry and its values. Other columns are left out; an empty table writes no shard and gives
    an empty result.
    """
    rows, entries = ingest(docs, folder, text)
    found = read_back(table(headers(entries, folder), "headers"), folder)
    return rows.join(found, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length", "width", "height", "depth")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir), f"{shared_folder(spark)}/media-{uuid.uuid4().hex}")
