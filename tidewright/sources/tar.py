"""Tar shards as a data source and sink, for tables and streams: spark.read.format("tar"), after register().

The folder must be one that driver and executors have mounted at the same place, as shards are read and written with
plain files. A shard is a partition. Conditions on the shard's name skip shards before they are opened.
"""

from __future__ import annotations

import io
import os
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from tidewright.session import shared_folder
from tidewright.sources import table

SCHEMA = "shard string, name string, offset long, size long, content binary"
ARROW = pa.schema([("shard", pa.string()), ("name", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("content", pa.binary())])
#: Bytes of content in a batch, one entry at least.
BATCH = 8 << 20


def local(path: str) -> str:
    """The folder of a path without a scheme, or with that of files."""
    if "://" in path.replace("file:///", "") or (":" in path.split("/")[0] and not path.startswith("file:")):
        raise ValueError(f"not a mounted folder: {path}")
    return path.removeprefix("file:").replace("///", "/", 1) if path.startswith("file:") else path


@dataclass
class Shard(InputPartition):
    path: str


def shards(folder: str) -> list[str]:
    """The names of the finished shards, sorted; those being written begin with a dot."""
    return sorted(x for x in os.listdir(folder) if x.endswith(".tar") and x[0] != ".") if os.path.isdir(folder) else []


def entries(path: str, content: bool) -> Iterator[pa.RecordBatch]:
    """The files of a shard in batches of bounded bytes; without `content` only headers are read."""
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), ARROW, strict=True)], schema=ARROW)

    with tarfile.open(path, "r:") as tar:
        for member in tar:
            tar.members = []  # tarfile remembers all members otherwise
            if not member.isfile():
                continue
            rows.append((os.path.basename(path), member.name, member.offset_data, member.size, tar.extractfile(member).read() if content else None))
            held += member.size if content else 100
            if held >= BATCH:
                yield batch()
                rows, held = [], 0
    if rows:
        yield batch()


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.content, self.filters = local(options["path"]), options.get("content", "true") == "true", []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("shard",):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Shard]:
        fits = {EqualTo: lambda f, x: x == f.value, In: lambda f, x: x in f.value, StringStartsWith: lambda f, x: x.startswith(f.value)}
        return [Shard(f"{self.folder}/{x}") for x in shards(self.folder) if all(fits[type(f)](f, x) for f in self.filters)]

    def read(self, partition: Shard | None) -> Iterator[pa.RecordBatch]:
        if partition:
            yield from entries(partition.path, self.content)


class TarStreamReader(DataSourceStreamReader):
    """New shards by the time of their last change, then by name: a shard must be finished when it gets its name, and not be older than those before."""

    def __init__(self, options: dict):
        self.folder, self.content = local(options["path"]), options.get("content", "true") == "true"

    def _timed(self) -> list[tuple[int, str]]:
        return sorted((os.stat(f"{self.folder}/{x}").st_mtime_ns, x) for x in shards(self.folder))

    def initialOffset(self) -> dict:
        return {"time": 0, "name": ""}

    def latestOffset(self) -> dict:
        time, name = max(self._timed(), default=(0, ""))
        return {"time": time, "name": name}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return [Shard(f"{self.folder}/{x}") for t, x in self._timed() if (start["time"], start["name"]) < (t, x) <= (end["time"], end["name"])]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        return entries(partition.path, self.content)


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class TarWriter(DataSourceArrowWriter):
    """A shard for each task with rows (name, content); shards get their names when all tasks are done, so a lost or repeated task leaves none."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = local(options["path"]), overwrite
        self.before = shards(self.folder) if overwrite else []

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        name, rows = f"shard-{uuid.uuid4().hex}.tar", 0
        os.makedirs(self.folder, exist_ok=True)
        with tarfile.open(f"{self.folder}/.{name}", "w") as tar:
            for batch in batches:
                for file, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    info = tarfile.TarInfo(file)
                    info.size = len(content or b"")
                    tar.addfile(info, io.BytesIO(content or b""))
                    tar.members = []
                    rows += 1
        if not rows:
            os.remove(f"{self.folder}/.{name}")
        return Written(name if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.name:
                os.rename(f"{self.folder}/.{m.name}", f"{self.folder}/{m.name}")
        for x in self.before:
            os.remove(f"{self.folder}/{x}")

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.name:
                os.remove(f"{self.folder}/.{m.name}")


class TarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TarReader:
        return TarReader(self.options)

    def streamReader(self, schema: StructType) -> TarStreamReader:
        return TarStreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TarWriter:
        return TarWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets it push conditions to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TarSource)


def archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to tar shards and read back."""
    register(spark)
    folder = f"{local(shared_folder(spark))}/pages-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("content"))
    pages.write.format("tar").mode("append").save(folder)
    read = spark.read.format("tar").load(folder)
    return read.select(F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("page_id"), "size", F.md5("content").alias("digest"))


QUERIES = {"archived_pages": (archived_pages, "select page_id, octet_length(encode(html)) as size, md5(html) as digest from pages")}
