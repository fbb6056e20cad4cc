"""What the corpus operators share: batched Python stages, durable tables and the split by document number."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that Spark puts in one Arrow batch, and bytes of text that one call of an operator's function gets.
BATCH_ROWS = 4000
SLICE_BYTES = 16 << 20

_kept: dict[str, object] = {}


def once(key: str, build: Callable[[], object], most: int = 3) -> object:
    """The value of `build()`, made once in each Python worker; the oldest of more than `most` values goes."""
    if key not in _kept:
        while len(_kept) >= most:
            _kept.pop(next(iter(_kept)))
        _kept[key] = build()
    return _kept[key]


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; -1 for a null id, which is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus, F.lit(-1))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of `batch` with about `limit` bytes of text, one row at least."""
    if batch.num_rows == 0:
        return
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    start = 0
    while start < batch.num_rows:
        end = start + 1
        while end < batch.num_rows and ends[end + 1] - ends[start] <= limit:
            end += 1
        yield batch.slice(start, end - start)
        start = end


def coded_words(texts: pa.Array, lower: bool = False, wide: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of texts (null: none) as numbers into the last result, an array of the different words.

    Words are parted by ASCII white space, or by any if `wide`; `lower` lowers A-Z. The second result has where
    each text's words begin, and where the last ones end.
    """
    texts = pc.fill_null(texts, "")
    lists = (pc.utf8_split_whitespace if wide else pc.ascii_split_whitespace)(pc.ascii_lower(texts) if lower else texts)
    ends = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    ends, codes = ends - ends[0], coded.indices.to_numpy().astype(np.int64)
    empty = coded.dictionary.index("").as_py()
    if empty >= 0:  # white space at an end of a text
        real = codes != empty
        ends = np.r_[0, np.cumsum(real)][ends]
        codes = codes[real]
    return codes, ends, coded.dictionary


#: A space between white space, or between that and the end: here the public splitting pattern looks past a space.
IRREGULAR = re.compile(r"\s (?:\s|\Z)")


def spaced_chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts cut before every space: numbers of their chunks, where each text's begin, and the different chunks.

    In texts without IRREGULAR the public splitting pattern never matches across such a cut, for it looks at most
    one character past white space, so chunks can be split into pre-tokens one by one.
    """
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    ends = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    ends, codes, strings = ends - ends[0], coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    first = ends[:-1][ends[:-1] < ends[1:]]
    own, place = np.unique(codes[first], return_inverse=True)
    codes[first] = len(strings) + place  # the first chunk has no space before it
    return codes, ends, [*(" " + s for s in strings), *(strings[i] for i in own.tolist())]


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list], list]], fields: list[tuple[str, str]], text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = SLICE_BYTES, arrays: bool = False) -> DataFrame:
    """One row for each row of `docs`: the columns `keep`, then `fields` (name and type).

    `make()` runs once in a task and returns a function that takes a list of texts (None for null), or if `arrays`
    an Arrow array of them, and returns a list or array for each field. Only `keep` and the text leave the JVM, in batches of bounded rows and bytes.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    source = docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    added = T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in fields))
    schema = T.StructType([*source.schema.fields[: len(keep)], *added.fields])
    kinds = [_arrow_type(f.dataType) for f in added.fields]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for part in slices(whole, "__text", limit):
                made = f(part.column("__text") if arrays else part.column("__text").to_pylist())
                columns = [part.column(i) for i in range(len(keep))] + [x.cast(k) if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def filter_texts(docs: DataFrame, make: Callable[[], Callable[[list], list]], text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """The rows of `docs`, with all columns, whose text gets a true value from the function that `make()` returns."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for part in slices(whole, text, limit):
                yield part.filter(pa.array(f(part.column(text).to_pylist()), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new one in a local session, as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or f"file://{tempfile.mkdtemp(prefix='checkpoints-')}")
        found = sc.getCheckpointDir()
    return found


def durable(df: DataFrame) -> DataFrame:
    """`df`, computed once and written to the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders that table() has written and release() has not deleted, of each thread of the driver for itself.
_threads = threading.local()


def _written() -> list[str]:
    if not hasattr(_threads, "written"):
        _threads.written = []
    return _threads.written


def table(df: DataFrame, name: str) -> DataFrame:
    """`df` written as compressed Parquet in the shared folder and read again; for what is large. It stays until release()."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written().append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any file system that Spark reaches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written() -> int:
    """How many tables of this thread stand in the shared folder now, for release()."""
    return len(_written())


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables written by operators in this thread since written() was `since`. What rests on them must have been read or saved before."""
    while len(_written()) > since:
        delete(spark, _written().pop())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
