"""Concatenate and cut: all documents' tokens in one row, cut into windows of a fixed length.

Pass one tokenises each partition once, and keeps its token strings durable, numbered by partition and place. The
totals of the partitions, one number each, give by prefix sums every partition's place in the whole. Pass two adds
the running total inside the partition, which gives every document's global offset, and cuts it at multiples of the
window; the pieces are the boundary records. No sequence but the last is short, so padding is less than one window
altogether, and no row is shuffled.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import BATCH_ROWS, SLICE_BYTES, coded_words, documents, durable, once, slices

#: Words whose ids a worker remembers, and their greatest length.
MEMORY, LONGEST = 800_000, 64
#: Words whose ids are put in line at once.
BLOCK = 200_000
#: White space by which the tokenizer parts words as Python does; the four other separators of Python it keeps.
KEPT_BY_TOKENIZER = "[\x1c-\x1f]"
#: The tokenizer's own pattern, and the rules in its file that the way by words rests on (fixed values of the file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def by_words(path: str) -> bool:
    """Whether a tokenizer file has the rules by which words can be encoded apart."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in rules["added_tokens"])
    return rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER and rules["post_processor"] is None and plain


def library_tokenizer(path: str) -> Callable[[pa.Array], list[bytes]]:
    """The same as word_tokenizer for any tokenizer file, each text by the library as a whole."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [np.asarray(tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts.to_pylist()]


def word_tokenizer(path: str, memory: int | None = None) -> Callable[[pa.Array], list[bytes]]:
    """A function from an array of texts (null: empty) to their ids as little-endian unsigned 32-bit numbers, without special tokens.

    The tokenizer drops white space and never joins across it, so words are encoded apart and remembered. Special
    strings have no white space in them and are left to the library with the word that holds them. Files with other
    rules are left to the library altogether.
    """
    from tokenizers import Tokenizer

    if not by_words(path):
        return library_tokenizer(path)

    tokenizer, most = Tokenizer.from_file(path), memory or MEMORY
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    pattern = regex.compile(PATTERN)
    beyond = re.compile("[^\x00-\u02af]").search
    words: dict[str, bytes] = {}
    parts: dict[str, bytes] = {}

    def trim(memory: dict[str, bytes], seen: set[str]) -> None:
        """Forgets all but what the batch at hand uses, the frequent words among it."""
        kept = {w: memory[w] for w in seen if w in memory}
        memory.clear()
        memory.update(kept)

    def raw(ids: list[int]) -> bytes:
        return np.asarray(ids, dtype="<u4").tobytes()

    def whole(text: str) -> bytes:
        return raw(tokenizer.encode(text, add_special_tokens=False).ids)

    def learn_parts(new: list[str]) -> None:
        """Ids of pre-tokens, encoded in one go: each is a word of its own in what the library returns."""
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            got = tokenizer.encode(" ".join(some), add_special_tokens=False)
            owner, ids = np.asarray(got.word_ids, dtype=np.int64), np.asarray(got.ids, dtype="<u4")
            if len(owner) and owner[-1] != len(some) - 1 or not len(owner):
                parts.update((s, whole(s)) for s in some)
                continue
            ends = np.searchsorted(owner, np.arange(len(some)), side="right") * 4
            line, start = ids.tobytes(), 0
            for s, end in zip(some, ends.tolist(), strict=True):
                parts[s] = line[start:end]
                start = end

    def learn(new: list[str]) -> None:
        split = {}
        for w in new:
            if w.isascii() or not beyond(w) and unicodedata.is_normalized("NFC", w):
                if "<|" in w and any(s in w for s in special):
                    words[w] = whole(w)
                else:
                    split[w] = pattern.findall(w.lower())
            else:
                words[w] = whole(w)
        needed = set().union(*split.values())
        if len(parts) > most:
            trim(parts, needed)
        learn_parts([p for p in needed if p not in parts])
        get = parts.__getitem__
        for w, found in split.items():
            words[w] = b"".join(map(get, found))

    def encode(texts: pa.Array) -> list[bytes]:
        codes, ends, different = coded_words(texts, wide=True)
        seen = different.to_pylist()
        if len(words) > most:
            trim(words, set(seen))
        new = [w for w in seen if w not in words]
        long = [w for w in new if len(w) > LONGEST]
        learn([w for w in new if len(w) <= LONGEST])
        for w in long:
            words[w] = whole(w)
        found = [words[w] for w in seen]
        for w in long:
            del words[w]
        n = np.fromiter((len(x) // 4 for x in found), dtype=np.int64, count=len(found))
        start, flat, out = np.cumsum(n) - n, np.frombuffer(b"".join(found), dtype="<u4"), []
        first = 0
        while first < len(texts):  # as many texts at a time as have about BLOCK words
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK, side="right")) - 1)
            own = codes[ends[first] : ends[last]]
            size = n[own]
            total = np.cumsum(size)
            ids = flat[np.arange(total[-1] if len(total) else 0) + np.repeat(start[own] - (total - size), size)]
            cuts = np.r_[0, total][ends[first : last + 1] - ends[first]].tolist()
            out += [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            first = last
        for i in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, KEPT_BY_TOKENIZER), False)).to_pylist():
            out[i] = whole(texts[i].as_py())
        return out

    return encode


def numbered(batches: Iterator[pa.RecordBatch], encode: Callable[[pa.Array], list[bytes]], end: bytes) -> Iterator[pa.RecordBatch]:
    """Rows with the partition's number, the number of their ids and these ids, compressed."""
    press = zstandard.ZstdCompressor(level=1).compress
    partition = TaskContext.get().partitionId()
    for whole in batches:
        for part in slices(whole, "__text", SLICE_BYTES):
            ids = [x + end for x in encode(part.column("__text"))]
            tokens = np.fromiter((len(x) // 4 for x in ids), dtype=np.int64, count=len(ids))
            yield pa.RecordBatch.from_arrays([pa.array([partition] * len(ids), pa.int32()), part.column("doc_id"), pa.array(tokens), pa.array([press(x) for x in ids], pa.binary())], names=["partition", "doc_id", "tokens", "ids"])


def cut(doc_id: list, start: np.ndarray, ids: list[bytes], window: int) -> list[list]:
    """The pieces of documents whose first ids stand at the places `start` of the whole."""
    rows: list[list] = [[] for _ in range(7)]
    for d, g, raw in zip(doc_id, start.tolist(), ids, strict=True):
        n, at = len(raw) // 4, 0
        while at < n:
            length = min(n - at, window - (g + at) % window)
            for row, x in zip(rows, (d, at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), n, (g + at) // window, (g + at) % window), strict=True):
                row.append(x)
            at += length
    return rows


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, memory: int | None = None) -> DataFrame:
    """Pieces of all rows of `docs`: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; a very long one is cut like any other, in memory in proportion to it. Repeated rows and ids are packed one by one, other columns are left
    out, and an empty table gives no pieces. The order is that of the table's partitions and rows as first read. A
    worker remembers the ids of `memory` words (default MEMORY).
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    key, end = f"ids of {path} {memory}", np.asarray([end_id], dtype="<u4").tobytes()
    source = docs.select("doc_id", F.col("text").cast("string").alias("__text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def tokenise(batches):
        return numbered(batches, once(key, lambda: word_tokenizer(path, memory)), end)

    tokens = durable(source.mapInArrow(tokenise, f"partition int, doc_id {kind}, tokens long, ids binary"))
    totals = tokens.groupBy("partition").agg(F.sum("tokens").alias("n")).collect()  # a row for each partition
    first, total = {}, 0
    for row in sorted(totals, key=lambda r: r["partition"]):
        first[row["partition"]], total = total, total + row["n"]
    begin = spark.sparkContext.broadcast(first)

    def place(batches):
        at: dict[int, int] = {}
        unpress = zstandard.ZstdDecompressor().decompress
        for b in batches:
            if not b.num_rows:
                continue
            partition = b.column("partition")[0].as_py()
            n = b.column("tokens").to_numpy()
            start = at.get(partition, begin.value[partition]) + np.cumsum(n) - n
            at[partition] = int(start[-1] + n[-1])
            rows = cut(b.column("doc_id").to_pylist(), start, [unpress(x) for x in b.column("ids").to_pylist()], window)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], b.schema.field("doc_id").type), *(pa.array(x, pa.int64()) for x in rows[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return tokens.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
