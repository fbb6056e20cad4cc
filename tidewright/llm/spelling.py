"""Spelling variants: words one edit apart, found by their rarest bigrams, and the more frequent form of each.

Bigrams are ordered by how often they occur in the words, rarest first, then by place. An edit destroys at most two
bigrams of a word and makes at most two, so two words one edit apart share a bigram that is among the three rarest of
both, at places at most one apart: the join is on these alone. One edit leaves all but one of four pieces whole, the halves
of what stands before the shared bigram and of what stands after it, so a key also holds the other three pieces; by bigram
and place alone 795,000 words gave 2.4 thousand million candidates. Each candidate is then verified by its distance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import BATCH_ROWS, documents, durable, slices, table

#: Least code points and occurrences of a word, and how many times a word's occurrences its form has at least.
LETTERS, OCCURS, TIMES = 5, 3, 2
#: A run whose hash this number divides loses a code point.
SPOILED = 97
#: Bigrams of a word that are joined: one more than an edit can destroy.
RAREST = 3
#: Steps of doubling that reach the end of every chain of forms, as occurrences double with each link and are below 2 ** 63.
DOUBLINGS = 6
BREAK = "[^a-zÀ-ÿ]+"


def counted(texts: pa.Array, ids: list) -> tuple[pa.Array, np.ndarray]:
    """The different words of texts (null: none) with their occurrences, after the runs that `spoiled` names have lost a code point.

    A run's hash is the crc32 of "<id>:<run>" (a null id is written as nothing), which for all runs at once is the id's part, moved on by the length
    of the run, and the run's own.
    """
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BREAK)
    ends = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    runs, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    size = pc.binary_length(runs).to_numpy().astype(np.int64)
    own = np.fromiter((zlib.crc32(w) for w in runs.cast(pa.binary()).to_pylist()), dtype=np.int64, count=len(runs))
    lengths, length = np.unique(size, return_inverse=True)
    spoiled: dict[tuple[int, int], int] = {}
    for i, (a, b) in enumerate(zip((ends - ends[0])[:-1].tolist(), (ends - ends[0])[1:].tolist())):
        start, code = zlib.crc32(f"{'' if ids[i] is None else ids[i]}:".encode()), codes[a:b]
        moved = np.fromiter((zlib.crc32(bytes(int(n)), start) ^ zlib.crc32(bytes(int(n))) for n in lengths), dtype=np.int64, count=len(lengths)) if b - a > len(lengths) else None
        if moved is None:
            moved, of = np.array([zlib.crc32(bytes(int(n)), start) ^ zlib.crc32(bytes(int(n))) for n in size[code]], dtype=np.int64), slice(None)
        else:
            of = length[code]
        h = moved[of] ^ own[code]
        for j in np.flatnonzero((h % SPOILED == 0) & (size[code] > 0)).tolist():
            key = (int(code[j]), int(h[j]))
            spoiled[key] = spoiled.get(key, 0) + 1
    n = np.bincount(codes, minlength=len(runs))
    more: dict[str, int] = {}
    for (code, h), times in spoiled.items():
        run = runs[code].as_py()
        n[code] -= times
        more[run[: h % len(run)] + run[h % len(run) + 1 :]] = more.get(run[: h % len(run)] + run[h % len(run) + 1 :], 0) + times
    return pa.concat_arrays([runs, pa.array(list(more), type=runs.type)]), np.r_[n, np.array(list(more.values()), dtype=np.int64)]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word and n for the words of LETTERS code points and OCCURS occurrences at least; each task counts its texts first."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                words, n = counted(part.column("text"), part.column("id").to_pylist())
                kept = (pc.utf8_length(words).to_numpy() >= LETTERS) & (n > 0)
                yield pa.RecordBatch.from_arrays([words.filter(pa.array(kept)).cast(pa.string()), pa.array(n[kept])], names=["word", "n"])

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURS)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """The place of each bigram, rarest first, ties by code points. Words have 90 letters, so there are 8,100 bigrams at most."""
    grams = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, 2))
    rows = words.select(F.explode(grams).alias("gram")).groupBy("gram").count().collect()
    return {r["gram"]: i for i, r in enumerate(sorted(rows, key=lambda r: (r["count"], r["gram"])))}


def keys(word: str, order: dict[str, int]) -> tuple[set[str], set[str]]:
    """The keys of a word as the shorter of two or one of equal length, and as the longer one: two words of LETTERS code points one edit apart share one.

    A key holds a side of one of the word's RAREST bigrams, the length of that side in the shorter word, which half of it is left out, and the rest.
    """
    even, longer = set(), set()
    for _, i in sorted((order[word[i : i + 2]], i) for i in range(len(word) - 1))[:RAREST]:
        before, after = word[:i], word[i + 2 :]
        for side, part, rest in (("<", before, word[i:]), (">", after, word[: i + 2])):
            for into, base in ((even, len(part)), (longer, len(part) - 1)):
                if base < 0:
                    continue
                half = base // 2
                into.add(f"{side}{base} {part[:half]} {rest}")
                if half:  # otherwise all of the side is left out already
                    into.add(f"{side}{base}  {part[len(part) - (base - half) :]} {rest}")
    return even, longer


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of words one edit apart once: a, b and their occurrences a_n, b_n; `words` has word and n."""
    order = bigram_order(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, longer, at = [], [], []
            for i, word in enumerate(batch.column("word").to_pylist()):
                for flag, own in enumerate(keys(word, order)):
                    key += [xxhash.xxh64_intdigest(k) for k in own]
                    longer += [bool(flag)] * len(own)
                    at += [i] * len(own)
            own = batch.take(pa.array(at, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(key, dtype=np.uint64).view(np.int64)), pa.array(longer, type=pa.bool_()), own.column("word"), own.column("n")], names=["key", "longer", "word", "n"])

    rows = table(words.select("word", "n").mapInArrow(run, "key long, longer boolean, word string, n long"), "bigrams")
    a = rows.where("not longer").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = rows.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("b_n"))
    near = a.join(b, "key").where((F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return near.select("a", "b", "a_n", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root, where following forms ends, for every word of `forms` (word, form); by doubling, as no chain has 64 words."""
    hops = durable(forms.select("word", F.col("form").alias("root")))
    for _ in range(DOUBLINGS):
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("__on"))
        if hops.join(on, "root", "left_semi").isEmpty():
            break
        hops = durable(hops.join(on, "root", "left").select("word", F.coalesce("__on", "root").alias("root")))
    return hops


def variants(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of the texts.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lowered, of LETTERS code points and OCCURS occurrences at least. Near words differ by one inserted,
    deleted or replaced code point; a word's form is the near word that occurs most (ties: first in code-point order), if it occurs TIMES
    as often as the word, else null; root is where following forms ends, the word itself without a form. Null and empty texts have no words, very long ones count whole;
    repeated rows count each time; a null doc_id is written as nothing in the hash that spoils some runs. Other columns are left out; an empty table gives an empty result.
    """
    words = table(word_counts(docs, text), "words")
    pairs = table(near_pairs(words), "pairs")
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("b_n").alias("a_n"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    enough = -F.col("best.less") >= TIMES * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    found = table(found, "forms")
    return found.join(roots(found.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))
