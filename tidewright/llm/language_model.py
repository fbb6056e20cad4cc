"""A hidden Markov language model: Baum-Welch on all training texts, exact likelihoods by the scaled forward recursion.

Words that are frequent in training are emission classes of their own; the others, unseen ones too, fall into classes
by their last letters, inside which a word has its smoothed share of the class's counts. So the model that is
broadcast has a fixed size, whatever the corpus, while the counts of all words stay in a distributed table: a text's
infrequent words are joined to it.

One pass counts words; one writes every text as class numbers; each step of Baum-Welch runs over all training texts
in their partitions, sums expected counts by class across partitions, and re-estimates on the driver, which sees one
row for each class. The first estimate separates states by which of the most frequent words share documents.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import BATCH_ROWS, coded_words, documents, durable, once, remainder, slices, table
from tidewright.llm.lattice import Lattice

#: Words with classes of their own, words whose counts are broadcast, classes of other words by their last letters.
OWN, BROADCAST, ENDINGS, LETTERS = 32_768, 262_144, 4096, 3
#: Groups of states, states in each, words by which groups are told apart, and steps of Baum-Welch.
GROUPS, ROLES, MARKERS, STEPS = 4, 2, 256, 3
STATES = GROUPS * ROLES
#: Occurrences that are added to each class, dealt out as all tokens are to the states, and to each transition.
LEAN, LEAN_MOVES = 1.0, 1.0
#: Different words that a task counts before it passes counts on; tokens that one recursion takes; bounds of the lengths that go together; bytes of text worked on at once.
COUNTED, TOKENS, LENGTHS, TEXT_BYTES = 200_000, 240_000, (400, 1600, 6400), 4 << 20


def ending(word: str) -> int:
    """The number of a word's last letters, for words without a class of their own."""
    return zlib.crc32(word[-LETTERS:].encode("utf-8", "surrogatepass")) % ENDINGS


# -- counts ---------------------------------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """word and c over all rows of `texts` (column text); a task's counts are summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for whole in batches:
            for part in slices(whole, "text", TEXT_BYTES):
                codes, _, different = coded_words(part.column("text"), lower=True)
                n = np.bincount(codes, minlength=len(different))
                held.append(pa.table({"word": different.filter(pa.array(n > 0)), "c": pa.array(n[n > 0])}))
            if sum(map(len, held)) > COUNTED:
                held = [summed()]
                if len(held[0]) > COUNTED:
                    yield from held[0].combine_chunks().to_batches(100_000)
                    held = []
        if held:
            yield from summed().combine_chunks().to_batches(100_000)

    return texts.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Frequent words with their counts, and the totals of each class of other words; its size is bounded.

    Classes are the first `own` words, then the endings, then the end of a text.
    """

    def __init__(self, words: list[str], counts: list[int], own: int, tokens: int, types: int, class_tokens: np.ndarray, class_types: np.ndarray):
        self.words, self.own, self.end = words, own, own + ENDINGS
        self.counts = np.array([*counts, 0], dtype=np.int64)  # the last for words that are not here
        self.tokens, self.types = tokens, types
        self.share = np.log10(class_tokens + 0.5 * (class_types + 1))  # of an ending's class, what a word's count is divided by

    def place(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words)}


def vocabulary(counts: DataFrame, n_docs: int, own: int, broadcast: int) -> Vocabulary:
    """From (word, c): the words whose count is among the highest, as many as `broadcast` allows with all of a count or none."""
    sizes = durable(counts.groupBy("c").agg(F.count("*").alias("n")))
    # one row for each different count; cumulated from the highest
    found = sorted(((r["c"], r["n"]) for r in sizes.collect()), reverse=True)
    tokens, types = sum(c * n for c, n in found), sum(n for _, n in found)
    least, held = math.inf, 0
    for c, n in found:
        if held + n > broadcast:
            break
        least, held = c, held + n
    rows = sorted(((-r["c"], r["word"]) for r in counts.where(F.col("c") >= least).collect()) if held else [])
    words, high = [w for _, w in rows], [-c for c, _ in rows]
    class_tokens, class_types = np.zeros(ENDINGS), np.zeros(ENDINGS)
    ends = F.crc32(F.expr(f"right(word, {LETTERS})")) % ENDINGS
    for r in counts.where(F.col("c") < least if held else F.lit(True)).groupBy(ends.alias("e")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        class_tokens[r["e"]], class_types[r["e"]] = r["c"], r["n"]
    for w, c in zip(words[own:], high[own:], strict=True):
        class_tokens[ending(w)] += c
        class_types[ending(w)] += 1
    return Vocabulary(words, high, own, tokens + n_docs, types + (n_docs > 0), class_tokens, class_types)


# -- texts as classes -----------------------------------------------------------------------------------------------


def encoded(rows: DataFrame, model) -> DataFrame:
    """Every row (doc_id, trains, text) as numbers: id, doc_id, trains, n_tokens, n_known and logs of the words known here, its classes, and the different words to look up with how often each occurs."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = model.value
        place = once(key, v.place)
        own, n_words, press = v.own, len(v.words), zstandard.ZstdCompressor(level=1).compress
        row = TaskContext.get().partitionId() << 33
        log_c = np.log10(v.counts + 0.5)
        for whole in batches:
            for part in slices(whole, "text", TEXT_BYTES):
                codes, ends, different = coded_words(part.column("text"), lower=True)
                strings = different.to_pylist()
                at = np.fromiter((place.get(w, n_words) for w in strings), dtype=np.int64, count=len(strings))
                classes = np.fromiter((p if p < own and p < n_words else own + ending(w) for p, w in zip(at.tolist(), strings, strict=True)), dtype=np.int32, count=len(strings))
                norm = np.where(classes >= own, v.share[np.maximum(classes - own, 0)], 0.0)
                here = at < n_words
                inside = np.where(classes >= own, np.where(here, log_c[at], 0.0) - norm, 0.0)  # the word's share of its class
                known = np.where(here, log_c[at], 0.0)
                upto = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x[codes])])[ends])
                n = part.num_rows
                far = ~here[codes]
                pairs, times = np.unique(np.repeat(np.arange(n), np.diff(ends))[far] * len(strings) + codes[far], return_counts=True)
                away = pairs % max(1, len(strings))
                cut = pa.array(np.searchsorted(pairs, np.arange(n + 1) * len(strings)).astype(np.int32))
                ids = classes[codes]
                size = np.diff(ends)
                ids = np.insert(ids, ends[1:], v.end) if len(size) else ids
                stops = ends + np.arange(len(ends))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + n)), part.column("doc_id"), part.column("trains"), pa.array(size + 1), pa.array(upto(here.astype(np.float64)).round().astype(np.int64)),
                    pa.array(upto(known)), pa.array(upto(inside)), pa.array([press(ids[a:b].tobytes()) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(cut, different.take(pa.array(away))), pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int32))),
                ], names=["row", "doc_id", "trains", "n_tokens", "n_known", "log_known", "log_inside", "classes", "away", "times"])
                row += n

    return rows.mapInArrow(run, f"row long, doc_id {kind}, trains boolean, n_tokens long, n_known long, log_known double, log_inside double, classes binary, away array<string>, times array<int>")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows and their classes, about TOKENS at a time, texts of like lengths together."""
    unpress = zstandard.ZstdDecompressor().decompress
    held: list[tuple[list, list, list]] = [([], [], [0]) for _ in range(len(LENGTHS) + 1)]
    for b in batches:
        for row, raw in zip(b.column("row").to_pylist(), b.column("classes"), strict=True):
            ids = np.frombuffer(unpress(raw.as_py()), dtype=np.int32)
            rows, texts, n = held[int(np.searchsorted(LENGTHS, len(ids)))]
            rows.append(row)
            texts.append(ids)
            n[0] += len(ids)
            if n[0] >= TOKENS:
                yield list(rows), list(texts)
                rows.clear()
                texts.clear()
                n[0] = 0
    for rows, texts, _ in held:
        if rows:
            yield rows, texts


# -- model ----------------------------------------------------------------------------------------------------------


class Hmm:
    """start[k], move[j, k] and emit[class, k], all probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def log10_likelihoods(self, texts: list[np.ndarray]) -> np.ndarray:
        lattice = Lattice(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
        emit = self.emit.astype(np.float64)[lattice.laid_out(np.concatenate(texts))]
        _, scale = lattice.forward(emit, self.move, self.start)
        return lattice.sums(np.log10(scale))

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, transitions and emissions over texts."""
        lattice = Lattice(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
        codes = lattice.laid_out(np.concatenate(texts))
        emit, move = self.emit.astype(np.float32)[codes], self.move.astype(np.float32)
        alpha, scale = lattice.forward(emit.copy(), move, self.start.astype(np.float32))
        beta = lattice.backward(emit, scale, move)
        first = alpha[: lattice.bounds[0][1]] * beta[: lattice.bounds[0][1]]
        emit *= beta
        emit /= scale[:, None]
        joint = np.zeros((STATES, STATES))
        for (a, b), (c, d) in zip(lattice.bounds, lattice.bounds[1:]):
            joint += alpha[a : a + d - c].T @ emit[c:d]
        beta *= alpha
        emissions = np.stack([np.bincount(codes, weights=beta[:, k], minlength=len(self.emit)) for k in range(STATES)], axis=1)
        return first.sum(axis=0, dtype=np.float64), joint * self.move, emissions


def normal(x: np.ndarray, axis: int) -> np.ndarray:
    return x / x.sum(axis=axis, keepdims=True)


def summed(partial: DataFrame, rows: int) -> np.ndarray:
    """The sum of (i, v0, v1, ...) by i as a matrix with `rows` rows, a fixed number."""
    names = [c for c in partial.columns if c != "i"]
    out = np.zeros((rows, len(names)))
    for r in partial.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["i"]] = [r[c] for c in names]
    return out


def _rows(matrix: np.ndarray) -> pa.RecordBatch:
    full = np.flatnonzero(matrix.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array(matrix[full, k].astype(np.float32)) for k in range(matrix.shape[1]))], names=["i", *(f"v{k}" for k in range(matrix.shape[1]))])


def companions(training: DataFrame, markers: int) -> np.ndarray:
    """In how many texts each two of the `markers` most frequent words occur."""

    def run(batches):
        together = np.zeros((markers, markers))
        for _, texts in gathered(batches):
            owner, ids = np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.concatenate(texts)
            present = np.zeros((len(texts), markers), dtype=np.float32)
            present[owner[ids < markers], ids[ids < markers]] = 1
            together += present.T @ present
        yield _rows(together)

    fields = ", ".join(f"v{k} float" for k in range(markers))
    return summed(training.select("row", "classes").mapInArrow(run, f"i int, {fields}"), markers)


def groups_of(together: np.ndarray) -> np.ndarray:
    """A group for each marker (-1: in no text): k-means over how surprisingly often markers share texts, from seeds far apart."""
    n = together.diagonal()
    used = np.flatnonzero(n > 0)
    if len(used) < GROUPS:
        return np.where(n > 0, 0, -1)
    lift = (together[np.ix_(used, used)] + 0.5) / np.sqrt(np.outer(n[used], n[used]))
    values, vectors = np.linalg.eigh(lift / np.sqrt(np.outer(lift.sum(axis=1), lift.sum(axis=1))))
    points = vectors[:, -GROUPS:]
    points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    seeds = [int(np.argmax(n[used]))]
    while len(seeds) < GROUPS:
        near = np.max(points @ points[seeds].T, axis=1)
        seeds.append(int(np.argmin(near)))
    centres = points[seeds]
    for _ in range(50):
        own = np.argmax(points @ centres.T, axis=1)
        new = np.stack([points[own == g].mean(axis=0) if (own == g).any() else centres[g] for g in range(GROUPS)])
        if np.allclose(new, centres):
            break
        centres = new
    out = np.full(len(n), -1)
    out[used] = own
    return out


def first_estimate(groups: np.ndarray, unigram: np.ndarray) -> Hmm:
    """States of a group favour its markers; of the roles in a group, one favours frequent words."""
    emit = np.repeat(unigram[:, None], STATES, axis=1) + 1e-12
    markers = len(groups)
    frequent = np.arange(len(unigram)) < markers
    for k in range(STATES):
        g, role = divmod(k, ROLES)
        marked = np.zeros(len(unigram), dtype=bool)
        marked[:markers] = groups == g
        other = np.zeros(len(unigram), dtype=bool)
        other[:markers] = (groups >= 0) & (groups != g)
        emit[marked, k] *= 3
        emit[other, k] *= 0.1
        emit[:, k] *= np.where(frequent == (role == 0), 1.5, 0.7)
    move = np.full((STATES, STATES), 0.002)
    for g in range(GROUPS):
        own = slice(g * ROLES, (g + 1) * ROLES)
        move[own, own] = 0.5
    return Hmm(np.full(STATES, 1 / STATES), normal(move, 1), normal(emit, 0))


def baum_welch(training: DataFrame, model: Hmm, unigram: np.ndarray) -> Hmm:
    """One step over all training texts. Rows of the sums: classes, then states' transitions, then starts."""
    shared, classes = training.sparkSession.sparkContext.broadcast(model), len(unigram)

    def run(batches):
        total = np.zeros((classes + STATES + 1, STATES))
        for _, texts in gathered(batches):
            first, moves, emissions = shared.value.expected(texts)
            total[:classes] += emissions
            total[classes:-1] += moves
            total[-1] += first
        yield _rows(total)

    fields = ", ".join(f"v{k} float" for k in range(STATES))
    total = summed(training.select("row", "classes").mapInArrow(run, f"i int, {fields}"), classes + STATES + 1)
    counts, share = total[:classes], normal(total[:classes].sum(axis=0) + 1, 0)
    n = counts.sum(axis=1, keepdims=True)
    leaning = (counts + LEAN * share) / (n + LEAN) * np.maximum(n, unigram[:, None] * n.sum())
    return Hmm(normal(total[-1] + 1, 0), normal(total[classes:-1] + LEAN_MOVES, 1), normal(leaning + 1e-12, 0))


def language_model(docs: DataFrame, held_out: int = 1, folds: int = 5, text: str = "text", own: int = OWN, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    A null or empty text is its end alone. A very long text is one sequence, in memory in proportion to it. A null id is never held out. Without any training text N is 0, words are
    unknown and the model is the first estimate. Repeated rows count each and stay, other columns are left out, an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    rows = docs.select("doc_id", (remainder("doc_id", folds) != held_out).alias("trains"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counts = table(word_counts(rows.where("trains")), "counts")
    n_docs = rows.where("trains").count()
    v = vocabulary(counts, n_docs, own, broadcast)
    shared = spark.sparkContext.broadcast(v)
    texts = table(encoded(rows, shared), "classes")
    training = texts.where("trains")

    unigram = np.zeros(v.end + 1)
    high = v.counts[:-1][:own]
    unigram[: len(high)] = high
    unigram[own : v.end] = 10**v.share
    unigram[v.end] = n_docs
    unigram = normal(unigram + 0.5, 0)
    model = first_estimate(groups_of(companions(training, min(MARKERS, own))), unigram)
    for _ in range(STEPS if n_docs else 0):
        model = baum_welch(training, model, unigram)
    final = spark.sparkContext.broadcast(model)

    def likelihoods(batches):
        for ids, found in gathered(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(final.value.log10_likelihoods(found))], names=["row", "likelihood"])

    away = texts.select("row", F.explode(F.arrays_zip("away", "times")).alias("w")).select("row", F.col("w.away").alias("word"), F.col("w.times").alias("times")).join(counts, "word", "left")
    known = F.coalesce("c", F.lit(0))
    looked_up = away.groupBy("row").agg(F.sum(F.when(known > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10(known + 0.5)).alias("more"))
    scored = texts.select("row", "classes").mapInArrow(likelihoods, "row long, likelihood double")
    more = F.coalesce("more", F.lit(0.0))
    base = F.lit(math.log10(v.tokens + 0.5 * (v.types + 1)))
    end = F.lit(math.log10(n_docs + 0.5))
    made = texts.drop("classes", "away", "times").join(scored, "row").join(looked_up, "row", "left")
    return made.select(
        "doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + (1 if n_docs else 0)).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("log_known") + more + end - base * F.col("n_tokens")).alias("base_score"), (F.col("likelihood") + F.col("log_inside") + more).alias("score"),
    )


def op4_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(documents(spark, sf_dir))
