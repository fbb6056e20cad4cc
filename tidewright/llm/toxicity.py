"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

Both dictionaries begin with the most frequent words of ordinary training texts. Then come, in one, segments that
cover the toxic training texts and are rare in ordinary ones (chosen greedily, a text counting until it is covered
COVER times), in the other as many bytes of further ordinary words. Texts are cut into windows of a few words; the
lengths to which a window compresses with either dictionary differ where it holds toxic segments. A text is described
by how many of its windows gain how many bytes. The thresholds are weighed by a logistic fit on training texts that
had no part in the dictionaries, which makes the score a calibrated probability.

`trained` makes the pair with the library's trainer instead; it finds fewer toxic texts (README), as the trainer takes
what is frequent in its samples, and in toxic texts too that is ordinary text.

The sample of labelled rows is bounded: DICTIONARY_ROWS and CALIBRATION_ROWS texts of each label, LEARNED characters of
each.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable

import numpy as np
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import documents, durable, filter_texts, map_texts, once, remainder

#: Rows of each label for the dictionaries and for the calibration, fold of the test rows and of the calibration.
DICTIONARY_ROWS, CALIBRATION_ROWS, HELD_OUT, CALIBRATION, FOLDS = 2000, 2000, 0, 4, 5
#: Rows of each label without which no model is made.
LEAST = 10
#: Characters of a sampled text that are learned from, beginning at a place that its id's hash draws.
LEARNED = 20_000
#: Words in a window; bytes of segments, times a toxic text is to be covered, texts a segment needs, log ratio of rates it needs.
WINDOW, SHORTEST, LONGEST, COVER, TEXTS, RATIO = 4, 5, 12, 3, 4, 4.0
#: What ends a window: the compressor looks for no match that begins in the last eight bytes.
PAD = b" " + b"\n" * 8
#: Bytes of whole toxic words, and hashes by which copies are found.
WORD_BYTES, HASHES = 6000, 3
#: Ordinary words that both dictionaries hold, and gains in bytes that are counted.
SHARED, GAINS = 1800, (2, 3, 4, 5, 6, 7)
#: For dictionaries by the library's trainer: bytes of the shared and of the own part, and the sizes of their segments and of what it counts.
TRAINED_SHARED, TRAINED_OWN, TRAINED_SEGMENTS = 32_000, 2000, ((16, 6), (12, 8))
WORD = re.compile(rb"[^\s.,!?;:#$%&*|]+")


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def segments(text: bytes) -> set[bytes]:
    """Beginnings of words, with the space before, and after if the word ends there."""
    return {w[:n] for w in {b" " + w + b" " for w in WORD.findall(text)} for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


def toxic_segments(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Segments in the order chosen, each the one in most texts not yet covered, less those expected from its ordinary rate."""
    inside: Counter[bytes] = Counter()
    for t in toxic:
        inside.update(segments(t))
    often = {g for g, n in inside.items() if n >= TEXTS}
    inside = Counter({g: inside[g] for g in often})
    outside: Counter[bytes] = Counter()
    for t in ordinary:
        outside.update(segments(t) & often)
    rate = lambda n, of: math.log((n + 0.5) / (of + 1))
    able = {g for g in often if rate(inside[g], len(toxic)) - rate(outside[g], len(ordinary)) > RATIO}
    open_sets, covered, chosen = [segments(t) & able for t in toxic], [0] * len(toxic), []
    gain = Counter(g for s in open_sets for g in s)
    while gain:
        best = max(gain, key=lambda g: (gain[g] - 2 * outside[g] * len(toxic) / len(ordinary), len(g), g))
        if gain[best] < TEXTS - 1:
            break
        chosen.append(best)
        alike = {g for g in able if g.startswith(best) or best.startswith(g)}
        able -= alike
        for i, s in enumerate(open_sets):
            if best in s:
                covered[i] += 1
                if covered[i] >= COVER:
                    gain.subtract(s)
                    open_sets[i] = set()
                    continue
            open_sets[i] = s - alike
        gain = Counter({g: n for g, n in gain.items() if g in able and n > 0})
    return chosen


def without_copies(texts: list[bytes]) -> list[bytes]:
    """The texts without near copies of earlier ones, whose every word would look like a sign: none of their least shingle hashes has come before."""
    seen, kept = set(), []
    for t in texts:
        words = t.split()
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:]))) or [t]
        least = {(seed, min(xxhash.xxh64_intdigest(s, seed) for s in shingles)) for seed in range(HASHES)}
        if seen.isdisjoint(least):
            kept.append(t)
        seen |= least
    return kept


def toxic_words(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Whole words, with the spaces beside, that far more toxic texts hold; those in most texts last, within WORD_BYTES."""
    counts = [Counter(w for t in texts for w in set(WORD.findall(t))) for texts in (toxic, ordinary)]
    rate = lambda n, of: math.log((n + 0.5) / (of + 1))
    found = [w for w, n in counts[0].items() if n >= TEXTS - 1 and len(w) >= 4 and rate(n, len(toxic)) - rate(counts[1][w], len(ordinary)) > RATIO]
    out, size = [], 0
    for w in sorted(found, key=lambda w: (-counts[0][w], w)):
        size += len(w) + 2
        if size > WORD_BYTES:
            break
        out.append(b" " + w + b" ")
    return out[::-1]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The contents of the toxic and of the ordinary dictionary. What lies last is nearest and cheapest to refer to."""
    toxic, ordinary = without_copies(toxic), without_copies(ordinary)
    counts = Counter(w for t in ordinary for w in set(WORD.findall(t)))
    words = sorted(counts, key=lambda w: (-counts[w], w))[: 4 * SHARED]
    joined = lambda ws: b" " + b" ".join(ws) + b" "
    chosen = b"".join([*toxic_segments(toxic, ordinary)[::-1], *toxic_words(toxic, ordinary)])
    shared = joined(words[:SHARED][::-1])
    return shared + chosen, shared + joined(words[SHARED:][::-1])[-len(chosen) :]


def trained(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The same by the library's trainer: a part trained on ordinary windows, then one on those words of either label's texts that two of
    them and none of the other label's hold. A word is said twice, since the trainer counts nothing in a sample's last seven bytes."""
    toxic, ordinary = without_copies(toxic), without_copies(ordinary)
    words = [Counter(b" " + w + b" " for t in texts for w in set(WORD.findall(t))) for texts in (toxic, ordinary)]

    def own(mine: Counter[bytes], other: Counter[bytes]) -> bytes:
        samples = [w + w[1:] for w in sorted(mine) if w not in other and len(w) >= 6 and mine[w] > 1 for _ in range(mine[w])]
        k, d = TRAINED_SEGMENTS[1]
        return zstd.train_dictionary(TRAINED_OWN, samples, k=k, d=d, dict_id=1).as_bytes()

    k, d = TRAINED_SEGMENTS[0]
    shared = zstd.train_dictionary(TRAINED_SHARED, [w for t in ordinary for w in windows(t)], k=k, d=d, dict_id=1).as_bytes()
    return shared + own(*words), shared + own(*words[::-1])


def windows(text: bytes) -> list[bytes]:
    """A text's words, WINDOW at a time, each with a space before, and what ends a window."""
    words = text.split()
    return [b" " + b" ".join(words[i : i + WINDOW]) + PAD for i in range(0, len(words), WINDOW)]


def compressor(content: bytes) -> zstd.ZstdCompressor:
    """Frames without header, size or checksum, so that lengths are those of what is said."""
    parameters = zstd.ZstdCompressionParameters(format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, strategy=zstd.STRATEGY_LAZY2, min_match=5, window_log=18, hash_log=17, chain_log=17, search_log=6)
    dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstd.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


class Meter:
    """Compression lengths of windows by the two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = compressor(toxic).compress, compressor(ordinary).compress

    def gains(self, text: bytes) -> np.ndarray:
        toxic, ordinary = self.toxic, self.ordinary
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], dtype=np.int64)

    def describe(self, text: bytes) -> list[float]:
        gains = self.gains(text)
        n = len(gains)
        counts = [int((gains >= g).sum()) for g in GAINS]
        return [*(math.log1p(c) for c in counts), *(math.log1p(100 * c / max(n, 1)) for c in counts), math.log1p(n), float(gains.max(initial=0))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the constant first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w, shrink = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Model:
    """What is broadcast: both dictionaries and the weights, None without rows enough to learn from."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: np.ndarray | None):
        self.toxic, self.ordinary, self.weights = toxic, ordinary, weights

    def scorer(self):
        if self.weights is None:
            return lambda text: 0.0
        meter, weights = Meter(self.toxic, self.ordinary), self.weights

        def score(text: str | None) -> float:
            z = weights[0] + float(np.dot(weights[1:], meter.describe(lowered(text))))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def train(rows: list[tuple[int, str, bool]], share: float | None = None, make: Callable = dictionaries) -> Model:
    """A model from (toxic, text, whether for calibration); `share` is that of toxic texts where the calibration's come from, if
    not that of the sample.

    Where calibration rows lack a label, all rows calibrate. With fewer than LEAST rows of a label there is nothing to learn
    from: the score of every text is 0, and nothing is predicted to be toxic.
    """
    if min(sum(y == k for y, _, _ in rows) for k in (0, 1)) < LEAST:
        return Model(b"", b"", None)
    texts = {k: [lowered(t) for y, t, c in rows if y == k and not c] for k in (0, 1)}
    fit = [(lowered(t), y) for y, t, c in rows if c]
    if len({y for _, y in fit}) < 2:
        fit, share = [(lowered(t), y) for y, t, _ in rows], None
    if not texts[0] or not texts[1]:
        texts = {k: [t for t, y in fit if y == k] for k in (0, 1)}
    toxic, ordinary = make(texts[1], texts[0])
    meter = Meter(toxic, ordinary)
    y = np.array([y for _, y in fit], dtype=np.float64)
    weights = logistic(np.array([meter.describe(t) for t, _ in fit]), y)
    if share is not None and 0 < share < 1:
        odds = lambda p: math.log(p / (1 - p))
        weights[0] += odds(share) - odds(y.mean())  # labels are drawn apart
    return Model(toxic, ordinary, weights)


def sample(docs: DataFrame, labels: DataFrame, text: str = "text") -> tuple[list[tuple[int, str, bool]], float | None]:
    """The bounded sample, rows with the least hashes of their ids from all folds but that of the test, and the share of toxic rows in the
    calibration's fold. Of an id's texts the least is taken, and of that LEARNED characters together."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    folds = durable(known.withColumn("fold", remainder("doc_id", FOLDS)).where(F.col("fold") != HELD_OUT).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))))
    folds = folds.withColumn("calibrates", F.col("fold") == CALIBRATION)
    sizes = {(r["calibrates"], r["toxic"]): r["n"] for r in folds.groupBy("calibrates", "toxic").agg(F.count("*").alias("n")).collect()}  # four rows

    def first(calibrates: bool, toxic: int) -> DataFrame:
        """The rows with the least hashes; those far above are left out before rows meet."""
        n = CALIBRATION_ROWS if calibrates else DICTIONARY_ROWS
        near = folds.where((F.col("calibrates") == calibrates) & (F.col("toxic") == toxic) & (F.col("h").cast("double") * sizes.get((calibrates, toxic), 0) < float(4 * n << 40)))
        return near.orderBy("h", "doc_id").limit(n).select("doc_id", "toxic", "calibrates")

    chosen = first(False, 1).union(first(False, 0)).union(first(True, 1)).union(first(True, 0))
    found = docs.select("doc_id", F.col(text).alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "calibrates").agg(F.min("text").alias("text"))
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - LEARNED, F.lit(0)) + 1).cast("int") + 1
    rows = [(y, t, c) for _, y, t, c in sorted((r["doc_id"], r["toxic"], r["text"], r["calibrates"]) for r in found.withColumn("text", F.substr("text", place, F.lit(LEARNED))).collect())]
    toxic, all_ = sizes.get((True, 1), 0), sizes.get((True, 1), 0) + sizes.get((True, 0), 0)
    return rows, toxic / all_ if all_ else None


def _scores(model, key: str):
    def make():
        score = once(key, lambda: model.value.scorer())
        return lambda texts: list(map(score, texts))

    return make


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    A null or empty text has no windows and gets the score of that. If there was nothing to learn from, every text's
    score is 0. A very long text is cut into windows like any other and takes memory in proportion to
    it. A null id is never held out. Repeated rows stay, other columns are left out, an empty table gives an empty
    result.
    """
    make = _scores(docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex)

    def single():
        run = make()
        return lambda texts: [run(texts)]

    made = map_texts(docs, single, [("score", "double")], text)
    return made.select("doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose text scores below `least`, with all their columns; all rows if there was nothing to learn from.

    Null and empty texts are judged like any others, as texts without words; rows without id or label too. Repeated rows
    stay or go together, an empty table gives an empty result.
    """
    if model.weights is None:
        return docs
    make = _scores(docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex)

    def decide():
        run = make()
        return lambda texts: [s < least for s in run(texts)]

    return filter_texts(docs, decide, text)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity(docs, train(*sample(docs, labels_of(spark, sf_dir))))
