"""Language of words and texts by a linear-chain conditional random field.

A word's features are its character n-grams with marks at both ends, so affixes are among them, and its entry in a
lexicon of the training sample. Their weights and those of transitions are learned on a bounded sample of labelled
texts and on sequences spliced from pieces of several of them, since in code-switched text the language changes.
Forward and backward recursions give each word's distribution over the languages; a text's is their mean.

Long texts are cut into pieces that overlap by MARGIN words on both sides, so a text of any length takes bounded memory
besides its own bytes, and every word is labelled once, with its neighbours in view.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import coded_words, documents, filter_texts, map_texts, once, remainder
from tidewright.llm.lattice import Lattice

#: Texts of each language in the training sample, texts of all languages unless FEWEST of each are more, and words in spliced sequences for each text.
SAMPLE, TEXTS, FEWEST, SPLICED = 150, 1200, 20, 200
#: Characters of a sampled text that are learned from, beginning at a place that its id's hash draws.
LEARNED = 8000
#: Lengths of n-grams in bytes, the buckets they are hashed to, and words in the lexicon (with this many occurrences).
NGRAMS, BUCKETS, LEXICON, SEEN = (2, 3, 4, 5), 1 << 16, 20_000, 3
#: Passes over the sample, step and shrinkage of the training; bytes of text worked on at once.
EPOCHS, RATE, SHRINK, LIMIT = 12, 0.08, 1e-4, 4 << 20
#: Positions times languages that are worked on at once, if no single sequence has more; languages with which LIMIT holds, with more it shrinks.
CELLS, USUAL = 8 << 20, 4
#: Words of a piece of a long text that are labelled, and of the words before and after it that are read along.
PIECE, MARGIN = 2000, 50
#: Trigrams that a text is given as known besides its own, so that a few words decide nothing, and the part of a language's usual share of known ones below which a text is in none.
GIVEN, USUALLY = 10, 0.6


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The byte trigrams of words with marks at both ends, as numbers, and the words they are of."""
    raw = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    data, owner = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int32), np.repeat(np.arange(len(raw)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
    inside = np.flatnonzero(left >= 3)
    return data[inside] << 16 | data[inside + 1] << 8 | data[inside + 2], owner[inside]


def known_share(words: list[str], counted: np.ndarray, codes: np.ndarray, owner: np.ndarray, n: int, known: np.ndarray) -> np.ndarray:
    """For each of `n` texts the share of its trigrams, of words that are `counted`, that are in `known` (sorted); `owner` has the text of each word of `codes`."""
    ids, of = trigrams(words)
    at = np.minimum(np.searchsorted(known, ids), max(len(known) - 1, 0))
    hit = known[at] == ids if len(known) else np.zeros(len(ids), bool)
    total, found = (np.bincount(of, weights=w, minlength=len(words)) * counted for w in (None, hit))
    share = [np.bincount(owner, weights=x[codes], minlength=n) + GIVEN for x in (found, total)]
    return share[0] / share[1]


def usual_share(words: list[str], counted: np.ndarray, codes: np.ndarray, owner: np.ndarray, label: np.ndarray) -> float:
    """The least of the languages' median shares of known trigrams, where each half of the texts is held to the trigrams of the other."""
    ids, of = trigrams(words)
    share, half = np.ones(len(label)), np.arange(len(label)) % 2
    for side in (0, 1):
        own = np.zeros(len(words), bool)
        own[codes[half[owner] != side]] = True
        share = np.where(half == side, known_share(words, counted, codes, owner, len(label), np.unique(ids[own[of]])), share)
    return min(float(np.median(share[label == x])) for x in np.unique(label))


class Words:
    """Features of different words: for each, the numbers of its n-grams' buckets and its lexicon entry."""

    def __init__(self, words: list[str], lexicon: dict[str, int]):
        raw = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(raw)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes up to the end of the word
        features, owners = [], []
        for n in NGRAMS:
            h = np.full(max(0, len(data) - n + 1), n, dtype=np.uint64)
            for i in range(n):
                h = (h ^ data[i : len(data) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = left[: len(h)] >= n
            features.append((h[inside] % BUCKETS).astype(np.int64))
            owners.append(owner[: len(h)][inside])
        entry = np.fromiter((lexicon.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        known = np.flatnonzero(entry >= 0)
        self.features = np.concatenate([*features, entry[known] + BUCKETS])
        self.owners = np.concatenate([*owners, known])
        self.count = len(words)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """The sum of the features' weights for each word and language."""
        return np.stack([np.bincount(self.owners, weights=weights[:, k][self.features], minlength=self.count) for k in range(weights.shape[1])], axis=1)

    def gathered(self, by_word: np.ndarray, size: int) -> np.ndarray:
        """The transpose of `emissions`."""
        return np.stack([np.bincount(self.features, weights=by_word[:, k][self.owners], minlength=size) for k in range(by_word.shape[1])], axis=1)


def potentials(scores: np.ndarray) -> np.ndarray:
    """Factors of words, each up to a constant of its own: that of a position cancels out."""
    return np.exp(np.clip(scores - scores.max(axis=-1, keepdims=True), -30, 0))


def transitions(moves: np.ndarray) -> np.ndarray:
    """Factors of transitions, up to one constant for all: one for each row would not cancel out."""
    return np.exp(np.clip(moves - moves.max(initial=0), -60, 0))


def marginals(lattice: Lattice, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each position's distribution (in the layout), alpha, the later positions' factors for the pairs, and the scales."""
    start = np.full(emit.shape[1], 1 / emit.shape[1], dtype=emit.dtype)
    alpha, scale = lattice.forward(emit.copy(), move, start)
    beta = lattice.backward(emit, scale, move)
    return alpha * beta, alpha, emit * beta / scale[:, None], scale


def pieces(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts of so many words cut into pieces: owner, first word (of all), and the words before it and of it that are read along and labelled."""
    number = np.maximum(1, -(-lengths // PIECE))
    owner = np.repeat(np.arange(len(lengths)), number)
    inside = (np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)) * PIECE
    first = (np.cumsum(lengths) - lengths)[owner] + inside
    return owner, first, np.minimum(inside, MARGIN), np.minimum(lengths[owner] - inside, PIECE)


class Field:
    """A trained model: languages, lexicon, weights of features and transitions."""

    def __init__(self, languages: list[str], lexicon: dict[str, int], weights: np.ndarray, moves: np.ndarray, known: np.ndarray, least: float):
        """`known`: trigrams of the training sample; `least`: the share of them from which a text is in one of the languages."""
        self.languages, self.lexicon, self.weights, self.moves, self.known, self.least = languages, lexicon, weights, moves, known, least

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Words of texts, the different words, and runs of positions with their texts and distributions over the languages."""
        codes, ends, different = coded_words(texts, wide=True)
        features = Words(pc.utf8_lower(different).to_pylist(), self.lexicon)
        emit, move = potentials(features.emissions(self.weights)).astype(np.float32), transitions(self.moves).astype(np.float32)
        owner, first, before, own = pieces(np.diff(ends))
        start, stop = first - before, np.minimum(first + own + MARGIN, ends[owner + 1])

        def found():
            for a, b in runs(stop - start, CELLS // len(self.languages)):
                lengths = stop[a:b] - start[a:b]
                shift = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                at = np.repeat(start[a:b], lengths) + shift
                lattice = Lattice(lengths)
                shares = marginals(lattice, emit[lattice.laid_out(codes[at])], move)[0][lattice.to]
                labelled = (shift >= np.repeat(before[a:b], lengths)) & (shift < np.repeat(before[a:b] + own[a:b], lengths))
                shares = shares[labelled]
                yield at[labelled], np.repeat(owner[a:b], lengths)[labelled], shares / shares.sum(axis=1, keepdims=True)

        return codes, ends, different, found()

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Words of texts, the different words, and each position's distribution over the languages."""
        codes, ends, different, found = self.read(texts)
        return codes, ends, different, np.concatenate([np.zeros((0, len(self.languages))), *(shares for _, _, shares in found)])

    def texts(self, texts: pa.Array) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
        """The language of each text, the mean share that its words with letters give it, how many of these words are of each
        language, as "en:7 de:2" in falling order, and the share of their trigrams that the sample has; und, 0, "" and 0 without letters."""
        codes, ends, different, found = self.read(texts)
        letters = pc.match_substring_regex(different, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool) if len(different) else np.zeros(0, bool)
        k = len(self.languages)
        total, labels = np.zeros((len(texts), k)), np.zeros((len(texts), k), dtype=np.int64)
        for at, owner, shares in found:
            said = letters[codes[at]]
            owner, shares = owner[said], shares[said]
            for j in range(k):
                total[:, j] += np.bincount(owner, weights=shares[:, j], minlength=len(texts))
            labels += np.bincount(owner * k + shares.argmax(axis=1), minlength=len(texts) * k).reshape(-1, k)
        n, best = labels.sum(axis=1), total.argmax(axis=1)
        score = np.clip(total[np.arange(len(best)), best] / np.maximum(n, 1), 0, 1)
        order = np.argsort(-labels, axis=1, kind="stable").tolist()
        said = [" ".join([f"{self.languages[j]}:{own[j]}" for j in by if own[j]]) for own, by in zip(labels.tolist(), order, strict=True)]
        known = known_share(pc.utf8_lower(different).to_pylist(), letters, codes, np.repeat(np.arange(len(texts)), np.diff(ends)), len(texts), self.known)
        return [self.languages[b] if m else "und" for b, m in zip(best, n, strict=True)], np.where(n > 0, score, 0.0), said, np.where(n > 0, known, 0.0)


def runs(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Bounds of runs of sequences with `most` positions together, one sequence at least."""
    ends, out, first = np.cumsum(lengths), [], 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
        out.append((first, last))
        first = last
    return out


class Labelled:
    """Sequences of words with their labels, laid out in parts of bounded size; gives the likelihood of the labels and its slopes."""

    def __init__(self, features: Words, size: int, codes: np.ndarray, labels: np.ndarray, lengths: np.ndarray, k: int):
        self.features, self.size, self.n, self.k = features, size, len(codes), k
        self.truth, self.pairs, self.parts = np.zeros((features.count, k)), np.zeros((k, k)), []
        np.add.at(self.truth, (codes, labels), 1.0)
        upto = np.r_[0, np.cumsum(lengths)]
        for first, last in runs(lengths, CELLS // k):
            lattice, own = Lattice(lengths[first:last]), slice(upto[first], upto[last])
            self.parts.append((lattice, lattice.laid_out(codes[own])))
            laid = lattice.laid_out(labels[own])
            for (a, b), (c, d) in zip(lattice.bounds, lattice.bounds[1:]):
                np.add.at(self.pairs, (laid[a : a + d - c], laid[c:d]), 1.0)

    def slopes(self, weights: np.ndarray, moves: np.ndarray, kind=np.float32) -> tuple[float, np.ndarray, np.ndarray]:
        """The log likelihood for each word, less the shrinkage, and its slopes by weights and moves."""
        scores = self.features.emissions(weights)
        by_word, move = potentials(scores).astype(kind), transitions(moves).astype(kind)
        expected, joint = np.zeros((self.features.count, self.k)), np.zeros((self.k, self.k))
        value = (self.truth * (scores - scores.max(axis=1, keepdims=True, initial=-np.inf))).sum() + (self.pairs * (moves - moves.max(initial=0))).sum()
        for lattice, laid in self.parts:
            found, alpha, later, scale = marginals(lattice, by_word[laid], move)
            value -= np.log(scale, dtype=np.float64).sum() + math.log(self.k) * np.count_nonzero(lattice.lengths)
            for j in range(self.k):
                expected[:, j] += np.bincount(laid, weights=found[:, j], minlength=self.features.count)
            for (a, b), (c, d) in zip(lattice.bounds, lattice.bounds[1:]):
                joint += alpha[a : a + d - c].T @ later[c:d]
        n = max(1, self.n)
        return (value - SHRINK * (weights**2).sum() / 2) / n, (self.features.gathered(self.truth - expected, self.size) - SHRINK * weights) / n, (self.pairs - joint * move) / n


def train(texts: list[str], langs: list[str]) -> Field | None:
    """A field fitted by Adam to the likelihood of the words' languages; None without any text."""
    if not texts:
        return None
    languages = sorted(set(langs))
    label = np.array([languages.index(x) for x in langs])
    codes, ends, different = coded_words(pa.array(texts, pa.string()), wide=True)
    words = pc.utf8_lower(different).to_pylist()
    counts = Counter()
    for w, n in zip(words, np.bincount(codes, minlength=len(words)).tolist(), strict=True):
        counts[w] += n
    lexicon = {w: i for i, w in enumerate(sorted((w for w, n in counts.items() if n >= SEEN), key=lambda w: (-counts[w], w))[:LEXICON])}
    random = np.random.default_rng(0)
    parts, labels, lengths = [codes], [np.repeat(label, np.diff(ends))], [np.diff(ends)]
    own = labels[0]
    for _ in range(len(texts) if len(codes) else 0):  # pieces of several texts, one after another
        n = 0
        while n < SPLICED:
            at, size = int(random.integers(len(codes))), int(random.integers(1, 40))
            parts.append(codes[at : at + size])
            labels.append(own[at : at + size])
            n += len(parts[-1])
        lengths.append(np.array([n]))
    size, k = BUCKETS + len(lexicon), len(languages)
    labelled = Labelled(Words(words, lexicon), size, np.concatenate(parts), np.concatenate(labels), np.concatenate(lengths), k)
    weights, moves = np.zeros((size, k)), np.zeros((k, k))
    state = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    for epoch in range(1, EPOCHS + 1):
        _, *slopes = labelled.slopes(weights, moves)
        for x, g, m, v in zip((weights, moves), slopes, state[::2], state[1::2], strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-10)
    letters = pc.match_substring_regex(different, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool) if len(different) else np.zeros(0, bool)
    usual = usual_share(words, letters, codes, np.repeat(np.arange(len(texts)), np.diff(ends)), label)
    return Field(languages, lexicon, weights.astype(np.float32), moves, np.unique(trigrams(words)[0]), USUALLY * usual)


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", held_out: int = 2, modulus: int = 4) -> tuple[list[str], list[str]]:
    """At most SAMPLE training texts of every language, TEXTS in all or FEWEST of each if that is more, those with the least hashes of their ids.

    Hashes that lie far above are left out before rows of a language meet. Of an id's texts the least is taken, and of
    that LEARNED characters together, so the bytes that reach the driver are bounded too.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (remainder("doc_id", modulus) != held_out))
    ids = rows.select("doc_id", F.col(lang).alias("lang"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h"))
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    texts = max(TEXTS, FEWEST * sizes.count())
    near = ids.join(sizes, "lang").where(F.col("h").cast("double") * F.col("n") < float(4 * SAMPLE << 40)).select("doc_id", "lang", "h").distinct()
    chosen = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= SAMPLE).orderBy("r", "lang").limit(texts).select("doc_id", "lang")
    found = docs.select("doc_id", F.col(lang).alias("lang"), F.col(text).alias("text")).where("text is not null").join(chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - LEARNED, F.lit(0)) + 1).cast("int") + 1
    found = found.select("doc_id", "lang", F.substr("text", place, F.lit(LEARNED)).alias("text"))
    got = sorted((r["lang"], r["doc_id"], r["text"]) for r in found.collect())
    return [t for _, _, t in got], [x for x, _, _ in got]


def scorer(model, key: str):
    """For map_texts: languages, scores, counts of words by language and shares of known trigrams of a list of texts."""

    def make():
        field = once(key, lambda: model.value)

        def run(texts: list) -> list:
            if field is None:
                return [["und"] * len(texts), [0.0] * len(texts), [""] * len(texts), [0.0] * len(texts)]
            return list(field.texts(pa.array(texts, pa.string())))

        return run

    return make


def limit(field: Field | None) -> int:
    """Bytes of text worked on at once: fewer with many languages, as each word has a number for each."""
    return LIMIT * USUAL // max(USUAL, len(field.languages) if field else 0)


def predict(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, word_langs (words with letters by their own language, "en:7 de:2") and known (the share of these words'
    trigrams that the training sample has) for every row.

    A null text, or one without a letter, is und with score 0, and so is every text if there was nothing to learn
    from. A very long text is labelled piece by piece. A null id is never held out. Repeated rows stay, other columns
    are left out, an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(field)
    made = map_texts(docs, scorer(model, uuid.uuid4().hex), [("lang_pred", "string"), ("score", "double"), ("word_langs", "string"), ("known", "double")], text, limit=limit(field))
    return made.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "word_langs", "known")


def keep_known(docs: DataFrame, field: Field | None, least: float, text: str = "text") -> DataFrame:
    """The rows whose text is in a learned language, by a score of `least` and a share of known trigrams of `field.least` at least; all rows if there was nothing to learn from.

    The share is calibrated: a part of what texts of the sample have when held to others, in the language where that is least. It tells random letters and
    other scripts from all languages, which the score, a comparison of languages, can't. A few words are always enough like the sample. A null text, or one without a letter, has no language and goes. Repeated rows are judged alike, rows without id
    like any other, all columns stay, an empty table gives an empty result.
    """
    if field is None:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(field)
    make, enough = scorer(model, uuid.uuid4().hex), field.least

    def decide():
        run = make()

        def kept(texts: list) -> list:
            languages, scores, _, known = run(texts)
            return [bool(x != "und" and s >= least and k >= enough) for x, s, k in zip(languages, scores, known, strict=True)]

        return kept

    return filter_texts(docs, decide, text, limit(field))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, train(*sample(docs)))
