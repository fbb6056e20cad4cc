"""The trained operators: against plain recursions and definitions, and by accuracy on rows held out."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, empty, fold, lowered, odd_rows, words
from tidewright.llm import common, language, language_model, quality, toxicity
from tidewright.llm.lattice import Lattice

BIG = "/root/testdata/sf0.01"


# -- shared ---------------------------------------------------------------------------------------------------------


def test_coded_words_are_the_words():
    texts = [" a  B ", "", None, "\x0b\x0ca\x1cb\x85c", "  ", "É x"]
    for lower in (False, True):
        codes, ends, different = common.coded_words(pa.array(texts), lower=lower)
        got = [[different[int(c)].as_py() for c in codes[a:b]] for a, b in zip(ends, ends[1:])]
        assert got == [words(lowered(t) if lower else t) for t in texts]
    codes, ends, different = common.coded_words(pa.array(texts), wide=True)
    assert [[different[int(c)].as_py() for c in codes[a:b]] for a, b in zip(ends, ends[1:])] == [(t or "").split() if "\x1c" not in (t or "") else ["a", "b", "c"] for t in texts]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (0, 5, 50, 1, 1)] + [None]})
    parts = list(common.slices(batch, "t", 6))
    assert [x for p in parts for x in p.column("t").to_pylist()] == batch.column("t").to_pylist()
    assert [p.num_rows for p in parts] == [2, 1, 3]


def plain_marginals(emit, move, start):
    """By summing over all paths."""
    n, k = emit.shape
    total, out = 0.0, np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        p = start[path[0]] * emit[0, path[0]]
        for i in range(1, n):
            p *= move[path[i - 1], path[i]] * emit[i, path[i]]
        total += p
        for i, s in enumerate(path):
            out[i, s] += p
    return total, out / total


def test_recursions_equal_sums_over_paths():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 5, 1, 5])
    emit, move, start = rng.random((lengths.sum(), 3)) + 0.01, rng.random((3, 3)), rng.random(3)
    lattice = Lattice(lengths)
    laid = np.empty_like(emit)
    laid[lattice.to] = emit
    alpha, scale = lattice.forward(laid.copy(), move, start)
    beta = lattice.backward(laid, scale, move)
    likelihood, found = lattice.sums(np.log(scale)), (alpha * beta)[lattice.to]
    at = 0
    for i, n in enumerate(lengths):
        if n:
            total, want = plain_marginals(emit[at : at + n], move, start)
            assert math.isclose(likelihood[i], math.log(total))
            assert np.allclose(found[at : at + n], want)
        at += n


# -- quality --------------------------------------------------------------------------------------------------------


def plain_counts(text):
    w = words(text)
    places = defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    repeated = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dups, len(repeated)


@pytest.mark.parametrize("case", ["odd", "documents"])
def test_counts_against_brute_force(spark, data, case):
    docs = odd_rows(spark) if case == "odd" else documents(spark, data)
    rows = quality.quality(docs).toPandas()
    got = sorted(rows[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]].itertuples(index=False, name=None))
    want = [plain_counts(r.text) for r in docs.select("text").collect()]
    assert got == sorted((*c, c[0] < 10 or 100 * c[4] > 20 * c[0]) for c in want)
    assert not (rows.kept & rows.base_failed).any()
    assert rows.kept.notna().all()


def test_outliers_are_rejected_and_the_rest_kept(spark):
    rows = quality.quality(documents(spark, BIG)).toPandas().set_index("doc_id")
    texts = documents(spark, BIG).toPandas().set_index("doc_id").text
    passed = rows[~rows.base_failed]
    junk = texts.str.contains(r"(?:[|#$%&*].*){8}", regex=True)
    assert passed.kept[~junk.reindex(passed.index)].mean() > 0.99
    assert passed.kept[junk.reindex(passed.index)].mean() < 0.1


def test_estimates_do_not_depend_on_partitions(spark):
    docs = documents(spark, BIG)
    a, b = (quality.quality(d).select("doc_id", "distance2").toPandas().sort_values("doc_id").distance2.to_numpy() for d in (docs.coalesce(1), docs.repartition(7, "source")))
    assert np.array_equal(a, b)


def test_estimate_ignores_a_cluster_of_outliers(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (800, quality.P)), rng.normal(12, 0.3, (200, quality.P))])
    rows = spark.createDataFrame([("a", "b", *(int(v * quality.STEPS) for v in r)) for r in x], ", ".join(["g_lang string", "g_source string", *(f"x{i} long" for i in range(quality.P))]))
    found = quality.estimates(rows).where("level = 2").first()
    assert max(abs(found[f"m{i}"]) for i in range(quality.P)) < 0.25


def plain_mcd(x, share, starts, rng):
    """Concentration steps to the exact nearest rows, from many random starts; the least determinant, reweighted."""
    h, floors, best = math.ceil(share * len(x)), np.diag(np.array(list(quality.FLOORS.values())) ** 2), None

    def moments(rows, factor):
        return rows.mean(axis=0), np.cov(rows.T, bias=True) * factor + floors

    def distances(mean, cov):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    for _ in range(starts):
        mean, cov = moments(x[rng.choice(len(x), quality.P + 2, replace=False)], 1.0)
        for _ in range(30):
            mean, cov = moments(x[np.argsort(distances(mean, cov), kind="stable")[:h]], quality.consistency(share))
        if best is None or np.linalg.slogdet(cov)[1] < best[0]:
            best = np.linalg.slogdet(cov)[1], mean, cov
    kept = x[distances(*best[1:]) <= quality.chi2_quantile(0.975, quality.P)]
    mean, cov = moments(kept, quality.consistency(0.975))
    return mean, cov, distances(mean, cov)


@pytest.mark.parametrize("bad", [0.0, 0.2, 0.4])
def test_estimates_against_exact_concentration_steps(spark, bad):
    rng = np.random.default_rng(7)
    n, mix = 600, rng.normal(0, 0.5, (quality.P, quality.P)) + np.eye(quality.P)
    good = rng.normal(0, 1, (n - int(bad * n), quality.P)) @ mix + 3
    x = np.round(np.concatenate([good, rng.normal(25, 1.5, (int(bad * n), quality.P))]) * quality.STEPS) / quality.STEPS
    rows = spark.createDataFrame([("a", "b", *(int(round(v * quality.STEPS)) for v in r)) for r in x], ", ".join(["g_lang string", "g_source string", *(f"x{i} long" for i in range(quality.P))]))
    found = quality.estimates(rows).where("level = 2").first()
    mean, inverse = np.array([found[f"m{i}"] for i in range(quality.P)]), np.zeros((quality.P, quality.P))
    for i in range(quality.P):
        for j in range(i + 1):
            inverse[i, j] = inverse[j, i] = found[f"a{i}_{j}"]
    want_mean, want_cov, want = plain_mcd(x, quality.SHARE, 60, rng)
    got = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
    assert np.abs(mean - want_mean).max() < 0.15 and abs(found["logdet"] - np.linalg.slogdet(want_cov)[1]) < 0.3
    cut = quality.chi2_quantile(1 - quality.ALPHA, quality.P)
    assert ((got > cut) == (want > cut)).mean() > 0.99 and (got[len(good) :] > cut).all() and (got[: len(good)] <= cut).mean() > 0.99


def test_copies_that_are_a_third_of_a_group_are_rejected(spark):
    docs = documents(spark, BIG).where("lang = 'en'").select("doc_id", "text", "lang", F.lit("s").alias("source"))
    junk = " ".join(f"{i} | #{7 * i} & {i}%" for i in range(60))
    n = docs.count()
    rows = quality.quality(docs.unionByName(spark.range(10_000, 10_000 + n // 2).select(F.col("id").alias("doc_id"), F.lit(junk).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source")))).toPandas().set_index("doc_id")
    texts = docs.toPandas().set_index("doc_id").text
    copies, passed = rows[rows.index >= 10_000], rows[(rows.index < 10_000) & ~rows.base_failed]
    assert 0.3 < len(copies) / (len(copies) + len(passed)) < 0.4 and not copies.base_failed.any() and (copies.level == 2).all()
    assert not copies.kept.any()
    assert passed.kept[~texts.str.contains(r"(?:[|#$%&*].*){8}", regex=True).reindex(passed.index)].mean() > 0.99


def test_chi_square():
    assert math.isclose(quality.chi2_cdf(2 * math.log(2), 2), 0.5)
    assert math.isclose(quality.chi2_quantile(0.975, 6), 14.449375, rel_tol=1e-6)
    assert math.isclose(quality.chi2_quantile(0.5, 6), 5.348121, rel_tol=1e-6)


def test_quality_of_nothing(spark):
    assert quality.quality(empty(spark)).count() == 0
    short = spark.createDataFrame([(1, "too short", None, None)], "doc_id long, text string, lang string, source string")
    assert [r.kept for r in quality.quality(short).collect()] == [False]


# -- language model -------------------------------------------------------------------------------------------------


def check_base(docs, got):
    rows = [(r.doc_id, words(lowered(r.text))) for r in docs.select("doc_id", "text").collect()]
    training = [w for d, w in rows if d is None or fold(d, 5) != 1]
    counts = Counter(x for w in training for x in w)
    n, v = sum(counts.values()) + len(training), len(counts) + (len(training) > 0)
    log = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    want = sorted((-1 if d is None else d, d is not None and fold(d, 5) == 1, len(w) + 1, sum(counts[x] > 0 for x in w) + (len(training) > 0), n, round(sum(log(counts[x]) for x in w) + log(len(training)), 4)) for d, w in rows)
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got)
    for a, b in zip(have, want, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-6, abs_tol=2e-4)


def test_base_against_brute_force_and_likelihood_on_held_out(spark, data):
    docs = documents(spark, data)
    got = language_model.language_model(docs).collect()
    check_base(docs, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)


def test_words_that_are_joined_score_the_same(spark, data):
    docs = documents(spark, data)
    every, few = ([r for r in sorted(language_model.language_model(docs, own=64, broadcast=n).collect(), key=lambda r: r.doc_id)] for n in (1 << 20, 500))
    check_base(docs, few)
    assert np.allclose([r.score for r in every], [r.score for r in few], rtol=1e-3)


def test_language_model_of_odd_rows(spark):
    docs = odd_rows(spark)
    check_base(docs, language_model.language_model(docs).collect())
    assert language_model.language_model(empty(spark)).count() == 0
    only_held = spark.createDataFrame([(d, "a b") for d in range(200) if fold(d, 5) == 1], "doc_id long, text string")
    got = language_model.language_model(only_held).collect()
    assert {(r.train_tokens, r.n_known, r.n_tokens) for r in got} == {(0, 0, 3)} and all(r.score < 0 for r in got)


def test_expected_counts_equal_sums_over_paths():
    rng, k = np.random.default_rng(1), language_model.STATES
    model = language_model.Hmm(language_model.normal(rng.random(k), 0), language_model.normal(rng.random((k, k)), 1), language_model.normal(rng.random((5, k)), 0))
    texts = [np.array([0, 3, 2]), np.array([4]), np.array([1, 1])]
    first, moves, emissions = np.zeros(k), np.zeros((k, k)), np.zeros((5, k))
    for text, likelihood in zip(texts, model.log10_likelihoods(texts), strict=True):
        paths = {}
        for path in itertools.product(range(k), repeat=len(text)):
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for i in range(1, len(text)):
                p *= model.move[path[i - 1], path[i]] * model.emit[text[i], path[i]]
            paths[path] = p
        total = sum(paths.values())
        assert math.isclose(likelihood, math.log10(total), rel_tol=1e-9)
        for path, p in paths.items():
            first[path[0]] += p / total
            for i, state in enumerate(path):
                emissions[text[i], state] += p / total
                if i:
                    moves[path[i - 1], state] += p / total
    for got, want in zip(model.expected(texts), (first, moves, emissions), strict=True):
        assert np.allclose(got, want, rtol=1e-4, atol=1e-5)


def test_scores_against_the_plain_model(spark, data, monkeypatch):
    """The query's own score: the forward recursion over each whole text with the trained model, and each word's share of its class."""
    docs = documents(spark, data)
    kept = {}
    real, vocabulary = language_model.baum_welch, language_model.vocabulary
    monkeypatch.setattr(language_model, "baum_welch", lambda *a: kept.setdefault("model", []).append(real(*a)) or kept["model"][-1])
    monkeypatch.setattr(language_model, "vocabulary", lambda *a: kept.setdefault("v", vocabulary(*a)))
    own = 64
    got = {r.doc_id: r.score for r in language_model.language_model(docs, own=own, broadcast=500).collect()}
    model = kept["model"][-1]
    rows = docs.select("doc_id", "text").collect()
    counts = Counter(w for r in rows if fold(r.doc_id, 5) != 1 for w in words(lowered(r.text)))
    place = {w: i for i, w in enumerate(kept["v"].words[:own])}
    tail = defaultdict(lambda: [0, 0])
    for w, c in counts.items():
        if w not in place:
            tail[language_model.ending(w)][0] += c
            tail[language_model.ending(w)][1] += 1
    for r in rows:
        if not 0 < len(words(r.text)) < 400:
            continue
        alpha, total = model.start, 0.0
        for w in [*words(lowered(r.text)), None]:
            k = own + language_model.ENDINGS if w is None else place.get(w, own + language_model.ending(w or ""))
            alpha = alpha * model.emit[k]
            if w is not None and w not in place:
                c, n = tail[language_model.ending(w)]
                total += math.log10((counts[w] + 0.5) / (c + 0.5 * (n + 1)))
            total += math.log10(alpha.sum())
            alpha = alpha / alpha.sum() @ model.move
        assert math.isclose(got[r.doc_id], total, rel_tol=1e-6)


def test_likelihood_rises_with_each_step(spark, data, monkeypatch):
    docs = documents(spark, data)
    totals = []
    for steps in (0, 1, 3):
        monkeypatch.setattr(language_model, "STEPS", steps)
        totals.append(sum(r.score for r in language_model.language_model(docs).collect() if not r.held_out))
    assert totals[0] < totals[1] < totals[2]


def test_counts_flushed_early_are_whole(spark, data, monkeypatch):
    docs = documents(spark, data)
    monkeypatch.setattr(language_model, "COUNTED", 50)
    got = {r.word: r.c for r in language_model.word_counts(docs).collect()}
    assert got == Counter(w for r in docs.collect() for w in words(lowered(r.text)))


# -- language -------------------------------------------------------------------------------------------------------


def test_language_accuracy_on_held_out_rows(spark):
    docs = documents(spark, BIG)
    got = language.predict(docs, language.train(*language.sample(docs))).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert set(got.doc_id) == {r.doc_id for r in docs.collect() if fold(r.doc_id, 4) == 2}
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_words_of_mixed_text(spark):
    docs = documents(spark, BIG)
    field = language.train(*language.sample(docs))
    codes, _, different, found = field.words(pa.array(["the of and that que los para las der und die mit"]))
    best = [field.languages[k] for k in found.argmax(axis=1)]
    assert best == ["en"] * 4 + ["es"] * 4 + ["de"] * 4


def test_slopes_equal_finite_differences():
    rng = np.random.default_rng(5)
    words_, k = ["ab", "ba", "cab", "a", "bc"], 3
    features, size = language.Words(words_, {"ab": 0, "bc": 1}), language.BUCKETS + 2
    lengths = np.array([4, 0, 1, 6])
    sample = language.Labelled(features, size, rng.integers(0, 5, 11), rng.integers(0, k, 11), lengths, k)
    weights, moves = np.zeros((size, k)), rng.normal(0, 1, (k, k))
    used = np.unique(features.features)
    weights[used] = rng.normal(0, 0.3, (len(used), k))
    value, by_weights, by_moves = sample.slopes(weights, moves, np.float64)
    brute = 0.0  # the likelihood of the labels themselves, over all paths
    emit, move = features.emissions(weights), np.exp(moves)
    rng = np.random.default_rng(5)
    codes, labels = rng.integers(0, 5, 11), rng.integers(0, k, 11)
    for a, b in zip(np.cumsum(lengths) - lengths, np.cumsum(lengths)):
        if b > a:
            total, _ = plain_marginals(np.exp(emit[codes[a:b]]), move, np.ones(k))
            brute += emit[codes[a:b], labels[a:b]].sum() + moves[labels[a : b - 1], labels[a + 1 : b]].sum() - math.log(total)
    assert math.isclose(value, (brute - language.SHRINK * (weights**2).sum() / 2) / 11, rel_tol=1e-9)
    for x, slope, places in ((moves, by_moves, itertools.product(range(k), range(k))), (weights, by_weights, itertools.product(used[::7], range(k)))):
        for i, j in places:
            sides = []
            for step in (1e-5, -1e-5):
                x[i, j] += step
                sides.append(sample.slopes(weights, moves, np.float64)[0])
                x[i, j] -= step
            assert math.isclose((sides[0] - sides[1]) / 2e-5, slope[i, j], rel_tol=1e-4, abs_tol=1e-8)


def test_prediction_against_sums_over_paths():
    field = language.train(["aa ab ca", "bb ba", "ab cc 1"], ["x", "y", "z"])
    texts = ["aa bb 12 ab", "", "cc", None, "ba aa aa bb", "7 --"]
    got = list(zip(*field.texts(pa.array(texts)), strict=True))
    for text, (lang, score, said, known) in zip(texts, got, strict=True):
        w = (text or "").split()
        letters = np.array([any(c.isalpha() for c in x) for x in w], dtype=bool)
        if not letters.any():
            assert (lang, score, said, known) == ("und", 0.0, "", 0.0)
            continue
        emit = np.exp(language.Words(w, field.lexicon).emissions(field.weights))
        shares = plain_marginals(emit, np.exp(field.moves), np.ones(3) / 3)[1][letters]
        assert lang == field.languages[shares.sum(axis=0).argmax()] and math.isclose(score, shares.mean(axis=0).max(), rel_tol=1e-4)
        best = Counter(field.languages[j] for j in shares.argmax(axis=1))
        assert dict(x.split(":") for x in said.split()) == {x: str(n) for x, n in best.items()}


def test_long_texts_are_labelled_in_pieces(spark, monkeypatch):
    docs = documents(spark, BIG)
    field = language.train(*language.sample(docs))
    texts = pa.array([" ".join(r.text for r in docs.where("length(text) > 200").orderBy("doc_id").limit(40).collect()), "short one", None])
    whole = field.words(texts)[3]
    monkeypatch.setattr(language, "PIECE", 100)
    monkeypatch.setattr(language, "CELLS", 4 * 1000)
    cut = field.words(texts)[3]
    assert cut.shape == whole.shape and len(cut) > 5000 and np.abs(cut - whole).max() < 1e-3
    owner, first, before, own = language.pieces(np.array([250, 0, 3]))
    assert owner.tolist() == [0, 0, 0, 1, 2] and own.tolist() == [100, 100, 50, 0, 3] and first.tolist() == [0, 100, 200, 250, 250] and before.tolist() == [0, 50, 50, 0, 0]


def test_sampled_texts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "LEARNED", 50)
    docs = spark.createDataFrame([(i, "word " * 100, "en") for i in range(20)], "doc_id long, text string, lang string")
    texts, _ = language.sample(docs)
    assert len(texts) == sum(fold(i, 4) != 2 for i in range(20)) and {len(t) for t in texts} == {50}


def test_field_fits_its_sample():
    texts, langs = ["aa ab", "bb ba", "ab"], ["x", "y", "x"]
    field = language.train(texts, langs)
    assert field.texts(pa.array(texts))[0] == langs


def test_every_language_is_learned(spark, monkeypatch):
    rng, rows = np.random.default_rng(3), []
    for k in range(45):
        own = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(12)]
        rows += [(100 * k + i, " ".join(rng.choice(own, 20)), f"l{k:02}") for i in range(60 - k)]  # the last ones are the rarest
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "TEXTS", 30)
    texts, langs = language.sample(docs)
    kept = Counter(x for d, _, x in rows if fold(d, 4) != 2)
    found = Counter(langs)
    assert len(found) == len(kept) == 45 and len(texts) == language.FEWEST * 45  # what rare languages leave goes to others
    assert all(found[x] >= min(language.FEWEST, n) for x, n in kept.items())
    monkeypatch.setattr(language, "CELLS", 45 * 1000)
    got = language.predict(docs, language.train(texts, langs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).groupby(got.lang).mean().min() > 0.9 and got.lang.nunique() == len({x for d, _, x in rows if fold(d, 4) == 2})


def test_training_in_parts_is_the_same(monkeypatch):
    texts, langs = ["aa ab", "bb ba", "ab", "ba bb bb"], ["x", "y", "x", "y"]
    whole = language.train(texts, langs)
    monkeypatch.setattr(language, "CELLS", 1)
    assert np.allclose(language.train(texts, langs).weights, whole.weights, atol=1e-3)
    assert language.runs(np.array([3, 0, 5, 1, 9]), 4) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_known_trigrams_against_sets():
    """Shares of known trigrams of words with letters, and the threshold, by sets of strings."""
    texts = ["the cat sat on a mat 12 ---", "a dog and a cat", "der Hund und die Katze", "die Katze saß auf der Matte", "", "99"]
    langs = ["en", "en", "de", "de", "en", "de"]
    field = language.train(texts, langs)

    def grams(text):
        own = [b"\x02" + w.lower().encode() + b"\x03" for w in (text or "").split() if any(c.isalpha() for c in w)]
        return [w[i : i + 3] for w in own for i in range(len(w) - 2)]

    def share(text, known):
        own = grams(text)
        return (sum(g in known for g in own) + language.GIVEN) / (len(own) + language.GIVEN)

    every = {g for t in texts for w in (t,) for g in grams(w)} | {b"\x0212"[0:3], b"12\x03", b"\x02--", b"---", b"--\x03", b"\x0299", b"99\x03", b"\x0212"}
    more = [*texts, "a cat and zqxwv", "qqqq " * 40, None, "Katze"]
    got = field.texts(pa.array(more))[3]
    assert np.allclose(got, [share(t, every) if grams(t) else 0.0 for t in more])
    usual = {}
    for i, (t, x) in enumerate(zip(texts, langs, strict=True)):
        other = {g for j, u in enumerate(texts) if j % 2 != i % 2 for g in grams(u)}
        usual.setdefault(x, []).append(share(t, other))
    assert math.isclose(field.least, language.USUALLY * min(float(np.median(v)) for v in usual.values()))


def test_gibberish_goes_and_clean_texts_stay(spark):
    """Twelve languages of syllables of their own, held-out texts of any length among them, random letters and an unknown script."""
    rng = random.Random(5)
    syllables = {f"l{k}": ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiouäöüéè") for _ in range(rng.choice((1, 2)))) for _ in range(30)] for k in range(12)}
    clean = lambda x, n: " ".join("".join(rng.choices(syllables[x], k=rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, clean(f"l{i % 12}", rng.choice((2, 8, 60, 200))), f"l{i % 12}") for i in range(480)]
    odd = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)) for n in (150, 400, 3000)] + ["Добрый день, это русский текст для проверки", "这是一个没有空格的中文句子 这里还有更多的汉字"]
    docs = spark.createDataFrame(rows + [(1000 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    field = language.train(*language.sample(docs))
    assert len(field.languages) == 12 and field.least > 0.4
    assert sorted(r.doc_id for r in language.keep_known(docs, field, 0.0).collect()) == list(range(480))


def test_language_of_odd_rows(spark):
    docs = odd_rows(spark)
    field = language.train(["hello there", "guten tag"], ["en", "de"])
    for model in (field, None):
        got = language.predict(docs, model).collect()
        assert len(got) == docs.count()
        by_id = {r.doc_id: r for r in got}
        assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (0, 1, 2, 11))
        assert not by_id[None].held_out
    assert language.predict(empty(spark), field).count() == 0
    assert language.sample(empty(spark)) == ([], [])
    assert language.train([], []) is None
    assert language.keep_known(docs, field, 0.0).columns == docs.columns
    assert language.keep_known(docs, None, 0.0).count() == docs.count()  # nothing learned, nothing rejected


# -- toxicity -------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = documents(spark, path), toxicity.labels_of(spark, path)
    model = toxicity.train(*toxicity.sample(docs, labels))
    got = toxicity.toxicity(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert all(fold(d, 5) == 0 for d in got.doc_id)
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.predicted == got.toxic).mean() > 0.95
    assert got.predicted[got.toxic == 1].mean() > 0.7 and got.predicted[got.toxic == 0].mean() < 0.03


def test_held_out_labels_change_nothing(spark, data):
    docs, labels = documents(spark, data), toxicity.labels_of(spark, data)
    turned = labels.withColumn("toxic", F.when(common.remainder("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.sample(docs, labels) == toxicity.sample(docs, turned)


@pytest.mark.parametrize("make", [toxicity.dictionaries, toxicity.trained])
def test_scores_against_plain_compression(spark, make):
    import zstandard

    docs = documents(spark, BIG)
    rows, share = toxicity.sample(docs, toxicity.labels_of(spark, BIG))
    model = toxicity.train(rows, share, make)
    score = model.scorer()
    for text in [r.text for r in docs.orderBy("doc_id").limit(20).collect()] + ["", None, "Idiot", "a b\nc d e f g\t h"]:
        w = (text or "").encode().lower().split()
        sizes = []
        for content in (model.ordinary, model.toxic):
            params = toxicity.compressor(content)  # the same settings; each window on its own
            sizes.append([len(params.compress(b" " + b" ".join(w[i : i + 4]) + b" " + b"\n" * 8)) for i in range(0, len(w), 4)])
        gains = [a - b for a, b in zip(*sizes, strict=True)]
        x = [math.log(1 + sum(g >= least for g in gains)) for least in (2, 3, 4, 5, 6, 7)]
        x += [math.log(1 + 100 * sum(g >= least for g in gains) / max(1, len(gains))) for least in (2, 3, 4, 5, 6, 7)]
        x += [math.log(1 + len(gains)), max([0, *gains])]
        z = model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x, strict=True))
        assert math.isclose(score(text), 1 / (1 + math.exp(-z)), rel_tol=1e-9, abs_tol=1e-12)
    own = toxicity.windows(b"some words of a text")[0]
    frame = toxicity.compressor(model.toxic).compress(own)
    params = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(model.toxic, dict_type=zstandard.DICT_TYPE_RAWCONTENT), format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    assert params.decompress(frame, max_output_size=200) == own  # the lengths are those of frames that hold the window


def test_calibration_is_that_of_the_shares():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    ordinary = [word() for _ in range(300)]
    text = lambda bad: " ".join([*rng.choice(ordinary, 30), *(["nastyword", "vileword"] if bad else [])])
    rows = [(y, text(y and rng.random() < 0.8), c) for y in (0, 1) for c in (False, True) for _ in range(200)]
    even, rare = toxicity.train(rows), toxicity.train(rows, 0.01)
    assert math.isclose(rare.weights[0] - even.weights[0], math.log(0.01 / 0.99), rel_tol=1e-9)


def test_labels_that_are_missing(spark):
    ids = [i for i in range(200) if fold(i, 5) != 0]
    texts = {i: f"word{i} and other{i % 7} things " * 5 + ("nasty" if i % 2 else "") for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    of = lambda pairs: spark.createDataFrame(pairs, "doc_id long, toxic int")
    fours = [i for i in ids if fold(i, 5) == 4]
    for pairs in ([], [(i, 1) for i in ids], [(i, 0) for i in ids], [(ids[0], 1)]):  # nothing to tell apart: nothing goes
        model = toxicity.train(*toxicity.sample(docs, of(pairs)))
        assert model.weights is None and toxicity.keep_clean(docs, model).count() == 200
    for pairs in ([(i, i % 2) for i in ids if i not in fours], [(i, i % 2) for i in fours], [(i, 0 if i in fours else i % 2) for i in ids]):  # folds that lack rows or a label
        assert toxicity.train(*toxicity.sample(docs, of(pairs))).weights is not None


def test_segments_cover_toxic_texts():
    toxic = [b"such a nasty thing", b"a nasty one", b"nasty words", b"how nasty is it"] * 2
    ordinary = [b"such a nice thing", b"a good one", b"many words"] * 40
    assert toxicity.toxic_segments(toxic, ordinary)[0] == b" nasty "


def test_toxicity_of_odd_rows(spark):
    docs = odd_rows(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(*toxicity.sample(docs, labels))
    got = toxicity.toxicity(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(empty(spark), model).count() == 0
    none = toxicity.train(*toxicity.sample(empty(spark), labels.limit(0)))
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert toxicity.keep_clean(docs, none).columns == docs.columns and toxicity.keep_clean(docs, none).count() == docs.count()
