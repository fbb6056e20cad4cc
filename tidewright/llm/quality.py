"""Robust multivariate outliers: minimum-covariance-determinant estimates for each language and source.

Each text gives a vector of transformed statistics. For every group the estimate looks for the half of the rows
whose covariance has the least determinant: from three deterministic starts, concentration steps keep the rows
nearest to the present centre, and the start with the least determinant is carried on, reweighted, and used for the
Mahalanobis distances of all rows. A group too small for that uses the estimate of its language, or of all rows.

Vectors are rounded to integers, so sums over any partitioning are exact and the result does not depend on it. A
step is two aggregations that combine before their shuffle: counts by binned distance give the cut-off of each group,
sums and products of the rows within it the next estimate. No group is brought into one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import BATCH_ROWS, SLICE_BYTES, coded_words, documents, durable, slices

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
#: Steps to which vectors are rounded; bins of a doubling of 1 + squared distance.
STEPS, BINS = 256, 32
#: Dimensions: transformed statistics, each with the least standard deviation that an estimate may give it.
FLOORS = {"log_words": 0.3, "log_word_length": 0.06, "symbols": 0.15, "repeats": 0.3, "dup_lines": 0.3, "echoes": 0.1}
P = len(FLOORS)
#: Share of rows in the subset, least rows for a group's own estimate, steps before and after the choice of a start.
SHARE, LEAST, FIRST_STEPS, LAST_STEPS = 0.5, 60, 2, 3
#: Chance by which a regular row is rejected, were rows normal.
ALPHA = 1e-9
#: Estimates up to which they are broadcast.
FEW = 20_000


# -- statistics of a text -----------------------------------------------------------------------------------------


def _number(*columns: np.ndarray) -> np.ndarray:
    """One number for each different combination; equal exactly where all columns are."""
    out = columns[0]
    for c in columns[1:]:
        out = np.unique(out * (int(c.max(initial=0)) + 1) + c, return_inverse=True)[1]
    return out


def word_repeats(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the words in windows found twice or more in it, and the words equal to the one before."""
    n, texts = len(codes), np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    covered = np.zeros(n + WINDOW + 1, dtype=np.int64)
    if n >= WINDOW:
        at = np.flatnonzero(texts[: n - WINDOW + 1] == texts[WINDOW - 1 :])
        two = _number(codes[:-1], codes[1:])
        four = _number(two[:-2], two[2:])
        five = _number(four[at], codes[at + WINDOW - 1], texts[at])
        twice = at[np.bincount(five, minlength=1)[five] > 1] if len(at) else at
        covered[twice] += 1
        np.subtract.at(covered, twice + WINDOW, 1)
    inside = np.r_[0, np.cumsum(np.cumsum(covered)[:n] > 0)]
    echo = np.r_[0, np.cumsum(np.r_[False, (codes[1:] == codes[:-1]) & (texts[1:] == texts[:-1])])] if n else np.zeros(1, np.int64)
    return inside[ends[1:]] - inside[ends[:-1]], echo[ends[1:]] - echo[ends[:-1]]


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def statistics(texts: pa.Array) -> list:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and echoes of each text."""
    codes, ends, _ = coded_words(texts)
    repeats, echoes = word_repeats(codes, ends)
    strings = [s or "" for s in texts.to_pylist()]
    chars = [len(s) - sum(map(s.count, SPACES)) for s in strings]
    return [np.diff(ends), chars, [sum(map(s.count, SYMBOLS)) for s in strings], [dup_lines(s) for s in strings], repeats, echoes]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_echoes")


def word_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, lang, source and the counts for every row."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    source = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col(text).cast("string").alias("__text"))

    def run(batches):
        for whole in batches:
            for part in slices(whole, "__text", SLICE_BYTES):
                made = statistics(part.column("__text"))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *(pa.array(x, pa.int64()) for x in made)], names=["doc_id", "lang", "source", *COUNTS])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:3], *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def vector() -> list[Column]:
    """The dimensions in FLOORS, in steps."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    rate = lambda c: F.log1p(10 * F.col(c) / (n + 10))  # noqa: E731  as if ten ordinary words stood beside, for a single case in a short text is no sign
    made = [F.log1p("n_words"), F.log((F.col("word_chars") + 50) / (n + 10)), rate("n_symbols"), rate("n_repeat_words"), F.log1p("n_dup_lines"), rate("n_echoes")]
    return [F.round(x * STEPS).cast("long").alias(f"x{i}") for i, x in enumerate(made)]


# -- chi-square -----------------------------------------------------------------------------------------------------


def chi2_cdf(x: float, k: int) -> float:
    """The regularised lower gamma function of k / 2 at x / 2: a series, or a continued fraction for its complement."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an, b = -i * (i - a), b + 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """What the covariance of the nearest `share` of normal rows must be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2) if 0 < share < 1 else 1.0


# -- estimates ------------------------------------------------------------------------------------------------------

KEYS = ["level", "g_lang", "g_source"]
MEAN, INVERSE = [f"m{i}" for i in range(P)], [f"a{i}_{j}" for i in range(P) for j in range(i + 1)]
ESTIMATE = ", ".join([*(f"{c} double" for c in MEAN), *(f"{c} double" for c in INVERSE), "logdet double"])
KEY_TYPES = "level int, g_lang string, g_source string"


def distance() -> Column:
    """The squared Mahalanobis distance of x0, x1, ... by the estimate beside them."""
    d = [F.col(f"x{i}") / STEPS - F.col(f"m{i}") for i in range(P)]
    terms = [F.col(f"a{i}_{j}") * d[i] * d[j] * (1 if i == j else 2) for i in range(P) for j in range(i + 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


def binned(d: Column) -> Column:
    return F.floor(F.log2(1 + d) * BINS).cast("int")


def estimated(rows: list[tuple[np.ndarray, np.ndarray]]) -> list[list[float]]:
    """m, a and logdet from means and covariances, each widened by the floors."""
    out = []
    floors = np.diag(np.array(list(FLOORS.values())) ** 2)
    for mean, cov in rows:
        wide = cov + floors
        inverse = np.linalg.inv(wide)
        out.append([*mean, *(inverse[i, j] for i in range(P) for j in range(i + 1)), np.linalg.slogdet(wide)[1]])
    return out


def solve(sums: DataFrame, keys: list[str], key_types: str) -> DataFrame:
    """Estimates from sums: n, s_i and s_i_j of the rows within, and the factor by which the covariance is corrected."""

    def run(batches):
        for b in batches:
            n = b["n"].to_numpy(np.float64)
            s = b[[f"s{i}" for i in range(P)]].to_numpy(np.float64) / STEPS / n[:, None]
            rows = []
            for k in range(len(b)):
                second = np.zeros((P, P))
                for i in range(P):
                    for j in range(i + 1):
                        second[i, j] = second[j, i] = float(b[f"s{i}_{j}"].iloc[k]) / STEPS**2 / n[k]
                rows.append((s[k], (second - np.outer(s[k], s[k])) * float(b["factor"].iloc[k])))
            made = pd.DataFrame(estimated(rows), columns=[*MEAN, *INVERSE, "logdet"], index=b.index)
            yield pd.concat([b[keys], made], axis=1)

    return sums.mapInPandas(run, f"{key_types}, {ESTIMATE}")


def settled(df: DataFrame, n: int) -> DataFrame:
    """`df`, which has a row for each of `n` estimates, three at most: computed once, and held as rows of the plan if it is so small that it is broadcast, else written."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema) if n <= FEW else durable(df)


def moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(P) for j in range(i + 1)])


def beside(rows: DataFrame, estimates: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows with the estimates of their keys; broadcast if these are few, else joined."""
    return rows.join(F.broadcast(estimates) if n <= FEW else estimates, keys)


def starts(rows: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """Three estimates for each group, all from medians and median deviations: of squashed scores, of directions, and their diagonal.

    Medians are exact, over counts of the rounded values.
    """

    def medians(long: DataFrame) -> DataFrame:
        counts = long.groupBy(*KEYS, "i", "v").agg(F.count("*").alias("c"))
        w = Window.partitionBy(*KEYS, "i").orderBy("v")
        ranked = counts.withColumn("upto", F.sum("c").over(w)).withColumn("all", F.sum("c").over(Window.partitionBy(*KEYS, "i")))
        return ranked.where(2 * F.col("upto") >= F.col("all")).groupBy(*KEYS, "i").agg(F.min("v").alias("median"))

    def wide(found: DataFrame, name: str) -> DataFrame:
        return found.groupBy(*KEYS).agg(*[F.max(F.when(F.col("i") == i, F.col("median"))).alias(f"{name}{i}") for i in range(P)])

    long = lambda xs: F.posexplode(F.array(*xs)).alias("i", "v")
    centre = settled(wide(medians(rows.select(*KEYS, long([F.col(f"x{i}") for i in range(P)]))), "c"), n)
    centred = beside(rows, centre, KEYS, n)
    spread = settled(wide(medians(centred.select(*KEYS, long([F.abs(F.col(f"x{i}") - F.col(f"c{i}")) for i in range(P)]))), "d").join(centre, KEYS), n)
    floors = list(FLOORS.values())
    scale = [F.greatest(1.4826 * F.col(f"d{i}"), F.lit(STEPS * floors[i])) for i in range(P)]
    z = beside(rows, spread, KEYS, n).select(*KEYS, *[((F.col(f"x{i}") - F.col(f"c{i}")) / scale[i]).alias(f"z{i}") for i in range(P)])
    norm = F.greatest(F.sqrt(sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(P))), F.lit(1e-9))
    whole = lambda x: F.round(x * (1 << 20)).cast("long")  # noqa: E731  integers, so that sums are exact
    squashed = [F.tanh(f"z{i}") for i in range(P)]
    turned = [F.col(f"z{i}") / norm for i in range(P)]
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    sums = z.groupBy(*KEYS).agg(F.count("*").alias("n"), *[F.sum(whole(u[i] * u[j])).alias(f"{name}{i}_{j}") for name, u in (("t", squashed), ("u", turned)) for i, j in pairs]).join(spread, KEYS)

    def run(batches):
        for b in batches:
            keys, rows = [], []
            for r in b.to_dict("records"):
                scale = np.array([max(1.4826 * r[f"d{i}"] / STEPS, floors[i]) for i in range(P)])
                mean = np.array([r[f"c{i}"] / STEPS for i in range(P)])
                for k, name in enumerate(("t", "u", "")):
                    cov = np.eye(P)
                    if name:
                        for i, j in pairs:
                            cov[i, j] = cov[j, i] = r[f"{name}{i}_{j}"] / (1 << 20) / r["n"]
                        own = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                        cov = cov / np.outer(own, own)
                    keys.append((r["level"], r["g_lang"], r["g_source"], k))
                    rows.append((mean, cov * np.outer(scale, scale)))
            yield pd.DataFrame([(*k, *e) for k, e in zip(keys, estimated(rows), strict=True)], columns=[*KEYS, "start", *MEAN, *INVERSE, "logdet"])

    return settled(sums.mapInPandas(run, f"{KEY_TYPES}, start int, {ESTIMATE}"), n)


def estimates(vectors: DataFrame) -> DataFrame:
    """Estimates for every group of `vectors` (g_lang, g_source, x0, ...) with LEAST rows at least; level 0 is all rows, 1 a language, 2 a source in it."""
    blank = F.lit(None).cast("string")
    group = F.explode(F.array(F.struct(F.lit(0).alias("level"), blank.alias("g_lang"), blank.alias("g_source")), F.struct(F.lit(1).alias("level"), F.col("g_lang"), blank.alias("g_source")), F.struct(F.lit(2).alias("level"), F.col("g_lang"), F.col("g_source"))))
    # nulls are written out so that keys join
    rows = vectors.select(group.alias("g"), *[f"x{i}" for i in range(P)]).select("g.level", F.coalesce("g.g_lang", F.lit("\x00")).alias("g_lang"), F.coalesce("g.g_source", F.lit("\x00")).alias("g_source"), *[f"x{i}" for i in range(P)])
    sizes = durable(rows.groupBy(*KEYS).agg(F.count("*").alias("rows")).where((F.col("rows") >= LEAST) | (F.col("level") == 0)))
    n = sizes.count()
    rows = beside(rows, sizes.select(*KEYS), KEYS, n)
    now, keys, key_types = starts(rows, sizes, n), [*KEYS, "start"], f"{KEY_TYPES}, start int"
    sized = lambda e: e.join(F.broadcast(sizes) if n <= FEW else sizes, KEYS)
    for step in range(FIRST_STEPS + LAST_STEPS):
        if step == FIRST_STEPS:
            now = settled(now.withColumn("best", F.row_number().over(Window.partitionBy(*KEYS).orderBy("logdet", "start"))).where("best = 1").drop("best"), n)
        at = beside(rows, now, KEYS, 3 * n).withColumn("bin", binned(distance()))
        counts = at.groupBy(*keys, "bin").agg(F.count("*").alias("c"))
        upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy("bin")))
        cut = settled(sized(upto).where(F.col("upto") >= F.ceil(SHARE * F.col("rows"))).groupBy(*keys).agg(F.min("bin").alias("cut")).join(now, keys), n)
        kept = beside(rows, cut, KEYS, 3 * n).where(binned(distance()) <= F.col("cut"))
        now = settled(solve(moments(kept, keys).withColumn("factor", F.lit(consistency(SHARE))), keys, key_types), n)
    kept = beside(rows, now, KEYS, n).where(distance() <= chi2_quantile(0.975, P))
    return settled(solve(moments(kept, KEYS).withColumn("factor", F.lit(consistency(0.975))), KEYS, KEY_TYPES), n)


def quality(docs: DataFrame, text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the squared distance and the level of the estimate by which a row was judged.

    A null or empty text has zero counts and fails the base rule. A very long text is counted whole, in memory in proportion
    to it. A null language or source is a group like any
    other. Estimates come from the rows that pass the base rule; where none do, there is nothing to judge. Repeated
    rows count each and stay; other columns are left out; an empty table gives an empty result.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = durable(word_statistics(docs, text).withColumn("base_failed", failed).withColumn("g_lang", F.coalesce("lang", F.lit("\x00"))).withColumn("g_source", F.coalesce("source", F.lit("\x00"))).drop("lang", "source").select("*", *vector()))
    found = estimates(rows.where("not base_failed").select("g_lang", "g_source", *[f"x{i}" for i in range(P)]))
    n = found.count()
    values = F.struct("level", *MEAN, *INVERSE)
    of_source = found.where("level = 2").select("g_lang", "g_source", values.alias("own"))
    of_lang = found.where("level = 1").select("g_lang", values.alias("shared"))
    of_all = found.where("level = 0").select("level", *MEAN, *INVERSE).first()  # one row, or none without a row to judge
    every = F.struct(*[F.lit(None if of_all is None else of_all[c]).cast("int" if c == "level" else "double").alias(c) for c in ("level", *MEAN, *INVERSE)])
    few = F.broadcast if n <= FEW else lambda x: x
    judged = rows.join(few(of_source), ["g_lang", "g_source"], "left").join(few(of_lang), "g_lang", "left")
    judged = judged.withColumn("e", F.coalesce("own", "shared", every)).select("doc_id", *COUNTS, "base_failed", *[f"x{i}" for i in range(P)], "e.*").withColumn("distance2", distance())
    fine = F.coalesce(F.col("distance2") <= chi2_quantile(1 - alpha, P), F.lit(True))
    return judged.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & fine).alias("kept"), "distance2", "level")


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))
