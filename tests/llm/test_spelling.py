"""Spelling variants against all pairs of a small vocabulary."""

import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import documents, empty, lowered, odd_rows
from tidewright.llm import spelling


def near(a, b):
    """Whether one insertion, deletion or replacement of a code point makes one word the other."""
    if len(a) > len(b):
        a, b = b, a
    return a != b and len(b) - len(a) < 2 and any(a[:i] == b[:i] and a[i + (len(a) == len(b)) :] == b[i + 1 :] for i in range(len(b)))


def plain_counts(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def plain(rows):
    n, form = plain_counts(rows), {}
    beside = {w: [v for v in n if near(w, v)] for w in n}
    for w in n:
        if beside[w]:
            best = min(beside[w], key=lambda v: (-n[v], v))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(beside[w]), n.get(form.get(w))))
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], "doc_id long, text string, word string, n int, key int, id string").repartition(3)
    got = spelling.variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_forms_chains_and_ties(spark):
    words = {"colour": 40, "color": 90, "colours": 20, "coloor": 10, "colors": 45, "colorz": 45, "coulour": 5, "culour": 3, "aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "aaaaaaaaa": 48, "straße": 9, "strasse": 4, "straßes": 3, "éèêëì": 5, "éèêëí": 10, "éèêëî": 10, "ababab": 3, "bababa": 6, "abcde": 3, "abcdf": 5, "four": 50, "fours": 50, "twice": 2}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    check(spark, rows)


def test_odd_rows(spark):
    odd = odd_rows(spark).withColumn("text", F.concat("text", F.lit(" endings")))
    got = sorted(map(tuple, spelling.variants(odd).collect()))
    assert got == plain([(r.doc_id, r.text) for r in odd.collect()]) and got
    assert spelling.variants(empty(spark)).count() == 0


def test_signs_and_capitals(spark):
    rows = [(i, t) for i, t in enumerate(["ÀÉÎÕÜ àéîõü ÀÉÎÕÜ", "ab×cd ab÷cd AB×CD", "ab×cd, ab÷cd; AB×CD ab×cd", "xĀabcdef", "abcdefſabcdef ABCDEF", None, "don't-stopping stopping Stopping"])] * 3 + [(None, "nowhere nowhere nowhere elsewhere elsewhere elsewhere")]
    check(spark, rows)


def test_spoiled_runs(spark):
    """With very many ids each word loses a code point somewhere."""
    rows = [(i, "spelling Variants Übung") for i in range(1500)]
    assert len(plain_counts(rows)) > 3
    check(spark, rows)


def test_real_texts(spark, data):
    rows = [tuple(r) for r in documents(spark, data, 60).select("doc_id", "text").collect()]
    check(spark, rows)


def test_one_group_holds_most_words(spark):
    """Words that share their ends and differ in three places: nearly all have the same three rarest bigrams."""
    rows = [(0, " ".join(f"zq{a}{b}{c}xj" for a in "abcdef" for b in "abcdef" for c in "abcdef" for _ in range(3)))]
    check(spark, rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=5, max_size=9), min_size=2, max_size=40, unique=True))
def test_near_words_share_a_key(words):
    grams = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    order = {g: i for i, g in enumerate(sorted(grams, key=lambda g: (grams[g], g)))}
    made = {w: spelling.keys(w, order) for w in words}
    for a in words:
        for b in words:
            if near(a, b) and len(a) <= len(b):
                assert made[a][0] & (made[b][0] if len(a) == len(b) else made[b][1])
