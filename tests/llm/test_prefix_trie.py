"""The trie of conversations against one built in Python, node by node."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import words
from tidewright.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_convs int, words string, p int"


def plain(rows):
    """The result as sorted tuples, from rows (conv_id, turn, role, text) without ties of a turn."""
    own = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    nodes = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], [[], []])[0].append(c)
        nodes[path][1].append(c)
    out = {}
    for path in sorted(nodes, key=len, reverse=True):
        below = [out[p] for p in nodes if len(p) == len(path) + 1 and p[: len(path)] == path]
        members, ends = nodes[path]
        saved = (len(members) - 1) * len(words(path[-1][1])) if path else 0
        out[path] = (min(members), len(path), min(nodes[path[:-1]][0]) if path else None, len(members), len(below), sum(b[5] for b in below) or 1, saved + sum(b[6] for b in below), hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest())
    return sorted(out.values(), key=str)


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    got = prefix_trie.prefix_trie(df)
    assert got.columns[:8] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_nulls_empties_gaps_and_repeats(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c // 3}" if c % 5 else "the same") for c in [*range(0, 45), 61, 62, 83, -7, -20, -41] for t in range(c % 6 + 1)]
    rows += [(0, None, None, None), (100, None, "user", None), (101, 3, None, ""), (102, 1, "user", "a b"), (103, 1, "usera", " b"), (None, 1, "user", "no id"), (None, None, None, None)]
    rows += [(120, i, "user", "w " * i) for i in range(5)] + [(c, i, "user", "w " * i) for c in (121, 122, 123, 124) for i in range(7)]
    random.Random(1).shuffle(rows)
    check(spark, rows)


def test_repeated_rows_are_turns(spark):
    rows = [(c, 1, "user", "again") for c in (0, 1, 2, 40) for _ in range(4)]
    check(spark, rows)


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cells_pieces_and_merges(spark, monkeypatch):
    """Long conversations cut into small cells, end lists into small pieces, tries merged two to one."""
    monkeypatch.setattr(prefix_trie, "CELL", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 2)
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    rng = random.Random(2)
    rows = [(c, t, "user", f"t{min(t, 9)}{rng.random() < 0.02}") for c in range(60) for t in range(rng.choice((1, 4, 11, 30)))]
    rows += [(c, 7 * t, "user", f"t{t}") for c in range(60, 140) for t in range(4)]
    check(spark, rows)


def test_a_third_are_one_conversation(spark):
    rows = [(c, t, "user", "same" if c % 3 == 0 else f"{c} {t}") for c in range(300) for t in range(3)]
    check(spark, rows)


def test_very_long_text_and_one_long_conversation(spark):
    rows = [(0, 0, "user", "word " * 200_000), (1, 0, "user", "x" * 500_000)] + [(40, t, "user", "w") for t in range(400)] + [(41, t, "user", "w") for t in range(300)]
    check(spark, rows)


def test_whole_table(spark, data):
    df = spark.read.parquet(f"{data}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, prefix_trie.op11_prefix_trie(spark, data).collect()), key=str) == plain(rows)


@pytest.mark.parametrize("n", [1, 5])
def test_running_values(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice("aab"), rng.choice([None, *range(40)]), i, rng.randrange(1 << 30)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, i int, x long")
    got = prefix_trie.running(df, "k", F.floor(F.col("t") / n), ["t", "i"], {"s": (F.sum, F.col("x"), prefix_trie.add), "e": (F.bit_xor, F.col("x"), prefix_trie.xor)})
    want, so_far = set(), {}
    for k, t, i, x in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        s, e = so_far.get(k, (0, 0))
        so_far[k] = (s + x, e ^ x)
        want.add((k, t, i, x, *so_far[k]))
    assert {tuple(r) for r in got.collect()} == want
