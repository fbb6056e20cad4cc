"""SimHash fingerprints, trees, shards and components against plain versions."""

from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import documents, empty, lowered, odd_rows, words
from tidewright.llm import simhash
from tidewright.llm.components import components


def plain_fingerprint(text):
    w = words(lowered(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, linked):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def near(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count() <= 3


@pytest.mark.parametrize("case", ["odd", "documents"])
def test_against_brute_force(spark, data, case):
    docs = odd_rows(spark) if case == "odd" else documents(spark, data)
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    root = plain_components(sorted(set(prints)), near)
    least = defaultdict(lambda: float("inf"))
    for r, p in zip(rows, prints, strict=True):
        if r.doc_id is not None:
            least[root[p]] = min(least[root[p]], r.doc_id)
    want = sorted((-1 if r.doc_id is None else r.doc_id, f"{p:016x}", least[root[p]]) for r, p in zip(rows, prints, strict=True))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.one_of_each_class(empty(spark)).count() == 0


def test_long_texts_are_counted_in_chunks(monkeypatch):
    text = " ".join(str(i * i % 977) for i in range(500))
    want = plain_fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.lists(st.integers(0, 63), max_size=6)), min_size=1, max_size=60))
def test_trees_link_what_is_near(points):
    values = sorted({(s, sum(1 << b for b in set(bits))) for s, bits in points})
    shard, fp = np.array([v[0] for v in values]), np.array([v[1] for v in values], dtype=np.uint64)
    got = simhash.link(shard, fp)
    index = list(range(len(values)))
    want = plain_components(index, lambda a, b: shard[a] == shard[b] and near(int(fp[a]), int(fp[b])))
    assert got.tolist() == [want[i] for i in index]


@pytest.mark.parametrize("limit", [20_000, 100, 20])
def test_dense_groups_keep_all_links(spark, limit, monkeypatch):
    rng = np.random.default_rng(0)
    values = sorted({0x1234567890ABCDEF ^ sum(1 << int(b) for b in set(rng.integers(0, 63, rng.integers(0, 6)).tolist())) for _ in range(500)})
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    rows = simhash.sharded(nodes, len(values), limit)
    links = rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(simhash.linked, "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert {v: got.get(v, v) for v in values} == plain_components(values, near)


def test_shards_meet_batch_borders(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "GATHER", 3)
    batches = [pa.RecordBatch.from_pydict({"shard": [1, 1], "fp": [0, 1]}), pa.RecordBatch.from_pydict({"shard": [1, 2], "fp": [3, 0]}), pa.RecordBatch.from_pydict({"shard": [2], "fp": [1]})]
    links = [x for b in simhash.linked(iter(batches)) for x in zip(*b.to_pydict().values(), strict=True)]
    assert sorted(links) == [(0, 1), (0, 1), (0, 3)]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture
def splitting(spark):
    """Settings under which tables of a test are large, and skewed joins of more than some KB are split."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def watched(monkeypatch, module):
    """The final plans of what `module` writes."""
    plans, real = [], module.durable

    def durable(df):
        made = real(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return made

    monkeypatch.setattr(module, "durable", durable)
    return plans


def test_hubs_and_giant_classes_are_split(spark, monkeypatch, splitting):
    import sys

    hub = spark.range(1, 40_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).repartition(8)
    plans = watched(monkeypatch, sys.modules["tidewright.llm.components"])
    got = components(hub)
    assert got.where("root = 0").count() == 40_001
    assert [p for p in plans if "SortMergeJoin(skew=true)" in p]
    plans = watched(monkeypatch, simhash)
    monkeypatch.setattr(simhash, "fingerprint_links", lambda nodes: hub)
    found = simhash.classes(spark.range(40_001).select(F.col("id").alias("doc_id"), F.col("id").alias("fp")))
    assert found.where("root = 0 and component_id = 0").count() == 40_001
    assert [p for p in plans if "SortMergeJoin(skew=true)" in p and "component_id" in p]


def test_one_of_each_class_stays(spark, data):
    docs = documents(spark, data)
    got = simhash.one_of_each_class(docs)
    assert got.columns == docs.columns
    want = {r.component_id for r in simhash.near_duplicates(docs).select("component_id").distinct().collect()}
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)
    nameless = docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.one_of_each_class(nameless.union(nameless)).count() == 2
    twice = docs.limit(5).union(docs.limit(5))
    assert simhash.one_of_each_class(twice.union(nameless)).count() == simhash.one_of_each_class(docs.limit(5)).count()


def test_ties_are_broken_alike(spark):
    """Rows of one id and class: the same one stays however the rows are dealt out."""
    rows = spark.createDataFrame([(1, t, x, {"k": x}) for x in "abc" for t in ("One  two", "one two", None, "")] + [(2, "one two", "a", None)], "doc_id long, text string, x string, m map<string,string>")
    kept = {tuple(map(str, sorted(map(str, simhash.one_of_each_class(df).collect())))) for df in (rows, rows.repartition(5), rows.coalesce(1).orderBy(F.desc("x")))}
    assert len(kept) == 1 and len(next(iter(kept))) == 2
    odd = odd_rows(spark)
    got = simhash.one_of_each_class(odd).collect()
    want = {r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert {r.doc_id for r in got} == want and len(got) == len(want)


def jaccard(a, b):
    def shingles(text):
        w = words(lowered(text))
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[int(rng.integers(len(w)))] = f"edit{int(rng.integers(10**6))}"
    return " ".join(w)


def test_wider_radius_keeps_all_links(spark):
    rng = np.random.default_rng(2)
    values = sorted({int(v) for base in rng.integers(-(2**62), 2**62, 40) for v in [base, *(base ^ sum(1 << int(b) for b in set(rng.integers(0, 63, rng.integers(1, 9)).tolist())) for _ in range(6))]})
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.root for r in components(simhash.fingerprint_links(nodes, 6)).collect()}
    assert {v: got.get(v, v) for v in values} == plain_components(values, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 6)


def test_sketches_tell_similarities():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.5, 0.8, 0.9, 1.0):
        both, own = int(400 * share), (400 - int(400 * share)) // 2
        x = rng.choice(2**31, both + 2 * own, replace=False).astype(np.int32)
        a, b = (simhash.sketch(simhash.least_hashes(np.sort(h))) for h in (x[: both + own], np.r_[x[:both], x[both + own :]]))
        agree = 64 * simhash.SKETCH - int(np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum())
        assert abs(2 * agree / (64 * simhash.SKETCH) - 1 - both / (both + 2 * own)) < 0.2


@pytest.mark.parametrize("limit", [20_000, 8])
def test_links_between_similar_texts(spark, data, limit):
    rng = np.random.default_rng(4)
    base = [r.text for r in documents(spark, data).where("length(text) > 600").orderBy("doc_id").limit(12).collect()]
    texts = [t for b in base for t in (b, edited(rng, b, 2), edited(rng, b, 5), edited(rng, b, max(1, len(b.split()) // 12)), " ".join(sorted(b.split())))] + ["", "one", "one two"]
    texts += [edited(rng, base[0], 2) for _ in range(60)]  # a dense group
    links = [(r.a, r.b) for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "node long, text string"), limit=limit).collect()]
    alike = {(j, i) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= simhash.SIMILAR}
    assert {(min(p), max(p)) for p in links} <= alike  # nothing else is linked
    assert len(links) < (1 if limit > 100 else 30) * len(texts)  # and never all pairs of a group
    index = list(range(len(texts)))
    want, got = plain_components(index, lambda a, b: (a, b) in alike), plain_components(index, lambda a, b: (a, b) in {(min(p), max(p)) for p in links})
    assert sum(want[i] == got[i] for i in index) > 0.95 * len(index) and len(set(want.values())) < len(texts) - 60


def test_one_of_each_group_stays(spark, data):
    rng = np.random.default_rng(6)
    docs = documents(spark, data).select("doc_id", "text")
    own = [r for r in docs.where("length(text) > 600").orderBy("doc_id").limit(20).collect()]
    more = spark.createDataFrame([(10_000 + r.doc_id, edited(rng, r.text, 3)) for r in own], docs.schema)
    got = simhash.one_of_each_group(docs.union(more))
    ids = {r.doc_id for r in got.collect()}
    classes_ = {r.doc_id for r in simhash.one_of_each_class(docs.union(more)).collect()}
    texts = {r.doc_id: r.text for r in docs.union(more).collect()}
    alike = {i for i in classes_ if i >= 10_000 and jaccard(texts[i], texts[i - 10_000]) >= simhash.SIMILAR}
    assert ids <= classes_ and len(alike & ids) <= 1 and len(alike) > 5
    kept = {i: texts[i] for i in ids}
    for i in classes_ - ids:  # every row that goes has a row that it is like, and that is before it
        assert any(j < i and jaccard(texts[i], texts[j]) >= simhash.SIMILAR for j in classes_)
    assert len(kept) == got.count()
    odd = odd_rows(spark)
    assert simhash.one_of_each_group(odd).columns == odd.columns and simhash.one_of_each_group(empty(spark)).count() == 0
    assert {r.doc_id for r in simhash.one_of_each_group(odd).collect()} <= {r.doc_id for r in simhash.one_of_each_class(odd).collect()}


def test_recall_of_near_copies(spark):
    """Of all pairs of different shingle sets with a similarity of 0.8 on a whole table, 0.95 at least lose one text."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    kept = {r.doc_id for r in simhash.one_of_each_group(docs).collect()}
    sets, held, pairs = {}, {}, set()
    for r in docs.orderBy("doc_id").collect():
        sets.setdefault(frozenset(simhash.shingle_hashes(r.text).tolist()), []).append(r.doc_id)
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in held.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            held[x].append(i)
        pairs |= {(j, i) for j, n in shared.items() if n >= 0.8 * (len(s) + len(list(sets)[j]) - n)}
    stays = [any(d in kept for d in ids) for ids in sets.values()]
    assert all(sum(d in kept for d in ids) < 2 for ids in sets.values())
    assert sum(stays[i] and stays[j] for i, j in pairs) <= 0.05 * len(pairs)
