"""Exact de-duplication: against SQL, against sets of rows, and with a hash that collides."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, empty, lowered, odd_rows
from tidewright.llm import common, exact


def plain(rows, largest):
    """(doc_id, keep_id, size, sha) and the ids that stay, from rows of (doc_id, text)."""
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    out, stay = [], []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        stay.append((keep is not None, keep or 0, hashlib.sha256(t.encode()).hexdigest()))
        out += [(i, keep, len(ids), stay[-1][2]) for i in ids]
    return sorted(map(str, out)), sorted(stay)


def check(df, rows, largest, **more):
    got = exact.duplicates(df, exact.lowered("text"), largest, **more).collect()
    out, stay = plain(rows, largest)
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == out
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text_sha256) for r in got if r.kept) == stay


@pytest.mark.parametrize("largest", [False, True])
def test_odd_rows(spark, largest):
    odd = odd_rows(spark)
    check(odd, [(r.doc_id, r.text) for r in odd.collect()], largest)
    assert exact.duplicates(empty(spark), exact.lowered("text")).count() == 0


@pytest.mark.parametrize("bits", [0, 2])
def test_collisions_are_told_apart_by_bytes(spark, bits):
    """With a hash of no or of two bits nearly all texts collide."""
    odd = odd_rows(spark)
    check(odd, [(r.doc_id, r.text) for r in odd.collect()], True, hashed=lambda t: F.substring(F.unhex(F.md5(t)), 1, 0) if not bits else (F.crc32(t) % (1 << bits)).cast("string").cast("binary"))


def test_only_a_to_z_are_lowered(spark):
    texts = ["ÀÉÎ ABC", "àéî abc", "ÀÉÎ abc", "İ I", "İ i", "ΑΣ", "αΣ", "ΑΣ", "AZ@[`{", "az@[`{", "\x00A", "\x00a"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows, True)
    assert [r[0] for r in df.select(exact.lowered("text")).collect()] == [lowered(t) for t in texts]


def test_a_third_of_all_rows_are_one_text(spark):
    rows = [(i, "The same" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rows, True)


def test_query_equals_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    want = con.execute(exact.ORACLE_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, exact.op12_exact_dedup(spark, data).select(names).collect())) == sorted(want.fetchall())


def test_plan_has_no_python(spark, data):
    docs = documents(spark, data)
    for df in (exact.duplicates(docs, exact.lowered("text"), True), exact.shared_hashes(docs, exact.lowered("text"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
    common.release(spark)
