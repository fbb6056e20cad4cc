"""Tar shards as source, sink and stream; tables that batches are merged into."""

import os
import tarfile
import time

import pytest
from pyspark.sql import functions as F

from tidewright.sources import tar
from tidewright.sources.upsert import Upserts


@pytest.fixture
def shards(spark, tmp_path):
    tar.register(spark)
    return str(tmp_path / "shards")


def made(spark, n, start=0):
    return spark.range(start, start + n).select(F.concat(F.lit("file-"), "id").alias("name"), F.encode(F.repeat(F.col("id").cast("string"), (F.col("id") % 50).cast("int")), "UTF-8").alias("content"))


def read(spark, folder, **options):
    return spark.read.format("tar").options(**options).load(folder)


def test_round_trip(spark, shards):
    rows = made(spark, 300).repartition(5)
    rows.write.format("tar").mode("append").save(shards)
    assert len(tar.shards(shards)) == 5 and not [x for x in os.listdir(shards) if x[0] == "."]
    got = {r.name: (r.size, bytes(r.content)) for r in read(spark, shards).collect()}
    assert got == {r.name: (len(r.content), bytes(r.content)) for r in rows.collect()}
    one = read(spark, shards).where("size > 60").orderBy("name").first()
    with open(f"{shards}/{one.shard}", "rb") as f:
        f.seek(one.offset)
        assert f.read(one.size) == bytes(one.content)
    assert read(spark, shards, content="false").where("content is not null").count() == 0
    made(spark, 7).coalesce(1).write.format("tar").mode("overwrite").save(shards)
    assert read(spark, shards).count() == 7
    made(spark, 0).write.format("tar").mode("append").save(shards)
    assert len(tar.shards(shards)) == 1 and read(spark, f"{shards}/nothing").count() == 0


def test_conditions_on_shards_skip_them(spark, shards):
    made(spark, 90).repartition(6).write.format("tar").mode("append").save(shards)
    first, second = tar.shards(shards)[:2]
    for condition, n in ((F.col("shard") == first, 1), (F.col("shard").isin(first, second), 2), (F.col("shard").startswith(first[:20]), 1), (F.col("size") > 5, 6)):
        found = read(spark, shards).where(condition)
        assert found.rdd.getNumPartitions() == n
        assert found.count() == len([r for r in read(spark, shards).collect() if (r.size > 5 if n == 6 else r.shard in (first, second)[:n])])


def test_damaged_and_foreign_entries(spark, shards):
    os.makedirs(shards)
    with tarfile.open(f"{shards}/a.tar", "w") as t:
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
        t.addfile(tarfile.TarInfo("x" * 300))
    open(f"{shards}/.half.tar", "wb").write(b"cut")
    assert [(r.name, r.size) for r in read(spark, shards).collect()] == [("x" * 300, 0)]
    with pytest.raises(ValueError, match="mounted"):
        tar.local("hdfs://host/folder")
    assert tar.local("file:///a/b") == "/a/b" and tar.local("file:/a/b") == "/a/b" and tar.local("/a/b") == "/a/b"


def test_a_restarted_stream_repeats_nothing(spark, shards, tmp_path):
    def run():
        rows = spark.readStream.format("tar").load(shards).select("name", "size")
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(once=True).start().awaitTermination()
        return sorted(r.name for r in spark.read.parquet(f"{tmp_path}/out").collect())

    made(spark, 20).repartition(3).write.format("tar").mode("append").save(shards)
    assert run() == sorted(f"file-{i}" for i in range(20))
    time.sleep(0.05)
    made(spark, 10, 20).repartition(2).write.format("tar").mode("append").save(shards)
    assert run() == sorted(f"file-{i}" for i in range(30)) == run()


# -- upserts --------------------------------------------------------------------------------------------------------

SCHEMA = "k int, v int, s string"


def rows_of(target):
    return sorted(map(tuple, target.read().collect()))


def test_batches_take_effect_once(spark, tmp_path):
    target = Upserts(spark, str(tmp_path / "t"), "k", "v", 4)
    assert target.read() is None
    first = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, None, "c"), (None, 1, "no key"), (1, 2, "a2"), (1, 2, "a1")], SCHEMA)
    assert target.merge(first, 0)
    assert rows_of(target) == sorted([(1, 2, "a2"), (2, 1, "b"), (3, None, "c")])
    second = spark.createDataFrame([(1, 1, "late"), (2, 1, "same version"), (3, 0, "newer"), (4, 1, "d")], SCHEMA)
    assert target.merge(second, 1)
    want = sorted([(1, 2, "a2"), (2, 1, "same version"), (3, 0, "newer"), (4, 1, "d")])
    assert rows_of(target) == want
    files = sorted(os.listdir(tmp_path / "t" / "data"))
    assert not target.merge(second, 1) and not target.merge(first, 0) and rows_of(target) == want
    assert sorted(os.listdir(tmp_path / "t" / "data")) == files
    assert target.merge(first.limit(0), 2) and rows_of(target) == want


def test_only_touched_buckets_are_rewritten_and_failed_batches_are_not_read(spark, tmp_path, monkeypatch):
    target = Upserts(spark, str(tmp_path / "t"), "k", "v", 8)
    target.merge(spark.createDataFrame([(i, 1, "x") for i in range(100)], SCHEMA), 0)
    before = target.state()["buckets"]
    target.merge(spark.createDataFrame([(5, 2, "y")], SCHEMA), 1)
    after = target.state()["buckets"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    real = Upserts._at
    monkeypatch.setattr(Upserts, "_at", lambda self, name: 1 / 0 if name.startswith("states/.") else real(self, name))
    with pytest.raises(ZeroDivisionError):
        target.merge(spark.createDataFrame([(6, 2, "lost")], SCHEMA), 2)
    monkeypatch.undo()
    assert (6, 1, "x") in rows_of(target) and len(rows_of(target)) == 100
    assert target.merge(spark.createDataFrame([(6, 2, "again")], SCHEMA), 2) and (6, 2, "again") in rows_of(target)


def test_a_stream_that_is_replayed(spark, tmp_path):
    target = Upserts(spark, str(tmp_path / "t"), "k", "v", 4)

    def run(checkpoint):
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        target.sink(rows, f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()

    for i in range(3):
        spark.createDataFrame([(k, i, f"{i}") for k in range(i, i + 5)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    run("one")
    want = sorted([(0, 0, "0"), (1, 1, "1"), *((k, 2, "2") for k in range(2, 7))])
    assert rows_of(target) == want
    run("two")  # all batches again, under a checkpoint that knows of none
    assert rows_of(target) == want and target.state()["batch"] == 2
