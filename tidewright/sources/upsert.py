"""A table that streams and batches are merged into by key: each batch takes effect once, whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.session import shared_folder
from tidewright.sources import table


class Upserts:
    """Rows by `key` with the greatest `version`, as Parquet in a folder of any file system that Spark reaches.

    Keys are dealt to `buckets` by a hash. A batch rewrites the buckets that it touches to files of their own, and then a small new file that names, for each bucket, where it stands; it is
    renamed into place, so readers see the table before or after a batch. It also holds the batch's number: a batch that is replayed, with that number or a lower one, changes nothing. What a batch that failed has
    written is named by nothing and not read. Of equal versions the row of the later batch stays, in one batch that with the greatest values. Rows with a null key are left out; a null version is less than any other.
    Batches must come from one writer at a time, as those of a stream do.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, version: str, buckets: int = 16):
        self.spark, self.path, self.key, self.version, self.buckets = spark, path.rstrip("/"), key, version, buckets

    def _at(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def state(self) -> dict:
        """The newest state: its number, the last batch, the schema, and the folder of each bucket."""
        where, fs = self._at("states")
        names = sorted(s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().endswith(".json")) if fs.exists(where) else []
        if not names:
            return {"number": 0, "batch": -1, "schema": None, "buckets": {}}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/states/{names[-1]}").collect()))

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The table, or the given buckets of it; None before the first batch."""
        state = self.state()
        if state["schema"] is None:
            return None
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(state["schema"])
        found = sorted({f"{self.path}/data/{f}/__bucket={b}" for b, f in state["buckets"].items() if buckets is None or int(b) in buckets})
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, number: int) -> bool:
        """Merges a batch; whether it took effect. Fits foreachBatch."""
        state = self.state()
        if number <= state["batch"]:
            return False
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        names = batch.columns
        whole = F.struct(F.col(self.version).alias("__v"), F.col("__new"), F.struct(*names).alias("__row"))
        fresh = batch.where(F.col(self.key).isNotNull()).withColumn("__new", F.lit(1))
        touched = [r[0] for r in fresh.select(bucket).distinct().collect()]  # no more than there are buckets
        before = self.read(touched)
        rows = fresh if before is None else fresh.unionByName(before.select(names).withColumn("__new", F.lit(0)))
        latest = rows.groupBy(F.col(self.key).alias("__key")).agg(F.max(whole).alias("__s")).select("__s.__row.*").withColumn("__bucket", bucket)
        folder = f"{number}-{uuid.uuid4().hex}"
        latest.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{folder}")
        new = {"number": state["number"] + 1, "batch": number, "schema": batch.schema.jsonValue(), "buckets": state["buckets"] | {str(b): folder for b in touched}}
        draft, fs = self._at(f"states/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(json.dumps(new).encode())
        out.close()
        if not fs.rename(draft, self._at(f"states/{new['number']:020d}.json")[0]):
            raise RuntimeError(f"batch {number}: another writer was faster")
        return True

    def sink(self, rows: DataFrame, checkpoint: str):
        """A writer of a stream that merges its batches; start() it."""
        return rows.writeStream.foreachBatch(lambda batch, number: self.merge(batch, number) and None).option("checkpointLocation", checkpoint)


def last_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer, from three batches of orders that are merged one after another, the second of them twice."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("at"), F.struct("o_orderdate", "o_orderkey").alias("version"))
    target = Upserts(spark, f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}", "o_custkey", "version")
    for i, years in enumerate(("year(at) % 3 = 1", "year(at) % 3 = 0", "year(at) % 3 = 2")):
        for _ in range(1 + (i == 1)):
            target.merge(orders.where(years), i)
    return target.read().select("o_custkey", "o_orderkey", "at")


QUERIES = {"last_orders": (last_orders, "select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, max(o_orderdate) as at from orders group by o_custkey")}
