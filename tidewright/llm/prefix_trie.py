"""The trie of conversations: nodes of shared beginnings, with their members, children, leaves and what sharing saves.

A node is named by its depth and a 128-bit hash of the turns on its path, which is the exclusive or of hashes of the single
turns and their places: so names are running values, and a conversation of any length is cut into cells of turns instead
of being brought together. Texts leave at the scan, where a turn becomes two hashes and a count of words.

Tries are built in two passes. In the first, every partition combines the turns it holds to a table of nodes (members, least
member); tables are merged by the nodes' names, FAN partitions to one, until one is left. The lists of conversations that end
at a node are merged likewise, in pieces of CHUNK ids. The second pass is the rollup: a node's sums over its subtree are sums over its
members, once each node is charged to one member, the least. A conversation is charged for the nodes at its end, from some depth on,
so it adds to each of its nodes, bottom up, the words from there to that depth; these are combined and merged in the same way.
No step is taken once a level, so deep tries cost no more rounds than flat ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import durable, table

WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a conversation in one cell, bits of an id that differ in one piece of an end list, and partial tries that are merged to one.
CELL, CHUNK, FAN = 4096, 12, 32
#: A conversation takes its first turns, up to so many less one, from the one whose id is the multiple of STRIDE before its own.
STRIDE, HEAD = 20, 4
NODE = ["depth", "p", "q"]
EMPTY = hashlib.sha256(b"").hexdigest()


def running(df: DataFrame, by: str, cell: Column, order: list[str], values: dict[str, tuple[Callable, Column, Callable]]) -> DataFrame:
    """`df` with running values of each `by` in `order`: name to (aggregate, column, how two of its results are combined).

    `cell`, a column that never falls in that order (null comes first), cuts a `by` into parts that are sorted one by one; what a part begins
    with is carried over one row for each part.
    """
    rows = df.withColumn("__cell", cell)
    w = Window.partitionBy(by, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumns({n: f(c).over(w) for n, (f, c, _) in values.items()})
    before = Window.partitionBy(by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(by, "__cell").agg(*[f(c).alias(f"__{n}") for n, (f, c, _) in values.items()], F.lit(1).alias("__one"))
    carry = parts.select(F.col(by).alias("__by"), F.col("__cell").alias("__of"), F.sum("__one").over(before).alias("__one"), *[f(F.col(f"__{n}")).over(before).alias(f"__{n}") for n, (f, _, _) in values.items()])
    carry = carry.where("__one is not null")
    found = here.join(carry, (F.col(by) == F.col("__by")) & F.col("__cell").eqNullSafe(F.col("__of")), "left")
    return found.select(*df.columns, *[F.when(F.col("__one").isNull(), F.col(n)).otherwise(both(F.col(n), F.col(f"__{n}"))).alias(n) for n, (_, _, both) in values.items()])


def add(a: Column, b: Column) -> Column:
    return a + b


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), two hashes of role and text, and the text's words, for each row with a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return running(rows, "conv_id", F.floor(F.col("turn") / CELL), ["turn", "a", "b"], {"pos": (F.sum, F.lit(1), add)})


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, depth, a, b and words of conversations as the trie takes them: with the first turns of another's. Depth 0, with zeros, is there for each."""
    h = F.crc32(F.col("conv_id").cast("string")) % HEAD
    heads = turns.where((F.col("conv_id") % STRIDE == 0) & (F.col("pos") < HEAD)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "words"))).alias("head"))
    begun = turns.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % STRIDE).alias("base"), h.alias("h")).join(heads, "base", "left")
    begun = durable(begun.select("conv_id", "h", F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.greatest("h", F.lit(1)))).alias("head")))
    short = begun.select("conv_id", (F.col("h") - F.coalesce(F.size("head"), F.lit(0))).alias("less")).where("less > 0 and h > 0")
    own = turns.where(F.col("pos") > h).join(short, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("depth"), "a", "b", "words")
    taken = begun.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.a", "t.b", "t.words")
    none = F.lit(0).cast("long")
    return own.unionAll(taken).unionAll(begun.select("conv_id", none, none, none, none))


def paths(turns: DataFrame) -> DataFrame:
    """Every turn of `turns` (conv_id, depth, a, b, words) with its node (depth, p, q), the parent's p and q, its words and those `upto` it."""
    tag = lambda seed: F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "a", "b")).otherwise(F.lit(0).cast("long"))
    rows = turns.select("conv_id", "depth", tag(2).alias("tp"), tag(3).alias("tq"), "words")
    found = running(rows, "conv_id", F.floor(F.col("depth") / CELL), ["depth"], {"p": (F.bit_xor, F.col("tp"), xor), "q": (F.bit_xor, F.col("tq"), xor), "upto": (F.sum, F.col("words"), add)})
    return found.select("conv_id", *NODE, xor(F.col("p"), F.col("tp")).alias("parent_p"), xor(F.col("q"), F.col("tq")).alias("parent_q"), "words", "upto")


def merged(rows: DataFrame, parts: int, values: dict[str, tuple[Callable, str]]) -> DataFrame:
    """One row for each node of `rows`: partial tries of the partitions, merged FAN to one until one is left. `values`: name to aggregate and column."""
    found, columns = rows.withColumn("__part", F.spark_partition_id()), {n: (f, c) for n, (f, c) in values.items()}
    while True:
        parts = -(-parts // FAN)
        found = found.groupBy(*NODE, F.floor(F.col("__part") / FAN).cast("int").alias("__part")).agg(*[f(c).alias(n) for n, (f, c) in columns.items()])
        columns = {n: (f, n) for n, (f, _) in columns.items()}
        if parts <= 1:
            return found.drop("__part")


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces of end lists (depth, p, q, ids) in order: a node and the SHA-256 of its ids, in decimal and with commas. Only one piece is held."""
    node, state, done = None, None, []

    def out() -> pa.RecordBatch:
        made = [pa.array(list(x), type=t) for x, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        done.clear()
        return pa.RecordBatch.from_arrays(made, names=[*NODE, "ends_sha256"])

    for batch in batches:
        for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
            if own != node:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(map(str, ids)).encode())
        if done:
            yield out()
    if node:
        done.append((*node, state.hexdigest()))
        yield out()


def end_digests(ends: DataFrame) -> DataFrame:
    """ends_sha256 of each node of `ends` (conv_id and node). A list is combined in pieces; as SHA-256 runs in order, those of one node pass through one task, piece by piece."""
    ends.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    pieces = ends.groupBy(*NODE, F.shiftright("conv_id", CHUNK).alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids").mapInArrow(digests, "depth long, p long, q long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """A row for each node of the trie of `turns` (conv_id, depth, a, b, words; a row of depth 0 for each conversation): see prefix_trie."""
    rows = table(paths(turns), "paths")
    parts = rows.rdd.getNumPartitions()
    tries = merged(rows, parts, {"n_convs": (F.count, "conv_id"), "least": (F.min, "conv_id"), "parent_p": (F.min, "parent_p"), "parent_q": (F.min, "parent_q"), "words": (F.min, "words")})
    nodes = table(tries, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_p").alias("p"), F.col("parent_q").alias("q")).agg(F.count("*").alias("n_children"))
    nodes = table(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    whole = rows.groupBy("conv_id").agg(F.max(F.struct(*NODE, "upto")).alias("end"))
    charged = nodes.groupBy(F.col("least").alias("conv_id")).agg(F.count("*").alias("n"), F.sum("words").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    none = F.lit(0).cast("long")
    whole = durable(whole.join(charged, "conv_id", "left").select("conv_id", "end.*", (F.col("depth") - F.coalesce("n", none)).alias("shared"), (F.col("upto") - F.coalesce("own", none)).alias("shared_words"), F.coalesce("leaf", none).alias("leaf")).drop("upto"))
    saved = F.when(F.col("depth") <= F.col("shared"), F.col("shared_words") - F.col("upto") + F.col("words")).otherwise(none)
    added = rows.select("conv_id", *NODE, "words", "upto").join(whole.select("conv_id", "shared", "shared_words", "leaf"), "conv_id").select(*NODE, saved.alias("saved_tokens"), F.col("leaf").alias("n_leaves"))
    sums = merged(added, parts, {"n_leaves": (F.sum, "n_leaves"), "saved_tokens": (F.sum, "saved_tokens")})
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("parent_p"), F.col("q").alias("parent_q"), F.col("least").alias("parent_conv_id"))
    with_parents = nodes.join(parents, ["depth", "parent_p", "parent_q"], "left")
    out = with_parents.join(sums, NODE).join(end_digests(whole.select("conv_id", *NODE)), NODE, "left")
    return out.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 for each node of the trie of rebuilt conversations.

    Turns are ordered by `turn`, null first, ties by a hash of role and text; equal rows are turns of their own. Null roles and texts are empty. Rows without
    conv_id are left out. A conversation whose turns all lie in its head and whose base is absent has no turn: it is a member of the root and ends there.
    Remainders of negative ids have their sign, as in SQL. Other columns are left out; an empty table gives an empty result, without a root.
    """
    return trie(rebuilt(table(turns_of(conversations), "turns")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
