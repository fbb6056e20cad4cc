"""Near-duplicates by SimHash: Burkhard-Keller trees over shards of fingerprints.

Fingerprints are split by the pigeonhole principle: of m blocks of bits, two fingerprints with at most 3 bits apart
share m - 3 whole blocks. Fingerprints with the same values in the same m - 3 blocks form a shard. Every shard gets
a tree whose children are keyed by their Hamming distance to the parent; a search from a node at distance d follows
only edges from d - 3 to d + 3. A broadcast of all trees would grow with the corpus, so the fingerprints go to the
trees of their shards instead. A shard of more than SHARD fingerprints is dealt anew by more blocks, and at last by
pairs of parts, so no task holds more than a bounded shard and no link is lost.

Out of a shard come the links that join its connected fingerprints, fewer than it has fingerprints, never all pairs.

`one_of_each_group` goes on from the classes so found. The documents that stay are sketched by the least hashes of their five-word
shingles in 256 orders; documents that agree in all least hashes of one of 32 bands of orders make clusters. In a cluster sketches are
compared, and of what looks similar as many links as connect it are kept if the Jaccard similarity, computed exactly, is SIMILAR or more: in two rounds, a document's
most similar ones first, and then those that the links found so far do not connect with it, so groups of copies cost a few links for each.
A pair of a similarity of 0.8 shares a band with a probability of 0.997, and has a sketch that says SKETCHED at least with one of 0.996.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import BATCH_ROWS, documents, durable, map_texts, slices, table
from tidewright.llm.components import components

RADIUS = 3
#: Words in a shingle and similarity of a link.
SHINGLE, SIMILAR = 5, 0.8
#: Words of 64 bits in a sketch, and the similarity by a sketch (its standard deviation is 0.04 there) from which it is computed exactly.
SKETCH, SKETCHED = 4, 0.7
#: How many of the documents before it that look most similar one is compared with in the first round; in the second with all others that aren't connected with it by then.
TRIED, ALL = 4, 1 << 40
#: Bands, each of so many orders.
BANDS = 32
ORDERS = np.random.default_rng(42).integers(0, 1 << 31, (2, 64 * SKETCH), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Fingerprints that one tree may hold, and rows that a task gathers before it builds the trees of whole shards.
SHARD, GATHER = 20_000, 100_000
#: Pairs of fingerprint and tree node that one step of a search may hold.
FRONTIER = 4_000_000
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """SimHash of the shingles of `size` words (A-Z lowered, ASCII white space between words); 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else iter([b" ".join(words)])
    n, ones, digest = max(1, len(words) - size + 1), np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for start in range(0, n, CHUNK):
        h = np.fromiter((digest(s, seed) for s in islice(shingles, CHUNK)), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def shingle_hashes(text: str | None) -> np.ndarray:
    """32-bit hashes of the different shingles of SHINGLE words, sorted; fewer words are one shingle, no words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    shingles = set(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))) or ({b" ".join(words)} if words else set())
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(x) for x in shingles), dtype=np.uint32, count=len(shingles)).view(np.int32))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """Of a set of hashes the least in each of 64 * SKETCH orders; two sets agree in a share of them that is their similarity."""
    a, b = ORDERS
    least, h = np.full(64 * SKETCH, 0xFFFFFFFF, dtype=np.uint32), hashes.view(np.uint32) * np.uint32(0x9E3779B1)
    for start in range(0, len(h), 256):
        least = np.minimum(least, ((h[start : start + 256, None] ^ b) * a).min(axis=0))
    return least


def sketch(least: np.ndarray) -> np.ndarray:
    """A bit of each least hash; two sets agree in (1 + similarity) / 2 of them."""
    return np.packbits(np.bitwise_count(least * np.uint32(0x85EBCA6B)) & 1, bitorder="little").view("<i8")


def bands(least: np.ndarray) -> list[int]:
    """A key for each band of least hashes."""
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, -1))]


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row."""

    def make():
        return lambda texts: [np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)]

    return map_texts(docs, make, [("fp", "long")], text)


# -- trees ----------------------------------------------------------------------------------------------------------


def build(shard: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree for each run of equal `shard`: the root of each point, and the edges as sorted keys 65 * parent + distance with their children."""
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    root = np.repeat(first, np.diff(np.r_[first, len(shard)]))
    at, active = root.copy(), np.flatnonzero(root != np.arange(len(fp)))
    keys, children = [], []
    while len(active):
        key = at[active] * 65 + np.bitwise_count(fp[active] ^ fp[at[active]]).astype(np.int64)
        new, index, inverse = np.unique(key, return_index=True, return_inverse=True)
        child = active[index]
        keys.append(new)
        children.append(child)
        at[active] = child[inverse]
        active = active[at[active] != active]
    if not keys:
        return root, np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key, kind="stable")
    return root, key[order], child[order]


def search(fp: np.ndarray, query: np.ndarray, start: np.ndarray, key: np.ndarray, child: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) at most `radius` apart, level by level; only edges within the radius are followed."""
    node = start
    while len(query):
        d = np.bitwise_count(fp[query] ^ fp[node]).astype(np.int64)
        hit = d <= radius
        yield query[hit], node[hit]
        low = np.searchsorted(key, node * 65 + np.maximum(d - radius, 0))
        n = np.searchsorted(key, node * 65 + np.minimum(d + radius, 64), side="right") - low
        total = np.cumsum(n)
        into = np.arange(total[-1] if len(total) else 0) + np.repeat(low - (total - n), n)
        query, node = np.repeat(query, n), child[into]


def link(shard: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each point the first point of its own shard that links reach. `shard` is sorted; points of a shard differ."""
    root, key, child = build(shard, fp)
    parent = np.arange(len(fp))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = np.bincount(root, minlength=len(fp))[root]
    start = 0
    while start < len(fp):
        end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start : start + 65536]), FRONTIER)))
        query = np.arange(start, min(end, len(fp)))
        for q, n in search(fp, query, root[query], key, child, radius):
            while len(q):  # labels of hits that still differ are joined
                a, b = parent[q], parent[n]
                apart = a != b
                q, n = q[apart], n[apart]
                for x, y in np.unique(np.stack([a[apart], b[apart]], axis=1), axis=0).tolist():
                    x, y = find(x), find(y)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                while not np.array_equal(up := parent[parent], parent):
                    parent[:] = up
        start = end
    return parent


def whole_shards(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...] = ("fp",)) -> Iterator[list[np.ndarray]]:
    """Shards of two rows at least, whole and some at a time, from rows (shard and `columns`, all longs) that come sorted by shard."""
    held: list[list[np.ndarray]] = []

    def whole(last: bool) -> Iterator[list[np.ndarray]]:
        joined = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        cut = len(joined[0]) if last else int(np.searchsorted(joined[0], joined[0][-1]))
        if cut < len(joined[0]):
            held.append([x[cut:] for x in joined])
        shard = joined[0][:cut]
        if len(shard):
            alone = np.r_[True, shard[1:] != shard[:-1]] & np.r_[shard[1:] != shard[:-1], True]
            if not alone.all():
                yield [x[:cut][~alone] for x in joined]

    for b in batches:
        if b.num_rows:
            held.append([b.column(c).to_numpy() for c in ("shard", *columns)])
        if sum(len(x[0]) for x in held) >= GATHER:
            yield from whole(False)
    if held:
        yield from whole(True)


def linked(batches: Iterator[pa.RecordBatch], radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that connect the fingerprints of each shard."""
    for shard, fp in whole_shards(batches):
        to = link(shard, fp.view(np.uint64), radius)
        joined = np.flatnonzero(to != np.arange(len(fp)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[to[joined]]), pa.array(fp[joined])], names=["a", "b"])


def matches(sketches: np.ndarray, part: np.ndarray, first: int, last: int) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of places that are similar by their sketches and in different parts: of each place those before it that rank from `first` to `last` by likeness. And whether any rank lower."""
    bits, out, more = 64 * SKETCH, [], False
    for q in range(1, len(sketches)):
        agree = bits - np.bitwise_count(sketches[:q] ^ sketches[q]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(agree >= bits * (1 + SKETCHED) / 2)
        if len(near) > first:
            near = near[np.argsort(-agree[near], kind="stable")]
            apart = part[near] != part[q]
            out += [(int(i), q) for i in near[first:last][apart[first:last]]]
            more = more or bool(apart[last:].any())
    return out, more


def matched(batches: Iterator[pa.RecordBatch], first: int, last: int) -> Iterator[pa.RecordBatch]:
    """Links (shard, a, b) between nodes of rows (shard, node, part, s0, s1, ...) that come sorted by shard; one without nodes for a shard of which more are to be tried."""
    for shard, node, part, *sketches in whole_shards(batches, ("node", "part", *(f"s{i}" for i in range(SKETCH)))):
        sketches, start = np.stack(sketches, axis=1).view(np.uint64), np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        found: list[tuple] = []
        for a, b in zip(start, np.r_[start[1:], len(shard)]):
            pairs, more = matches(sketches[a:b], part[a:b], first, last)
            found += [(int(shard[a]), int(node[a + i]), int(node[a + j])) for i, j in pairs]
            found += [(int(shard[a]), None, None)] if more else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), type=pa.int64()) for x in zip(*found)], names=["shard", "a", "b"])


def connected(batches: Iterator[pa.RecordBatch], tree: bool) -> Iterator[pa.RecordBatch]:
    """Of links (shard, a, b) that come sorted by shard, with `tree` those that connect what is connected in a shard, fewer than it has nodes; otherwise (shard, node, part) of these nodes."""
    now, parent = None, {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def parts() -> Iterator[pa.RecordBatch]:
        if parent and not tree:
            rows = [(now, x, find(x)) for x in list(parent)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), type=pa.int64()) for x in zip(*rows)], names=["shard", "node", "part"])

    for batch in batches:
        kept = []
        for i, (shard, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "a", "b")))):
            if shard != now:
                yield from parts()
                now, parent = shard, {}
            x, y = find(a), find(b)
            if x != y:
                parent[x] = y
                kept.append(i)
        if tree:
            yield batch.take(pa.array(kept, type=pa.int64())).select(["a", "b"])
    yield from parts()


# -- shards ---------------------------------------------------------------------------------------------------------


def shard_keys(fp: Column, blocks: int, radius: int, *within: Column) -> Column:
    """An array with a key for each choice of `blocks` - `radius` blocks; equal in one place at least for links."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    value = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    chosen = combinations(range(blocks), blocks - radius)
    return F.array(*[F.xxhash64(*within, F.lit(i), *[value[b] for b in c]) for i, c in enumerate(chosen)])


def sharded(nodes: DataFrame, n: int, limit: int = SHARD, radius: int = RADIUS) -> DataFrame:
    """(shard, fp) with shards of at most `limit` rows, or twice that for pairs of parts. The more rows, the more bits that a shard shares."""
    bits = 16 if n <= 1 << 22 else 25 if n <= 1 << 32 else 32
    blocks = next(m for m in range(radius + 1, 64) if 64 * (m - radius) // m >= bits)
    rows = nodes.select(F.explode(shard_keys(F.col("fp"), blocks, radius)).alias("shard"), "fp")
    done = []
    for blocks in (radius + 3, radius + 5, None):
        full = durable(rows.groupBy("shard").count().where(F.col("count") > limit))
        if full.isEmpty():
            break
        done.append(rows.join(full, "shard", "left_anti"))
        hot = rows.join(full, "shard")
        if blocks:
            rows = durable(hot.select(F.explode(shard_keys(F.col("fp"), blocks, radius, F.col("shard"))).alias("shard"), "fp").distinct())
        else:
            parts = F.ceil(F.col("count") / limit).cast("int")
            own = hot.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int"))
            other = own.select("shard", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
            rows = other.select(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "fp")
    for more in done:
        rows = rows.unionByName(more)
    return rows


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all of `nodes` (distinct fp) within `radius` bits; never all pairs of a dense group."""
    rows = sharded(nodes, nodes.count(), SHARD, radius).repartition("shard").sortWithinPartitions("shard")
    return rows.mapInArrow(partial(linked, radius=radius), "a long, b long")


def dealt(members: DataFrame, limit: int = SHARD) -> DataFrame:
    """Rows of `members` (cluster, node, bands, ...) with their shard: the cluster, or if it has more than `limit` rows its bands, and of
    bands with more rows than that pairs of parts. Rows of a cluster that share a band meet in one shard at least."""
    of = lambda df, key: durable(df.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > limit))
    large = of(members, "cluster")
    small = members.join(large, "cluster", "left_anti").withColumn("shard", F.col("cluster")).drop("bands")
    if large.isEmpty():
        return small
    keyed = durable(members.join(large, "cluster").drop("__n").withColumn("shard", F.explode("bands")).drop("bands"))
    full = of(keyed, "shard")
    own = keyed.join(full, "shard").withColumn("__parts", F.ceil(F.col("__n") / limit).cast("int")).withColumn("__own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("__parts")).cast("int"))
    other = own.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    parts = other.withColumn("shard", F.xxhash64("shard", F.least("__own", "__other"), F.greatest("__own", "__other")))
    names = small.columns
    return small.unionByName(keyed.join(full, "shard", "left_anti").select(names)).unionByName(parts.select(names))


def band_links(sketched: DataFrame) -> DataFrame:
    """Links (a, b) that connect the nodes of `sketched` (node, bands) that share a band: each with the least of the band."""
    keyed = sketched.select(F.explode("bands").alias("band"), "node")
    groups = durable(keyed.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a"))
    return keyed.join(groups, "band").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def similar(docs: DataFrame, text: str = "text", limit: int = SHARD) -> DataFrame:
    """Links (a, b) between rows of `docs` (node, a long and unlike in each row, and text) whose five-word shingles have a Jaccard
    similarity of SIMILAR at least, as many as connect such rows; a few that bands or a sketch misjudge are missed.

    A null, empty or blank text has no shingles, and such rows are all alike; a text of fewer words is one shingle. Of a long text every shingle counts. Other
    columns are left out; an empty table gives no links.
    """
    fields = [*((f"s{i}", "long") for i in range(SKETCH)), ("bands", "array<long>")]

    def sketching():
        def run(texts: list) -> list:
            least = [least_hashes(shingle_hashes(t)) for t in texts]
            return [*np.array([sketch(x) for x in least]).reshape(-1, SKETCH).T, [bands(x) for x in least]]

        return run

    sketched = table(map_texts(docs, sketching, fields, text, ("node",)), "sketches")
    roots = components(band_links(sketched)).toDF("node", "cluster")
    rows = durable(dealt(durable(sketched.join(roots, "node")), limit).withColumn("part", F.col("node")))
    by_shard = lambda df, *then: df.repartition("shard").sortWithinPartitions("shard", *then)
    links, first, last = [], 0, TRIED
    while True:
        found = durable(by_shard(rows, "node").mapInArrow(partial(matched, first=first, last=last), "shard long, a long, b long"))
        more = durable(found.where("a is null").select("shard").distinct())
        links.append(durable(_verified(docs, found.where("a is not null"), text)))
        if more.isEmpty():
            break
        # only shards of which more are to be tried go on, with the parts that are connected by now
        known = reduce(DataFrame.unionAll, links).join(more, "shard", "left_semi")
        parts = by_shard(known, "a", "b").mapInArrow(partial(connected, tree=False), "shard long, node long, joined long")
        rows = rows.join(more, "shard", "left_semi").join(parts, ["shard", "node"], "left")
        rows = durable(rows.withColumn("part", F.coalesce("joined", "node")).drop("joined"))
        first, last = last, ALL
    whole = reduce(DataFrame.unionAll, links)
    return by_shard(whole, "a", "b").mapInArrow(partial(connected, tree=True), "a long, b long").distinct()


def _verified(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """The links of `found` (shard, a, b) between rows of `docs` with a similarity of SIMILAR at least, computed from all their shingles."""

    def hashing():
        return lambda texts: [[shingle_hashes(t) for t in texts]]

    ends = durable(found.select(F.col("a").alias("node")).union(found.select("b")).distinct())
    hashed = table(map_texts(docs.join(ends, "node", "left_semi"), hashing, [("hashes", "array<int>")], text, ("node",)), "shingles")
    sets = lambda x: hashed.select(F.col("node").alias(x), F.col("hashes").alias(f"{x}_hashes"))
    size = lambda x: F.size(f"{x}_hashes")
    both = F.size(F.array_intersect("a_hashes", "b_hashes"))
    alike = (both >= SIMILAR * (size("a") + size("b") - both)) | ((size("a") == 0) & (size("b") == 0))
    return found.join(sets("a"), "a").join(sets("b"), "b").where(alike).select("shard", "a", "b")


def classes(prints: DataFrame) -> DataFrame:
    """fp, its class (the root's fp) and component_id (the class's least doc_id) for each different fp of `prints` (doc_id, fp).

    The least ids of classes are written before they are joined back, so that a giant class can be split among tasks.
    """
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = durable(components(fingerprint_links(nodes.select("fp"))).withColumnRenamed("node", "fp").join(nodes, "fp"))
    least = durable(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    found = linked.join(least, "root").select("fp", "root", "component_id")
    return durable(nodes.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id")))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable by links) for every row.

    A null, empty or blank text has fingerprint zero and is linked like any other. Of a very long text every shingle counts; they are hashed
    CHUNK at a time. A row without doc_id keeps a null
    there and takes the component of its fingerprint, which is null if none of its rows has an id. Repeated rows
    stay. Other columns are left out; an empty table gives an empty result.
    """
    prints = durable(fingerprints(docs, text))
    return prints.join(classes(prints), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_class(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, that stay: one of each class of near-duplicates, that with the least doc_id.

    A row without id stays only in a class where no row has one. Of several rows with the id that stays one does: that with
    the least fingerprint, then a null text before any other, then the least hashes of text and other columns; equal rows
    are one. Null, empty and blank texts are near-duplicates of one another. An empty table gives an empty result.
    Fingerprints are computed once, and the table is written with them.
    """
    return _representatives(docs, text).select(docs.columns)


def _representatives(docs: DataFrame, text: str) -> DataFrame:
    """What one_of_each_class returns, with the fingerprint __fp, unlike in each row, and __none, __id."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text):
                found = np.array([fingerprint(t) for t in part.column(text).to_pylist()], dtype=np.uint64).view(np.int64)
                yield part.append_column("__fp", pa.array(found))

    marked = table(docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())])), "fingerprints")
    rest = F.xxhash64(F.lit(0), *[F.col(c) for c, kind in docs.dtypes if c != text and not re.search("map<|variant", kind)])
    marked = marked.withColumns({"__id": F.coalesce("doc_id", F.lit(0).cast(id_type)), "__none": F.col("doc_id").isNull(), "__said": F.col(text).isNotNull(), "__hash": F.xxhash64(text), "__rest": rest})
    keys = ["__none", "__id", "__fp", "__said", "__hash", "__rest"]
    rows = marked.select("doc_id", *keys)
    of = classes(rows.select("doc_id", F.col("__fp").alias("fp"))).select(F.col("fp").alias("__fp"), "root")
    first = durable(rows.groupBy("__fp").agg(F.min(F.struct(*keys)).alias("s"))).join(of, "__fp").groupBy("root").agg(F.min("s").alias("s")).select("s.*")
    return marked.join(durable(first), keys, "left_semi").dropDuplicates(keys)


def one_of_each_group(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, that stay: of each group of near-duplicates that with the least doc_id.

    Groups are joined by the links of one_of_each_class, whose rules on nulls, ties and repeated rows hold, and by those of `similar`
    between the rows that these leave: a five-word Jaccard similarity of SIMILAR or more. An empty table gives an empty result.
    """
    left = table(_representatives(docs, text), "representatives")
    links = similar(left.select(F.col("__fp").alias("node"), text), text)
    roots = durable(components(links))
    keys = left.select("__none", "__id", "__fp").join(roots, F.col("__fp") == F.col("node"))
    stays = durable(keys.groupBy("root").agg(F.min(F.struct("__none", "__id", "__fp")).alias("s"))).select(F.col("s.__fp").alias("node"))
    goes = durable(roots.join(stays, "node", "left_anti").select(F.col("node").alias("__fp")))
    return left.join(goes, "__fp", "left_anti").select(docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
