"""Near-duplicate groups by SimHash fingerprints and vantage-point trees.

A top tree, fitted on a bounded sample, deals the distinct fingerprints out to
shards by their Hamming distance to vantage points.  A fingerprint has one
home shard and also visits the later shards that the triangle bound can't rule
out, so each close pair meets once.  In a shard a local tree answers all
queries in batches and reports a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from math import acos, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambulo.llm.common import byte_rows, cut_lineage, mix64, parts_of, written
from ambulo.llm.components import connected_components

SEED = 42
#: Fingerprints in the sample that fits the top tree, for each shard and in all.
SAMPLE_PER_SHARD, SAMPLE_MOST = 64, 1 << 17
#: Pairs whose sketches are compared at a time.
ACCEPT_AT_ONCE = 1 << 15
#: Words of 64 bits in the sketch that verifies links.
SKETCH_WORDS = 8
#: Orders of the shingles whose smallest hash brings documents together.
LEAST = 4


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` lower-cased words; of all words if there are fewer; nothing without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], "<u8")
    starts = np.concatenate(([0], ends[:-width] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bytes whose bits over half the rows of hashes (n x 64-bit numbers) set; zero without rows."""
    ones = np.zeros(hashes.shape[1] * 64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[i : i + 4096]).view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(ones * 2 > len(hashes), bitorder="little")


def fingerprint(text: bytes, width: int = 4) -> int:
    """64-bit SimHash of a UTF-8 text: a bit is set if over half the shingle hashes set it."""
    return int(majority(shingle_hashes(text, width)[:, None]).view("<u8")[0])


def sketch(text: bytes, width: int) -> tuple[int, bytes, list[int]]:
    """Number of shingles; SimHash of SKETCH_WORDS x 64 bits, of which the first 64 are the fingerprint; LEAST smallest hashes.

    The smallest hashes are those of independent orders of the shingles: two
    sets share one with a probability of their similarity.
    """
    hashes = shingle_hashes(text, width)
    more = mix64(hashes[:, None] + np.arange(1, SKETCH_WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    least = more[:, :LEAST].min(axis=0) if len(hashes) else np.zeros(LEAST, np.uint64)
    return len(hashes), majority(np.concatenate([hashes[:, None], more], axis=1)).tobytes(), least.view(np.int64).tolist()


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id long, fp long) for each row of docs; null text counts as empty: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x, width) for x in byte_rows(batch, 1)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(prints)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def distances(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def choose_vantage(points: np.ndarray, radius: int) -> tuple[np.uint64, int]:
    """Of eight spread points the one whose median sphere has the fewest points near it."""
    best = None
    for p in points[:: max(1, len(points) // 8)][:8]:
        d = distances(points, p)
        mid = int(np.median(d))
        if (d <= mid).all() and (d < mid).any():
            mid -= 1
        score = (int(((d > mid - radius) & (d <= mid + radius)).sum()), abs(2 * int((d <= mid).sum()) - len(d)))
        if best is None or score < best[0]:
            best = (score, p, mid)
    return best[1], best[2]


def top_tree(sample: np.ndarray, levels: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and spheres of a complete binary tree, in heap order."""
    n = (1 << levels) - 1
    vantage, sphere, parts = np.zeros(n, np.uint64), np.zeros(n, np.int16), {0: sample}
    for node in range(n):
        points = parts.pop(node)
        if len(points):
            vantage[node], sphere[node] = choose_vantage(points, radius)
        inside = distances(points, vantage[node]) <= sphere[node]
        parts[2 * node + 1], parts[2 * node + 2] = points[inside], points[~inside]
    return vantage, sphere


def route(fps: np.ndarray, vantage: np.ndarray, sphere: np.ndarray, radius: int, at_home: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, shard, whether it is the home) of each fingerprint's home and of the later shards it visits; of all shards in reach if none is its home."""
    index, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.full(len(fps), at_home)
    levels = (len(vantage) + 1).bit_length() - 1
    for _ in range(levels):
        d, s = distances(fps[index], vantage[node]), sphere[node]
        inside = d <= s
        # A row that isn't at home goes everywhere in reach; one at home keeps
        # its own side as home and sends a visitor to the later side only.
        left = np.where(home, inside, d - radius <= s)
        right = np.where(home, ~inside, d + radius > s)
        visit = home & inside & (d + radius > s)
        index = np.concatenate([index[left], index[right], index[visit]])
        home = np.concatenate([home[left], home[right], np.zeros(int(visit.sum()), bool)])
        node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2, 2 * node[visit] + 2])
    return index, node - ((1 << levels) - 1), home


class Forest:
    """Union-find over array indices; whole arrays of links at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        p = self.parent[x]
        while True:
            q = self.parent[p]
            if (p == q).all():
                self.parent[x] = p
                return p
            p = q

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.find(a), self.find(b)
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def link_in_shard(
    fps: np.ndarray, members: np.ndarray, queries: np.ndarray, radius: int, leaf: int = 128, chunk: int = 8192, accept: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
) -> Forest:
    """Unite each query with all members within radius, by one walk of a vantage-point tree.

    members and queries are indices into fps.  Where a whole subtree lies
    within radius of a query it is united at once.  accept, if given, decides
    about each pair of indices that isn't united yet.
    """
    forest = Forest(len(fps))
    stack = [(members, queries)]
    while stack:
        points, asks = stack.pop()
        if not len(points) or not len(asks):
            continue
        if len(points) > leaf:
            p, sphere = choose_vantage(fps[points], radius)
            d = distances(fps[points], p)
            to = distances(fps[asks], p)
            inside = d <= sphere
            if not accept and int(d.max()) * 2 <= radius:  # all members are within radius of each other and of the vantage point
                whole = to + int(d.max()) <= radius
                if whole.any():
                    forest.unite(points, np.full(len(points), points[0]))
                    forest.unite(asks[whole], np.full(int(whole.sum()), points[0]))
                    asks, to = asks[~whole], to[~whole]
            if not inside.all():
                stack.append((points[inside], asks[to - radius <= sphere]))
                stack.append((points[~inside], asks[to + radius > sphere]))
                continue
        for i in range(0, len(asks), chunk):
            for j in range(0, len(points), 1024):
                some, near = asks[i : i + chunk], points[j : j + 1024]
                q, m = np.nonzero(distances(fps[some][:, None], fps[near][None, :]) <= radius)
                q, m = some[q], near[m]
                for k in range(0, len(q), ACCEPT_AT_ONCE if accept else max(1, len(q))):
                    a, b = (q, m) if not accept else (q[k : k + ACCEPT_AT_ONCE], m[k : k + ACCEPT_AT_ONCE])
                    if accept:
                        apart = forest.find(a) != forest.find(b)
                        a, b = a[apart], b[apart]
                        good = accept(a, b)
                        a, b = a[good], b[good]
                    forest.unite(a, b)
    return forest


def fingerprint_links(prints: DataFrame, radius: int = 4, shard_size: int = 1 << 15, block: int = 1 << 17) -> DataFrame:
    """Spanning links (a, b) of all pairs of distinct fingerprints within radius.

    prints: (fp long), distinct.  A shard with over ``block`` queries is dealt
    out as blocks of queries, each with all the shard's members (8 bytes each).
    """
    spark = prints.sparkSession
    n = prints.count()
    levels = max(0, int(np.ceil(np.log2(max(1, n / shard_size)))))
    most = min(SAMPLE_MOST, SAMPLE_PER_SHARD << levels)
    rows = prints.orderBy(F.xxhash64("fp"), "fp").limit(most).collect()
    vantage, sphere = top_tree(np.array([r[0] for r in rows], np.int64).view(np.uint64), levels, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            index, shard, home = route(fps.view(np.uint64), vantage, sphere, radius)
            yield pa.record_batch([pa.array(shard), pa.array(fps[index]), pa.array(home)], ["shard", "fp", "home"])

    dealt = cut_lineage(prints.mapInArrow(deal, "shard long, fp long, home boolean"))
    blocks = dealt.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = dealt.join(blocks, "shard")
    asks = dealt.select("shard", F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("part"), "fp", F.lit(False).alias("member"))
    held = dealt.where("home").select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "fp", F.lit(True).alias("member"))

    def search(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        member = table.column("member").to_numpy()
        fps, at = np.unique(fp, return_inverse=True)
        forest = link_in_shard(fps, np.unique(at[member]), np.unique(at[~member]), radius)
        root = forest.find(np.arange(len(fps)))
        child = np.flatnonzero(root != np.arange(len(fps)))
        return pa.table({"a": fps[child].view(np.int64), "b": fps[root[child]].view(np.int64)})

    return asks.unionAll(held).groupBy("shard", "part").applyInArrow(search, "a long, b long")


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id long, text_hash long, size int, sketch binary, least array<long>) for each row of docs; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            sizes, prints, least = zip(*(sketch(x, width) for x in byte_rows(batch, 2)), strict=True)
            columns = [pa.array(sizes, pa.int32()), pa.array(prints, pa.binary()), pa.array(least, pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], ["doc_id", "text_hash", "size", "sketch", "least"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, size int, sketch binary, least array<long>")


def sketch_links(nodes: DataFrame, similarity: float, radius: int, shard_size: int = 1 << 15) -> DataFrame:
    """Spanning links (a, b) of the pairs of nodes that share a smallest hash and whose sketches agree enough.

    nodes: (node long, size int, sketch binary, least array<long>), distinct.
    In a group of nodes with one smallest hash a pair is compared if its
    fingerprints are within radius and its sizes within the factor that
    ``similarity`` allows; its sketches decide.  A group over shard_size is
    dealt out by a top tree, as fingerprint_links does.
    """
    keyed = nodes.select("node", F.posexplode("least").alias("order", "hash")).select("node", F.xxhash64("order", "hash").alias("group"))
    groups = cut_lineage(keyed.groupBy("group").count().where("count > 1"))
    most = groups.agg(F.max("count")).first()[0] or 0
    levels = max(0, int(np.ceil(np.log2(max(1, most / shard_size)))))
    vantage = sphere = None
    if levels:
        size = min(SAMPLE_MOST, SAMPLE_PER_SHARD << levels)
        rows = nodes.orderBy(F.xxhash64("node"), "node").limit(size).select(F.substring("sketch", 1, 8)).collect()
        vantage, sphere = top_tree(np.array([np.frombuffer(r[0], "<u8")[0] for r in rows], np.uint64), levels, radius)
    met = written(keyed.join(groups, "group").join(nodes.drop("least"), "node").select("group", "count", "node", "size", "sketch"))
    parts = met.where(F.col("count") <= shard_size).select("group", F.lit(0).cast("long").alias("shard"), F.lit(0).alias("part"), "node", "size", "sketch", F.lit(True).alias("member"), F.lit(True).alias("asks"))
    if levels:
        parts = parts.unionByName(_dealt(met.where(F.col("count") > shard_size), vantage, sphere, radius, shard_size))

    # bits that differ at this similarity of sets of one size, and one and a half standard deviations more
    share = acos(2 * similarity / (1 + similarity)) / pi
    bits = SKETCH_WORDS * 64
    limit = int(bits * share + 1.5 * (bits * share * (1 - share)) ** 0.5)

    def search(node: np.ndarray, size: np.ndarray, wide: np.ndarray, member: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, first, at = np.unique(node, return_index=True, return_inverse=True)
        size, wide = size[first].astype(np.int64), wide[first]

        def accept(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            near = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])
            near[near] = np.bitwise_count(wide[a[near]] ^ wide[b[near]]).sum(axis=1) <= limit
            return near

        forest = link_in_shard(np.ascontiguousarray(wide[:, 0]), np.unique(at[member]), np.unique(at[asks]), radius, accept=accept)
        root = forest.find(np.arange(len(node)))
        child = np.flatnonzero(root != np.arange(len(node)))
        return node[child], node[root[child]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group, shard and part; what is held is one of these and the batch."""
        held, key = [], None

        def links(tables: list[pa.RecordBatch]) -> list[tuple[np.ndarray, np.ndarray]]:
            t = pa.Table.from_batches(tables)
            wide = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u8").reshape(-1, SKETCH_WORDS)
            columns = [t.column(n).to_numpy() for n in ("group", "shard", "part", "node", "size", "member", "asks")]
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
            return [search(columns[3][a:b], columns[4][a:b], wide[a:b], columns[5][a:b], columns[6][a:b]) for a, b in zip([0, *edges], [*edges, t.num_rows], strict=True)]

        def batch_of(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (list(zip(*found, strict=True)) or ((), ())))
            return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            last = tuple(k[-1] for k in keys)
            tail = int(np.argmax(np.all([k == v for k, v in zip(keys, last, strict=True)], axis=0)))
            # everything before the last key of the batch is complete
            if key != last or tail:
                done = [*held, batch.slice(0, tail)] if tail else held
                if done:
                    yield batch_of(links(done))
                held = []
            held.append(batch.slice(tail))
            key = last
        if held:
            yield batch_of(links(held))

    keys = ["group", "shard", "part"]
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _dealt(met: DataFrame, vantage: np.ndarray, sphere: np.ndarray, radius: int, shard_size: int) -> DataFrame:
    """Members and queries of the shards of large groups, dealt out by the levels of the top tree that a group's size needs."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, 4096):
            fps = np.array([np.frombuffer(x, "<u8", 1)[0] for x in batch.column(4).to_pylist()], np.uint64)
            depth = np.ceil(np.log2(batch.column(1).to_numpy() / shard_size)).astype(int)
            for levels in np.unique(depth).tolist():
                rows, n = np.flatnonzero(depth == levels), (1 << levels) - 1
                index, shard, home = route(fps[rows], vantage[:n], sphere[:n], radius)
                taken = batch.take(pa.array(rows[index]))
                yield pa.record_batch([taken.column(0), pa.array(shard), pa.array(home), *taken.columns[2:]], ["group", "shard", "home", "node", "size", "sketch"])

    dealt = written(met.mapInArrow(deal, "group long, shard long, home boolean, node long, size int, sketch binary"))
    blocks = cut_lineage(dealt.groupBy("group", "shard").agg(F.ceil(F.count("*") / shard_size).cast("int").alias("blocks")))
    dealt = dealt.join(blocks, ["group", "shard"])
    own = ["node", "size", "sketch"]
    asks = dealt.select("group", "shard", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("part"), *own, F.lit(False).alias("member"), F.lit(True).alias("asks"))
    held = dealt.where("home").select("group", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), *own, F.lit(True).alias("member"), F.lit(False).alias("asks"))
    return asks.unionByName(held)


def similar_documents(docs: DataFrame, similarity: float = 0.8, width: int = 5, radius: int = 16) -> DataFrame:
    """Groups of documents whose shingles of ``width`` words have a similarity of about ``similarity`` or more.

    Returns (doc_id long, text_hash long, first_id long, first_hash long) for
    each row of docs (doc_id, text, ...): the smallest doc_id of its group and
    the smallest xxhash64 of that id's texts in the group.  Null doc_ids come
    last.

    At such a similarity fingerprints differ in ten bits on average, a radius
    at which the triangle bound of a vantage-point tree rules nothing out, so
    trees over all documents would compare all pairs.  Documents that share
    one of LEAST smallest shingle hashes are searched instead (a pair of
    similarity 0.8 shares one in 99.8 % of cases).  A link needs fingerprints
    within radius and SimHashes of SKETCH_WORDS x 64 bits that differ by no
    more than sets of that similarity do on average, plus one and a half
    standard deviations; a group is what links reach.

    Null and empty texts and those without words are one group.  Equal texts
    are in one group, repeated rows are kept.  An empty table gives an empty
    result.  Other columns are ignored whatever their names.
    """
    rows = written(sketches(docs, width).withColumn("node", F.xxhash64("size", "sketch", "least")))
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("smallest")
    nodes = written(rows.groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("least").alias("least"), smallest))
    roots = connected_components(sketch_links(nodes.drop("smallest"), similarity, radius))
    placed = nodes.select("node", "smallest").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = placed.groupBy("root").agg(F.min("smallest").alias("smallest"))
    placed = placed.select("node", "root").join(first, "root").select("node", F.col("smallest.doc_id").alias("first_id"), F.col("smallest.text_hash").alias("first_hash"))
    return rows.select("doc_id", "text_hash", "node").join(placed, "node").select("doc_id", "text_hash", "first_id", "first_hash")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """Fingerprint and near-duplicate component of every row of docs (doc_id, text, ...).

    Returns (doc_id long, fp long, component_id long): component_id is the
    smallest doc_id reachable over links of at most ``radius`` bits, itself
    included.  Null or empty text, or one without words, has fingerprint 0,
    which links like any other.  Repeated rows are kept, each with its
    component.  A null doc_id is kept and never the smallest unless alone
    (then component_id is null).  An empty table gives an empty result.  Other
    columns are ignored whatever their names.
    """
    prints = cut_lineage(fingerprints(docs, width))
    first = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(fingerprint_links(first.select("fp"), radius))
    placed = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(placed.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
