"""Approximate nearest neighbours: an NN-descent graph from Spark joins, greedy search on it.

Vectors that are equal stand as one node. A round of the descent gathers at every node its neighbours and some of the
nodes that have it as neighbour, with their vectors, and offers each of them the closest of the others that are nearer
than what it has; every node keeps the nearest it was offered. The first offers come from blocks of vectors that lie on
the same side of planes through the medians of random directions. Rounds end when few edges change. Within the descent a
vector is its largest component (in double precision) and single precision shares of it, so one vector's size takes no
digits from another's; distances of the search and of the result are in double precision on the original vectors.

A query starts at its own node and at a few entry nodes and goes on expanding the nearest nodes it has seen until the
best `beam` of them are expanded, however many hops that takes.

Equal distances are told apart by a hash of the pair while the graph is built, so ties don't make hubs; a node that very
many others name is one key of the join that brings the vectors, which adaptive execution splits. Of a hub's incoming edges
only a bounded number leave each task.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, neither as queries nor as candidates, nor do rows without vec_id; every other row is a candidate of its own, rows of
equal vectors and rows that repeat a vec_id too (each such row is a query where its id asks for one); ties go to the smaller
vec_id; fewer candidates than k are all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.llm.arrow_text import U64, mix
from tidebars.llm.store import materialize, shuffle_partitions, small_batches

#: Neighbours a node keeps, nodes a search holds, entry nodes.
DEGREE, BEAM, ENTRIES = 40, 112, 16
#: The share of changed edges that ends the descent.
SETTLED = 0.1
#: Offers to each member of a group; members of a first block; rounds of first blocks.
OFFERS, BLOCK, TABLES = 10, 192, 3


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    return rows.join(F.broadcast(length), F.size("v") == F.col("d"), "left_semi")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _lists(node: np.ndarray, other: np.ndarray, d: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray]:
    """node, its others and their distances as lists, and where each node starts; rows sorted by node."""
    start = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(start, len(node)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(t))) for x, t in ((other, np.int64), (d, np.float32))]
    return pa.array(node[start].astype(np.int64)), *lists, start


def _local_join(members: DataFrame, vectors: DataFrame, groups: int, offers: int) -> DataFrame:
    """node, others, ds: for each member (node) of a group (g) the nearest of its other members that are nearer than worst,
    once per cell; vectors: node, part, top, worst."""
    cells = max(shuffle_partitions(members.sparkSession), groups // 2_000)

    def run(table: pa.Table) -> pa.Table:
        g, m = table.column("g").to_numpy(), table.column("node").to_numpy()
        order = np.lexsort((m, g))
        g, m = g[order], m[order]
        fresh = np.append(True, (g[1:] != g[:-1]) | (m[1:] != m[:-1])) if len(g) else np.zeros(0, bool)
        order, g, m = order[fresh], g[fresh], m[fresh]
        raw = table.column("part").combine_chunks()
        data = np.frombuffer(b"".join(raw.to_pylist()), np.float32).reshape(len(raw), -1)
        top, worst = table.column("top").to_numpy()[order], table.column("worst").to_numpy()[order]
        start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(g)], strict=True):
            if b - a < 2:
                continue
            x = data[order[a:b]].astype(np.float64) * top[a:b, None]
            norm = (x * x).sum(axis=1)
            d = np.maximum(norm[:, None] + norm[None, :] - 2 * (x @ x.T), 0)
            d[np.isnan(d)] = np.inf
            np.fill_diagonal(d, np.inf)
            k = min(offers, b - a - 1)
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            own = np.sqrt(np.take_along_axis(d, near, 1)).astype(np.float32)
            better = own < worst[a:b, None]
            out.append((np.repeat(m[a:b], k)[better.ravel()], m[a:b][near[better]], own[better]))
        node, other, d = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        order = np.lexsort((other, node))
        node, other, d = node[order], other[order], d[order]
        fresh = np.append(True, (node[1:] != node[:-1]) | (other[1:] != other[:-1])) if len(node) else np.zeros(0, bool)
        nodes, others, ds, _ = _lists(node[fresh], other[fresh], d[fresh])
        return pa.table({"node": nodes, "others": others, "ds": ds})

    rows = members.join(vectors, "node").withColumn("cell", F.pmod(F.xxhash64("g"), F.lit(cells)))
    return rows.select("cell", "g", "node", "part", "top", "worst").groupBy("cell").applyInArrow(run, "node long, others array<long>, ds array<float>")


def _keep_nearest(offers: DataFrame, nodes: int, degree: int) -> DataFrame:
    """node, others, ds, changed (edges that are new), worst (largest distance kept, infinite while there is room), one row
    a node; offers: node, others, ds, new."""
    cells = max(shuffle_partitions(offers.sparkSession), nodes // 5_000)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        others, ds = (table.column(c).combine_chunks() for c in ("others", "ds"))
        count = np.diff(others.offsets.to_numpy())
        node, new = (np.repeat(table.column(c).to_numpy(), count) for c in ("node", "new"))
        other, d = others.flatten().to_numpy(), ds.flatten().to_numpy()
        order = np.lexsort((new, other, node))
        node, other, d, new = node[order], other[order], d[order], new[order]
        fresh = np.append(True, (node[1:] != node[:-1]) | (other[1:] != other[:-1])) if len(node) else np.zeros(0, bool)
        node, other, d, new = node[fresh], other[fresh], d[fresh], new[fresh]
        order = np.lexsort((mix(mix(node.astype(U64)) ^ other.astype(U64)), d, node))
        node, other, d, new = node[order], other[order], d[order], new[order]
        first = np.append(True, node[1:] != node[:-1]) if len(node) else np.zeros(0, bool)
        rank = np.arange(len(node)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(node) else np.zeros(0, int)
        keep = rank < degree
        node, other, d, new = node[keep], other[keep], d[keep], new[keep]
        nodes_, others_, ds_, start = _lists(node, other, d)
        size = np.diff(np.append(start, len(node)))
        changed = np.add.reduceat(new, start) if len(node) else np.zeros(0, np.int64)
        worst = np.where(size < degree, np.inf, d[start + size - 1]) if len(node) else np.zeros(0)
        return pa.table({"node": nodes_, "others": others_, "ds": ds_, "changed": pa.array(changed.astype(np.int64)), "worst": pa.array(worst.astype(np.float32))})

    rows = offers.withColumn("cell", F.pmod(F.xxhash64("node"), F.lit(cells)))
    return rows.groupBy("cell").applyInArrow(run, "node long, others array<long>, ds array<float>, changed long, worst float")


def _edges(graph: DataFrame) -> DataFrame:
    return graph.select("node", F.explode(F.arrays_zip("others", "ds")).alias("e")).select("node", F.col("e.others").alias("other"), F.col("e.ds").alias("d"))


def build_graph(nodes: DataFrame, degree: int = DEGREE, settled: float = SETTLED, seed: int = 7) -> DataFrame:
    """node, others, ds, changed, worst of the neighbour graph; nodes: node, v (distinct vectors)."""
    n, dims = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return nodes.select("node", F.array().cast("array<long>").alias("others"), F.array().cast("array<float>").alias("ds"), F.lit(0).cast("long").alias("changed"), F.lit(0.0).cast("float").alias("worst"))
    bits = max(0, int(np.ceil(np.log2(max(1, n / BLOCK)))))
    planes = np.random.default_rng(seed).standard_normal((TABLES * bits, dims)) / np.sqrt(dims)

    def prepare(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, dims)
            top = np.abs(x).max(axis=1) if len(x) else np.zeros(0)
            part = (x / top[:, None]).astype(np.float32)
            side = x @ planes.T if bits else np.zeros((len(x), 0))
            sides = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * TABLES * bits, pa.int32()), pa.array(side.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in part], pa.binary()), pa.array(top), sides], names=["node", "part", "top", "side"])

    ready = materialize(nodes.select("node", "v").mapInArrow(prepare, "node long, part binary, top double, side array<double>"), "parts")
    vectors = ready.select("node", "part", "top")
    # a median a direction: as many numbers as there are planes
    middle = ready.agg(*[F.percentile_approx(F.get("side", F.lit(i)), 0.5, 1000).alias(f"m{i}") for i in range(TABLES * bits)]).first() if bits else ()
    codes = [sum((F.when(F.get("side", F.lit(t * bits + b)) > middle[t * bits + b], 1 << b).otherwise(0) for b in range(bits)), F.lit(0)).cast("long") * TABLES + t for t in range(TABLES)]
    coded = ready.select("node", F.explode(F.array(*codes)).alias("code"))
    # a code of many vectors is cut into blocks at random
    sizes = coded.groupBy("code").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("cuts"))
    blocks = coded.join(sizes, "code").select(F.xxhash64("code", F.pmod(F.xxhash64("node", "code"), "cuts")).alias("g"), "node")
    any_distance = F.lit(float("inf")).cast("float")
    offers = _local_join(blocks, vectors.withColumn("worst", any_distance), TABLES * n // BLOCK * 20 + 1, degree // 2).withColumn("new", F.lit(1))
    graph = materialize(_keep_nearest(offers, n, degree), "graph")
    while True:
        edges = _edges(graph)
        back = edges.select(F.col("other").alias("g"), F.col("node"), F.row_number().over(Window.partitionBy("other").orderBy(F.xxhash64("node", "other"))).alias("r")).where(F.col("r") <= degree // 2).select("g", "node")
        around = edges.select(F.col("node").alias("g"), F.col("other").alias("node")).union(back)
        known = vectors.join(graph.select("node", "worst"), "node", "left").withColumn("worst", F.coalesce("worst", any_distance))
        offers = _local_join(around, known, n, OFFERS).withColumn("new", F.lit(1))
        graph = materialize(_keep_nearest(graph.select("node", "others", "ds", F.lit(0).alias("new")).union(offers), n, degree), "graph", instead_of=graph)
        # distances only fall, so this ends
        changed, held = graph.agg(F.sum("changed"), F.sum(F.size("others"))).first()
        if (changed or 0) <= settled * (held or 0):
            return graph


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, beam: int = BEAM, entries: int = ENTRIES) -> DataFrame:
    """query, node, d of the nearest nodes found; queries: query, node (its own), qv; nodes: node, v."""
    # both directions of an edge lead on; a node's incoming edges are as bounded as its outgoing ones
    out = _edges(graph)
    incoming = out.select(F.col("other").alias("node"), F.col("node").alias("other"), F.row_number().over(Window.partitionBy("other").orderBy("d", "node")).alias("r")).where(F.col("r") <= DEGREE).drop("r")
    edges = materialize(out.select("node", "other").union(incoming).groupBy("node").agg(F.collect_set("other").alias("others")), "edges")
    order = Window.partitionBy("query").orderBy("d", "node")

    def reach(pairs: DataFrame) -> DataFrame:
        """query, node, d of pairs (query, node)."""
        return pairs.join(nodes, "node").join(queries.select("query", "qv"), "query").select("query", "node", distance(F.col("qv"), F.col("v")).alias("d"))

    doors = [r[0] for r in nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(entries).collect()]
    starts = queries.select("query", F.explode(F.array_distinct(F.concat(F.array("node"), F.array(*[F.lit(x).cast("long") for x in doors])))).alias("node"))
    seen = materialize(reach(starts).withColumn("expanded", F.lit(False)), "seen")
    # a beam only gets nearer, so nothing is left to expand in the end
    while not seen.where(~F.col("expanded")).isEmpty():
        ahead = seen.where(~F.col("expanded")).select("query", "node")
        found = ahead.join(edges, "node").select("query", F.explode("others").alias("node")).distinct()
        found = found.join(seen.select("query", "node"), ["query", "node"], "left_anti")
        both = seen.withColumn("expanded", F.lit(True)).union(reach(found).withColumn("expanded", F.lit(False)))
        seen = materialize(both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= beam).drop("r"), "seen", instead_of=seen)
    return seen.select("query", "node", "d")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found of every row that is_query (over vec_id) picks."""
    small_batches(vectors.sparkSession)
    rows = usable(vectors).withColumns({"row": F.monotonically_increasing_id(), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    rows = materialize(rows, "vectors")
    nodes = materialize(rows.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.first("v").alias("v")), "nodes")
    graph = build_graph(nodes.select("node", "v"))
    owned = rows.select("vec_id", "row", "h1", "h2").join(nodes.select("node", "h1", "h2"), ["h1", "h2"]).select("vec_id", "row", "node")
    queries = materialize(rows.where(is_query).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), "h1", "h2").join(nodes.select("node", "h1", "h2"), ["h1", "h2"]).drop("h1", "h2"), "queries")
    found = search(queries, nodes.select("node", "v"), graph)
    # of equal vectors only the first k + 1 rows can be returned
    first = owned.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id", "row"))).where(F.col("r") <= k + 1).drop("r")
    out = found.join(first, "node").where("row <> query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "vec_id", "row"))
    out = out.withColumn("rank", rank).where(F.col("rank") <= k).join(queries.select("query", "query_id"), "query")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score"))
