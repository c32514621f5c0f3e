"""Connected components by alternating large-star and small-star steps, in Spark joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.store import materialize


def _forest(batches):
    """A spanning forest of the partition's edges, every node linked to the smallest of its tree."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, find(x)) for x in parent]
    rows = [r for r in rows if r[0] != r[1]]
    for lo in range(0, len(rows), 50_000):
        own = rows[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in own], pa.int64()) for i in (0, 1)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of edges (two long columns, in any order).

    Each partition first keeps a spanning forest of its edges. A round then hangs the larger neighbours of every
    node, and after that its smaller ones, on its smallest; rounds end when the edges no longer change. Edges
    stay in tables of the shared folder from round to round.
    """
    u, v = edges.columns[:2]
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    e = materialize(e.mapInArrow(_forest, "u long, v long"), "edges")
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.union(lower.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "edges", instead_of=e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
