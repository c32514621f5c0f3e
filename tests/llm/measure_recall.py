"""Recall of op10 against brute force, with the shipped settings; run by hand: python tests/llm/measure_recall.py [folder of embeddings.parquet].

Data sets: the folder's embeddings; 50,000 Gaussian vectors in 16 dimensions, one of them times 1e9; 50,000 vectors in 500
tight clusters; 12,000 near copies of one vector (noise 2e-5) among 20,000 others.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def data_sets(folder: str | None):
    if folder:
        import pyarrow.parquet as pq

        t = pq.read_table(f"{folder}/embeddings.parquet")
        yield "embeddings", t.column("vec_id").to_numpy(), np.array(t.column("embedding").to_pylist(), np.float64)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((50_000, 16))
    x[17] *= 1e9
    yield "outlier", np.arange(len(x)), x
    x = np.repeat(rng.standard_normal((500, 32)), 100, axis=0) + 0.05 * rng.standard_normal((50_000, 32))
    yield "clusters", np.arange(len(x)), x
    x = np.concatenate([rng.standard_normal(64) + 2e-5 * rng.standard_normal((12_000, 64)), rng.standard_normal((8_000, 64)) / 4])
    yield "near copies", rng.permutation(len(x)), x


def recall(found: dict[int, list[int]], ids: np.ndarray, x: np.ndarray, k: int = 10) -> float:
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0).tolist():
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        best = ids[np.lexsort((ids, d))[:k]]
        hit += len(set(best.tolist()) & set(found.get(int(ids[q]), [])))
        total += k
    return hit / total


if __name__ == "__main__":
    from pyspark.sql import functions as F

    from tidebars.llm import neighbours
    from tidebars.session import build_session

    spark = build_session("recall")
    for name, ids, x in data_sets(sys.argv[1] if len(sys.argv) > 1 else None):
        start = time.time()
        df = spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist(), strict=True)], "vec_id long, embedding array<double>")
        found: dict[int, list[int]] = {}
        for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect():
            found.setdefault(r["query_id"], []).append(r["vec_id"])
        print(f"{name}: {len(ids)} vectors, recall {recall(found, ids, x):.4f}, {time.time() - start:.0f} s", flush=True)
