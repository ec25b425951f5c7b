"""Connected components by union-find inside tasks and star contraction between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteframe.session import cut


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the links ``a - b``: every node but the roots, with the least node of its group."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    half = len(a)
    for x, y in zip(flat[:half].tolist(), flat[half:].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(len(nodes))], np.int64)
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _forest(batches):
    """The links of each batch as stars; a batch is bounded, so is its forest."""
    for batch in batches:
        u, v = roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node in ``links`` (two long columns).

    The component is its smallest node. Links shrink to stars inside each task,
    then large-star and small-star rounds run until nothing changes; each round is written
    to the shared folder, so a lost executor costs one round. Minima are combined
    map-side and only joined by key, so a hub never meets in one row.
    """
    a, b = links.columns
    links = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    links = cut(links.mapInArrow(_forest, "u long, v long").distinct())
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        sums = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        now = links.agg(F.count(F.lit(1)), sums).first()
        if now == state:
            break
        state = now
    ends = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends)
