"""Connected components of a links table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each batch's links: at most as many rows as it has nodes."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (p := parent.get(root, root)) != root:
                root = p
            while x != root:
                parent[x], x = root, parent.get(x, x)
            return root

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        roots = [find(x) for x in nodes]
        keep = [k for k, (x, r) in enumerate(zip(nodes, roots, strict=True)) if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in keep], pa.int64()), pa.array([roots[k] for k in keep], pa.int64())], ["u", "v"])


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component_id)`` for each node of ``links``: the smallest node that it reaches.

    Each round is written to the shared folder. The hub of a large component is met through partial minima and a
    join that adaptive execution can split; no node's neighbours are gathered in one place. Self-links, repeated
    links and either direction are fine.
    """
    pairs = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    nodes_alone = pairs.filter("u = v").select("u")
    edges = save(pairs.filter("u is not null and v is not null and u <> v").mapInArrow(_spanning, "u long, v long"), "edges")
    nodes = edges.select("u").union(edges.select("v")).union(nodes_alone).distinct()
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = save(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return nodes.join(edges.withColumnRenamed("v", "m"), "u", "left").select(F.col("u").alias("node"), F.coalesce("m", "u").alias("component_id"))
