"""Exact threshold pairs of vectors by dual traversal of cover trees.

On unit vectors a cosine of at least c is a distance of at most sqrt(2 - 2c). Equal vectors of a label are one
point. A label's points are dealt to the cells of a few pivots, a cell to chunks of bounded size, and a chunk is
one cover tree: nested levels whose radii halve, each point within its level's radius of its parent. Two chunks are
traversed together only if their roots and covering radii leave room for a pair; inside, node pairs are
pruned by the same bound, or taken whole where both nodes lie within the threshold of each other.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .components import components

#: Points of a tree; what a task holds at once is two trees.
CHUNK = 1024
#: Pivots of a label; larger labels get more chunks a cell, not more pivots.
PIVOTS = 32
SLACK = 1e-7


class Tree:
    """Cover tree of unit vectors: node k is a point with a level, its children's slice in ``order``, and a covering radius."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        if len(points):
            d = np.sqrt(np.maximum(((points - points[0]) ** 2).sum(1), 0))
            self._grow(0, np.arange(len(points)), d)

    def _grow(self, center: int, members: np.ndarray, d: np.ndarray) -> None:
        """Nodes from the root down; a stack, since a tree may be deep."""
        stack = [(center, members, d, -1)]
        while stack:
            center, members, d, parent = stack.pop()
            radius = float(d.max())
            node = len(self.center)
            self.center.append(center)
            self.radius.append(radius)
            self.children.append([])
            self.members.append(members)
            if parent >= 0:
                self.children[parent].append(node)
            if len(members) == 1 or radius == 0:
                continue
            half = radius / 2
            left, dist, nxt = members, d, center
            while len(left):  # a net of half the radius: each new centre takes what lies within reach
                if nxt is None:
                    nxt = int(left[np.argmax(dist)])
                    dist = np.sqrt(np.maximum(((self.points[left] - self.points[nxt]) ** 2).sum(1), 0))
                near = dist <= half
                near |= left == nxt
                stack.append((nxt, left[near], dist[near], node))
                left, dist = left[~near], dist[~near]
                nxt = None


def dual_pairs(a: Tree, b: Tree, same: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays (into a's and b's points) of linked blocks: each of the first with each of the second."""
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    if not len(a.points) or not len(b.points):
        return
    ca, cb = np.array(a.center), np.array(b.center)
    ra, rb = np.array(a.radius), np.array(b.radius)
    stack = [(np.array([0]), np.array([0]))]
    while stack:
        xs, ys = stack.pop()
        d = np.sqrt(np.maximum(2 - 2 * (a.points[ca[xs]] @ b.points[cb[ys]].T), 0))
        room = ra[xs][:, None] + rb[ys][None, :]
        for i, j in zip(*np.nonzero(d <= reach + room + SLACK), strict=True):
            x, y = int(xs[i]), int(ys[j])
            if same and len(a.members[x]) == 1 and x == y:
                continue
            if d[i, j] + room[i, j] < reach - SLACK:
                yield a.members[x], b.members[y]
            elif not a.children[x] and not b.children[y]:
                yield from _exact(a, b, a.members[x], b.members[y], cosine)
            elif len(a.members[x]) * len(b.members[y]) <= 64:
                yield from _exact(a, b, a.members[x], b.members[y], cosine)
            else:
                stack.append((np.array(a.children[x] or [x]), np.array(b.children[y] or [y])))


def _exact(a: Tree, b: Tree, xs: np.ndarray, ys: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    c = a.points[xs] @ b.points[ys].T
    for i, j in zip(*np.nonzero(c >= cosine), strict=True):
        yield xs[i : i + 1], ys[j : j + 1]


def link_chunks(ids_a: np.ndarray, a: Tree, ids_b: np.ndarray, b: Tree, copies_a: np.ndarray, copies_b: np.ndarray, same: bool, cosine: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """How many rows each vector links with across two chunks, and links that join what belongs together."""
    count_a, count_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    parent: dict[int, int] = {}
    links = []

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    for xs, ys in dual_pairs(a, b, same, cosine):
        # within one chunk the traversal meets each pair from both sides
        count_a[xs] += copies_b[ys].sum()
        if same:
            count_a[np.intersect1d(xs, ys)] -= copies_a[np.intersect1d(xs, ys)]
        else:
            count_b[ys] += copies_a[xs].sum()
        first = find(int(ids_a[xs[0]]))
        for v in {int(v) for v in ids_a[xs]} | {int(v) for v in ids_b[ys]}:
            r = find(v)
            if r != first:
                links.append((int(ids_a[xs[0]]), v))
                parent[max(r, first)] = min(r, first)
                first = min(r, first)
    counts: dict[int, int] = {}
    for ids, c in ((ids_a, count_a), (ids_b, count_b)):
        for k in np.flatnonzero(c):
            counts[int(ids[k])] = counts.get(int(ids[k]), 0) + int(c[k])
    return counts, links


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept, over pairs of equal, non-null labels with at least this cosine.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do vectors
    of different lengths and rows without an id. Repeated rows and equal vectors link with each other.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.col(label_col).alias("label"))
    # nulls and NaN fail the comparison, as infinities do
    sound = F.size("v") > 0
    sound &= ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    # adding 0.0 makes -0.0 and 0.0 one value; the key names a vector within its label
    key = F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))), 256)
    keyed = save(rows.filter("sound").select("vec_id", "label", key.alias("key"), "v"), "vectors")
    points = save(keyed.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")).withColumn("dim", F.size("v")), "points")
    chunks = save(_chunks(points), "chunks")
    found = save(_dual(chunks, cosine), "found")
    counts = found.filter("other is null").groupBy("vec").agg(F.sum("n").alias("n"))
    groups = components(found.filter("other is not null"), "vec", "other")
    info = (
        points.join(counts.withColumnRenamed("vec", "rep"), "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    linked = keyed.select("vec_id", "label", "key").join(info, ["label", "key"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _chunks(points: DataFrame) -> DataFrame:
    """One row a chunk: label, dim, chunk, root, radius, tree (ids, copies and the tree, as bytes)."""
    sizes = points.groupBy("label", "dim").agg(F.count("*").alias("n"))
    spot = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sized = points.join(sizes, ["label", "dim"])
    share = F.least(F.lit(float(PIVOTS)), F.ceil(F.col("n") / CHUNK).cast("double")) / F.col("n")
    # a label's points are dealt to groups of a few chunks, and each group sees all of the label's pivots
    groups = F.ceil(F.col("n") / (4 * CHUNK)).cast("long")
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("key", F.lit(1)), groups))
    pivots = save(sized.filter(spot < share).select("label", "dim", "key", "v", groups.alias("groups")), "pivots").select("label", "dim", "key", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"))

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({"label": [], "dim": [], "rep": [], "copies": [], "v": [], "cell": [], "key": []})
        p = _unit(np.stack(left["v"]))
        cell = np.zeros(len(p), np.int64)
        if len(right):
            right = right.sort_values("key")
            cell = np.argmax(p @ _unit(np.stack(right["v"])).T, 1)
        return left[["label", "dim", "rep", "copies", "v", "key"]].assign(cell=cell)

    kind = points.schema["label"].dataType.simpleString()
    celled = salted.select("label", "dim", "salt", "rep", "copies", "v", "key").groupBy("label", "dim", "salt").cogroup(pivots.groupBy("label", "dim", "salt")).applyInPandas(assign, f"label {kind}, dim int, rep long, copies long, v array<double>, cell long, key string")
    celled = save(celled, "cells")
    per = celled.groupBy("label", "dim", "cell").agg(F.count("*").alias("m"))
    parts = celled.join(per, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("key", F.lit(2)), F.ceil(F.col("m") / CHUNK).cast("long")))

    def plant(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        tree = Tree(_unit(np.stack(group["v"])))
        blob = pickle.dumps((group["rep"].to_numpy(), group["copies"].to_numpy(), tree), protocol=5)
        head = group.iloc[0]
        return pd.DataFrame({"label": [head["label"]], "dim": [head["dim"]], "chunk": [f"{head['cell']}.{head['part']}"], "root": [tree.points[0]], "radius": [tree.radius[0]], "tree": [blob]})

    return parts.groupBy("label", "dim", "cell", "part").applyInPandas(plant, f"label {kind}, dim int, chunk string, root array<double>, radius double, tree binary")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _dual(chunks: DataFrame, cosine: float) -> DataFrame:
    """Rows (vec, n) with a vector's link counts and rows (vec, other) with joining links."""
    heads = chunks.select("label", "dim", "chunk", "root", "radius")
    a, b = (heads.select("label", "dim", F.col("chunk").alias(f"chunk_{s}"), F.col("root").alias(f"root_{s}"), F.col("radius").alias(f"radius_{s}")) for s in "ab")
    gap = F.sqrt(F.aggregate(F.zip_with("root_a", "root_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    room = F.col("radius_a") + F.col("radius_b") + math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    pairs = a.join(b, ["label", "dim"]).filter("chunk_a <= chunk_b").filter(gap <= room).select("label", "dim", "chunk_a", "chunk_b")
    trees = chunks.select("label", "dim", "chunk", "tree")
    both = (
        save(pairs, "chunk_pairs")
        .join(trees.withColumnsRenamed({"chunk": "chunk_a", "tree": "tree_a"}), ["label", "dim", "chunk_a"])
        .join(trees.withColumnsRenamed({"chunk": "chunk_b", "tree": "tree_b"}), ["label", "dim", "chunk_b"])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids_a, copies_a, tree_a = pickle.loads(batch.column(1)[i].as_py())
                same = batch.column(0)[i].as_py()
                ids_b, copies_b, tree_b = (ids_a, copies_a, tree_a) if same else pickle.loads(batch.column(2)[i].as_py())
                counts, links = link_chunks(ids_a, tree_a, ids_b, tree_b, copies_a, copies_b, same, cosine)
                vec = [*counts, *(x for x, _ in links)]
                other = [None] * len(counts) + [y for _, y in links]
                yield pa.RecordBatch.from_arrays([pa.array(vec, pa.int64()), pa.array(other, pa.int64()), pa.array([*counts.values()] + [0] * len(links), pa.int64())], ["vec", "other", "n"])

    return both.select((F.col("chunk_a") == F.col("chunk_b")).alias("same"), "tree_a", "tree_b").mapInArrow(run, "vec long, other long, n long")
