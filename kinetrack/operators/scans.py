"""Linear passes over ordered tracks (W19, W20): prefix composition of state maps, and a stack carried over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.files import stored
from .kinematics import KEY

#: Frames of a track that one pass composes; longer tracks are cut into chunks, which may lie in different tasks.
CHUNK = 4096
MAPS = ["m0", "m1", "m2"]


def _composed(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Row i: the maps (rows of three states) from the last ``first`` row up to i, composed in order."""
    n = len(maps)
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(first, at, 0))
    longest, step = int((at - start).max()) + 1 if n else 0, 1
    while step < longest:
        rows = np.flatnonzero(at - step >= start)
        maps[rows] = np.take_along_axis(maps[rows], maps[rows - step], 1)
        step *= 2
    return maps


def composed_maps(maps: DataFrame, key: Sequence[str] = KEY, chunk: int = CHUNK) -> DataFrame:
    """``maps`` with m0, m1, m2 replaced by the composition of all maps of the track up to this row.

    ``maps`` has the key, ``idx`` (0, 1, 2, ... in each track) and the states m0, m1, m2 to which the states 0, 1, 2 go.
    Maps compose associatively: chunks are composed locally, the chunks' own maps by the same operator, and both are
    joined. Linear in the rows; a track may be longer than a task holds.
    """
    key, names = list(key), maps.columns
    places, idx_at = [names.index(m) for m in MAPS], names.index("idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = np.arange(3, dtype=np.int64)[None]
        for batch in batches:
            if not batch.num_rows:
                continue
            told = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in places], 1).astype(np.int64)
            first = batch.column(idx_at).to_numpy(zero_copy_only=False) % chunk == 0
            told = _composed(np.concatenate([carry, told]), np.concatenate([[True], first]))
            carry = told[-1:]
            columns = list(batch.columns)
            for k, place in enumerate(places):
                columns[place] = pa.array(np.ascontiguousarray(told[1:, k]))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = StructType([StructField(f.name, LongType()) if f.name in MAPS else f for f in maps.schema])
    dealt = maps.withColumn("_chunk", F.floor(F.col("idx") / chunk)).repartition(*key, "_chunk").sortWithinPartitions(*key, "idx").drop("_chunk")
    local = stored(dealt.mapInArrow(run, schema))
    if (local.agg(F.max("idx")).first()[0] or 0) < chunk:
        return local
    local = local.withColumn("_chunk", F.floor(F.col("idx") / chunk))
    ends = local.groupBy(*key, "_chunk").agg(F.max_by(F.struct(*MAPS), "idx").alias("m")).select(*key, F.col("_chunk").alias("idx"), "m.*")
    before = composed_maps(ends, key, chunk).select(*key, (F.col("idx") + 1).alias("_chunk"), F.array(*MAPS).alias("_before"))
    joined = local.join(before, [*key, "_chunk"], "left")
    now = F.array(*MAPS)
    through = [F.coalesce(F.get(now, F.get("_before", k).cast("int")), F.col(m)).alias(m) for k, m in enumerate(MAPS)]
    return joined.select(*[c for c in names if c not in MAPS], *through).select(*names)


def stack_merge(eps: DataFrame, threshold: int, key: Sequence[str] = KEY) -> DataFrame:
    """Episodes (key, ep_idx, state, run) without those of at most ``threshold`` frames between two of one state, leftmost first.

    One pass over each track in order. Below an episode that is longer than the threshold nothing changes any more, so
    it is handed on; what stays open, within a batch and over its end, is at most a few short episodes.
    """
    key = list(key)
    width = len(key)
    names = [*key, "ep_idx", "state", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, done, stack = None, 0, []
        for batch in batches:
            out: list[tuple] = []

            def close(keep: int) -> None:
                nonlocal done, stack
                for state, length in stack[: len(stack) - keep]:
                    out.append((*at, done, state, length))  # noqa: B023
                    done += 1
                stack = stack[len(stack) - keep :]

            columns = [c.to_pylist() for c in batch.columns]
            for *who, state, length in zip(*columns, strict=True):
                if who != at:
                    close(0)
                    at, done = who, 0
                if len(stack) > 1 and stack[-1][1] <= threshold and stack[-2][0] == state != stack[-1][0]:
                    length = stack[-2][1] + stack[-1][1] + length
                    del stack[-2:]
                stack.append((state, length))
                if length > threshold and len(stack) > 1:
                    close(1)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if stack:
            out = [(*at, done + k, state, length) for k, (state, length) in enumerate(stack)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    fields = [*eps.select(*key).schema.fields, *[StructField(c, LongType()) for c in names[width:]]]
    types = [to_arrow_type(f.dataType) for f in fields]
    rows = eps.select(*key, "ep_idx", F.col("state").cast("long").alias("state"), F.col("run").cast("long").alias("run"))
    return rows.repartition(*key).sortWithinPartitions(*key, "ep_idx").drop("ep_idx").mapInArrow(run, StructType(fields))
