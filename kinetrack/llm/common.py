"""Helpers that several operators share: written intermediate tables and byte-bounded Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _LOCAL.setdefault("dir", "") or tempfile.mkdtemp(prefix="kinetrack-")
        _LOCAL["dir"] = root
    return root.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    The written table cuts the lineage, so that a lost executor costs the reading of a file, not the job so far.
    """
    path = f"{shared_dir(df.sparkSession)}/kinetrack/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``#row`` that tells each row from every other, in the order of the ids.

    It is ``doc_id`` where every row has one of its own. Otherwise rows are numbered, by id and hash of the text, and
    written once, so that every later reading sees the same numbers.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        return docs.withColumn("#row", F.col("doc_id").cast("long"))
    return save(docs.orderBy("doc_id", F.xxhash64("text")).withColumn("#row", F.monotonically_increasing_id()), "rows")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most ``rows`` rows whose ``column`` holds about ``limit`` bytes; a longer value stands alone."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1
    cuts = np.union1d(at, np.arange(0, batch.num_rows, rows)).tolist()
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def byte_rows(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


#: Bits of the filter that keeps documents without candidates out of a join with texts: 64 in a row, 2 MB of rows, whatever the input.
FILTER_BITS = 1 << 23


def _marked(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """``rows`` with ``#met``: whether the hash of doc_id hits a bit that some ``listed`` id sets. JVM only; the broadcast side is bounded by FILTER_BITS."""
    bit = f"pmod(xxhash64(doc_id), {FILTER_BITS})"
    word, mask = f"cast({bit} div 64 as int)", f"shiftleft(1L, cast({bit} % 64 as int))"
    words = listed.groupBy(F.expr(word).alias("#word")).agg(F.bit_or(F.expr(mask)).alias("#bits"))
    met = rows.withColumn("#word", F.expr(word)).join(F.broadcast(words), "#word", "left")
    return met.withColumn("#met", F.coalesce(F.expr(f"`#bits` & {mask}"), F.lit(0)) != 0).drop("#word", "#bits")


def with_texts(texts: DataFrame, listed: DataFrame) -> DataFrame:
    """Join texts with a table by doc_id; most texts that have no partner stay out of the shuffle.

    The filter has false positives (more as it fills, beyond some tens of millions of ids), which the join drops; it
    never loses a document.
    """
    return split_by(texts, listed)[0].join(listed, "doc_id")


def split_by(texts: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose doc_id may be in ``listed``, and rows whose doc_id is surely not (or null)."""
    marked = _marked(texts, listed)
    return marked.filter("`#met`").drop("#met"), marked.filter("not `#met`").drop("#met")
