"""Token counts of flat, unindexed token files.

A flat token file is a run of fixed-width ids with an end-of-document id behind each document, cut into blocks
anywhere. Each block is searched for that id with one vectorised comparison; a prefix scan over the blocks of a
file carries positions, document numbers and the open document across block boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices
from .tokens import encoder, texts_of

BLOCK_IDS = 1 << 17
FLAT = "file long, block long, data binary, doc_ids array<long>"


def write_flat(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """One flat token file per partition, as rows ``(file, block, data)``; ``doc_ids`` lists the documents that end in a block.

    Strings of special tokens in a text are ordinary text here, so that ``end_id`` only ever ends a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_path, True)
        file, block, width = TaskContext.get().partitionId(), 0, 2 * block_ids
        data, docs_in, ends, base = bytearray(), [], [], 0

        def row(n: int) -> pa.RecordBatch:
            k = int(np.searchsorted(ends, base + n, side="right"))
            out = pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([bytes(data[:n])], pa.binary()), pa.array([docs_in[:k]], pa.list_(pa.int64()))], ["file", "block", "data", "doc_ids"])
            del data[:n], docs_in[:k], ends[:k]
            return out

        for batch in batches:
            for part in slices(batch, 1):
                ids, bounds = tokens.encode(texts_of(part.column(1)), end_id)
                docs_in += part.column(0).to_pylist()
                ends += (base + len(data) + 2 * bounds[1:]).tolist()
                data += ids.tobytes()
                while len(data) >= width:
                    yield row(width)
                    base, block = base + width, block + 1
        if data:
            yield row(len(data))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, FLAT)


def separator_scan(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """Documents of flat token files ``(file, block, data)``: file, ordinal, start, n_tokens (without the separator).

    A document that the file's end cuts off (no separator behind it) counts too, as the last one. Empty blocks and
    empty files are allowed; a null block counts as empty. Every block holds whole ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends = [], []
            for data in batch.column(2).to_pylist():
                ids = np.frombuffer(data or b"", f"<u{width}")
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["file", "block", "n_ids", "ends"])

    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = blocks.select(F.col("file").cast("long"), F.col("block").cast("long"), "data").mapInArrow(run, "file long, block long, n_ids long, ends array<long>")
    placed = (
        scanned.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
        .withColumn("docs_before", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
        .withColumn("last_end", F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1)))
        .withColumn("open_from", F.coalesce(F.max("last_end").over(before) + 1, F.lit(0)))
        .withColumn("is_last", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())
    )
    # the cut-off document of a file ends where the file does, as if a separator stood behind it
    past = F.col("n_ids")
    rest = F.col("base") + past - F.coalesce(F.col("last_end") + 1, F.col("open_from"))
    ends = F.when(F.col("is_last") & (rest > 0), F.concat("ends", F.array(past))).otherwise(F.col("ends"))
    each = placed.select("file", "base", "docs_before", "open_from", ends.alias("ends"), F.posexplode(ends).alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("open_from")).otherwise(F.col("base") + F.element_at("ends", F.greatest(F.col("k"), F.lit(1)).cast("int")) + 1)
    return each.select("file", (F.col("docs_before") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("end") - start).alias("n_tokens"))


def manifest(flat: DataFrame) -> DataFrame:
    """Which document is the n-th of which file: the writer's own list, against which a scan can be held."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    numbered = flat.select("file", "block", "doc_ids").withColumn("docs_before", F.coalesce(F.sum(F.size("doc_ids")).over(before), F.lit(0)))
    return numbered.select("file", "docs_before", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("docs_before") + F.col("k")).alias("ordinal"), "doc_id")
