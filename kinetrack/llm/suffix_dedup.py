"""Removal of long repeated byte strings by fingerprints at growing lengths, in place of prefix doubling.

No rank is made in Spark from a sorted pair of shorter ranks: that would sort a row for every byte. The fingerprint of
the l bytes that start at a position, computed in tasks from the raw bytes, stands for its rank at length l, and Spark
groups positions by it. Positions whose fingerprint is unique drop out; the rest go on at a greater length until the
threshold is reached:

1. length 64, at anchors only. In each threshold-long string the 64 bytes of smallest hash are its anchor
   (leftmost on ties), so equal strings have equal anchors at equal offsets. Consecutive starts that share an
   anchor form a cell. Cells whose anchor occurs once hold no repeated string. Cells equal as a whole, up to the
   threshold behind their last start, repeat at each of their starts; one of them stays on, as a witness.
2. threshold - 15, for blocks of 16 starts (aligned to the anchor) of the distinct cells whose anchor has several
   contents: the bytes that all strings of a block share. Blocks of unique rank drop out; blocks equal as a whole
   are settled, and one stays on as a witness.
3. the threshold, at each start of the blocks that are left: those at the edges of repeated passages.

So copies, however many, are never expanded: steps 2 and 3 see each distinct content once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_rows, row_keys, save, slices, split_by, with_texts

THRESHOLD, GRAM = 200, 64
POSITION_BITS = 24
#: Starts of a text that are looked at together; bounds memory and keeps positions below 2 ** POSITION_BITS.
STRETCH = 1 << 23
_RNG = np.random.default_rng(20_200)
BYTES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = tuple(int(x) * 8 + 5 for x in _RNG.integers(1 << 50, 1 << 60, 2))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base ``k`` and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _POWERS.get(k)
    if have is None or len(have[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        out = []
        for base in (BASE[k], pow(BASE[k], -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            p[1:] = np.uint64(base & (1 << 64) - 1)
            out.append(np.multiply.accumulate(p))
        _POWERS[k] = have = tuple(out)
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Ranks:
    """Fingerprints of a text's substrings."""

    def __init__(self, raw: np.ndarray, k: int):
        self.k, n = k, len(raw)
        self.inverse = _powers(k, n + 1)[1]
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTES[k][raw] * _powers(k, n + 1)[0][:n], out=self.prefix[1:])

    def at(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return _mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours."""
    n = len(v)
    full = np.full(-(-n // width) * width, np.iinfo(v.dtype).max, v.dtype)
    full[:n] = v
    blocks = full.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def cells(raw: np.ndarray, threshold: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start and anchor of each cell, the anchor's rank, and the rank of the cell's whole content."""
    n = len(raw)
    if n >= STRETCH + threshold:  # a long text, some starts at a time: a cell that is cut there counts as two
        parts = [(at, cells(raw[at : at + STRETCH + threshold - 1], threshold, gram)) for at in range(0, n - threshold + 1, STRETCH)]
        return tuple(np.concatenate([part[k] + (at if k < 3 else np.uint64(0)) for at, part in parts]) for k in range(5))
    grams = Ranks(raw, 0).at(slice(0, n - gram + 1), slice(gram, n + 1))
    mask = np.uint64((1 << POSITION_BITS) - 1)
    anchor = (sliding_min(grams & ~mask | np.arange(len(grams), dtype=np.uint64), threshold - gram + 1) & mask).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], len(anchor)) - 1
    q = anchor[first]
    whole = Ranks(raw, 1).at(first, last + threshold) ^ _mix(((q - first) * 1024 + last - first).astype(np.uint64))
    return first, last, q, grams[q], whole


def pack_cell(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """First start, count of further starts and distance from the last start to the anchor, in one number."""
    return first << 16 | (last - first) << 8 | (anchor - last)


def unpack_cell(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and anchor."""
    first = at >> 16
    last = first + (at >> 8 & 255)
    return first, last, last + (at & 255)


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs ``first, first + 1, ...`` of ``count`` numbers: all numbers, and the run that each belongs to."""
    run = np.repeat(np.arange(len(first)), count)
    return first[run] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count), run


#: Starts of a block.
BLOCK = 16
#: Hot anchors: those in 1 of 500 documents of a sample of about this size. They are only dealt out differently:
#: over so many parts that each is expected to hold about PART_CELLS cells.
SAMPLE_DOCS, PART_CELLS = 3000, 1000


def repeated_starts(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """``(doc_id, first, last)``: runs of starts at which a string of ``threshold`` bytes begins that also begins elsewhere.

    ``docs`` holds ``doc_id``, a long that no two rows share, and ``text``. Runs may touch or overlap. Texts shorter
    than the threshold have none.
    """
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") >= threshold)
    hot = texts.sparkSession.sparkContext.broadcast(_hot_anchors(texts, threshold, gram))

    def find_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                out = []
                for doc, text in zip(part.column(0).to_pylist(), byte_rows(part.column(1)), strict=True):
                    first, last, q, anchor, whole = cells(np.frombuffer(text, np.uint8), threshold, gram)
                    salt = salts_of(hot.value, anchor, doc, first)
                    out.append((np.full(len(first), doc), pack_cell(first, last, q), anchor.view(np.int64), salt, whole.view(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["doc_id", "at", "anchor", "salt", "whole"])

    # one shuffle and sort settle all but the hot anchors, whose salted parts meet in small aggregates below
    found = texts.mapInArrow(find_cells, "doc_id long, at long, anchor long, salt int, whole long")
    alike, near = Window.partitionBy("anchor", "salt", "whole"), Window.partitionBy("anchor", "salt")
    placed = found.withColumn("nth", F.row_number().over(alike.orderBy("doc_id", "at"))).withColumn("n", F.count("*").over(alike)).withColumn("all", F.count("*").over(near))
    stay = save(placed.filter("all > 1 or salt > 0").select("anchor", "salt", "whole", "doc_id", "at", "n", "all", (F.col("nth") == 1).alias("one")), "cells")
    cold, warm = stay.filter("salt = 0"), stay.filter("salt > 0")
    kinds = warm.filter("one").groupBy("anchor", "whole").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "at")).alias("one"))
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor")
    # copies that met in their salted part are settled there; the rest asks the aggregate
    equal = stay.filter("n > 1").select("doc_id", "at").union(warm.filter("n = 1").join(kinds.filter("n > 1").select("anchor", "whole"), ["anchor", "whole"]).select("doc_id", "at"))
    picked = cold.filter("one and n < all").select("doc_id", "at", "anchor", (F.col("n") == 1).alias("alone")).union(kinds.join(mixed, "anchor").select("one.doc_id", "one.at", "anchor", F.col("n") == 1))
    listed = save(picked.groupBy("doc_id").agg(F.collect_list(F.struct("at", "anchor", "alone")).alias("cells")), "open_cells")

    def rank_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 18):
                out = []
                for doc, text, cs in zip(part.column(0).to_pylist(), byte_rows(part.column(1)), part.column(2).to_pylist(), strict=True):
                    rank = Ranks(np.frombuffer(text, np.uint8), 1)
                    first, last, q = unpack_cell(np.array([c["at"] for c in cs]))
                    low = (q - last) // BLOCK
                    k, cell = spread(low, (q - first) // BLOCK - low + 1)
                    end = q[cell] - k * BLOCK  # behind the block's starts, if none is cut off
                    a, b = np.maximum(end - BLOCK + 1, first[cell]), np.minimum(end, last[cell])
                    common = rank.at(end, end - BLOCK + 1 + threshold)
                    whole = rank.at(a, b + threshold) ^ _mix(((end - a) * 64 + end - b).astype(np.uint64))
                    out.append((np.array([c["anchor"] for c in cs])[cell], k, common.view(np.int64), whole.view(np.int64), np.full(len(k), doc), a << 8 | (b - a), np.array([c["alone"] for c in cs])[cell]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["anchor", "k", "common", "whole", "doc_id", "at", "alone"])

    blocks = save(with_texts(texts, listed).select("doc_id", "text", "cells").mapInArrow(rank_blocks, "anchor long, k long, common long, whole long, doc_id long, at long, alone boolean"), "blocks")
    shared = ["anchor", "k", "common"]
    often = blocks.groupBy(*shared).agg(F.count("*").alias("n"), (F.min("whole") != F.max("whole")).alias("mixed")).filter("n > 1").drop("n")
    open_ = save(blocks.join(often, shared), "open_blocks")
    same = save(open_.groupBy(*shared, "whole").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at", "alone")).alias("one"), F.first("mixed").alias("mixed")), "distinct_blocks")
    settled = open_.filter("alone").join(same.filter("n > 1").select(*shared, "whole"), [*shared, "whole"]).select("doc_id", "at")
    edges = save(same.filter("mixed").select("one.doc_id", F.struct("one.at", "anchor", (F.col("one.alone") & (F.col("n") == 1)).alias("alone")).alias("block")).groupBy("doc_id").agg(F.collect_list("block").alias("blocks")), "edge_blocks")

    def rank_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 18):
                out = []
                for doc, text, bs in zip(part.column(0).to_pylist(), byte_rows(part.column(1)), part.column(2).to_pylist(), strict=True):
                    rank = Ranks(np.frombuffer(text, np.uint8), 1)
                    at = np.array([b["at"] for b in bs])
                    start, block = spread(at >> 8, (at & 255) + 1)
                    out.append((np.array([b["anchor"] for b in bs])[block], rank.at(start, start + threshold).view(np.int64), np.full(len(start), doc), start, np.array([b["alone"] for b in bs])[block]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["anchor", "rank", "doc_id", "start", "alone"])

    ranked = save(with_texts(texts, edges).select("doc_id", "text", "blocks").mapInArrow(rank_starts, "anchor long, rank long, doc_id long, start long, alone boolean"), "starts")
    again = ranked.groupBy("anchor", "rank").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "rank")
    single = ranked.filter("alone").join(again, ["anchor", "rank"]).select("doc_id", F.col("start").alias("first"), F.col("start").alias("last"))
    cut = equal.select("doc_id", F.expr("at >> 16").alias("first"), F.expr("(at >> 16) + ((at >> 8) & 255)").alias("last"))
    return cut.union(settled.select("doc_id", F.expr("at >> 8").alias("first"), F.expr("(at >> 8) + (at & 255)").alias("last"))).union(single)


def _hot_anchors(texts: DataFrame, threshold: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of 1 in 500 sampled documents (at most 500 times a document's mean number of cells), and the parts to deal each to."""
    n = texts.count()
    some = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE_DOCS / max(n, 1))) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in byte_rows(batch.column(1)):
                anchor, times = np.unique(cells(np.frombuffer(text, np.uint8), threshold, gram)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(times, pa.int64())], ["anchor", "times"])

    met = some.mapInArrow(run, "anchor long, times long").groupBy("anchor").agg(F.count("*").alias("n"), F.sum("times").alias("times"))
    rows = met.filter(F.col("n") >= max(3, min(n, SAMPLE_DOCS) // 500)).orderBy("anchor").toArrow()
    anchors, times = (rows.column(k).to_numpy().astype(np.int64) for k in (0, 2))
    order = np.argsort(anchors.view(np.uint64))
    return anchors.view(np.uint64)[order], 1 + times[order] * max(n // SAMPLE_DOCS, 1) // PART_CELLS


def salts_of(hot: tuple[np.ndarray, np.ndarray], anchor: np.ndarray, doc: int, first: np.ndarray) -> np.ndarray:
    """Part of each cell: 0 for anchors that are not hot, else one of the anchor's parts by document and place."""
    if not len(hot[0]):
        return np.zeros(len(anchor), np.int32)
    at = np.minimum(np.searchsorted(hot[0], anchor), len(hot[0]) - 1)
    spot = _mix(_mix(np.uint64(doc & (1 << 64) - 1) + first.astype(np.uint64) * np.uint64(BASE[0])))
    return np.where(hot[0][at] == anchor, 1 + (spot >> np.uint64(8)) % hot[1][at].astype(np.uint64), 0).astype(np.int32)


def _cut(docs: DataFrame, threshold: int, gram: int, finish: Callable[[bytes, list[tuple[int, int]]], tuple], columns: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """Per row of ``docs`` its doc_id and what ``finish`` makes of the text's bytes and the maximal spans that go."""
    rows = row_keys(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    texts = rows.select(F.col("doc_id").alias("id"), "text", F.col("#row").alias("doc_id"))
    runs = save(repeated_starts(texts, threshold, gram).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "runs")

    def spans_of(text: bytes, found: list | None) -> list[tuple[int, int]]:
        if not found:
            return []
        a = np.minimum(np.array(sorted((r["first"], r["last"] + threshold) for r in found)), len(text))
        reach = np.maximum.accumulate(a[:, 1])
        new = np.flatnonzero(np.append(True, a[1:, 0] > reach[:-1]))
        return list(zip(a[new, 0].tolist(), reach[np.append(new[1:], len(a)) - 1].tolist(), strict=True))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                made = [finish(text, spans_of(text, found)) for text, found in zip(byte_rows(part.column(1)), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, (_, t, _) in zip(zip(*made, strict=True), columns, strict=True)]], ["doc_id", *[n for n, _, _ in columns]])

    # texts without a candidate pass by on their own, without a shuffle
    near, far = split_by(texts, runs)
    schema = ", ".join(["doc_id long", *[f"{n} {k}" for n, _, k in columns]])
    none = F.lit(None).cast("array<struct<first:bigint,last:bigint>>")
    return near.join(runs, "doc_id", "left").select("id", "text", "runs").mapInArrow(cut, schema).union(far.select("id", "text", none.alias("runs")).mapInArrow(cut, schema))


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    return b"".join(text[x:y] for x, y in zip([0, *[b for _, b in spans]], [*[a for a, _ in spans], len(text)], strict=True)) if spans else text


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that no repeated string covers), spans.

    Every copy of a repeated string goes, in the same document too; spans are half-open byte ranges. Null and empty
    texts keep nothing of nothing. Every row counts for itself, also where rows share an id or have none: it loses
    what its own text repeats, and rows of equal texts are copies of each other. The result holds unless two different
    strings have one 64-bit fingerprint.
    """

    def finish(text: bytes, spans: list[tuple[int, int]]) -> tuple:
        return len(text), sum(b - a for a, b in spans), len(spans), _kept(text, spans), [x for span in spans for x in span]

    columns = [("n_bytes", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("n_spans", pa.int64(), "long"), ("kept", pa.binary(), "binary"), ("spans", pa.list_(pa.int64()), "array<long>")]
    return _cut(docs, threshold, gram, finish, columns)


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """Per row of which something is left: doc_id and text. The torn ends of characters that a cut went through are dropped."""
    out = _cut(docs, threshold, gram, lambda text, spans: (_kept(text, spans).decode("utf-8", "ignore"),), [("text", pa.string(), "string")])
    return out.filter("text <> ''")
