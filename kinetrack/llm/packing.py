"""Packing along a space-filling curve.

Each document's hashed token vector is projected to a few dimensions; the Hilbert key of that point orders the
corpus, a range shuffle deals it out, and every task cuts its stretch of the curve into sequences. Neighbouring
sequences hold similar documents, and only the last sequence of a task is open: it is cut into powers of two,
so nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, save, slices
from .tokens import binaries, encoder, texts_of

BUCKETS, DIMS, BITS = 256, 4, 10
#: Ids that one task packs, about (64 MB).
RANGE_TOKENS = 1 << 25
#: Hash bucket of each 16-bit id.
BUCKET_OF = ((np.arange(1 << 16, dtype=np.uint32) * np.uint32(2654435761) >> np.uint32(16)) % BUCKETS).astype(np.int64)
TOKENS = "doc_id long, curve long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows) with ``bits`` bits a coordinate."""
    x = points.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents, the token ids of which lie in a row. Equal documents get equal keys."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n) * BUCKETS, np.diff(bounds))
    vectors = np.sqrt(np.bincount(owner + BUCKET_OF[ids], minlength=n * BUCKETS).reshape(n, BUCKETS))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    points = vectors @ np.random.default_rng(7).standard_normal((BUCKETS, DIMS))
    cells = ((np.tanh(points) + 1) / 2 * (1 << BITS)).astype(np.int64)
    return hilbert_key(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def token_table(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Per document: its ids with ``end_id`` behind them (16-bit little-endian), their count and its curve key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, 1):
                ids, bounds = tokens.encode(texts_of(part.column(1)), end_id)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(curve_keys(ids, bounds)), pa.array(np.diff(bounds)), binaries(ids, bounds)], ["doc_id", "curve", "doc_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, TOKENS)


def cut_stretch(rows: Iterator[tuple[int, np.ndarray]], size: int, first_sequence: int) -> Iterator[tuple]:
    """Cut documents, in order, into sequences of ``size`` ids; the last, open one into powers of two."""
    sequence, used, held = first_sequence, 0, []
    for doc, ids in rows:
        start = 0
        while start < len(ids):
            piece = ids[start : start + size - used]
            held.append((doc, start, piece, len(ids)))
            used, start = used + len(piece), start + len(piece)
            if used == size:
                at = 0
                for d, s, p, n in held:
                    yield d, s, len(p), zlib.crc32(p.tobytes()), n, sequence, at
                    at += len(p)
                sequence, used, held = sequence + 1, 0, []
    room = 1 << (used.bit_length() - 1) if used else 0
    at = 0
    for d, s, p, n in held:
        while len(p):
            piece = p[: room - at]
            yield d, s, len(piece), zlib.crc32(piece.tobytes()), n, sequence, at
            used, at, s, p = used - len(piece), at + len(piece), s + len(piece), p[len(piece) :]
            if at == room:
                sequence, at, room = sequence + 1, 0, 1 << (used.bit_length() - 1) if used else 0


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Pack documents into sequences of at most ``size`` ids along the Hilbert curve of their vectors.

    A null or empty text is one ``end_id``; equal texts stand side by side (ties on the curve by ``doc_id``, so a
    large group of copies spreads over tasks); repeated rows are packed once each; an empty table gives no piece.
    """
    tokens = save(token_table(docs, tokenizer_path, id_col, text_col, end_id), "tokens")
    # ranges of bounded size; what a task leaves open is a vanishing share as long as it holds many sequences
    total = tokens.agg(F.sum("doc_tokens")).first()[0] or 0
    ranges = max(partitions(docs.sparkSession), -(-total // RANGE_TOKENS))
    dealt = tokens.repartitionByRange(ranges, "curve", "doc_id").sortWithinPartitions("curve", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield doc, np.frombuffer(ids, "<u2").astype("<u4")

        out = []
        types = [pa.int64()] * 7
        names = [x.split()[0] for x in PIECES.split(", ")]
        for piece in cut_stretch(rows(), size, TaskContext.get().partitionId() << 36):
            out.append(piece)
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return dealt.select("doc_id", "ids").mapInArrow(run, PIECES)
