"""Best-fit packing of whole documents by a configuration linear program over the histogram of their lengths.

Only documents longer than a sequence are cut. The pieces are written once, with their place among the pieces of the
same length and written part; the histogram of lengths (at most one row a length) goes to the driver, where
``configurations`` decides how many sequences of which lengths there are. A piece then finds its sequence by its
length and its number among pieces of that length, so no group of pieces is ever gathered.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import BpeCodec
from .common import save, slices
from .configurations import Configuration, solve
from .tokens import WordCache, texts_of

PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, nth long"


class WordIds:
    """Ids of texts (16-bit little-endian) by a word-level BPE tokenizers file, as that library gives them.

    No word reaches over a space, so texts are normalised and cut at spaces, and the ids of each distinct run are made
    once a worker. Texts that may hold special tokens, or characters that Python's Unicode tables lack, are cut into
    words as a whole. New runs are merged together by tiktoken: the file's ids are in the order of merges, and END,
    which no lower-cased word holds, stands for the end of a word. Files of another kind are refused.
    """

    END = "A"

    def __init__(self, path: str):
        import tiktoken

        self.codec = codec = BpeCodec(path)
        self.cache, suffix, end = WordCache(), codec.suffix, self.END.encode()
        with open(path, encoding="utf-8") as f:
            pairs = json.load(f)["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in pairs]
        if not suffix or [codec.vocab[a + b] for a, b in pairs] != list(range(512, 512 + len(pairs))):
            raise ValueError(f"{path}: only word ends and ids in the order of merges are known")
        raw = {}
        for token, i in codec.vocab.items():
            if token not in codec.special:
                whole = token.endswith(suffix) and token != suffix
                raw[bytes(map(codec.byte_of.__getitem__, token.removesuffix(suffix) if whole else token)) + end * whole] = i
        if sorted(raw.values()) != list(range(512 + len(pairs))):
            raise ValueError(f"{path}: two tokens stand for the same bytes")
        self.fast = tiktoken.Encoding(path, pat_str=rf"[^{self.END}\s]+{self.END}|\n", mergeable_ranks=raw, special_tokens={})
        self.line = raw[b"\n"]

    def runs(self, text: str) -> list[str]:
        codec = self.codec
        if "<|" in text or not text.isascii() and codec.foreign(text):
            return codec.words(text)
        return codec.lowered(text).replace("\n", " ").split(" ")

    def merged(self, runs: list[str]) -> list[bytes]:
        """Ids of runs without a line break: their words are marked and merged in one go, a line a run."""
        ids = self.fast.encode_to_numpy(self.codec.split.sub(rf"\g<0>{self.END}", "\n".join(runs)), disallowed_special=()).astype("<u2")
        ends = np.flatnonzero(ids == self.line)
        whole, at = ids.tobytes(), 2 * np.array([-1, *ends.tolist(), len(ids)])
        return [whole[a + 2 : b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.runs(t) for t in texts]
        known, special = self.cache.room(), self.codec.special
        missing = self.cache.missing(set(chain.from_iterable(cut)))
        for run in special.keys() & set(missing):
            self.cache.put(run, np.array([special[run]], "<u2").tobytes())
        missing = [run for run in missing if run not in special]
        for run, ids in zip(missing, self.merged(missing) if missing else (), strict=True):
            self.cache.put(run, ids)
        return [b"".join(map(known.__getitem__, c)) for c in cut]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The encoder of this process: later tasks of a worker find the words that earlier ones met."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, size: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Whole documents with ``end_id`` behind them, cut only where longer than ``size``.

    ``nth`` numbers the pieces of one length within the task that made them (``part``): the number is fixed once the
    table is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, part_id = word_ids(tokenizer_path), np.array([end_id], "<u2").tobytes(), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for part in slices(batch, 1):
                rows: list[list] = [[], [], [], [], [], []]
                for name, ids in zip(part.column(0).to_pylist(), encoder.encode(texts_of(part.column(1))), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 2 * size)):
                        cut = ids[at : at + 2 * size]
                        length = len(cut) // 2
                        for column, value in zip(rows, (name, k, at // 2, length, cut, int(seen[length])), strict=True):
                            column.append(value)
                        seen[length] += 1
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
                name, piece, start, length, cut, nth = (pa.array(c, t) for c, t in zip(rows, types, strict=True))
                yield pa.RecordBatch.from_arrays([name, piece, start, length, cut, pa.array(np.full(len(nth), part_id, np.int32)), nth], ["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


def places(plan: list[tuple[Configuration, int]]) -> dict[str, np.ndarray]:
    """The places of each length, in order: from which number on, how many a sequence, at which offset, from which sequence on.

    One row for each length of each configuration: bounded by the histogram of lengths, not by the pieces.
    """
    rows, first, sequence = [], {}, 0
    for configuration, uses in plan:
        offset = 0
        for length, times in configuration:
            at = first.get(length, 0)
            rows.append((length, at, times, offset, sequence))
            first[length] = at + times * uses
            offset += length * times
        sequence += uses
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "times", "offset", "sequence"), table.T, strict=True))


def placed(plan: list[tuple[Configuration, int]], length: str, number: str) -> Column:
    """``struct<sequence_id, offset>`` of the piece with this number among the pieces of its length."""
    at = places(plan)
    keys = at["length"] << 44 | at["first"]

    def find(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        n, j = length.to_numpy(np.int64), number.to_numpy(np.int64)
        row = np.searchsorted(keys, n << 44 | j, "right") - 1
        along = j - at["first"][row]
        return pd.DataFrame({"sequence_id": at["sequence"][row] + along // at["times"][row], "offset": at["offset"][row] + along % at["times"][row] * n})

    return F.pandas_udf(find, "sequence_id long, offset long")(length, number)


def pack_whole(docs: DataFrame, tokenizer_path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Pack documents into as few sequences of at most ``size`` ids as the program finds; only longer ones are cut.

    Per piece: doc_id, piece (from 0), start, length, ids (16-bit little-endian), sequence_id and offset. A sequence's
    pieces lie gapless from offset 0; sequence ids run from 0 without a hole. A null or empty text is one ``end_id``;
    repeated rows, and rows that share an id or have none, are packed once each; an empty table gives no piece; other
    columns are not read. A length that a third of all pieces share is spread over tasks by the part that wrote it.
    """
    written = save(pieces(docs, tokenizer_path, size, id_col, text_col, end_id), "pieces")
    counts = written.groupBy("part", "length").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = save(counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))), "counts")
    histogram = {r.length: r.n for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    plan, _ = solve(histogram, size)
    numbered = written.join(before.select("part", "length", "before"), ["part", "length"]).withColumn("number", F.col("before") + F.col("nth"))
    return numbered.withColumn("at", placed(plan, "length", "number")).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids", "at.sequence_id", "at.offset")


def ids_crc32(ids: str) -> Column:
    """CRC-32 of ids as unsigned 32-bit little-endian numbers."""

    def run(ids: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in ids], dtype="int64")

    return F.pandas_udf(run, "long")(ids)
