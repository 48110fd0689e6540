"""Importance resampling toward a target distribution of hashed n-grams.

Both corpora are counted whole into hash buckets; a bucket's gain is its scaled log ratio of smoothed frequencies. A
document's weight is the floored mean of the gains of its n-grams, read from an array; a Gumbel draw by its id makes
the score. The documents to draw are those up to the exact cutoff key, which weighted median-of-medians finds: each
round every partition names the medians of its remaining keys on both sides of the pivot, the weighted median of those
is the next pivot, and at least a quarter of the remaining keys is discarded. Only the drawn ones are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from .common import byte_rows, save, slices

#: Bytes of a text that are cut into words at a time; bounds the memory of a long text, not what is read.
STRETCH = 1 << 20
#: Keys that the driver may order itself at the end of the selection.
TAIL = 1024
#: A-Z in lower case; bytes that separate words as spaces; digits, a-z and all bytes of other characters as they are.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
LAST = (1 << 63) - 1


def stretches(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in runs cut between words."""
    text, start = text.translate(WORD_BYTES), 0
    while start < len(text):
        end = len(text)
        if end - start > STRETCH:
            end = text.rfind(b" ", start, start + STRETCH)
            if end <= start and (end := text.find(b" ", start + STRETCH)) < 0:
                end = len(text)
        yield text[start:end].split()
        start = end


def hashes(text: bytes, orders: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per run of words: their number, and the CRC-32 of every n-gram of 1 to ``orders`` words that ends in it."""
    held: list[bytes] = []
    for words in stretches(text):
        run, new = held + words, len(held)
        grams = list(map(crc32, run))
        out = [grams[new:]]
        spaced = [b" " + w for w in run]
        for n in range(1, orders):  # an n-gram's CRC goes on from the one that is a word shorter
            grams = list(map(crc32, spaced[n:], grams))
            out.append(grams[max(0, new - n) :])
        held = run[len(run) - orders + 1 :] if orders > 1 and len(run) >= orders - 1 else run if orders > 1 else []
        yield len(words), np.array([x for grams in out for x in grams], np.int64)


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, orders: int) -> np.ndarray:
    """How many n-grams of all texts fall in each bucket: at most ``buckets`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                held = [np.zeros(0, np.int64)]
                for text in byte_rows(part.column(0)):
                    held.extend(found % buckets for _, found in hashes(text, orders))
                total += np.bincount(np.concatenate(held), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(ratio of the smoothed frequencies, target to source)) of each bucket."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + b) / (float(s + 1) * float(t_all + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, orders: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, n_words, n_features and weight, the floored mean gain of all n-grams (0 without any)."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for text in byte_rows(part.column(1)):
                    words = features = total = 0
                    for n, found in hashes(text, orders):
                        words, features, total = words + n, features + len(found), total + int(gains[found % buckets].sum())
                    rows.append((words, features, total // features if features else 0))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def drawn_score(weight: str, name: str, seed: int) -> Column:
    """Weight plus a Gumbel draw by the SHA-256 of ``seed:id`` (a null id counts as empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(name).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.col(weight) + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


class Key(NamedTuple):
    """Order of drawing: higher scores first, then smaller ids (null last), then the row's place in the written table."""

    low: int
    name: int
    row: int


def key_columns() -> list[Column]:
    return [(-F.col("score")).alias("low"), F.coalesce("doc_id", F.lit(LAST)).alias("name"), F.col("row")]


def before(key: Key, and_equal: bool = False) -> Column:
    """Whether a row's key comes before ``key``."""
    low, name, row = (F.col(c) for c in Key._fields)
    last = row <= key.row if and_equal else row < key.row
    return (low < key.low) | ((low == key.low) & ((name < key.name) | ((name == key.name) & last)))


def medians(keys: DataFrame, pivot: Key | None) -> list[tuple[list[int], list[Key | None]]]:
    """Of each partition the number of its keys below and above the pivot, and the median key of either side."""
    names = [f"{side}_{c}" for side in ("below", "above") for c in ("n", *Key._fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows]
        if not held:
            return
        low, name, row = np.concatenate(held, axis=1)
        order = np.lexsort((row, name, low))
        if pivot is None:
            cut = skip = 0
        else:
            is_below = (low < pivot.low) | ((low == pivot.low) & ((name < pivot.name) | ((name == pivot.name) & (row < pivot.row))))
            cut = int(is_below.sum())
            skip = cut + int(((low == pivot.low) & (name == pivot.name) & (row == pivot.row)).sum())
        out = []
        for side in (order[:cut], order[skip:]):
            k = side[(len(side) - 1) // 2] if len(side) else None
            out += [len(side), *((None, None, None) if k is None else (int(low[k]), int(name[k]), int(row[k])))]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in out], names)

    rows = keys.mapInArrow(run, ", ".join(f"{n} long" for n in names)).collect()
    return [([r.below_n, r.above_n], [Key(*r[1:4]) if r.below_n else None, Key(*r[5:8]) if r.above_n else None]) for r in rows]


def weighted_median(found: list[tuple[int, Key]]) -> Key:
    half, so_far = sum(n for n, _ in found) / 2, 0
    for n, key in sorted(found, key=lambda x: x[1]):
        so_far += n
        if so_far >= half:
            return key
    raise ValueError("no key is left")


def cutoff(keys: DataFrame, k: int, total: int, tail: int = TAIL) -> Key:
    """The ``k``-th of ``total`` different keys (low, name, row) in order; keys are never sorted as a whole.

    Each round discards at least a quarter of what remains; what remains is written anew each time it has shrunk to a
    quarter, so all rounds together read a few times the first one.
    """
    remaining, stored_size, pivot = keys, total, None
    while total > tail:
        told = medians(remaining, pivot)
        if pivot is not None:
            below = sum(n[0] for n, _ in told)
            if k == below + 1:
                return pivot
            side = 0 if k <= below else 1
            k -= (below + 1) * side
            total = sum(n[side] for n, _ in told)
            remaining = remaining.filter(~before(pivot, True) if side else before(pivot))
            if total * 4 <= stored_size and total > tail:
                remaining, stored_size = save(remaining, "keys"), total
        else:
            side = 1
        pivot = weighted_median([(n[side], m[side]) for n, m in told if n[side]])
    rest = sorted(Key(r.low, r.name, r.row) for r in remaining.collect())  # ``tail`` keys at most
    return rest[k - 1]


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = 10_000, orders: int = 2, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", tail: int = TAIL,
) -> DataFrame:
    """Every row with n_words, n_features, weight, score and, for the drawn ones, its rank 1, 2, 3, ...

    Of the rows with ``min_words`` words, floor(percent / 100) are drawn: the highest scores, ties to smaller ids, rows
    without an id last, and rows that share an id in the order in which they were written. A null or empty text has no
    word and weight 0. Repeated rows are scored each; other columns are not read. An empty table gives no row, and an
    empty target only the smoothing. Hash buckets bound what reaches the driver and the tasks, not the corpora.
    """
    gains = gains_of(bucket_counts(docs, text_col, buckets, orders), bucket_counts(target, target_col, buckets, orders))
    scored = save(weighed(docs, gains, orders, id_col, text_col).withColumn("score", drawn_score("weight", "doc_id", seed)).withColumn("row", F.monotonically_increasing_id()), "scored")
    fit = F.col("n_words") >= min_words
    eligible = scored.filter(fit)
    n = eligible.count()
    k = percent * n // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    unranked = [*columns, F.lit(None).cast("long").alias("rank")]
    if not k:
        return scored.select(*unranked)
    last = cutoff(eligible.select(*key_columns()), k, n, tail)
    keyed = scored.select(*columns, "row", *key_columns()[:2])
    drawn = fit & before(last, True)
    winners = numbered(keyed.filter(drawn), ["low", "name", "row"], "rank")
    return winners.select(*columns, "rank").union(keyed.filter(~drawn).select(*unranked))
