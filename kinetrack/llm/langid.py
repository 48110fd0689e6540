"""Language identification by hierarchical discrimination.

A first linear classifier tells language families apart; inside a family, one-versus-one linear support vector
machines separate its languages and vote. Features are the relative frequencies of hashed character 1- to 4-grams of
the whole text, lower-cased, with each stretch of other characters than letters as one space; roots of frequencies
give every text a vector of length 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .common import slices
from .tokens import texts_of

BITS = 12
DIM = 1 << BITS
#: At most so many labelled documents of a language are learned from (those of smallest hash) ...
SAMPLE_PER_LANG = 400
#: ... and at most about so many of all languages together, 16 KB each on the driver.
SAMPLE_TOTAL = 10_000
#: Characters that are looked at together; bounds a task's memory, not what is read of a text.
STRETCH = 1 << 18
SPACE = 32
#: Multipliers of the rolling hash: one for each step back, one for each length.
STEP, SPREAD = np.uint32(2654435761), np.array([2246822519, 3266489917, 668265263, 374761393], np.uint32)
# ISO 639-1 codes by family. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"],
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str, stretch: int = STRETCH) -> np.ndarray | None:
    """How often each hash of a 1- to 4-gram occurs in the whole text; None if it has no letter.

    A gram is counted where it ends; three marks before the text complete the first ones. Stretches carry the last
    three characters over, so their length does not show in the result.
    """
    low, n, met = text.lower() + " ", np.zeros(DIM, np.int64), False
    before = np.array([0, 0, SPACE], np.uint32)
    for at in range(0, len(low), stretch):
        codes = np.frombuffer(low[at : at + stretch].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
        letter = letters()[codes]
        met = met or bool(letter.any())
        follows = np.concatenate(([before[-1] != SPACE], letter[:-1]))
        codes = np.concatenate((before, np.where(letter, codes, np.uint32(SPACE))[letter | follows]))
        if len(codes) == 3:
            continue
        rolled = np.zeros(len(codes) - 3, np.uint32)
        for k in range(4):
            rolled = rolled + codes[3 - k : len(codes) - k] * np.uint32(pow(int(STEP), k, 1 << 32))
            n += np.bincount(rolled * SPREAD[k] >> np.uint32(32 - BITS), minlength=DIM)
        before = codes[-3:]
    return n if met else None


def vector(n: np.ndarray) -> np.ndarray:
    return np.sqrt(n / n.sum())


def linear_svm(x: np.ndarray, y: np.ndarray, rounds: int = 20, c: float = 10.0, seed: int = 1) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1-loss linear SVM on rows ``x`` with ``y`` in {-1, 1}; returns weights and bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    alpha, w, rng = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(seed)
    norm = (x * x).sum(1)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1
            a = min(max(alpha[i] - g / norm[i], 0.0), c)
            if a != alpha[i]:
                w += (a - alpha[i]) * y[i] * x[i]
                alpha[i] = a
    return w[:-1], float(w[-1])


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]  # one-versus-one inside a family
    weights: np.ndarray  # a column for each family, then for each pair
    bias: np.ndarray

    def decide(self, v: np.ndarray) -> tuple[str, float]:
        """Language and confidence from the decision values of all machines: family first, then votes inside it."""
        n = len(self.families)
        f = int(np.argmax(v[:n])) if n > 1 else 0
        sure = 1 / (1 + np.exp(-np.clip(2 * (v[f] - np.delete(v[:n], f).max()) if n > 1 else 8.0, -30, 30)))
        members = [x for x in self.langs if FAMILY.get(x, x) == self.families[f]]
        votes = dict.fromkeys(members, 0.0)
        margin = dict.fromkeys(members, 8.0)
        for (a, b), d in zip(self.pairs, v[n:], strict=True):
            if a in votes:
                votes[a if d >= 0 else b] += 1
                margin[a], margin[b] = min(margin[a], d), min(margin[b], -d)
        best = max(members, key=lambda x: (votes[x], margin[x], x))
        return best, float(sure / (1 + np.exp(-np.clip(2 * margin[best], -30, 30))))


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_per_lang: int = SAMPLE_PER_LANG, sample_total: int = SAMPLE_TOTAL) -> Model | None:
    """Learn from at most ``sample_per_lang`` documents of each non-null language; None if no labelled row has a letter.

    Where ``sample_total`` does not hold so many of every language, each gets an equal part of it, 8 at least. The
    sample (smallest hashes of the id) is turned into vectors in Spark tasks; only these reach the driver.
    """
    labelled = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    # a hash cut per language that leaves a little more than the sample, from counts: no sort over all rows
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    size = min(sample_per_lang, max(8, sample_total // len(counts)))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, (1.2 * size + 40) / n))]), F.col("lang"))
    near = labelled.filter(spot < share)
    first = Window.partitionBy("lang").orderBy(spot, "doc_id", F.xxhash64("text"))
    sample = near.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= size).select("text", "lang", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                found = [gram_counts(text) for text in texts_of(part.column(0))]
                vectors = [None if n is None else vector(n).astype(np.float32).tobytes() for n in found]
                yield pa.RecordBatch.from_arrays([pa.array(vectors, pa.binary()), part.column(1), part.column(2)], ["v", "lang", "place"])

    rows = sample.mapInArrow(run, "v binary, lang string, place int").filter("v is not null").collect()
    rows.sort(key=lambda r: (r["lang"], r["place"]))
    return train([np.frombuffer(r["v"], np.float32) for r in rows], [r["lang"] for r in rows])


def train(vectors: list[np.ndarray], labels: list[str]) -> Model | None:
    if not vectors:
        return None
    x, y = np.stack(vectors).astype(np.float64), np.array(labels)
    langs = sorted(set(labels))
    fam = np.array([FAMILY.get(v, v) for v in y])
    families = sorted(set(fam))
    pairs = [(a, b) for f in families for a, b in combinations([v for v in langs if FAMILY.get(v, v) == f], 2)]
    machines = [linear_svm(x, np.where(fam == f, 1.0, -1.0)) if len(families) > 1 else (np.zeros(DIM), 0.0) for f in families]
    for a, b in pairs:
        at = (y == a) | (y == b)
        machines.append(linear_svm(x[at], np.where(y[at] == a, 1.0, -1.0)))
    return Model(langs, families, pairs, np.stack([m[0] for m in machines], 1), np.array([m[1] for m in machines]))


def judge(text: str, model: Model | None) -> tuple[str, float]:
    n = gram_counts(text) if model else None
    return ("und", 0.0) if n is None else model.decide(vector(n) @ model.weights + model.bias)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two columns added: lang_pred (``und`` if the text is null or has no letter, or nothing was learned) and score from 0 to 1.

    Whole texts, narrow, one pass; equal texts get equal values. Columns of ``docs`` that have the names of the new
    ones are left out; choose other names to keep them.
    """
    kept = [F.col(c) for c in docs.columns if c not in (lang_pred, score)]
    source = docs.select(F.col(text_col).cast("string").alias("#text"), *kept)
    schema = StructType([*source.schema.fields[1:]]).add(lang_pred, StringType()).add(score, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                told = [judge(text, model) for text in texts_of(part.column(0))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64())], schema.names)

    return source.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows kept from learning: CRC-32 of the id's decimal text, modulo 4, is 2; a row without an id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
