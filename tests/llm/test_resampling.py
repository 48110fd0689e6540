"""Importance resampling against a direct computation, and the selection against a sort."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from kinetrack.llm import queries, resampling

SCHEMA = "doc_id long, text string, score long, row long, low long, name string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, orders=2):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def direct(docs, target, percent=25, min_words=20, buckets=10_000, orders=2, seed=7):
    """Rows (doc_id, n_words, n_features, weight, score, rank); rows that tie in all share the ranks of their places."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    told = [(name, *features(t, orders)) for name, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in told for f in fs), Counter(bucket(f) for x in target for f in features(x, orders)[1])
    s_all, t_all = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    rows = []
    for name, words, fs in told:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        rows.append((name, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    rest = Counter(rows)
    rest.subtract(drawn)
    return [(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in rest.elements()]


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = random.Random(9)
    long = " ".join(t for _, t in docs[:70] if t)
    same = " ".join(f"w{k}" for k in range(30))
    docs += [(9000, None), (9001, ""), (9002, " \n--"), (9003, long), (9004, "x" * 300_000), (9005, "é" * 40_000 + " b"), (9006, "Éa ΣΑΣ x y 1,2.3 İI \x7f|")]
    docs += [(None, same)] * 3 + [(9010, same)] * 2 + [(20_000 + k, same) for k in range(40)]
    docs += [(9100 + k, "".join(rng.choice("aB9é ,-\n") for _ in range(rng.randrange(300)))) for k in range(80)]
    return docs, [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [None, "", same]


def frame(spark, docs):
    return spark.createDataFrame([(k, t, 1, 2, 3, "x") for k, t in docs], SCHEMA).repartition(6)


def test_resampling(spark, rows):
    docs, target = rows
    df, goal = frame(spark, docs), spark.createDataFrame([(t, 5) for t in target], "text string, rank int")
    for options in ({}, {"percent": 60, "min_words": 1, "buckets": 97, "orders": 3, "seed": 11}, {"orders": 1, "percent": 100}):
        got = resampling.resample(df, goal, tail=7, **options).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, direct(docs, target, **options)))


def test_edges(spark, rows):
    docs, target = rows
    df, none = frame(spark, docs), spark.createDataFrame([], "text string")
    got = resampling.resample(df, none).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, direct(docs, [])))
    assert resampling.resample(df.limit(0), none).count() == 0
    assert all(r["rank"] is None for r in resampling.resample(df.limit(9), none, percent=0).collect())


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {r[0]: (r[0], *r[2:]) for r in direct(docs, target)}
    assert {r.doc_id: tuple(r) for r in queries.op11_importance_resampling(spark, sf_dir).collect()} == want
    assert sum(r[4] is not None for r in want.values()) > 20


def test_long_texts_in_stretches(monkeypatch):
    text = ("The quick-brown fox 42 é\n" * 50 + "y" * 200 + " z").encode()
    whole = list(resampling.hashes(text, 3))
    for size in (1, 7, 64, 300):
        monkeypatch.setattr(resampling, "STRETCH", size)
        parts = list(resampling.hashes(text, 3))
        assert sum(n for n, _ in parts) == whole[0][0] and len(parts) > 1
        assert Counter(x for _, found in parts for x in found.tolist()) == Counter(whole[0][1].tolist())


def test_cutoff_like_a_sort(spark):
    rng = random.Random(1)
    keys = [(rng.randrange(5), rng.randrange(40), k) for k in range(3000)]
    df = spark.createDataFrame(keys, "low long, name long, row long").repartition(7)
    ordered = sorted(keys)
    for k in (1, 2, 750, 1501, 2999, 3000):
        assert tuple(resampling.cutoff(df, k, len(keys), tail=10)) == ordered[k - 1]
    lopsided = df.repartitionByRange(5, "low", "name", "row")  # every partition holds another range of keys
    assert tuple(resampling.cutoff(lopsided, 800, len(keys), tail=1)) == ordered[799]
