"""Fill-in-middle against a direct rearrangement of lines."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from kinetrack.llm import fim

SCHEMA = "doc_id long, text string, n long, form string, output string"


def direct(name, text, rate=100, spm_rate=50, seed=7):
    """The contract, word for word, on code points."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts():
    rng = random.Random(5)
    out = [None, "", "\n", "\n\n\n", "one", "one\n", "\none", "<P>", "a<S>b", "x<M", "<P\n>", "<", "<S", "é\nü\n\U0001f600", "a\r\nb\x85c d\n"]
    out += ["".join(rng.choice("ab é<PSM>\n\U0001f600") for _ in range(rng.randrange(400))) for _ in range(300)]
    passage = "\n".join("".join(rng.choice("abcdefgh ü") for _ in range(rng.randrange(90))) for _ in range(200))
    out += [f"{k}\n{passage}\n{rng.random()}" * (1 + k % 3) for k in range(12)]
    long = "\n".join("".join(rng.choices("lorem ipsum é", k=70)) for _ in range(6000))
    return [*out, long, long[:300_000] + "<M>" + long, "x" * 300_000, "\n" * 200_000, "<S" * 30_000]


def test_fill_in_middle(spark, sf_dir):
    texts = odd_texts()
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a\nb\nc"), (None, "a\nb\nc"), (4, "one\ntwo\n"), (4, "one\ntwo\n")]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = spark.createDataFrame([(k, t, 5, "form", "x") for k, t in rows], SCHEMA).repartition(4)
    for rate, spm_rate, seed in ((100, 50, 7), (40, 30, 11)):
        got = fim.fill_in_middle(docs, rate, spm_rate, seed).withColumn("back", fim.restored()).collect()
        want = sorted((repr((k, *direct(k, t, rate, spm_rate, seed), t or "")) for k, t in rows))
        assert sorted(repr(tuple(r)) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    empty = fim.fill_in_middle(docs.limit(0))
    assert empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and empty.count() == 0


def test_other_marks(spark):
    text = "one\n<P> two\nthree é\nfour\n" * 9
    docs = spark.createDataFrame([(k, text) for k in range(60)], "doc_id long, text string")
    got = fim.fill_in_middle(docs, marks=("{a}", "{b}", "{c}")).select("form", fim.restored(marks=("{a}", "{b}", "{c}")).alias("back")).collect()
    assert {r.form for r in got} == {"psm", "spm"} and {r.back for r in got} == {text}


def test_query_digests(spark, sf_dir):
    from kinetrack.llm import queries

    got = {r.doc_id: r for r in queries.op12_fill_in_middle(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n, form, prefix, middle, output = direct(r.doc_id, r.text)
        assert got[r.doc_id][:5] == (r.doc_id, n, form, prefix, middle)
        assert got[r.doc_id].output_sha256 == hashlib.sha256(output.encode()).hexdigest() and got[r.doc_id].restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_borders_follow_content(monkeypatch):
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 123, 40_000, np.uint8)
    a, b = (np.concatenate([rng.integers(97, 123, k, np.uint8), passage]) for k in (1000, 3777))
    cuts = [{end - k for end in fim.chunks(x, 0, len(x)) if end > k} for x, k in ((a, 1000), (b, 3777))]
    assert len(cuts[0] & cuts[1]) >= 0.9 * len(cuts[0])  # shared bytes, shared chunks
    whole = fim.chunks(a, 0, len(a))
    monkeypatch.setattr(fim, "STRETCH", 97)
    assert fim.chunks(a, 0, len(a)) == whole
    sizes = np.diff([0, *whole])
    assert sizes[:-1].min() >= fim.LEAST and sizes.max() <= fim.MOST


def test_a_full_cache_changes_nothing():
    """Summaries that were dropped are made again, with the same results."""
    tight = fim.ChunkCache(limit=1000)
    texts = [t.encode() for t in odd_texts()[1:60]]
    wide = fim.ChunkCache()
    for _ in range(2):
        for k, t in enumerate(texts):
            assert fim.rearranged(k, t, tight, 100, 50, 7) == fim.rearranged(k, t, wide, 100, 50, 7)
    assert len(tight.new) < len(wide.new)


def test_rows_of_the_query_cover_nulls(spark):
    docs = spark.createDataFrame([(None, None), (1, None)], "doc_id long, text string")
    rows = fim.fill_in_middle(docs).select("doc_id", "n", "form", "output", F.col("prefix_chars").isNull().alias("none")).collect()
    assert sorted(map(repr, map(tuple, rows))) == ["(1, 0, 'plain', '', True)", "(None, 0, 'plain', '', True)"]
