"""The corpus pipeline: language ID, near-duplicate removal, repeated-passage removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrack.llm import jaccard, langid, packing, suffix_dedup
from kinetrack.llm.common import row_keys, save
from kinetrack.llm.queries import tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told (``und`` goes: no text, or no letter in it); ``lang`` is filled where it is null."""
    model = langid.fit(docs.filter(~langid.held_out()), "doc_id", "text", "lang")

    # the prediction rides along with the row, in one pass: narrow, no join
    told = langid.predict(docs, model, lang_pred="#lang", score="#score").filter(F.col("#lang") != "und")
    return told.withColumn("lang", F.coalesce("lang", "#lang")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of n-gram Jaccard links stays: the one with the smallest id.

    Rows that share an id are judged by their texts like any others: unlike ones stay, of equal or near ones (with a
    text) one stays. A row without an id joins no group and stays.
    """
    named = row_keys(docs.filter("doc_id is not null"))
    keep = jaccard.jaccard_groups(named, "#row").filter("doc_id = component_id").select(F.col("doc_id").alias("#row"))
    return named.join(keep, "#row", "left_semi").select(*docs.columns).union(docs.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 200-byte strings; documents of which nothing is left go.

    A cut inside a multi-byte character takes the rest of that character with it. ``n_chars`` is counted anew.
    Each row counts for itself, with an id, without one or with one that other rows have too, and loses only what its
    own text repeats. Rows whose text is null or empty have nothing to lose and stay as they are.
    """
    keyed = row_keys(docs)
    whole = suffix_dedup.without_repeats(keyed.filter("text <> ''").select(F.col("#row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "#row")
    rest = keyed.select("#row", *[c for c in docs.columns if c not in ("text", "n_chars")])
    told = rest.join(whole, "#row").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
    return told.union(docs.filter("text is null or text = ''"))


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", curve_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned languages, set similarity by shingles and tokenizer ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None
