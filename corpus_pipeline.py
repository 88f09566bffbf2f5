"""Corpus pipeline: toxicity, near duplicates, repeated passages, source mix, packing, over the documents table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result to the shared folder and reads
it again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpref.llm import mixing, near_dedup, packing, queries, substring_dedup, toxicity
from cohortpref.llm.common import Aside
from cohortpref.session import snapshot


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; the model learns from the labels of these documents."""
    aside = Aside(docs, ("doc_id", "text"))
    model = toxicity.fit(aside.rows, queries.labels(spark, sf_dir))
    scored = toxicity.score(aside.rows, model, aside.keep, "toxicity")
    return aside.back(scored.where(F.col("toxicity") < toxicity.THRESHOLD))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (five-word shingles, similarity 0.8): the one of the smallest id."""
    aside = Aside(docs, ("doc_id", "text"))
    judged = near_dedup.near_duplicates(aside.rows).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return aside.back(aside.rows.join(judged, F.col("doc_id") == F.col("gone"), "left_anti"))


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words of repeated passages. A text that loses words becomes the words left, joined by
    one space; others stay as they are. A document that loses every word is dropped."""
    aside = Aside(docs, ("doc_id", "text", "n_chars"))
    left = substring_dedup.remove_repeats(aside.rows, aside.keep)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    out = left.where(~changed | (F.col("kept_text") != ""))
    n_chars = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return aside.back(out.withColumns({"text": text, "n_chars": n_chars}))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: each row once per pass (none to two)."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", remove_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# The stages learn, hash with functions SQL lacks and tokenise: the tests compare them with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = snapshot(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
