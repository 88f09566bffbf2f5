"""Registered queries of the text operators: each applies one operator to its whole table and returns its digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpref.llm import (
    collocations,
    fingerprints,
    importance,
    lm_scoring,
    mixing,
    near_dedup,
    packing,
    piece_encoding,
    quality_rules,
    substring_dedup,
    token_counts,
    toxicity,
    url_filters,
)
from cohortpref.llm.common import crc_remainder
from cohortpref.session import snapshot, work_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(documents(spark, sf_dir))


@query
def op2_quality_rules(spark, sf_dir):
    stats = snapshot(quality_rules.statistics(documents(spark, sf_dir)), "quality-statistics")
    rules = quality_rules.fit_decision_list(stats, labels(spark, sf_dir))
    return quality_rules.judge(stats, rules).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "rule")


@query
def op3_substring_dedup(spark, sf_dir):
    left = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op4_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=4)


@query
def op5_lm_scoring(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = crc_remainder(F.col("doc_id"), 10) == 0
    scored = lm_scoring.score(docs, ~held_out)
    return scored.withColumn("held_out", held_out).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]


@query
def op6_url_filters(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    judged = url_filters.judge_pages(pages, url_filters.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op7_token_counts(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path(), work_path(spark, "flat-tokens"))


@query
def op8_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


@query
def op9_mixing(spark, sf_dir):
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "passes")


@query
def op10_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = crc_remainder(F.col("doc_id"), 4) == 2
    learnt = labels(spark, sf_dir).where(~held_out)
    scored = toxicity.score(docs, toxicity.fit(docs, learnt))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op11_importance(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance.resample(documents(spark, sf_dir), benchmark).select("doc_id", "n_features", "weight", "score", "rank")


@query
def op12_collocations(spark, sf_dir):
    return collocations.collocations(documents(spark, sf_dir))


@query
def op13_piece_encoding(spark, sf_dir):
    model = piece_encoding.PieceModel(tokenizer_path("piece_bpe_32k.model"))
    made = model.round_trip(documents(spark, sf_dir))
    return made.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
