"""The registered queries of the operators here, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, embedding_dups, licenses, lines, mixing, ranked, secrets, simhash, suffixes, tokens, toxicity, trie, urls
from factloom.llm.common import read
from factloom.session import cut_lineage, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: three-word shingles, at most three differing bits."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    sizes, table = mixing.plan(read(spark, sf_dir, "documents"))
    return mixing.copies(sizes, table).select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                                              (F.col("copies") * F.col("size")).alias("taken"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and licence notices in every document."""
    return licenses.scan(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents, written and read back."""
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read_tokens(spark, path)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    return urls.judge(read(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that earlier documents hold."""
    kept = lines.drop_shared_lines(read(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    docs = read(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs)).withColumnRenamed("id", "doc_id")

    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "net")
    counts = [F.size(F.filter("spans", _is(kind))).cast("long").alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    return cut_lineage(found).select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that stand in windows of the benchmark."""
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op10_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings, by label."""
    found = embedding_dups.near_duplicates(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated strings."""
    kept = suffixes.drop_repeats(read(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for every item of the benchmark."""
    return ranked.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


for _query, _sql in ((op1_simhash, None), (op2_mixing, mixing.SQL), (op3_licenses, licenses.SQL), (op4_tokens, None),
                     (op5_url_filter, urls.SQL), (op6_line_dedup, lines.SQL),
                     (op7_secrets, None), (op8_decontamination, decontaminate.SQL), (op9_toxicity, None), (op10_embedding_dups, embedding_dups.SQL),
                     (op11_prefix_trie, trie.SQL), (op12_suffix_dedup, None), (op13_ranked_search, ranked.SQL),
                     (pipeline, corpus_pipeline.ORACLE_SQL)):
    QUERIES[_query.__name__] = _query
    if _sql is not None:
        ORACLES[_query.__name__] = _sql
