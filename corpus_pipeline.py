"""From raw documents to token files: the stages of a training corpus, each one job over what the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, mixing, shingles, tokens, toxicity
from factloom.llm.common import lookup, read, unused
from factloom.operators.skew import broadcast_if_small
from factloom.session import cut_lineage, scratch_path, working_copies

SHINGLE_WORDS = 5
SIMILARITY = 0.8          # of shingle sets: common shingles by all shingles
MAX_DISTANCE = 9          # of 64 bits: what fingerprints propose, where SIMILARITY decides
TABLES = 8                # fingerprints per document: what one table misses beyond three bits another one finds


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the limit. A null text counts as empty; rows are judged one by one."""
    net = toxicity.train(docs, read(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    return toxicity.score(docs, net, out=score).filter(F.col(score) < toxicity.REJECT).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates: the least id (null last), of one id the least text hash. Rows with one id and
    different texts are different documents; of rows that repeat id and text one stays."""
    rows = cut_lineage(shingles.near_duplicates(docs, shingle_words=SHINGLE_WORDS, least=SIMILARITY, max_distance=MAX_DISTANCE, tables=TABLES))
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "of")).alias("first"))
    named = lookup(rows, cut_lineage(first), ["label"], "of")
    key, of = unused(docs, "id"), unused(docs, "of")
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("of") == F.col("first.of"))
    ruled = cut_lineage(named.groupBy(F.col("id").alias(key), F.col("of").alias(of)).agg(F.min(stays).alias("stays"), F.count(F.lit(1)).alias("n"))
                        .filter("not stays or n > 1"))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (shingles.text_hash(F.col("text")) == F.col(of))
    single = docs.join(broadcast_if_small(ruled.select(key, of)), same, "left_anti")
    twice = docs.join(broadcast_if_small(ruled.filter("stays").select(key, of)), same, "left_semi")
    return single.unionByName(twice.dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    key, of = unused(docs, "id"), unused(docs, "of")
    bad = cut_lineage(found.filter("n_hit > 0").select(F.col("id").alias(key), F.col("of").alias(of)).distinct())
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(of))
    return docs.join(broadcast_if_small(bad), same, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them: not at all, or up to three times."""
    return mixing.mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row its place in the token files, its number of ids and their checksum, read back from the files."""
    path = scratch_path(spark, "corpus-tokens")
    tokens.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read_tokens(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_token_files),
]

#: The network, the fingerprints and the tokenizer have no SQL. The tests hold every stage against a plain version of its rule (toxicity: the same
#: network's scores row by row; mixing: its plan).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again; a stage's working copies go when it is stored."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with working_copies(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
