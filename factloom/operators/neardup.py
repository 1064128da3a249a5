"""Near-duplicate pairs and clusters over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.errors import INVALID_INPUT, RequestError, expected
from factloom.operators.components import connected_components
from factloom.operators.knn import BLOCK_ROWS, knn_join
from factloom.operators.predicates import active
from factloom.operators.skew import join_unique
from factloom.session import cut_lineage, shuffle_partitions


def near_duplicate_pairs(memories: DataFrame, as_of, threshold: float = S.NEAR_DUP_THRESHOLD,
                         k: int = S.NEAR_DUP_TOP_K, strategy: str = "auto",
                         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`user_id, id_a, id_b, similarity`: pairs of active rows of one user where either row has the
    other among its k nearest, at `threshold` or above.

    Rows with one and the same vector are compared once: a group of copies is one row in
    the kNN join and each copy then takes its partners from the group's short list. So a
    vector that a third of the table shares costs no more than any other.
    """
    if not 0.5 <= threshold <= 1.0:
        raise RequestError(INVALID_INPUT, expected("threshold", "a number from 0.5 to 1", threshold))
    rows = (memories.filter(active(as_of) & F.col("embedding").isNotNull()
                            & F.exists("embedding", lambda x: x != 0))
            .select("id", "user_id", F.col("embedding").alias("vec")))
    # Two 64-bit hashes stand for the vector, so grouping copies moves no vectors.
    thin = rows.select("id", "user_id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("copy"), "vec").alias("h2"))
    same = ["user_id", "h1", "h2"]
    # A group needs only its k+1 lowest ids: no row can have more partners in it.
    lowest = W.partitionBy(*same).orderBy("id")
    heads = (thin.withColumn("r", F.row_number().over(lowest)).filter(F.col("r") <= k + 1)
             .groupBy(*same).agg(F.sort_array(F.collect_list("id")).alias("ids")))
    copies = thin.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"))
    groups = cut_lineage(heads.join(copies, same))

    # The one shuffle of vectors. Scoring needs many tasks, so its partitions are not to be merged by size.
    spread = rows.repartition(shuffle_partitions(memories.sparkSession), "id")
    reps = cut_lineage(spread.join(groups.select(F.col("rep").alias("id")), "id", "left_semi"))
    q = reps.select(F.col("id").alias("query_id"), F.col("user_id").alias("part"), "vec",
                    F.lit(float(threshold)).alias("floor"))
    base = reps.select("id", F.col("user_id").alias("part"), "vec")
    near = cut_lineage(knn_join(q, base, k, exclude_self=True, strategy=strategy, block_rows=block_rows))

    own = groups.filter(F.col("n") > 1).select(
        F.col("rep").alias("query_id"), F.lit(1.0).cast("double").alias("score"), F.explode("ids").alias("id"))
    others = (join_unique(near.withColumnRenamed("id", "rep"), groups.select("rep", "ids"), ["rep"], "query_id")
              .select("query_id", "score", F.explode("ids").alias("id")))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    short_list = (own.unionByName(others).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
                  .groupBy(F.col("query_id").alias("rep"))
                  .agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("partners")))
    listed = cut_lineage(groups.join(short_list, "rep").select(*same, "n", "partners"))

    members = join_unique(thin, listed, same, "id", weight="n").filter("partners is not null")
    partners = F.slice(F.filter("partners", lambda p: p["id"] != F.col("id")), 1, k)
    pairs = members.select("user_id", "id", F.explode(partners).alias("p"))
    return (pairs.groupBy("user_id", F.least("id", "p.id").alias("id_a"), F.greatest("id", "p.id").alias("id_b"))
            .agg(F.max("p.score").alias("similarity")))


def near_duplicate_clusters(memories: DataFrame, as_of, threshold: float | None = None,
                            max_groups: int | None = None, strategy: str = "auto",
                            members: bool = True) -> DataFrame:
    """Groups of rows linked by near-duplicate pairs, strongest first.

    `cluster_id` (least id), `max_similarity`, `pair_count`, `rank`, `total_pairs` (over all
    clusters, before the cut to `max_groups`), and with `members` one row per `id` of a kept
    cluster. Equal similarities are ordered by cluster id. Whatever the size of a cluster,
    its members stay rows and are never gathered into one value.
    """
    threshold = S.NEAR_DUP_THRESHOLD if threshold is None else threshold
    max_groups = S.NEAR_DUP_GROUPS if max_groups is None else max_groups
    if not 1 <= max_groups <= S.MAX_NEAR_DUP_GROUPS:
        raise RequestError(INVALID_INPUT, expected("max_groups", f"a number from 1 to {S.MAX_NEAR_DUP_GROUPS}", max_groups))
    pairs = cut_lineage(near_duplicate_pairs(memories, as_of, threshold, strategy=strategy))
    labels = connected_components(pairs)
    by_pair = join_unique(pairs.select(F.col("id_a").alias("id"), "similarity"), labels, ["id"], "id")
    groups = by_pair.groupBy(F.col("label").alias("cluster_id")).agg(
        F.max("similarity").alias("max_similarity"), F.count(F.lit(1)).alias("pair_count"))
    total = pairs.agg(F.count(F.lit(1)).alias("total_pairs"))
    kept = groups.orderBy(F.desc("max_similarity"), "cluster_id").limit(max_groups)
    kept = kept.withColumn("rank", F.row_number().over(W.orderBy(F.desc("max_similarity"), "cluster_id")))
    kept = kept.withColumn("total_pairs", total.scalar())
    if not members:
        return kept
    return labels.join(F.broadcast(kept), labels["label"] == kept["cluster_id"]).select(   # at most 500 clusters
        "cluster_id", "rank", "max_similarity", "pair_count", "total_pairs", "id")
