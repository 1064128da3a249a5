"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.skew import join_unique
from factloom.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """`id, label` for every node of the undirected edges (id_a, id_b); label is the least id reached.

    Alternates two steps that keep connectivity: every node hands its larger neighbours to the
    least id it knows, then its smaller ones. The edges become stars around the least ids in
    about as many rounds as the logarithm of the longest path, whatever the order of the ids. Minima
    are combined before each shuffle and the join back goes through `join_unique`, so the
    centre of a large star does not fill one task.
    """
    e = edges.select(F.greatest("id_a", "id_b").cast("long").alias("u"), F.least("id_a", "id_b").cast("long").alias("v"))
    alone = e.filter(F.col("u") == F.col("v")).select(F.col("u").alias("id"), F.col("u").alias("label"))
    e = cut_lineage(e.filter(F.col("u") != F.col("v")).distinct())
    alone, mark = cut_lineage(alone.distinct()), _mark(e)
    while mark[0]:
        e = cut_lineage(_to_least(_to_least(e, larger=True), larger=False))
        before, mark = mark, _mark(e)
        if before == mark:
            break
    labels = e.select(F.col("u").alias("id"), F.col("v").alias("label"))
    centres = labels.select(F.col("label").alias("id"), "label").distinct()
    found = cut_lineage(labels.unionByName(centres))
    return found.unionByName(alone.join(found, "id", "left_anti"))


def _to_least(e: DataFrame, larger: bool) -> DataFrame:
    """Edges u > v in, edges u > v out. With `larger` a node links its larger neighbours to the least
    id among itself and all neighbours, else itself and its smaller neighbours to the least of them."""
    if larger:
        turned = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        e = e.unionByName(turned)
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    least = cut_lineage(least.withColumn("m", F.least("u", "m")))
    seen = join_unique(e.withColumn("row", F.abs("v")), least, ["u"], "row", weight="n")
    if larger:
        return seen.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = seen.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    """Number and hash sum of the edges: unchanged when a round changed nothing."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
