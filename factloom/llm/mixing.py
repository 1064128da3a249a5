"""Mixing sources to target weights by Pareto order sampling.

Every document of a source is taken a number of whole times for certain. What is left of the target goes to one copy more of some: a document's
inclusion probability falls with its length, by half for every four binary digits, and is scaled so that the expected words fill
what is left (shortest documents first where that makes them certain). Documents are ranked by their random odds over their inclusion odds,
and taken in that order until the words are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import SPACES, lookup, running_sums, words
from factloom.session import cut_lineage

WEIGHTS = (5, 2, 1)      # of the sources in their order, repeating
MAX_COPIES = 3
CLASSES = 8              # of length, four binary digits each


def word_count(text: Column) -> Column:
    return F.size(words(text, SPACES)).cast("long")


def random_odds(id_col: Column, of: Column) -> Column:
    """u / (1 - u) of a fixed hash of the id (of the text where there is none), so that reruns agree."""
    name = F.coalesce(id_col.cast("string"), F.concat(F.lit("null "), of.cast("string")))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return u / (F.lit(1.0) - u)


def shares(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """`source, source_size, target, whole, room` per source.

    Sources by code point, null last, weigh `weights`, repeating, and share the sum of all sizes; a target stops at `max_copies` times its
    source's size and the excess is shared again by weight. With sources by the ratio of cap to weight, exactly those before the first one
    that its share of the rest fits are capped. `whole` copies of every document are certain; `room` words are left for one more copy of some.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_sums(per.withColumn("one", F.lit(1).cast("long")), [F.asc_nulls_last("source")], {"rank": "one"})
    turn = ((F.col("rank") - 1) % len(weights)).cast("int")
    ranked = ranked.select("source", "source_size", F.get(F.array(*map(F.lit, weights)), turn).cast("long").alias("weight"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_copies).withColumn("ratio", F.col("cap") / F.col("weight"))
    summed = cut_lineage(running_sums(ranked, ["ratio", F.asc_nulls_last("source")], {"caps": "cap", "weights": "weight"}))
    total = summed.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    t, w = total.t or 0, total.w or 1
    left, over = t - (F.col("caps") - F.col("cap")), w - (F.col("weights") - F.col("weight"))
    first = (summed.select(F.struct(F.col("caps").alias("at"), F.col("weights").alias("w"), left.alias("left"), over.alias("over")).alias("x"),
                           (F.col("weight") * left / over <= F.col("cap")).alias("fits"))
             .filter("fits").agg(F.min("x").alias("x")).first().x)
    rest, by = (first.left, first.over) if first else (0, 1)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(rest).cast("long") / F.lit(by).cast("long"))
    out = summed.select("source", "source_size", target.alias("target"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return out.withColumn("whole", whole).withColumn("room", F.col("target") - F.col("whole") * F.col("source_size"))


def length_class(size: Column) -> Column:
    """Four binary digits of a size make a class; the last one holds all longer ones."""
    return F.least(F.floor(F.length(F.bin(size)) / 4), F.lit(CLASSES - 1)).cast("int")


def inclusion(sizes: DataFrame, table: DataFrame) -> DataFrame:
    """`source, p`: the inclusion probabilities of a source's classes of length, as an array.

    The weight of a class is half that of the class before it. Classes from the shortest on are certain as long as
    their probability would pass one; the others share what is left by weight. At most CLASSES rows per source.
    """
    words = sizes.groupBy("source", length_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    weight = F.pow(F.lit(2.0), F.lit(CLASSES - 1) - F.col("class"))
    rows = words.join(table.select(F.col("source").alias("s"), "room"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    upto, onward = W.partitionBy("source").orderBy("class").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("source").orderBy("class").rowsBetween(0, W.unboundedFollowing)
    certain = F.coalesce(F.sum("words").over(upto), F.lit(0))
    rows = rows.withColumn("weight", weight).withColumn("left", F.col("room") - certain).withColumn("rest", F.sum(F.col("words") * F.col("weight")).over(onward))
    fits = rows.filter((F.col("rest") > 0) & (F.col("left") * F.col("weight") <= F.col("rest")))
    first = fits.groupBy("source").agg(F.min(F.struct("class", (F.col("left") / F.col("rest")).alias("scale"))).alias("at"))
    p = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda c: F.when(c < F.col("at.class"), F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.col("at.scale") * F.pow(F.lit(2.0), F.lit(CLASSES - 1) - c))))
    return first.select("source", p.alias("p"))


def rank_key(odds: Column, p: Column) -> Column:
    """Random odds over inclusion odds: the least go first, the certain ones before all."""
    return F.when(p > 0, odds * (F.lit(1.0) - p) / p).otherwise(F.lit(float("inf")))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """`id, source, size, odds` per row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
                       word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("of"))
    return rows.select("id", "source", "size", random_odds(F.col("id"), F.col("of")).alias("odds"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> tuple[DataFrame, DataFrame]:
    """(`id, source, size, odds` per row, `source, source_size, target, whole, p, cut` per source).

    A row gets `whole` copies, and one more if struct(key, id, size) is at most its source's `cut`: in the order of the keys documents are taken while
    the middle of the next one lies within the room, so a source misses its target by at most half a document. Running sums of words go
    over range partitions of (source, key), so no source has to fit into one task.
    """
    sizes = cut_lineage(sized(docs, id_col, text_col, source_col))
    table = cut_lineage(shares(sizes, weights, max_copies))
    p = inclusion(sizes, table).select(F.col("source").alias("s"), "p")
    table = cut_lineage(table.join(p, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))
    order = [F.asc_nulls_last("source"), "key", F.asc_nulls_first("id"), "size"]
    before = running_sums(table.select("source", "source_size"), [F.asc_nulls_last("source")], {"end": "source_size"})
    starts = table.join(before.select(F.col("source").alias("s"), (F.col("end") - F.col("source_size")).alias("start")),
                        F.col("source").eqNullSafe(F.col("s"))).select("source", "start", "room", "p")
    keyed = _with_source(sizes, cut_lineage(starts)).withColumn("key", _key())
    inside = running_sums(keyed, order, {"upto": "size"}).filter(F.col("upto") - F.col("start") - F.col("size") / 2 <= F.col("room"))
    cuts = inside.filter("room > 0").groupBy("source").agg(F.max(F.struct("key", "id", "size")).alias("cut"))
    cuts = cuts.select(F.col("source").alias("s"), "cut")
    return sizes, cut_lineage(table.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "room"))


def _key() -> Column:
    return rank_key(F.col("odds"), F.coalesce(F.get(F.col("p"), length_class(F.col("size"))), F.lit(0.0)))


def _with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with their source's columns. Null is a source like any other; a hot source is spread by `lookup`."""
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    named = table.withColumn("_name", name).drop("source")
    return lookup(rows.withColumn("_name", name), named, ["_name"], "id").drop("_name")


def copies(rows: DataFrame, table: DataFrame) -> DataFrame:
    """`rows` (with id, source, size, odds) with `source_size, target` and the number of `copies` that the mix takes of each."""
    both = _with_source(rows, table).withColumn("key", _key())
    extra = F.coalesce(F.struct("key", "id", "size") <= F.col("cut"), F.lit(False)).cast("long")
    return both.withColumn("copies", F.col("whole") + extra).drop("whole", "cut", "p", "key")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """The mixed rows: each row of `docs`, all columns, as often as the mix takes it.

    A null source is a source of its own, after all others. A null or empty text has size zero; it takes part in the draw and
    costs nothing. Rows equal in id and size are taken together; rows with a null id are drawn by their texts, equal ones together. An
    empty table gives an empty table.
    """
    _, table = plan(docs, id_col, text_col, source_col, weights, max_copies)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"),
                       F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
                       random_odds(F.col(id_col).cast("long"), F.xxhash64(text_col)).alias("odds"))
    taken = copies(rows, table).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
odds AS (
  SELECT *, least(length(bin(size)) // 4, 7) AS class, u / (1.0::DOUBLE - u) AS odds FROM (
    SELECT *, (CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM sized)),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w FROM sized GROUP BY source),
summed AS (
  SELECT *, (sum(s) OVER ()) - (sum(3 * s) OVER o - 3 * s) AS rest, (sum(w) OVER ()) - (sum(w) OVER o - w) AS over_w, row_number() OVER o AS k
  FROM per WINDOW o AS (ORDER BY 3 * s::DOUBLE / w, source NULLS LAST)),
cut AS (SELECT rest, over_w FROM summed WHERE w * rest::DOUBLE / over_w <= 3 * s ORDER BY k LIMIT 1),
target AS (
  SELECT source, s AS source_size, least(3.0::DOUBLE * s, (w * (SELECT rest FROM cut))::DOUBLE / (SELECT over_w FROM cut)::DOUBLE) AS target FROM per),
room AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM target),
classes AS (
  SELECT o.source, o.class, any_value(r.target - r.whole * r.source_size) AS room, sum(o.size) AS words, power(2.0::DOUBLE, 7 - o.class) AS weight
  FROM odds o JOIN room r ON o.source IS NOT DISTINCT FROM r.source GROUP BY o.source, o.class),
filled AS (
  SELECT *, room - coalesce(sum(words) OVER (PARTITION BY source ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
    sum(words * weight) OVER (PARTITION BY source ORDER BY class ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM classes),
scale AS (
  SELECT source, class AS first, remains / rest AS scale FROM filled WHERE rest > 0 AND remains * weight <= rest
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY class) = 1),
chance AS (
  SELECT o.*, CASE WHEN s.first IS NULL THEN 0.0::DOUBLE WHEN o.class < s.first THEN 1.0::DOUBLE
    ELSE greatest(0.0::DOUBLE, s.scale * power(2.0::DOUBLE, 7 - o.class)) END AS p
  FROM odds o LEFT JOIN scale s ON o.source IS NOT DISTINCT FROM s.source),
keyed AS (SELECT *, CASE WHEN p > 0 THEN odds * (1.0::DOUBLE - p) / p ELSE 'inf'::DOUBLE END AS key FROM chance),
placed AS (
  SELECT k.doc_id, k.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS room,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN room r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN room > 0 AND upto - size / 2.0 <= room THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM placed
"""
