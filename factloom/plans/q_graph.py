"""Registered queries: joins from the foreign-key graph of the star schema."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.reports import page
from factloom.plans.autojoin import (Join, all_of, any_of, auto_join, where_exists, where_in, where_not_exists,
                                     where_not_in)
from factloom.plans.fkgraph import FkGraph
from factloom.plans.registry import read, register
from factloom.session import scratch_path

STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def star_graph() -> FkGraph:
    return (FkGraph()
            .add("nation", "n_regionkey", "region", "r_regionkey")
            .add("customer", "c_nationkey", "nation", "n_nationkey")
            .add("supplier", "s_nationkey", "nation", "n_nationkey")
            .add("orders", "o_custkey", "customer", "c_custkey")
            .add("lineitem", "l_orderkey", "orders", "o_orderkey")
            .add("lineitem", "l_partkey", "part", "p_partkey")
            .add("lineitem", "l_suppkey", "supplier", "s_suppkey"))


def star(spark, sf_dir):
    return {t: read(spark, sf_dir, t) for t in STAR + ["documents", "labels"]}


_TO_NATION = "orders>customer customer>nation"
_PATHS = [      # the shortest ways, written down by hand
    ("customer", "lineitem", "orders>customer lineitem>orders"), ("customer", "nation", "customer>nation"),
    ("customer", "orders", "orders>customer"), ("customer", "part", "orders>customer lineitem>orders lineitem>part"),
    ("customer", "region", "customer>nation nation>region"), ("customer", "supplier", "customer>nation supplier>nation"),
    ("lineitem", "nation", "lineitem>supplier supplier>nation"), ("lineitem", "orders", "lineitem>orders"),
    ("lineitem", "part", "lineitem>part"), ("lineitem", "region", "lineitem>supplier supplier>nation nation>region"),
    ("lineitem", "supplier", "lineitem>supplier"), ("nation", "orders", "customer>nation orders>customer"),
    ("nation", "part", "supplier>nation lineitem>supplier lineitem>part"), ("nation", "region", "nation>region"),
    ("nation", "supplier", "supplier>nation"), ("orders", "part", "lineitem>orders lineitem>part"),
    ("orders", "region", _TO_NATION + " nation>region"), ("orders", "supplier", "lineitem>orders lineitem>supplier"),
    ("part", "region", "lineitem>part lineitem>supplier supplier>nation nation>region"),
    ("part", "supplier", "lineitem>part lineitem>supplier"), ("region", "supplier", "nation>region supplier>nation")]


_KEYS = {      # what equals what on each edge
    "nation>region": "n_regionkey = r_regionkey", "customer>nation": "c_nationkey = n_nationkey", "supplier>nation": "s_nationkey = n_nationkey",
    "orders>customer": "o_custkey = c_custkey", "lineitem>orders": "l_orderkey = o_orderkey", "lineitem>part": "l_partkey = p_partkey",
    "lineitem>supplier": "l_suppkey = s_suppkey"}


def _path_sql(a: str, b: str, path: str) -> str:
    joined = sorted({t for edge in path.split() for t in edge.split(">")})
    return (f"SELECT '{a}' AS a, '{b}' AS b, '{path}' AS path, count(*) AS rows FROM {', '.join(joined)} "
            f"WHERE {' AND '.join(_KEYS[e] for e in path.split())}")


@register(" UNION ALL ".join(_path_sql(*row) for row in _PATHS))
def join_path(spark, sf_dir):
    """The edges between each pair of tables, and the rows of the join along them."""
    tables, graph, found = star(spark, sf_dir), star_graph(), None
    for a in STAR:
        for b in STAR:
            if a < b:
                path = " ".join(f"{e.from_table}>{e.to_table}" for e in graph.join_path([a, b]))
                joined = auto_join(tables, graph, [f"{t}.{tables[t].columns[0]}" for t in (a, b)])
                r = joined.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(path).alias("path"), "rows")
                found = r if found is None else found.unionByName(r)
    return found


@register("""SELECT c_name, r_name, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_totalprice > 300000""")
def auto_join_inner(spark, sf_dir):
    df = auto_join(star(spark, sf_dir), star_graph(), ["customer.c_name", "region.r_name", "orders.o_orderkey"],
                   "orders.o_totalprice > 300000")
    return df.select("customer.c_name", "region.r_name", "orders.o_orderkey", F.round("orders.o_totalprice", 2).alias("o_totalprice"))


@register("""SELECT n_name, s_name FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s
ON s_nationkey = n_nationkey""")
def left_override(spark, sf_dir):
    tables = star(spark, sf_dir)
    tables["supplier"] = tables["supplier"].filter("s_acctbal > 5000")
    df = auto_join(tables, star_graph(), ["nation.n_name", "supplier.s_name"], left=("supplier",))
    return df.select("n_name", "s_name")


@register("""SELECT c_name, n_name FROM (SELECT * FROM customer WHERE c_acctbal > 9000) c RIGHT JOIN nation
ON c_nationkey = n_nationkey""")
def right_override(spark, sf_dir):
    tables = star(spark, sf_dir)
    tables["customer"] = tables["customer"].filter("c_acctbal > 9000")
    df = auto_join(tables, star_graph(), ["customer.c_name", "nation.n_name"], right=("nation",))
    return df.select("c_name", "n_name")


@register("""SELECT d.doc_id, lang, l.quality, l2.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
JOIN labels l2 ON d.n_chars = l2.doc_id AND d.doc_id >= 0""")
def explicit_join(spark, sf_dir):
    df = auto_join(star(spark, sf_dir), star_graph(), ["documents.doc_id", "documents.lang"], joins=[
        Join("documents", "doc_id", "labels", "doc_id", "left", "l"),
        Join("documents", "n_chars", "labels", "doc_id", "inner", "l2")])
    return df.select("documents.doc_id", "lang", "l.quality", "l2.toxic")


@register("""SELECT c.c_custkey, p.c_name AS previous_name, n.n_name FROM customer c JOIN customer p ON c.c_nationkey = p.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def self_join_alias(spark, sf_dir):
    df = auto_join(star(spark, sf_dir), star_graph(), ["c.c_custkey", "n.n_name"], aliases={"customer": "c", "nation": "n"},
                   joins=[Join("customer", "c_nationkey", "customer", "c_custkey", alias="p")])
    return df.select("c.c_custkey", F.col("p.c_name").alias("previous_name"), "n.n_name")


@register("""WITH ship AS (SELECT l_orderkey AS o, l_linenumber AS n, count(*) AS copies FROM lineitem GROUP BY 1, 2)
SELECT copies, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN ship ON l_orderkey = o AND l_linenumber = n
GROUP BY copies""")
def composite_key(spark, sf_dir):
    tables = star(spark, sf_dir)
    tables["ship"] = tables["lineitem"].groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(
        F.count(F.lit(1)).alias("copies"))
    graph = star_graph().add("lineitem", ("l_orderkey", "l_linenumber"), "ship", ("o", "n"))
    df = auto_join(tables, graph, ["lineitem.l_quantity", "ship.copies"])
    return df.groupBy("copies").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@register("""SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' AND (c_mktsegment = 'BUILDING' OR (o_totalprice > 400000 AND c_acctbal < 0) OR o_orderpriority LIKE '1.%')""")
def where_tree(spark, sf_dir):
    cond = all_of("orders.o_orderstatus = 'F'", all_of(), any_of(
        "customer.c_mktsegment = 'BUILDING'", any_of(),
        all_of("orders.o_totalprice > 400000", "customer.c_acctbal < 0"),
        any_of("orders.o_orderpriority like '1.%'")))
    df = auto_join(star(spark, sf_dir), star_graph(), ["orders.o_orderkey", "customer.c_name"], cond)
    return df.select("o_orderkey", "c_name")


@register("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""")
def where_in_subquery(spark, sf_dir):
    t = star(spark, sf_dir)
    return where_in(t["customer"], "c_custkey", t["orders"].filter("o_totalprice > 450000"), "o_custkey").select("c_custkey")


_NULLABLE = "(SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN n_chars END AS k FROM documents)"


@register(f"""SELECT 'plain' AS kind, doc_id FROM {_NULLABLE} WHERE k NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'with null', doc_id FROM {_NULLABLE} WHERE k NOT IN (SELECT CASE WHEN toxic = 0 THEN doc_id END FROM labels)
UNION ALL SELECT 'empty', doc_id FROM {_NULLABLE} WHERE k NOT IN (SELECT doc_id FROM labels WHERE toxic > 5)""")
def where_not_in_subquery(spark, sf_dir):
    t = star(spark, sf_dir)
    docs = t["documents"].select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("n_chars")).alias("k"))
    labels = t["labels"].select(F.col("doc_id").alias("d"), "toxic")
    subs = {"plain": labels, "with null": labels.select(F.when(F.col("toxic") == 0, F.col("d")).alias("d")),
            "empty": labels.filter("toxic > 5")}
    out = None
    for kind, sub in subs.items():
        r = where_not_in(docs, "k", sub, "d").select(F.lit(kind).alias("kind"), "doc_id")
        out = r if out is None else out.unionByName(r)
    return out


@register("""SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)""")
def where_exists_subquery(spark, sf_dir):
    t = star(spark, sf_dir)
    sub = t["lineitem"].filter("l_quantity >= 50")
    return where_exists(t["supplier"], sub, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey")


@register("""SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def where_not_exists_subquery(spark, sf_dir):
    t = star(spark, sf_dir)
    labels = t["labels"].select(F.col("doc_id").alias("labelled"))
    return where_not_exists(t["documents"], labels, F.col("doc_id") == F.col("labelled")).select("doc_id", "lang")


@register("""SELECT count(*) AS n, count(c_acctbal) AS n_balance, round(sum(l_quantity), 2) AS quantity,
  round(avg(l_discount), 6) AS avg_discount, min(c_name) AS first_name, max(l_extendedprice) AS top_price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def aggregates(spark, sf_dir):
    df = auto_join(star(spark, sf_dir), star_graph(), ["lineitem.l_quantity", "customer.c_acctbal"])
    return df.agg(F.count(F.lit(1)).alias("n"), F.count("c_acctbal").alias("n_balance"),
                  F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("avg_discount"),
                  F.min("c_name").alias("first_name"), F.max("l_extendedprice").alias("top_price"))


@register("""SELECT n_name, p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
GROUP BY n_name, p_brand HAVING count(*) > 20 AND avg(l_quantity) > 24""")
def group_by_having(spark, sf_dir):
    df = auto_join(star(spark, sf_dir), star_graph(), ["nation.n_name", "part.p_brand", "lineitem.l_quantity", "supplier.s_suppkey"])
    grouped = df.groupBy("n_name", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"),
                                                  F.avg("l_quantity").alias("q"))
    return grouped.filter("n > 20 and q > 24").drop("q")


@register("""SELECT DISTINCT n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def select_distinct(spark, sf_dir):
    df = auto_join(star(spark, sf_dir), star_graph(), ["nation.n_name", "customer.c_mktsegment"])
    return df.select("n_name", "c_mktsegment").distinct()


@register("""SELECT r_name, c_custkey, c_acctbal, CAST(row_number() OVER (ORDER BY r_name, c_acctbal DESC, c_custkey) AS INTEGER) AS place
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
ORDER BY r_name, c_acctbal DESC, c_custkey LIMIT 100""")
def order_by_limit(spark, sf_dir):
    df = auto_join(star(spark, sf_dir), star_graph(), ["customer.c_custkey", "region.r_name"])
    top = df.orderBy("r_name", F.desc("c_acctbal"), "c_custkey").limit(100).select("r_name", "c_custkey", "c_acctbal")
    return top.withColumn("place", F.row_number().over(W.orderBy("r_name", F.desc("c_acctbal"), "c_custkey")))


@register("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 75""")
def page_of_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return page(rows, 3, 25).select("o_orderkey", "o_totalprice")


@register("""SELECT s_nationkey AS nationkey, 'supplier' AS kind FROM supplier WHERE s_acctbal > 8000
UNION SELECT c_nationkey, 'customer' FROM customer WHERE c_acctbal > 9000 UNION SELECT n_nationkey, 'nation' FROM nation""")
def union_distinct(spark, sf_dir):
    return _union_arms(spark, sf_dir).distinct()


@register("""SELECT s_nationkey AS nationkey, 'supplier' AS kind FROM supplier WHERE s_acctbal > 8000
UNION ALL SELECT c_nationkey, 'customer' FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT n_nationkey, 'nation' FROM nation
ORDER BY 1, 2""")
def union_all(spark, sf_dir):
    return _union_arms(spark, sf_dir).orderBy("nationkey", "kind")


def _union_arms(spark, sf_dir):
    t = star(spark, sf_dir)
    arms = [t["supplier"].filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("nationkey"), F.lit("supplier").alias("kind")),
            t["customer"].filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey"), F.lit("customer").alias("kind")),
            t["nation"].select(F.col("n_nationkey").alias("nationkey"), F.lit("nation").alias("kind"))]
    return arms[0].unionByName(arms[1]).unionByName(arms[2])


@register("""WITH big AS (SELECT o_custkey AS custkey, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey
  HAVING sum(o_totalprice) > 2000000),
rich AS (SELECT custkey AS rich_key FROM big JOIN customer ON c_custkey = custkey WHERE c_acctbal > 0)
SELECT c_name, n_name, round(spent, 2) AS spent FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN big ON custkey = c_custkey JOIN rich ON rich_key = c_custkey""")
def named_subqueries(spark, sf_dir):
    t = star(spark, sf_dir)
    t["big"] = (t["orders"].groupBy(F.col("o_custkey").alias("custkey")).agg(F.sum("o_totalprice").alias("spent"))
                .filter("spent > 2000000"))
    t["rich"] = t["big"].join(t["customer"], F.col("custkey") == F.col("c_custkey")).filter("c_acctbal > 0").select(
        F.col("custkey").alias("rich_key"))
    df = auto_join(t, star_graph(), ["customer.c_name", "nation.n_name", "big.spent"], joins=[
        Join("customer", "c_custkey", "big", "custkey"), Join("customer", "c_custkey", "rich", "rich_key")])
    return df.select("c_name", "n_name", F.round("spent", 2).alias("spent"))


@register("""SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def saved_graph(spark, sf_dir):
    """The graph written as a table, read back and used."""
    path = scratch_path(spark, "graph")
    star_graph().save(spark, path)
    graph = FkGraph.load(spark, path)
    df = auto_join(star(spark, sf_dir), graph, ["part.p_brand", "lineitem.l_orderkey"])
    return df.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
