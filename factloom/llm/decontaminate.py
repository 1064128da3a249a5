"""Benchmark decontamination by winnowing.

Every text keeps the least hash of the five-word grams in each window of six grams. Any ten words in a row that a document
shares with a benchmark item are one such window on both sides, so both keep the same hash of it: a shared
span of ten words is never missed. Documents whose hashes meet those of the benchmark are looked at again: a met hash is extended
to its window of ten words, which is compared with the items' windows word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import NOT_ALNUM, ascii_lower, let, lookup, words
from factloom.operators.skew import broadcast_if_small
from factloom.session import cut_lineage

WINDOW = 10          # words that make a hit: six grams of five words


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _winnowed(w: Column) -> Column:
    """For every window of ten words the least hash of its six grams of five words; null for a text of fewer words.

    Hashes of 2, 4 and 5 words and least ones of 2, 4 and 6 grams are made by pairing an array with itself, shifted, so a word costs
    six cheap steps. What pairing leaves behind the last window is cut off.
    """
    def pair(a: Column, b: Column, by: int) -> Column:
        return F.zip_with(a, _shifted(b, by), lambda x, y: F.xxhash64(x, y))

    def least(a: Column, by: int) -> Column:
        return F.zip_with(a, _shifted(a, by), lambda x, y: F.least(x, y))

    grams = let(F.transform(w, lambda x: F.xxhash64(x)), lambda one: let(
        pair(one, one, 1), lambda two: pair(let(two, lambda t: pair(t, t, 2)), one, 4)))
    pairs = let(grams, lambda g: least(g, 1))
    fours = let(pairs, lambda m: least(m, 2))
    sixes = let(fours, lambda m: least(m, 2))
    return F.when(F.size(w) >= WINDOW, F.slice(sixes, 1, F.size(w) - WINDOW + 1))


def _short_grams(w: Column, length: int) -> Column:
    """The hash of every `length` words, for items of fewer than ten; null for a text of fewer words."""
    return F.when(F.size(w) >= length, F.transform(
        F.sequence(F.lit(0), F.size(w) - length),
        lambda i: F.xxhash64(F.lit(length), *[F.get(w, i + k) for k in range(length)])))


def _windows(w: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(w, start + 1, length), " ")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """`id, of, n_words, n_hit, items` for every row of `docs`: words, words inside a window that occurs in an item,
    and the distinct ids of those items as sorted strings. `of` is a hash of the text.

    A window is ten words in a row of an item; an item of one to nine words is one window, met exactly through
    grams of its own length. Words are runs of letters and digits after A-Z are lower-cased. A null or empty text has no words and
    no hits; an item without words is never met; a met item with a null id counts its words but isn't listed. A repeated row of
    `docs` is returned as often as it occurs, and rows that share an id are judged each by its own text. Further columns are not read.
    """
    tests = items.select(F.col(item_col).cast("string").alias("item"),
                         words(ascii_lower(F.col(item_text)), NOT_ALNUM).alias("w")).filter(F.size("w") > 0)
    tests = cut_lineage(tests)
    short = [r.n for r in tests.filter(F.size("w") < WINDOW).select(F.size("w").alias("n")).distinct().collect()]  # 1 to 9
    n = F.least(F.size("w"), F.lit(WINDOW))
    of_items = tests.select("item", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("w") - n), lambda i: _windows(F.col("w"), i, n))).alias("window"))
    of_items = cut_lineage(of_items.distinct())
    own = F.when(F.size("w") >= WINDOW, _winnowed(F.col("w")))
    for length in short:
        own = own.when(F.size("w") == length, _short_grams(F.col("w"), length))
    test_grams = cut_lineage(tests.select(F.explode(own).alias("h")).distinct().withColumn("met", F.lit(True)))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("of"))
    split = rows.select("id", "of", words(ascii_lower(F.col("text")), NOT_ALNUM).alias("w"))
    none = F.array().cast("array<long>")
    hashes = [F.coalesce(_winnowed(F.col("w")), none), *[F.coalesce(_short_grams(F.col("w"), length), none) for length in short]]
    # A null goes along with a document's hashes, so that one pass gives its words and its number of rows as well.
    every = F.concat(F.array(F.lit(None).cast("long")), F.array_distinct(F.concat(*hashes)))
    spread = split.select("id", "of", F.size("w").cast("long").alias("n_words"), F.explode(every).alias("h"))
    met = lookup(spread, test_grams, ["h"], "of").filter("met or h is null")
    per_doc = cut_lineage(met.groupBy("id", "of").agg(
        F.max("n_words").alias("n_words"), F.count(F.when(F.col("h").isNull(), 1)).alias("copies"),
        F.count(F.when(F.col("met"), 1)).alias("n_met")))

    suspects = per_doc.filter("n_met > 0").select(F.col("id").alias("sid"), F.col("of").alias("sof"))
    again = rows.join(broadcast_if_small(suspects), F.col("id").eqNullSafe(F.col("sid")) & (F.col("of") == F.col("sof")), "left_semi")
    again = again.select("id", "of", words(ascii_lower(F.col("text")), NOT_ALNUM).alias("w"))

    def placed(found: Column, length: int) -> Column:
        """Hashes with their start and the words of their window."""
        return F.coalesce(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("start"), F.lit(length).alias("len"),
                                                                   _windows(F.col("w"), i, F.lit(length)).alias("window"))), no_places)

    no_places = F.array().cast("array<struct<h:bigint,start:int,len:int,window:string>>")
    windows = F.concat(placed(_winnowed(F.col("w")), WINDOW), *[placed(_short_grams(F.col("w"), length), length) for length in short])
    tried = again.select("id", "of", F.explode(windows).alias("at")).select("id", "of", "at.*")
    tried = lookup(tried, test_grams, ["h"], "start").filter("met").select("id", "of", "start", "len", "window")
    numbered = cut_lineage(of_items.select("window").distinct().withColumn("same", F.lit(True)))
    hits = cut_lineage(lookup(tried, numbered, ["window"], "start").filter("same").distinct())
    covered = hits.groupBy("id", "of").agg(F.collect_set(F.struct("start", "len")).alias("spans")).select(
        "id", "of", F.size(F.array_distinct(F.flatten(F.transform(
            "spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))).cast("long").alias("n_hit"))
    listed = (hits.select("id", "of", "window").distinct().join(of_items, "window").select("id", "of", "item").distinct()
              .groupBy("id", "of").agg(F.array_sort(F.collect_set("item")).alias("items")))
    found = covered.join(listed, (covered["id"].eqNullSafe(listed["id"])) & (covered["of"] == listed["of"]), "left").select(
        covered["id"].alias("fid"), covered["of"].alias("fof"), "n_hit", "items")
    out = per_doc.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("of") == F.col("fof")), "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("id", "of", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


SQL = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
item_at AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(len(w) - least(len(w), 10) + 1)) AS s FROM item WHERE len(w) > 0),
item_win AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1:s + n], ' ') AS win FROM item_at),
sizes AS (SELECT DISTINCT n FROM item_win),
doc_at AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s FROM doc, sizes WHERE len(w) >= n),
hit AS (
  SELECT d.doc_id, d.s, d.n, i.item_id FROM (SELECT doc_id, s, n, array_to_string(w[s + 1:s + n], ' ') AS win FROM doc_at) d
  JOIN item_win i USING (n, win)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(l.n_items, 0) AS n_items,
  sha256(coalesce(l.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN covered c USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""
