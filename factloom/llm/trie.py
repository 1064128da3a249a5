"""The prefix trie of conversations by a skeleton of splitters.

A conversation is the path of its turns' hashes. Paths are range-partitioned: splitters from a bounded sample cut their order (ties by id, so
that one path may cover several shards) into shards. A node whose path is no prefix of a splitter has all its members in one shard,
since its members stand together in the order and no splitter parts them. So the skeleton, the trie of the splitters' paths, is broadcast; every sorted
shard finishes all other nodes in one pass with a stack of the open ones, and gives partial aggregates of skeleton nodes, which are reduced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import cut_lineage, shuffle_partitions

WIDTH = 16                   # bytes of a turn in a path
GROUP = 100                  # conversations that share the first turns of the first of them
MOST_SHARED = 6
SAMPLE_PER_SHARD = 20
SKELETON_BYTES = 16 << 20    # of splitter paths that are broadcast; beyond it every second splitter goes
ROOT = bytes(WIDTH)
ENDS = 4096                  # ids of members that end at one skeleton node, in one row
_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
         "own binary, above binary, tokens long, shard int, seq int, ends string")


def turn_paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`conv_id, keys, sizes`: every conversation's turns in order, as hashes (hex) and code points."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    key = F.substring(F.sha2(F.concat_ws(":", F.char_length(role).cast("string"), role, text), 256), 1, 2 * WIDTH)
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), key.alias("key"), F.char_length(text).alias("size")).alias("t"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))        # one conversation's hashes; nulls first
    return own.select("conv_id", F.col("t.key").alias("keys"), F.col("t.size").alias("sizes"))


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its group."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED).cast("int")


def rebuilt(own: DataFrame) -> DataFrame:
    """The same columns, each conversation's first turns replaced by those of the first of its group (all it has if fewer, none if it is absent)."""
    first = own.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("first"), F.slice("keys", 1, MOST_SHARED).alias("first_keys"),
                                                             F.slice("sizes", 1, MOST_SHARED).alias("first_sizes"))
    rows = own.withColumn("h", shared_turns(F.col("conv_id"))).withColumn("first", F.col("conv_id") - F.col("conv_id") % GROUP)
    rows = rows.join(first, "first", "left")          # at most GROUP conversations for each first one

    def changed(mine: str, theirs: str) -> Column:
        lead = F.when(F.col(theirs).isNull(), F.array().cast(own.schema[mine].dataType)).otherwise(F.slice(theirs, F.lit(1), F.col("h")))
        return F.concat(lead, F.slice(mine, F.col("h") + 1, F.greatest(F.size(mine) - F.col("h"), F.lit(0))))

    return rows.select("conv_id", changed("keys", "first_keys").alias("keys"), changed("sizes", "first_sizes").alias("sizes"))


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                shards: int | None = None) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations: `conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256`.

    Turns with one number (or none, which come first) are ordered by role and then by a hash of the text; a repeated row is two turns. Null roles and texts are
    empty. Rows without a conversation id are left out. An empty table has no nodes, not even a root. Two turns are the same
    when 128 bits of their SHA-256 are. A conversation's hashes must fit in a task; its texts need not. Columns that aren't named are not read.
    """
    spark = turns.sparkSession
    made = rebuilt(cut_lineage(turn_paths(turns, conv_col, turn_col, role_col, text_col)))
    paths = cut_lineage(made.select("conv_id", F.unhex(F.array_join("keys", "")).alias("path"), "sizes"))
    n = shards or shuffle_partitions(spark)
    splitters = _splitters(paths, n)
    skeleton = {ROOT}.union(*(_names(path) for path, _ in splitters))
    known = spark.sparkContext.broadcast((splitters, skeleton))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, _ = known.value
        for batch in batches:
            of = [bisect_right(bounds, x) for x in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int32())], ["conv_id", "path", "sizes", "shard"])

    dealt = paths.mapInArrow(deal, "conv_id long, path binary, sizes array<int>, shard int")
    dealt = dealt.repartitionById(len(splitters) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _nodes(batches, known.value[1])

    found = cut_lineage(dealt.mapInArrow(nodes, _NODE))
    return _whole(found)


def _below(name: bytes, key: bytes) -> bytes:
    """The name of the child that a turn leads to: a hash of the whole path in a few bytes, however long the path."""
    return hashlib.blake2b(name + key, digest_size=WIDTH).digest()


def _names(path: bytes) -> list[bytes]:
    """The names of all nodes on a path but the root."""
    found = [ROOT]
    for at in range(0, len(path), WIDTH):
        found.append(_below(found[-1], path[at:at + WIDTH]))
    return found[1:]


def _splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most `shards` - 1 quantiles of a bounded sample of paths and ids, in order."""
    total = paths.count()
    share = min(1.0, SAMPLE_PER_SHARD * shards / max(total, 1))
    sample = paths.select("path", "conv_id").sample(share, seed=1)
    nth = F.ntile(shards).over(Window.orderBy("path", "conv_id"))
    last = sample.withColumn("tile", nth).groupBy("tile").agg(F.max(F.struct("path", "conv_id")).alias("x"))     # the sample only
    rows = sorted((bytes(r.x.path), r.x.conv_id) for r in last.filter(F.col("tile") < shards).collect())
    while sum(len(p) for p, _ in rows) > SKELETON_BYTES and len(rows) > 1:
        rows = rows[1::2]
    return rows


class _Open:
    """A node whose members are not all seen yet."""

    def __init__(self, depth: int, size: int, name: bytes | None, above: bytes | None) -> None:
        self.depth, self.size = depth, size
        self.name, self.above = name, above          # of skeleton nodes only
        self.least, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.below: list[tuple] = []                 # finished children, which wait for this node's id
        self.sha, self.n_ends, self.ends, self.seq = hashlib.sha256(), 0, [], 0


def _nodes(batches: Iterator[pa.RecordBatch], skeleton: set[bytes]) -> Iterator[pa.RecordBatch]:
    """Nodes of the sorted shards of one task: whole ones, and parts of skeleton nodes (`own` is their name)."""
    out: list[tuple] = []
    stack: list[_Open] = []
    now, before = None, b""

    def close() -> None:
        x = stack.pop()
        if x.name is not None:
            flush(x)
            out.append((x.least, x.depth, None, x.convs, x.children, x.leaves, x.saved, None, x.name, x.above, x.size, now, -1, None))
            out.extend((*row[:2], None, *row[3:8], None, x.name, None, now, -1, None) for row in x.below)
        else:
            leaves, saved = x.leaves or 1, x.saved + (x.convs - 1) * x.size
            row = (x.least, x.depth, None, x.convs, x.children, leaves, saved, x.sha.hexdigest())
            out.extend((*r[:2], x.least, *r[3:8], None, None, None, now, -1, None) for r in x.below)
            up = stack[-1]
            up.below.append(row)
            up.children += 1
            up.leaves += leaves
            up.saved += saved
        if stack:
            up = stack[-1]
            up.least = x.least if up.least is None else min(up.least, x.least)

    def flush(x: _Open) -> None:
        if x.ends:
            out.append((None, None, None, None, None, None, None, None, x.name, None, None, now, x.seq, ",".join(map(str, x.ends))))
            x.ends, x.seq = [], x.seq + 1

    def open_below(at: int, path: bytes, size: int) -> None:
        up, name = stack[-1], None
        if up.name is not None:                      # below other nodes there is no skeleton
            name = _below(up.name, path[at * WIDTH:(at + 1) * WIDTH])
        stack.append(_Open(at + 1, size, name if name in skeleton else None, up.name))

    for batch in batches:
        for conv, path, sizes, shard in zip(*(c.to_pylist() for c in batch.columns)):
            if shard != now:
                while stack:
                    close()
                now, before = shard, b""
                stack.append(_Open(0, 0, ROOT, None))
            same = 0
            while same < len(path) and path[same:same + WIDTH] == before[same:same + WIDTH]:
                same += WIDTH
            while len(stack) - 1 > same // WIDTH:
                close()
            for at in range(len(stack) - 1, len(path) // WIDTH):
                open_below(at, path, sizes[at])
            before = path
            for x in stack:
                x.convs += 1
            end = stack[-1]
            end.least = conv if end.least is None else min(end.least, conv)
            if end.name is not None:
                end.ends.append(conv)
                if len(end.ends) == ENDS:
                    flush(end)
            else:
                end.sha.update(f"{',' if end.n_ends else ''}{conv}".encode())
                end.n_ends += 1
        if len(out) > 50_000:
            yield _rows(out)
            out.clear()
    while stack:
        close()
    if out:
        yield _rows(out)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_FIELDS = [(x.split()[0], _TYPES[x.split()[1]]) for x in _NODE.split(", ")]


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out), _FIELDS)], [n for n, _ in _FIELDS])


def _whole(found: DataFrame) -> DataFrame:
    """Skeleton nodes from their parts, and ids of skeleton parents for the nodes right below them."""
    spark = found.sparkSession
    parts = found.filter("own is not null and seq < 0")
    reduced = parts.groupBy("own").agg(F.min("conv_id").alias("conv_id"), F.first("above").alias("above"), F.first("depth").alias("depth"), F.first("tokens").alias("tokens"),
                                       *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    rows = {bytes(r.own): r.asDict() for r in reduced.collect()}          # the skeleton, of bounded size
    for name, x in sorted(rows.items(), key=lambda row: -row[1]["depth"]):
        x["n_leaves"] = x["n_leaves"] or 1
        x["saved_tokens"] += (x["n_convs"] - 1) * x["tokens"]
        up = rows.get(bytes(x["above"])) if x["above"] is not None else None
        x["parent_conv_id"] = None if up is None else up["conv_id"]
        if up is not None:
            up["n_children"] += 1
            up["n_leaves"] += x["n_leaves"]
            up["saved_tokens"] += x["saved_tokens"]
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    made = spark.createDataFrame([(p, *(x[c] for c in names)) for p, x in rows.items()], "own binary, " + ", ".join(f"{c} long" for c in names))

    ends = found.filter("seq >= 0").select("own", "shard", "seq", "ends")
    ends = ends.repartition(shuffle_partitions(spark), "own").sortWithinPartitions("own", "shard", "seq")
    hashes = cut_lineage(ends.mapInArrow(_end_hashes, "own binary, ends_sha256 string"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    top = made.join(F.broadcast(hashes), "own", "left").select(*names, F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    parents = F.broadcast(made.select(F.col("own").alias("_own"), F.col("conv_id").alias("_parent")))
    local = found.filter("own is null").join(parents, F.col("above") == F.col("_own"), "left")
    local = local.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
    return local.select(*names, "ends_sha256").unionByName(top)


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each skeleton node's ids, fed piece by piece in order."""
    now, sha, done = None, None, []
    for batch in batches:
        for own, ends in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if own != now:
                if now is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = own, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ends.encode())
    if now is not None:
        done.append((now, sha.hexdigest()))
    if done:
        a, b = zip(*done)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b)], ["own", "ends_sha256"])


SQL = """
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
bits AS (
  SELECT c, list_transform(range(8 * strlen(c::VARCHAR)), lambda i: (ascii(substr(c::VARCHAR, (i // 8 + 1)::INT, 1)) >> (i % 8)::INT) & 1) AS b FROM ids),
shared AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(b, lambda x: x::BIGINT)),
    lambda crc, bit: xor(crc >> 1, 3988292384::BIGINT * (xor(crc, bit) & 1))), 4294967295::BIGINT) % 6 AS h FROM bits),
own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth FROM conversations WHERE conv_id IS NOT NULL),
made AS (
  SELECT s.c, o.nth, 0 AS mine, o.role, o.text FROM shared s JOIN own o ON o.c = s.c - s.c % 100 AND o.nth <= s.h
  UNION ALL SELECT s.c, o.nth, 1, o.role, o.text FROM shared s JOIN own o ON o.c = s.c AND o.nth > s.h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY mine, nth) AS depth, role, text FROM made),
lists AS (SELECT s.c, list(struct_pack(r := role, t := text) ORDER BY depth) FILTER (WHERE depth IS NOT NULL) AS path
  FROM shared s LEFT JOIN placed p USING (c) GROUP BY s.c),
paths AS (SELECT c, coalesce(path, []) AS path FROM lists),
prefixes AS (SELECT c, len(path) AS size, unnest(range(len(path) + 1)) AS depth, path FROM paths),
members AS (SELECT c, size, depth, md5(to_json(path[1:depth])::VARCHAR) AS node, md5(to_json(path[1:depth - 1])::VARCHAR) AS above,
    CASE WHEN depth = 0 THEN 0 ELSE length(path[depth].t) END AS tokens FROM prefixes),
nodes AS (
  SELECT depth, node, CASE WHEN depth > 0 THEN any_value(above) END AS above, min(c) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * any_value(tokens) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE size = depth), '')) AS ends_sha256 FROM members GROUP BY depth, node),
leaves AS (SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.above = n.node) AS n_children FROM nodes n),
up AS (
  SELECT depth AS d, node AS n, above AS a, (n_children = 0)::BIGINT AS leaf, saved, depth AS top, node AS top_node FROM leaves
  UNION ALL SELECT u.d, u.n, l.above, u.leaf, u.saved, l.depth, l.node FROM up u JOIN leaves l ON l.depth = u.top - 1 AND l.node = u.a),
sums AS (SELECT top AS depth, top_node AS node, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY ALL)
SELECT l.conv_id, l.depth, p.conv_id AS parent_conv_id, l.n_convs, l.n_children, s.n_leaves, s.saved_tokens, l.ends_sha256
FROM leaves l JOIN sums s USING (depth, node) LEFT JOIN leaves p ON p.depth = l.depth - 1 AND p.node = l.above
"""
