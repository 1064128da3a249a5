"""Joins found from a foreign-key graph.

`auto_join` looks at the `table.column` names in use, finds the way between the tables
and returns one joined DataFrame whose columns are reached as `table.column`. Grouping,
having, distinct, ordering, limits, unions and named subqueries are plain DataFrame calls on
the result. Catalyst and AQE choose order and strategy of the joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.fkgraph import FkGraph

_QUALIFIED = re.compile(r"\b([A-Za-z_]\w*)\.[A-Za-z_]\w*")
_QUOTED = re.compile(r"'(?:[^']|'')*'")


@dataclass(frozen=True)
class Join:
    """An explicit join: `from_table.from_columns = to_table.to_columns`, the target under `alias` if given."""

    from_table: str
    from_columns: str | tuple[str, ...]
    to_table: str
    to_columns: str | tuple[str, ...]
    how: str = "inner"
    alias: str | None = None


class Group:
    """Conditions joined by AND or OR: SQL texts, columns or further groups."""

    def __init__(self, how: str, parts):
        self.how, self.parts = how, parts

    def texts(self) -> list[str]:
        out = []
        for p in self.parts:
            out += p.texts() if isinstance(p, Group) else [p] if isinstance(p, str) else []
        return out

    def column(self) -> Column | None:
        cols = []
        for p in self.parts:
            c = p.column() if isinstance(p, Group) else F.expr(p) if isinstance(p, str) else p
            if c is not None:       # an empty group says nothing
                cols.append(c)
        out = None
        for c in cols:
            out = c if out is None else (out & c if self.how == "and" else out | c)
        return out


def all_of(*parts) -> Group:
    return Group("and", parts)


def any_of(*parts) -> Group:
    return Group("or", parts)


def tables_in(text: str) -> list[str]:
    """Names before a dot in an SQL expression text, string literals left out."""
    return [m.lower() for m in _QUALIFIED.findall(_QUOTED.sub("''", text))]


def auto_join(tables: dict[str, DataFrame], graph: FkGraph, columns: list[str], where: Group | str | None = None,
              *, left: tuple[str, ...] = (), right: tuple[str, ...] = (), joins: list[Join] | None = None,
              aliases: dict[str, str] | None = None, also: list[str] | None = None) -> DataFrame:
    """Join every table that `columns`, `where` and `also` (ordering, grouping, having texts) name.

    The root is the first table of `where`, else of `columns`. Joins found in the graph are
    inner ones unless the table is listed in `left` or `right`. `joins` are added after them,
    in order; their targets need no way in the graph. `aliases` maps a table to the name it
    goes by. Named subqueries are further entries of `tables`.
    """
    tables = {k.lower(): v for k, v in tables.items()}
    names = {k.lower(): v.lower() for k, v in (aliases or {}).items()}
    real = {v: k for k, v in names.items()}
    joins = joins or []
    where = all_of(where) if isinstance(where, str) else where
    join_aliases = {j.alias.lower() for j in joins if j.alias}
    targets = {j.to_table.lower() for j in joins if j.to_table.lower() != j.from_table.lower()}

    def known(texts: list[str]) -> list[str]:
        found = [real.get(t, t) for text in texts for t in tables_in(text)]
        return [t for t in dict.fromkeys(found) if t in tables and t not in join_aliases]

    in_where = known(where.texts() if where else [])
    in_select = known(columns)
    named = list(dict.fromkeys(in_select + in_where + known(also or []) + [j.from_table.lower() for j in joins]))
    wanted = [t for t in named if t not in targets] or named[:1]
    # A named subquery that the graph does not know is reached by an explicit join only.
    apart = [t for t in wanted if t not in graph.tables]
    if len(apart) < len(wanted):
        joined_by = {j.to_table.lower() for j in joins}
        wanted = [t for t in wanted if t not in apart or t not in joined_by]
    if not wanted:
        raise ValueError("no table is named")
    root = next((t for t in in_where[:1] + in_select[:1] if t in wanted), wanted[0])

    def aliased(table: str, alias: str | None = None) -> DataFrame:
        return tables[table].alias(alias or names.get(table, table))

    def on(a: str, a_cols, b: str, b_cols) -> Column:
        def tup(c):
            return (c,) if isinstance(c, str) else tuple(c)
        cond = None
        for x, y in zip(tup(a_cols), tup(b_cols), strict=True):
            eq = F.col(f"{a}.{x}") == F.col(f"{b}.{y}")
            cond = eq if cond is None else cond & eq
        return cond

    out = aliased(root)
    for table, e in graph.join_order(root, graph.join_path(wanted, root)):
        how = "left" if table in {t.lower() for t in left} else "right" if table in {t.lower() for t in right} else "inner"
        cond = on(names.get(e.from_table, e.from_table), e.from_columns, names.get(e.to_table, e.to_table), e.to_columns)
        out = out.join(aliased(table), cond, how)
    for j in joins:
        to = (j.alias or names.get(j.to_table.lower(), j.to_table)).lower()
        source = names.get(j.from_table.lower(), j.from_table.lower())
        out = out.join(aliased(j.to_table.lower(), to), on(source, j.from_columns, to, j.to_columns), j.how)
    cond = where.column() if where else None
    return out if cond is None else out.filter(cond)


def where_in(df: DataFrame, column: str, sub: DataFrame, sub_column: str) -> DataFrame:
    """`column IN (subquery)`."""
    return df.join(sub.select(F.col(sub_column).alias("_in")), F.col(column) == F.col("_in"), "left_semi")


def where_not_in(df: DataFrame, column: str, sub: DataFrame, sub_column: str) -> DataFrame:
    """`column NOT IN (subquery)` with SQL's rule for nulls, as a plain shuffled anti join.

    One null in the subquery leaves no row; an empty subquery keeps all rows, null ones too.
    """
    values = sub.select(F.col(sub_column).alias("_in"))
    facts = values.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_in").isNull()).alias("nulls")))
    seen = facts.scalar()
    rest = df.join(values.filter("_in is not null"), F.col(column) == F.col("_in"), "left_anti")
    return rest.filter((seen["n"] == 0) | ((seen["nulls"] == 0) & F.col(column).isNotNull()))


def where_exists(df: DataFrame, sub: DataFrame, on: Column) -> DataFrame:
    return df.join(sub, on, "left_semi")


def where_not_exists(df: DataFrame, sub: DataFrame, on: Column) -> DataFrame:
    return df.join(sub, on, "left_anti")
