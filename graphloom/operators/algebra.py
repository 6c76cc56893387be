"""Solution tables: one string column per variable, combined as SPARQL's algebra combines solutions.

A position of a pattern that starts with ``?`` is a variable, anything else a term.  Null is
"unbound".  Rows are bags; ``distinct`` is asked for where it is wanted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .closure import reach, with_self

Pattern = tuple[str, object, str]


def path_pairs(g: DataFrame, path, start: DataFrame | None = None) -> DataFrame:
    """(s, o) joined by a property path.

    A path is a predicate or ``("inv", p)``, ``("seq", p, ...)``, ``("alt", p, ...)``, ``("?", p)``,
    ``("+", p)``, ``("*", p)``.  ``start`` (column s) limits where paths begin; for ``?`` and ``*``
    it also says which nodes reach themselves, and without it those are the nodes of the path's edges.
    """
    if isinstance(path, str):
        out = g.where(F.col("p") == path).select("s", "o")
        return out if start is None else out.join(start.select("s").distinct(), "s", "left_semi")
    kind, *parts = path
    if kind == "inv":
        out = path_pairs(g, parts[0]).select(F.col("o").alias("s"), F.col("s").alias("o"))
        return out if start is None else out.join(start.select("s").distinct(), "s", "left_semi")
    if kind == "seq":
        out = path_pairs(g, parts[0], start)
        for p in parts[1:]:
            step = path_pairs(g, p, out.select(F.col("o").alias("s")) if not isinstance(p, str) else None).select(F.col("s").alias("_m"), F.col("o").alias("_o"))
            out = out.join(step, F.col("o") == F.col("_m")).select("s", F.col("_o").alias("o")).distinct()
        return out
    if kind == "alt":
        return reduce(DataFrame.unionByName, [path_pairs(g, p, start) for p in parts]).distinct()
    edges = path_pairs(g, parts[0])
    nodes = start.select("s").distinct() if start is not None else edges.select(F.explode(F.array("s", "o")).alias("s")).distinct()
    if kind == "?":
        near = edges if start is None else edges.join(nodes, "s", "left_semi")
        return with_self(near, nodes)
    closed = reach(edges, start)
    if kind == "+":
        return closed
    if kind == "*":
        return with_self(closed, nodes)
    raise ValueError(f"unknown path: {path}")


def inverse(path):
    """The path that leads back."""
    if isinstance(path, str):
        return ("inv", path)
    kind, *parts = path
    if kind == "inv":
        return parts[0]
    return (kind, *map(inverse, reversed(parts) if kind == "seq" else parts))


def bound(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with these variables (all, if none is named) marked as never unbound; joins then need not look for nulls."""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={"bound": True}) if c in names or not names else F.col(f"`{c}`") for c in df.columns])


def _loose(df: DataFrame, name: str) -> bool:
    """Whether a variable may be unbound in some solutions."""
    field = df.schema[name]
    return field.nullable and not (field.metadata or {}).get("bound")


def match(g: DataFrame, pattern: Pattern) -> DataFrame:
    """Solutions of one triple pattern; the predicate may be a path, a variable that stands twice must agree.

    A path with a fixed end is walked from there.
    """
    s, p, o = pattern
    variable = isinstance(p, str) and p.startswith("?")
    if variable:
        t = g.select("s", "p", "o")
    elif isinstance(p, str):
        t = path_pairs(g, p)
    elif not s.startswith("?"):
        t = path_pairs(g, p, g.sparkSession.createDataFrame([(s,)], "s string"))
    elif not o.startswith("?"):
        t = path_pairs(g, inverse(p), g.sparkSession.createDataFrame([(o,)], "s string")).select(F.col("o").alias("s"), F.col("s").alias("o"))
    else:
        t = path_pairs(g, p)
    columns: dict[str, Column] = {}
    for name, term in (("s", s), *((("p", p),) if variable else ()), ("o", o)):
        if not term.startswith("?"):
            t = t.where(F.col(name) == term)
        elif term in columns:
            t = t.where(F.col(name) == columns[term])
        else:
            columns[term] = F.col(name)
    return t.select(*[c.alias(v[1:], metadata={"bound": True}) for v, c in columns.items()]) if columns else t.select(F.lit(1).alias("_matched"))


def shared(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns and c != "_matched"]


class _Agreement:
    """Equi-join keys for solutions that agree in all variables that both bind.

    A side that may leave shared variables unbound has rows of several masks, which say what it
    binds.  The rows of the other side stand once for each mask that they may meet, and two rows meet on
    both masks and on the variables that both bind: one equi-join for all pairs of masks.
    """

    def __init__(self, left: DataFrame, right: DataFrame):
        self.names = shared(left, right)
        self.left_loose, self.right_loose = ([c for c in self.names if _loose(d, c)] for d in (left, right))
        self.free = [c for c in self.names if c in self.left_loose or c in self.right_loose]
        self.fixed = [c for c in self.names if c not in self.free]

    def masks(self, loose: list[str]) -> list[int]:
        """All masks of a side: bit i is set where variable i of ``free`` is bound."""
        out = [0]
        for i, c in enumerate(self.free):
            out = [m | 1 << i for m in out] + (out if c in loose else [])
        return out

    def own(self) -> Column:
        return reduce(lambda a, b: a + b, [F.when(F.col(f"`{c}`").isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(self.free)], F.lit(0))

    def keyed(self, side: DataFrame, mine: str, theirs: str, masks: list[int]) -> DataFrame:
        """``side`` once for each of the other side's masks, with the keys."""
        out = side.withColumn(mine, self.own()).withColumn(theirs, F.explode(F.array(*map(F.lit, masks))) if len(masks) > 1 else F.lit(masks[0]))
        for i, c in enumerate(self.free):
            both = F.col(mine).bitwiseAND(F.col(theirs)).bitwiseAND(F.lit(1 << i)) != 0
            out = out.withColumn(f"_key{i}", F.when(both, F.col(f"`{c}`")).otherwise(F.lit("")))
        return out

    @property
    def keys(self) -> list[str]:
        return [*self.fixed, "_l", "_r", *[f"_key{i}" for i in range(len(self.free))]]

    def left(self, df: DataFrame, masks: list[int] | None = None) -> DataFrame:
        return self.keyed(df, "_l", "_r", self.masks(self.right_loose) if masks is None else masks)

    def right(self, df: DataFrame) -> DataFrame:
        return self.keyed(df, "_r", "_l", self.masks(self.left_loose))

    def joined(self, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """The merged solutions; for a left join the right side must bind all that is shared."""
        renamed = self.right(right).select(*[F.col(f"`{c}`").alias(f"_o_{c}" if c in self.free else c) for c in self.right(right).columns])
        out = self.left(left).join(renamed, self.keys, how)
        merged = [F.coalesce(f"`{c}`", f"`_o_{c}`").alias(c, metadata={} if c in self.left_loose and (how == "left" or c in self.right_loose) else {"bound": True}) if c in self.free else F.col(f"`{c}`") for c in left.columns]
        return out.select(*merged, *[F.col(f"`{c}`") for c in right.columns if c not in left.columns])

    def without(self, left: DataFrame, right: DataFrame, how: str = "left_anti", overlap: bool = False) -> DataFrame:
        """Rows of ``left`` without (or, by ``how``, with) a row of ``right`` that agrees; ``overlap``: in a bound variable at least."""
        there = self.right(right)
        if overlap and not self.fixed:
            there = there.where(F.col("_l").bitwiseAND(F.col("_r")) != 0)
        there = there.select(*self.keys).distinct()
        parts, rest = [], left
        for m in self.masks(self.right_loose):
            if how == "left_semi":
                parts.append(self.left(rest, [m]).join(there, self.keys, how).select(*left.columns))
            rest = self.left(rest, [m]).join(there, self.keys, "left_anti").select(*left.columns)
        return reduce(DataFrame.unionByName, parts) if how == "left_semi" else rest


def join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Solutions that agree, merged: a variable that one of them leaves unbound agrees with anything.  Without shared variables, a product."""
    a = _Agreement(left, right)
    if not a.names:
        return left.crossJoin(right)
    return a.joined(left, right, "inner") if a.free else left.join(right, a.names)


def bgp(g: DataFrame, *patterns: Pattern, start: DataFrame | None = None) -> DataFrame:
    """All patterns together, from ``start``'s solutions; each next pattern is one that shares a variable with those before, if there is one."""
    rest = list(patterns)
    out = match(g, rest.pop(0)) if start is None else start
    while rest:
        k = next((i for i, p in enumerate(rest) if any(x[1:] in out.columns for x in p if isinstance(x, str) and x.startswith("?"))), 0)
        out = join(out, match(g, rest.pop(k)))
    return out


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left``'s solutions, merged with those of ``right`` that agree, or alone where none does."""
    a = _Agreement(left, right)
    if not a.names:
        return left.join(right, how="left")
    extra = [c for c in right.columns if c not in left.columns]
    loosened = right.select(*[F.col(f"`{c}`").alias(c, metadata={}) if c in extra else F.col(f"`{c}`") for c in right.columns])
    if not a.free:
        return left.join(loosened, a.names, "left")
    if not a.right_loose:
        return a.joined(left, loosened, "left")
    return a.joined(left, loosened, "inner").unionByName(a.without(left, right), allowMissingColumns=True)


def union(*parts: DataFrame) -> DataFrame:
    """Bag union; variables that a part lacks are unbound there."""
    names = list(dict.fromkeys(c for part in parts for c in part.columns))
    sure = {c for c in names if all(c in part.columns and not _loose(part, c) for part in parts)}
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(*[F.col(f"`{c}`").alias(c, metadata={"bound": True} if c in sure else {}) for c in out.columns])


def exists(left: DataFrame, right: DataFrame) -> DataFrame:
    """The solutions with which some solution of ``right`` agrees."""
    a = _Agreement(left, right)
    if not a.names:
        return left.join(right.limit(1).select(F.lit(1)), how="left_semi")
    return a.without(left, right, "left_semi") if a.free else left.join(right.select(*a.names).distinct(), a.names, "left_semi")


def not_exists(left: DataFrame, right: DataFrame) -> DataFrame:
    """Without the solutions with which some solution of ``right`` agrees; without a shared variable, all or nothing."""
    a = _Agreement(left, right)
    if not a.names:
        return left.join(right.limit(1).select(F.lit(1)), how="left_anti")
    return a.without(left, right) if a.free else left.join(right.select(*a.names).distinct(), a.names, "left_anti")


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """SPARQL's MINUS: a solution goes if one of ``right`` agrees with it and binds one of its variables, too."""
    a = _Agreement(left, right)
    if not a.names:
        return left
    return a.without(left, right, overlap=True) if a.free else not_exists(left, right)


def values(spark, names: list[str], rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def ask(df: DataFrame) -> bool:
    return not df.isEmpty()


def construct(df: DataFrame, *template: tuple[str, str, str]) -> DataFrame:
    """Graph of the template's triples for each solution; triples with an unbound variable are left out."""
    col = lambda x: F.col(x[1:]) if x.startswith("?") else F.lit(x)
    parts = [df.select(col(s).alias("s"), col(p).alias("p"), col(o).alias("o")) for s, p, o in template]
    return reduce(DataFrame.unionByName, parts).dropna().distinct()
