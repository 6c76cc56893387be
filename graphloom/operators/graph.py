"""Set operations and rewriting of graphs (DataFrames s, p, o)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..terms import A, PARAM, SH, XSD, is_blank
from .closure import SMALL, components, cut, widen

COLUMNS = ["s", "p", "o"]


def graph(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS).dropDuplicates()


def bag(*graphs: DataFrame) -> DataFrame:
    """A union that may have a triple twice, for readers that tell apart what they read."""
    return widen(reduce(lambda a, b: a.select(*COLUMNS).unionByName(b.select(*COLUMNS)), graphs))


def union(*graphs: DataFrame) -> DataFrame:
    return graph(bag(*graphs))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select(*COLUMNS), COLUMNS, "left_anti")


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select(*COLUMNS), COLUMNS, "left_semi")


def size(g: DataFrame) -> int:
    return g.count()


def triples(g: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples that agree with the bound positions."""
    for name, term in zip(COLUMNS, (s, p, o)):
        if term is not None:
            g = g.where(F.col(name) == term)
    return g


def value(g: DataFrame, s: str, p: str) -> str | None:
    """An object of (s, p), the least one where there are several."""
    return triples(g, s, p).agg(F.min("o")).first()[0]


def rename_blank_nodes(g: DataFrame, prefix: str) -> DataFrame:
    """A copy in which every blank node's name starts with ``prefix``."""
    new = lambda c: F.when(is_blank(F.col(c)), F.concat(F.lit(f"_:{prefix}"), F.substring(c, 3, 1 << 20))).otherwise(F.col(c)).alias(c)
    return g.select(*map(new, COLUMNS))


def remove_node(g: DataFrame, node: str) -> DataFrame:
    """Without the triples that have the node in any position."""
    return g.where(~(F.col("s").eqNullSafe(node) | F.col("p").eqNullSafe(node) | F.col("o").eqNullSafe(node)))


def replace_nodes(g: DataFrame, mapping: DataFrame | dict[str, str]) -> DataFrame:
    """Whole terms replaced in every position; ``mapping`` is a dictionary or a DataFrame (old, new)."""
    if isinstance(mapping, dict):
        if not mapping:
            return g
        table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
        return graph(g.select(*[F.coalesce(table[F.col(c)], F.col(c)).alias(c) for c in COLUMNS]))
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    small = m.count() <= SMALL
    for c in COLUMNS:
        own = m
        if c == "p":  # one predicate may stand in a third of all triples: the few that there are, are met apart
            own = cut(g.select(F.col("p").alias("_old")).distinct().join(m, "_old"))
        g = g.join(F.broadcast(own) if small or c == "p" and own.count() <= SMALL else own, F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("_new", c)).select(*COLUMNS)
    return graph(g)


def parameters(g: DataFrame) -> DataFrame:
    """(name) of the parameters in any position."""
    node = F.explode(F.array(*COLUMNS)).alias("node")
    return g.select(node).where(F.col("node").startswith(f"<{PARAM}")).select(strip_param(F.col("node")).alias("name")).distinct()


def strip_param(term: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(term, "^<|>$", ""), f"^({PARAM})+", "")


def types(g: DataFrame) -> DataFrame:
    """(type) of everything typed, sorted."""
    return g.where(F.col("p") == A).select(F.col("o").alias("type")).distinct().orderBy("type")


def skip_uri(term: Column) -> Column:
    """Whether a term belongs to the XSD or SHACL vocabulary."""
    return term.startswith(f"<{XSD}") | term.startswith(f"<{SH}")


def describe(g: DataFrame, roots: DataFrame) -> DataFrame:
    """Concise bounded description: the triples of the roots (column node), and of blank nodes that they lead to."""
    seen = roots.select("node").distinct()
    front = seen
    while True:
        step = g.join(front, F.col("s") == F.col("node"), "left_semi").where(is_blank(F.col("o"))).select(F.col("o").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti"))
        if front.isEmpty():
            return g.join(seen, F.col("s") == F.col("node"), "left_semi")
        seen = cut(seen.unionByName(front))


def skolemize(g: DataFrame, properties: tuple[str, ...] = (f"<{SH}property>", f"<{SH}qualifiedValueShape>")) -> DataFrame:
    """Blank nodes under these properties become IRIs made from a hash of their name."""
    m = g.where(F.col("p").isin(*properties) & is_blank(F.col("o"))).select(F.col("o").alias("old")).distinct()
    return replace_nodes(g, m.select("old", F.concat(F.lit("<urn:well-known/"), F.substring(F.sha2("old", 256), 1, 16), F.lit(">")).alias("new")))


# --- graphs up to the names of their blank nodes


def _coloured(g: DataFrame, nodes: DataFrame) -> DataFrame:
    """The triples with the colours of their blank ends, and the component that they belong to."""
    m = lambda at: nodes.select(F.col("node").alias(f"_n{at}"), F.col("colour").alias(f"_c{at}"), F.col("component").alias(f"_k{at}"))
    j = g.join(m("s"), F.col("s") == F.col("_ns"), "left").join(m("o"), F.col("o") == F.col("_no"), "left")
    c = lambda at: F.coalesce(F.col(f"_c{at}"), F.xxhash64(F.col(at)))
    return j.select("s", "p", "o", c("s").alias("cs"), c("o").alias("co"), F.coalesce("_ks", "_ko").alias("component"))


def _refined(g: DataFrame, nodes: DataFrame) -> DataFrame:
    """Colours refined from the neighbours' until no class of equal colours splits any more.

    A round folds into a node's colour the triples around it, the blank nodes in them by their colours; classes
    only split, so when their number stays the colours are stable.
    """
    nodes = cut(nodes)
    count = lambda: nodes.select("component", "colour").distinct().count()
    classes = count()
    while True:
        j = _coloured(g, nodes)
        out = j.where(is_blank(F.col("s"))).select(F.col("s").alias("node"), F.xxhash64(F.lit(1), "p", "co").alias("h"))
        back = j.where(is_blank(F.col("o"))).select(F.col("o").alias("node"), F.xxhash64(F.lit(2), "p", "cs").alias("h"))
        loops = j.where(is_blank(F.col("s")) & (F.col("s") == F.col("o"))).select(F.col("s").alias("node"), F.xxhash64(F.lit(3), "p").alias("h"))
        folded = out.unionByName(back).unionByName(loops).groupBy("node").agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("t"))
        nodes = cut(nodes.join(folded, "node").select("node", "component", F.xxhash64("colour", "t").alias("colour")))
        before, classes = classes, count()
        if classes == before:
            return nodes


def canonical_hash(g: DataFrame) -> int:
    """A number that is the same for graphs that differ only in their blank nodes' names, and for no others but by a collision of hashes.

    The components that blank nodes form among themselves are settled apart from each other, all at
    once.  Colours are refined from the neighbours' until they are stable; where nodes of a component still
    share one, each of its smallest such class is told apart in turn, the rest is refined after
    it, and the component's least outcome counts.  So the work grows with the ties inside a component, not with
    the number of components, alike or not.
    """
    g = cut(graph(g))
    ties = g.where(is_blank(F.col("s")) & is_blank(F.col("o"))).select("s", "o")
    alone = g.select(F.explode(F.array("s", "o")).alias("node")).where(is_blank(F.col("node"))).distinct()
    nodes = alone.join(components(ties), "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.lit(1).cast("long").alias("colour"))
    ground = g.where(~is_blank(F.col("s")) & ~is_blank(F.col("o"))).agg(F.sum(F.xxhash64("s", "p", "o").cast("decimal(38,0)"))).first()[0]
    rest = _least(g.where(is_blank(F.col("s")) | is_blank(F.col("o"))), nodes).agg(F.sum(F.xxhash64("digest").cast("decimal(38,0)"))).first()[0]
    return (int(ground or 0) * 31 + int(rest or 0)) % (1 << 61)


def _least(g: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, digest): the least digest of each component over all ways to tell tied nodes apart."""
    nodes = _refined(g, nodes)
    classes = nodes.groupBy("component", "colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tied = cut(classes.groupBy("component").agg(F.min(F.struct("n", "colour")).alias("c")).select("component", "c.colour", "c.n"))
    j = _coloured(g, nodes).groupBy("component").agg(F.sum(F.xxhash64("cs", "p", "co").cast("decimal(38,0)")).alias("digest"))
    done = j.join(tied, "component", "left_anti")
    most = tied.agg(F.max("n")).first()[0]
    if most is None:
        return done
    mine = nodes.join(tied.select("component"), "component", "left_semi")
    own = g.join(mine.select(F.col("node").alias("s")), "s", "left_semi").unionByName(g.join(mine.select(F.col("node").alias("o")), "o", "left_semi").select(*COLUMNS)).select(*COLUMNS).distinct()
    own, parts = cut(own), []
    place = F.row_number().over(Window.partitionBy("component", "colour").orderBy("node"))
    ranked = cut(mine.join(tied.select("component", F.col("colour").alias("_c")), "component").withColumn("_i", F.when(F.col("colour") == F.col("_c"), place)))
    for i in range(1, most + 1):  # the i-th tied node of every component at once
        some = ranked.join(tied.where(F.col("n") >= i).select("component"), "component", "left_semi")
        parts.append(_least(own, some.select("node", "component", F.when(F.col("_i") == i, F.xxhash64(F.lit(7), "colour")).otherwise(F.col("colour")).alias("colour"))))
    return done.unionByName(cut(reduce(DataFrame.unionByName, parts).groupBy("component").agg(F.min("digest").alias("digest"))))


def isomorphic(left: DataFrame, right: DataFrame) -> bool:
    """Whether two graphs differ only in their blank nodes' names."""
    return graph(left).count() == graph(right).count() and canonical_hash(left) == canonical_hash(right)
