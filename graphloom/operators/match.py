"""Partial matching of templates against graphs, as joins over what lies under each template edge."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.template import Template
from ..terms import A, OWL, SUBPROPERTY, is_param, param_name
from .closure import SMALL, ancestors, cut, stored
from .graph import difference

Edge = tuple[str, str, str]


class Matcher:
    """Maps template nodes to graph nodes, one to one, so that template edges lie on graph edges.

    One scan finds what may lie under each template edge, and these relations are counted.  Partial matches
    grow edge by edge, the smallest relation first; each is written once, and every part of
    the template that begins with the same edges goes on from it.
    """

    def __init__(self, template: Template, g: DataFrame, ontology: DataFrame, check_predicates: bool = False):
        self.template, self.g, self.check_predicates = template, g, check_predicates
        self.edges = sorted({(s, p, o) for s, p, o in template.body})
        self.nodes = sorted({t for s, _, o in self.edges for t in (s, o)})
        # classes and properties alike: a term may stand for what is above or below it
        self.up = cut(ancestors(ontology).unionByName(ancestors(ontology, SUBPROPERTY)))
        self.lying = cut(self._lying())
        self.counts = {e: 0 for e in self.edges} | {self.edges[r.edge]: r.n for r in self.lying.groupBy("edge").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.grown: dict[tuple[Edge, ...], tuple[DataFrame, bool]] = {}

    def _lying(self) -> DataFrame:
        """(edge, s, p, o): the graph's triples on which a template edge may lie, by the edge's place."""
        spark = self.g.sparkSession
        table = lambda rows, schema: spark.createDataFrame(rows, schema)  # noqa: E731  of as many rows as the template has edges or nodes
        checked = [(k, p) for k, (_, p, _) in enumerate(self.edges) if p == A or self.check_predicates]
        free = [(k,) for k, (_, p, _) in enumerate(self.edges) if p != A and not self.check_predicates]
        wanted = table(checked, "edge int, _p string")
        # the predicate or one below it: as many rows as the ontology has properties below the template's
        below = wanted.unionByName(wanted.join(self.up, F.col("_p") == F.col("ancestor")).where(F.col("_p") != A).select("edge", F.col("child").alias("_p"))).distinct()
        few = None if free else [r._p for r in below.select("_p").distinct().limit(1001).collect()]
        source = self.g.select("s", "p", "o")
        narrow = few is not None and len(few) <= 1000  # a plain list of predicates reaches the sources of the graph
        # what is read more than once is written once: the triples of these predicates, and the types
        triples = kept = stored((source.where(F.col("p").isin(sorted({*few, A}))) if narrow else source).distinct())
        if narrow:
            triples = kept.where(F.col("p").isin(few))
        raw = triples.join(F.broadcast(below) if below.count() <= SMALL else below, F.col("p") == F.col("_p")).select("edge", "s", "p", "o")
        if free:
            raw = raw.unionByName(triples.select(F.explode(F.array(*[F.lit(k) for (k,) in free])).alias("edge"), "s", "p", "o"))
        loops = [k for k, (s, _, o) in enumerate(self.edges) if s == o]
        raw = raw.where(~F.col("edge").isin(loops) | (F.col("s") == F.col("o"))) if loops else raw
        ends = table([(k, s, o) for k, (s, _, o) in enumerate(self.edges)], "edge int, ts string, to string")
        raw = raw.join(F.broadcast(ends), "edge")
        feasible = cut(self._feasible(raw, kept.where(F.col("p") == A)))
        may = {r.tnode: r.n for r in feasible.groupBy("tnode").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a node of the template
        sides = [("ts", "s", 0), ("to", "o", 2)]
        for end, at, _ in sorted(sides, key=lambda x: sum(may.get(e[x[2]], 0) for e in self.edges)):  # the side that lets fewer through first
            raw = raw.join(feasible.select(F.col("tnode").alias(end), F.col("node").alias(at)), [end, at], "left_semi")
        return raw.select("edge", "s", "p", "o")

    def _feasible(self, raw: DataFrame, types_in: DataFrame) -> DataFrame:
        """(tnode, node) that may map: the same term, a class and its super- or sub-class, or types so related."""
        spark = self.g.sparkSession
        types = [(s, o) for s, p, o in self.edges if p == A]
        untyped = [n for n in self.nodes if n not in {s for s, _ in types} and not n.startswith('"')]
        individual = f"<{OWL}NamedIndividual>"
        wanted = spark.createDataFrame([*types, *((n, individual) for n in untyped)], "tnode string, ttype string")
        constants = spark.createDataFrame([(n, n) for n in self.nodes if not is_param(n)], "tnode string, node string")
        related = self.up.select(F.col("child").alias("x"), F.col("ancestor").alias("y"))
        related = related.unionByName(related.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
        may = wanted.join(related, F.col("ttype") == F.col("x")).select("tnode", F.col("y").alias("type")).unionByName(wanted.select("tnode", F.col("ttype").alias("type"))).distinct()
        kinds = types_in.select(F.col("s").alias("node"), F.col("o").alias("type"))
        parts = [constants, constants.join(related, F.col("node") == F.col("x")).select("tnode", F.col("y").alias("node")), may.join(kinds, "type").select("tnode", "node")]
        if untyped:  # nodes without a type, of those that lie under an edge there
            at = [raw.select(F.col(t).alias("tnode"), F.col(c).alias("node")) for t, c in (("ts", "s"), ("to", "o"))]
            near = at[0].unionByName(at[1]).where(F.col("tnode").isin(*untyped) & ~F.col("node").startswith('"')).distinct()
            parts.append(near.join(kinds, "node", "left_anti").select("tnode", "node"))
        return reduce(DataFrame.unionByName, parts).distinct()

    def _connected(self, nodes: Iterable[str]) -> list[frozenset[str]]:
        """The parts into which the template's edges divide some of its nodes."""
        left, out = set(nodes), []
        while left:
            front = [left.pop()]
            part = set(front)
            while front:
                n = front.pop()
                near = {x for s, _, o in self.edges if n in (s, o) for x in (s, o)} & left
                left -= near
                part |= near
                front += near
            out.append(frozenset(part))
        return out

    def _within(self, nodes: Iterable[str]) -> list[Edge]:
        """The edges among some nodes, the smallest relation first, each after the first next to one before it, if there is such a one."""
        rest, out, seen = sorted((e for e in self.edges if e[0] in nodes and e[2] in nodes), key=lambda e: (self.counts[e], e)), [], set()
        while rest:
            e = rest.pop(next((i for i, e in enumerate(rest) if e[0] in seen or e[2] in seen), 0))
            seen |= {e[0], e[2]}
            out.append(e)
        return out

    def _name(self, node: str) -> str:
        return f"n{self.nodes.index(node)}"

    def _pairs(self, e: Edge) -> DataFrame:
        s, o = self._name(e[0]), self._name(e[2])
        under = self.lying.where(F.col("edge") == self.edges.index(e))
        return under.select(F.col("s").alias(s), F.col("o").alias(o)).distinct() if s != o else under.select(F.col("s").alias(s)).distinct()

    def _extended(self, before: DataFrame | None, e: Edge) -> DataFrame:
        """Matches that also have this edge; nodes that are new differ from all others."""
        pairs = self._pairs(e)
        if before is None:
            return pairs.where(F.col(pairs.columns[0]) != F.col(pairs.columns[1])) if len(pairs.columns) > 1 else pairs
        shared = [c for c in pairs.columns if c in before.columns]
        new = [c for c in pairs.columns if c not in before.columns]
        out = before.join(pairs, shared) if shared else before.crossJoin(pairs)
        for c in new:
            for other in [*before.columns, *new[: new.index(c)]]:
                out = out.where(F.col(c) != F.col(other))
        return out

    def mappings(self, nodes: list[str], edges: list[Edge]) -> DataFrame:
        """One row a mapping of these nodes: a column for each, named by its place in ``self.nodes``."""
        return reduce(self._extended, self._within(nodes) if set(edges) == set(self._within(nodes)) else edges, None).select(*map(self._name, nodes))

    def _grow(self, edges: list[Edge]) -> tuple[int, DataFrame | None]:
        """(how many of the edges have matches together, the matches of all), each step written once."""
        before = None
        for k in range(1, len(edges) + 1):
            key = tuple(edges[:k])
            if key not in self.grown:
                if not self.counts[edges[k - 1]]:
                    return k - 1, None
                m = cut(self._extended(before, edges[k - 1]))
                self.grown[key] = (m, m.isEmpty())
            before, empty = self.grown[key]
            if empty:
                return k - 1, None
        return len(edges), before

    def _matching(self) -> Iterator[tuple[list[str], list[Edge], DataFrame]]:
        """The connected parts with a parameter that have mappings, largest first, down to two nodes.

        A part without mappings is followed only by those that lack one of the nodes that clash in it,
        so the search is as wide as the template and the graph differ, whatever the template's size.
        """
        queue: list[tuple[int, list[str]]] = []
        seen: set[frozenset[str]] = set()
        clashes = [frozenset((s, o)) for (s, _, o), n in ((e, self.counts[e]) for e in self.edges) if not n]

        def put(nodes: Iterable[str]) -> None:
            for part in self._connected(nodes):
                if len(part) > 1 and part not in seen and any(map(is_param, part)):
                    seen.add(part)
                    heapq.heappush(queue, (-len(part), sorted(part)))

        put(self.nodes)
        while queue:
            nodes = heapq.heappop(queue)[1]
            without = next((c for c in clashes if c <= set(nodes)), None)
            if without is None:
                edges = self._within(nodes)
                k, m = self._grow(edges)
                if m is None:
                    without = frozenset(t for s, _, o in edges[: k + 1] for t in (s, o))
                    clashes.append(without)
                else:
                    yield nodes, edges, m.select(*map(self._name, nodes))
            for n in sorted(without or nodes):
                put(set(nodes) - {n})

    def best(self, target: str | None = None) -> tuple[list[str], DataFrame] | None:
        """The largest part of the template that matches (with ``target`` among the mapped nodes, if given), and its mappings."""
        for nodes, _, m in self._matching():
            if target is None:
                return nodes, m
            m = m.where(F.array_contains(F.array(*m.columns), target))
            if not m.isEmpty():
                return nodes, m
        return None

    def all(self) -> Iterator[tuple[list[str], DataFrame]]:
        """Every part that matches with its mappings, largest first; sets of graph nodes are listed once a part."""
        for nodes, _, m in self._matching():
            yield nodes, m.withColumn("_key", F.array_join(F.array_sort(F.array(*m.columns)), " ")).dropDuplicates(["_key"]).drop("_key")

    def remaining(self, nodes: list[str], mapping: dict[str, str]) -> Template | None:
        """What is left of the template once a mapping's parameters are bound; none if nothing is."""
        terms = {param_name(n): mapping[f"n{self.nodes.index(n)}"] for n in nodes if is_param(n)}
        left = self.template.evaluate(terms, require_optional=True)
        return left if isinstance(left, Template) else None

    def completed(self, nodes: list[str], mappings: DataFrame, namespace: str) -> DataFrame:
        """The triples that the template still lacks, for all mappings of a part at once.

        What ``remaining`` says of one mapping is filled for each: bound parameters stand for what they are
        mapped to, required ones that are not get names minted from the mapping, optional ones are left out.
        """
        bound = {param_name(n): self._name(n) for n in nodes if is_param(n)}
        covered = set(self._within(nodes))
        left = replace(self.template, body=tuple(x for x in self.template.body if x not in covered), dependencies=())
        rows = mappings.select(*[F.col(c).alias(p) for p, c in bound.items()])
        key = F.concat_ws("\x1f", *[F.col(f"`{p}`") for p in sorted(bound)])
        return left.graph(left.fill(rows, namespace, key))

    def unmatched(self, nodes: list[str], edges: list[Edge], mappings: DataFrame) -> DataFrame:
        """The graph without the triples that some mapping covers: those of the graph's own predicates, below the template's or any."""
        covered = []
        for e in edges:
            under = self.lying.where(F.col("edge") == self.edges.index(e)).select("s", "p", "o")
            ends = mappings.select(F.col(self._name(e[0])).alias("s"), F.col(self._name(e[2])).alias("o")).distinct()
            covered.append(under.join(ends, ["s", "o"], "left_semi").select("s", "p", "o"))
        return difference(self.g.select("s", "p", "o"), reduce(DataFrame.unionByName, covered).distinct()) if covered else self.g
