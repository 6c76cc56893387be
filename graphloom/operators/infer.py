"""Rules to a fixpoint, each round from what the round before has added.

A rule tells what it reads and what may make its conditions false.  Rules whose conditions can
become false run after all that may do so (strata); inside a stratum the first round reads the graph,
and every later one starts from the last round's triples: a pattern is joined from those of its
predicate, a shape is checked again on the foci that they touch.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.patterns import Text
from ..plans.shapes import ANY, Shape, ShapeGraph, dependence, inline, predicates, sh, target_reads
from ..terms import A, SUBCLASS
from . import algebra, solve
from .algebra import Pattern, bgp, construct, inverse, path_pairs
from .closure import SMALL, ancestors, cut, shared_folder, widen
from .graph import COLUMNS, difference
from .validate import Validator

#: A rule may also be any function that makes triples from the graph; it reads all of it in every round.
Rule = Callable[[DataFrame], DataFrame]
EVERY = "every focus"


@dataclass
class State:
    """The graph of a round, what the last round added to it, and the predicates of that (None: any)."""

    g: DataFrame
    delta: DataFrame | None = None
    touched: set[str] | None = None
    hierarchy: DataFrame | None = None

    def touches(self, reads: set[str]) -> bool:
        return self.touched is None or ANY in reads or bool(self.touched & reads)

    def part(self, predicate: str) -> DataFrame:
        return self.delta.where(F.col("p") == predicate)

    def typed(self, cls: str) -> DataFrame:
        """(focus) of what the last round made an instance of a class or of its subclasses."""
        kinds = self.validator.up.where(F.col("ancestor") == cls).select(F.col("child").alias("o")).unionByName(self.g.sparkSession.range(1).select(F.lit(cls).alias("o")))
        return self.part(A).join(kinds, "o", "left_semi").select(F.col("s").alias("focus"))

    @cached_property
    def validator(self) -> Validator:
        return Validator(self.g, hierarchy=self.hierarchy, is_table=True)


def new_targets(shape: Shape, at: State) -> DataFrame | str | None:
    """Foci that the last round's triples may have made targets."""
    parts = []
    for kind, t in shape.targets:
        if kind == "class":
            if at.touches({SUBCLASS}):
                return EVERY
            if at.touches({A}):
                parts.append(at.typed(t))
        elif kind in ("subjects", "objects") and at.touches({t}):
            parts.append(at.part(t).select(F.col("s" if kind == "subjects" else "o").alias("focus")))
        elif kind == "select":
            return EVERY
    return reduce(DataFrame.unionByName, parts) if parts else None


def affected(shape: Shape, at: State) -> DataFrame | str | None:
    """Foci for which the last round's triples may change whether they conform."""
    parts, values = [], []
    if at.touches(set(predicates(shape.path))):
        if isinstance(shape.path, str):
            parts.append(at.part(shape.path).select(F.col("s").alias("focus")))
        elif shape.path is not None and shape.path[0] == "inv" and isinstance(shape.path[1], str):
            parts.append(at.part(shape.path[1]).select(F.col("o").alias("focus")))
        elif shape.path is not None:
            return EVERY
    for name, arg in shape.constraints:
        if name == "class":
            if at.touches({SUBCLASS}):
                return EVERY
            if at.touches({A}):
                values.append(at.typed(arg))
        elif name in ("closed", "sparql", "exactCount"):
            return EVERY
        elif name in ("disjoint", "equals", "lessThan", "lessThanOrEquals") and at.touches({arg}):
            parts.append(at.part(arg).select(F.col("s").alias("focus")))
        for s in arg if isinstance(arg, tuple) else (arg,):
            if isinstance(s, Shape):
                found = affected(s, at)
                if isinstance(found, str):
                    return EVERY
                if found is not None:
                    values.append(found)
    if values:
        v = reduce(DataFrame.unionByName, values).distinct()
        if shape.path is not None:
            v = cut(v)
        if shape.path is None:
            parts.append(v)
        elif not v.isEmpty():  # else the path need not be read
            parts.append(path_pairs(at.g, inverse(shape.path), v.select(F.col("focus").alias("s"))).select(F.col("o").alias("focus")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _conforming(foci: DataFrame, conditions: Sequence[Shape], at: State) -> DataFrame:
    for c in conditions:
        foci = foci.join(at.validator.failing(c, foci), "focus", "left_anti")
    return foci


def _changed_foci(shape: Shape, conditions: Sequence[Shape], at: State) -> DataFrame | None:
    """Conforming foci for which the last round may matter."""
    found = [new_targets(shape, at), *[affected(c, at) for c in conditions]]
    if any(isinstance(x, str) for x in found):
        return _conforming(at.validator.targets(shape), conditions, at)
    some = [x for x in found if x is not None]
    if not some:
        return None
    foci = cut(reduce(DataFrame.unionByName, some).distinct())
    n = foci.count()
    if not n:
        return None
    return _conforming(at.validator.targets(shape).join(F.broadcast(foci) if n <= SMALL else foci, "focus", "left_semi"), conditions, at)


def _names_values(shape: Shape) -> bool:
    """Whether results of a shape may name other nodes than its foci: what its properties lead to."""
    inner = shape.get("property")
    return bool(inner) and shape.path is not None or any(map(_names_values, inner))


def revalidate(v: Validator, shape: Shape, report: DataFrame, added: DataFrame) -> DataFrame:
    """The report of a shape after triples were added to the validator's graph, from the ``report`` of that shape before.

    Only targets for which these triples may change something are checked again; the results of all others stand.
    """
    shape = inline(shape)
    v.prepare([shape])
    touched = sorted(r.p for r in added.select("p").distinct().limit(1000).collect())
    known = len(touched) < 1000
    new = cut(difference(added.select(*COLUMNS).distinct(), v.g.where(F.col("p").isin(touched)) if known else v.g))
    at = State(v.g.unionByName(new), new, set(touched) if known else None, v.up if known and SUBCLASS not in touched else None)
    found = [new_targets(shape, at), affected(shape, at)]
    if any(isinstance(x, str) for x in found) or _names_values(shape):
        return at.validator.report([shape])
    some = [x for x in found if x is not None]
    if shape.deactivated or not some:
        return report
    foci = cut(reduce(DataFrame.unionByName, some).distinct())
    foci = F.broadcast(foci) if foci.count() <= SMALL else foci
    again = at.validator.check(shape, at.validator.targets(shape).join(foci, "focus", "left_semi"))
    return report.join(foci, "focus", "left_anti").unionByName(again)


# --- rules


@dataclass(frozen=True)
class TripleRule:
    """For each target of the shape that conforms to all conditions, one triple; ``$this`` stands for the target."""

    shape: Shape
    subject: str
    predicate: str
    object: str
    conditions: tuple[Shape, ...] = ()

    def __call__(self, g: DataFrame, hierarchy: DataFrame | None = None) -> DataFrame:
        return self.first(State(g, hierarchy=hierarchy))

    def reads(self) -> set[str]:
        return target_reads(self.shape).union(*(dependence(c)[0] for c in self.conditions))

    def breaks(self) -> set[str]:
        return set().union(*(dependence(c)[1] for c in self.conditions))

    def writes(self) -> set[str]:
        return {ANY if self.predicate == "$this" else self.predicate}

    def _said(self, foci: DataFrame) -> DataFrame:
        col = lambda t: F.col("focus") if t == "$this" else F.lit(t)
        return foci.select(col(self.subject).alias("s"), col(self.predicate).alias("p"), col(self.object).alias("o"))

    def first(self, at: State) -> DataFrame:
        return self._said(_conforming(at.validator.targets(self.shape), self.conditions, at))

    def next(self, at: State) -> DataFrame | None:
        foci = _changed_foci(self.shape, self.conditions, at)
        return None if foci is None else self._said(foci)


def _from_delta(patterns: Sequence[Pattern], at: State, begin: DataFrame | None = None) -> list[DataFrame] | None:
    """Solutions with at least one of the last round's triples, by the pattern that takes it; none if a path is concerned."""
    out = []
    for k, (s, p, o) in enumerate(patterns):
        if not isinstance(p, str):
            if at.touches(set(predicates(p))):
                return None
        elif p.startswith("?") or at.touches({p}):
            found = algebra.match(at.delta, (s, p, o))
            start = found if begin is None else algebra.join(found, begin)
            out.append(bgp(at.g, *patterns[:k], *patterns[k + 1 :], start=start))
    return out


@dataclass(frozen=True)
class PatternRule:
    """Builds the template from each solution of the patterns."""

    where: tuple[Pattern, ...]
    template: tuple[tuple[str, str, str], ...]

    def __call__(self, g: DataFrame) -> DataFrame:
        return construct(bgp(g, *self.where), *self.template)

    def reads(self) -> set[str]:
        return {q for _, p, _ in self.where for q in ([ANY] if isinstance(p, str) and p.startswith("?") else predicates(p))}

    def breaks(self) -> set[str]:
        return set()

    def writes(self) -> set[str]:
        return {ANY if p.startswith("?") else p for _, p, _ in self.template}

    def first(self, at: State) -> DataFrame:
        return self(at.g)

    def next(self, at: State) -> DataFrame | None:
        found = _from_delta(self.where, at)
        if found is None:
            return self(at.g)
        return construct(reduce(DataFrame.unionByName, found), *self.template) if found else None


@dataclass(frozen=True)
class TextRule:
    """A query text that builds triples for the targets of a shape that conform to all conditions."""

    shape: Shape
    text: Text
    conditions: tuple[Shape, ...] = ()

    def __call__(self, g: DataFrame, hierarchy: DataFrame | None = None) -> DataFrame:
        return self.first(State(g, hierarchy=hierarchy))

    def _parts(self) -> tuple[list[Pattern], list] | None:
        """(patterns, filters and bindings) if the text has nothing else."""
        where = self.text.read().where
        if any(kind not in ("triples", "filter", "bind") or kind == "filter" and args[0][0] == "exists" for kind, *args in where):
            return None
        return [t for kind, *args in where if kind == "triples" for t in args[0]], [x for x in where if x[0] != "triples"]

    def _own_reads(self) -> set[str]:
        return _read_by(self.text.read())

    def reads(self) -> set[str]:
        return self._own_reads() | target_reads(self.shape).union(*(dependence(c)[0] for c in self.conditions))

    def breaks(self) -> set[str]:
        out = set().union(*(dependence(c)[1] for c in self.conditions))
        return out | ({ANY} if negated(self.text.read().where) else set())

    def writes(self) -> set[str]:
        return PatternRule((), tuple(self.text.read().template)).writes()

    def first(self, at: State) -> DataFrame:
        return solve.triples(at.g, self.text, _conforming(at.validator.targets(self.shape), self.conditions, at))

    def next(self, at: State) -> DataFrame | None:
        parts = self._parts()
        foci = _conforming(at.validator.targets(self.shape), self.conditions, at)
        found = None if parts is None else _from_delta(parts[0], at, solve.foci_of(foci))
        if found is None:
            return solve.triples(at.g, self.text, foci)
        made = [construct(solve.group(at.g, parts[1], begin=rows), *self.text.read().template) for rows in found]
        fresh = _changed_foci(self.shape, self.conditions, at)
        if fresh is not None:
            made.append(solve.triples(at.g, self.text, fresh))
        return reduce(DataFrame.unionByName, made) if made else None


def _read_by(x) -> set[str]:
    """The predicates of all patterns in a query or a group, nested ones included; ANY if one is a variable."""
    if hasattr(x, "where"):
        return _read_by(x.where) | _read_by(x.columns) | _read_by(x.having)
    if isinstance(x, tuple) and x[:1] == ("triples",):
        return PatternRule(tuple(x[1]), ()).reads()
    return set().union(*map(_read_by, x)) if isinstance(x, (list, tuple)) else set()


def negated(where) -> bool:
    """Whether a group takes anything away."""
    if isinstance(where, tuple) and where and where[0] in ("minus", "optional") or isinstance(where, tuple) and where[:2] == ("exists", True):
        return True
    if hasattr(where, "where"):
        return negated(where.where) or any(e is not None and e[0] == "aggregate" for _, e in where.columns)
    return isinstance(where, (list, tuple)) and any(map(negated, where))


@dataclass(frozen=True)
class Opaque:
    """A function of the graph, of which nothing is known."""

    f: Rule

    def reads(self) -> set[str]:
        return {ANY}

    def breaks(self) -> set[str]:
        return set()

    def writes(self) -> set[str]:
        return {ANY}

    def first(self, at: State) -> DataFrame:
        return self.f(at.g)

    def next(self, at: State) -> DataFrame:
        return self.f(at.g)


def construct_rule(where: Sequence[Pattern], *template: tuple[str, str, str]) -> PatternRule:
    """A rule that builds the template from each solution of the patterns."""
    return PatternRule(tuple(where), tuple(template))


def rules_of(sg: ShapeGraph) -> list[TripleRule | TextRule]:
    """The rules (sh:rule) of the node shapes of a shapes graph; one of a kind that is not known is named in a warning."""
    out: list[TripleRule | TextRule] = []
    for node in dict.fromkeys(s for s, p, _ in sg.triples if p == sh("rule")):
        shape = sg.shape(node)
        for r in sg.values(node, "rule"):
            if sg.values(r, "deactivated") == ['"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'] or shape.deactivated:
                continue
            conditions = tuple(sg.shape(c) for c in sg.values(r, "condition"))
            if sh("TripleRule") in sg.values(r, A) or sg.one(r, "subject") is not None:
                subject, predicate, object_ = ("$this" if t == sh("this") else t for t in (sg.one(r, n) for n in ("subject", "predicate", "object")))
                out.append(TripleRule(shape, subject, predicate, object_, conditions))
            elif sg.one(r, "construct") is not None:
                out.append(TextRule(shape, sg.text(r, "construct"), conditions))
            else:
                warnings.warn(f"rule {r} of {node} is of a kind that is not read", stacklevel=2)
    return out


# --- the fixpoint


def strata(rules: Sequence) -> list[list]:
    """Rules in the order in which their conditions cannot become false any more."""
    level = [0] * len(rules)
    meet = lambda a, b: bool(a & b) or bool(a) and ANY in b or bool(b) and ANY in a
    for _ in range(len(rules) + 1):
        before = list(level)
        for i, r in enumerate(rules):
            for j, w in enumerate(rules):
                if i != j and meet(w.writes(), r.reads()):
                    level[i] = max(level[i], level[j] + meet(w.writes(), r.breaks()))
        if level == before:
            return [[r for r, n in zip(rules, level) if n == k] for k in sorted(set(level))]
        if max(level) > len(rules):
            break
    warnings.warn("some rules' conditions can be made false by what follows from them: all rules run together", stacklevel=3)
    return [list(rules)]


def fixpoint(g: DataFrame, rules: Sequence, limit: int | None = 4, partial: bool = False, added: bool = False) -> DataFrame:
    """``g`` and all that the rules add (with ``added`` only that); a stratum ends with a round that adds nothing.

    If ``limit`` rounds (None: any number) still add triples, what follows from the last of them
    is missing: that is an error unless ``partial`` asks for just so many rounds.  Each round's triples
    are written once, as a part of the graph's table.
    """
    spark = g.sparkSession
    home = f"{shared_folder(g)}/rules-{uuid.uuid4().hex}"

    def read(*paths: str) -> DataFrame:
        return spark.read.schema("s string, p string, o string").option("recursiveFileLookup", "true").parquet(*paths)

    def result() -> DataFrame:
        if not added:
            return read(f"{home}/graph")
        return read(*[f"{home}/graph/{k}" for k in range(1, step + 1)]) if step else spark.createDataFrame([], "s string, p string, o string")

    widen(g).select(*COLUMNS).dropDuplicates().sortWithinPartitions("p", "s").write.parquet(f"{home}/graph/0")
    known_rules = [r if hasattr(r, "first") else Opaque(r) for r in rules]
    hierarchy, rounds, step = None, 0, 0
    for own in strata(known_rules):
        at = State(read(f"{home}/graph"), hierarchy=hierarchy)
        while True:
            if rounds == limit and partial:
                return result()
            if at.hierarchy is None and any({A, SUBCLASS} & r.reads() and not isinstance(r, (PatternRule, Opaque)) for r in own):
                at.hierarchy = cut(ancestors(at.g))
            parts = [r.first(at) if at.delta is None else r.next(at) for r in own if at.delta is None or at.touches(r.reads())]
            parts = [x.select(*COLUMNS) for x in parts if x is not None]
            hierarchy = at.hierarchy
            if not parts:
                break
            step += 1
            reduce(DataFrame.unionByName, parts).dropDuplicates().write.parquet(f"{home}/made/{step}")
            made = read(f"{home}/made/{step}")
            kinds = [r.p for r in made.select("p").distinct().limit(1000).collect()]
            there = at.g.where(F.col("p").isin(kinds)) if len(kinds) < 1000 else at.g
            if made.count() <= SMALL:  # what is known of a few triples is found without a shuffle of the graph
                hits = there.join(F.broadcast(made), COLUMNS, "left_semi")
                new = made.join(F.broadcast(hits), COLUMNS, "left_anti")
            else:
                new = difference(made, there)
            new.sortWithinPartitions("p", "s").write.parquet(f"{home}/graph/{step}")
            delta = read(f"{home}/graph/{step}")
            touched = {r.p for r in delta.select("p").distinct().limit(1000).collect()}
            if not touched:
                break
            if rounds == limit:
                raise ValueError(f"the rules still add triples after {limit} rounds")
            rounds += 1
            at = State(read(f"{home}/graph"), delta, touched if len(touched) < 1000 else None, None if SUBCLASS in touched or len(touched) == 1000 else at.hierarchy)
            hierarchy = at.hierarchy
    return result()


def infer(data: DataFrame, shapes: DataFrame, rules: Sequence, limit: int | None = None) -> DataFrame:
    """The fixpoint over data and shapes together, without the shapes' own triples."""
    return difference(fixpoint(data.unionByName(shapes), rules, limit), shapes)
