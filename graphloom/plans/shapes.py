"""Shapes as driver-side plans: read from a shapes graph or built in Python."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field, replace

from ..terms import A, OWL, RDF, RDFS, SH, SUBCLASS, qname, text_of
from .patterns import Text

Triple = tuple[str, str, str]
#: Namespace of the exact-count component unless a shapes graph is read with another.
CONSTRAINT = "urn:graphloom/constraint#"


def sh(name: str) -> str:
    return f"<{SH}{name}>"


@dataclass(frozen=True)
class Shape:
    """A node shape (no path) or a property shape.

    ``constraints`` are (name, value) pairs with SHACL's names; values are terms, numbers, Shapes
    or tuples of them.  ``qualified`` has (shape, min, max), ``pattern`` (regex, flags),
    ``exactCount`` (class, n), ``sparql`` a function (graph, foci) -> DataFrame (focus, value) or a
    query text with its message.  ``targets`` are (kind, term) with kind class, node, subjects or
    objects, or ``select`` with a query text.
    """

    id: str
    path: object = None
    targets: tuple[tuple[str, object], ...] = ()
    constraints: tuple[tuple[str, object], ...] = ()
    severity: str = "Violation"
    message: str | None = None
    deactivated: bool = False
    name: str | None = None

    def get(self, name: str):
        return [v for n, v in self.constraints if n == name]

    # --- building

    def having(self, *constraints: tuple[str, object]) -> Shape:
        return replace(self, constraints=(*self.constraints, *constraints))

    def targeting(self, kind: str, *terms: str) -> Shape:
        return replace(self, targets=(*self.targets, *((kind, t) for t in terms)))

    def of_class(self, cls: str, active: bool = False) -> Shape:
        out = self.having(("class", cls))
        return out.targeting("class", cls) if active else out

    def count(self, exactly: int = 0, min: int = 0, max: int = 0) -> Shape:
        """Counts; a count of 0 is not set."""
        low, high = exactly or min, exactly or max
        return self.having(*((("minCount", low),) if low else ()), *((("maxCount", high),) if high else ()))

    def has_property(self, *shapes: Shape) -> Shape:
        return self.having(*(("property", s) for s in shapes))

    def matches(self, value: str | Shape, min: int = 0, max: int = 0, exactly: int = 0, qualified: bool = False) -> Shape:
        """Values are of a class (a term) or conform to a shape, this often; ``qualified``: at least among the others."""
        what = ("class", value) if isinstance(value, str) else ("node", value)
        if not qualified:
            return self.having(what).count(exactly, min, max)
        return self.having(("qualified", (Shape(f"{self.id}-value", constraints=(what,)), exactly or min or None, exactly or max or None)))

    def __or__(self, other: Shape) -> Shape:
        return any_of(self, other)

    def __and__(self, other: Shape) -> Shape:
        return all_of(self, other)


def any_of(*shapes: Shape) -> Shape:
    return Shape("or(" + ",".join(s.id for s in shapes) + ")", constraints=(("or", shapes),))


def all_of(*shapes: Shape) -> Shape:
    return Shape("and(" + ",".join(s.id for s in shapes) + ")", constraints=(("and", shapes),))


def one_of(*shapes: Shape) -> Shape:
    return Shape("xone(" + ",".join(s.id for s in shapes) + ")", constraints=(("xone", shapes),))


def negation(shape: Shape) -> Shape:
    return Shape(f"not({shape.id})", constraints=(("not", shape),))


@dataclass(frozen=True)
class TextConstraint:
    """A query text whose solutions are results; ``message`` may name their variables as {?x}."""

    text: Text
    message: str | None = None


def predicates(path) -> tuple[str, ...]:
    """The predicates of a path; none of no path."""
    return () if path is None else (path,) if isinstance(path, str) else tuple(q for p in path[1:] for q in predicates(p))


#: Stands for all predicates in what a shape reads.
ANY = "*"


# --- what shapes depend on

def _values_matter(name: str) -> bool:
    """Constraints that every value has to meet, so that one more value may break them."""
    return name not in ("minCount", "hasValue", "qualified", "property", "exactCount")


def dependence(shape: Shape) -> tuple[set[str], set[str]]:
    """(predicates that a shape reads, those of which one more triple may make it fail); ``ANY`` for all."""
    reads, breaks = set(predicates(shape.path)), set()
    own = set(reads)
    for name, arg in shape.constraints:
        inner = [x for x in (arg if isinstance(arg, tuple) else (arg,)) if isinstance(x, Shape)]
        for s in inner:
            r, b = dependence(s)
            reads |= r
            breaks |= r | b if name in ("not", "xone") or name == "qualified" and arg[2] is not None else b
        if name == "class":
            reads |= {A, SUBCLASS}
        if name == "exactCount":
            reads, breaks = reads | {A}, breaks | {A}
        if name in ("disjoint", "equals", "lessThan", "lessThanOrEquals"):
            reads, breaks = reads | {arg}, breaks | {arg}
        if name == "closed" or name == "sparql":
            reads, breaks = reads | {ANY}, breaks | {ANY}
        if shape.path is not None and (_values_matter(name) or name == "property" or name == "qualified" and arg[2] is not None):
            breaks |= own
    return reads, breaks


def target_reads(shape: Shape) -> set[str]:
    out: set[str] = set()
    for kind, t in shape.targets:
        out |= {A, SUBCLASS} if kind == "class" else {t} if kind in ("subjects", "objects") else {ANY} if kind == "select" else set()
    return out


# --- paths as text


def path_text(path, prefixes: dict[str, str]) -> str:
    if isinstance(path, str):
        return qname(path, prefixes)
    kind, *parts = path
    said = [path_text(p, prefixes) for p in parts]
    if kind == "seq":
        return "/".join(said)
    if kind == "alt":
        return "(" + "|".join(said) + ")"
    inner = said[0] if isinstance(parts[0], str) else f"({said[0]})"
    return f"^{inner}" if kind == "inv" else inner + kind


# --- reading a shapes graph


@dataclass
class ShapeGraph:
    triples: list[Triple]
    component_namespace: str = CONSTRAINT
    #: Prefixes for query texts beside those that the graph declares (sh:declare).
    prefixes: dict[str, str] = field(default_factory=dict)
    by_subject: dict = field(init=False)

    def __post_init__(self):
        self.by_subject = defaultdict(lambda: defaultdict(list))
        for s, p, o in self.triples:
            self.by_subject[s][p].append(o)
        declared = [(self.one(d, "prefix"), self.one(d, "namespace")) for _, p, d in self.triples if p == sh("declare")]
        self.known = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "sh": SH} | self.prefixes | {text_of(k): text_of(ns) for k, ns in declared if k and ns}

    def text(self, node: str, name: str, path=None) -> Text:
        """A query text of a node, with all prefixes that are known."""
        return Text(text_of(self.one(node, name)), tuple(sorted(self.known.items())), path)

    def values(self, s: str, *names: str) -> list[str]:
        return [o for n in names for o in self.by_subject[s][n if n.startswith("<") else sh(n)]] if s in self.by_subject else []

    def one(self, s: str, *names: str) -> str | None:
        return next(iter(self.values(s, *names)), None)

    def items(self, head: str) -> list[str]:
        """Members of an RDF list."""
        out, nil = [], f"<{RDF}nil>"
        while head and head != nil:
            out.append(self.one(head, f"<{RDF}first>"))
            head = self.one(head, f"<{RDF}rest>")
        return out

    def path(self, node: str):
        if self.values(node, f"<{RDF}first>"):
            return ("seq", *map(self.path, self.items(node)))
        # the second spelling of each is what some builders emit
        for kind, *names in (("inv", "inversePath", "path-inverse"), ("?", "zeroOrOnePath", "path-zero-or-one"), ("+", "oneOrMorePath", "path-one-or-more"), ("*", "zeroOrMorePath", "path-zero-or-more")):
            inner = self.one(node, *names)
            if inner:
                return (kind, self.path(inner))
        choice = self.one(node, "alternativePath")
        return ("alt", *map(self.path, self.items(choice))) if choice else node

    def node_shapes(self) -> list[str]:
        return [s for s, p, o in self.triples if p == A and o == sh("NodeShape")]

    def shape(self, node: str, above: tuple[str, ...] = ()) -> Shape:
        """The shape of a node with everything it refers to; shapes that refer to themselves are an error."""
        if node in above:
            raise ValueError(f"recursive shape {text_of(node)}")
        sub = lambda n: self.shape(n, (*above, node))
        num = lambda t: int(text_of(t))
        c: list[tuple[str, object]] = []
        for name in ("minCount", "maxCount", "minLength", "maxLength"):
            c += [(name, num(t)) for t in self.values(node, name)]
        for name in ("class", "datatype", "nodeKind", "hasValue", "disjoint", "equals", "lessThan", "lessThanOrEquals"):
            c += [(name, t) for t in self.values(node, name)]
        for name in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive"):
            c += [(name, float(text_of(t))) for t in self.values(node, name)]
        for name in ("in", "languageIn"):
            c += [(name, tuple(self.items(t))) for t in self.values(node, name)]
        flags = self.one(node, "flags")
        c += [("pattern", (text_of(t), text_of(flags) if flags else "")) for t in self.values(node, "pattern")]
        c += [("uniqueLang", True) for t in self.values(node, "uniqueLang") if text_of(t) == "true"]
        for name in ("node", "property", "not"):
            c += [(name, sub(t)) for t in self.values(node, name)]
        for name in ("or", "and", "xone"):
            c += [(name, tuple(map(sub, self.items(t)))) for t in self.values(node, name)]
        for t in self.values(node, "qualifiedValueShape"):
            low, high = self.one(node, "qualifiedMinCount"), self.one(node, "qualifiedMaxCount")
            c.append(("qualified", (sub(t), num(low) if low else None, num(high) if high else None)))
        if any(text_of(t) == "true" for t in self.values(node, "closed")):
            free = [x for t in self.values(node, "ignoredProperties") for x in self.items(t)]
            c.append(("closed", tuple(free + [p for q in self.values(node, "property") for p in self.values(q, "path")])))
        for t in self.values(node, f"<{self.component_namespace}exactCount>"):
            c.append(("exactCount", (self.one(node, f"<{self.component_namespace}class>"), num(t))))
        targets = [(kind, t) for kind, name in (("class", "targetClass"), ("node", "targetNode"), ("subjects", "targetSubjectsOf"), ("objects", "targetObjectsOf")) for t in self.values(node, name)]
        kinds = self.values(node, A)
        if sh("NodeShape") in kinds and (f"<{OWL}Class>" in kinds or f"<{RDFS}Class>" in kinds):
            targets.append(("class", node))
        path, severity, message = self.one(node, "path"), self.one(node, "severity"), self.one(node, "message")
        targets += [("select", self.text(t, "select")) for t in self.values(node, "target") if self.one(t, "select")]
        for t in self.values(node, "sparql"):
            if not any(text_of(x) == "true" for x in self.values(t, "deactivated")) and self.one(t, "select"):
                said = self.one(t, "message")
                c.append(("sparql", TextConstraint(self.text(t, "select", self.path(path) if path else None), text_of(said) if said else None)))
        if path is None and sh("PropertyShape") in kinds:
            raise ValueError(f"property shape {text_of(node)} has no sh:path")
        name = self.one(node, "name", f"<{RDFS}label>")
        return Shape(
            node,
            self.path(path) if path else None,
            tuple(targets),
            tuple(c),
            text_of(severity).rpartition("#")[2] if severity else "Violation",
            text_of(message) if message else None,
            any(text_of(t) == "true" for t in self.values(node, "deactivated")),
            text_of(name).replace(" ", "_") if name else None,
        )

    def shapes(self) -> list[Shape]:
        return [self.shape(n) for n in dict.fromkeys(self.node_shapes())]


def inline(shape: Shape) -> Shape:
    """``and`` and ``node`` constraints of node shapes replaced by what they refer to, so that results name this shape."""
    if shape.path is not None:
        return shape
    out = shape
    while out.get("and") or out.get("node"):
        parts = [m for ms in out.get("and") for m in ms] + out.get("node")
        kept = tuple(c for c in out.constraints if c[0] not in ("and", "node"))
        out = replace(out, constraints=tuple(dict.fromkeys(kept + tuple(c for p in parts for c in p.constraints))), targets=tuple(dict.fromkeys(out.targets + tuple(t for p in parts for t in p.targets))))
    return out
