"""Graph templates: small driver-side plans that turn a DataFrame of bindings into a graph."""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.closure import widen
from ..terms import A, BAD_IRI, LABEL, is_param, param, param_name, term_of

Triple = tuple[str, str, str]


class Unresolved(Exception):
    """A dependency names a template that is not there, or templates depend on each other in a circle."""


@dataclass(frozen=True)
class Dependency:
    template: str
    args: dict[str, str]
    library: str | None = None


@dataclass(frozen=True)
class Template:
    name: str
    body: tuple[Triple, ...]
    optional: frozenset[str] = frozenset()
    dependencies: tuple[Dependency, ...] = ()
    #: Finds (library, name) at the time of use; None if there is no such template.
    lookup: Callable[[str | None, str], "Template | None"] = field(default=lambda library, name: None, compare=False)

    # --- parameters

    @property
    def parameters(self) -> set[str]:
        return {param_name(t) for triple in self.body for t in triple if is_param(t)}

    @property
    def dependency_parameters(self) -> set[str]:
        return set().union(*(self._of(d).parameters for d in self.dependencies))

    @property
    def all_parameters(self) -> set[str]:
        return self.parameters | self.dependency_parameters

    def parameter_counts(self) -> Counter:
        """How many templates among this one and all it depends on use each parameter."""
        return reduce(Counter.__add__, (self._of(d).parameter_counts() for d in self.dependencies), Counter(self.parameters))

    def transitive_parameters(self, above: tuple[str, ...] = ()) -> set[str]:
        out = set(self.parameters)
        for d in self.dependencies:
            inner = self._of(d, above).transitive_parameters((*above, self.name))
            out |= set(self._renamed(d, inner).values())
        return out

    def dependency_for(self, parameter: str) -> Template | None:
        """The template whose ``name`` is bound to this parameter."""
        return next((self._of(d) for d in self.dependencies if d.args.get("name") == parameter), None)

    def _of(self, d: Dependency, above: tuple[str, ...] = ()) -> Template:
        found = self.lookup(d.library, d.template)
        if found is None:
            raise Unresolved(f"{self.name} depends on {d.template}, which is not there")
        if found.name in (*above, self.name):
            raise Unresolved(f"{self.name} and {found.name} depend on each other")
        return found

    @staticmethod
    def _renamed(d: Dependency, inner: Iterable[str]) -> dict[str, str]:
        """Names given by the arguments; others are scoped by what ``name`` is bound to."""
        return dict(d.args) | {p: f"{d.args['name']}-{p}" for p in inner if p not in d.args and p != "name"}

    def check(self) -> None:
        """Raises ValueError unless the dependencies' arguments fit."""
        for d in self.dependencies:
            if "name" not in d.args:
                raise ValueError(f"dependency {d.template} of {self.name} has no 'name' argument")
            inner, own = self._of(d).transitive_parameters(), self.transitive_parameters()
            if not set(d.args) <= inner or not set(d.args.values()) <= own or d.args["name"] not in self.parameters:
                raise ValueError(f"arguments {d.args} don't fit {self.name} and {d.template}")

    # --- rewriting

    def substitute(self, terms: dict[str, str]) -> Template:
        """Parameters replaced by terms (or by other parameters)."""
        put = lambda t: terms.get(param_name(t), t) if is_param(t) else t
        return replace(self, body=tuple(dict.fromkeys(tuple(map(put, x)) for x in self.body)))

    def rename(self, names: dict[str, str]) -> Template:
        return replace(self.substitute({k: param(v) for k, v in names.items()}), optional=frozenset(names.get(p, p) for p in self.optional))

    def to_inline(self, keep: Iterable[str] = ()) -> Template:
        """Every parameter but those kept gets a suffix that marks it as inlined, once."""
        return self.rename({p: f"{p}-{self.name}-inlined" for p in self.parameters if p not in set(keep) and not p.endswith("-inlined")})

    def inline(self, above: tuple[str, ...] = ()) -> Template:
        """One flat template with the bodies of all dependencies.

        A dependency's parameter is optional if the dependency says so and this template does not
        require it, if it has the name of an optional parameter here, or if its ``name`` is optional.
        """
        body, optional = list(self.body), set(self.optional)
        for d in self.dependencies:
            inner = self._of(d, above).inline((*above, self.name))
            inner = inner.rename(self._renamed(d, inner.parameters))
            here = {param_name(t) for x in body for t in x if is_param(t)}
            may = (inner.optional - here) | (optional & inner.parameters)
            if d.args["name"] in may:
                may |= inner.parameters
            optional = (optional | may) - (here - optional)
            body += inner.body
        return replace(self, body=tuple(dict.fromkeys(body)), optional=frozenset(optional), dependencies=())

    # --- evaluation

    def evaluate(self, terms: dict[str, str], require_optional: bool = False) -> Template | list[Triple]:
        """One set of bindings: the triples if all that is needed is bound, else the template that is left."""
        left = self.substitute(terms)
        missing = left.parameters
        if missing and (require_optional or not missing <= self.optional):
            return replace(left, optional=self.optional & missing)
        return [x for x in left.body if not any(map(is_param, x))]

    def graph(self, bindings: DataFrame, require_optional: bool = False, prefix: str = "", only: set[str] | None = None, bag: bool = False) -> DataFrame:
        """All rows of bindings (a column of terms for each parameter) at once, as a graph.

        A row with a null in a required parameter gives nothing - ``complete`` tells which - and
        triples of unbound optional parameters are left out.  Blank nodes of the body are fresh for
        each row.  ``only`` limits the triples to some predicates before any are made.  A ``bag`` may have a
        triple twice: for what goes into a union of graphs, which tells its triples apart.
        """
        names = self.parameters
        have = {p: F.col(f"`{prefix}{p}`") for p in names if f"{prefix}{p}" in bindings.columns}
        needed = sorted(names if require_optional else names - self.optional)
        if any(p not in have for p in needed):
            raise ValueError(f"{self.name} needs bindings for {[p for p in needed if p not in have]}")
        rows = bindings.dropna(subset=[f"`{prefix}{p}`" for p in needed]) if needed else bindings
        triples = rows.select(F.inline(self.triples(have, only))).dropna()
        return triples if bag else triples.dropDuplicates()

    @staticmethod
    def row_key(have: dict[str, Column]) -> Column:
        """What names the fresh blank nodes of a row, from the parameters' columns."""
        return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for _, c in sorted(have.items())]), 256), 1, 32)

    def triples(self, have: dict[str, Column], only: set[str] | None = None, key: Column | None = None) -> Column:
        """The body as an array of (s, p, o), from the parameters' columns: one pass over the rows, however many triples it has.

        ``key`` is the rows' ``row_key``, if it stands in a column already.
        """
        key = self.row_key(have) if key is None else key

        def col(t: str) -> Column:
            if is_param(t):
                return have.get(param_name(t), F.lit(None).cast("string"))
            return F.concat(F.lit(f"{t}-"), key) if t.startswith("_:") else F.lit(t)

        return F.array(*[F.struct(col(s).alias("s"), col(p).alias("p"), col(o).alias("o")) for s, p, o in self.body if only is None or p in only])

    def complete(self, bindings: DataFrame, require_optional: bool = False) -> Column:
        """Whether a row binds all that is needed."""
        needed = self.parameters if require_optional else self.parameters - self.optional
        have = [F.col(f"`{p}`").isNotNull() if p in bindings.columns else F.lit(False) for p in sorted(needed)]
        return reduce(lambda a, b: a & b, have, F.lit(True))

    def fill(self, bindings: DataFrame, namespace: str, key: Column, include_optional: bool = False) -> DataFrame:
        """Missing and null parameters get names minted from ``key``: ``<namespace><parameter>_<32 hex>``."""
        for p in sorted(self.parameters if include_optional else self.parameters - self.optional):
            mint = _minted(namespace, p, key)
            bindings = bindings.withColumn(p, F.coalesce(F.col(f"`{p}`"), mint) if p in bindings.columns else mint)
        return bindings

    def header(self) -> list[str]:
        """Columns of a table to fill in: what is required, then what is optional."""
        return [*sorted(self.parameters - self.optional), *sorted(self.parameters & self.optional)]

    def csv(self, path: str | None = None) -> str:
        """The header as one line of CSV, written to ``path`` if given."""
        text = io.StringIO()
        csv.writer(text, lineterminator="\n").writerow(self.header())
        if path is not None:
            with open(path, "w", newline="") as f:
                f.write(text.getvalue())
        return text.getvalue()

    # --- dependencies

    def depending(self, template: str, args: dict[str, str], library: str | None = None) -> Template:
        """With one more dependency, whose arguments must fit."""
        out = replace(self, dependencies=(*self.dependencies, Dependency(template, dict(args), library)))
        out.check()
        return out

    def not_depending(self, template: str, args: dict[str, str] | None = None) -> Template:
        """Without the dependencies on a template, or without those with just these arguments."""
        return replace(self, dependencies=tuple(d for d in self.dependencies if d.template != template or args not in (None, d.args)))


def _minted(namespace: str, p: str, key: Column) -> Column:
    return F.concat(F.lit(f"<{namespace}{p}_"), F.md5(F.concat_ws("\x1f", key.cast("string"), F.lit(p))), F.lit(">"))


# --- templates from specifications

# Predicates that the short rules of a specification stand for, and the vocabularies of network references.
#: (rule, predicate in the given namespace)
RULES = {"hasPoint": "hasPoint", "hasPart": "hasPart", "upstream": "isFedBy", "downstream": "feeds"}
NETWORK = "http://data.ashrae.org/bacnet/2020#"
REFERENCES = "https://brickschema.org/schema/Brick/ref#"


def from_spec(name: str, spec: dict, read_turtle: Callable[[str], list[Triple]], namespace: str, lookup=lambda library, name: None) -> Template:
    """A template from a mapping: ``body`` (Turtle), ``type``, the rules of RULES, ``bacnet``, ``optional``, ``dependencies``.

    A rule of RULES names parameters, in a list or as a mapping to their types.  ``bacnet`` names those that
    get a network reference: an object of their own, ``<parameter>_object``, on one device.
    """
    body: list[Triple] = []
    here, device = param("name"), param("BACnet_device")
    for rule, value in spec.items():
        if rule in ("optional", "dependencies"):
            continue
        named = value if isinstance(value, (list, dict)) else [value]
        if rule == "body":
            body += read_turtle(value)
        elif rule == "type":
            body.append((here, A, value if value.startswith("<") else f"<{value}>"))
        elif rule in RULES:
            if isinstance(named, dict):
                body += [(param(v), A, kind if kind.startswith("<") else f"<{kind}>") for v, kind in named.items()]
            body += [(here, f"<{namespace}{RULES[rule]}>", param(v)) for v in named]
        elif rule == "bacnet":
            body.append((device, A, f"<{NETWORK}BACnetDevice>"))
            for v in named:
                node = f"_:network-{v}"
                body += [(param(v), f"<{REFERENCES}hasExternalReference>", node), (node, f"<{NETWORK}object-identifier>", param(f"{v}_object")), (node, f"<{NETWORK}objectOf>", device)]
        else:
            raise ValueError(f"unknown rule {rule} in template {name}")
    needs = tuple(Dependency(d["template"], dict(d.get("args", {})), d.get("library")) for d in spec.get("dependencies", ()))
    return Template(name, tuple(dict.fromkeys(body)), frozenset(spec.get("optional", ())), needs, lookup)


# --- records to graphs


def ingest(template: Template, records: DataFrame, namespace: str, mapper: Callable[[str], str] = lambda column: column, require_optional: bool = True, fill_unused: bool = False, key: Column | None = None) -> DataFrame:
    """Records (string columns) through a template.  Cells become IRIs in ``namespace`` where they can, else literals.

    Without ``fill_unused`` a record that leaves parameters unbound is an error; with it they are minted from ``key``.
    """
    flat = template.inline()
    wanted = {mapper(c): c for c in records.columns if mapper(c) in flat.parameters}
    told = key if key is not None else F.concat_ws("\x1f", *[F.col(f"`{c}`").cast("string") for c in records.columns])
    records = records.withColumn("_key", told)  # of the record as it came, not of its terms
    b = records.select("*", *[term_of(F.col(f"`{c}`").cast("string"), namespace).alias(p) for p, c in wanted.items() if p != c]).withColumns({p: term_of(F.col(f"`{c}`").cast("string"), namespace) for p, c in wanted.items() if p == c})
    if fill_unused:
        b = flat.fill(b, namespace, F.col("_key"))
    elif not b.where(~flat.complete(b, require_optional)).isEmpty():
        raise ValueError(f"some records leave parameters of {template.name} unbound")
    return flat.graph(b, require_optional=require_optional and not fill_unused)


def choose(records: DataFrame, route: Column, templates: dict[str, Template], namespace: str, key: Column) -> DataFrame:
    """Each record through the template that ``route`` names, unbound parameters filled; records without one are left out.

    One pass over the records: each makes the array of triples of its own template.
    """
    made = None
    for name, t in templates.items():
        flat = t.inline()
        have = {p: term_of(F.col(f"`{p}`").cast("string"), namespace) for p in flat.parameters if p in records.columns}
        have |= {p: F.coalesce(have[p], _minted(namespace, p, key)) if p in have else _minted(namespace, p, key) for p in flat.parameters - flat.optional}
        own = flat.triples(have)
        made = F.when(F.col("_route") == name, own) if made is None else made.when(F.col("_route") == name, own)
    routed = records.withColumn("_route", route)
    return routed.select(F.inline(made)).dropna().dropDuplicates()


def label_untitled(g: DataFrame) -> DataFrame:
    """Adds to every typed subject without a label the local name of its type."""
    typed = g.where(F.col("p") == A).join(g.where(F.col("p") == LABEL).select("s"), "s", "left_anti")
    local = F.regexp_extract("o", r"([^#/]+)>$", 1)
    return g.unionByName(typed.select("s", F.lit(LABEL).alias("p"), F.concat(F.lit('"'), local, F.lit('"')).alias("o"))).dropDuplicates()


def bindings_from_json(rows: DataFrame, column: str, parameters: Iterable[str], base: str) -> DataFrame:
    """Bindings from JSON texts {parameter: {"@id"} or {"@literal", "@datatype"}}; ids are relative to ``base``."""
    kind = "map<string,struct<`@id`:string,`@literal`:string,`@datatype`:string>>"
    parsed = rows.withColumn("_m", F.from_json(column, kind))
    from ..terms import literal_col

    def term(p):
        x = F.col("_m")[p]
        typed = F.when(x["@datatype"].isNotNull(), F.concat(literal_col(x["@literal"]), F.lit("^^<"), x["@datatype"], F.lit(">"))).otherwise(literal_col(x["@literal"]))
        return F.when(x["@id"].isNotNull(), F.concat(F.lit(f"<{base}/"), F.regexp_replace(x["@id"], BAD_IRI, "_"), F.lit(">"))).otherwise(typed)

    return parsed.select(*[c for c in rows.columns if c not in set(parameters)], *[term(p).alias(p) for p in parameters])


class Builder:
    """Collects calls of templates and turns them into one graph.

    ``add`` is a single call, whose terms are strings; ``add_rows`` calls a template for every row of
    a table, whose terms are columns.  What a call returns may be bound in later ones.
    """

    def __init__(self, spark, namespace: str):
        self.spark, self.namespace, self.calls, self.tables = spark, namespace, [], []

    def add(self, template: Template, **terms: str) -> dict[str, str]:
        """Records a call; the terms of all required parameters, those not given being minted from the call's number."""
        flat = template.inline()
        n = len(self.calls)
        full = {p: terms.get(p, f"<{self.namespace}{p}_{n}>") for p in flat.parameters - flat.optional} | terms
        self.calls.append((flat, full))
        return full

    def add_rows(self, template: Template, bindings: DataFrame, key: Column) -> DataFrame:
        """Records a call for each row; the rows with the terms of all required parameters, null or missing ones minted from ``key`` and the call's number.

        Rows of one key and the same call mint the same terms.  Other columns stay, so that a later call can bind them.
        """
        flat = template.inline()
        full = flat.fill(bindings, self.namespace, F.concat_ws("\x1f", key.cast("string"), F.lit(f"call {len(self.tables)}")))
        self.tables.append((flat, full))
        return full

    def compile(self) -> DataFrame:
        rows = [x for t, terms in self.calls for x in t.evaluate(terms)]
        made = [t.graph(b, bag=True) for t, b in self.tables]
        if rows or not made:
            made.append(self.spark.createDataFrame(rows, "s string, p string, o string"))
        return label_untitled(widen(reduce(DataFrame.unionByName, made)).dropDuplicates())
