"""Models, libraries and templates by name, over a graph table partitioned by graph id."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import extract, graph, infer, match, validate
from .plans.shapes import Shape, ShapeGraph
from .plans.template import Dependency, Template, from_spec
from .sources import files, turtle
from .sources.snapshots import Folder, GraphTable, Transaction
from .terms import A, BAD_IRI, IMPORTS, ONTOLOGY, OWL, RDFS, SH, iri, literal, param, text_of


class NotFound(KeyError):
    """There is no model, library, template or graph of that name."""


def unique_name(wanted: str, taken) -> str:
    """``wanted``, or with the first of _1, _2, ... that is free."""
    name, n = wanted, 0
    while name in taken:
        n += 1
        name = f"{wanted}_{n}"
    return name


@dataclass
class Library:
    name: str
    templates: dict[str, Template] = field(default_factory=dict)
    shapes: list[tuple[str, str, str]] = field(default_factory=list)


@dataclass
class Model:
    name: str
    graph_id: str
    description: str = ""
    manifest: list[tuple[str, str, str]] = field(default_factory=list)


class Engine:
    """One catalog.  Every model's triples are one partition of the table at ``path``.

    Metadata are Python objects; ``save`` writes them beside that table and ``open`` reads them back.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.models: dict[str, Model] = {}
        self.libraries: dict[str, Library] = {}
        self.table = GraphTable(spark, path)
        self._open: Transaction | None = None

    # --- the catalog as a table

    @staticmethod
    def _versions(spark: SparkSession, path: str) -> DataFrame | None:
        """(version, kind, name, body) of all that was saved, or None if nothing was."""
        try:
            return spark.read.schema("version long, kind string, name string, body string").parquet(f"{path}-catalog")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def save(self) -> int:
        """Adds the metadata as a new version, which is whole once it is there; the number of that version."""
        before = self._versions(self.spark, self.path)
        version = 1 + ((before.agg(F.max("version")).first()[0] or 0) if before is not None else 0)
        claims = Folder(self.spark, f"{self.path}-catalog-claims")
        while not claims.create(f"{version:012d}", ""):  # two that save at once get versions of their own
            version += 1
        rows = [(version, "catalog", "", "")]
        for m in self.models.values():
            rows.append((version, "model", m.name, json.dumps({"graph_id": m.graph_id, "description": m.description, "manifest": m.manifest})))
        for lib in self.libraries.values():
            rows.append((version, "library", lib.name, json.dumps({"shapes": lib.shapes})))
            for t in lib.templates.values():
                needs = [{"template": d.template, "args": d.args, "library": d.library} for d in t.dependencies]
                rows.append((version, "template", t.name, json.dumps({"in": lib.name, "body": t.body, "optional": sorted(t.optional), "dependencies": needs})))
        self.spark.createDataFrame(rows, "version long, kind string, name string, body string").coalesce(1).write.mode("append").parquet(f"{self.path}-catalog")
        return version

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> Engine:
        """The catalog as it was saved last, or as some version of it; without any, an error."""
        saved = cls._versions(spark, path)
        if saved is None:
            raise NotFound(path)
        if version is None:
            version = saved.agg(F.max("version")).first()[0]
        rows = saved.where(F.col("version") == version).collect()  # metadata only
        if not rows:
            raise NotFound(f"{path}, version {version}")
        out = cls(spark, path)
        triples = lambda some: [tuple(x) for x in some]
        said = [(r["kind"], r["name"], json.loads(r["body"])) for r in rows if r["kind"] != "catalog"]
        for kind, name, d in said:
            if kind == "model":
                out.models[name] = Model(name, d["graph_id"], d["description"], triples(d["manifest"]))
            elif kind == "library":
                out.libraries[name] = Library(name, {}, triples(d["shapes"]))
        for kind, name, d in said:
            if kind == "template":
                needs = tuple(Dependency(n["template"], n["args"], n["library"]) for n in d["dependencies"])
                out.libraries[d["in"]].templates[name] = Template(name, tuple(triples(d["body"])), frozenset(d["optional"]), needs, out.find_template)
        return out

    # --- models

    def create_model(self, name: str, description: str = "") -> Model:
        if re.search(BAD_IRI, name) or ":" not in name:
            raise ValueError(f"not an IRI: {name}")
        if name in self.models:
            raise ValueError(f"there is a model {name}")
        m = self.models[name] = Model(name, hashlib.sha256(name.encode()).hexdigest()[:32], description)
        rows = [(iri(name), A, ONTOLOGY)] + ([(iri(name), f"<{RDFS}comment>", literal(description))] if description else [])
        self.add(m, self.frame(rows))
        return m

    def frame(self, triples: Sequence[tuple[str, str, str]]) -> DataFrame:
        return self.spark.createDataFrame(list(triples), "s string, p string, o string")

    def model_from_graph(self, g: DataFrame) -> Model:
        """The model is named by the graph's ontology declaration."""
        head = g.where((F.col("p") == A) & (F.col("o") == ONTOLOGY)).select("s").limit(2).collect()
        if len(head) != 1:
            raise ValueError("the graph must declare one owl:Ontology")
        said = graph.value(g, head[0][0], f"<{RDFS}comment>")
        m = self.create_model(text_of(head[0][0]), text_of(said) if said else "")
        self.add(m, g)
        return m

    def model_from_file(self, path: str) -> Model:
        """A file of any format that ``files`` reads, or all files of a folder; no triple passes through the driver."""
        return self.model_from_graph(graph.cut(files.read(self.spark, path)))

    def model(self, name: str) -> Model:
        if name not in self.models:
            raise NotFound(name)
        return self.models[name]

    def graph(self, m: Model) -> DataFrame:
        """The model's triples, inside a transaction with what it has changed so far."""
        return (self._open or self.table).load(m.graph_id)

    def add(self, m: Model, g: DataFrame) -> None:
        with self._writing() as t:
            t.append(m.graph_id, g)

    def replace(self, m: Model, g: DataFrame) -> None:
        with self._writing() as t:
            t.replace(m.graph_id, g)

    @contextmanager
    def _writing(self) -> Iterator[Transaction]:
        """The open transaction, or one of its own for a single change."""
        if self._open is not None:
            yield self._open
        else:
            with self.table.transaction() as t:
                yield t

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """All changes of graphs and metadata inside are made together; an error takes all of them back."""
        if self._open is not None:
            raise ValueError("a transaction is open")
        models, libraries = dict(self.models), {k: replace(lib, templates=dict(lib.templates), shapes=list(lib.shapes)) for k, lib in self.libraries.items()}
        manifests = {k: list(m.manifest) for k, m in models.items()}
        try:
            with self.table.transaction() as t:
                self._open = t
                yield
        except BaseException:
            self.models, self.libraries = models, libraries
            for k, m in models.items():
                m.manifest = manifests[k]
            raise
        finally:
            self._open = None

    def delete_model(self, name: str) -> None:
        with self._writing() as t:
            t.delete(self.models.pop(self.model(name).name).graph_id)

    # --- libraries

    def library(self, name: str) -> Library:
        if name not in self.libraries:
            raise NotFound(name)
        return self.libraries[name]

    def create_library(self, name: str, overwrite: bool = True) -> Library:
        if name in self.libraries and not overwrite:
            return self.libraries[name]
        self.libraries[name] = Library(name)
        return self.libraries[name]

    def find_template(self, library: str | None, name: str) -> Template | None:
        """By library and name at the time of use, so a library may be loaded anew; without a library, any that has it."""
        places = [self.libraries[library]] if library in self.libraries else [] if library else self.libraries.values()
        return next((lib.templates[name] for lib in places if name in lib.templates), None)

    def template(self, library: str, name: str) -> Template:
        found = self.find_template(library, name)
        if found is None:
            raise NotFound(f"{library}/{name}")
        return found

    def add_template(self, library: str, name: str, spec: dict, prefixes: dict[str, str], namespace: str) -> Template:
        lib = self.library(library)
        if name in lib.templates:
            raise ValueError(f"there is a template {name} in {library}")
        spec = spec | {"dependencies": [{"library": library} | d for d in spec.get("dependencies", [])]}
        lib.templates[name] = from_spec(name, spec, lambda text: turtle.read(text, dict(prefixes)), namespace, self.find_template)
        return lib.templates[name]

    def load_directory(self, path: str, prefixes: dict[str, str], namespace: str, infer_templates: bool = False) -> Library:
        """All YAML files are templates, all Turtle and RDF/XML files shapes; a library of the same name is replaced."""
        import yaml

        root = Path(path)
        lib = self.create_library(root.name)
        found = [f for f in sorted(root.rglob("*")) if ".ipynb_checkpoints" not in f.parts]
        for f in found:
            if f.suffix in (".ttl", ".n3", ".rdf", ".xml"):
                lib.shapes += files.parse(str(f), f.read_bytes())
        for f in found:
            if f.suffix in (".yml", ".yaml"):
                for name, spec in (yaml.safe_load(f.read_text()) or {}).items():
                    self.add_template(lib.name, name, spec, prefixes, namespace)
        if infer_templates:
            self.infer_templates(lib)
        return lib

    def load_ontology(self, triples: list[tuple[str, str, str]], infer_templates: bool = False, overwrite: bool = True, run_rules: bool = False) -> Library:
        """A library of an ontology's shapes, named by it.

        Without ``overwrite`` one that is there stays as it is; with ``run_rules`` the ontology gets what its own rules
        make of it.  An ontology is metadata: its triples are held by the driver.
        """
        names = {s for s, p, o in triples if p == A and o == ONTOLOGY}
        if len(names) > 1:
            raise ValueError("the graph declares several ontologies")
        name = text_of(names.pop()) if names else "urn:unnamed/"
        if name in self.libraries and not overwrite:
            return self.libraries[name]
        if run_rules and (rules := infer.rules_of(ShapeGraph(list(triples)))):
            g = self.frame(triples)
            triples = [*triples, *(tuple(r) for r in graph.difference(infer.fixpoint(g, rules), g).select("s", "p", "o").collect())]
        lib = self.create_library(name)
        lib.shapes = list(triples)
        if infer_templates:
            self.infer_templates(lib)
        return lib

    def load_manifest(self, entries: list[dict], prefixes: dict[str, str], namespace: str) -> list[Library]:
        """A list of {"directory": path} and {"ontology": path}."""
        out = []
        for e in entries:
            if set(e) == {"directory"}:
                out.append(self.load_directory(e["directory"], prefixes, namespace))
            elif set(e) == {"ontology"}:
                out.append(self.load_ontology(list(files.parse(e["ontology"], Path(e["ontology"]).read_bytes()))))
            else:
                raise ValueError(f"cannot load {e}: only directories and ontology files can be read here")
        return out

    def delete_library(self, name: str) -> None:
        """Its templates go with it; templates elsewhere that depend on them keep unresolved dependencies."""
        del self.libraries[self.library(name).name]

    def resolve_imports(self, library: str, limit: int = -1, missing_ok: bool = True) -> list[tuple[str, str, str]]:
        """The library's shapes and those of all that it imports, up to ``limit`` steps."""
        out: dict[tuple[str, str, str], None] = {}
        seen, front = set(), [(self.library(library).name, 0)]
        while front:
            name, depth = front.pop(0)
            if name in seen:
                continue
            seen.add(name)
            if name not in self.libraries:
                if not missing_ok:
                    raise NotFound(name)
                continue
            triples = self.libraries[name].shapes
            out |= dict.fromkeys(triples)
            if limit < 0 or depth < limit:
                front += [(text_of(o), depth + 1) for _, p, o in triples if p == IMPORTS]
        return list(out)

    # --- shapes to templates and back

    def infer_templates(self, lib: Library) -> None:
        """A template for every class that is also a node shape: one parameter for each value that it asks for."""
        sg = ShapeGraph(self.resolve_imports(lib.name))
        for node in [n for n in sg.node_shapes() if f"<{OWL}Class>" in sg.values(n, A)]:
            name = text_of(node)
            if name not in lib.templates:
                lib.templates[name] = shape_to_template(sg.shape(node), self.find_template)

    def template_to_shape(self, t: Template) -> Shape:
        """The shape of what a template makes around its ``name``: one property for each predicate, once each."""
        here = param("name")
        kinds = [o for s, p, o in t.body if s == here and p == A]
        shape = Shape(iri(f"urn:shape/{t.name}"), targets=tuple(("class", k) for k in kinds), constraints=tuple(("class", k) for k in kinds))
        out: dict[str, list[str]] = {}
        for s, p, o in t.body:
            if s == here and p != A:
                out.setdefault(p, []).append(o)
        for p, objects in out.items():
            for k, o in enumerate(objects):
                what = self._value_of(t, o)
                q = Shape(f"{shape.id}-{text_of(p)}-{k}", path=p)
                inner = Shape(f"{q.id}-value", constraints=(what,))
                q = q.having(("qualified", (inner, 1, 1))) if len(objects) > 1 else q.having(what, ("minCount", 1), ("maxCount", 1))
                shape = shape.has_property(q)
        return shape

    def _value_of(self, t: Template, o: str) -> tuple[str, object]:
        name = text_of(o).rpartition("#")[2]
        if o != param(name):
            return "hasValue", o
        kind = next((c for s, p, c in t.body if s == o and p == A), None)
        dep = t.dependency_for(name)
        return ("class", kind) if kind else ("node", self.template_to_shape(dep)) if dep else ("nodeKind", f"<{SH}IRIOrLiteral>")

    # --- using models

    def compile(self, m: Model, shapes: Sequence[tuple[str, str, str]], rules: Sequence[infer.Rule] = ()) -> DataFrame:
        """What the shapes' own triple rules and further ``rules`` add to the model, with the model."""
        told = [*infer.rules_of(ShapeGraph(list(shapes))), *rules]
        return infer.infer(self.graph(m), self.frame(shapes), told) if told else self.graph(m)

    def validate(self, m: Model, shapes: Sequence[tuple[str, str, str]] | None = None, prefixes: dict[str, str] | None = None) -> tuple[bool, DataFrame, DataFrame]:
        """(valid, report, diff); the model's manifest where no shapes are given."""
        triples = list(m.manifest if shapes is None else shapes)
        plans = ShapeGraph(triples).shapes()
        v = validate.Validator(graph.union(self.graph(m), self.frame(triples)), prefixes)
        report = graph.cut(v.report(plans))
        return validate.conforms(report), report, validate.diff(report, plans, prefixes)

    def shape_table(self, m: Model, shapes: Sequence[tuple[str, str, str]], name: str) -> DataFrame:
        sg = ShapeGraph(list(shapes))
        if name not in sg.by_subject:
            raise ValueError(f"no shape {name}")
        return extract.Extractor(graph.union(self.graph(m), self.frame(shapes))).table(sg.shape(name))

    def target_nodes(self, m: Model) -> DataFrame:
        return graph.types(self.graph(m))

    def validate_shapes(self, m: Model, shapes: Sequence[tuple[str, str, str]], names: Sequence[str], cls: str) -> tuple[DataFrame, DataFrame]:
        """(summary, report) of single shapes on the instances of a class: a row of the summary for each shape, what is wrong by shape."""
        sg = ShapeGraph(list(shapes))
        missing = [n for n in names if n not in sg.by_subject]
        if missing:
            raise NotFound(missing[0])
        plans = [sg.shape(n) for n in names]
        report = graph.cut(validate.Validator(graph.union(self.graph(m), self.frame(shapes))).by_shape(plans, cls))
        return validate.shape_summary(report, plans), report

    def matcher(self, m: Model, template: Template, library: str, *ontologies: DataFrame, check_predicates: bool = False) -> match.Matcher:
        """Matches of a library's template in a model; without ontologies those of the library and of all that it imports count."""
        known = graph.union(*ontologies) if ontologies else self.frame(self.resolve_imports(library, missing_ok=True))
        return match.Matcher(template, self.graph(m), known, check_predicates)

    def repair(self, diffs: DataFrame, path_terms: dict[str, str], namespace: str, shapes: Sequence[Shape] = ()) -> DataFrame:
        """The graph that settles differences; what a shape asks for is built by the library template of its name, of alternatives the smallest."""
        templates, needs = validate.repair_templates(diffs, path_terms, self.find_template, shapes)
        return validate.repaired(templates, needs, namespace)

    def describe(self) -> str:
        """The catalog as JSON."""
        return json.dumps(
            {
                "models": [{"name": m.name, "description": m.description, "graph_id": m.graph_id} for m in self.models.values()],
                "libraries": [{"name": lib.name, "templates": [{"name": t.name, "parameters": sorted(t.parameters), "optional": sorted(t.optional), "dependencies": [d.template for d in t.dependencies]} for t in lib.templates.values()]} for lib in self.libraries.values()],
            }
        )


def shape_to_template(shape: Shape, lookup) -> Template:
    """A template that makes what a shape asks for at least: typed values, fixed values, and dependencies on shapes."""
    here = param("name")
    body: dict[tuple[str, str, str], None] = {}
    for c in [t for k, t in shape.targets if k == "class"][:1] + shape.get("class"):
        body[(here, A, c)] = None
    needs = []
    for n, p in enumerate(shape.get("property")):
        if p.path is None:
            raise ValueError(f"property {p.id} of {shape.id} has no path")
        inner, low, _ = next(iter(p.get("qualified")), (None, None, None))
        for v in p.get("hasValue"):
            body[(here, p.path, v)] = None
        lows = p.get("minCount") + ([low] if low else [])
        kinds = [c for x in (p, inner) if x for c in x.get("class")]
        nodes = [s for x in (p, inner) if x for s in x.get("node")]
        if len(lows) > 1 or len(kinds) + len(nodes) > 1:
            raise ValueError(f"property {p.id} of {shape.id} has several counts or kinds")
        if not isinstance(p.path, str) or not lows or not kinds + nodes:
            continue
        for k in range(lows[0]):
            name = f"{p.name or f'p{n}'}{k}" if lows[0] > 1 else p.name or f"p{n}"
            body[(here, p.path, param(name))] = None
            if kinds:
                body[(param(name), A, kinds[0])] = None
            else:
                needs.append(Dependency(text_of(nodes[0].id), {"name": name}))
    return Template(text_of(shape.id), tuple(body), frozenset(), tuple(needs), lookup)


