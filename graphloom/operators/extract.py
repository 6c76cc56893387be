"""From shapes to tables: the rows that would satisfy a shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shapes import Shape, path_text
from ..terms import A, LABEL, plain
from .algebra import path_pairs
from .closure import ancestors, instances
from .validate import Validator


class Extractor:
    def __init__(self, g: DataFrame, hierarchy: DataFrame | None = None, bag: bool = False):
        self.checker = Validator(g, hierarchy=hierarchy, bag=bag)  # one table and one hierarchy for both

    @property
    def g(self) -> DataFrame:
        return self.checker.g

    @property
    def up(self) -> DataFrame:
        return self.checker.up

    def table(self, shape: Shape) -> DataFrame:
        """One row a solution: ``target`` and a column for each property that has values to show, as plain text.

        Properties with a class or a node shape are optional unless they are qualified with a
        minimum of at least 1; properties of one path without qualification share a column.
        """
        if shape.targets:  # without a target every subject is one
            self.checker.prepare([shape])
        rows = self._rows(shape, "target")
        return rows.select(*[plain(F.col(f"`{c}`")).alias(c) for c in rows.columns]).distinct()

    def _is_a(self, df: DataFrame, column: str, classes: list[str]) -> DataFrame:
        for c in classes:
            df = df.join(instances(self.g, [c], self.up).select(F.col("node").alias(column)), column, "left_semi")
        return df

    def _rows(self, shape: Shape, root: str, start: DataFrame | None = None) -> DataFrame:
        """Solutions of a node shape; ``start`` gives the candidates where the shape has no target of its own."""
        out = self.checker.targets(shape).select(F.col("focus").alias(root)) if shape.targets else start
        if start is not None and shape.targets:
            out = start.join(out, root, "left_semi")
        if out is None:
            out = self.g.select(F.col("s").alias(root)).distinct()
        out = self._is_a(out, root, shape.get("class"))
        for inner in shape.get("node"):
            out = self._join(out, self._rows(inner, root, out.select(root).distinct()), root, False)
        for members in shape.get("or"):
            branches = [self._rows(m, root, out.select(root).distinct()) for m in members]
            out = self._join(out, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches).distinct(), root, False)
        names: dict[str, str] = {}
        for n, prop in enumerate(shape.get("property")):
            said = path_text(prop.path, {})
            name = prop.name or f"{root}_{n}"
            if not prop.get("qualified"):
                name = names.setdefault(said, name)
            out = self._property(out, prop, root, name)
        return out

    def _join(self, left: DataFrame, right: DataFrame, root: str, optional: bool) -> DataFrame:
        on = [c for c in left.columns if c in right.columns]
        return left.join(right, on, "left" if optional else "inner")

    def _property(self, out: DataFrame, prop: Shape, root: str, name: str) -> DataFrame:
        inner, low, _ = next(iter(prop.get("qualified")), (None, None, None))
        sources = [x for x in (prop, inner) if x is not None]
        classes = [c for x in sources for c in x.get("class")]
        nodes = [n for x in sources for n in x.get("node")]
        choices = [m for x in sources for m in x.get("or")]
        pairs = path_pairs(self.g, prop.path, out.select(F.col(root).alias("s")).distinct()).select(F.col("s").alias(root), F.col("o").alias(name)).distinct()
        shown = False
        if classes:
            out, shown = self._join(out, self._is_a(pairs, name, classes[:1]), root, not low), True
        for n in nodes[:1]:
            rows = pairs.join(self._rows(n, name, pairs.select(name).distinct()), name)
            out, shown = self._join(out, rows, root, not low), True
        for members in choices:
            branches = [self._rows(m, name, pairs.select(name).distinct()) for m in members]
            rows = pairs.join(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches).distinct(), name)
            out, shown = self._join(out, rows, root, False), True
        for v in prop.get("hasValue"):
            out, shown = out.join(pairs.where(F.col(f"`{name}`") == v).select(root), root, "left_semi"), True
        return out if shown else self._join(out, pairs, root, False)

    def save(self, shape: Shape, table: str) -> None:
        self.table(shape).write.mode("overwrite").saveAsTable(table)


def shapes_about(shapes: list[Shape], g: DataFrame, cls: str, hierarchy: DataFrame | None = None) -> DataFrame:
    """(shape) of those whose target class is the class or one of its super-classes."""
    up = ancestors(g) if hierarchy is None else hierarchy
    rows = [(s.id, c) for s in shapes for c in {t for k, t in s.targets if k == "class"} | set(s.get("class"))]
    about = g.sparkSession.createDataFrame(rows, "shape string, ancestor string")
    above = up.where(F.col("child") == cls).select("ancestor").unionByName(g.sparkSession.createDataFrame([(cls,)], "ancestor string")).distinct()
    return about.join(above, "ancestor", "left_semi").select("shape").distinct()


def shapes_of_kind(g: DataFrame, kind: str, subkinds: DataFrame | None = None) -> DataFrame:
    """(shape, label) of the instances of a kind or of what ``subkinds`` (child, ancestor) puts below it."""
    return _labelled(g, instances(g, [kind], subkinds).select(F.col("node").alias("shape")))


def within(g: DataFrame, top: str, predicate: str) -> DataFrame:
    """(name) of what is ``predicate`` of ``top``, over any number of steps, and ``top``; circles end."""
    below = ancestors(g, predicate).where(F.col("ancestor") == top).select(F.col("child").alias("name"))
    return below.unionByName(g.sparkSession.range(1).select(F.lit(top).alias("name"))).distinct()


def shapes_of_domain(g: DataFrame, domain: str, in_domain: str, includes: str) -> DataFrame:
    """(shape, label) of the shapes of a domain and of the domains that include it, over any number of steps."""
    of = g.where(F.col("p") == in_domain).join(within(g, domain, includes), F.col("o") == F.col("name"), "left_semi")
    return _labelled(g, of.select(F.col("s").alias("shape")).distinct())


def listing(g: DataFrame, kinds: list[str], group: str | None = None) -> DataFrame:
    """(kind, shape, label) of the shapes of each kind and of its subclasses, led by ``group``, a column of ``g``, if named."""
    found = instances(g, kinds).select(F.col("node").alias("shape"), F.col("class").alias("kind"))
    if group is None:
        return _labelled(g, found).select("kind", "shape", "label")
    said = g.select(group, F.col("s").alias("shape")).where(F.col("p") == A).distinct()
    return _labelled(g, found.join(said, "shape")).select(group, "kind", "shape", "label")


def _labelled(g: DataFrame, shapes: DataFrame) -> DataFrame:
    label = g.where(F.col("p") == LABEL).groupBy(F.col("s").alias("shape")).agg(F.min("o").alias("label"))
    return shapes.join(label, "shape", "left").withColumn("label", plain(F.col("label")))


# --- the same as query text, for other engines

PREAMBLE = "PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>\nPREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>\n"
_KINDS = {"class": "{v} rdf:type/rdfs:subClassOf* {t} .", "node": "BIND({t} AS {v}) .", "subjects": "{v} {t} ?of{n} .", "objects": "?of{n} {t} {v} ."}


def _path(path) -> str:
    """A path with full IRIs."""
    if isinstance(path, str):
        return path
    kind, *parts = path
    inner = [_path(p) for p in parts]
    if kind == "seq":
        return "/".join(inner)
    if kind == "alt":
        return "(" + "|".join(inner) + ")"
    return f"^({inner[0]})" if kind == "inv" else f"({inner[0]}){kind}"


def _where(shape: Shape, root: str, names: list[str]) -> str:
    if root not in names:
        names.append(root)
    v = f"?{root}"
    is_a = lambda c, x=v: f"{x} rdf:type/rdfs:subClassOf* {c} .\n"
    targets = ["{ " + _KINDS[k].format(v=v, t=t, n=n) + " }" for n, (k, t) in enumerate(shape.targets)]
    out = " UNION ".join(targets) + "\n" if targets else ""
    out += "".join(is_a(c) for c in shape.get("class"))
    out += "".join(_where(s, root, names) for s in shape.get("node"))
    for members in shape.get("or"):
        out += " UNION ".join("{ " + _where(m, root, names) + " }" for m in members) + "\n"
    shared: dict[str, str] = {}
    for n, p in enumerate(shape.get("property")):
        path, name = _path(p.path), p.name or f"{root}_{n}"
        inner, low, _ = next(iter(p.get("qualified")), (None, None, None))
        if inner is None:
            name = shared.setdefault(path, name)
        sources = [x for x in (p, inner) if x is not None]
        step, shown = f"{v} {path} ?{name} .\n", False
        parts = [is_a(c, f"?{name}") for x in sources for c in x.get("class")][:1] + [_where(s, name, names) for x in sources for s in x.get("node")][:1]
        for part in parts:
            shown = True
            out += step + part if low else "OPTIONAL { " + step + part + "} .\n"
        for members in [m for x in sources for m in x.get("or")]:
            shown = True
            out += step + " UNION ".join("{ " + _where(m, name, names) + " }" for m in members) + "\n"
        if (shown or not p.get("hasValue")) and name not in names:
            names.append(name)
        for t in p.get("hasValue"):
            shown = True
            out += f"{v} {path} {t} .\n"
        out += "" if shown else step
    return out


def query_text(shape: Shape) -> str:
    """The SPARQL query that selects what ``Extractor.table`` returns."""
    names: list[str] = []
    where = _where(shape, "target", names)
    return f"{PREAMBLE}SELECT DISTINCT {' '.join('?' + n for n in names)} WHERE {{\n{where}}}"
