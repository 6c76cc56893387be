"""Validation of graphs against shapes, set by set: report, differences, reasons and repairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shapes import ANY, Shape, TextConstraint, dependence, inline, path_text, target_reads
from ..plans.template import Dependency, Template
from ..terms import A, SH, XSD, datatype, is_blank, is_iri, is_literal, lang, lexical, number, param, plain, qname, text_of
from . import solve
from .algebra import path_pairs
from .closure import ancestors, cut, instances, stored

REPORT = "focus string, path string, value string, source_shape string, component string, severity string, message string"
#: Numeric and other datatypes whose lexical forms are checked; what a value must cast to.
CASTS = {"integer": "decimal(38,0)", "int": "int", "long": "bigint", "decimal": "decimal(38,18)", "float": "float", "double": "double", "date": "date", "dateTime": "timestamp"}


#: Constraints that are checked together, from a value and what is known of it.
FUSED = {"minCount", "maxCount", "hasValue", "qualified", "class", "node", "not", "or", "and", "xone", "in", "datatype", "nodeKind", "pattern", "minLength", "maxLength", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "languageIn"}


def _shapes_in(name: str, arg) -> list[Shape]:
    return [arg] if name in ("node", "not") else list(arg) if name in ("or", "and", "xone") else [arg[0]] if name == "qualified" else []


def _breaks(name: str, arg, v: Column) -> Column:
    """Whether a value breaks a constraint that only its own term decides."""
    if name == "in":
        return ~v.isin(*arg)
    if name == "datatype":
        kind = text_of(arg)
        ok = datatype(v) == kind
        cast = CASTS.get(kind.removeprefix(XSD)) if kind.startswith(XSD) else None
        if cast:
            ok = ok & lexical(v).try_cast(cast).isNotNull()
        elif kind == f"{XSD}boolean":
            ok = ok & lexical(v).isin("true", "false", "1", "0")
        return ~F.coalesce(ok, F.lit(False))
    if name == "nodeKind":
        kinds = {"IRI": is_iri(v), "BlankNode": is_blank(v), "Literal": is_literal(v)}
        return ~reduce(lambda a, b: a | b, [kinds[k] for k in kinds if k in text_of(arg).removeprefix(SH)])
    if name == "pattern":
        regex, flags = arg
        return is_blank(v) | ~plain(v).rlike(f"(?{flags}){regex}" if flags else regex)
    if name in ("minLength", "maxLength"):
        n = F.length(plain(v))
        return is_blank(v) | (n < arg if name == "minLength" else n > arg)
    if name == "languageIn":
        fits = reduce(lambda a, b: a | b, [(F.lower(lang(v)) == text_of(t).lower()) | F.lower(lang(v)).startswith(text_of(t).lower() + "-") for t in arg], F.lit(False))
        return ~F.coalesce(fits, F.lit(False))
    ok = {"minInclusive": number(v) >= arg, "maxInclusive": number(v) <= arg, "minExclusive": number(v) > arg, "maxExclusive": number(v) < arg}[name]
    return ~F.coalesce(ok, F.lit(False))


class Validator:
    """Shapes are checked on all focus nodes at once; the constraints of a target and path share its values.

    What the shapes read of the graph is written once as a table by predicate, unless ``is_table`` says that
    it is one; every target, path and constraint reads the part that it needs.  A ``bag`` may have a triple
    twice: targets, values and classes are told apart where they are read, the triples only for what reads any of them.
    """

    def __init__(self, data: DataFrame, prefixes: dict[str, str] | None = None, hierarchy: DataFrame | None = None, is_table: bool = False, bag: bool = False):
        self._data, self._g, self._bag = data, data if is_table else None, bag
        self._covers = {ANY} if is_table else set()
        self.prefixes = prefixes or {}
        self._up = hierarchy
        self.spark: SparkSession = data.sparkSession

    def prepare(self, shapes: Sequence[Shape]) -> None:
        """Write what these shapes read, unless it is there."""
        reads = set().union(*(dependence(s)[0] | target_reads(s) for s in shapes))
        if ANY in self._covers or reads <= self._covers:
            return
        if self._covers or ANY in reads:  # more than was asked for before: the whole graph, for all that may come
            self._covers, self._g = {ANY}, stored(self._whole())
        else:
            self._covers, self._g = reads, stored(self._data.where(F.col("p").isin(*sorted(reads))))

    @property
    def g(self) -> DataFrame:
        """The table: all of the graph, or what the shapes read that were prepared for."""
        if self._g is None:
            self._covers, self._g = {ANY}, stored(self._whole())
        return self._g

    def _whole(self) -> DataFrame:
        return self._data.dropDuplicates(["s", "p", "o"]) if self._bag else self._data

    @property
    def up(self) -> DataFrame:
        """The class hierarchy, found once when it is first asked for."""
        if self._up is None:
            self._up = cut(ancestors(self.g))
        return self._up

    # --- targets

    def targets(self, shape: Shape) -> DataFrame:
        """(focus) of all targets of a shape."""
        parts = []
        classes = [t for k, t in shape.targets if k == "class"]
        if classes:
            parts.append(instances(self.g, classes, self.up).select(F.col("node").alias("focus")))
        nodes = [(t,) for k, t in shape.targets if k == "node"]
        if nodes:
            parts.append(self.spark.createDataFrame(nodes, "focus string"))
        for kind, column in (("subjects", "s"), ("objects", "o")):
            terms = [t for k, t in shape.targets if k == kind]
            if terms:
                parts.append(self.g.where(F.col("p").isin(terms)).select(F.col(column).alias("focus")))
        parts += [solve.solutions(self.g, t).select(F.col("this").alias("focus")) for k, t in shape.targets if k == "select"]
        if not parts:
            return self.spark.createDataFrame([], "focus string")
        return reduce(DataFrame.unionByName, parts).distinct()

    # --- checking

    def report(self, shapes: Sequence[Shape]) -> DataFrame:
        """All results of all shapes on their targets."""
        active = [s for s in map(inline, shapes) if not s.deactivated]
        self.prepare(active)
        parts = [self.check(s, self.targets(s)) for s in active]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], REPORT)

    def check_on(self, shape: Shape, cls: str) -> DataFrame:
        """Results of one shape on the instances of a class, whatever its own targets are."""
        self.prepare([inline(shape).targeting("class", cls)])
        return self.check(inline(shape), instances(self.g, [cls], self.up).select(F.col("node").alias("focus")))

    def by_shape(self, shapes: Sequence[Shape], cls: str) -> DataFrame:
        """Results on the instances of a class with ``shape``, the shape that was asked for, whatever the shapes' own targets are."""
        plans = [inline(s) for s in shapes if not s.deactivated]
        self.prepare([s.targeting("class", cls) for s in plans])
        foci = cut(instances(self.g, [cls], self.up).select(F.col("node").alias("focus")).distinct())
        parts = [self.check(s, foci).withColumn("shape", F.lit(s.id)) for s in plans]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{REPORT}, shape string")

    def failing(self, shape: Shape, foci: DataFrame) -> DataFrame:
        """(focus) of those that do not conform."""
        return self.check(shape, foci, strict=True).select("focus").distinct()

    def rows(self, shape: Shape, foci: DataFrame) -> DataFrame:
        """(focus, value): a node shape's value is the focus itself; a focus without a value has one row with null."""
        if shape.path is None:
            return foci.select("focus", F.col("focus").alias("value"))
        if isinstance(shape.path, str):  # one join, by focus: what is grouped by focus after it is where it has to be
            pairs = self.g.where(F.col("p") == shape.path)
        else:
            pairs = path_pairs(self.g, shape.path, foci.select(F.col("focus").alias("s")))
        return foci.join(pairs.select(F.col("s").alias("focus"), F.col("o").alias("value")), "focus", "left").distinct()

    def check(self, shape: Shape, foci: DataFrame, strict: bool = False) -> DataFrame:
        """Results of a shape on the foci; with ``strict`` a nested property's results name the outer focus."""
        foci = foci.select("focus").distinct()
        parts = []
        rows = self.rows(shape, foci)
        values = rows if shape.path is None else rows.where(F.col("value").isNotNull())
        together = [(name, arg) for name, arg in shape.constraints if name in FUSED]
        if together:
            parts.append(self._together(shape, together, rows))
        for name, arg in shape.constraints:
            if name == "property":
                if shape.path is None:
                    parts.append(self.check(arg, foci, strict))
                else:
                    inner = values.select(F.col("value").alias("focus")).distinct()
                    if strict:
                        bad = self.failing(arg, inner)
                        parts.append(self._said(shape, values.join(bad.select(F.col("focus").alias("value")), "value", "left_semi"), "NodeConstraintComponent"))
                    else:
                        parts.append(self.check(arg, inner))
            elif name not in FUSED:
                found, component = self._violations(name, arg, foci, values)
                parts.append(self._said(shape, found, component))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], REPORT)

    def _together(self, shape: Shape, constraints: Sequence[tuple[str, object]], rows: DataFrame) -> DataFrame:
        """Results of all constraints that can be told from a value and what is known of it: one pass over the values, one over the foci.

        Which classes a value has and which nested shapes it breaks are joined once, for all
        constraints; counts, qualified counts and fixed values come from one aggregate a focus.
        """
        counted = rows
        classes = list(dict.fromkeys(arg for name, arg in constraints if name == "class"))
        nested = list(dict.fromkeys(s for name, arg in constraints for s in _shapes_in(name, arg)))
        if classes:
            kinds = instances(self.g, classes, self.up).select(F.col("node").alias("value"), "class")
            rows = rows.join(self._flags(kinds, "class", classes, "_is"), "value", "left")
        if nested:
            distinct = rows.where(F.col("value").isNotNull()).select(F.col("value").alias("focus")).distinct()
            failing = [self.failing(s, distinct) for s in nested]
            if len(nested) > 1:  # one after the other: a task that checks all of them has the memory of all of their joins
                failing = list(map(cut, failing))
            broken = [f.select(F.col("focus").alias("value"), F.lit(k).alias("_k")) for k, f in enumerate(failing)]
            rows = rows.join(self._flags(reduce(DataFrame.unionByName, broken), "_k", range(len(nested)), "_fails"), "value", "left")

        fails = lambda s: F.coalesce(F.col(f"_fails{nested.index(s)}"), F.lit(False))
        if any(name == "qualified" for name, _ in constraints):
            counted = rows  # other counts are taken where the values still lie by focus
        has = F.col("value").isNotNull()
        of_values, of_foci, sums = [], [], {"_n": F.count("value")}
        for name, arg in constraints:
            component = f"{name[0].upper()}{name[1:]}ConstraintComponent"
            if name in ("minCount", "maxCount"):
                of_foci.append((component, F.col("_n") < arg if name == "minCount" else F.col("_n") > arg))
            elif name == "hasValue":
                sums[f"_s{len(sums)}"] = F.count_if(F.col("value") == arg)
                of_foci.append((component, F.col(list(sums)[-1]) == 0))
            elif name == "qualified":
                inner, low, high = arg
                sums[f"_s{len(sums)}"] = F.count_if(has & ~fails(inner))
                n = F.col(list(sums)[-1])
                of_foci += [("QualifiedMinCountConstraintComponent", n < low)] if low is not None else []
                of_foci += [("QualifiedMaxCountConstraintComponent", n > high)] if high is not None else []
            elif name == "class":
                of_values.append((component, ~F.coalesce(F.col(f"_is{classes.index(arg)}"), F.lit(False))))
            elif name == "node":
                of_values.append((component, fails(arg)))
            elif name == "not":
                of_values.append((component, ~fails(arg)))
            elif name in ("or", "and", "xone"):
                bad = reduce(lambda a, b: a + b, [fails(s).cast("int") for s in arg])
                of_values.append((component, {"or": bad == len(arg), "and": bad > 0, "xone": bad != len(arg) - 1}[name]))
            else:
                of_values.append((component, _breaks(name, arg, F.col("value"))))

        def told(df: DataFrame, tests: list, columns: list[str]) -> DataFrame:
            which = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(component)) for component, test in tests]), lambda x: x.isNotNull())
            return df.select(*columns, F.explode(which).alias("_component"))

        parts = []
        if of_values:
            parts.append(told(rows.where(has), of_values, ["focus", "value"]))
        if of_foci:
            parts.append(told(counted.groupBy("focus").agg(*[c.alias(n) for n, c in sums.items()]), of_foci, ["focus"]).withColumn("value", F.lit(None).cast("string")))
        found = reduce(lambda a, b: a.unionByName(b), parts)
        return self._said(shape, found, F.col("_component"))

    @staticmethod
    def _flags(pairs: DataFrame, column: str, kinds: Sequence, name: str) -> DataFrame:
        """(value, a boolean for each kind) of distinct pairs (value, ``column``): no sets are collected, one kind needs no aggregate."""
        if len(kinds) == 1:
            return pairs.select("value", F.lit(True).alias(f"{name}0"))
        return pairs.groupBy("value").agg(*[F.max(F.col(column) == k).alias(f"{name}{n}") for n, k in enumerate(kinds)])

    def _said(self, shape: Shape, found: DataFrame, component) -> DataFrame:
        path = F.lit(path_text(shape.path, self.prefixes)) if shape.path is not None else F.lit(None).cast("string")
        value = F.col("value") if "value" in found.columns else F.lit(None).cast("string")
        component = F.lit(component) if isinstance(component, str) else component
        return found.select("focus", path.alias("path"), value.alias("value"), F.lit(shape.id).alias("source_shape"), component.alias("component"), F.lit(shape.severity).alias("severity"), (F.col("message") if "message" in found.columns else F.lit(shape.message)).cast("string").alias("message"))

    def _violations(self, name: str, arg, foci: DataFrame, values: DataFrame) -> tuple[DataFrame, str]:
        """(focus, value) of a constraint that compares with other parts of the graph."""
        v = F.col("value")
        component = f"{name[0].upper()}{name[1:]}ConstraintComponent"
        other = self.g.where(F.col("p") == arg).select(F.col("s").alias("focus"), F.col("o").alias("other")) if isinstance(arg, str) else None
        if name == "disjoint":
            return values.join(other.select("focus", F.col("other").alias("value")), ["focus", "value"], "left_semi"), component
        if name == "equals":
            theirs = other.join(foci, "focus", "left_semi").select("focus", F.col("other").alias("value")).distinct()
            both = ["focus", "value"]
            return values.join(theirs, both, "left_anti").unionByName(theirs.join(values, both, "left_anti")), component
        if name in ("lessThan", "lessThanOrEquals"):
            a, b = number(v), number(F.col("other"))
            less = F.when(a.isNotNull() & b.isNotNull(), a < b if name == "lessThan" else a <= b).otherwise(plain(v) < plain(F.col("other")) if name == "lessThan" else plain(v) <= plain(F.col("other")))
            return values.join(other, "focus").where(~less).select("focus", "value").distinct(), component
        if name == "uniqueLang":
            twice = values.withColumn("l", lang(v)).where(F.col("l") != "").groupBy("focus", "l").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            return twice.select("focus").distinct(), component
        if name == "closed":
            extra = self.g.where(~F.col("p").isin(*arg)).join(foci, F.col("s") == F.col("focus"), "left_semi")
            return extra.select(F.col("s").alias("focus"), F.col("o").alias("value")), component
        if name == "exactCount":
            cls, n = arg
            have = self.g.where((F.col("p") == A) & (F.col("o") == cls)).agg(F.countDistinct("s").alias("n"))
            return foci.crossJoin(have.where(F.col("n") != n).select(F.lit(1).alias("_"))).select("focus"), "countConstraintComponent"
        if name == "sparql":
            return self._by_text(arg, foci) if isinstance(arg, TextConstraint) else arg(self.g, foci), "SPARQLConstraintComponent"
        raise ValueError(f"unknown constraint {name}")

    def _by_text(self, c: TextConstraint, foci: DataFrame) -> DataFrame:
        """(focus, value, message) for each solution of a query text; the value is ?value, or the focus itself."""
        found = solve.solutions(self.g, c.text, foci, texts=c.message is not None)
        value = F.col("value") if "value" in found.columns else F.col("this")
        said = [] if c.message is None else [solve.messages(found, c.message).alias("message")]
        return found.select(F.col("this").alias("focus"), value.alias("value"), *said)


def conforms(report: DataFrame) -> bool:
    """No violations; warnings and infos do not count."""
    return report.where(F.col("severity") == "Violation").isEmpty()


def shape_summary(report: DataFrame, shapes: Sequence[Shape]) -> DataFrame:
    """(shape, conforms, foci, results) of ``Validator.by_shape``: shapes without a violation conform; foci and results count all severities."""
    counted = report.groupBy("shape").agg((F.count_if(F.col("severity") == "Violation") == 0).alias("conforms"), F.countDistinct("focus").alias("foci"), F.count(F.lit(1)).alias("results"))
    asked = report.sparkSession.createDataFrame([(s.id,) for s in shapes if not s.deactivated], "shape string")
    out = asked.join(counted, "shape", "left")
    return out.select("shape", F.coalesce("conforms", F.lit(True)).alias("conforms"), F.coalesce("foci", F.lit(0)).alias("foci"), F.coalesce("results", F.lit(0)).alias("results"))


# --- differences


def _flat(shapes: Sequence[Shape]) -> list[Shape]:
    out: dict[str, Shape] = {}

    def add(x) -> None:
        if isinstance(x, Shape):
            if x.id not in out:
                out[x.id] = x
                for _, v in x.constraints:
                    add(v)
        elif isinstance(x, tuple):
            for y in x:
                add(y)

    for s in shapes:
        add(inline(s))
    return list(out.values())


def _counts(s: Shape) -> tuple[int | None, int | None]:
    """Counts of a shape; a count of 0 reads as none."""
    low = next(iter(s.get("minCount")), None) or next((q[1] for q in s.get("qualified")), None)
    high = next(iter(s.get("maxCount")), None) or next((q[2] for q in s.get("qualified")), None)
    return low or None, high or None


def _reason(s: Shape, prefixes: dict[str, str], object_type: str | None) -> str:
    """What comes after the focus."""
    low, high = _counts(s)
    what = f"instance(s) of {object_type} on" if object_type else "uses of"
    span = f"{low}" if low == high else f"between {low} and {high}" if low is not None and high is not None else f"at least {low}" if low is not None else f"at most {high}"
    return f" expected {span} {what} path {path_text(s.path, prefixes)}"


def diff(report: DataFrame, shapes: Sequence[Shape], prefixes: dict[str, str] | None = None) -> DataFrame:
    """(focus, kind, path, min_count, max_count, classname, shapename, shapes, severity, component, reason), one row a difference.

    The kind follows from the shape: counts with a class, with a node shape, or alone; class
    constraints, exact counts (of the whole graph, with a null focus) and alternatives have kinds of
    their own.  Other results are no difference.
    """
    prefixes = prefixes or {}
    rows = []
    for s in _flat(shapes):
        low, high = _counts(s)
        nested = [q[0] for q in s.get("qualified")]
        cls = next((c for x in (s, *nested) for c in x.get("class")), None)
        node = next((n for x in (s, *nested) for n in x.get("node")), None)
        for c in s.get("class"):
            rows.append((s.id, "ClassConstraintComponent", "RequiredClass", None, None, None, c, None, None, f" needs to be a {text_of(c)}"))
        for c, n in s.get("exactCount"):
            rows.append((s.id, "countConstraintComponent", "GraphClassCardinality", None, n, n, c, None, None, f"Graph did not have {n} instances of {text_of(c)}"))
        for members in s.get("or"):
            ids = [text_of(m.id) for m in members]
            rows.append((s.id, "OrConstraintComponent", "OrShape", None, None, None, None, None, ids, f" needs to match one of the following shapes: {', '.join(ids)}"))
        if s.path is not None and (low or high):
            kind, said = ("PathClassCount", qname(cls, prefixes)) if cls else ("PathShapeCount", qname(node.id, prefixes)) if node else ("RequiredPath", None)
            rows.append((s.id, None, kind, path_text(s.path, prefixes), low, high, cls if kind == "PathClassCount" else None, node.id if kind == "PathShapeCount" else None, None, _reason(s, prefixes, said)))
    spark = report.sparkSession
    # one row for each constraint of the driver's shapes: its size is that of the shapes
    table = spark.createDataFrame(rows, "source_shape string, _component string, kind string, _path string, min_count int, max_count int, classname string, shapename string, shapes array<string>, _reason string")
    own = ["ClassConstraintComponent", "countConstraintComponent", "NodeConstraintComponent"]
    j = report.join(F.broadcast(table), "source_shape").where(F.when(F.col("_component").isNotNull(), F.col("component") == F.col("_component")).otherwise(~F.col("component").isin(*own) & F.col("path").isNotNull()))
    at = plain(F.col("focus"))
    whole = F.col("kind") == "GraphClassCardinality"
    reason = F.when(whole, F.col("_reason")).when(F.col("kind") == "RequiredClass", F.concat(plain(F.coalesce("value", "focus")), F.lit(" on "), at, F.col("_reason"))).otherwise(F.concat(at, F.col("_reason")))
    return j.select(F.when(~whole, F.col("focus")).alias("focus"), "kind", F.col("_path").alias("path"), "min_count", "max_count", "classname", "shapename", "shapes", "severity", "component", reason.alias("reason")).distinct()


def broken_entities(diffs: DataFrame) -> DataFrame:
    """(entity, reasons): the whole graph is called Model."""
    return diffs.groupBy(F.coalesce("focus", F.lit("Model")).alias("entity")).agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


def reasons_by_shape(diffs: DataFrame) -> DataFrame:
    """(shapename, n, reasons): for each shape that something has to conform to, how many foci lack it, and why.

    A reason is said once, without the focus that it is about, so there are at most as many as constraints.
    """
    own = F.ltrim(F.substring("reason", F.length(plain(F.col("focus"))) + 1, F.length("reason")))
    said = diffs.where("shapename is not null and focus is not null").select("shapename", "focus", own.alias("reason"))
    return said.groupBy("shapename").agg(F.count_distinct("focus").alias("n"), F.sort_array(F.collect_set("reason")).alias("reasons"))


def reasons_by_severity(diffs: DataFrame, severity: str) -> DataFrame:
    """(entity, reasons) of one severity; entities without such reasons stay, with none."""
    if severity not in ("Violation", "Warning", "Info"):
        raise ValueError(f"unknown severity {severity}")
    return diffs.groupBy(F.coalesce("focus", F.lit("Model")).alias("entity")).agg(F.sort_array(F.collect_set(F.when(F.col("severity") == severity, F.col("reason")))).alias("reasons"))


def repair(diffs: DataFrame, path_terms: dict[str, str], namespace: str) -> DataFrame:
    """The triples that would settle count and class differences, with minted names.

    ``path_terms``: predicate terms by path text; differences on other paths are left to the caller.
    """
    table = F.create_map(*[F.lit(x) for pair in path_terms.items() for x in pair]) if path_terms else F.create_map().cast("map<string,string>")
    counted = diffs.where(F.col("kind").isin("PathClassCount", "PathShapeCount", "RequiredPath") & (F.col("min_count") > 0)).withColumn("pred", table[F.col("path")]).where("pred is not null")
    key = F.concat_ws("|", "focus", "path", F.coalesce("classname", "shapename", F.lit("")), F.col("n").cast("string"))
    made = counted.withColumn("n", F.explode(F.sequence(F.lit(1), "min_count"))).withColumn("new", F.concat(F.lit(f"<{namespace}"), F.md5(key), F.lit(">")))
    links = made.select(F.col("focus").alias("s"), F.col("pred").alias("p"), F.col("new").alias("o"))
    kinds = made.select(F.col("new").alias("s"), F.lit(A).alias("p"), F.coalesce("classname", "shapename").alias("o")).dropna()
    own = diffs.where((F.col("kind") == "RequiredClass") & F.col("focus").isNotNull()).select(F.col("focus").alias("s"), F.lit(A).alias("p"), F.col("classname").alias("o"))
    return links.unionByName(kinds).unionByName(own).distinct()


def needed(shape: Shape, node: str, fresh: Iterator[int]) -> list[tuple[str, str, str]] | None:
    """The fewest triples that make a new or bare node conform, with parameters for the nodes to be made; none if they cannot be told.

    Of alternatives, nested ones included, the one with the fewest triples is taken, the first of several.
    """
    out: list[tuple[str, str, str]] = []
    low = max([*shape.get("minCount"), *[q[1] or 0 for q in shape.get("qualified")], 0])
    fixed = shape.get("hasValue")
    if shape.path is None:
        out += [(node, A, c) for c in shape.get("class")]
        parts = shape.get("node") + shape.get("property") + [s for ms in shape.get("and") for s in ms]
        inner = [needed(s, node, fresh) for s in parts]
        if None in inner or shape.get("not") or shape.get("sparql") or fixed and fixed != [node]:
            return None
        for members in shape.get("or") + shape.get("xone"):
            choices = [x for x in (needed(m, node, fresh) for m in members) if x is not None]
            if not choices:
                return None
            inner.append(min(choices, key=len))
        return [*dict.fromkeys(out + [t for x in inner for t in x])]
    if not low and not fixed:
        return []
    if not isinstance(shape.path, str):
        return None
    out += [(node, shape.path, v) for v in fixed]
    values = Shape(shape.id, constraints=tuple(c for c in shape.constraints if c[0] in ("class", "node", "and", "or", "xone", "not", "property")))
    inner = [s for s, n, _ in shape.get("qualified") if n]
    allowed = next(iter(shape.get("in")), ())
    for k in range(low - len(fixed)):
        if shape.get("in") or shape.get("datatype"):
            if k >= len(allowed):
                return None
            out.append((node, shape.path, allowed[k]))
            continue
        new = param(f"new{next(fresh)}")
        out.append((node, shape.path, new))
        for s in (values, *inner):
            more = needed(s, new, fresh)
            if more is None:
                return None
            out += more
    return out


def repair_templates(diffs: DataFrame, path_terms: dict[str, str], lookup: Callable[[str | None, str], Template | None] = lambda library, name: None, shapes: Sequence[Shape] = ()) -> tuple[dict[str, Template], DataFrame]:
    """(templates by name, (focus, templates)): what each focus needs to have its differences settled.

    Differences of one kind, path, count and class share a template, so there are at most as many as
    constraints.  Its parameters are ``focus`` and one for each node to be made; a node that has to
    conform to a shape depends on the template of the shape's name, if ``lookup`` knows one.  A count
    of the whole graph has a template without ``focus``, and a null focus.  Of alternatives that ``shapes`` has,
    the one that takes the fewest new triples is built; without it, and on paths that ``path_terms`` does not
    name, differences are left to the caller.
    """
    key = ["kind", "path", "min_count", "classname", "shapename", "shapes"]
    kinds = ("PathClassCount", "PathShapeCount", "RequiredPath", "RequiredClass", "GraphClassCardinality", "OrShape")
    found = cut(diffs.where(F.col("kind").isin(*kinds)).select("focus", *key).distinct())
    choices = {tuple(text_of(m.id) for m in members): members for s in _flat(shapes) if s.path is None for members in s.get("or")}
    here, out, names = param("focus"), {}, []
    # one row for each constraint of the driver's shapes
    for r in sorted(found.select(*key).distinct().collect(), key=lambda r: [str(x) for x in r]):
        name, body, needs = f"repair{len(names)}", [], []
        if r.kind == "RequiredClass":
            body.append((here, A, r.classname))
        elif r.kind == "OrShape":
            members = choices.get(tuple(r.shapes or ()))
            ways = [x for x in (needed(m, here, count()) for m in members or ()) if x]
            body += min(ways, key=len) if ways else []
        elif r.kind != "GraphClassCardinality" and r.path not in path_terms:
            continue
        else:
            for k in range(r.min_count or 0):
                node = f"{name}-{k}"
                body += [(here, path_terms[r.path], param(node))] if r.path is not None else []
                body += [(param(node), A, kind) for kind in (r.classname, r.shapename) if kind is not None]
                if r.shapename is not None and lookup(None, text_of(r.shapename)) is not None:
                    needs.append(Dependency(text_of(r.shapename), {"name": node}))
        if body:
            out[name] = Template(name, tuple(body), frozenset(), tuple(needs), lookup)
            names.append((name, *r))
    table = diffs.sparkSession.createDataFrame(names, "template string, _kind string, _path string, _min_count int, _classname string, _shapename string, _shapes array<string>")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    return out, found.join(F.broadcast(table), same).groupBy("focus").agg(F.sort_array(F.collect_set("template")).alias("templates"))


def merged(templates: Sequence[Template], name: str = "repair") -> Template:
    """One template for a focus with several needs: they share ``focus`` and nothing else."""
    flat = [t.inline() for t in templates]
    return Template(name, tuple(dict.fromkeys(x for t in flat for x in t.body)), frozenset().union(*(t.optional for t in flat)))


def repaired(templates: dict[str, Template], needs: DataFrame, namespace: str) -> DataFrame:
    """The triples of all that the foci need; nodes to be made get names minted from the focus and the parameter."""
    rows = needs.select("focus", F.explode("templates").alias("_t"))
    parts = []
    for name, t in templates.items():
        flat = t.inline()
        b = rows.where(F.col("_t") == name).select("focus")
        parts.append(flat.graph(flat.fill(b, namespace, F.coalesce("focus", F.lit("Model")))))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else needs.sparkSession.createDataFrame([], "s string, p string, o string")


def severity_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))

