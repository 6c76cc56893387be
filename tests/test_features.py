"""Results by shape, repair by the smallest alternative, graph identity, label search, routing, network references, default ontologies."""

import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.catalog import Engine
from graphloom.functions import labels as L
from graphloom.operators import graph, validate
from graphloom.plans.shapes import Shape, ShapeGraph, any_of
from graphloom.plans.template import NETWORK, REFERENCES, Template, choose, from_spec, ingest
from graphloom.sources import turtle
from graphloom.terms import A, iri, literal, param

E = "urn:e#"
HEAD = f"@prefix e: <{E}> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .\n"


def e(name):
    return iri(E + name)


def frame(spark, text):
    return spark.createDataFrame(turtle.read(HEAD + text), "s string, p string, o string")


# --- constraints together


def test_constraints_of_a_path_share_one_pass(spark):
    """All kinds on one path give what each gives alone."""
    rng = random.Random(4)
    values = [e("v1"), e("v2"), literal("abc"), literal("5", "http://www.w3.org/2001/XMLSchema#integer"), literal("x", lang="en"), "_:b"]
    rows = [(e(f"f{k}"), A, e("T")) for k in range(30)] + [(e(f"f{k}"), e("p"), v) for k in range(30) for v in rng.sample(values, rng.randint(0, 4))]
    rows += [(e("v1"), A, e("K")), (e("v2"), A, e("L")), (e("v1"), e("q"), e("v2"))]
    g = spark.createDataFrame(rows + rows[:7], "s string, p string, o string")
    inner, other = Shape("i", constraints=(("class", e("K")),)), Shape("o", constraints=(("property", Shape("oq", path=e("q"), constraints=(("minCount", 1),))),))
    constraints = [
        ("minCount", 2), ("maxCount", 2), ("hasValue", e("v1")), ("class", e("K")), ("class", e("L")), ("node", inner), ("not", other), ("or", (inner, other)), ("xone", (inner, other)), ("and", (inner, other)),
        ("qualified", (inner, 1, 1)), ("in", (e("v1"), literal("abc"))), ("nodeKind", "<http://www.w3.org/ns/shacl#IRI>"), ("datatype", "<http://www.w3.org/2001/XMLSchema#integer>"), ("pattern", ("^a", "")), ("minLength", 4), ("minInclusive", 6.0), ("languageIn", (literal("en"),)),
    ]
    v = validate.Validator(g)
    shape = lambda cs: Shape("s", targets=(("class", e("T")),), constraints=(("property", Shape("p", path=e("p"), constraints=tuple(cs))),))
    rows_of = lambda s: sorted(map(str, v.report([s]).select("focus", "value", "component").collect()))
    together = rows_of(shape(constraints))
    assert together == sorted(x for c in constraints for x in rows_of(shape([c])))
    plan = v.report([shape([("minCount", 2), ("maxCount", 2), ("hasValue", e("v1"))])])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and plan.count("Generate explode") == 1


def test_results_by_shape(spark):
    g = frame(spark, "e:a a e:T ; e:p 1 . e:b a e:S . e:S rdfs:subClassOf e:T .")
    has = Shape(e("has"), targets=(("class", e("Other")),), constraints=(("property", Shape("x", path=e("p"), constraints=(("minCount", 1),))),))
    never, soft = Shape(e("never")), Shape(e("soft"), severity="Warning", constraints=(("class", e("S")),))
    off = Shape(e("off"), deactivated=True, constraints=(("class", e("Z")),))
    report = validate.Validator(g).by_shape([has, never, soft, off], e("T"))
    got = {r.shape: (r.conforms, r.foci, r.results) for r in validate.shape_summary(report, [has, never, soft, off]).collect()}
    assert got == {e("has"): (False, 1, 1), e("never"): (True, 0, 0), e("soft"): (True, 1, 1)}


def test_the_smallest_alternative_is_built_and_validates(spark):
    deep = Shape(e("deep"), constraints=(("property", Shape("d", path=e("part"), constraints=(("qualified", (Shape("dq", constraints=(("class", e("K")), ("property", Shape("dd", path=e("q"), constraints=(("minCount", 1),))))), 1, None)),))),))
    wide = Shape(e("wide"), constraints=(("property", Shape("w", path=e("r"), constraints=(("minCount", 4),))),))
    never = Shape(e("hard"), constraints=(("not", Shape("n")),))
    either = any_of(wide, never, any_of(wide, deep)).targeting("class", e("T"))
    g = frame(spark, "e:a a e:T . e:b a e:T ; e:r 1, 2, 3, 4 . e:c a e:T .")
    diffs = validate.diff(validate.Validator(g).report([either]), [either])
    templates, needs = validate.repair_templates(diffs, {}, shapes=[either])
    made = validate.repaired(templates, needs, "urn:new/")
    assert sorted((r.s == e("a"), r.p) for r in made.collect() if r.s in (e("a"), e("c"))) == [(False, e("part")), (True, e("part"))]
    assert made.count() == 6 and validate.conforms(validate.Validator(graph.union(g, made)).report([either]))
    assert validate.repair_templates(diffs, {})[0] == {}


# --- graphs up to blank nodes


def ring(names):
    return [(f"_:{a}", "<p>", f"_:{b}") for a, b in zip(names, names[1:] + names[:1])]


def test_identity_of_graphs(spark):
    f = lambda rows: spark.createDataFrame(rows, "s string, p string, o string")
    fours = f(ring("abcd") + ring("efgh") + [("<x>", "<p>", "<y>")])
    assert not graph.isomorphic(fours, f(ring("abcdefgh") + [("<x>", "<p>", "<y>")]))
    assert graph.isomorphic(fours, f(ring("mnop") + ring("hgfe") + [("<x>", "<p>", "<y>")]))
    twins = [(f"_:t{k}", "<p>", "<x>") for k in range(40)] + [("_:l", "<q>", "_:l")]
    assert graph.isomorphic(f(twins), f([(s.replace("t", "u"), p, o.replace("l", "w")) if s != "_:l" else ("_:w", p, "_:w") for s, p, o in twins]))
    assert not graph.isomorphic(f(twins), f([*twins[:-1], ("_:l", "<q>", "_:t1")]))


# --- labels


def test_until_ends_where_a_parser_fits(spark):
    texts = ["", "a", "ab-c", "--", "x1y2", "caab", "é-é", "aXbX"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    parsers = [
        L.string("-", L.DELIMITER), L.regex(r"[0-9]", L.IDENTIFIER), L.regex(r"b*$", L.IDENTIFIER), L.regex(r"\bX", L.IDENTIFIER), L.choice(L.string("b", L.DELIMITER), L.regex("[0-9]y", L.DELIMITER)),
        L.abbreviations({"aa": "urn:a", "X": "urn:x"}), L.sequence(L.string("a", L.DELIMITER), L.string("b", L.DELIMITER)),
    ]
    for p in parsers:
        found = {r.t: r.v for r in df.select("t", L.until(p, L.IDENTIFIER)(F.col("t"))[0]["value"].alias("v")).collect()}
        tried = {t: next((t[:n] for n in range(1, len(t) + 1) if fits(spark, p, t[n:])), None) for t in texts}
        assert found == tried, p.to_json()


def fits(spark, parser, text, known={}):  # noqa: B006
    key = (parser.to_json(), text)
    if key not in known:
        known[key] = spark.createDataFrame([(text,)], "t string").select(L.ok(parser(F.col("t")))).first()[0]
    return known[key]


def test_long_labels_are_read_in_linear_time(spark):
    word = L.sequence(L.until(L.string(".", L.DELIMITER), L.IDENTIFIER), L.string(".", L.DELIMITER))
    text = ".".join(["abcdefghi"] * 500) + "."
    df = spark.createDataFrame([(text,), ("x" * 5000,)], "label string")
    began = time.time()
    rows = L.parse(df, L.many(word)).select("success", F.size("tokens").alias("n")).collect()
    assert sorted(map(tuple, rows)) == [(False, 0), (True, 1000)] and time.time() - began < 60


# --- templates


def test_routes_are_taken_in_one_scan(spark):
    one = Template("one", ((param("name"), A, e("One")), (param("name"), e("p"), param("v")), (param("name"), e("q"), param("w"))), frozenset({"w"}))
    two = Template("two", ((param("name"), A, e("Two")), ("_:x", e("of"), param("name"))))
    records = spark.createDataFrame([("a", "1", None), ("b", None, "x y"), ("c", "3", "z"), (None, None, None)], "name string, v string, w string")
    route = F.when(F.col("name") == "b", "two").when(F.col("name") == "z", "none").otherwise("one")
    got = choose(records, route, {"one": one, "two": two}, E, F.concat_ws("|", "name", "v"))
    parts = [ingest(t, records.withColumn("_r", route).where(F.col("_r") == n).drop("_r"), E, fill_unused=True, key=F.concat_ws("|", "name", "v")) for n, t in (("one", one), ("two", two))]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, parts[0].union(parts[1]).collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + got._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1


def test_network_references(spark):
    t = from_spec("sensor", {"type": E + "Sensor", "bacnet": ["temp", "flow"], "hasPoint": {"temp": E + "Temperature"}}, lambda text: turtle.read(text), E)
    assert {"name", "temp", "flow", "temp_object", "flow_object", "BACnet_device"} == set(t.parameters)
    assert (param("BACnet_device"), A, f"<{NETWORK}BACnetDevice>") in t.body and (param("temp"), A, e("Temperature")) in t.body
    rows = spark.createDataFrame([tuple(e(f"{p}{k}") for p in sorted(t.parameters)) for k in range(2)], ", ".join(f"`{p}` string" for p in sorted(t.parameters)))
    g = t.graph(rows)
    refs = g.where(F.col("p") == f"<{REFERENCES}hasExternalReference>")
    assert refs.count() == 4 and refs.select("o").distinct().count() == 4 and g.where(F.col("p") == f"<{NETWORK}objectOf>").count() == 4


def test_an_engine_matches_with_its_library_and_checks_shape_by_shape(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "graphs"))
    shapes = turtle.read(HEAD + "e:Sub rdfs:subClassOf e:Top . e:S a sh:NodeShape ; sh:property [ sh:path e:p ; sh:minCount 1 ] .")
    from graphloom.catalog import Library

    engine.libraries["urn:lib"] = Library("urn:lib", {}, shapes)
    m = engine.create_model("urn:model")
    engine.add(m, frame(spark, "e:x a e:Sub ."))
    nodes, rows = engine.matcher(m, Template("t", ((param("name"), A, e("Top")),)), "urn:lib").best()
    assert rows.count() == 1
    summary, report = engine.validate_shapes(m, shapes, [e("S")], e("Top"))
    assert [tuple(r) for r in summary.collect()] == [(e("S"), False, 1, 1)] and report.count() == 1


def test_shapes_with_texts_compile(spark, tmp_path):
    """A shapes graph with rules of several kinds compiles; the kind that is not known is named."""
    engine = Engine(spark, str(tmp_path / "graphs"))
    m = engine.create_model("urn:model")
    engine.add(m, frame(spark, "e:x a e:T ; e:v 1 ."))
    shapes = turtle.read(HEAD + f"""<{E}> sh:declare [ sh:prefix "e" ; sh:namespace "{E}" ] . e:S a sh:NodeShape ; sh:targetClass e:T ; sh:rule [ a sh:SPARQLRule ; sh:construct "CONSTRUCT {{ $this e:w ?v }} WHERE {{ $this e:v ?v }}" ] , [ a sh:Strange ] , [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate e:ok ; sh:object e:yes ] .""")
    with pytest.warns(UserWarning, match="not read"):
        out = engine.compile(m, shapes)
    assert {r.p for r in out.where(F.col("s") == e("x")).collect()} == {A, e("v"), e("w"), e("ok")}
    assert len(ShapeGraph(shapes).shapes()) == 1
