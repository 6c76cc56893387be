"""Scans, linked calls of templates, completed matches and ontologies with rules of their own."""

from pyspark.sql import functions as F

from graphloom.catalog import Engine
from graphloom.operators import match, validate
from graphloom.plans.shapes import Shape
from graphloom.plans.template import NETWORK, Builder, Template, _minted
from graphloom.sources import network, turtle
from graphloom.terms import A, LABEL, SUBCLASS, iri, is_param, literal, param

E = "urn:example/"
SCHEMA = "s string, p string, o string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_scan_of_devices_and_points(spark):
    scan = spark.createDataFrame(
        [
            ("Device", {"device_id": "roof unit", "address": "10.0.0.7"}),
            ("Device", {"device_id": "", "address": "10.0.0.8"}),
            ("Device", {"device_id": "lost"}),
            ("Object", {"name": 'supply "A"', "address": "3", "type": "ai", "device_id": "roof unit"}),
            ("Object", {"name": 'supply "A"', "address": "3", "type": "ai", "device_id": "roof unit"}),
            ("Object", {"name": 'supply "A"', "address": "3", "type": "ai", "device_id": "cellar"}),
            ("Object", {"name": "nameless type", "address": "4", "device_id": "cellar"}),
            ("Pump", {"device_id": "x", "address": "y"}),
        ],
        "rtype string, fields map<string,string>",
    )
    g = network.graph(scan, E)
    devices = rows(g.where(F.col("p") == f"<{NETWORK}device-instance>").select("s", "o"))
    assert devices == [(f"<{E}10.0.0.8>", '""'), (f"<{E}roof_unit>", '"roof unit"')]
    points = rows(g.where(F.col("o") == f"<{network.BRICK}Point>").select("s"))
    assert points == [(f"<{E}supply__A_-3>",)]
    references = g.where(F.col("p") == f"<{NETWORK}objectOf>")
    assert rows(references.select("o")) == [(f"<{E}cellar>",), (f"<{E}roof_unit>",)]
    titles = g.where(F.col("p") == f"<{NETWORK}object-name>")
    assert {r.o for r in titles.collect()} == {'"supply \\"A\\""'}
    assert network.graph(scan.limit(0), E).count() == 0


def test_scan_makes_each_term_once_a_record(spark, capsys):
    """However many triples say a term: the names of references were hashed, and their texts cleaned, once for each of them."""
    scan = spark.createDataFrame([("Object", {"name": "a", "address": "3", "type": "ai", "device_id": "d"})], "rtype string, fields map<string,string>")
    g = network.graph(scan, E)
    assert g.count() == 6
    capsys.readouterr()
    g.explain()
    assert capsys.readouterr().out.count("sha2(") <= 1


def test_rows_of_calls_are_linked(spark):
    b = Builder(spark, E)
    room = Template("room", ((param("name"), A, iri(f"{E}Room")), (param("name"), iri(f"{E}on"), param("floor"))), frozenset({"floor"}))
    lamp = Template("lamp", ((param("name"), A, iri(f"{E}Lamp")), (param("name"), iri(f"{E}in"), param("room"))))
    given = spark.createDataFrame([(1, None, f"<{E}first>"), (2, f"<{E}hall>", None), (2, f"<{E}hall>", None)], "k int, name string, floor string")
    rooms = b.add_rows(room, given, F.col("k"))
    b.add_rows(lamp, rooms.select("k", F.col("name").alias("room")), F.col("k"))
    b.add(lamp, name=f"<{E}spare>", room=f"<{E}hall>")
    g = b.compile()
    assert {r.o for r in g.where((F.col("s") == f"<{E}hall>")).collect()} == {iri(f"{E}Room"), '"Room"'}  # optional and unbound: no floor
    assert g.where(F.col("p") == iri(f"{E}in")).count() == 3
    assert g.where((F.col("p") == iri(f"{E}on"))).count() == 1
    # every lamp is in a room that is there, and no name stands for a room and a lamp
    lamps, kinds = g.where(F.col("p") == iri(f"{E}in")), g.where(F.col("p") == A)
    assert lamps.join(kinds.where(F.col("o") == iri(f"{E}Room")).select(F.col("s").alias("o")), "o", "left_anti").count() == 0
    assert kinds.groupBy("s").count().where("count > 1").count() == 0
    assert g.where(F.col("p") == LABEL).count() == 5
    assert Builder(spark, E).compile().count() == 0


def test_minted_names_stay_apart(spark):
    n = 300_000  # names of 32 bits would meet some ten times
    assert spark.range(n).select(_minted(E, "x", F.col("id")).alias("x")).distinct().count() == n


def test_partial_matches_are_completed_together(spark):
    g = spark.createDataFrame([(f"<{E}a{k}>", iri(f"{E}feeds"), f"<{E}b{k}>") for k in range(4)] + [(f"<{E}a0>", iri(f"{E}note"), '"n"')], SCHEMA)
    body = ((param("name"), iri(f"{E}feeds"), param("to")), (param("name"), iri(f"{E}has"), param("part")), (param("part"), A, iri(f"{E}Part")), (param("to"), iri(f"{E}says"), param("word")))
    t = Template("fed", body, frozenset({"word"}))
    m = match.Matcher(t, g, spark.createDataFrame([], SCHEMA), check_predicates=True)
    nodes, found = m.best()
    done = m.completed(nodes, found, E)
    assert done.where(F.col("p") == iri(f"{E}has")).select("o").distinct().count() == 4
    assert done.where(F.col("p") == A).count() == 4 and done.count() == 8  # nothing of the optional word
    one = found.orderBy(*found.columns).first().asDict()
    left = m.remaining(nodes, one)
    assert {x[1] for x in left.body if any(map(is_param, x))} - {iri(f"{E}says")} == {r.p for r in done.select("p").distinct().collect()}
    again = match.Matcher(t, g.unionByName(done), spark.createDataFrame([(iri(f"{E}Part"), SUBCLASS, iri(f"{E}Thing"))], SCHEMA), check_predicates=True)
    assert len(again.best()[0]) > len(nodes)


ONTOLOGY = f"""
@prefix e: <{E}> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
e:house a owl:Ontology .
e:Door a owl:Class, sh:NodeShape ; sh:rule [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate e:opens ; sh:object "yes" ] .
e:front a e:Door .
"""


def test_ontologies_with_rules_and_without_overwriting(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "c"))
    plain_one = e.load_ontology(turtle.read(ONTOLOGY))
    said = (iri(f"{E}front"), iri(f"{E}opens"), literal("yes"))
    assert said not in plain_one.shapes
    assert e.load_ontology(turtle.read(ONTOLOGY), overwrite=False, run_rules=True) is plain_one
    told = e.load_ontology(turtle.read(ONTOLOGY), run_rules=True)
    assert said in told.shapes and set(plain_one.shapes) <= set(told.shapes) and e.library(f"{E}house") is told
    assert e.load_ontology(turtle.read(f"<{E}x> <{E}y> <{E}z> ."), run_rules=True).name == "urn:unnamed/"


def test_reasons_by_shape(spark):
    lit = Shape(iri(f"{E}lit"), constraints=(("property", Shape(iri(f"{E}lit-p"), path=iri(f"{E}lamp"), constraints=(("minCount", 1),))),))
    inner = Shape(iri(f"{E}in"), constraints=(("node", lit),))
    shapes = [Shape(iri(f"{E}s{k}"), targets=(("class", iri(f"{E}Hall")),), constraints=(("property", Shape(iri(f"{E}s{k}-p"), path=iri(f"{E}{p}"), constraints=(("qualified", (inner, 1, None)),))),)) for k, p in enumerate(("next", "over"))]
    g = [(f"<{E}h{k}>", A, iri(f"{E}Hall")) for k in range(5)] + [(f"<{E}h0>", iri(f"{E}next"), f"<{E}r>"), (f"<{E}r>", iri(f"{E}lamp"), '"1"')]
    report = validate.Validator(spark.createDataFrame(g, SCHEMA)).report(shapes)
    (row,) = validate.reasons_by_shape(validate.diff(report, shapes)).collect()
    assert row.shapename == iri(f"{E}lit") and row.n == 5 and len(row.reasons) == 2  # h0 lacks one over it only
    assert not any("/h" in r for r in row.reasons)
    assert validate.reasons_by_shape(validate.diff(report.limit(0), shapes)).count() == 0
