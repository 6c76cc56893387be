"""Templates, shapes, Turtle and the catalog on small graphs."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from graphloom.catalog import Engine, NotFound, shape_to_template, unique_name
from graphloom.operators import extract, graph
from graphloom.plans.shapes import ShapeGraph, inline
from graphloom.plans.template import Builder, Dependency, Template, Unresolved, ingest
from graphloom.sources import ntriples, records, turtle
from graphloom.streaming.ingest import stream_to_graph
from graphloom.terms import A, iri, lexical, literal, param, param_name, qname, text_of

E = "http://example.net/e#"
HEAD = """@prefix e: <http://example.net/e#> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix P: <urn:___param___#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
"""


def t(name, *links, optional=(), deps=(), known=None):
    """A template whose name is linked to parameters."""
    body = ((param("name"), A, iri(E + name)), *((param("name"), iri(E + "has"), param(x)) for x in links))
    return Template(name, body, frozenset(optional), tuple(Dependency(d, a) for d, a in deps), lambda _, n: (known or {}).get(n))


def frame(spark, text):
    return spark.createDataFrame(turtle.read(HEAD + text), "s string, p string, o string")


# --- terms and Turtle


def test_terms():
    assert param_name("<urn:___param___#urn:___param___#x>") == "x"
    with pytest.raises(ValueError):
        param_name("<urn:x>")
    assert text_of(literal('a"b\n\\')) == 'a"b\n\\'
    assert qname("<urn:a#b>", {"p": "urn:a#", "q": "urn:"}) == "p:b" and qname("<urn:a#>", {"p": "urn:a#"}) == "urn:a#"
    assert unique_name("x", {"x", "x_1"}) == "x_2"


def test_turtle():
    got = set(turtle.read(HEAD + '''# comment
e:a a e:B, e:C ; e:p "x"@en , "1"^^xsd:int, 5, 1.5, 1e3, true, 'q' ; .
e:b e:list ( e:x [ e:y """long "quoted" text""" ] ) . e:part\\+ e:p P:b\\-c .
[ e:in e:out ] .
BASE <urn:base/>
<rel> e:p <#frag> .'''))
    s = {(x[1], x[2]) for x in got if x[0] == f"<{E}a>"}
    assert (A, f"<{E}C>") in s and (f"<{E}p>", '"x"@en') in s and len(s) == 9
    assert (f"<{E}part+>", f"<{E}p>", "<urn:___param___#b-c>") in got
    assert any(o == '"long \\"quoted\\" text"' for _, _, o in got)
    assert ("<urn:base/rel>", f"<{E}p>", "<urn:base/#frag>") in got
    sg = ShapeGraph(list(got))
    head = sg.one(f"<{E}b>", f"<{E}list>")
    assert sg.items(head)[0] == f"<{E}x>" and len(sg.items(head)) == 2
    again = set(turtle.read(turtle.write([x for x in got if "_:" not in "".join(x)], {"e": E})))
    assert again == {x for x in got if "_:" not in "".join(x)}
    for bad in ("e:a e:p", "x:a x:b x:c .", "e:a e:p e:o", '"s'):
        with pytest.raises((ValueError, IndexError)):
            turtle.read(HEAD + bad)


def test_lexical_reads_escapes(spark):
    said = ["\ue000", "a\\nb", "\\\n\\n\t\r", 'q"\\"', "", "\\" * 5 + "n", "plain\ntext", "\\t\\r" * 20_000]
    rows = spark.createDataFrame([(k, literal(x).replace("\t", "\\t")) for k, x in enumerate(said)], "k long, t string")
    assert [r[0] for r in rows.orderBy("k").select(lexical(F.col("t"))).collect()] == said


# --- templates


def test_parameters_and_dependencies():
    """A cart of two wheels, whose hubs are bolts; the right wheel shares the left one's node as its rim."""
    known = {}
    known["bolt"] = t("bolt", "thread", known=known)
    known["wheel"] = t("wheel", "rim", "hub", deps=[("bolt", {"name": "hub"})], known=known)
    cart = known["cart"] = t("cart", "left", "right", deps=[("wheel", {"name": "left"}), ("wheel", {"name": "right", "rim": "left"})], known=known)
    cart.check()
    assert cart.parameters == {"name", "left", "right"} and cart.dependency_parameters == {"name", "rim", "hub"}
    assert cart.transitive_parameters() == {"name", "left", "right", "left-rim", "left-hub", "left-hub-thread", "right-hub", "right-hub-thread"}
    assert cart.parameter_counts() == {"name": 5, "left": 1, "right": 1, "rim": 2, "hub": 2, "thread": 2}
    assert cart.dependency_for("right").name == "wheel" and known["wheel"].dependency_for("rim") is None
    for wrong in ({"rim": "left"}, {"name": "nowhere"}, {"name": "left", "spoke": "right"}):
        with pytest.raises(ValueError):
            t("sledge", "left", "right", deps=[("wheel", wrong)], known=known).check()
    with pytest.raises(Unresolved):
        t("sledge", "runner", deps=[("runner", {"name": "runner"})], known=known).inline()
    known["chain"] = t("chain", "link", deps=[("ring", {"name": "link"})], known=known)
    known["ring"] = t("ring", "link", deps=[("chain", {"name": "link"})], known=known)
    with pytest.raises(Unresolved):
        known["chain"].inline()
    once = cart.to_inline(["name", "left"])
    assert once.parameters == {"name", "left", "right-cart-inlined"} and once.to_inline(["name", "left"]).parameters == once.parameters


def test_inlining_optionality():
    """Parts of an optional part are optional, whatever the depth; what is also needed elsewhere is not."""
    known = {}
    known |= {"lamp": t("lamp", "bulb", known=known), "desk": t("desk", "lamp", "drawer", optional=["drawer"], deps=[("lamp", {"name": "lamp"})], known=known)}
    office = t("office", "main", "spare", optional=["spare"], deps=[("desk", {"name": "main"}), ("desk", {"name": "spare"})], known=known).inline()
    required = {"name", "main", "main-lamp", "main-lamp-bulb"}
    assert office.parameters - office.optional == required
    assert office.optional == {"main-drawer", "spare", "spare-lamp", "spare-lamp-bulb", "spare-drawer"}
    # one parameter of a dependency may be optional by its inlined name alone
    assert t("room", "light", optional=["light-bulb"], deps=[("lamp", {"name": "light"})], known=known).inline().optional == {"light-bulb"}
    # a required parameter that an optional dependency shares stays required
    shared = t("hall", "light", "stock", optional=["light"], deps=[("lamp", {"name": "light", "bulb": "stock"})], known=known).inline()
    assert shared.optional == {"light"} and shared.parameters == {"name", "light", "stock"}


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=4, unique=True), st.integers(0, 5))
def test_inlining_commutes_with_evaluation(links, unbound):
    """Binding all parameters of the inlined template makes the triples of each template bound by itself."""
    known = {}
    for k in range(4):
        needs = [(f"n{b}", {"name": f"x{b}"}) for a, b in links if a == k < b]
        known[f"n{k}"] = t(f"n{k}", *[f"x{b}" for a, b in links if a == k < b], "own", deps=needs, known=known)
    flat = known["n0"].inline()
    terms = {p: f"<urn:v/{p}>" for p in flat.parameters}

    def spell(template, prefix):
        own = {p: terms[f"{prefix}{p}"] if f"{prefix}{p}" in terms else None for p in template.parameters if p != "name"}
        own["name"] = terms[prefix[:-1] or "name"]
        made = set(template.evaluate(own))
        for d in template.dependencies:
            made |= spell(known[d.template], f"{prefix}{d.args['name']}-")
        return made

    assert set(flat.evaluate(terms)) == spell(known["n0"], "")
    fewer = dict(sorted(terms.items())[unbound:])
    left = flat.evaluate(fewer, require_optional=True)
    assert (left.parameters if isinstance(left, Template) else set()) == set(flat.parameters) - set(fewer)


def test_evaluate(spark):
    book = t("book", "author", "shelf", optional=["author", "shelf"])
    n, a, s = (iri(E + x) for x in "nas")
    assert {x[2] for x in book.evaluate({"name": n})} == {iri(E + "book")}
    assert {x[2] for x in book.evaluate({"name": n, "author": a, "shelf": s})} == {iri(E + "book"), a, s}
    for bound in ({"shelf": s}, {"author": a, "shelf": s}):
        assert book.evaluate(bound).parameters >= {"name"}
    assert book.evaluate({"name": n, "shelf": s}, require_optional=True).parameters == {"author"}
    rows = spark.createDataFrame([("<a>", "<z>"), ("<b>", None), (None, "<z>"), ("<a>", "<z>")], "name string, shelf string")
    assert book.graph(rows).count() == 3
    assert [r[0] for r in rows.select(book.complete(rows)).collect()] == [True, True, False, True]
    with pytest.raises(ValueError):
        book.graph(rows, require_optional=True)
    blank = Template("copy", ((param("name"), iri(E + "at"), "_:b"), ("_:b", iri(E + "id"), param("id"))))
    g = blank.graph(spark.createDataFrame([("<a>", '"1"'), ("<b>", '"2"')], "name string, id string"))
    assert g.count() == 4 and g.where("p like '%at>'").select("o").distinct().count() == 2


def test_ingest(spark):
    loan = t("loan", "reader")
    r = spark.createDataFrame([("l1", "Ann B."), ("l2", None)], "name string, reader string")
    with pytest.raises(ValueError):
        ingest(loan, r, E)
    g = ingest(loan, r, E, fill_unused=True).collect()
    assert len(g) == 4 and {x.o for x in g if x.p == iri(E + "has") and x.s == iri(E + "l1")} == {'"Ann B."'}
    b = Builder(spark, E)
    b.add(loan, name=iri(E + "a"))
    b.add(loan, name=iri(E + "b"), reader=iri(E + "c"))
    made = b.compile()
    assert made.count() == 6 and made.where("p like '%label>'").select("o").distinct().collect()[0].o == '"loan"'
    assert loan.header() == ["name", "reader"]


# --- graphs


def test_graph_operations(spark):
    g = frame(spark, "e:a e:p [ e:q [ e:r 1 ] ] ; e:p e:b . e:b e:p _:x . _:y e:p e:c .")
    assert graph.describe(g, spark.createDataFrame([(f"<{E}a>",)], "node string")).count() == 4
    h = graph.rename_blank_nodes(g, "other")
    assert graph.size(graph.union(g, h)) == 6 + 6 - 1 and graph.canonical_hash(g) == graph.canonical_hash(h)
    assert graph.canonical_hash(g) != graph.canonical_hash(graph.remove_node(g, f"<{E}c>"))
    assert graph.canonical_hash(g.where("s like '<%' and o like '<%'")) == graph.canonical_hash(g.where("s like '<%' and o like '<%'").repartition(3))
    s = frame(spark, "e:s sh:property [ sh:path e:p ] .")
    assert graph.skolemize(s).where("s like '_:%' or o like '_:%'").count() == 0
    assert graph.value(g, f"<{E}a>", f"<{E}none>") is None


# --- shapes


def test_shape_templates_and_text():
    sg = ShapeGraph(turtle.read(HEAD + """
e:VAV a owl:Class, sh:NodeShape ; sh:property [ sh:path e:hasPoint ; sh:name "air flow" ; sh:qualifiedValueShape [ sh:class e:Flow ] ; sh:qualifiedMinCount 2 ] ;
  sh:property [ sh:path e:zone ; sh:node e:Zone ; sh:minCount 1 ] ; sh:property [ sh:path e:on ; sh:hasValue e:floor ] ; sh:property [ sh:path ( e:a [ sh:oneOrMorePath e:b ] ) ] .
e:Zone a sh:NodeShape ; sh:targetSubjectsOf e:zoned . e:bad a sh:NodeShape ; sh:property [ a sh:PropertyShape ; sh:minCount 1 ] .
e:loop a sh:NodeShape ; sh:node e:loop . e:both a sh:NodeShape ; sh:and ( e:one e:two ) . e:one sh:class e:C . e:two sh:class e:D ."""))
    made = shape_to_template(sg.shape(f"<{E}VAV>"), lambda lib, n: None)
    assert made.parameters == {"name", "air_flow0", "air_flow1", "p1"} and made.dependencies[0].args == {"name": "p1"}
    assert (param("name"), f"<{E}on>", f"<{E}floor>") in made.body
    text = extract.query_text(sg.shape(f"<{E}VAV>"))
    assert "?target rdf:type/rdfs:subClassOf* <http://example.net/e#VAV> ." in text and f"?target <{E}on> <{E}floor> ." in text
    assert text.index("?air_flow") < text.index("WHERE") and f"<{E}a>/(<{E}b>)+" in text and "OPTIONAL" in text
    assert inline(sg.shape(f"<{E}both>")).get("class") == [f"<{E}C>", f"<{E}D>"]
    for broken in ("bad", "loop"):
        with pytest.raises(ValueError):
            sg.shape(f"<{E}{broken}>")


# --- files, catalog, streams


def test_ntriples_and_table(spark, tmp_path):
    g = frame(spark, 'e:a e:p "x . y"@en, "q\\"", 5 . _:b e:p e:c .')
    path = str(tmp_path / "g")
    ntriples.write(g, path)
    assert ntriples.read(spark, path).exceptAll(g).count() == 0
    (tmp_path / "bad.nt").write_text("# fine\n\n<a> <b> .\n")
    with pytest.raises(Exception):
        ntriples.read(spark, str(tmp_path / "bad.nt")).collect()
    long = literal("x\\y\"z" * 50_000)
    ntriples.write(spark.createDataFrame([("<a>", "<b>", long)], "s string, p string, o string"), str(tmp_path / "long"))
    assert ntriples.read(spark, str(tmp_path / "long")).first().o == long
    store = str(tmp_path / "store")
    ntriples.append(g, "one", store)
    ntriples.append(g, "one", store)
    ntriples.append(g.limit(1), "two", store)
    assert ntriples.load(spark, store, "one").count() == 4 and ntriples.load(spark, store, "none").count() == 0
    ntriples.replace(g.limit(2), "one", store)
    assert ntriples.load(spark, store, "one").count() == 2 and ntriples.graph_ids(spark, store) == ["one", "two"]
    ntriples.delete(spark, "two", store)
    assert ntriples.graph_ids(spark, store) == ["one"]


def test_records(spark, tmp_path):
    (tmp_path / "r.csv").write_text("name,room\na,1\nb,\n")
    r = records.from_csv(spark, str(tmp_path / "r.csv"))
    assert [tuple(x)[:2] for x in r.collect()] == [("a", "1"), ("b", None)]
    assert records.from_csv(spark, data=["name,room", "a,1"]).first().rtype == "data stream"
    with pytest.raises(ValueError):
        records.from_csv(spark)
    (tmp_path / "r.json").write_text(json.dumps([{"rtype": "Device", "fields": {"device_id": "d 1", "address": "x"}}, {"rtype": "Object", "fields": {"name": "p q", "type": "ai", "address": "7", "device_id": "d 1"}}]))
    j = records.from_json(spark, str(tmp_path / "r.json"))
    assert [tuple(x) for x in records.bacnet(j).orderBy("kind").collect()] == [("device", "d_1", "d_1", None), ("point", "p_q-7", "d_1", "ai,7")]


def test_catalog(spark, tmp_path):
    lib = tmp_path / "lib"
    lib.mkdir()
    (lib / "t.yml").write_text("""
fan:
  body: "P:name a e:Fan ; e:has P:speed ."
  optional: [speed]
ahu:
  type: http://example.net/e#AHU
  hasPart: sf
  dependencies: [{template: fan, args: {name: sf}}]
""")
    (lib / "s.ttl").write_text(HEAD + """<urn:lib> a owl:Ontology ; owl:imports <urn:other> . e:AHU a owl:Class, sh:NodeShape ;
  sh:property [ sh:path e:hasPart ; sh:class e:Fan ; sh:minCount 1 ; sh:name "fan" ] . e:BigFan rdfs:subClassOf e:Fan .""")
    engine = Engine(spark, str(tmp_path / "store"))
    prefixes = {"e": E, "P": "urn:___param___#"}
    engine.load_directory(str(lib), prefixes, E, infer_templates=True)
    assert set(engine.library("lib").templates) == {"fan", "ahu", E + "AHU"}
    with pytest.raises(ValueError):
        engine.add_template("lib", "x", {"nonsense": 1}, prefixes, E)
    engine.load_ontology(turtle.read(HEAD + "<urn:other> a owl:Ontology ; owl:imports <urn:other> . e:x e:y e:z ."))
    shapes = engine.library("lib").shapes
    assert len(engine.resolve_imports("lib")) == len(shapes) + 3 and len(engine.resolve_imports("lib", 0)) == len(shapes)

    m = engine.create_model("urn:site", "a site")
    with pytest.raises(ValueError):
        engine.create_model("not an iri")
    # names that differ in a sign only have graphs of their own, and descriptions may have any text
    for name in ("urn:a-b", "urn:a_b"):
        engine.create_model(name, f'the "{name}"\\')
    engine.delete_model("urn:a-b")
    kept = engine.graph(engine.model("urn:a_b")).where("p like '%comment>'").select(lexical(F.col("o"))).first()[0]
    assert kept == 'the "urn:a_b"\\'
    ahu = engine.template("lib", "ahu").inline()
    engine.add(m, ahu.graph(spark.createDataFrame([(iri(E + "a"), iri(E + "f"))], "name string, sf string")))
    engine.add(m, spark.createDataFrame([(iri(E + "b"), A, iri(E + "AHU"))], "s string, p string, o string"))
    valid, report, diff = engine.validate(m, shapes, {"e": E})
    assert not valid and [r.reason for r in diff.collect()] == [f"{E}b expected at least 1 instance(s) of e:Fan on path e:hasPart"]
    rows = engine.shape_table(m, shapes, f"<{E}AHU>").orderBy("target").collect()
    assert [tuple(r) for r in rows] == [(E + "a", E + "f"), (E + "b", None)]
    assert engine.template_to_shape(engine.template("lib", "ahu")).get("property")[0].get("node")[0].get("class") == [f"<{E}Fan>"]
    assert json.loads(engine.describe())["models"][0]["name"] == "urn:site"
    # a template elsewhere survives the library that it depends on, and works again once that is back
    engine.create_library("mine")
    engine.add_template("mine", "uses", {"body": "P:name e:p P:x .", "dependencies": [{"library": "lib", "template": "fan", "args": {"name": "x"}}]}, prefixes, E)
    engine.delete_library("lib")
    with pytest.raises(Unresolved):
        engine.template("mine", "uses").inline()
    engine.load_directory(str(lib), prefixes, E)
    assert engine.template("mine", "uses").inline().parameters == {"name", "x", "x-speed"}
    engine.delete_model("urn:site")
    with pytest.raises(NotFound):
        engine.model("urn:site")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"name": "a", "reader": "x"}\n{"name": "b", "reader": "y"}\n')
    stream = spark.readStream.schema("name string, reader string").json(str(tmp_path / "in"))
    for _ in range(2):
        stream_to_graph(stream, t("loan", "reader"), E, str(tmp_path / "store"), "live", str(tmp_path / "ck")).awaitTermination(60)
        (tmp_path / "in/2.json").write_text('{"name": "a", "reader": "x"}\n{"name": "c", "reader": "z"}\n')
    assert ntriples.load(spark, str(tmp_path / "store"), "live").count() == 6


def test_catalog_is_kept(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(NotFound):
        Engine.open(spark, path)
    engine = Engine(spark, path)
    m = engine.create_model("urn:shop", "a shop")
    m.manifest = [(iri(E + "a"), A, iri(E + "B"))]
    engine.create_library("lib").shapes = [(iri(E + "s"), A, iri(E + "B"))]
    prefixes = {"e": E, "P": "urn:___param___#"}
    engine.add_template("lib", "till", {"body": "P:name a e:Till ; e:by P:clerk .", "optional": ["clerk"]}, prefixes, E)
    engine.add_template("lib", "shop", {"body": "P:name e:has P:till .", "dependencies": [{"template": "till", "args": {"name": "till"}}]}, prefixes, E)
    assert engine.save() == 1
    engine.delete_library("lib")
    assert engine.save() == 2
    again = Engine.open(spark, path, version=1)
    assert again.models == engine.models and again.library("lib").shapes == [(iri(E + "s"), A, iri(E + "B"))]
    assert again.template("lib", "shop").inline().header() == ["name", "till", "till-clerk"]
    assert again.graph(again.model("urn:shop")).count() == 2
    assert Engine.open(spark, path).libraries == {} and list(Engine.open(spark, path).models) == ["urn:shop"]
    with pytest.raises(NotFound):
        Engine.open(spark, path, version=3)


def test_header_and_dependencies(tmp_path):
    known = {}
    shelf = known["shelf"] = Template("shelf", ((param("name"), A, param("kind")),))
    book = Template("book", ((param("name"), f"<{E}on>", param("where")), (param("name"), f"<{E}title>", param("a,b"))), frozenset({"a,b"}), (), lambda _, n: known.get(n))
    assert book.csv(str(tmp_path / "h.csv")) == 'name,where,"a,b"\n' == (tmp_path / "h.csv").read_text()
    more = book.depending("shelf", {"name": "where"})
    assert more.inline().parameters == {"name", "where", "a,b", "where-kind"} and more.not_depending("shelf").dependencies == ()
    assert more.not_depending("shelf", {"name": "other"}) == more and shelf.csv() == "kind,name\n"
    for args in ({}, {"name": "nowhere"}, {"name": "where", "none": "where"}):
        with pytest.raises(ValueError):
            book.depending("shelf", args)
