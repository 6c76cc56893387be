"""Validation, reasons, matching, rules and labels on small graphs."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import terms
from graphloom.functions import expressions as X
from graphloom.functions import labels as L
from graphloom.operators import algebra, closure, graph, infer, match, validate
from graphloom.plans.shapes import Shape, ShapeGraph
from graphloom.plans.template import Template
from graphloom.sources import turtle
from graphloom.terms import A, iri, literal, param

from .test_plans import E, HEAD, frame

PREFIXES = {"e": E}


def run(spark, text):
    triples = turtle.read(HEAD + text)
    shapes = ShapeGraph(triples).shapes()
    report = validate.Validator(frame(spark, text), PREFIXES).report(shapes).cache()
    return report, validate.diff(report, shapes, PREFIXES)


ONTOLOGY = "e:VAV rdfs:subClassOf e:TU . e:RVAV rdfs:subClassOf e:VAV . e:SAF rdfs:subClassOf e:AF . "


def test_reasons(spark):
    text = ONTOLOGY + """e:vav1 a e:VAV . e:vav2 a e:RVAV ; e:hasPoint e:p1, e:p2 . e:p1 a e:SAF . e:p2 a e:T .
e:shape a sh:NodeShape ; sh:targetClass e:VAV ;
  sh:property [ sh:path e:hasPoint ; sh:qualifiedValueShape [ sh:class e:AF ] ; sh:qualifiedMinCount 1 ] ;
  sh:property [ sh:path e:hasPoint ; sh:qualifiedValueShape [ sh:class e:T ] ; sh:qualifiedMinCount 1 ; sh:severity sh:Warning ] ;
  sh:property [ sh:path e:label ; sh:minCount 1 ; sh:maxCount 1 ; sh:severity sh:Info ] ."""
    report, diff = run(spark, text)
    assert {(r.severity, r["count"]) for r in report.groupBy("severity").count().collect()} == {("Violation", 1), ("Warning", 1), ("Info", 2)}
    assert not validate.conforms(report)
    reasons = {r.reason for r in diff.where(F.col("focus") == f"<{E}vav1>").collect()}
    assert reasons == {f"{E}vav1 expected at least 1 instance(s) of e:AF on path e:hasPoint", f"{E}vav1 expected at least 1 instance(s) of e:T on path e:hasPoint", f"{E}vav1 expected 1 uses of path e:label"}
    by = {r.entity: len(r.reasons) for r in validate.reasons_by_severity(diff, "Warning").collect()}
    assert by == {f"<{E}vav1>": 1, f"<{E}vav2>": 0}
    with pytest.raises(ValueError):
        validate.reasons_by_severity(diff, "Fatal")
    made = validate.repair(diff.where("kind = 'PathClassCount'"), {"e:hasPoint": f"<{E}hasPoint>"}, E)
    assert made.count() == 4 and made.where(F.col("p") == A).count() == 2
    fixed = frame(spark, text).unionByName(made)
    again = validate.Validator(fixed, PREFIXES).report(ShapeGraph(turtle.read(HEAD + text)).shapes())
    assert validate.conforms(again)


def test_nested_shapes_name_the_parent(spark):
    text = """e:a a e:C . e:parent a sh:NodeShape ; sh:targetClass e:C ; sh:and ( e:x [ sh:node e:y ] ) . e:x sh:property [ sh:path e:p ; sh:minCount 1 ] . e:y sh:class e:D ."""
    report, diff = run(spark, text)
    assert {(r.component, r.source_shape == f"<{E}parent>") for r in report.collect()} == {("MinCountConstraintComponent", False), ("ClassConstraintComponent", True)}
    assert {r.kind for r in diff.collect()} == {"RequiredPath", "RequiredClass"}


def test_or_and_exact_count(spark):
    text = """@prefix c: <urn:graphloom/constraint#> . e:a a e:C . e:s a sh:NodeShape ; sh:targetClass e:C ; sh:or ( e:x e:y ) . e:x sh:class e:D . e:y sh:property [ sh:path e:p ; sh:minCount 1 ] .
e:n a sh:NodeShape ; sh:targetNode e:any ; c:exactCount 2 ; c:class e:C ."""
    _, diff = run(spark, text)
    got = {r.entity: r.reasons for r in validate.broken_entities(diff).collect()}
    assert got == {f"<{E}a>": [f"{E}a needs to match one of the following shapes: {E}x, {E}y"], "Model": [f"Graph did not have 2 instances of {E}C"]}


def test_other_constraints(spark):
    data = 'e:a a e:C ; e:t "x"@en, "y"@en, "z"@fr ; e:lo 5 ; e:hi 3 ; e:n "12a"^^xsd:integer ; e:same e:q ; e:too e:r ; e:path e:b . e:b e:path e:c . e:c e:path e:b ; e:end e:d . '
    prop = lambda p, c: f"e:s a sh:NodeShape ; sh:targetClass e:C ; sh:property [ sh:path {p} ; {c} ] ."
    n = lambda p, c: run(spark, data + prop(p, c))[0].count()
    assert n("e:t", "sh:uniqueLang true") == 1 and n("e:t", 'sh:languageIn ( "en" )') == 1
    assert n("e:lo", "sh:lessThan e:hi") == 1 and n("e:hi", "sh:lessThanOrEquals e:lo") == 0
    assert n("e:same", "sh:equals e:too") == 2 and n("e:n", "sh:datatype xsd:integer") == 1 and n("e:lo", "sh:datatype xsd:integer") == 0
    assert n("e:t", 'sh:pattern "^[XY]$" ; sh:flags "i"') == 1 and n("e:t", "sh:maxLength 0") == 3
    assert n("( [ sh:oneOrMorePath e:path ] e:end )", "sh:minCount 1") == 0
    assert n("( [ sh:zeroOrOnePath e:path ] e:end )", "sh:minCount 1") == 1
    assert n("[ sh:zeroOrMorePath e:path ]", "sh:maxCount 2") == 1 and n("[ sh:inversePath e:none ]", "sh:minCount 1") == 1
    assert run(spark, data + "e:s a sh:NodeShape ; sh:targetClass e:C ; sh:deactivated true ; sh:class e:D .")[0].count() == 0
    v = validate.Validator(frame(spark, data))
    shape = Shape("<x>", targets=(("class", f"<{E}C>"),), constraints=(("sparql", lambda g, foci: foci.withColumn("value", F.lit("<v>"))),))
    assert v.report([shape]).count() == 1 and v.check_on(shape, f"<{E}C>").count() == 1


def test_builder():
    s = Shape("<s>").of_class("<C>", active=True).count(min=1).has_property(Shape("<p>", path="<q>").matches("<D>", exactly=2, qualified=True))
    assert s.targets == (("class", "<C>"),) and s.get("minCount") == [1] and s.get("property")[0].get("qualified")[0][1:] == (2, 2)
    assert Shape("<s>").count(0).constraints == () and (s | s).get("or") and (s & s).get("and")


def test_optional_with_unbound_variables(spark):
    a = spark.createDataFrame([("1", None), ("2", "x")], "k string, v string")
    b = spark.createDataFrame([("x", "p"), ("y", "q")], "v string, w string")
    got = {tuple(r) for r in algebra.optional(a, b).select("k", "v", "w").collect()}
    assert got == {("1", "x", "p"), ("1", "y", "q"), ("2", "x", "p")}


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "s string, o string")
    assert closure.reach(e).count() == 9


def test_rules(spark):
    g = frame(spark, "e:a e:value 1 ; a e:Old . e:Old rdfs:subClassOf e:Base .")
    shapes = frame(spark, "e:s a sh:NodeShape .")
    rule = infer.construct_rule([("?x", f"<{E}value>", "?v")], ("?x", f"<{E}copied>", "?v"))
    out = infer.infer(g, shapes, [rule, infer.TripleRule(Shape("s", targets=(("class", f"<{E}Base>"),)), "$this", f"<{E}seen>", literal("yes"))])
    assert out.count() == 5


def test_matching(spark):
    onto = frame(spark, "e:Supply_Fan rdfs:subClassOf e:Fan . e:Damper rdfs:subClassOf e:Equip .")
    fan = Template("supply-fan", ((param("name"), A, f"<{E}Supply_Fan>"), (param("name"), f"<{E}has>", param("speed"))))
    m = match.Matcher(fan, frame(spark, "e:f1 a e:Fan . e:f2 a e:Fan ."), onto)
    nodes, rows = m.best()
    assert len(nodes) == 2 and rows.count() == 2
    _, one = m.best(target=f"<{E}f2>")
    assert one.count() == 1
    left = m.remaining(nodes, one.first().asDict())
    assert left.parameters == {"speed"}
    full = match.Matcher(fan, frame(spark, "e:f a e:Supply_Fan ; e:has e:s ."), onto)
    nodes, rows = full.best()
    assert len(nodes) == 3 and full.remaining(nodes, rows.first().asDict()) is None
    assert full.unmatched(nodes, full.edges, rows).count() == 0
    assert match.Matcher(fan, frame(spark, "e:d a e:Damper ."), onto).best() is None
    assert sum(rows.count() for _, rows in full.all()) >= 2


# --- labels

ABBR = L.abbreviations({"AHU": "urn:AHU", "FCU": "urn:FCU"})
EQUIP = L.sequence(ABBR, L.string("-", L.DELIMITER), L.regex("[0-9]+", L.IDENTIFIER))


def parse(spark, parser, *texts):
    df = spark.createDataFrame([(x,) for x in texts], "label string")
    return {r.label: r for r in L.parse(df, parser).collect()}


def short(r):
    return [(x.value, x.kind, x.length) for x in r.tokens]


def test_labels(spark):
    got = parse(spark, EQUIP, "AHU-1", "AHU1-", "FCU-3", "4AHU", "")
    assert short(got["AHU-1"]) == [("AHU", "Constant", 3), ("-", "Delimiter", 1), ("1", "Identifier", 1)] and got["AHU-1"].success
    assert got["AHU-1"].tokens[0].token == "urn:AHU"
    assert not got["AHU1-"].success and got["AHU1-"].errors == ["Expected -, got 1"] and short(got["AHU1-"])[0] == ("AHU", "Constant", 3)
    assert not got["4AHU"].success and got["4AHU"].errors == ["Expected AHU, got 4AH | Expected FCU, got 4AH"]
    one = L.many(L.sequence(L.regex("[A-Z]+", L.IDENTIFIER), L.regex("[0-9]+", L.IDENTIFIER), L.string("/", L.DELIMITER)))
    got = parse(spark, one, "AHU1/SP2/", "AHU1/SP2", "AHU1", "")
    assert len(short(got["AHU1/SP2/"])) == 6 and got["AHU1/SP2/"].success
    assert got["AHU1/SP2"].success and len(got["AHU1/SP2"].errors) == 1
    assert got["AHU1"].success and len(got["AHU1"].errors) == 1
    skip = L.sequence(L.string("abc", L.IDENTIFIER), L.maybe(L.string("def", L.IDENTIFIER)), L.rest(L.IDENTIFIER))
    got = parse(spark, skip, "abcjkl", "abcdefjkl")
    assert [x[0] for x in short(got["abcjkl"])] == ["abc", "jkl"] and [x[0] for x in short(got["abcdefjkl"])] == ["abc", "def", "jkl"]


def test_label_helpers(spark):
    got = parse(spark, L.sequence(L.until(L.string("-", L.DELIMITER), L.IDENTIFIER), L.rest(L.IDENTIFIER)), "ab-c", "-", "xyz")
    assert [x[0] for x in short(got["ab-c"])] == ["ab", "-c"] and not got["xyz"].success and not got["-"].success
    got = parse(spark, L.sequence(L.extend_if_match(L.substring_n(2, L.IDENTIFIER), L.constant_kind("urn:two")), L.constant(L.constant_kind("urn:end"))), "ab", "a")
    assert [(x.kind, x.token) for x in got["ab"].tokens] == [("Identifier", "ab"), ("Constant", "urn:two"), ("Constant", "urn:end")] and got["ab"].success
    assert got["a"].errors == ["Expected 2 characters, got a"]
    df = spark.createDataFrame([("AHU-1",), ("AHU",), ("bad",), ("worse",)], "label string")
    assert {tuple(r) for r in L.label_records(df, L.choice(EQUIP, ABBR)).collect()} == {("AHU-1", "1", "urn:AHU"), ("AHU", "AHU", "urn:AHU")}
    twice = L.parse(df, L.as_identifier(ABBR)).where("label = 'AHU'").first()
    assert [(x.kind, x.length) for x in twice.tokens] == [("Constant", 3), ("Identifier", 0)]
    at = L.parse(df, EQUIP).select("label", L.error_offsets(F.col("tokens")).alias("at")).collect()
    assert {r.label: r["at"] for r in at}["AHU"] == [3]
    again = L.from_json(L.choice(EQUIP, L.many(L.maybe(ABBR))).to_json())
    assert json.loads(again.to_json()) == json.loads(L.choice(EQUIP, L.many(L.maybe(ABBR))).to_json())
    assert parse(spark, again, "FCU-7")["FCU-7"].success
    with pytest.raises(TypeError):
        L.from_json("[]")
    with pytest.raises(NameError):
        L.from_json('{"parser": "eval", "args": {}}')


def test_iri_helper():
    assert iri("urn:x") == "<urn:x>"


def test_expressions(spark):
    rows = [('"01"^^<http://www.w3.org/2001/XMLSchema#integer>', '"1.0"^^<http://www.w3.org/2001/XMLSchema#decimal>'), ('"a b"@en-GB', '"b"'), ("<urn:x>", "_:b")]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(X.equal(a, b), X.same_term(a, b), X.lang_matches(a, "en"), X.ucase(a), X.strafter(a, F.lit('"a "')), X.strbefore(a, F.lit('"z"')), X.is_numeric(a), X.concat(a, b), X.str_lang(b, "de"), X.first_bound(X.concat(a), b)).collect()
    assert tuple(got[0])[:3] == (True, False, False) and got[0][6] is True
    assert tuple(got[1]) == (False, False, True, '"A B"@en-GB', '"b"@en-GB', '""', False, '"a bb"', '"b"@de', '"a b"')
    assert got[2][0] is False and got[2][3] is None and got[2][9] == "_:b"


def test_literals_round_trip(spark):
    texts = ["a\\nb", 'q"q', "line\nbreak\r\t", "\\", "\\\\n", "", "é"]
    df = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("l", terms.literal_col(F.col("t")))
    for r in df.withColumn("back", terms.lexical(F.col("l"))).collect():
        assert r.back == r.t and terms.text_of(r.l) == r.t and terms.text_of(literal(r.t)) == r.t


def test_rules_of_a_shapes_graph(spark):
    text = HEAD + """e:S a sh:NodeShape ; sh:targetClass e:Base ; sh:rule [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate e:seen ; sh:object e:yes ; sh:condition [ sh:class e:Top ] ] ."""
    rules = infer.rules_of(ShapeGraph(turtle.read(text)))
    g = frame(spark, "e:a a e:Base . e:b a e:Base, e:Top . e:c a e:Sub . e:Sub rdfs:subClassOf e:Base, e:Top .")
    made = {r.s for r in infer.fixpoint(g, rules).where(F.col("p") == f"<{E}seen>").collect()}
    assert made == {f"<{E}b>", f"<{E}c>"}
    with pytest.warns(UserWarning, match="not read"):
        assert infer.rules_of(ShapeGraph(turtle.read(HEAD + "e:S a sh:NodeShape ; sh:rule [ a sh:JSRule ] ."))) == []


def test_rounds_that_are_not_enough_are_an_error(spark):
    g = frame(spark, " ".join(f"e:n{k} e:next e:n{k + 1} ." for k in range(12)))
    longer = infer.construct_rule([("?a", f"<{E}next>", "?b"), ("?b", f"<{E}next>", "?c")], ("?a", f"<{E}next>", "?c"))
    with pytest.raises(ValueError):
        infer.fixpoint(g, [longer], limit=1)
    assert infer.fixpoint(g, [longer], limit=None).count() == 78
    assert infer.fixpoint(g, [longer], limit=1, partial=True).count() == 12 + 11


def test_delimiters_take_a_blank(spark):
    d = spark.createDataFrame([("Lamp 7",), ("Lamp-7",), ("Lamp7",), ("Lamp#7",)], "label string")
    p = L.named({"Lamp": f"{E}Lamp"})
    assert [r.success for r in L.parse(d, p).collect()] == [True, True, True, False]


def test_large_templates_match_in_part(spark):
    """A case with 14 shelves, three of which are there; no limit on the template's size."""
    t = Template("case", tuple((param("name"), f"<{E}shelf{k}>", param(f"s{k}")) for k in range(14)))
    g = frame(spark, "e:c e:shelf3 e:x ; e:shelf7 e:y ; e:shelf9 e:z .")
    m = match.Matcher(t, g, g, check_predicates=True)
    nodes, rows = m.best()
    assert nodes == [param(n) for n in ("name", "s3", "s7", "s9")] and rows.count() == 1
    assert m.remaining(nodes, rows.first().asDict()).parameters == {f"s{k}" for k in range(14) if k not in (3, 7, 9)}
    assert [len(nodes) for nodes, _ in m.all()] == [4, 3, 3, 3, 2, 2, 2]
    # two edges that clash only together: no node stands for both ends
    pair = Template("pair", ((param("a"), f"<{E}shelf3>", param("b")), (param("a"), f"<{E}shelf7>", param("b"))))
    assert match.Matcher(pair, g, g, check_predicates=True).best() is None
    one = match.Matcher(Template("two", ((param("a"), f"<{E}above>", param("a")),)), g, g)
    assert one.best() is None  # a part has two nodes at least


def test_repairs_as_templates(spark):
    text = """e:k1 a e:Kitchen . e:k2 a e:Kitchen ; e:has e:o . e:o a e:Oven .
e:S a sh:NodeShape ; sh:targetClass e:Kitchen ; sh:class e:Room ;
  sh:property [ sh:path e:has ; sh:qualifiedValueShape [ sh:class e:Oven ] ; sh:qualifiedMinCount 1 ] ;
  sh:property [ sh:path e:door ; sh:qualifiedValueShape [ sh:node e:DoorShape ] ; sh:qualifiedMinCount 2 ] .
e:DoorShape sh:class e:Door ; sh:property [ sh:path e:lock ; sh:minCount 1 ] ."""
    _, diff = run(spark, text)
    door = Template(f"{E}DoorShape", ((param("name"), A, f"<{E}Door>"), (param("name"), f"<{E}lock>", param("lock"))))
    paths = {"e:has": f"<{E}has>", "e:door": f"<{E}door>"}
    made, needs = validate.repair_templates(diff, paths, lambda _, name: door if name == door.name else None)
    by = {r.focus: [made[t] for t in r.templates] for r in needs.collect()}
    assert set(by) == {f"<{E}k1>", f"<{E}k2>"} and [len(by[f"<{E}k{k}>"]) for k in (1, 2)] == [3, 2]
    whole = validate.merged(by[f"<{E}k1>"])
    assert len(whole.parameters) == 1 + 1 + 2 * 2  # the focus, an oven, two doors with locks
    fixed = frame(spark, text).unionByName(validate.repaired(made, needs, E))
    assert validate.conforms(validate.Validator(fixed, PREFIXES).report(ShapeGraph(turtle.read(HEAD + text)).shapes()))
    none, foci = validate.repair_templates(diff, {}, lambda _, name: None)
    assert len(none) == 1 and {t for r in foci.collect() for t in r.templates} == set(none)  # the class alone
    assert validate.repaired({}, foci.limit(0), E).count() == 0


def test_terms_made_and_added_up(spark):
    rows = [("a", '"1"^^<http://www.w3.org/2001/XMLSchema#integer>'), ("a", '"2.5"^^<http://www.w3.org/2001/XMLSchema#decimal>'), ("b", '"x"'), ("b", None), ("c", None)]
    t = F.col("t")
    got = {r.k: tuple(r)[1:] for r in spark.createDataFrame(rows, "k string, t string").groupBy("k").agg(X.total(t), X.average(t), X.sample(t), X.group_concat(t, "|")).collect()}
    assert got == {"a": (3.5, 1.75, rows[0][1], '"1|2.5"'), "b": (None, None, '"x"', '"x"'), "c": (0.0, 0.0, None, '""')}
    df = spark.createDataFrame([("<urn:a>", '"2024-02-29T23:58:07.5+02:00"'), ('"b c"', '"2024-02-29T23:58:07Z"'), ('"d"', '"soon"')], "a string, t string")
    got = [tuple(r) for r in df.select(X.to_iri(F.col("a"), E), X.minutes(t), X.seconds(t).cast("double"), X.tz(t)).collect()]
    assert got == [("<urn:a>", 58, 7.5, '"+02:00"'), (None, 58, 7.0, '"Z"'), (f"<{E}d>", None, None, None)]
    assert df.select(X.bnode(F.lit(1)).alias("b")).distinct().count() == 1 and df.select(X.bnode(F.col("a")).alias("b")).distinct().count() == 3
    assert df.select(X.tz(X.now()).alias("z")).first().z == '"Z"'


def test_shapes_by_domain(spark):
    g = frame(spark, 'e:light e:covers e:power . e:power e:covers e:light, e:wire . e:s1 e:of e:light ; rdfs:label "one" . e:s2 e:of e:power . e:s3 e:of e:wire . e:s1 a e:Kind .')
    from graphloom.operators import extract

    of = lambda d: {tuple(r) for r in extract.shapes_of_domain(g, f"<{E}{d}>", f"<{E}of>", f"<{E}covers>").collect()}
    assert of("wire") == {(f"<{E}s1>", "one"), (f"<{E}s2>", None), (f"<{E}s3>", None)} and of("power") == {(f"<{E}s1>", "one"), (f"<{E}s2>", None)}
    assert of("none") == set()
    assert [tuple(r) for r in extract.listing(g, [f"<{E}Kind>"]).collect()] == [(f"<{E}Kind>", f"<{E}s1>", "one")]


def test_shuffles_widen_with_the_rows_read(spark, tmp_path, monkeypatch):
    """A fixed number of tasks held ever more rows each; the session's number is raised with the input, never lowered."""
    held = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {k: spark.conf.get(k, None) for k in held}
    monkeypatch.setattr(closure, "TASK_ROWS", 50)
    try:
        spark.conf.set(held[-1], "false")
        part = lambda n, rows: spark.range(rows).selectExpr("'<s' || id || '>' AS s", "'<p>' AS p", f"'<o{n}>' AS o").write.parquet(str(tmp_path / n))
        part("a", 1000), part("b", 500), part("c", 10)
        read = lambda n: spark.read.parquet(str(tmp_path / n))
        g = graph.union(read("a"), read("b"))
        assert (g.rdd.getNumPartitions(), g.count()) == (30, 1500)
        assert graph.union(read("c"), read("c")).count() == 10 and spark.conf.get(held[0]) == "30"
        assert closure.stored(graph.union(read("a"), read("b"))).count() == 1500
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_graphs_of_a_union_are_told_apart_once(spark):
    """A union and what it is made of told the same triples apart, each with a shuffle of its own."""
    from graphloom import queries

    g = queries._orders_and_lines(spark, "/root/testdata/sf0.001")
    plan = g._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
    apart = graph.union(queries.orders(spark, "/root/testdata/sf0.001"), queries.lines(spark, "/root/testdata/sf0.001"))
    assert g.count() == apart.count() and graph.difference(g, apart).isEmpty()


def test_a_matcher_reads_the_graph_once(spark):
    """What may lie under edges and the types were read from the graph apart, so that it was built for each."""
    read = spark.sparkContext.accumulator(0)
    a = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
    rows = [(f"<{E}x{k}>", a, f"<{E}Kind>") for k in range(10)] + [(f"<{E}x{k}>", f"<{E}on>", f"<{E}y{k}>") for k in range(10)]
    g = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(lambda r: read.add(1) or r), "s string, p string, o string")
    t = Template("t", ((terms.param("x"), a, f"<{E}Kind>"), (terms.param("x"), f"<{E}on>", terms.param("y"))))
    m = match.Matcher(t, g, frame(spark, "e:Kind rdfs:subClassOf e:Top ."), check_predicates=True)
    assert read.value == len(rows)
    assert m.best()[1].count() == 10


def _results(report) -> list:
    return sorted(map(str, report.select("focus", "path", "value", "source_shape", "component").collect()))


def _counted() -> tuple:
    """A shape whose parts are counts, classes, alternatives and a bound that one more triple may break."""
    t = lambda n: f"<{E}{n}>"
    kind = Shape(t("kind"), constraints=(("class", t("Good")),))
    first = Shape(t("first"), constraints=(("property", Shape(t("first-p"), path=t("p"), constraints=(("minCount", 2), ("class", t("Good"))))),))
    second = Shape(t("second"), constraints=(("property", Shape(t("second-p"), path=t("q"), constraints=(("qualified", (kind, 1, 2)),))), ("class", t("Fine"))))
    few = Shape(t("few"), path=t("p"), constraints=(("maxCount", 2), ("class", t("Good")), ("class", t("Fine"))))
    return t, Shape(t("s"), targets=(("class", t("T")),), constraints=(("or", (first, second)), ("property", few)))


def test_a_graph_with_triples_twice_gives_the_same_report(spark):
    """Validators told triples apart before they told apart what they read of them; a bag is read as the set that it is."""
    t, shape = _counted()
    rows = [(t("a"), terms.A, t("T")), (t("b"), terms.A, t("T")), (t("c"), terms.A, t("T")), (t("a"), t("p"), t("x")), (t("a"), t("p"), t("y")), (t("b"), t("p"), t("x")), (t("c"), t("q"), t("x")), (t("x"), terms.A, t("Good")), (t("y"), terms.A, t("Better")), (t("Better"), terms.SUBCLASS, t("Good"))]
    once = spark.createDataFrame(rows, "s string, p string, o string")
    twice = graph.bag(once, once)
    assert twice.count() == 2 * len(rows)
    equal = Shape(t("e"), targets=(("class", t("T")),), constraints=(("property", Shape(t("e-p"), path=t("p"), constraints=(("equals", t("q")),))),))
    closed = Shape(t("d"), targets=(("class", t("T")),), constraints=(("closed", (terms.A, t("q"))),))
    for shapes in ([shape, equal], [closed]):
        assert _results(validate.Validator(twice, bag=True).report(shapes)) == _results(validate.Validator(once).report(shapes)) != []


def test_a_report_after_more_triples_checks_what_they_touch(spark):
    """The whole graph was validated again; results of foci that the new triples don't touch now stand as they are."""
    t, shape = _counted()
    kinds = [(t(x), terms.A, t("T")) for x in "abcdef"] + [(t("x"), terms.A, t("Good")), (t("y"), terms.A, t("Good"))]
    rows = [*kinds, (t("a"), t("p"), t("x")), (t("b"), t("p"), t("x")), (t("b"), t("p"), t("y")), (t("c"), t("q"), t("z")), (t("d"), t("p"), t("w")), (t("e"), terms.A, t("Fine"))]
    more = [(t("a"), t("p"), t("y")), (t("b"), t("p"), t("v")), (t("z"), terms.A, t("Good")), (t("c"), terms.A, t("Fine")), (t("w"), terms.A, t("Fine")), (t("g"), terms.A, t("T")), (t("b"), t("p"), t("x"))]
    make = lambda r: spark.createDataFrame(r, "s string, p string, o string")
    v = validate.Validator(make(rows))
    before = closure.cut(v.report([shape]))
    marked = lambda r: r.withColumn("component", F.when(F.col("focus") == t("f"), "as it was").otherwise(F.col("component")))
    whole = validate.Validator(graph.union(make(rows), make(more))).report([shape])
    found = _results(infer.revalidate(v, shape, marked(before), make(more)))
    assert found == _results(marked(whole)) and any("as it was" in r for r in found)


def test_counts_are_taken_where_values_lie_by_focus(spark):
    """Values that were joined by value to tell their classes were brought back to their foci to be counted."""
    t, _ = _counted()
    g = spark.createDataFrame([(t("a"), terms.A, t("T")), (t("a"), t("p"), t("x"))], "s string, p string, o string")
    shape = lambda *c: Shape(t("s"), targets=(("class", t("T")),), constraints=(("property", Shape(t("n"), path=t("p"), constraints=c)),))
    joins = lambda *c: validate.Validator(g).report([shape(*c)])._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(("minCount", 2), ("class", t("Good"))) == joins(("minCount", 2)) + joins(("class", t("Good")))
