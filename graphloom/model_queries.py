"""Queries of models, libraries, named graphs and scans over the standard tables, each with the SQL that says the same."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Engine
from .functions import labels as L
from .operators import algebra, closure, extract, graph, match, validate
from .plans.shapes import Shape
from .plans.template import NETWORK, Builder, Template
from .queries import BRAND, CONTAINS, CUSTOMER, IN_NATION, ORDER, PLACED_BY, PREFIXES, PRIORITY, STATUS, U, _FINISHED, _RDF, _RULES, _URGENT, _bag, _logic, _report, customers, lines, orders, parts, query, ref, said, table
from .sources import network, ntriples, records, turtle
from .sources.snapshots import GraphTable
from .terms import A, iri, literal, literal_col, param, plain


def _place(df: DataFrame, name: str) -> str:
    """A new folder among those that executors share."""
    return f"{closure.shared_folder(df)}/{name}-{uuid.uuid4().hex}"


# --- scans and builders


@query(f"""SELECT DISTINCT '{U}part_' || l_partkey || '-' || l_linenumber AS point, l_returnflag || ',' || l_linenumber AS identifier,
'{U}' || replace(s_name, '#', '_') AS device, replace(s_name, '#', ' ') AS instance FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
def network_graph(spark, d):
    """Suppliers as devices and their parts as points of a network scan; read back over the references between them."""
    s = table(spark, d, "supplier").select("s_suppkey", F.translate("s_name", "#", " ").alias("device_id"), F.concat(F.lit("n"), "s_nationkey").alias("address"))
    li = table(spark, d, "lineitem").select("l_suppkey", F.concat(F.lit("part "), "l_partkey").alias("name"), F.col("l_linenumber").cast("string").alias("address"), F.col("l_returnflag").alias("type")).distinct()
    points = li.join(s.select("s_suppkey", "device_id"), F.col("l_suppkey") == F.col("s_suppkey")).select("name", "address", "type", "device_id")
    scan = records.as_records(s.select("device_id", "address"), "Device").unionByName(records.as_records(points, "Object"))
    g = network.graph(scan, U)
    rows = algebra.bgp(
        g, ("?point", f"<{network.REFERENCE}hasExternalReference>", "?r"), ("?r", f"<{NETWORK}object-identifier>", "?identifier"), ("?r", f"<{NETWORK}objectOf>", "?device"), ("?device", f"<{NETWORK}device-instance>", "?instance")
    )
    return said(rows.select("point", "identifier", "device", "instance"))


_DESK, _SEAT = iri(f"{U}Desk"), iri(f"{U}Seat")


@query(f"""WITH x AS (SELECT '{U}name_' || md5(c_custkey || chr(31) || 'call 0' || chr(31) || 'name') AS desk, '{U}name_' || md5(c_custkey || chr(31) || 'call 1' || chr(31) || 'name') AS seat,
'{U}customer/' || c_custkey AS customer, '{U}nation/' || c_nationkey AS nation FROM customer)
SELECT desk AS s, '{_RDF}type' AS p, '{U}Desk' AS o FROM x UNION ALL SELECT desk, '{U}inNation', nation FROM x UNION ALL SELECT desk, 'http://www.w3.org/2000/01/rdf-schema#label', 'Desk' FROM x
UNION ALL SELECT seat, '{_RDF}type', '{U}Seat' FROM x UNION ALL SELECT seat, '{U}at', desk FROM x UNION ALL SELECT seat, '{U}for', customer FROM x UNION ALL SELECT seat, 'http://www.w3.org/2000/01/rdf-schema#label', 'Seat' FROM x""")
def builder_linked_rows(spark, d):
    """A desk for every customer and a seat at it: the desks' minted names are bound in the second call."""
    b = Builder(spark, U)
    c = table(spark, d, "customer").select("c_custkey", ref("customer", "c_custkey").alias("customer"), ref("nation", "c_nationkey").alias("nation"))
    desks = b.add_rows(Template("desk", ((param("name"), A, _DESK), (param("name"), IN_NATION, param("nation")))), c, F.col("c_custkey"))
    seat = Template("seat", ((param("name"), A, _SEAT), (param("name"), iri(f"{U}at"), param("desk")), (param("name"), iri(f"{U}for"), param("customer"))))
    b.add_rows(seat, desks.select("c_custkey", "customer", F.col("name").alias("desk")), F.col("c_custkey"))
    return said(b.compile())


# --- named graphs and their texts


@query("""WITH n AS (SELECT count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus <> 'F') AS op FROM orders)
SELECT 1 AS version, 'done' AS graph, 4 * f AS triples FROM n UNION ALL SELECT 1, 'open', 4 * o FROM n UNION ALL SELECT 2, 'open', 4 * op FROM n
UNION ALL SELECT 3, 'done', 4 * f FROM n UNION ALL SELECT 3, 'open', 4 * o FROM n""")
def named_graph_versions(spark, d):
    """Two named graphs of orders; one grows by what it has in part already, the other goes; then the first state again."""
    g = orders(spark, d)
    at = lambda *status: g.join(g.where((F.col("p") == STATUS) & F.col("o").isin(*map(literal, status))).select("s"), "s", "left_semi")
    t = GraphTable(spark, _place(g, "orders"))
    with t.transaction() as change:
        change.append("open", at("O"))
        change.append("done", at("F"))
    with t.transaction() as change:
        change.append("open", at("O", "P"))
        change.delete("done")
    t.restore(1)
    parts_of = [t.load(name, v).agg(F.count(F.lit(1)).alias("triples")).select(F.lit(v).alias("version"), F.lit(name).alias("graph"), "triples") for v in t.versions() for name in t.graph_ids(v)]
    return reduce(DataFrame.unionByName, parts_of)


@query("""SELECT 'urn:tpch/part/' || p_partkey AS s, p_brand || ' "' || p_name || '" \\' || chr(10) || p_type || ' .' AS o FROM part""")
def ntriples_roundtrip(spark, d):
    """Texts with quotes, backslashes, line ends and full stops, written as lines and read again."""
    p = table(spark, d, "part")
    text = F.concat("p_brand", F.lit(' "'), "p_name", F.lit('" \\\n'), "p_type", F.lit(" ."))
    g = p.select(ref("part", "p_partkey").alias("s"), F.lit(BRAND).alias("p"), literal_col(text).alias("o"))
    path = _place(g, "text")
    ntriples.write(g, path)
    return said(ntriples.read(spark, path)).select("s", "o")


# --- templates and shapes


@query(f"""SELECT '{U}order/' || o_orderkey AS focus, 'HasValueConstraintComponent' AS component FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT '{U}order/' || o_orderkey, 'ClassConstraintComponent' FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey >= 20""")
def shape_of_template(spark, d):
    """The shape of what a template makes, on orders some of which it could not have made."""
    t = Template("finished", ((param("name"), A, ORDER), (param("name"), PLACED_BY, param("who")), (param("who"), A, CUSTOMER), (param("name"), STATUS, literal("F"))))
    g = orders(spark, d, True)
    known = customers(spark, d, True)
    known = known.join(known.where((F.col("p") == IN_NATION) & (F.regexp_extract("o", "([0-9]+)>$", 1).cast("int") < 20)).select("s"), "s", "left_semi")
    shape = Engine(spark, _place(g, "catalog")).template_to_shape(t)
    return validate.Validator(graph.bag(g, known), PREFIXES, bag=True).report([shape]).select(plain(F.col("focus")).alias("focus"), "component")


_CLASSES = f"""
@prefix t: <{U}> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
<{U}shop> a owl:Ontology .
t:Order a owl:Class, sh:NodeShape ; rdfs:subClassOf t:Document ;
  sh:property [ sh:path t:placedBy ; sh:class t:Customer ; sh:minCount 1 ; sh:name "customer" ] ;
  sh:property [ sh:path t:status ; sh:hasValue "F" ] .
"""


@query(f"""WITH x AS (SELECT '{U}order/' || o_orderkey AS s, '{U}customer/' || o_custkey AS c FROM orders WHERE o_orderstatus = 'F')
SELECT s, '{_RDF}type' AS p, '{U}Order' AS o FROM x UNION SELECT s, '{U}placedBy', c FROM x UNION SELECT c, '{_RDF}type', '{U}Customer' FROM x UNION SELECT s, '{U}status', 'F' FROM x""")
def template_of_shape(spark, d):
    """A library's class that is a shape gives a template; finished orders go through it."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(ref("order", "o_orderkey").alias("name"), ref("customer", "o_custkey").alias("customer"))
    e = Engine(spark, _place(o, "catalog"))
    lib = e.load_ontology(turtle.read(_CLASSES), infer_templates=True)
    return said(e.template(lib.name, f"{U}Order").graph(o))


# --- models


@query(f"""WITH n AS (SELECT count(*) AS n, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS u, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F') AS uf FROM orders)
SELECT '{_RDF}type' AS p, n + u + 1 AS n FROM n UNION ALL SELECT '{U}placedBy', n FROM n UNION ALL SELECT '{U}status', n FROM n UNION ALL SELECT '{U}priority', n FROM n
UNION ALL SELECT '{U}level', u FROM n UNION ALL SELECT '{U}handles', uf FROM n""")
def compiled_model(spark, d):
    """A model of the orders, compiled with a shapes graph that has rules: its triples by predicate."""
    g = orders(spark, d)
    e = Engine(spark, _place(g, "catalog"))
    m = e.create_model("urn:model/orders")
    e.add(m, g)
    return e.compile(m, turtle.read(_RULES)).groupBy(plain(F.col("p")).alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT '{U}order/' || o_orderkey AS name, '{U}customer/' || o_custkey AS who FROM orders")
def match_library_ontology(spark, d):
    """A template of documents meets orders through the library's own classes, none being given."""
    g = orders(spark, d).where(F.col("p").isin(A, PLACED_BY))
    e = Engine(spark, _place(g, "catalog"))
    lib = e.load_ontology(turtle.read(_CLASSES))
    m = e.create_model("urn:model/orders")
    e.add(m, g)
    matcher = e.matcher(m, Template("document", ((param("name"), A, iri(f"{U}Document")), (param("name"), PLACED_BY, param("who")))), lib.name, check_predicates=True)
    _, rows = matcher.best()
    return rows.select(*[plain(F.col(f"n{matcher.nodes.index(param(p))}")).alias(p) for p in ("name", "who")])


@query(f"""WITH x AS (SELECT '{U}order/' || o_orderkey AS s, '{U}clerk_' || md5('<{U}order/' || o_orderkey || '>' || chr(31) || '<{U}customer/' || o_custkey || '>' || chr(31) || 'clerk') AS clerk FROM orders WHERE o_orderstatus = 'F')
SELECT s, '{U}handledBy' AS p, clerk AS o FROM x UNION ALL SELECT clerk, '{_RDF}type', '{U}Clerk' FROM x""")
def match_completed(spark, d):
    """What finished orders lack of a template that they match in part, for all of them at once."""
    g = orders(spark, d).where(F.col("p").isin(PLACED_BY, STATUS))
    body = ((param("name"), STATUS, literal("F")), (param("name"), PLACED_BY, param("who")), (param("name"), iri(f"{U}handledBy"), param("clerk")), (param("clerk"), A, iri(f"{U}Clerk")))
    m = match.Matcher(Template("handled", body), g, spark.createDataFrame([], "s string, p string, o string"), check_predicates=True)
    nodes, rows = m.best()
    return said(m.completed(nodes, rows, U))


# --- shapes read and reported


@query(f"SELECT DISTINCT '{U}order/' || o_orderkey AS target, o_orderstatus AS status, o_orderpriority AS priority FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def shape_to_df_class_and_node(spark, d):
    """A class and a node shape on the shape itself: lines of orders that have no class, since they are not urgent, are left out."""
    g = orders(spark, d)
    urgent = g.where((F.col("p") == PRIORITY) & F.col("o").isin(literal("1-URGENT"), literal("2-HIGH"))).select("s")
    g = g.where(F.col("p") != A).unionByName(g.where(F.col("p") == A).join(urgent, "s", "left_semi"))
    inner = Shape(iri(f"{U}status-of"), constraints=(("property", Shape("s", path=STATUS, name="status")),))
    shape = Shape(iri(f"{U}T"), targets=(("subjects", CONTAINS),), constraints=(("class", ORDER), ("node", inner), ("property", Shape("p", path=PRIORITY, name="priority"))))
    return extract.Extractor(graph.union(g, lines(spark, d))).table(shape)


@query(f"""SELECT '{U}branded' AS shapename, count(*) AS n, 1 AS reasons FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#2')""")
def reasons_by_shape(spark, d):
    """How many orders lack what conforms to a shape, and how many reasons there are, by that shape."""
    branded = Shape(iri(f"{U}branded"), constraints=(("property", Shape(iri(f"{U}branded-p"), path=BRAND, constraints=(("hasValue", literal("Brand#2")),))),))
    inner = Shape(iri(f"{U}has-branded"), constraints=(("node", branded),))
    shape = Shape(iri(f"{U}wants-branded"), targets=(("class", ORDER),), constraints=(("property", Shape(iri(f"{U}wants-branded-p"), path=CONTAINS, constraints=(("qualified", (inner, 1, None)),))),))
    report = validate.Validator(_bag(spark, d), PREFIXES, bag=True).report([shape])
    rows = validate.reasons_by_shape(validate.diff(report, [shape], PREFIXES))
    return rows.select(plain(F.col("shapename")).alias("shapename"), "n", F.size("reasons").alias("reasons"))


@query(f"""SELECT '{U}order/' || o_orderkey AS focus, NULL::VARCHAR AS value, 'HasValueConstraintComponent' AS component FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT '{U}order/' || o_orderkey, o_orderpriority, 'InConstraintComponent' FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""")
def logic_and_flattened(spark, d):
    """In a report the members of an ``and``, and of a node shape, are constraints of the shape itself."""
    shape = _logic(("and", (_FINISHED, Shape(iri(f"{U}through"), constraints=(("node", _URGENT),)))))
    return _report(spark, d, shape, orders(spark, d))


# --- labels


@query(f"SELECT replace(c_name, '#', '-') AS label, split_part(c_name, '#', 2) AS identifier, '{U}Customer' AS type FROM customer UNION SELECT replace(s_name, '#', '_'), split_part(s_name, '#', 2), '{U}Supplier' FROM supplier")
def label_prebuilt_from_json(spark, d):
    """The prebuilt parser of names, said as JSON and read from it, over all names."""
    parser = L.from_json(L.named({"Customer": f"{U}Customer", "Supplier": f"{U}Supplier"}).to_json())
    c = table(spark, d, "customer").select(F.translate("c_name", "#", "-").alias("label"))
    return L.label_records(c.unionByName(table(spark, d, "supplier").select(F.translate("s_name", "#", "_").alias("label"))), parser)
