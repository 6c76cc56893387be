"""Queries over the standard tables, read as records of a graph, each with the SQL that says the same."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expressions as X
from .functions import labels as L
from .operators import algebra, closure, encoding, extract, graph, infer, match, validate
from .plans.shapes import Shape, ShapeGraph, all_of, any_of, negation, one_of, sh
from .plans.template import Dependency, Template, bindings_from_json, choose, ingest, label_untitled
from .sources import records, turtle
from .terms import A, LABEL, SUBCLASS, XSD, datatype, iri, iri_col, is_iri, lexical, literal, literal_col, number, param, plain

U = "urn:tpch/"
PREFIXES = {"t": U}
CUSTOMER, ORDER, PART, NATION, SUPPLIER = (iri(f"{U}{c}") for c in ("Customer", "Order", "Part", "Nation", "Supplier"))
IN_NATION, SEGMENT, BALANCE, PLACED_BY, CONTAINS, STATUS, PRIORITY, BRAND, SIZE, IN_REGION = (iri(f"{U}{p}") for p in ("inNation", "segment", "acctbal", "placedBy", "containsPart", "status", "priority", "brand", "size", "inRegion"))

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return put


# --- tables as graphs


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ref(kind: str, key: str):
    """The IRI of a row."""
    return iri_col(F.concat(F.lit(f"{U}{kind}/"), F.col(key).cast("string")))


T_CUSTOMER = Template("customer", ((param("name"), A, CUSTOMER), (param("name"), IN_NATION, param("nation")), (param("name"), SEGMENT, param("segment"))), frozenset({"segment"}))


def customer_bindings(spark, d):
    c = table(spark, d, "customer")
    building = F.col("c_mktsegment") == "BUILDING"
    return c.select(ref("customer", "c_custkey").alias("name"), ref("nation", "c_nationkey").alias("nation"), F.when(~building, literal_col(F.col("c_mktsegment"))).alias("segment"))


def customers(spark, d, bag=False):
    return T_CUSTOMER.graph(customer_bindings(spark, d), bag=bag)


T_ORDER = Template("order", ((param("name"), A, ORDER), (param("name"), PLACED_BY, param("customer")), (param("name"), STATUS, param("status")), (param("name"), PRIORITY, param("priority"))))


def orders(spark, d, bag=False):
    o = table(spark, d, "orders")
    return T_ORDER.graph(o.select(ref("order", "o_orderkey").alias("name"), ref("customer", "o_custkey").alias("customer"), literal_col(F.col("o_orderstatus")).alias("status"), literal_col(F.col("o_orderpriority")).alias("priority")), bag=bag)


T_LINE = Template("line", ((param("name"), CONTAINS, param("part")),))


def lines(spark, d, bag=False):
    li = table(spark, d, "lineitem")
    return T_LINE.graph(li.select(ref("order", "l_orderkey").alias("name"), ref("part", "l_partkey").alias("part")), bag=bag)


T_PART = Template("part", ((param("name"), A, param("kind")), (param("name"), BRAND, param("brand")), (param("name"), SIZE, param("size"))))


def parts(spark, d):
    """Parts, typed by their p_type, which are subclasses of Part."""
    p = table(spark, d, "part")
    g = T_PART.graph(p.select(ref("part", "p_partkey").alias("name"), iri_col(F.concat(F.lit(U), "p_type")).alias("kind"), literal_col(F.col("p_brand")).alias("brand"), literal_col(F.col("p_size"), f"{XSD}integer").alias("size")), bag=True)
    kinds = p.select(iri_col(F.concat(F.lit(U), "p_type")).alias("s"), F.lit(SUBCLASS).alias("p"), F.lit(PART).alias("o"))
    return graph.union(g, kinds)


def places(spark, d):
    """nation under region under World."""
    n = table(spark, d, "nation").select(ref("nation", "n_nationkey").alias("s"), F.lit(SUBCLASS).alias("p"), ref("region", "n_regionkey").alias("o"))
    r = table(spark, d, "region").select(ref("region", "r_regionkey").alias("s"), F.lit(SUBCLASS).alias("p"), F.lit(iri(f"{U}World")).alias("o"))
    return n.unionByName(r)


def residents(spark, d):
    """Customers as instances of their nation."""
    return table(spark, d, "customer").select(ref("customer", "c_custkey").alias("s"), F.lit(A).alias("p"), ref("nation", "c_nationkey").alias("o"))


def said(g: DataFrame) -> DataFrame:
    return g.select(*[plain(F.col(c)).alias(c) for c in g.columns])


_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_C = f"""customers AS (
  SELECT '{U}customer/' || c_custkey AS s, '{_RDF}type' AS p, '{U}Customer' AS o FROM customer
  UNION SELECT '{U}customer/' || c_custkey, '{U}inNation', '{U}nation/' || c_nationkey FROM customer
  UNION SELECT '{U}customer/' || c_custkey, '{U}segment', c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING')"""
_O = f"""orders_g AS (
  SELECT '{U}order/' || o_orderkey AS s, '{_RDF}type' AS p, '{U}Order' AS o FROM orders
  UNION SELECT '{U}order/' || o_orderkey, '{U}placedBy', '{U}customer/' || o_custkey FROM orders
  UNION SELECT '{U}order/' || o_orderkey, '{U}status', o_orderstatus FROM orders
  UNION SELECT '{U}order/' || o_orderkey, '{U}priority', o_orderpriority FROM orders)"""

# --- templates


@query(f"WITH {_C} SELECT * FROM customers")
def triples_from_template(spark, d):
    return said(customers(spark, d))


@query(f"WITH {_C} SELECT * FROM customers WHERE s NOT IN (SELECT '{U}customer/' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def template_require_optional(spark, d):
    return said(T_CUSTOMER.graph(customer_bindings(spark, d), require_optional=True))


@query(f"WITH {_C}, {_O} SELECT s, p, o FROM orders_g UNION SELECT s, p, o FROM customers WHERE s IN (SELECT '{U}customer/' || o_custkey FROM orders)")
def template_inline_dependency(spark, d):
    known = {"customer": T_CUSTOMER}
    t = Template("order", T_ORDER.body, frozenset(), (Dependency("customer", {"name": "customer"}),), lambda _, n: known.get(n))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", literal_col(F.col("o_orderstatus")).alias("status"), literal_col(F.col("o_orderpriority")).alias("priority"))
    c = customer_bindings(spark, d).select(F.col("name").alias("customer"), F.col("nation").alias("customer-nation"), F.col("segment").alias("customer-segment"))
    b = o.withColumn("customer", ref("customer", "o_custkey")).withColumn("name", ref("order", "o_orderkey")).join(c, "customer")
    return said(t.inline().graph(b))


@query(f"SELECT '{U}customer/' || c_custkey AS name, '{U}nation_' || md5(c_custkey::VARCHAR || chr(31) || 'nation') AS nation FROM customer")
def template_fill_minted(spark, d):
    c = table(spark, d, "customer")
    return said(T_CUSTOMER.fill(c.select(ref("customer", "c_custkey").alias("name"), "c_custkey"), U, F.col("c_custkey")).select("name", "nation"))


@query(f"""SELECT '{U}event/' || event_id AS s, '{_RDF}type' AS p, CASE event_type WHEN 'purchase' THEN '{U}Purchase' ELSE '{U}Other' END AS o FROM events WHERE event_type <> 'error'
UNION SELECT '{U}event/' || event_id, '{U}by', '{U}user/' || user_id FROM events WHERE event_type = 'purchase'""")
def ingress_chooser(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("event/"), "event_id").alias("name"), F.concat(F.lit("user/"), "user_id").alias("user"), "event_type")
    buy = Template("buy", ((param("name"), A, iri(f"{U}Purchase")), (param("name"), iri(f"{U}by"), param("user"))))
    other = Template("other", ((param("name"), A, iri(f"{U}Other")),))
    route = F.when(F.col("event_type") == "purchase", "buy").when(F.col("event_type") != "error", "other")
    return said(choose(e, route, {"buy": buy, "other": other}, U, F.col("name")))


@query(f"""SELECT p_partkey, CASE WHEN contains(p_name, ' ') OR contains(p_name, '"') THEN p_name ELSE '{U}' || p_name END AS term, contains(p_name, ' ') AS is_literal FROM part""")
def term_coercion(spark, d):
    from .terms import term_of

    t = term_of(F.col("p_name"), U)
    return table(spark, d, "part").select("p_partkey", plain(t).alias("term"), (~is_iri(t)).alias("is_literal"))


@query(f"""SELECT '{U}supplier/' || s_suppkey AS s, '{_RDF}type' AS p, '{U}Supplier' AS o FROM supplier
UNION SELECT '{U}supplier/' || s_suppkey, '{U}inNation', '{U}nation/' || s_nationkey FROM supplier
UNION SELECT '{U}supplier/' || s_suppkey, 'http://www.w3.org/2000/01/rdf-schema#label', 'Supplier' FROM supplier""")
def ingress_with_labels(spark, d):
    t = Template("supplier", ((param("name"), A, SUPPLIER), (param("name"), IN_NATION, param("nation"))))
    r = table(spark, d, "supplier").select(F.concat(F.lit("supplier/"), "s_suppkey").alias("name"), F.concat(F.lit("nation/"), "s_nationkey").alias("nation"))
    return said(label_untitled(ingest(t, r, U)))


@query(f"SELECT event_id, '{U}event/' || event_id AS name, json_extract_string(props, '$.k') AS k FROM events")
def bindings_json(spark, d):
    e = table(spark, d, "events")
    j = e.select("event_id", F.to_json(F.struct(F.struct(F.concat(F.lit("event/"), "event_id").alias("@id")).alias("name"), F.struct(F.get_json_object("props", "$.k").alias("@literal"), F.lit(f"{XSD}integer").alias("@datatype")).alias("k"))).alias("j"))
    return bindings_from_json(j, "j", ["name", "k"], U.rstrip("/")).select("event_id", plain(F.col("name")).alias("name"), lexical(F.col("k")).alias("k"))


@query("SELECT event_id::VARCHAR AS id, json_extract_string(props, '$.k') AS k, event_type FROM events")
def record_json_roundtrip(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    r = records.to_json(records.as_records(e, "event")).select(F.from_json("value", "rtype string, fields map<string,string>").alias("r")).select("r.*")
    return records.columns_of(r, "event", ["event_id", "k", "event_type"]).withColumnRenamed("event_id", "id")


# --- graphs as sets


@query(f"WITH {_C}, {_O} SELECT * FROM customers UNION SELECT * FROM orders_g")
def graph_union(spark, d):
    return said(graph.union(customers(spark, d, True), orders(spark, d, True)))


@query(f"WITH {_C} SELECT * FROM customers EXCEPT SELECT * FROM customers WHERE p = '{U}segment'")
def graph_difference(spark, d):
    c = customers(spark, d)
    return said(graph.difference(c, graph.triples(c, p=SEGMENT)))


@query(f"WITH {_C} SELECT * FROM customers WHERE p = '{U}inNation' AND o = '{U}nation/3'")
def graph_intersection(spark, d):
    c = customers(spark, d)
    return said(graph.intersection(c, graph.triples(c, p=IN_NATION, o=iri(f"{U}nation/3"))))


@query(f"""WITH {_C}, m AS (SELECT '{U}nation/' || n_nationkey AS old, '{U}region/' || n_regionkey AS new FROM nation)
SELECT DISTINCT s, p, coalesce(new, o) AS o FROM customers LEFT JOIN m ON o = old""")
def replace_nodes(spark, d):
    m = table(spark, d, "nation").select(ref("nation", "n_nationkey").alias("old"), ref("region", "n_regionkey").alias("new"))
    return said(graph.replace_nodes(customers(spark, d), m))


@query(f"WITH {_C} SELECT * FROM customers WHERE s <> '{U}customer/7' AND o <> '{U}nation/3'")
def remove_triples_with_node(spark, d):
    return said(graph.remove_node(graph.remove_node(customers(spark, d), iri(f"{U}customer/7")), iri(f"{U}nation/3")))


@query("SELECT DISTINCT p_type AS name FROM part UNION SELECT 'made' FROM part")
def parameters_scan(spark, d):
    g = table(spark, d, "part").select(ref("part", "p_partkey").alias("s"), F.lit(param("made")).alias("p"), F.concat(F.lit("<urn:___param___#urn:___param___#"), "p_type", F.lit(">")).alias("o"))
    return graph.parameters(g)


@query(f"WITH {_C}, {_O} SELECT DISTINCT o AS type FROM (SELECT * FROM customers UNION SELECT * FROM orders_g) WHERE p = '{_RDF}type' ORDER BY 1")
def distinct_types_sorted(spark, d):
    return said(graph.types(graph.union(customers(spark, d, True), orders(spark, d, True))))


@query("SELECT p_partkey, p_size::DOUBLE AS value, 'http://www.w3.org/2001/XMLSchema#integer' AS datatype FROM part")
def literal_terms(spark, d):
    t = literal_col(F.col("p_size"), f"{XSD}integer")
    return table(spark, d, "part").select("p_partkey", number(t).alias("value"), datatype(t).alias("datatype"))


# --- solution tables


@query("SELECT o_orderkey::VARCHAR AS o, c_custkey::VARCHAR AS c, c_nationkey::VARCHAR AS n FROM orders JOIN customer ON o_custkey = c_custkey")
def bgp_join(spark, d):
    g = graph.union(customers(spark, d, True), orders(spark, d, True))
    rows = algebra.bgp(g, ("?o", PLACED_BY, "?c"), ("?c", IN_NATION, "?n"))
    return rows.select(*[F.regexp_extract(c, "/([0-9]+)>$", 1).alias(c) for c in rows.columns])


@query(f"SELECT '{U}customer/' || c_custkey AS c, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS seg FROM customer")
def bgp_optional(spark, d):
    g = customers(spark, d)
    return said(algebra.optional(algebra.match(g, ("?c", A, CUSTOMER)), algebra.match(g, ("?c", SEGMENT, "?seg"))))


@query(f"""SELECT '{U}customer/' || c_custkey AS x, c_mktsegment AS seg, NULL::VARCHAR AS prio FROM customer WHERE c_mktsegment <> 'BUILDING'
UNION ALL SELECT '{U}order/' || o_orderkey, NULL, o_orderpriority FROM orders""")
def bgp_union(spark, d):
    return said(algebra.union(algebra.match(customers(spark, d), ("?x", SEGMENT, "?seg")), algebra.match(orders(spark, d), ("?x", PRIORITY, "?prio"))))


@query(f"SELECT '{U}customer/' || c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_not_exists(spark, d):
    g = customers(spark, d)
    return said(algebra.not_exists(algebra.match(g, ("?c", A, CUSTOMER)), algebra.match(g, ("?c", SEGMENT, "?any"))))


@query(f"SELECT '{U}customer/' || c_custkey AS c FROM customer WHERE c_mktsegment <> 'BUILDING'")
def filter_exists_minus(spark, d):
    g = customers(spark, d)
    every = algebra.match(g, ("?c", A, CUSTOMER))
    kept = algebra.exists(every, algebra.match(g, ("?c", SEGMENT, "?any")))
    return said(algebra.minus(kept, algebra.match(g, ("?c", iri(f"{U}nothing"), "?any"))))


@query(f"SELECT '{U}nation/' || v.k AS n, v.label AS label, count(*) AS customers FROM customer JOIN (VALUES (1, 'one'), (2, 'two')) v(k, label) ON c_nationkey = v.k GROUP BY ALL")
def bind_values(spark, d):
    v = algebra.values(spark, ["n", "label"], [(iri(f"{U}nation/1"), literal("one")), (iri(f"{U}nation/2"), literal("two"))])
    rows = algebra.join(algebra.match(customers(spark, d), ("?c", IN_NATION, "?n")), v)
    return said(rows.groupBy("n", "label").agg(F.count("c").alias("customers")).select("n", "label", F.col("customers").cast("string"))).withColumn("customers", F.col("customers").cast("bigint"))


@query(f"SELECT '{U}customer/' || o_custkey AS c, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) > 12")
def subselect_having(spark, d):
    return algebra.match(orders(spark, d), ("?o", PLACED_BY, "?c")).groupBy(plain(F.col("c")).alias("c")).agg(F.count_distinct("o").alias("n")).where("n > 12")


@query("SELECT o_orderpriority AS prio, count(*) AS n, min(o_orderkey)::VARCHAR AS least FROM orders GROUP BY 1 ORDER BY n DESC, prio LIMIT 3")
def group_order_limit(spark, d):
    rows = algebra.match(orders(spark, d), ("?o", PRIORITY, "?prio"))
    key = F.regexp_extract("o", "/([0-9]+)>$", 1).cast("bigint")
    return rows.groupBy(lexical(F.col("prio")).alias("prio")).agg(F.count("o").alias("n"), F.min(key).cast("string").alias("least")).orderBy(F.col("n").desc(), "prio").limit(3)


@query(f"SELECT '{U}customer/' || o_custkey AS s, '{U}bought' AS p, '{U}part/' || l_partkey AS o FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def construct_graph(spark, d):
    g = graph.union(orders(spark, d, True), lines(spark, d, True))
    return said(algebra.construct(algebra.bgp(g, ("?o", PLACED_BY, "?c"), ("?o", CONTAINS, "?p")), ("?c", iri(f"{U}bought"), "?p")))


# --- paths


@query(f"SELECT DISTINCT '{U}order/' || o_orderkey AS s, '{U}nation/' || c_nationkey AS o FROM orders JOIN customer ON o_custkey = c_custkey")
def path_sequence(spark, d):
    return said(algebra.path_pairs(graph.union(orders(spark, d, True), customers(spark, d, True)), ("seq", PLACED_BY, IN_NATION)))


@query(f"SELECT DISTINCT '{U}part/' || l_partkey AS s, '{U}order/' || l_orderkey AS o FROM lineitem")
def path_inverse(spark, d):
    return said(algebra.path_pairs(lines(spark, d), ("inv", CONTAINS)))


@query(f"SELECT DISTINCT '{U}order/' || o_orderkey AS s, o_orderstatus AS o FROM orders UNION SELECT '{U}order/' || o_orderkey, o_orderpriority FROM orders")
def path_alternative(spark, d):
    return said(algebra.path_pairs(orders(spark, d), ("alt", STATUS, PRIORITY)))


_PLACES = f"places AS (SELECT '{U}nation/' || n_nationkey AS s, '{U}region/' || n_regionkey AS o FROM nation UNION SELECT '{U}region/' || r_regionkey, '{U}World' FROM region)"
_REACH = f"{_PLACES}, reach AS (SELECT s, o FROM places UNION SELECT r.s, p.o FROM reach r JOIN places p ON r.o = p.s)"
_STAR = f"{_REACH}, star AS (SELECT s AS child, o AS ancestor FROM reach UNION SELECT s, s FROM places UNION SELECT o, o FROM places)"


@query(f"WITH {_PLACES} SELECT s, o FROM places UNION SELECT s, s FROM places UNION SELECT o, o FROM places")
def path_zero_or_one(spark, d):
    return said(algebra.path_pairs(places(spark, d), ("?", SUBCLASS)))


@query(f"WITH RECURSIVE {_REACH} SELECT s, o FROM reach")
def path_one_or_more(spark, d):
    return said(algebra.path_pairs(places(spark, d), ("+", SUBCLASS)))


@query(f"WITH RECURSIVE {_STAR} SELECT child AS s, ancestor AS o FROM star WHERE child LIKE '%/nation/%'")
def path_zero_or_more(spark, d):
    start = table(spark, d, "nation").select(ref("nation", "n_nationkey").alias("s"))
    return said(algebra.path_pairs(places(spark, d), ("*", SUBCLASS), start))


@query(f"WITH RECURSIVE {_STAR} SELECT '{U}customer/' || c_custkey AS node, ancestor AS class FROM customer JOIN star ON child = '{U}nation/' || c_nationkey WHERE ancestor IN ('{U}World', '{U}region/1')")
def class_closure_instances(spark, d):
    g = graph.union(residents(spark, d), places(spark, d))
    return said(closure.instances(g, [iri(f"{U}World"), iri(f"{U}region/1")]))


@query(f"WITH RECURSIVE {_STAR} SELECT * FROM (VALUES ('{U}S1', '{U}World'), ('{U}S2', '{U}region/1'), ('{U}S3', '{U}nation/1')) v(shape, c) WHERE c IN (SELECT ancestor FROM star WHERE child = '{U}region/1')".replace("SELECT * FROM (VALUES", "SELECT shape FROM (VALUES"))
def shapes_about_class(spark, d):
    shapes = [Shape(iri(f"{U}S{k}"), targets=(("class", iri(f"{U}{c}")),)) for k, c in ((1, "World"), (2, "region/1"), (3, "nation/1"))]
    return said(extract.shapes_about(shapes, places(spark, d), iri(f"{U}region/1")))


# --- validation


def _report(spark, d, shape: Shape, g: DataFrame, bag: bool = False) -> DataFrame:
    r = validate.Validator(g, PREFIXES, bag=bag).report([shape])
    return r.select(plain(F.col("focus")).alias("focus"), plain(F.col("value")).alias("value"), "component")


def _order(*constraints, path=None, **more) -> Shape:
    """A shape of all orders with one property."""
    return Shape(iri(f"{U}OrderShape"), targets=(("class", ORDER),), constraints=(("property", Shape(iri(f"{U}OrderProperty"), path=path or CONTAINS, constraints=constraints, **more)),))


def _orders_and_lines(spark, d):
    return graph.union(orders(spark, d, True), lines(spark, d, True))


def _bag(spark, d):
    """Orders, lines and parts, for validators: they tell apart what they read."""
    return graph.bag(orders(spark, d, True), lines(spark, d, True), parts(spark, d))


@query(f"SELECT '{U}order/' || o_orderkey AS focus FROM orders")
def target_class(spark, d):
    return said(validate.Validator(orders(spark, d)).targets(Shape("x", targets=(("class", ORDER),))))


@query(f"SELECT DISTINCT '{U}order/' || l_orderkey AS focus FROM lineitem UNION SELECT '{U}nation/' || c_nationkey FROM customer UNION SELECT '{U}order/-1'")
def target_subjects_objects_node(spark, d):
    g = graph.union(lines(spark, d), customers(spark, d))
    return said(validate.Validator(g).targets(Shape("x", targets=(("subjects", CONTAINS), ("objects", IN_NATION), ("node", iri(f"{U}order/-1"))))))


_N = "(SELECT o_orderkey, count(DISTINCT l_partkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)"


@query(f"SELECT '{U}order/' || o_orderkey AS focus, NULL::VARCHAR AS value, 'MinCountConstraintComponent' AS component FROM {_N} WHERE n < 2")
def min_count(spark, d):
    return _report(spark, d, _order(("minCount", 2)), _orders_and_lines(spark, d))


@query(f"SELECT '{U}order/' || o_orderkey AS focus, NULL::VARCHAR AS value, 'MaxCountConstraintComponent' AS component FROM {_N} WHERE n > 6")
def max_count(spark, d):
    return _report(spark, d, _order(("maxCount", 6)), _orders_and_lines(spark, d))


_QN = "(SELECT o_orderkey, count(DISTINCT p_partkey) AS n FROM orders LEFT JOIN (SELECT l_orderkey, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey AND p_type = 'PROMO') ON o_orderkey = l_orderkey GROUP BY 1)"
PROMO = iri(f"{U}PROMO")


@query(f"SELECT '{U}order/' || o_orderkey AS focus, NULL::VARCHAR AS value, 'QualifiedMinCountConstraintComponent' AS component FROM {_QN} WHERE n < 1")
def qualified_min_count(spark, d):
    inner = Shape(iri(f"{U}PromoPart"), constraints=(("class", PROMO),))
    return _report(spark, d, _order(("qualified", (inner, 1, None))), _bag(spark, d), True)


@query(f"SELECT '{U}order/' || o_orderkey AS focus, NULL::VARCHAR AS value, 'QualifiedMaxCountConstraintComponent' AS component FROM {_QN} WHERE n > 2")
def qualified_max_count(spark, d):
    inner = Shape(iri(f"{U}PromoPart"), constraints=(("class", PROMO),))
    return _report(spark, d, _order(("qualified", (inner, None, 2))), _bag(spark, d), True)


@query(f"SELECT '{U}order/' || o_orderkey AS focus, NULL::VARCHAR AS value, CASE WHEN n < 1 THEN 'QualifiedMinCountConstraintComponent' ELSE 'QualifiedMaxCountConstraintComponent' END AS component FROM {_QN} WHERE n < 1 OR n > 2")
def qualified_both_bounds(spark, d):
    inner = Shape(iri(f"{U}PromoPart"), constraints=(("class", PROMO),))
    return _report(spark, d, _order(("qualified", (inner, 1, 2))), _bag(spark, d), True)


@query(f"SELECT DISTINCT '{U}order/' || l_orderkey AS focus, '{U}part/' || l_partkey AS value, 'ClassConstraintComponent' AS component FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> 'PROMO' AND l_orderkey IN (SELECT o_orderkey FROM orders)")
def class_constraint(spark, d):
    return _report(spark, d, _order(("class", PROMO)), _bag(spark, d), True)


@query(f"SELECT DISTINCT '{U}order/' || l_orderkey AS focus, '{U}part/' || l_partkey AS value, 'NodeConstraintComponent' AS component FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 40 AND l_orderkey IN (SELECT o_orderkey FROM orders)")
def node_constraint(spark, d):
    small = Shape(iri(f"{U}Small"), constraints=(("property", Shape(iri(f"{U}SmallSize"), path=SIZE, constraints=(("maxInclusive", 40.0),))),))
    return _report(spark, d, _order(("node", small)), _bag(spark, d), True)


@query(f"SELECT '{U}order/' || o_orderkey AS focus, NULL::VARCHAR AS value, 'HasValueConstraintComponent' AS component FROM orders WHERE o_orderstatus <> 'F'")
def has_value(spark, d):
    return _report(spark, d, _order(("hasValue", literal("F")), path=STATUS), orders(spark, d))


@query(f"SELECT '{U}order/' || o_orderkey AS focus, o_orderpriority AS value, 'InConstraintComponent' AS component FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def in_list(spark, d):
    return _report(spark, d, _order(("in", (literal("1-URGENT"), literal("5-LOW"))), path=PRIORITY), orders(spark, d))


@query(f"SELECT '{U}order/' || o_orderkey AS focus, o_orderpriority AS value, 'PatternConstraintComponent' AS component FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')")
def pattern(spark, d):
    return _report(spark, d, _order(("pattern", ("^[1-3]-", "")), path=PRIORITY), orders(spark, d))


@query(f"SELECT '{U}part/' || p_partkey AS focus, CASE WHEN p_size % 3 = 0 THEN 'size ' || p_size ELSE p_size::VARCHAR END AS value, 'DatatypeConstraintComponent' AS component FROM part WHERE p_size % 3 = 0 OR p_size % 5 = 0")
def datatype_constraint(spark, d):
    """Integers conform; a text under that datatype and a plain string do not."""
    p, size = table(spark, d, "part"), F.col("p_size").cast("string")
    value = F.when(F.col("p_size") % 3 == 0, literal_col(F.concat(F.lit("size "), size), f"{XSD}integer")).when(F.col("p_size") % 5 == 0, literal_col(size)).otherwise(literal_col(size, f"{XSD}integer"))
    g = T_PART.graph(p.select(ref("part", "p_partkey").alias("name"), F.lit(PART).alias("kind"), literal_col(F.col("p_brand")).alias("brand"), value.alias("size")))
    return _report(spark, d, _part(("datatype", iri(f"{XSD}integer"))), g)


@query(f"SELECT '{U}order/' || o_orderkey AS focus, o_orderstatus AS value, 'NodeKindConstraintComponent' AS component FROM orders")
def node_kind(spark, d):
    return _report(spark, d, _order(("nodeKind", sh("BlankNodeOrIRI")), path=("alt", STATUS, PLACED_BY)), orders(spark, d))


@query(f"SELECT '{U}order/' || o_orderkey AS focus, o_orderpriority AS value, 'MinLengthConstraintComponent' AS component FROM orders WHERE length(o_orderpriority) < 6")
def min_length(spark, d):
    return _report(spark, d, _order(("minLength", 6), path=PRIORITY), orders(spark, d))


def _part(*constraints, path=SIZE) -> Shape:
    return Shape(iri(f"{U}PartShape"), targets=(("class", PART),), constraints=(("property", Shape(iri(f"{U}PartProperty"), path=path, constraints=constraints)),))


@query(f"SELECT '{U}part/' || p_partkey AS focus, p_size::VARCHAR AS value, CASE WHEN p_size < 10 THEN 'MinInclusiveConstraintComponent' ELSE 'MaxExclusiveConstraintComponent' END AS component FROM part WHERE p_size < 10 OR p_size >= 45")
def value_range(spark, d):
    return _report(spark, d, _part(("minInclusive", 10.0), ("maxExclusive", 45.0)), parts(spark, d))


@query(f"SELECT '{U}part/' || p_partkey AS focus, p_brand AS value, 'DisjointConstraintComponent' AS component FROM part WHERE p_partkey % 2 = 0")
def disjoint(spark, d):
    p = table(spark, d, "part").where("p_partkey % 2 = 0")
    also = p.select(ref("part", "p_partkey").alias("s"), F.lit(iri(f"{U}also")).alias("p"), literal_col(F.col("p_brand")).alias("o"))
    return _report(spark, d, _part(("disjoint", iri(f"{U}also")), path=BRAND), graph.union(parts(spark, d), also))


@query(f"SELECT '{U}part/' || p_partkey AS focus, p_brand AS value, 'ClosedConstraintComponent' AS component FROM part WHERE p_size > 10")
def closed_shape(spark, d):
    """Small parts have no brand here, and so no predicate beyond those allowed."""
    small = parts(spark, d).where(F.col("p") == SIZE).where(number(F.col("o")) <= 10).select("s")
    g = parts(spark, d).join(small.withColumn("p", F.lit(BRAND)), ["s", "p"], "left_anti").select("s", "p", "o")
    return _report(spark, d, Shape(iri(f"{U}Closed"), targets=(("class", PART),), constraints=(("closed", (A, SIZE)),)), g)


def _logic(*constraints) -> Shape:
    return Shape(iri(f"{U}Logic"), targets=(("class", ORDER),), constraints=constraints)


_FINISHED = Shape(iri(f"{U}Finished"), constraints=(("property", Shape(iri(f"{U}FinishedP"), path=STATUS, constraints=(("hasValue", literal("F")),))),))
_URGENT = Shape(iri(f"{U}Urgent"), constraints=(("property", Shape(iri(f"{U}UrgentP"), path=PRIORITY, constraints=(("in", (literal("1-URGENT"), literal("2-HIGH"))),))),))


def _logic_sql(component: str, wrong: str) -> str:
    return f"SELECT '{U}order/' || o_orderkey AS focus, '{U}order/' || o_orderkey AS value, '{component}' AS component FROM orders WHERE {wrong}"


_F, _UR = "(o_orderstatus = 'F')", "(o_orderpriority IN ('1-URGENT', '2-HIGH'))"


@query(_logic_sql("OrConstraintComponent", f"NOT ({_F} OR {_UR})"))
def logic_or(spark, d):
    return _report(spark, d, _logic(*any_of(_FINISHED, _URGENT).constraints), orders(spark, d))


@query(_logic_sql("AndConstraintComponent", f"NOT ({_F} AND {_UR})"))
def logic_and(spark, d):
    v = validate.Validator(orders(spark, d), PREFIXES)
    s = _logic(*all_of(_FINISHED, _URGENT).constraints)
    return v.check(s, v.targets(s)).select(plain(F.col("focus")).alias("focus"), plain(F.col("value")).alias("value"), "component")


@query(_logic_sql("NotConstraintComponent", _F))
def logic_not(spark, d):
    return _report(spark, d, _logic(*negation(_FINISHED).constraints), orders(spark, d))


@query(_logic_sql("XoneConstraintComponent", f"{_F} = {_UR}"))
def logic_xone(spark, d):
    return _report(spark, d, _logic(*one_of(_FINISHED, _URGENT).constraints), orders(spark, d))


@query(f"SELECT CASE WHEN (SELECT count(*) FROM customer) <> 7 THEN '{U}check' END AS focus, NULL::VARCHAR AS value, 'countConstraintComponent' AS component")
def exact_count_component(spark, d):
    s = Shape(iri(f"{U}Exactly"), targets=(("node", iri(f"{U}check")),), constraints=(("exactCount", (CUSTOMER, 7)),))
    return _report(spark, d, s, customers(spark, d))


@query(f"SELECT 'Warning' AS severity, count(*) AS n FROM {_N} WHERE n < 2 HAVING count(*) > 0 UNION ALL SELECT 'Violation', count(*) FROM orders WHERE o_orderstatus <> 'F' HAVING count(*) > 0")
def severity_summary(spark, d):
    shapes = [_order(("minCount", 2), severity="Warning"), Shape(iri(f"{U}Other"), targets=(("class", ORDER),), constraints=(("property", Shape(iri(f"{U}OtherP"), path=STATUS, constraints=(("hasValue", literal("F")),))),))]
    return validate.severity_counts(validate.Validator(graph.bag(orders(spark, d, True), lines(spark, d, True)), bag=True).report(shapes))


def _diffs(spark, d) -> DataFrame:
    shapes = [_order(("minCount", 1))]
    report = validate.Validator(_orders_and_lines(spark, d), PREFIXES).report(shapes)
    return validate.diff(report, shapes, PREFIXES)


@query(f"SELECT '{U}order/' || o_orderkey AS focus, '{U}order/' || o_orderkey || ' expected at least 1 uses of path t:containsPart' AS reason FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def diff_reasons(spark, d):
    return _diffs(spark, d).select(plain(F.col("focus")).alias("focus"), "reason")


@query(f"""SELECT '{U}order/' || o_orderkey AS focus, '{U}order/' || o_orderkey || ' expected between 2 and 9 instance(s) of t:PROMO on path t:containsPart' AS reason, 'PathClassCount' AS kind FROM {_QN} WHERE n < 2 OR n > 9""")
def diff_class_counts(spark, d):
    inner = Shape(iri(f"{U}PromoPart"), constraints=(("class", PROMO),))
    shapes = [_order(("qualified", (inner, 2, 9)))]
    report = validate.Validator(_bag(spark, d), PREFIXES, bag=True).report(shapes)
    return validate.diff(report, shapes, PREFIXES).select(plain(F.col("focus")).alias("focus"), "reason", "kind")


@query(f"SELECT '{U}order/' || o_orderkey AS entity, 1 AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def broken_entities(spark, d):
    return validate.broken_entities(_diffs(spark, d)).select(plain(F.col("entity")).alias("entity"), F.size("reasons").alias("n"))


@query(f"SELECT '{U}order/' || o_orderkey AS s, '{U}containsPart' AS p, '{U}' || md5('<{U}order/' || o_orderkey || '>|t:containsPart||1') AS o FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def repair_triples(spark, d):
    return said(validate.repair(_diffs(spark, d), {"t:containsPart": CONTAINS}, U))


# --- shapes to tables


def _extract(spark, d, shape: Shape) -> DataFrame:
    return extract.Extractor(_bag(spark, d), bag=True).table(shape)


def _order_table(*properties: Shape) -> Shape:
    return Shape(iri(f"{U}T"), targets=(("class", ORDER),), constraints=tuple(("property", p) for p in properties))


@query(f"SELECT DISTINCT '{U}order/' || o_orderkey AS target, '{U}part/' || p_partkey AS promo FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO'")
def shape_to_df_required(spark, d):
    inner = Shape("v", constraints=(("class", PROMO),))
    return _extract(spark, d, _order_table(Shape("p", path=CONTAINS, name="promo", constraints=(("qualified", (inner, 1, None)),))))


@query(f"SELECT DISTINCT '{U}order/' || o_orderkey AS target, promo FROM orders LEFT JOIN (SELECT l_orderkey, '{U}part/' || p_partkey AS promo FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO') ON o_orderkey = l_orderkey")
def shape_to_df_optional(spark, d):
    return _extract(spark, d, _order_table(Shape("p", path=CONTAINS, name="promo", constraints=(("class", PROMO), ("minCount", 1)))))


@query(f"SELECT DISTINCT '{U}order/' || o_orderkey AS target, '{U}part/' || p_partkey AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_type IN ('PROMO', 'LARGE')")
def shape_to_df_union(spark, d):
    two = tuple(Shape(f"o{k}", constraints=(("class", iri(f"{U}{k}")),)) for k in ("PROMO", "LARGE"))
    return _extract(spark, d, _order_table(Shape("p", path=CONTAINS, name="item", constraints=(("or", two),))))


@query(f"SELECT '{U}order/' || o_orderkey AS target, o_orderpriority AS prio FROM orders WHERE o_orderstatus = 'F'")
def shape_to_df_hasvalue(spark, d):
    return _extract(spark, d, _order_table(Shape("p", path=STATUS, constraints=(("hasValue", literal("F")),)), Shape("q", path=PRIORITY, name="prio")))


@query(f"SELECT DISTINCT '{U}order/' || o_orderkey AS target, '{U}part/' || p_partkey AS item, p_brand AS brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO'")
def shape_to_df_nested(spark, d):
    node = Shape("n", constraints=(("class", PROMO), ("property", Shape("b", path=BRAND, name="brand"))))
    inner = Shape("v", constraints=(("node", node),))
    return _extract(spark, d, _order_table(Shape("p", path=CONTAINS, name="item", constraints=(("qualified", (inner, 1, None)),))))


# --- rules


@query(f"WITH RECURSIVE {_REACH} SELECT s, '{SUBCLASS[1:-1]}' AS p, o FROM reach")
def rule_fixpoint(spark, d):
    up = infer.construct_rule([("?a", SUBCLASS, "?b"), ("?b", SUBCLASS, "?c")], ("?a", SUBCLASS, "?c"))
    return said(infer.fixpoint(places(spark, d), [up]))


@query(f"""WITH {_O} SELECT * FROM orders_g UNION SELECT '{U}order/' || o_orderkey, '{_RDF}type', '{U}UrgentOrder' FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
UNION SELECT '{U}order/' || o_orderkey, '{U}level', 'now' FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def triple_rule_with_condition(spark, d):
    urgent = iri(f"{U}UrgentOrder")
    first = infer.TripleRule(Shape("s", targets=(("class", ORDER),)), "$this", A, urgent, (_URGENT,))
    then = infer.TripleRule(Shape("s", targets=(("class", urgent),)), "$this", iri(f"{U}level"), literal("now"))
    return said(infer.fixpoint(orders(spark, d), [first, then]))


_RULES = f"""@prefix t: <{U}> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix rdf: <{_RDF}> .
t:OrderRules a sh:NodeShape ; sh:targetClass t:Order ;
  sh:rule [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate rdf:type ; sh:object t:UrgentOrder ; sh:condition t:IsUrgent ] .
t:UrgentRules a sh:NodeShape ; sh:targetClass t:UrgentOrder ;
  sh:rule [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate t:level ; sh:object "now" ] ;
  sh:rule [ a sh:TripleRule ; sh:subject t:Desk ; sh:predicate t:handles ; sh:object sh:this ; sh:condition [ sh:property [ sh:path t:status ; sh:hasValue "F" ] ] ] .
t:IsUrgent a sh:NodeShape ; sh:property [ sh:path t:priority ; sh:in ( "1-URGENT" "2-HIGH" ) ] .
"""


@query(f"""SELECT '{U}order/' || o_orderkey AS s, '{_RDF}type' AS p, '{U}UrgentOrder' AS o FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
UNION SELECT '{U}order/' || o_orderkey, '{U}level', 'now' FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
UNION SELECT '{U}Desk', '{U}handles', '{U}order/' || o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'""")
def rules_from_shapes_graph(spark, d):
    """Triple rules as a shapes graph in Turtle says them; what they add to the orders."""
    g = orders(spark, d)
    return said(infer.fixpoint(g, infer.rules_of(ShapeGraph(turtle.read(_RULES))), limit=None, added=True))


# --- labels


def _name_parser() -> L.Parser:
    kinds = L.abbreviations({"Customer": f"{U}Customer", "Supplier": f"{U}Supplier"})
    return L.sequence(kinds, L.string("#", L.DELIMITER), L.regex("[0-9]+", L.IDENTIFIER))


def _names(spark, d) -> DataFrame:
    odd = F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("-x"))).when(F.col("c_custkey") % 7 == 0, F.lit("Broken#")).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", odd.alias("label"))


_NAMES = "(SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name || '-x' WHEN c_custkey % 7 = 0 THEN 'Broken#' ELSE c_name END AS label FROM customer)"


@query(f"SELECT c_custkey, label, regexp_full_match(label, '(Customer|Supplier)#[0-9]+') AS success FROM {_NAMES}")
def label_parse_success(spark, d):
    return L.parse(_names(spark, d), _name_parser()).select("c_custkey", "label", "success")


@query(f"SELECT DISTINCT label, regexp_extract(label, '#([0-9]+)', 1) AS identifier, '{U}Customer' AS type FROM {_NAMES} WHERE regexp_full_match(label, 'Customer#[0-9]+')")
def label_tokens(spark, d):
    return L.label_records(_names(spark, d), _name_parser())


@query(f"SELECT CASE WHEN label = 'Broken#' THEN label ELSE '-x' END AS unparsed, count(DISTINCT label) AS n FROM {_NAMES} WHERE NOT regexp_full_match(label, 'Customer#[0-9]+') GROUP BY 1")
def label_failures_grouped(spark, d):
    _, bad = L.split(L.parse(_names(spark, d), _name_parser()))
    return L.failures(bad).select("unparsed", "n")


@query(f"SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#1%' THEN '{U}One' WHEN p_brand LIKE 'Brand#%' THEN '{U}Any' END AS type, CASE WHEN p_brand LIKE 'Brand#1%' THEN substr(p_brand, 8) ELSE substr(p_brand, 7) END AS rest FROM part")
def label_choice_order(spark, d):
    p = L.sequence(L.abbreviations({"Brand#1": f"{U}One", "Brand#": f"{U}Any", "Brand#12": f"{U}Never"}), L.rest(L.IDENTIFIER))
    t = L.parse(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("label")), p)
    return t.select("p_partkey", F.get("tokens", F.lit(0))["token"].alias("type"), F.get("tokens", F.lit(1))["value"].alias("rest"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS head, length(p_name) - length(replace(p_name, ' ', '')) AS blanks FROM part")
def label_until(spark, d):
    p = L.many(L.sequence(L.until(L.choice(L.string(" ", L.DELIMITER), L.regex("$", L.DELIMITER)), L.IDENTIFIER), L.maybe(L.string(" ", L.DELIMITER))))
    t = L.parse(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("label")), p).where("success")
    return t.select("p_partkey", F.get("tokens", F.lit(0))["value"].alias("head"), F.size(F.filter("tokens", lambda x: x["kind"] == "Delimiter")).cast("bigint").alias("blanks"))


# --- matching


@query(f"SELECT DISTINCT '{U}order/' || o_orderkey AS name, '{U}part/' || p_partkey AS part FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO' AND o_orderstatus = 'F'")
def template_match(spark, d):
    t = Template("finished", ((param("name"), CONTAINS, param("part")), (param("part"), A, PROMO), (param("name"), STATUS, literal("F")), (param("name"), A, ORDER)))
    g = graph.union(_orders_and_lines(spark, d), parts(spark, d))
    m = match.Matcher(t, g, parts(spark, d), check_predicates=True)
    every = m.mappings(m.nodes, m.edges)
    return every.select(*[plain(F.col(f"n{m.nodes.index(param(p))}")).alias(p) for p in ("name", "part")])


@query(f"SELECT '{U}part/' || p_partkey AS name, '{U}' || p_type AS kind FROM part")
def template_match_covariant(spark, d):
    """A template of the super-class matches instances of its subclasses; the optional part that is not there is left."""
    t = Template("thing", ((param("name"), A, PART), (param("name"), iri(f"{U}madeBy"), param("maker"))))
    m = match.Matcher(t, parts(spark, d), parts(spark, d), check_predicates=True)
    nodes, rows = m.best()
    rows = rows.where(~F.col(f"n{m.nodes.index(param('name'))}").isin(*[iri(f"{U}{k}") for k in ("ECONOMY", "LARGE", "MEDIUM", "PROMO")]))
    return rows.select(plain(F.col(f"n{m.nodes.index(param('name'))}")).alias("name"), plain(F.col(f"n{m.nodes.index(PART)}")).alias("kind"))


# --- functions on terms


@query("""SELECT p_partkey, length(p_name) AS n, upper(p_name) AS up, substr(p_name, 2, 3) AS some, CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE '' END AS before, CASE WHEN contains(p_name, ' ') THEN substr(p_name, strpos(p_name, ' ') + 1) ELSE '' END AS after, starts_with(p_name, 's') AS starts, regexp_matches(p_name, 'r.*g') AS fits, replace(p_name, ' ', '%20') AS uri, md5(p_name) AS hash FROM part""")
def term_string_functions(spark, d):
    t, blank = literal_col(F.col("p_name")), literal_col(F.lit(" "))
    said_as = {"up": X.ucase(t), "some": X.substr(t, 2, 3), "before": X.strbefore(t, blank), "after": X.strafter(t, blank), "uri": X.encode_for_uri(t), "hash": X.digest(t, "md5")}
    rest = {"n": lexical(X.strlen(t)).cast("bigint"), "starts": X.strstarts(t, literal_col(F.lit("s"))), "fits": X.regex(t, "r.*g")}
    return table(spark, d, "part").select("p_partkey", *[lexical(c).alias(n) for n, c in said_as.items()], *[c.alias(n) for n, c in rest.items()])


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, floor(o_totalprice)::BIGINT AS whole, o_totalprice > 1000 AS large, true AS is_number, o_orderstatus = 'F' OR o_orderstatus = 'O' AS known FROM orders")
def term_number_and_date_functions(spark, d):
    price, date = literal_col(F.col("o_totalprice"), f"{XSD}double"), literal_col(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), f"{XSD}dateTime")
    status = literal_col(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", X.year(date).alias("y"), X.month(date).alias("m"), X.numeric(price, F.floor).alias("whole"), (number(price) > 1000).alias("large"), X.is_numeric(price).alias("is_number"), X.one_of(status, F.lit(literal("F")), F.lit(literal("O"))).alias("known"))


@query("SELECT l_orderkey AS k, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS parts, sum(l_partkey)::DOUBLE AS total, avg(l_partkey)::DOUBLE AS mean, min(l_partkey::VARCHAR) AS one, CASE WHEN l_orderkey % 2 = 0 THEN sum(l_linenumber)::DOUBLE END AS some FROM lineitem GROUP BY l_orderkey")
def term_aggregates(spark, d):
    """SUM, AVG, SAMPLE and GROUP_CONCAT; a sum over a term that is no number is unbound."""
    part = literal_col(F.col("l_partkey"), f"{XSD}integer")
    odd = F.when(F.col("l_orderkey") % 2 == 0, literal_col(F.col("l_linenumber"), f"{XSD}integer")).otherwise(literal_col(F.lit("none")))
    rows = table(spark, d, "lineitem").select("l_orderkey", part.alias("part"), odd.alias("odd"))
    one = X.sample(F.col("part"))
    return rows.groupBy(F.col("l_orderkey").alias("k")).agg(lexical(X.group_concat(F.col("part"), ",")).alias("parts"), X.total(F.col("part")).alias("total"), X.average(F.col("part")).alias("mean"), lexical(one).alias("one"), X.total(F.col("odd")).alias("some"))


@query(f"SELECT event_id, minute(ts)::INT AS mi, second(ts)::INT AS se, hour(ts)::INT AS ho, day(ts)::INT AS da, CASE WHEN event_id % 2 = 0 THEN 'Z' ELSE '' END AS zone, '{U}event/' || event_id AS iri, '_:b' AS blank, count(*) OVER (PARTITION BY event_type) AS alike FROM events")
def term_times_and_nodes(spark, d):
    """Minutes, seconds, zones; IRIs from texts; blank nodes that rows with one key share."""
    from pyspark.sql import Window

    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    t = literal_col(F.when(F.col("event_id") % 2 == 0, F.concat(text, F.lit("Z"))).otherwise(text), f"{XSD}dateTime")
    b = X.bnode(F.col("event_type"))
    named = X.to_iri(literal_col(F.concat(F.lit("event/"), F.col("event_id").cast("string"))), U)
    return table(spark, d, "events").select("event_id", X.minutes(t).alias("mi"), F.floor(X.seconds(t)).cast("int").alias("se"), X.hours(t).alias("ho"), X.day(t).alias("da"), lexical(X.tz(t)).alias("zone"), plain(named).alias("iri"), F.substring(b, 1, 3).alias("blank"), F.count("*").over(Window.partitionBy(b)).alias("alike"))


# --- more of shapes, graphs and labels


@query(f"""WITH p AS (SELECT p_partkey AS k, p_size AS s, p_size % 2 = 0 AS even FROM part)
SELECT '{U}part/' || k AS focus, s::VARCHAR AS value, 'LessThanConstraintComponent' AS component FROM p WHERE even AND s >= 20
UNION ALL SELECT '{U}part/' || k, s::VARCHAR, 'LessThanOrEqualsConstraintComponent' FROM p WHERE even AND s > 20
UNION ALL SELECT '{U}part/' || k, s::VARCHAR, 'EqualsConstraintComponent' FROM p WHERE NOT even OR s <> 20
UNION ALL SELECT '{U}part/' || k, '20', 'EqualsConstraintComponent' FROM p WHERE even AND s <> 20""")
def property_pairs(spark, d):
    """lessThan, lessThanOrEquals and equals against a limit of 20 that only parts of even size have."""
    limit = iri(f"{U}limit")
    p = table(spark, d, "part").where("p_size % 2 = 0")
    also = p.select(ref("part", "p_partkey").alias("s"), F.lit(limit).alias("p"), F.lit(literal("20", f"{XSD}integer")).alias("o"))
    return _report(spark, d, _part(("lessThan", limit), ("lessThanOrEquals", limit), ("equals", limit)), graph.union(parts(spark, d), also))


@query(f"""SELECT '{U}part/' || p_partkey AS focus, NULL::VARCHAR AS value, 'UniqueLangConstraintComponent' AS component FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT '{U}part/' || p_partkey, p_brand, 'LanguageInConstraintComponent' FROM part WHERE p_partkey % 3 = 1""")
def languages(spark, d):
    """Names in English; every third part has two, and the next one in French only."""
    third = F.col("p_partkey") % 3
    said_as = F.when(third == 0, F.array(literal_col(F.col("p_name"), lang="en"), literal_col(F.concat("p_name", F.lit("!")), lang="en"))).when(third == 1, F.array(literal_col(F.col("p_brand"), lang="fr"))).otherwise(F.array(literal_col(F.col("p_name"), lang="en-GB"), literal_col(F.col("p_name"), lang="en")))
    p = table(spark, d, "part").select(ref("part", "p_partkey").alias("s"), F.explode(said_as).alias("o"))
    return _report(spark, d, _part(("uniqueLang", True), ("languageIn", (literal("en"),)), path=LABEL), graph.union(parts(spark, d), p.select("s", F.lit(LABEL).alias("p"), "o")))


_CLASS_SHAPES = f"""@prefix t: <{U}> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
t:Order a owl:Class, sh:NodeShape ; sh:property [ sh:path t:status ; sh:hasValue "F" ; sh:message "is not done" ; sh:severity sh:Warning ] ;
  sh:property [ sh:path t:priority ; sh:in ( "1-URGENT" ) ; sh:deactivated false ] .
t:Off a sh:NodeShape ; sh:targetClass t:Order ; sh:deactivated true ; sh:property [ sh:path t:nothing ; sh:minCount 1 ] .
"""


@query(f"""SELECT '{U}order/' || o_orderkey AS focus, 'Warning' AS severity, 'is not done' AS message FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT '{U}order/' || o_orderkey, 'Violation', NULL FROM orders WHERE o_orderpriority <> '1-URGENT'""")
def implicit_class_target(spark, d):
    """A class that is a node shape too; messages and severities; a shape that is switched off."""
    shapes = ShapeGraph(turtle.read(_CLASS_SHAPES)).shapes()
    return validate.Validator(orders(spark, d)).report(shapes).select(plain(F.col("focus")).alias("focus"), "severity", "message")


@query(f"SELECT '{U}order/' || o_orderkey AS entity, CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS n FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority <> '1-URGENT'")
def diff_by_severity(spark, d):
    """Entities with their number of warnings; those with violations only stay, with none."""
    count = lambda name, path, severity: Shape(iri(f"{U}{name}"), path=path, constraints=(("minCount", 1),), severity=severity)
    s = Shape(iri(f"{U}Both"), targets=(("class", ORDER),), constraints=(("property", count("Done", iri(f"{U}done"), "Warning")), ("property", count("Fast", iri(f"{U}fast"), "Violation"))))
    o = table(spark, d, "orders")
    has = lambda p, rows: rows.select(ref("order", "o_orderkey").alias("s"), F.lit(iri(f"{U}{p}")).alias("p"), F.lit(literal("yes")).alias("o"))
    g = graph.union(orders(spark, d, True), has("done", o.where("o_orderstatus = 'F'")), has("fast", o.where("o_orderpriority = '1-URGENT'")))
    diffs = validate.diff(validate.Validator(g, PREFIXES).report([s]), [s], PREFIXES)
    return validate.reasons_by_severity(diffs, "Warning").select(plain(F.col("entity")).alias("entity"), F.size("reasons").alias("n"))


@query(f"""WITH broken AS (SELECT '{U}order/' || o_orderkey AS f FROM {_QN} WHERE n < 2),
made AS (SELECT f, '{U}repair0-' || k || '_' || md5('<' || f || '>' || chr(31) || 'repair0-' || k) AS x, '{U}repair0-' || k || '-maker_' || md5('<' || f || '>' || chr(31) || 'repair0-' || k || '-maker') AS y FROM broken, (VALUES (0), (1)) v(k))
SELECT f AS s, '{U}containsPart' AS p, x AS o FROM made UNION SELECT x, '{_RDF}type', '{U}PromoShape' FROM made
UNION SELECT x, '{_RDF}type', '{U}PROMO' FROM made UNION SELECT x, '{U}madeBy', y FROM made""")
def repair_builds_shapes(spark, d):
    """Orders with fewer than two conforming parts get new ones, each built by the template of the shape."""
    node = Shape(iri(f"{U}PromoShape"), constraints=(("class", PROMO),))
    shapes = [_order(("qualified", (Shape(iri(f"{U}PromoValue"), constraints=(("node", node),)), 2, None)))]
    report = validate.Validator(_bag(spark, d), PREFIXES, bag=True).report(shapes)
    promo = Template(f"{U}PromoShape", ((param("name"), A, PROMO), (param("name"), iri(f"{U}madeBy"), param("maker"))))
    templates, needs = validate.repair_templates(validate.diff(report, shapes, PREFIXES), {"t:containsPart": CONTAINS}, lambda _, n: promo if n == promo.name else None)
    return said(validate.repaired(templates, needs, U))


@query(f"""SELECT '{U}order/' || o_orderkey AS s, '{U}by' AS p, '_:x' || 'c' || o_custkey AS o FROM orders UNION SELECT '_:xc' || o_custkey, '{U}key', o_custkey::VARCHAR FROM orders""")
def graph_copy(spark, d):
    return said(graph.rename_blank_nodes(_buyers(spark, d), "x"))


def _buyers(spark, d):
    """Orders by customers that are blank nodes."""
    o = table(spark, d, "orders")
    node = F.concat(F.lit("_:c"), F.col("o_custkey").cast("string"))
    by = o.select(ref("order", "o_orderkey").alias("s"), F.lit(iri(f"{U}by")).alias("p"), node.alias("o"))
    return graph.union(by, o.select(node.alias("s"), F.lit(iri(f"{U}key")).alias("p"), literal_col(F.col("o_custkey")).alias("o")))


@query(f"""SELECT '{U}order/' || o_orderkey AS s, '{U}by' AS p, '_:c' || o_custkey AS o FROM orders WHERE o_orderpriority = '1-URGENT'
UNION SELECT '_:c' || o_custkey, '{U}key', o_custkey::VARCHAR FROM orders WHERE o_orderpriority = '1-URGENT'""")
def graph_description(spark, d):
    """Urgent orders with the blank nodes that they lead to."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(ref("order", "o_orderkey").alias("node"))
    return said(graph.describe(_buyers(spark, d), urgent))


@query(f"""SELECT '{U}order/' || o_orderkey AS s, '{U}by' AS p, 'urn:well-known/' || left(sha256('_:c' || o_custkey), 16) AS o FROM orders
UNION SELECT 'urn:well-known/' || left(sha256('_:c' || o_custkey), 16), '{U}key', o_custkey::VARCHAR FROM orders""")
def graph_skolemize(spark, d):
    return said(graph.skolemize(_buyers(spark, d), (iri(f"{U}by"),)))


@query("SELECT p_partkey, p_partkey % 2 = 1 AS skip FROM part")
def skip_terms(spark, d):
    p = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 4 == 1, F.lit(XSD)).when(F.col("p_partkey") % 4 == 3, F.lit("http://www.w3.org/ns/shacl#")).otherwise(F.lit(U))
    return p.select("p_partkey", graph.skip_uri(iri_col(F.concat(name, "p_name"))).alias("skip"))


@query(f"""WITH RECURSIVE {_STAR} SELECT '{U}customer/' || c_custkey AS shape, c_name AS label FROM customer WHERE '{U}nation/' || c_nationkey IN (SELECT child FROM star WHERE ancestor = '{U}region/1')""")
def shapes_of_domain(spark, d):
    """Customers stand for shapes, nations and regions for domains of which one includes the next."""
    c = table(spark, d, "customer")
    named = c.select(ref("customer", "c_custkey").alias("s"), F.lit(LABEL).alias("p"), literal_col(F.col("c_name")).alias("o"))
    return said(extract.shapes_of_domain(graph.union(customers(spark, d), named, places(spark, d)), iri(f"{U}region/1"), IN_NATION, SUBCLASS).select("shape")).join(named.select(plain(F.col("s")).alias("shape"), lexical(F.col("o")).alias("label")), "shape")


@query(f"""SELECT p_brand AS library, kind, '{U}part/' || p_partkey AS shape, p_name AS label FROM part JOIN (VALUES ('{U}Part'), ('{U}PROMO')) v(kind) ON kind = '{U}Part' OR p_type = 'PROMO'""")
def shapes_listing(spark, d):
    """Parts stand for shapes, brands for libraries."""
    p = table(spark, d, "part")
    node = ref("part", "p_partkey")
    typed = p.select(F.col("p_brand").alias("library"), node.alias("s"), F.lit(A).alias("p"), iri_col(F.concat(F.lit(U), "p_type")).alias("o"))
    named = p.select(F.col("p_brand").alias("library"), node.alias("s"), F.lit(LABEL).alias("p"), literal_col(F.col("p_name")).alias("o"))
    above = p.select("p_brand", iri_col(F.concat(F.lit(U), "p_type")).alias("s"), F.lit(SUBCLASS).alias("p"), F.lit(PART).alias("o"))
    g = typed.unionByName(named).unionByName(above.withColumnRenamed("p_brand", "library"))
    return extract.listing(g, [PART, PROMO], "library").select("library", plain(F.col("kind")).alias("kind"), plain(F.col("shape")).alias("shape"), "label")


@query(f"""SELECT label, CASE WHEN length(label) >= 8 THEN 'Constant,Identifier,Identifier,Constant,Identifier' ELSE 'Identifier,Identifier' END AS kinds, CASE WHEN length(label) >= 8 THEN substr(label, 1, 8) END AS head,
length(label) >= 8 AS success FROM (SELECT DISTINCT CASE WHEN c_custkey % 7 = 0 THEN left(c_name, 5) ELSE c_name END AS label FROM customer)""")
def label_constants(spark, d):
    """substring_n, constant, extend_if_match and as_identifier together."""
    short = F.when(F.col("c_custkey") % 7 == 0, F.left("c_name", F.lit(5))).otherwise(F.col("c_name"))
    eight = L.as_identifier(L.sequence(L.constant(L.constant_kind(f"{U}Customer")), L.substring_n(8, L.IDENTIFIER)))
    p = L.sequence(L.choice(L.extend_if_match(eight, L.constant_kind(f"{U}Long")), L.constant(L.IDENTIFIER)), L.maybe(L.rest(L.IDENTIFIER)))
    t = L.parse(table(spark, d, "customer").select(short.alias("label")).distinct(), p)
    told = F.filter("tokens", lambda x: x["length"].isNotNull())
    return t.select("label", F.array_join(F.transform(told, lambda x: x["kind"]), ",").alias("kinds"), F.get(F.filter(told, lambda x: x["length"] == 8), F.lit(0))["value"].alias("head"), (F.size(told) > 2).alias("success"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 8 ELSE 0 END AS at FROM customer WHERE c_custkey % 3 <> 2")
def label_error_offsets(spark, d):
    """Labels that fail at the second part, at the first, or not at all."""
    third = F.col("c_custkey") % 3
    label = F.when(third == 0, F.lit("Customer!7")).when(third == 1, F.lit("Client#7")).otherwise(F.col("c_name"))
    t = L.parse(table(spark, d, "customer").select("c_custkey", label.alias("label")), _name_parser())
    return t.select("c_custkey", F.explode(L.error_offsets(F.col("tokens"))).alias("at"))


@query(f"""SELECT '{U}order/' || o_orderkey AS s, '{U}placedBy' AS p, '{U}customer/' || o_custkey AS o FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT '{U}order/' || o_orderkey, '{U}status', o_orderstatus FROM orders WHERE o_orderstatus <> 'F'""")
def match_remaining_graph(spark, d):
    """What is left of the orders' links once those of finished orders are matched."""
    g = orders(spark, d).where(F.col("p").isin(PLACED_BY, STATUS))
    t = Template("finished", ((param("name"), STATUS, literal("F")), (param("name"), PLACED_BY, param("who"))))
    m = match.Matcher(t, g, places(spark, d), check_predicates=True)
    nodes, rows = m.best()
    return said(m.unmatched(nodes, m.edges, rows))


@query(f"SELECT '{U}part/' || p_partkey AS name, p_brand AS brand FROM part WHERE p_type = 'PROMO'")
def match_sub_properties(spark, d):
    """A template's predicate matches one below it; the template has more nodes than any match."""
    said_with, label = iri(f"{U}mark"), iri(f"{U}label")
    up = parts(spark, d).where(F.col("p") == SUBCLASS).unionByName(spark.range(1).select(F.lit(BRAND).alias("s"), F.lit("<http://www.w3.org/2000/01/rdf-schema#subPropertyOf>").alias("p"), F.lit(said_with).alias("o")))
    more = tuple((param(f"x{k}"), label, param(f"x{k + 1}")) for k in range(12))
    t = Template("marked", ((param("name"), A, PROMO), (param("name"), said_with, literal("Brand#0")), (param("name"), iri(f"{U}never"), param("x0")), *more))
    g = parts(spark, d).where(F.col("p").isin(A, BRAND)).withColumn("o", F.when(F.col("p") == BRAND, F.lit(literal("Brand#0"))).otherwise(F.col("o"))).where((F.col("p") == BRAND) | (F.col("o") == PROMO))
    m = match.Matcher(t, g, up, check_predicates=True)
    nodes, rows = m.best()
    name = F.col(f"n{m.nodes.index(param('name'))}")
    return rows.select(name.alias("s")).join(parts(spark, d).where(F.col("p") == BRAND), "s").select(plain(F.col("s")).alias("name"), lexical(F.col("o")).alias("brand"))


# --- query texts in shapes

_RDFS = "http://www.w3.org/2000/01/rdf-schema#"
_TEXTS = f"""@prefix t: <{U}> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix rdfs: <{_RDFS}> .
<{U}> sh:declare [ sh:prefix "t" ; sh:namespace "{U}" ] , [ sh:prefix "rdfs" ; sh:namespace "{_RDFS}" ] .
t:FullPlace a sh:NodeShape ; sh:target [ a sh:SPARQLTarget ; sh:prefixes <{U}> ; sh:select "SELECT ?this WHERE {{ ?this rdfs:subClassOf+ t:World . }}" ] ;
  sh:property [ sh:path [ sh:inversePath rdfs:subClassOf ] ; sh:minCount 6 ] .
t:AloneInNation a sh:NodeShape ; sh:targetClass t:Supplier ; sh:severity sh:Warning ;
  sh:sparql [ a sh:SPARQLConstraint ; sh:prefixes <{U}> ; sh:message "{{$this}} and {{?another}} are in {{?n}}" ;
    sh:select "SELECT DISTINCT $this ?another ?n WHERE {{ {{ $this t:inNation ?n . ?another t:inNation ?n . FILTER (?another != $this) }} $this a ?kind . ?another a ?kind2 . FILTER (?kind = ?kind2) }}" ] .
t:NoBetterNeighbour a sh:NodeShape ; sh:targetClass t:Supplier ;
  sh:sparql [ sh:select "SELECT $this ?value WHERE {{ $this t:inNation ?value ; t:acctbal ?b . FILTER NOT EXISTS {{ ?other t:inNation ?value . ?other t:acctbal ?c . FILTER (?c > ?b) }} }}" ] .
t:OrderRules a sh:NodeShape ; sh:targetClass t:Order ;
  sh:rule [ a sh:SPARQLRule ; sh:prefixes <{U}> ; sh:construct "CONSTRUCT {{ $this a t:UrgentOrder . }} WHERE {{ $this t:priority ?p . FILTER (STRSTARTS(STR(?p), '1-') || ?p IN ('2-HIGH')) }}" ] ,
          [ a sh:JSRule ; sh:jsFunctionName "unknown" ] .
t:UrgentRules a sh:NodeShape ; sh:targetClass t:UrgentOrder ;
  sh:rule [ a sh:SPARQLRule ; sh:construct "CONSTRUCT {{ ?who t:waitsFor $this }} WHERE {{ $this t:placedBy ?who OPTIONAL {{ $this t:status ?s }} FILTER (?s != 'F') }}" ] ;
  sh:rule [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate t:level ; sh:object "now" ] .
"""


def _text_shapes() -> ShapeGraph:
    return ShapeGraph(turtle.read(_TEXTS))


def _suppliers(spark, d):
    s = table(spark, d, "supplier")
    t = Template("supplier", ((param("name"), A, SUPPLIER), (param("name"), IN_NATION, param("nation")), (param("name"), BALANCE, param("bal"))))
    return t.graph(s.select(ref("supplier", "s_suppkey").alias("name"), ref("nation", "s_nationkey").alias("nation"), literal_col(F.col("s_acctbal").cast("decimal(12,2)"), f"{XSD}decimal").alias("bal")))


@query(f"""WITH place AS (SELECT '{U}nation/' || n_nationkey AS s, '{U}region/' || n_regionkey AS o FROM nation UNION SELECT '{U}region/' || r_regionkey, '{U}World' FROM region)
SELECT p.s AS focus, NULL::VARCHAR AS value, 'MinCountConstraintComponent' AS component FROM place p LEFT JOIN place c ON c.o = p.s GROUP BY p.s HAVING count(c.s) < 6""")
def query_text_target(spark, d):
    """A target in query text: everything below World, over a path of any length."""
    return _report(spark, d, _text_shapes().shape(iri(f"{U}FullPlace")), places(spark, d))


@query(f"""SELECT '{U}supplier/' || a.s_suppkey AS focus, '{U}supplier/' || a.s_suppkey AS value,
'{U}supplier/' || a.s_suppkey || ' and {U}supplier/' || b.s_suppkey || ' are in {U}nation/' || a.s_nationkey AS message, 'Warning' AS severity
FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey""")
def query_text_constraint(spark, d):
    """A constraint in query text: a self-join with an inequality for all foci at once, and a message with values."""
    r = validate.Validator(_suppliers(spark, d), PREFIXES).report([_text_shapes().shape(iri(f"{U}AloneInNation"))])
    return r.select(plain(F.col("focus")).alias("focus"), plain(F.col("value")).alias("value"), "message", "severity")


@query(f"""SELECT '{U}supplier/' || s_suppkey AS focus, '{U}nation/' || s_nationkey AS value, 'SPARQLConstraintComponent' AS component FROM supplier a
WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_acctbal::DECIMAL(12,2) > a.s_acctbal::DECIMAL(12,2))""")
def query_text_not_exists(spark, d):
    """A pre-bound focus and outer values inside NOT EXISTS."""
    return _report(spark, d, _text_shapes().shape(iri(f"{U}NoBetterNeighbour")), _suppliers(spark, d))


@query(f"""WITH urgent AS (SELECT * FROM orders WHERE o_orderpriority LIKE '1-%' OR o_orderpriority = '2-HIGH')
SELECT '{U}order/' || o_orderkey AS s, '{_RDF}type' AS p, '{U}UrgentOrder' AS o FROM urgent
UNION SELECT '{U}customer/' || o_custkey, '{U}waitsFor', '{U}order/' || o_orderkey FROM urgent WHERE o_orderstatus <> 'F'
UNION SELECT '{U}order/' || o_orderkey, '{U}level', 'now' FROM urgent""")
def query_text_rules(spark, d):
    """Rules in query text and triple rules that follow from each other; one of an unknown kind is passed over."""
    g = orders(spark, d)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # of the rule that is not read
        rules = infer.rules_of(_text_shapes())
    return said(infer.fixpoint(g, rules, added=True))


# --- solutions with unbound variables

_SEGMENTS = "SELECT '{0}customer/' || c_custkey AS c, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS seg FROM customer".format(U)
_WANTED = f"SELECT '{U}nation/' || n_nationkey AS n, CASE n_nationkey % 3 WHEN 0 THEN 'MACHINERY' WHEN 1 THEN 'FURNITURE' END AS seg FROM nation"


def _segments(spark, d):
    g = customers(spark, d)
    return algebra.optional(algebra.match(g, ("?c", IN_NATION, "?n")), algebra.match(g, ("?c", SEGMENT, "?seg")))


def _wanted(spark, d):
    """What each nation asks for, where it asks for something."""
    n = table(spark, d, "nation")
    asks = F.when(F.col("n_nationkey") % 3 == 0, literal("MACHINERY")).when(F.col("n_nationkey") % 3 == 1, literal("FURNITURE"))
    return n.select(ref("nation", "n_nationkey").alias("n"), asks.alias("seg"))


_BOTH = f"""a AS (SELECT s.c, '{U}nation/' || c_nationkey AS n, s.seg FROM ({_SEGMENTS}) s JOIN customer ON s.c = '{U}customer/' || c_custkey), b AS ({_WANTED})"""


@query(f"WITH {_BOTH} SELECT c, a.n, coalesce(a.seg, b.seg) AS seg FROM a JOIN b ON a.n = b.n AND (a.seg IS NULL OR b.seg IS NULL OR a.seg = b.seg)")
def join_unbound(spark, d):
    """A join over a variable that either side may leave unbound: what is unbound agrees with anything."""
    return said(algebra.join(_segments(spark, d), _wanted(spark, d)))


@query(f"WITH {_BOTH} SELECT c, a.n, coalesce(a.seg, b.seg) AS seg FROM a LEFT JOIN b ON a.n = b.n AND (a.seg IS NULL OR b.seg IS NULL OR a.seg = b.seg)")
def optional_unbound(spark, d):
    return said(algebra.optional(_segments(spark, d), _wanted(spark, d)))


@query(f"WITH {_BOTH} SELECT c, a.n, a.seg FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.n = b.n AND (a.seg IS NULL OR b.seg IS NULL OR a.seg = b.seg))")
def minus_unbound(spark, d):
    return said(algebra.minus(_segments(spark, d), _wanted(spark, d)))


# --- walks by doubling


@query(f"SELECT '{U}supplier/' || a.s_suppkey AS s, '{U}supplier/' || b.s_suppkey AS o FROM supplier a JOIN supplier b ON a.s_suppkey % 7 = b.s_suppkey % 7 AND a.s_suppkey < b.s_suppkey UNION SELECT '{U}supplier/' || a.s_suppkey, '{U}hub' FROM supplier a")
def path_long_chains(spark, d):
    """Seven chains through all suppliers, every one of which leads to a hub: rounds grow with the logarithm of the chains."""
    s = table(spark, d, "supplier")
    last = s.agg(F.max("s_suppkey")).first()[0]
    to = F.when(F.col("s_suppkey") + 7 <= last, F.concat(F.lit(f"<{U}supplier/"), (F.col("s_suppkey") + 7).cast("string"), F.lit(">")))
    g = s.select(ref("supplier", "s_suppkey").alias("s"), F.explode(F.array(to, F.lit(iri(f"{U}hub")))).alias("o")).where("o is not null").withColumn("p", F.lit(iri(f"{U}next")))
    return said(algebra.path_pairs(g, ("+", iri(f"{U}next"))))


@query(f"""WITH RECURSIVE e AS (SELECT '{U}nation/' || n_nationkey AS s, '{U}region/' || n_regionkey AS o FROM nation UNION SELECT '{U}region/' || r_regionkey, '{U}World' FROM region UNION SELECT '{U}World', '{U}region/0'),
r(name, depth) AS (SELECT '{U}nation/3', 0 UNION SELECT o, depth + 1 FROM r JOIN e ON s = name WHERE depth < 6) SELECT name, min(depth)::INT AS depth FROM r GROUP BY name""")
def imports_closure(spark, d):
    """What a nation imports over the places' edges, which have a cycle."""
    g = places(spark, d).select("s", "o").unionByName(spark.range(1).select(F.lit(iri(f"{U}World")).alias("s"), F.lit(iri(f"{U}region/0")).alias("o")))
    return closure.imports(g, iri(f"{U}nation/3")).select(plain(F.col("name")).alias("name"), "depth")


# --- what matches leave, under other predicates

_LEFT = """SELECT '{0}order/' || o_orderkey AS s, '{0}placedBy' AS p, '{0}customer/' || o_custkey AS o FROM orders WHERE o_orderstatus <> 'F'
UNION SELECT '{0}order/' || o_orderkey, '{0}status', o_orderstatus FROM orders WHERE o_orderstatus <> 'F'""".format(U)


def _finished(spark, d, predicate: str, check: bool):
    g = orders(spark, d).where(F.col("p").isin(PLACED_BY, STATUS))
    sub = spark.createDataFrame([(PLACED_BY, f"<{_RDFS}subPropertyOf>", predicate)], "s string, p string, o string")
    t = Template("finished", ((param("name"), STATUS, literal("F")), (param("name"), predicate, param("who"))))
    m = match.Matcher(t, g, sub, check_predicates=check)
    nodes, rows = m.best()
    return said(m.unmatched(nodes, m.edges, rows))


@query(_LEFT)
def match_remaining_sub_property(spark, d):
    """A template's predicate lies on one below it; what is covered there goes."""
    return _finished(spark, d, iri(f"{U}concerns"), True)


@query(_LEFT)
def match_remaining_any_predicate(spark, d):
    """Without a check of predicates a template edge covers whatever lies under it."""
    return _finished(spark, d, iri(f"{U}concerns"), False)


# --- results by shape, choices, identity


_PLACED = Shape(iri(f"{U}placed"), constraints=(("property", Shape(iri(f"{U}placed-p"), path=PLACED_BY, constraints=(("minCount", 1),))),))
_LINED = Shape(iri(f"{U}lined"), targets=(("class", CUSTOMER),), constraints=(("property", Shape(iri(f"{U}lined-p"), path=CONTAINS, constraints=(("minCount", 1),))),))
_OPEN = Shape(iri(f"{U}open"), constraints=(("property", Shape(iri(f"{U}open-p"), path=STATUS, severity="Warning", constraints=(("in", (literal("O"), literal("P"))),))),))


@query(f"""SELECT '{U}placed' AS shape, true AS conforms, 0::BIGINT AS foci, 0::BIGINT AS results
UNION ALL SELECT '{U}lined', count(*) = 0, count(*), count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT '{U}open', true, count(*), count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'P')""")
def results_by_shape(spark, d):
    """Several shapes on the instances of one class, whatever their own targets are; warnings do not break a shape."""
    shapes = [_PLACED, _LINED, _OPEN]
    report = validate.Validator(_orders_and_lines(spark, d), PREFIXES).by_shape(shapes, ORDER)
    out = validate.shape_summary(report, shapes)
    return out.select(plain(F.col("shape")).alias("shape"), "conforms", "foci", "results")


_WAYS = any_of(
    Shape(iri(f"{U}dear"), constraints=(("property", Shape(iri(f"{U}dear-p"), path=CONTAINS, constraints=(("minCount", 2), ("class", PART)))),)),
    Shape(iri(f"{U}watched"), constraints=(("property", Shape(iri(f"{U}watched-p"), path=iri(f"{U}watchedBy"), constraints=(("qualified", (Shape(iri(f"{U}clerk"), constraints=(("class", iri(f"{U}Clerk")),)), 1, None)),))),)),
    Shape(iri(f"{U}urgent"), constraints=(("property", Shape(iri(f"{U}urgent-p"), path=PRIORITY, constraints=(("hasValue", literal("1-URGENT")), ("maxCount", 1)))), ("class", iri(f"{U}Express")), ("class", iri(f"{U}Night")))),
)


@query(f"""WITH bad AS (SELECT '{U}order/' || o_orderkey AS s FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE coalesce(n, 0) < 2)
SELECT s, '{U}watchedBy' AS p, count(*) AS n FROM bad GROUP BY s""")
def repair_smallest_alternative(spark, d):
    """Orders that meet none of three alternatives get the one that takes the fewest triples; the repaired graph validates."""
    shape = _WAYS.targeting("class", ORDER)
    v = validate.Validator(_bag(spark, d), bag=True)
    report = closure.cut(v.report([shape]))
    templates, needs = validate.repair_templates(validate.diff(report, [shape]), {}, shapes=[shape])
    made = closure.cut(validate.repaired(templates, needs, f"{U}new/"))
    still = infer.revalidate(v, shape, report, made)
    # a focus that were still wrong would stand here with another predicate
    rows = made.where(F.col("p") != A).select("s", "p").unionByName(still.select(F.col("focus").alias("s"), F.lit(iri(f"{U}broken")).alias("p")))
    return rows.groupBy(plain(F.col("s")).alias("s"), plain(F.col("p")).alias("p")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH pair AS (SELECT n_nationkey, n_regionkey, n_regionkey = (n_regionkey + 2 * (n_nationkey % 2)) AS same FROM nation)
SELECT n_regionkey, bool_and(n_nationkey % 2 = 0) AS same FROM pair GROUP BY 1""")
def graph_identity(spark, d):
    """Per region, whether its nations as blank nodes are what they are when every odd nation is tied to itself as well."""
    n = table(spark, d, "nation")
    blank = lambda prefix, c: F.concat(F.lit(f"_:{prefix}"), F.col(c).cast("string"))
    rows = []
    for r in n.select("n_regionkey").distinct().collect():  # five regions
        own = n.where(F.col("n_regionkey") == r[0])
        one = own.select(blank("a", "n_nationkey").alias("s"), F.lit(IN_REGION).alias("p"), ref("region", "n_regionkey").alias("o"))
        two = own.select(blank("z", "n_nationkey").alias("s"), F.lit(IN_REGION).alias("p"), ref("region", "n_regionkey").alias("o"))
        tied = own.where("n_nationkey % 2 = 1").select(blank("z", "n_nationkey").alias("s"), F.lit(IN_NATION).alias("p"), blank("z", "n_nationkey").alias("o"))
        rows.append((r[0], graph.isomorphic(one, two.unionByName(tied))))
    return spark.createDataFrame(rows, f"n_regionkey {n.schema['n_regionkey'].dataType.simpleString()}, same boolean")


# --- graphs with numbers for terms


@query("SELECT o_orderkey::VARCHAR AS o, c_custkey::VARCHAR AS c, c_nationkey::VARCHAR AS n FROM orders JOIN customer ON o_custkey = c_custkey")
def encoded_join(spark, d):
    """A join of patterns over numbers; the texts of its solutions are met at the end."""
    e = encoding.Encoded.of(graph.union(customers(spark, d, True), orders(spark, d, True)))
    rows = e.decode(e.bgp(("?o", PLACED_BY, "?c"), ("?c", IN_NATION, "?n")))
    return rows.select(*[F.regexp_extract(c, "/([0-9]+)>$", 1).alias(c) for c in rows.columns])


@query(f"""WITH {_C} SELECT replace(s, '{U}customer/', '{U}client/') AS s, CASE p WHEN '{U}segment' THEN '{U}market' ELSE p END AS p,
CASE o WHEN '{U}nation/1' THEN '{U}land/1' ELSE o END AS o FROM customers WHERE o <> 'MACHINERY'""")
def encoded_replace(spark, d):
    """Subjects, a predicate and an object get other names: the dictionary changes, not the triples."""
    g = customers(spark, d).where(F.col("o") != literal("MACHINERY"))
    named = table(spark, d, "customer").select(ref("customer", "c_custkey").alias("old"), ref("client", "c_custkey").alias("new"))
    more = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in ((SEGMENT, iri(f"{U}market")), (iri(f"{U}nation/1"), iri(f"{U}land/1")))])).alias("x")).select("x.*")
    return said(encoding.Encoded.of(g).replaced(named.unionByName(more)).graph())


# --- parts of a template


def _status_matcher(spark, d):
    g = orders(spark, d).where(F.col("p").isin(PLACED_BY, STATUS))
    t = Template("finished", ((param("name"), STATUS, literal("F")), (param("name"), PLACED_BY, param("who"))))
    return match.Matcher(t, g, places(spark, d), check_predicates=True)


@query(f"""SELECT 3 AS nodes, '{U}placedBy {U}status' AS edges, count(*) AS n FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 2, '{U}status', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, '{U}placedBy', count(*) FROM orders""")
def match_every_part(spark, d):
    """All parts of a template that match, from the whole down to two nodes, and how often each does."""
    m = _status_matcher(spark, d)
    parts_of = []
    for nodes, rows in m.all():
        said_edges = " ".join(sorted(p[1:-1] for s, p, o in m.edges if s in nodes and o in nodes))
        parts_of.append(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(len(nodes)).alias("nodes"), F.lit(said_edges).alias("edges"), "n"))
    return reduce(DataFrame.unionByName, parts_of)


@query(f"""SELECT '{U}order/' || o_orderkey AS name, '{U}customer/' || o_custkey AS who FROM orders
WHERE o_custkey = (SELECT min(o_custkey) FROM orders WHERE o_orderstatus = 'F') AND o_orderstatus = 'F'""")
def match_about_a_node(spark, d):
    """The largest part of a template that matches with a given node in it: the first customer with a finished order."""
    first = table(spark, d, "orders").where("o_orderstatus = 'F'").agg(F.min("o_custkey")).first()[0]
    m = _status_matcher(spark, d)
    nodes, rows = m.best(iri(f"{U}customer/{first}"))
    return rows.select(*[plain(F.col(f"n{m.nodes.index(param(p))}")).alias(p) for p in ("name", "who")])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Which orders have no line item, and why that is wrong."""
    return diff_reasons(spark, d)


def queries() -> dict[str, Query]:
    from . import model_queries  # noqa: F401  it registers its queries here

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from . import model_queries  # noqa: F401

    return dict(_sql)
