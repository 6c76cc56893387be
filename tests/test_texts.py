"""Query texts in shapes, rules round by round, solutions with unbound variables, matching edge by edge."""

import itertools
import random
import warnings

import pytest
from pyspark.sql import functions as F

from graphloom.operators import algebra, closure, infer, match, solve, validate
from graphloom.plans.patterns import Text
from graphloom.plans.shapes import Shape, ShapeGraph
from graphloom.plans.template import Template
from graphloom.sources import turtle
from graphloom.terms import A, SUBPROPERTY, iri, literal, param

E = "urn:e#"
HEAD = f"@prefix e: <{E}> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"


def frame(spark, text):
    return spark.createDataFrame(turtle.read(HEAD + text), "s string, p string, o string")


def e(name):
    return iri(E + name)


def ask(spark, g, text, foci=None):
    rows = solve.solutions(g, Text(text, (("e", E), ("rdfs", RDFS))), None if foci is None else spark.createDataFrame([(e(f),) for f in foci], "focus string"))
    return sorted(tuple(None if x is None else x[len(E) + 1 : -1] if x.startswith(f"<{E}") else x for x in r) for r in rows.collect())


@pytest.fixture(scope="module")
def g(spark):
    return closure.cut(frame(spark, """e:a e:in e:x ; e:n 3 ; e:next e:b . e:b e:in e:x ; e:n 5 ; e:next e:c ; e:off true . e:c e:in e:y ; e:n 5 . e:d e:in e:y ; rdfs:label "dee"@en , "d" ."""))


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_nothing_beyond_is_told_from_the_furthest(spark, capsys, op):
    """Every row of a group met every other one of it.  Numbers go as numbers, other literals by their text, the rest is an error."""
    values = ['"3"', '"20"', '"x"', '"3.0"', '"NaN"', '"Z"@en', "<urn:e#i>", '"-1"', '"20"']
    rows = [(e(f"s{k}"), p, o) for k, v in enumerate(values) for p, o in ((e("in"), e(f"g{k // 6}")), (e("n"), v))]
    g = spark.createDataFrame([*rows, (e("s8"), e("n"), '"4"')], "s string, p string, o string")
    have = [(r[0], e(f"g{k // 6}"), v) for k, v in enumerate(values) for r in [(e(f"s{k}"),)]] + [(e("s8"), e("g1"), '"4"')]
    both = spark.createDataFrame(have, "s string, q string, v string")
    other = both.select(F.col("s").alias("t"), "q", F.col("v").alias("w"))
    holds = both.join(other, "q").where(solve.truth(("op", op, ("var", "w"), ("var", "v")), ["v", "w"])).select("s", "v").distinct().collect()
    for start in ("EXISTS", "NOT EXISTS"):
        text = f"SELECT ?s ?v WHERE {{ ?s e:in ?q ; e:n ?v . FILTER {start} {{ ?t e:in ?q . ?t e:n ?w . FILTER (?v {turned[op]} ?w) }} }}"
        found = solve.solutions(g, Text(text, (("e", E),)))
        want = {tuple(r) for r in holds} if start == "EXISTS" else {(s, v) for s, _, v in have} - {tuple(r) for r in holds}
        assert sorted(map(tuple, found.collect())) == sorted(want)
        found.explain()
        assert ("max(" if op in (">", ">=") else "min(") in capsys.readouterr().out


turned = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


@pytest.mark.parametrize(
    "text,want",
    [
        ("SELECT ?s WHERE { ?s e:in e:x . FILTER (?s != e:a) }", [("b",)]),
        ("SELECT ?s ?t WHERE { ?s e:next+ ?t }", [("a", "b"), ("a", "c"), ("b", "c")]),
        ("SELECT ?t WHERE { e:a e:next/e:next|^e:next ?t }", [("c",)]),
        ("SELECT ?s WHERE { ?s e:next* e:c }", [("a",), ("b",), ("c",)]),
        ("SELECT ?s WHERE { ?s e:in ?p . FILTER NOT EXISTS { ?s e:off true } FILTER EXISTS { ?s e:n ?n . FILTER (?n > 2 && ?n * 2 < 11) } }", [("a",), ("c",)]),
        ("SELECT ?s ?o WHERE { ?s e:in ?p OPTIONAL { ?s e:next ?o } FILTER (!BOUND(?o)) }", [("c", None), ("d", None)]),
        ("SELECT ?s WHERE { { ?s e:n 3 } UNION { ?s e:off ?v } }", [("a",), ("b",)]),
        ("SELECT ?s WHERE { ?s e:in e:x MINUS { ?s e:off true } MINUS { e:d e:in ?nothing } }", [("a",)]),
        ("SELECT ?s ?l WHERE { ?s rdfs:label ?x . BIND (UCASE(STR(?x)) AS ?l) FILTER (LANG(?x) = 'en') }", [("d", '"DEE"')]),
        ("SELECT ?p (COUNT(?s) AS ?many) WHERE { ?s e:in ?p } GROUP BY ?p HAVING (COUNT(?s) > 1) ORDER BY ?p", [("x", '"2"^^<http://www.w3.org/2001/XMLSchema#integer>'), ("y", '"2"^^<http://www.w3.org/2001/XMLSchema#integer>')]),
        ("SELECT ?s WHERE { VALUES (?s ?p) { (e:a UNDEF) (UNDEF e:y) } ?s e:in ?p }", [("a",), ("c",), ("d",)]),
        ("SELECT ?s WHERE { ?s e:n ?n . { SELECT (MAX(?m) AS ?n) WHERE { ?t e:n ?m } } }", [("b",), ("c",)]),
        ("SELECT DISTINCT ?p WHERE { ?s e:in ?p ; e:n [] . # a remark\n FILTER (?p IN (e:x, e:z)) }", [("x",)]),
        ("SELECT ?s WHERE { ?s e:next ?t . ?t e:n ?n . FILTER REGEX(STR(?s), '#B$', 'i') }", [("b",)]),
    ],
)
def test_texts(spark, g, text, want):
    assert ask(spark, g, text) == want


def test_a_focus_that_is_bound_before(spark, g):
    # only the focus tells which other is meant: the inner groups start from all foci at once
    assert ask(spark, g, "SELECT $this ?o WHERE { { ?o e:in ?p . FILTER (?o != $this) } $this e:in ?p }", ["a", "c"]) == [("a", "b"), ("c", "d")]
    assert ask(spark, g, "SELECT $this WHERE { $this e:n ?n . FILTER NOT EXISTS { ?o e:n ?m . FILTER (?m > ?n && ?o != $this) } }", ["a", "b", "c", "d"]) == [("b",), ("c",)]
    assert ask(spark, g, "SELECT $this WHERE { FILTER NOT EXISTS { $this e:next ?x } }", ["a", "c", "z"]) == [("c",), ("z",)]
    assert ask(spark, g, "SELECT $this ?n WHERE { { SELECT $this (COUNT(?x) AS ?n) WHERE { $this e:next+ ?x } GROUP BY $this } }", ["a", "c"]) == [("a", '"2"^^<http://www.w3.org/2001/XMLSchema#integer>')]


@pytest.mark.parametrize("text", ["SELECT ?s WHERE { ?s q:x ?o }", "ASK { ?s ?p ?o }", "SELECT ?s WHERE { ?s ?p }", "SELECT ?s WHERE { GRAPH ?g { ?s ?p ?o } }", "SELECT ?s { ?s ?p ?o } SELECT", "SELECT ?s WHERE { ?s ?p 'x }"])
def test_what_is_not_read_is_an_error(text):
    with pytest.raises(ValueError, match="query text, line 1"):
        Text(text, (("e", E),)).read()


SHAPES = HEAD + """
e:Deep a sh:NodeShape ; sh:target [ a sh:SPARQLTarget ; sh:select "SELECT ?this WHERE { ?this rdfs:subClassOf+ <urn:e#Top> }" ] ; sh:property [ sh:path rdfs:label ; sh:minCount 1 ] .
e:Same a sh:NodeShape ; sh:targetClass e:Unit ; sh:severity sh:Info ; sh:sparql [ sh:message "{$this} like {?other}" ; sh:select "SELECT $this ?other WHERE { $this e:symbol ?s . ?other e:symbol ?s . FILTER (?other != $this) }" ] , [ sh:deactivated true ; sh:select "SELECT $this WHERE { $this ?p ?o }" ] .
e:Paths a sh:PropertyShape ; sh:path ( e:has e:part ) ; sh:targetClass e:Unit ; sh:sparql [ sh:select "SELECT $this ?value WHERE { $this $PATH ?value . FILTER (ISLITERAL(?value)) }" ] .
"""


def test_targets_and_constraints(spark):
    sg = ShapeGraph(turtle.read(SHAPES), prefixes={"e": E})
    data = frame(spark, """e:Unit rdfs:subClassOf e:Mid . e:Mid rdfs:subClassOf e:Top ; rdfs:label "m" .
        e:u a e:Unit ; e:symbol "k" ; e:has e:h . e:v a e:Unit ; e:symbol "k" . e:w a e:Unit ; e:symbol "z" . e:h e:part "lit", e:p .""")
    report = validate.Validator(data).report([sg.shape(e(n)) for n in ("Deep", "Same", "Paths")])
    got = {(r.focus, r.value, r.component, r.severity, r.message) for r in report.collect()}
    assert got == {
        (e("Unit"), None, "MinCountConstraintComponent", "Violation", None),
        (e("u"), e("u"), "SPARQLConstraintComponent", "Info", f"{E}u like {E}v"),
        (e("v"), e("v"), "SPARQLConstraintComponent", "Info", f"{E}v like {E}u"),
        (e("u"), '"lit"', "SPARQLConstraintComponent", "Violation", None),
    }


# --- rules


def naive(triples, rules):
    """The fixpoint of rules as functions of a set of triples."""
    known = set(triples)
    while True:
        new = set().union(*(r(known) for r in rules)) - known
        if not new:
            return known
        known |= new


def test_rounds_follow_what_is_new(spark):
    """A mark walks along a chain, and each later round starts from one triple."""
    g = frame(spark, " ".join(f"e:n{k} e:next e:n{k + 1} ." for k in range(8)) + " e:n0 e:on e:yes . e:q e:other e:q .")
    walk = infer.construct_rule([("?a", e("on"), e("yes")), ("?a", e("next"), "?b")], ("?b", e("on"), e("yes")))
    read = []

    class Watched(infer.PatternRule):
        def next(self, at):
            read.append((at.delta.count(), at.touched))
            return super().next(at)

    out = infer.fixpoint(g, [Watched(walk.where, walk.template)], limit=None)
    assert out.where(F.col("p") == e("on")).count() == 9
    assert read == [(1, {e("on")})] * 8


def test_a_text_reads_its_own_predicates_and_what_is_added_is_told(spark):
    shape = Shape("s", targets=(("subjects", e("p")),))
    rule = infer.TextRule(shape, Text("CONSTRUCT { ?x e:q $this } WHERE { $this e:p ?x OPTIONAL { $this e:r ?s } FILTER NOT EXISTS { $this e:off ?t } }", (("e", E),)))
    assert rule.reads() == {e("p"), e("r"), e("off")}
    every = infer.TextRule(shape, Text("CONSTRUCT { ?x e:q $this } WHERE { $this e:p ?x OPTIONAL { $this ?any ?s } }", (("e", E),)))
    assert infer.ANY in every.reads()
    g = frame(spark, "e:a e:p e:b . e:c e:p e:d ; e:off true . e:f e:p e:h . e:h e:q e:f .")
    assert {tuple(r) for r in infer.fixpoint(g, [rule], added=True).collect()} == {(e("b"), e("q"), e("a"))}
    assert infer.fixpoint(g, [rule]).count() == g.count() + 1
    assert infer.fixpoint(g.limit(0), [], added=True).count() == 0


def test_rules_equal_a_naive_fixpoint(spark):
    rng = random.Random(6)
    nodes = [f"n{k}" for k in range(12)]
    triples = {(e(rng.choice(nodes)), e(rng.choice(["p", "q"])), e(rng.choice(nodes))) for _ in range(25)}
    g = spark.createDataFrame(sorted(triples), "s string, p string, o string")
    rules = [
        infer.construct_rule([("?a", e("p"), "?b"), ("?b", e("q"), "?c")], ("?a", e("r"), "?c")),
        infer.construct_rule([("?a", e("r"), "?b"), ("?b", e("r"), "?c")], ("?a", e("p"), "?c")),
        infer.construct_rule([("?a", ("+", e("r")), "?b"), ("?b", e("p"), "?a")], ("?a", e("loop"), "?b")),
        infer.construct_rule([("?a", e("loop"), "?b"), ("?x", "?any", "?a")], ("?x", e("sees"), "?b")),
    ]

    def pairs(t, p):
        return {(s, o) for s, q, o in t if q == e(p)}

    def reach(t):
        got = pairs(t, "r")
        while True:
            more = got | {(a, d) for a, b in got for c, d in got if b == c}
            if more == got:
                return got
            got = more

    plain = [
        lambda t: {(a, e("r"), d) for a, b in pairs(t, "p") for c, d in pairs(t, "q") if b == c},
        lambda t: {(a, e("p"), d) for a, b in pairs(t, "r") for c, d in pairs(t, "r") if b == c},
        lambda t: {(a, e("loop"), b) for a, b in reach(t) if (b, a) in pairs(t, "p")},
        lambda t: {(x, e("sees"), b) for a, b in pairs(t, "loop") for x, _, o in t if o == a},
    ]
    out = {tuple(r) for r in infer.fixpoint(g, rules, limit=None).select("s", "p", "o").collect()}
    assert out == naive(triples, plain)


def test_conditions_that_can_become_false_wait(spark):
    """A rule for those without a mark runs after the rule that marks."""
    text = HEAD + """e:S a sh:NodeShape ; sh:targetClass e:T ; sh:rule
      [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate e:is ; sh:object e:Bare ; sh:condition [ sh:property [ sh:path e:mark ; sh:maxCount 0 ] ] ] ,
      [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate e:mark ; sh:object e:yes ; sh:condition [ sh:property [ sh:path e:seen ; sh:minCount 1 ] ] ] ,
      [ a sh:SPARQLRule ; sh:construct "CONSTRUCT { ?x e:seen $this } WHERE { $this e:next ?x }" ] ."""
    rules = infer.rules_of(ShapeGraph(turtle.read(text), prefixes={"e": E}))
    assert [len(s) for s in infer.strata(rules)] == [2, 1]
    g = frame(spark, "e:a a e:T ; e:next e:b . e:b a e:T ; e:next e:c . e:c a e:T .")
    out = {tuple(r) for r in infer.fixpoint(g, rules).where(F.col("p").isin(e("is"), e("mark"))).collect()}
    assert out == {(e("b"), e("mark"), e("yes")), (e("c"), e("mark"), e("yes")), (e("a"), e("is"), e("Bare"))}


def test_foci_that_new_triples_touch(spark):
    """A condition on a value's type becomes true in a later round, through a new subclass as well."""
    text = HEAD + """e:S a sh:NodeShape ; sh:targetSubjectsOf e:has ; sh:rule [ sh:subject sh:this ; sh:predicate e:ok ; sh:object e:yes ;
        sh:condition [ sh:property [ sh:path e:has ; sh:qualifiedMinCount 1 ; sh:qualifiedValueShape [ sh:class e:Good ] ] ] ; a sh:TripleRule ] ."""
    rules = infer.rules_of(ShapeGraph(turtle.read(text)))
    typed = infer.construct_rule([("?a", e("likes"), "?b")], ("?b", A, e("Fine")))
    lifted = infer.construct_rule([("?x", A, e("Fine"))], (e("Fine"), f"<{RDFS}subClassOf>", e("Good")))
    g = frame(spark, "e:a e:has e:v . e:b e:has e:w . e:z e:likes e:v .")
    out = infer.fixpoint(g, [*rules, typed, lifted], limit=None).where(F.col("p") == e("ok"))
    assert [r.s for r in out.collect()] == [e("a")]


def test_unstratified_rules_warn(spark):
    text = HEAD + """e:S a sh:NodeShape ; sh:targetClass e:T ; sh:rule
      [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate e:p ; sh:object e:x ; sh:condition [ sh:property [ sh:path e:q ; sh:maxCount 0 ] ] ] ,
      [ a sh:TripleRule ; sh:subject sh:this ; sh:predicate e:q ; sh:object e:x ; sh:condition [ sh:property [ sh:path e:p ; sh:maxCount 0 ] ] ] ."""
    with pytest.warns(UserWarning, match="all rules run together"):
        assert len(infer.strata(infer.rules_of(ShapeGraph(turtle.read(text))))) == 1
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert infer.fixpoint(frame(spark, "e:a a e:T ."), infer.rules_of(ShapeGraph(turtle.read(text)))).count() == 3


# --- unbound variables


def test_joins_of_unbound_variables(spark):
    rng = random.Random(8)
    pick = lambda xs: rng.choice([None, *xs])
    left = [(pick("ab"), pick("xy"), str(k)) for k in range(12)] + [(None, None, "n")] * 2
    right = [(pick("ab"), pick("xy"), f"r{k}") for k in range(9)]
    a = spark.createDataFrame(left, "u string, v string, k string")
    b = spark.createDataFrame(right, "u string, v string, w string")
    agree = lambda l, r: all(x is None or y is None or x == y for x, y in zip(l[:2], r[:2]))
    overlap = lambda l, r: any(x is not None and y is not None for x, y in zip(l[:2], r[:2]))
    merged = lambda l, r: (l[0] or r[0], l[1] or r[1], l[2], r[2])
    order = lambda rows: sorted(map(str, rows))
    got = lambda df: order(tuple(r) for r in df.collect())
    joined = [merged(l, r) for l, r in itertools.product(left, right) if agree(l, r)]
    assert got(algebra.join(a, b).select("u", "v", "k", "w")) == order(joined)
    alone = [(*l, None) for l in left if not any(agree(l, r) for r in right)]
    assert got(algebra.optional(a, b).select("u", "v", "k", "w")) == order(joined + alone)
    assert got(algebra.exists(a, b)) == order(l for l in left if any(agree(l, r) for r in right))
    assert got(algebra.not_exists(a, b)) == order(l for l in left if not any(agree(l, r) for r in right))
    assert got(algebra.minus(a, b)) == order(l for l in left if not any(agree(l, r) and overlap(l, r) for r in right))
    for df in (algebra.join(a, b), algebra.optional(a, b), algebra.minus(a, b)):
        assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()


def test_bound_variables_need_no_masks(spark):
    g = frame(spark, "e:a e:p e:b . e:b e:q e:c .")
    plan = algebra.bgp(g, ("?x", e("p"), "?y"), ("?y", e("q"), "?z"))._jdf.queryExecution().toString()
    assert "explode" not in plan.lower() and "_key0" not in plan


# --- closures and matches


def test_doubling_needs_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(closure, "cut", lambda df, cut=closure.cut: written.append(1) or cut(df))
    edges = [(f"n{k}", f"n{k + 1}") for k in range(300)] + [(f"c{k}", f"c{(k + 1) % 6}") for k in range(6)] + [("hub", f"h{k}") for k in range(40)] + [("h1", "hub")]
    pairs = closure.reach(spark.createDataFrame(edges, "s string, o string"))
    found = {tuple(r) for r in pairs.collect()}
    want = {(f"n{a}", f"n{b}") for a in range(301) for b in range(a + 1, 301)} | {(f"c{a}", f"c{b}") for a in range(6) for b in range(6)} | {("hub", f"h{k}") for k in range(40)} | {("hub", "hub"), ("h1", "hub")} | {("h1", f"h{k}") for k in range(40)}
    assert found == want and pairs.count() == len(want) and len(written) <= 11


def test_long_chains_are_not_written_as_pairs(spark, monkeypatch):
    """Chains that lead to a hub, into each other and into a circle; a circle alone, a loop: the rows written grow with the nodes."""
    monkeypatch.setattr(closure, "MANY", 100, raising=False)
    monkeypatch.setattr(closure, "BLOCK", 16, raising=False)
    rows = []
    monkeypatch.setattr(closure, "cut", lambda df, cut=closure.cut: (c := cut(df), rows.append(c.count()))[0])
    edges = {(f"{c}{k}", f"{c}{k + 1}") for c in "ab" for k in range(150)} | {(f"{c}{k}", "hub") for c in "ab" for k in range(151)}
    edges |= {("a90", "b20"), ("a70", "b60"), ("a99", "c2"), ("x", "x"), ("b5", "b3"), ("d0", "a140")} | {(f"{c}{k}", f"{c}{(k + 1) % 5}") for c in "ce" for k in range(5)}
    after: dict[str, set[str]] = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    want = set()
    for a in after:
        front = seen = set(after[a])
        while front:
            front = {z for y in front for z in after.get(y, ())} - seen
            seen = seen | front
        want |= {(a, b) for b in seen}
    pairs = closure.reach(spark.createDataFrame(sorted(edges), "s string, o string"))
    found = [tuple(r) for r in pairs.collect()]
    assert set(found) == want and len(found) == len(want)
    assert max(rows) < len(want) / 10


@pytest.mark.parametrize("check", [True, False])
def test_what_a_match_covers_goes_whatever_its_predicate(spark, check):
    onto = frame(spark, "e:sub rdfs:subPropertyOf e:top .")
    assert onto.where(F.col("p") == SUBPROPERTY).count() == 1
    g = frame(spark, "e:a e:sub e:b ; e:far e:c . e:c e:sub e:d .")
    m = match.Matcher(Template("t", ((param("x"), e("top"), param("y")),)), g, onto, check_predicates=check)
    nodes, rows = m.best()
    left = {tuple(r) for r in m.unmatched(nodes, m.edges, rows).collect()}
    assert left == ({(e("a"), e("far"), e("c"))} if check else set())


def test_a_large_template_takes_a_bounded_number_of_steps(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(match, "cut", lambda df, cut=match.cut: steps.append(1) or cut(df))
    chain = [(param(f"x{k}"), e("next"), param(f"x{k + 1}")) for k in range(19)]
    g = frame(spark, " ".join(f"e:n{k} e:next e:n{k + 1} ." for k in range(19)))
    m = match.Matcher(Template("long", tuple(chain)), g, frame(spark, "e:A rdfs:subClassOf e:B ."), check_predicates=True)
    nodes, rows = m.best()
    assert len(nodes) == 20 and [tuple(r) for r in rows.collect()] == [tuple(e(f"n{n[len('<urn:___param___#x'):-1]}") for n in nodes)]
    assert len(steps) <= 23


def test_pairs_of_two_sides_are_made_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(solve, "TASK_PAIRS", 7)
    monkeypatch.setattr(solve, "cut", lambda df: kept.append(closure.cut(df)) or kept[-1])
    rows = [(f"{k}", f"{k % 3}", kind) for k in range(20) for kind in (['"1"^^xsd:integer', "e:K"] if k % 2 else ['"1.0"^^xsd:decimal', "e:K"] if k % 5 else ['"1"'])]
    g = frame(spark, "@prefix xsd: <http://www.w3.org/2001/XMLSchema#> . " + " ".join(f"e:x{k} e:in e:n{n} ; e:kind {kind} ." for k, n, kind in rows)).distinct()
    text = Text("SELECT DISTINCT ?a ?b ?n WHERE { { ?a e:in ?n . ?b e:in ?n . FILTER (?a != ?b) } ?a e:kind ?k . ?b e:kind ?l . FILTER (?k = ?l) }", (("e", E),))
    found = solve.solutions(g, text)
    # what is known of the two sides is joined; nothing tells the pairs apart afterwards
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {(a, b, n) for a, n, k in rows for b, m, l in rows if a != b and n == m and (k == l or '"1"' not in (k, l) and "e:K" not in (k, l))}
    assert sorted(tuple(r) for r in found.collect()) == sorted((e(f"x{a}"), e(f"x{b}"), e(f"n{n}")) for a, b, n in want)
    assert max(x.count() for x in kept) == 20
    assert max(map(len, found.rdd.glom().collect())) < found.count()
