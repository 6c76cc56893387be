"""Graphs with numbers for terms, and replacements that leave the triples alone."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import algebra, encoding, graph
from graphloom.sources import turtle

E = "urn:e#"


def frame(spark, text):
    return spark.createDataFrame(turtle.read(f"@prefix e: <{E}> .\n" + text), "s string, p string, o string")


def e(name):
    return f"<{E}{name}>"


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


@pytest.mark.parametrize("collide", [False, True])
def test_numbers_say_what_texts_say(spark, monkeypatch, collide):
    if collide:
        monkeypatch.setattr(encoding, "number_of", lambda t: F.pmod(F.xxhash64(t), F.lit(4)))
    g = frame(spark, """e:a e:p e:b . e:b e:p e:c ; e:q "x", 5 . e:c e:q "x" . e:p e:q e:a .""")
    coded = encoding.Encoded.of(g.unionByName(g))
    assert bool(coded.odd) == collide and dict(coded.triples.dtypes)["o"] == "bigint"
    assert rows(coded.graph(), "s", "p", "o") == rows(g, "s", "p", "o")
    for patterns in ([("?x", e("p"), "?y"), ("?y", e("q"), "?v")], [("?x", "?p", "?y"), ("?p", e("q"), "?z")], [("?x", ("+", e("p")), e("c"))], [("?x", e("q"), '"x"')]):
        names = sorted(algebra.bgp(g, *patterns).columns)
        assert rows(coded.decode(coded.bgp(*patterns)), *names) == rows(algebra.bgp(g, *patterns), *names)


def test_replacements_merge_terms(spark):
    g = frame(spark, "e:a e:p e:b . e:c e:p e:b . e:b e:r e:d .")
    mapping = spark.createDataFrame([(e("a"), e("c")), (e("b"), e("new")), (e("p"), e("r")), ("<urn:none>", "<urn:some>")], "old string, new string")
    coded = encoding.Encoded.of(g).replaced(mapping)
    want = {(e("c"), e("r"), e("new")), (e("new"), e("r"), e("d"))}
    assert {tuple(r) for r in coded.graph().collect()} == want == {tuple(r) for r in graph.replace_nodes(g, mapping).collect()} and coded.graph().count() == 2
    assert rows(coded.decode(coded.bgp(("?x", e("r"), "?y"), ("?y", e("r"), "?z"))), "x", "z") == [(e("c"), e("d"))]
    again = coded.replaced(spark.createDataFrame([(e("new"), e("newer"))], "old string, new string"))
    assert {tuple(r) for r in again.graph().collect()} == {(e("c"), e("r"), e("newer")), (e("newer"), e("r"), e("d"))}


def test_predicates_are_met_apart(spark):
    """A mapping joins the few distinct predicates, not the predicate of every triple."""
    g = spark.range(2000).select(F.concat(F.lit("<s"), "id", F.lit(">")).alias("s"), F.lit("<p>").alias("p"), F.lit('"v"').alias("o"))
    mapping = spark.createDataFrame([("<p>", "<q>")], "old string, new string")
    out = graph.replace_nodes(g, mapping)
    assert out.select("p").distinct().collect()[0].p == "<q>" and out.count() == 2000
    assert "hashpartitioning(p" not in out._jdf.queryExecution().executedPlan().toString()
