"""Graphs with numbers for terms: joins move three longs a triple, texts are met at the edges only.

A term's number is a hash of its text, so that tasks agree on it without a counter, and graphs that are
encoded apart can be joined.  Texts whose numbers collide are found when a dictionary is built; they get
numbers from a second hash, and the collided ones are listed with the dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shapes import predicates
from . import algebra
from .closure import SMALL, cut
from .graph import COLUMNS


def number_of(term: Column) -> Column:
    return F.xxhash64(term)


def _second(term: Column) -> Column:
    return F.xxhash64(F.lit("second"), term)


@dataclass
class Encoded:
    """``triples`` (s, p, o as longs), ``terms`` (id, term), ``odd`` (term, id) of terms whose first numbers collide, ``moved`` (id, to) after replacements."""

    triples: DataFrame
    terms: DataFrame
    odd: list[tuple[str, int]]
    moved: DataFrame | None = None

    @classmethod
    def of(cls, g: DataFrame) -> Encoded:
        """The distinct terms are numbered and written once, then the triples."""
        terms = cut(g.select(F.explode(F.array(*COLUMNS)).alias("term")).distinct().select(number_of(F.col("term")).alias("id"), "term"))
        clashing = terms.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
        clashed = terms.join(clashing, "id", "left_semi").select("term", _second(F.col("term")).alias("id"))
        odd = [(r.term, r.id) for r in clashed.limit(1000).collect()]  # of 2^32 terms one pair, by chance
        if odd:
            if len(odd) == 1000:
                raise ValueError("too many terms share their numbers")
            terms = cut(terms.select(_numbered(F.col("term"), odd).alias("id"), "term"))
            if not terms.groupBy("id").count().where("count > 1").isEmpty():
                raise ValueError("two terms share both of their numbers")
        return cls(cut(g.select(*[_numbered(F.col(c), odd).alias(c) for c in COLUMNS]).distinct()), terms, odd)

    def view(self) -> DataFrame:
        """The triples with replaced numbers."""
        if self.moved is None:
            return self.triples
        out = self.triples
        for c in COLUMNS:
            m = self.moved.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
            if c == "p":  # a predicate may stand in a third of all triples: its few distinct numbers are met apart
                m = cut(out.select(F.col("p").alias("_id")).distinct().join(m, "_id"))
            small = m.count() <= SMALL
            out = out.join(F.broadcast(m) if small else m, F.col(c) == F.col("_id"), "left").withColumn(c, F.coalesce("_to", c)).drop("_id", "_to")
        return out.distinct()

    def bgp(self, *patterns: algebra.Pattern) -> DataFrame:
        """Solutions of all patterns together, as numbers; predicates are terms, variables or paths."""
        fixed = sorted({t for s, p, o in patterns for t in (s, o, *([p] if isinstance(p, str) else predicates(p))) if not t.startswith("?")})
        row = self.triples.sparkSession.range(1).select(*[_numbered(F.lit(t), self.odd).alias(f"c{k}") for k, t in enumerate(fixed)]).first() if fixed else ()
        ids = {t: str(n) for t, n in zip(fixed, row)}
        spell = lambda q: ids.get(q, q) if isinstance(q, str) else (q[0], *map(spell, q[1:]))
        return algebra.bgp(self.view(), *[(spell(s), spell(p), spell(o)) for s, p, o in patterns])

    def decode(self, df: DataFrame, *names: str) -> DataFrame:
        """The texts of these columns (of all, if none is named)."""
        for c in names or df.columns:
            t = self.terms.select(F.col("id").alias("_id"), F.col("term").alias("_term"))
            df = df.join(t, F.col(f"`{c}`") == F.col("_id"), "left").withColumn(c, F.col("_term")).drop("_id", "_term")
        return df

    def graph(self) -> DataFrame:
        return self.decode(self.view())

    def replaced(self, mapping: DataFrame) -> Encoded:
        """Terms (old, new) replaced in every position: the dictionary is written anew, no text of a triple moves."""
        m = mapping.select(F.col("old").alias("term"), F.col("new").alias("_new"))
        changed = cut(self.terms.join(F.broadcast(m) if m.count() <= SMALL else m, "term").select("id", F.col("_new").alias("term"), _numbered(F.col("_new"), self.odd).alias("to")))
        terms = self.terms.join(changed.select("id"), "id", "left_anti").unionByName(changed.select(F.col("to").alias("id"), "term")).distinct()
        moved = changed.select("id", "to")
        if self.moved is not None:
            again = self.moved.join(moved.select(F.col("id").alias("to"), F.col("to").alias("_to")), "to", "left").select("id", F.coalesce("_to", "to").alias("to"))
            moved = moved.unionByName(again)
        return Encoded(self.triples, cut(terms), self.odd, cut(moved.where("id <> to")))


def _numbered(term: Column, odd: list[tuple[str, int]]) -> Column:
    if not odd:
        return number_of(term)
    known = reduce(lambda c, x: c.when(term == x[0], F.lit(x[1])), odd[1:], F.when(term == odd[0][0], F.lit(odd[0][1])))
    return known.otherwise(number_of(term))
