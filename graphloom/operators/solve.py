"""Solutions of query texts (``plans.patterns``) as joins over whole graphs.

A pre-bound ``$this`` is a relation of all foci at once: every group that mentions it starts from
that relation, nested ones included, so that a text costs the same joins for one focus or for
all.  EXISTS starts its group from the distinct outer bindings of the variables that it mentions.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..plans.patterns import Query, Text, mentioned
from ..terms import XSD, datatype, iri_col, is_blank, is_iri, is_literal, lang, lexical, literal_col, number, plain
from . import algebra
from .closure import cut

_names = count()


def _text(t: Column) -> Column:
    return literal_col(plain(t))


#: Functions of terms; those in TESTS give truth values.
TESTS = {
    "ISIRI": is_iri, "ISURI": is_iri, "ISBLANK": is_blank, "ISLITERAL": is_literal, "ISNUMERIC": X.is_numeric,
    "STRSTARTS": X.strstarts, "STRENDS": X.strends, "CONTAINS": X.contains, "SAMETERM": X.same_term,
}
CALLS = {
    "STR": _text, "UCASE": X.ucase, "LCASE": X.lcase, "STRLEN": X.strlen, "CONCAT": X.concat, "COALESCE": X.first_bound,
    "DATATYPE": lambda t: iri_col(datatype(t)), "LANG": lambda t: literal_col(lang(t)), "IRI": X.to_iri, "URI": X.to_iri,
    "STRBEFORE": X.strbefore, "STRAFTER": X.strafter, "ENCODE_FOR_URI": X.encode_for_uri,
}


def _constant(e) -> str:
    if e[0] != "term":
        raise ValueError("this argument has to be a constant")
    from ..terms import text_of

    return text_of(e[1])


def value(e, columns: list[str]) -> Column:
    """An expression as a column of terms; null is an error or unbound."""
    kind = e[0]
    if kind == "var":
        return F.col(f"`{e[1]}`") if e[1] in columns else F.lit(None).cast("string")
    if kind == "term":
        return F.lit(e[1])
    if kind == "call" and e[1] == "IF":
        return F.when(truth(e[2][0], columns), value(e[2][1], columns)).otherwise(value(e[2][2], columns))
    if kind == "call" and e[1] == "REPLACE":
        return X.replace(value(e[2][0], columns), *map(_constant, e[2][1:3]))
    if kind == "call" and e[1] == "SUBSTR":
        return X.substr(value(e[2][0], columns), *[int(_constant(a)) for a in e[2][1:]])
    if kind == "call" and e[1].startswith("<"):  # a cast
        return literal_col(plain(value(e[2][0], columns)), e[1][1:-1])
    if kind == "call" and e[1] in CALLS:
        return CALLS[e[1]](*[value(a, columns) for a in e[2]])
    if kind == "op" and e[1] in "+-*/":
        a, b = (number(value(x, columns)) for x in e[2:])
        n = {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[e[1]]
        whole = (n == F.floor(n)) & (F.lit(e[1] != "/"))
        return F.when(whole, X.typed(n.cast("decimal(38,0)"), "integer")).otherwise(X.typed(n, "decimal"))
    return X.truth(truth(e, columns))


def truth(e, columns: list[str]) -> Column:
    """An expression as a truth value; null is an error."""
    kind = e[0]
    if kind == "not":
        return ~truth(e[1], columns)
    if kind == "in":
        return X.one_of(value(e[1], columns), *[value(x, columns) for x in e[2]])
    if kind == "op" and e[1] in ("&&", "||"):
        a, b = (truth(x, columns) for x in e[2:])
        return a & b if e[1] == "&&" else a | b
    if kind == "op" and e[1] not in "+-*/":
        a, b = (value(x, columns) for x in e[2:])
        if e[1] in ("=", "!="):
            return X.equal(a, b) if e[1] == "=" else ~X.equal(a, b)
        x, y = number(a), number(b)
        compare = {"<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[e[1]]
        return F.when(x.isNotNull() & y.isNotNull(), compare(x, y)).when(is_literal(a) & is_literal(b), compare(lexical(a), lexical(b)))
    if kind == "call" and e[1] == "BOUND":
        return value(e[2][0], columns).isNotNull()
    if kind == "call" and e[1] == "REGEX":
        return X.regex(_text(value(e[2][0], columns)), *map(_constant, e[2][1:]))
    if kind == "call" and e[1] == "LANGMATCHES":
        tag = F.lower(lexical(value(e[2][0], columns)))
        wanted = _constant(e[2][1]).lower()
        return tag != "" if wanted == "*" else (tag == wanted) | tag.startswith(f"{wanted}-")
    if kind == "call" and e[1] in TESTS:
        return TESTS[e[1]](*[value(a, columns) for a in e[2]])
    if kind == "call" and e[1] not in CALLS and not e[1].startswith("<") and e[1] not in ("IF", "REPLACE", "SUBSTR"):
        raise ValueError(f"function {e[1]} is not read")
    if kind == "exists":
        raise ValueError("EXISTS is read where it has to hold by itself only")
    v = value(e, columns)
    n = number(v)
    return F.when(datatype(v) == f"{XSD}boolean", lexical(v).isin("true", "1")).when(X.is_numeric(v), n != 0).when(is_literal(v), lexical(v) != "")


def _begin(part, pre: DataFrame | None) -> DataFrame | None:
    return pre if pre is not None and "this" in mentioned(part) else None


def _with(out: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if out is None else algebra.join(out, more)


def group(g: DataFrame, elements: list, begin: DataFrame | None = None, pre: DataFrame | None = None) -> DataFrame:
    """Solutions of a group, from the solutions ``begin``; filters hold for the whole group, wherever they stand."""
    out = _begin(elements, pre) if begin is None else begin
    filters = []
    unit = g.sparkSession.range(1).select(F.lit(1).alias("_matched"))
    for kind, *args in elements:
        if kind == "triples":
            out = algebra.bgp(g, *args[0], start=out)
        elif kind == "group":
            out = _with(out, group(g, args[0], pre=pre))
        elif kind == "union":
            out = _with(out, algebra.union(*[group(g, branch, pre=pre) for branch in args[0]]))
        elif kind == "select":
            out = _with(out, select(g, args[0], pre))
        elif kind == "values":
            out = _with(out, algebra.values(g.sparkSession, *args))
        elif kind == "optional":
            out = algebra.optional(unit if out is None else out, group(g, args[0], pre=pre))
        elif kind == "minus":
            out = algebra.minus(unit if out is None else out, group(g, args[0], pre=pre))
        elif kind == "bind":
            out = unit if out is None else out
            out = algebra.bind(out, args[1], value(args[0], out.columns))
        else:
            filters.append(args[0])
    out = unit if out is None else out
    plain_ones = [truth(e, out.columns) for e in filters if e[0] != "exists"]
    if plain_ones:
        out = out.where(reduce(lambda a, b: a & b, plain_ones))
    for e in filters:
        if e[0] == "exists":
            out = _exists(g, out, e[2], e[1], pre)
    return out


def _exists(g: DataFrame, out: DataFrame, inner: list, negated: bool, pre: DataFrame | None) -> DataFrame:
    names = [c for c in out.columns if c in mentioned(inner)]
    compared = _comparison(inner, names)
    if compared is not None:
        return _exists_beyond(g, out, inner, *compared, negated, pre)
    if not names:
        found = group(g, inner, pre=pre)
        return (algebra.not_exists if negated else algebra.exists)(out.withColumnRenamed("_matched", "_m"), found.limit(1).select(F.lit(1).alias("_found"))).withColumnRenamed("_m", "_matched")
    key = f"_key{next(_names)}"
    keyed = out.withColumn(key, F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])))
    begin = algebra.bound(keyed.select(*names, key).distinct(), key)
    found = group(g, inner, begin, pre).select(key).distinct()
    return keyed.join(found, key, "left_anti" if negated else "left_semi").drop(key)


def _comparison(inner: list, names: list[str]) -> tuple[tuple, str, str, str, list[str]] | None:
    """(filter, operator, inner variable, outer variable, other outer variables) of a group of triples that compares one
    variable of its own with one from outside, which nothing else in it mentions; None for other groups."""
    own = [e for e in inner if e[0] == "triples"]
    filters = [e for e in inner if e[0] == "filter"]
    if not own or len(own) + len(filters) != len(inner):
        return None
    turned = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
    for f in filters:
        e = f[1]
        if e[0] != "op" or e[1] not in turned or e[2][0] != "var" or e[3][0] != "var":
            continue
        rest = mentioned([x for x in inner if x is not f])
        for op, mine, theirs in ((e[1], e[2][1], e[3][1]), (turned[e[1]], e[3][1], e[2][1])):
            others = [c for c in names if c != theirs]
            if mine in mentioned(own) and mine not in names and theirs in names and theirs not in rest and others:
                return f, op, mine, theirs, others
    return None


def _exists_beyond(g: DataFrame, out: DataFrame, inner: list, f: tuple, op: str, mine: str, theirs: str, others: list[str], negated: bool, pre: DataFrame | None) -> DataFrame:
    """EXISTS of a value on one side of an outer one: the furthest value of each outer binding decides, so that no outer row meets all inner ones.

    As in ``truth`` numbers are compared as numbers, and literals of which one is no number by their text.
    """
    key = f"_key{next(_names)}"
    keyed = out.withColumn(key, F.to_json(F.struct(*[F.col(f"`{c}`") for c in others])))
    begin = algebra.bound(keyed.select(*others, key).distinct(), key)
    furthest = F.max if op in (">", ">=") else F.min
    c, b = F.col(f"`{mine}`"), F.col(f"`{theirs}`")
    found = group(g, [e for e in inner if e is not f], begin, pre)
    ends = found.groupBy(key).agg(furthest(number(c)).alias("_number"), furthest(F.when(number(c).isNull(), lexical(c))).alias("_other"), furthest(lexical(c)).alias("_any"))
    beyond = {">": lambda p, q: p > q, ">=": lambda p, q: p >= q, "<": lambda p, q: p < q, "<=": lambda p, q: p <= q}[op]
    holds = lambda p, q: F.coalesce(beyond(p, q), F.lit(False))
    there = F.when(number(b).isNotNull(), holds(F.col("_number"), number(b)) | holds(F.col("_other"), lexical(b))).otherwise(holds(F.col("_any"), lexical(b)))
    return keyed.join(ends, key, "left").where(~there if negated else there).select(*[F.col(f"`{x}`") for x in out.columns])


def _aggregate(e, columns: list[str]) -> Column:
    _, name, distinct, what, between = e
    if name == "COUNT":
        t = F.lit(1) if what is None else value(what, columns)
        return X.typed(F.countDistinct(t) if distinct else F.count(t), "integer")
    t = value(what, columns)
    if name in ("MIN", "MAX"):
        pair = F.when(t.isNotNull(), F.struct(number(t).alias("n"), t.alias("t")))
        return (F.min(pair) if name == "MIN" else F.max(pair))["t"]
    if name in ("SUM", "AVG"):
        n = X.total(t) if name == "SUM" else X.average(t)
        return F.when(n == F.floor(n), X.typed(n.cast("decimal(38,0)"), "integer")).otherwise(X.typed(n, "decimal"))
    return X.sample(t) if name == "SAMPLE" else X.group_concat(t, between)


def _conjunction(elements: list) -> tuple[list, list] | None:
    """(patterns, filters) of a group that has nothing else, nested groups included whose filters are about their own patterns."""
    patterns, filters = [], []
    for kind, *args in elements:
        if kind == "triples":
            patterns += args[0]
        elif kind == "filter" and args[0][0] != "exists":
            filters.append(args[0])
        elif kind == "group":
            inner = _conjunction(args[0])
            if inner is None or not mentioned(inner[1]) <= mentioned(inner[0]):
                return None
            patterns, filters = patterns + inner[0], filters + inner[1]
        else:
            return None
    return patterns, filters


def _divided(patterns: list, hinge: str) -> list[tuple[list, set[str]]]:
    """The parts of the patterns, with their variables, that have no variable but the hinge in common."""
    parts: list[tuple[list, set[str]]] = []
    for p in patterns:
        names, own, rest = mentioned(p), [p], []
        for more, theirs in parts:
            if names & theirs - {hinge}:
                own, names = more + own, names | theirs
            else:
                rest.append((more, theirs))
        parts = [*rest, (own, names)]
    return parts


#: Pairs that a task makes of two sides.
TASK_PAIRS = 1_000_000


def _of_two_sides(g: DataFrame, q: Query, pre: DataFrame | None, texts: bool) -> DataFrame | None:
    """The rows of a SELECT DISTINCT whose patterns fall into two sides that one variable joins; None for others.

    Each side's rows are told apart by themselves, with the set of what the other side is compared with, so that
    a pair is made once, by the last join, and the pairs are neither shuffled nor told apart.  Large groups are dealt over tasks.
    What is compared or said of one term is made on its side: of a pair it is too much code to be compiled.
    """
    plain_ones = _conjunction(q.where) if q.distinct and q.columns and not (q.group_by or q.having or q.order or q.limit is not None) else None
    names = [n for n, e in q.columns if e is None]
    if plain_ones is None or len(names) < len(q.columns):
        return None
    patterns, filters = plain_ones
    ways = [(hinge, parts) for hinge in sorted(set(names)) if len(parts := _divided(patterns, hinge)) == 2 and all(hinge in theirs for _, theirs in parts)]
    if not ways:
        return None
    hinge, parts = min(ways, key=lambda way: max(len(some) for some, _ in way[1]))  # the pairs of an uneven way would be on one of its sides
    (_, left), (_, right) = parts
    own: list[list] = [[], []]
    late, keys = [], None
    for f in filters:
        m = mentioned(f)
        x = [e[1] for e in f[2:] if e[0] == "var"] if f[:2] == ("op", "=") else []
        if m <= left or m <= right:
            own[not m <= left].append(f)
        elif m <= set(names) & (left | right):
            same = f[:2] in (("op", "="), ("op", "!=")) and len([e for e in f[2:] if e[0] == "var"]) == 2
            late.append((f, [e[1] for e in f[2:]] if same else []))
        elif keys is None and len(x) == 2 and m <= left | right and not m & set(names):
            keys = x if x[0] in left else x[::-1]
        else:
            return None
    sides = []
    for k, (some, theirs) in enumerate(parts):
        rows = algebra.bgp(g, *some, start=_begin(some, pre))
        for f in own[k]:
            rows = rows.where(truth(f, rows.columns))
        kept = [F.col(f"`{n}`") for n in dict.fromkeys(names) if n in theirs]
        rows = (rows.groupBy(*kept).agg(F.collect_set(X.same_value(F.col(f"`{keys[k]}`"))).alias(f"_keys{k}")) if keys else rows.select(*kept).distinct())
        mine = [n for n in dict.fromkeys(names) if n in theirs and not (k and n == hinge)]
        made = {f"_same_{n}": X.same_value(F.col(f"`{n}`")) for n in mine if any(n in x for _, x in late)} | ({f"_text_{n}": plain(F.col(f"`{n}`")) for n in mine} if texts else {})
        sides.append(cut(rows.withColumns(made) if made else rows))
    on = f"`{hinge}`"
    sizes = [s.groupBy(F.col(on)).agg(F.count(F.lit(1)).alias(f"_n{k}")) for k, s in enumerate(sides)]
    sizes = cut(sizes[0].join(sizes[1], hinge).select(F.col(on), (F.col("_n0") * F.col("_n1")).alias("_pairs")))
    tasks = max(int(g.sparkSession.conf.get("spark.sql.shuffle.partitions")), min((sizes.agg(F.sum("_pairs")).first()[0] or 0) // TASK_PAIRS + 1, 10_000))
    deals = F.ceil(F.col("_pairs") / TASK_PAIRS).cast("int")
    dealt = sides[0].join(sizes, hinge).withColumn("_deal", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in sides[0].columns if not c.startswith("_keys")]), deals).cast("int")).drop("_pairs").repartition(tasks, F.col(on), "_deal")
    every = sides[1].join(sizes, hinge).withColumn("_deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("_pairs").repartition(tasks, F.col(on), "_deal")
    rows = dealt.join(every, [hinge, "_deal"])
    told = [truth(f, names) if not x else (F.col(f"`_same_{x[0]}`") == F.col(f"`_same_{x[1]}`")) == F.lit(f[1] == "=") for f, x in late]
    for test in [*told, *([F.arrays_overlap("_keys0", "_keys1")] if keys else [])]:
        rows = rows.where(test)
    return rows.select(*[F.col(f"`{n}`") if n in left | right else F.lit(None).cast("string").alias(n) for n in names], *[c for c in rows.columns if c.startswith("_text_")])


def select(g: DataFrame, q: Query, pre: DataFrame | None = None, texts: bool = False) -> DataFrame:
    """The rows of a SELECT: a column for each variable that it names; with ``texts`` also their plain texts (``_text_x``), where they are at hand."""
    rows = _of_two_sides(g, q, pre, texts)
    if rows is not None:
        return rows
    rows = group(g, q.where, pre=pre)
    columns = rows.columns
    computed = {n: e for n, e in q.columns if e is not None}
    if q.group_by or any(e[0] == "aggregate" for e in computed.values()):
        made = [_aggregate(e, columns).alias(n) for n, e in computed.items() if e[0] == "aggregate"]
        for k, h in enumerate(q.having):
            if h[0] == "op" and h[2][0] == "aggregate":
                made.append(_aggregate(h[2], columns).alias(f"_h{k}"))
        missing = [F.lit(None).cast("string").alias(n) for n in q.group_by if n not in columns]
        rows = rows.select("*", *missing).groupBy(*q.group_by).agg(*made)
        for k, h in enumerate(q.having):
            test = ("op", h[1], ("var", f"_h{k}"), h[3]) if h[0] == "op" and h[2][0] == "aggregate" else h
            rows = rows.where(truth(test, rows.columns))
        computed = {n: e for n, e in computed.items() if e[0] != "aggregate"}
    for n, e in computed.items():
        rows = rows.withColumn(n, value(e, rows.columns))
    if q.order:
        keys = [(number(value(e, rows.columns)), value(e, rows.columns), down) for e, down in q.order]
        rows = rows.orderBy(*[k.desc() if down else k.asc() for n, t, down in keys for k in (n, t)])
    names = [n for n, _ in q.columns] or [c for c in rows.columns if not c.startswith("_")]
    rows = rows.select(*[F.col(f"`{n}`") if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names])
    rows = rows.distinct() if q.distinct else rows
    return rows if q.limit is None else rows.limit(q.limit)


def foci_of(foci: DataFrame) -> DataFrame:
    """The relation of all foci as the pre-bound variable."""
    return algebra.bound(foci.select(F.col("focus").alias("this")).distinct())


def solutions(g: DataFrame, text: Text, foci: DataFrame | None = None, texts: bool = False) -> DataFrame:
    return select(g, text.read(), None if foci is None else foci_of(foci), texts)


def triples(g: DataFrame, text: Text, foci: DataFrame | None = None) -> DataFrame:
    """The graph that a CONSTRUCT makes."""
    q = text.read()
    if not q.template:
        raise ValueError("this query text makes no triples")
    return algebra.construct(group(g, q.where, pre=None if foci is None else foci_of(foci)), *q.template)


def messages(found: DataFrame, message: str) -> Column:
    """A message in which {$x} and {?x} are the values of a result."""
    import re

    parts = re.split(r"\{[?$](\w+)\}", message)
    said = [F.lit(p) if k % 2 == 0 else F.coalesce(F.col(f"`_text_{p}`") if f"_text_{p}" in found.columns else plain(F.col(f"`{p}`")), F.lit("")) if p in found.columns else F.lit(f"{{?{p}}}") for k, p in enumerate(parts)]
    return F.concat(*said)
