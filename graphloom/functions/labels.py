"""Parser combinators for labels that compile to column expressions; no Python runs on the data.

A parser is a function from a text column to a column of tokens
``array<struct<value, kind, token, length, error, id>>``.  ``kind`` is Identifier, Constant,
Delimiter or Null; an error token is Null with a message.  Intermediate results are bound with a
lambda over a one-element array, so that an expression is evaluated once however often it is used.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "struct<value:string,kind:string,token:string,length:int,error:string,id:string>"
#: (kind, token text); no text means that the token is what was read.
Kind = tuple[str, str | None]
IDENTIFIER: Kind = ("Identifier", None)
DELIMITER: Kind = ("Delimiter", None)


def constant_kind(iri: str) -> Kind:
    return ("Constant", iri)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _token(value, kind: str, token, length, error=None, id=None) -> Column:
    as_col = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(as_col(value, "string").alias("value"), F.lit(kind).alias("kind"), as_col(token, "string").alias("token"), as_col(length, "int").alias("length"), as_col(error, "string").alias("error"), as_col(id, "string").alias("id"))


def _read(value: Column, kind: Kind, id) -> Column:
    return F.array(_token(value, kind[0], value if kind[1] is None else kind[1], F.length(value), id=id))


def _refused(what, text: Column, size: int, id=None) -> Column:
    return F.array(_token(None, "Null", None, 0, F.concat(F.lit(f"Expected {what}, got "), F.substring(text, 1, size)), id))


def ok(tokens: Column) -> Column:
    """At least one token and no error."""
    return (F.size(tokens) > 0) & ~F.exists(tokens, lambda t: t["error"].isNotNull())


def consumed(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0), lambda a, t: a + t["length"])


def _after(text: Column, n: Column) -> Column:
    return F.substring(text, n + 1, F.length(text))


@dataclass(frozen=True)
class Parser:
    """``kind`` and ``args`` name the parser for JSON; ``run`` builds its column."""

    kind: str
    args: dict
    run: Callable[[Column], Column]

    def __call__(self, text: Column) -> Column:
        return self.run(text)

    def to_json(self) -> str:
        return json.dumps(_plain(self))


def _plain(x):
    if isinstance(x, Parser):
        return {"parser": x.kind, "args": {k: _plain(v) for k, v in x.args.items()}}
    return [_plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def string(s: str, kind: Kind, id: str | None = None) -> Parser:
    return Parser("string", {"s": s, "kind": kind, "id": id}, lambda t: F.when(t.startswith(s), _read(F.lit(s), kind, id)).otherwise(_refused(s, t, len(s), id)))


def rest(kind: Kind, id: str | None = None) -> Parser:
    return Parser("rest", {"kind": kind, "id": id}, lambda t: _read(t, kind, id))


def substring_n(n: int, kind: Kind, id: str | None = None) -> Parser:
    return Parser("substring_n", {"n": n, "kind": kind, "id": id}, lambda t: F.when(F.length(t) >= n, _read(F.substring(t, 1, n), kind, id)).otherwise(_refused(f"{n} characters", t, n, id)))


def regex(r: str, kind: Kind, id: str | None = None) -> Parser:
    """Anchored at the start; the pattern is Java's."""
    return Parser("regex", {"r": r, "kind": kind, "id": id}, lambda t: F.when(t.rlike(f"^(?:{r})"), _read(F.regexp_extract(t, f"^(?:{r})", 0), kind, id)).otherwise(_refused(r, t, len(r), id)))


def choice(*parsers: Parser, id: str | None = None) -> Parser:
    """The first that reads without error; else their first errors, joined."""

    def run(t: Column) -> Column:
        def pick(results: Column) -> Column:
            good = F.filter(results, ok)
            errors = F.filter(F.transform(results, lambda r: F.get(r, F.lit(0))["error"]), lambda e: e.isNotNull())
            return F.when(F.size(good) > 0, F.get(good, F.lit(0))).otherwise(F.array(_token(None, "Null", None, 0, F.array_join(errors, " | "))))

        return let(F.array(*[p(t) for p in parsers]), pick)

    return Parser("choice", {"parsers": parsers, "id": id}, run)


def constant(kind: Kind, id: str | None = None) -> Parser:
    return Parser("constant", {"kind": kind, "id": id}, lambda t: F.array(_token(None, kind[0], kind[1], 0, id=id)))


def abbreviations(table: dict[str, str], id: str | None = None) -> Parser:
    """Strings that stand for IRIs; the first that fits is taken, so a shorter one listed before hides a longer one."""
    parser = choice(*[string(s, constant_kind(iri)) for s, iri in table.items()])
    return Parser("abbreviations", {"table": table, "id": id}, parser.run)


def sequence(*parsers: Parser, id: str | None = None) -> Parser:
    """One after the other; after an error what was read so far is the result."""

    def run(t: Column) -> Column:
        def then(p: Parser) -> Callable[[Column], Column]:
            def on(s: Column) -> Column:
                more = let(p(s["left"]), lambda r: F.struct(F.concat(s["out"], r).alias("out"), _after(s["left"], consumed(r)).alias("left"), F.exists(r, lambda x: x["error"].isNotNull()).alias("stop")))
                return F.when(s["stop"], s).otherwise(more)

            return on

        state = F.struct(F.array().cast(f"array<{TOKEN}>").alias("out"), t.alias("left"), F.lit(False).alias("stop"))
        for p in parsers:
            state = let(state, then(p))
        return state["out"]

    return Parser("sequence", {"parsers": parsers, "id": id}, run)


def many(parser: Parser, id: str | None = None) -> Parser:
    """Again and again until nothing, or nothing with a value first, is read; it also ends where no character is consumed."""

    def run(t: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            def on(r: Column) -> Column:
                ends = (F.size(r) == 0) | F.get(r, F.lit(0))["value"].isNull()
                more = F.struct(F.concat(s["out"], r).alias("out"), _after(s["left"], consumed(r)).alias("left"), (consumed(r) == 0).alias("stop"))
                return F.when(ends, F.struct(s["out"].alias("out"), s["left"].alias("left"), F.lit(True).alias("stop"))).otherwise(more)

            return F.when(s["stop"], s).otherwise(let(parser(s["left"]), on))

        start = F.struct(F.array().cast(f"array<{TOKEN}>").alias("out"), t.alias("left"), F.lit(False).alias("stop"))
        return F.aggregate(F.sequence(F.lit(0), F.length(t)), start, step, lambda s: s["out"])

    return Parser("many", {"parser": parser, "id": id}, run)


def maybe(parser: Parser, id: str | None = None) -> Parser:
    return Parser("maybe", {"parser": parser, "id": id}, lambda t: let(parser(t), lambda r: F.when(ok(r), r).otherwise(F.array(_token(None, "Null", None, 0, id=id)))))


def _first(parser: Parser, t: Column) -> Column:
    """The least number of characters, at least one, after which the parser reads without error; null if there is none.

    Strings and patterns are searched for; other parsers are tried at each place up to the first that fits.
    """
    if parser.kind == "string":
        at = F.locate(parser.args["s"], t, 2)
        return F.when(F.length(t) > 0, F.when(at > 0, at - 1)) if parser.args["s"] else F.when(F.length(t) > 0, 1)
    if parser.kind == "abbreviations" and all(parser.args["table"]):
        return F.array_min(F.array(*[_first(string(s, DELIMITER), t) for s in parser.args["table"]]))
    if parser.kind == "choice" and all(p.kind in ("string", "regex", "abbreviations", "choice") for p in parser.args["parsers"]):
        return F.array_min(F.array(*[_first(p, t) for p in parser.args["parsers"]]))
    if parser.kind == "regex" and not _looks_back(parser.args["r"]):
        at = F.regexp_instr(_after(t, F.lit(1)), F.lit(parser.args["r"]))
        last = F.when(F.lit("").rlike(f"^(?:{parser.args['r']})"), F.length(t))  # an empty rest may fit, too
        return F.when(F.length(t) > 0, F.coalesce(F.when(at > 0, at), last))
    found = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), F.lit(0), lambda at, n: F.when(at > 0, at).when(ok(parser(_after(t, n))), n).otherwise(0))
    return F.when(F.length(t) > 0, let(found, lambda n: F.when(n > 0, n)))


def _looks_back(pattern: str) -> bool:
    """Whether what stands before a place can decide if a pattern fits there."""
    return any(x in pattern for x in ("^", "\\b", "\\B", "\\A", "\\G", "(?<"))


def until(parser: Parser, kind: Kind, id: str | None = None) -> Parser:
    """The shortest stretch of at least one character after which the parser reads without error."""

    def run(t: Column) -> Column:
        return let(_first(parser, t), lambda n: F.when(n.isNotNull(), _read(F.substring(t, F.lit(1), n), kind, id)).otherwise(F.array(_token(None, "Null", None, 0, F.concat(F.lit(f"Expected {kind[0]}, got "), t), id))))

    return Parser("until", {"parser": parser, "kind": kind, "id": id}, run)


def extend_if_match(parser: Parser, kind: Kind, id: str | None = None) -> Parser:
    return Parser("extend_if_match", {"parser": parser, "kind": kind, "id": id}, lambda t: let(parser(t), lambda r: F.when(ok(r), F.array_append(r, _token(None, kind[0], kind[1], 0, id=id))).otherwise(r)))


def as_identifier(parser: Parser) -> Parser:
    """After each constant an identifier of the same text, of length 0."""

    def twice(x: Column) -> Column:
        return F.when(x["kind"] == "Constant", F.array(x, F.struct(x["value"].alias("value"), F.lit("Identifier").alias("kind"), x["value"].alias("token"), F.lit(0).alias("length"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("id")))).otherwise(F.array(x))

    return Parser("as_identifier", {"parser": parser}, lambda t: let(parser(t), lambda r: F.when(ok(r), F.flatten(F.transform(r, twice))).otherwise(r)))


#: Parsers that are often needed.
delimiters = regex(r"[._:/\- ]", DELIMITER)
identifier = regex(r"[a-zA-Z0-9]+", IDENTIFIER)


def named(table: dict[str, str]) -> Parser:
    """An abbreviation, a delimiter if there is one, and a name."""
    return sequence(abbreviations(table), maybe(delimiters), identifier)


_MAKERS = {f.__name__: f for f in (string, rest, substring_n, regex, choice, constant, abbreviations, sequence, many, maybe, until, extend_if_match, as_identifier)}


def from_json(text: str | dict) -> Parser:
    """The parser of a JSON text; a wrong form is a TypeError, an unknown parser a NameError."""
    d = json.loads(text) if isinstance(text, str) else text
    if not isinstance(d, dict) or set(d) != {"parser", "args"} or not isinstance(d["args"], dict):
        raise TypeError(f"not a parser: {d}")
    if d["parser"] not in _MAKERS:
        raise NameError(f"unknown parser {d['parser']}")
    args = {k: from_json(v) if isinstance(v, dict) and "parser" in v else tuple(v) if k == "kind" else v for k, v in d["args"].items()}
    several = [from_json(p) for p in args.pop("parsers", [])]
    return _MAKERS[d["parser"]](*several, **args)


# --- running parsers over tables


def parse(df: DataFrame, parser: Parser, column: str = "label") -> DataFrame:
    """Adds tokens (without silent nulls), success (all characters are read) and errors."""
    kept = F.filter(parser(F.col(column)), lambda t: t["error"].isNotNull() | (t["kind"] != "Null"))
    out = df.withColumn("tokens", kept)
    return out.withColumn("success", consumed(F.col("tokens")) == F.length(column)).withColumn("errors", F.transform(F.filter("tokens", lambda t: t["error"].isNotNull()), lambda t: t["error"]))


def split(parsed: DataFrame, column: str = "label") -> tuple[DataFrame, DataFrame]:
    """The labels that were read in full and those that were not, each label once."""
    once = parsed.dropDuplicates([column])
    return once.where("success"), once.where("not success")


def pairs(tokens: Column, label: Column) -> Column:
    """array<struct<identifier, type>>: successive constants and identifiers, two by two; a constant left over goes with the label."""
    told = F.filter(tokens, lambda t: t["kind"].isin("Constant", "Identifier"))

    def pair(t: Column) -> Column:
        n = F.size(t)

        def two(i: Column) -> Column:
            a, b = F.get(t, 2 * i), F.get(t, 2 * i + 1)
            name = F.when(a["kind"] == "Identifier", a["token"]).otherwise(b["token"])
            kind = F.when(a["kind"] == "Constant", a["token"]).otherwise(b["token"])
            return F.struct(name.alias("identifier"), kind.alias("type"))

        whole = F.when(n >= 2, F.transform(F.sequence(F.lit(0), (n / 2).cast("int") - 1), two)).otherwise(F.array().cast("array<struct<identifier:string,type:string>>"))
        last = F.get(t, n - 1)
        return F.when((n % 2 == 1) & (last["kind"] == "Constant"), F.array_append(whole, F.struct(label.alias("identifier"), last["token"].alias("type")))).otherwise(whole)

    return let(told, pair)


def failures(failed: DataFrame, column: str = "label") -> DataFrame:
    """(unparsed, labels, n): what is left of failed labels, with the labels that it is left of, most first."""
    left = F.substring(F.col(column), consumed(F.col("tokens")) + 1, F.length(column))
    return failed.groupBy(left.alias("unparsed")).agg(F.sort_array(F.collect_set(column)).alias("labels"), F.count_distinct(F.col(column)).alias("n")).orderBy(F.col("n").desc(), "unparsed")


def error_offsets(tokens: Column) -> Column:
    """Where in the label each error stands."""
    step = lambda a, t: F.struct((a["at"] + t["length"]).alias("at"), F.when(t["error"].isNotNull(), F.array_append(a["out"], a["at"])).otherwise(a["out"]).alias("out"))
    return F.aggregate(tokens, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])


def label_records(df: DataFrame, parser: Parser, column: str = "label") -> DataFrame:
    """(label, identifier, type) of every label that is read in full."""
    good, _ = split(parse(df, parser, column), column)
    return good.withColumn("_t", F.explode(pairs(F.col("tokens"), F.col(column)))).select(F.col(column).alias("label"), "_t.identifier", "_t.type")

