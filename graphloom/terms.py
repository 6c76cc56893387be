"""Terms in N-Triples notation: as Python strings for plans, as string columns for data."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SH = "http://www.w3.org/ns/shacl#"
#: Fixed prefix of template parameters.
PARAM = "urn:___param___#"

A = f"<{RDF}type>"
SUBCLASS = f"<{RDFS}subClassOf>"
SUBPROPERTY = f"<{RDFS}subPropertyOf>"
LABEL = f"<{RDFS}label>"
IMPORTS = f"<{OWL}imports>"
ONTOLOGY = f"<{OWL}Ontology>"

#: Characters that an IRI may not have.
BAD_IRI = "[<>\" {}|\\\\^`]"


# --- Python side


def iri(text: str) -> str:
    return f"<{text}>"


def param(name: str) -> str:
    return f"<{PARAM}{name}>"


def is_param(term: str) -> bool:
    return term.startswith(f"<{PARAM}")


def param_name(term: str) -> str:
    """The name of a parameter; a prefix that stands several times is stripped as often."""
    if not is_param(term):
        raise ValueError(f"not a parameter: {term}")
    return re.sub(f"^(?:{re.escape(PARAM)})+", "", term[1:-1])


def literal(value: str, datatype: str | None = None, lang: str | None = None) -> str:
    body = '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r") + '"'
    return body + (f"@{lang}" if lang else f"^^<{datatype}>" if datatype else "")


def text_of(term: str) -> str:
    """An IRI without brackets, a literal's value, a blank node as it is."""
    if term.startswith("<"):
        return term[1:-1]
    if term.startswith('"'):
        body = term[1 : term.rindex('"')]
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), body)
    return term


def qname(term: str, prefixes: dict[str, str]) -> str:
    """``prefix:local`` by the longest namespace that fits, else the text of the term."""
    text = text_of(term)
    fit = max(((len(ns), p, ns) for p, ns in prefixes.items() if text.startswith(ns) and len(text) > len(ns)), default=None)
    return f"{fit[1]}:{text[fit[0]:]}" if fit else text


# --- column side


def iri_col(text: Column) -> Column:
    return F.concat(F.lit("<"), text, F.lit(">"))


def literal_col(text: Column, datatype: str | None = None, lang: str | None = None) -> Column:
    body = F.regexp_replace(text.cast("string"), r'(["\\])', r"\\$1")
    body = F.replace(F.replace(body, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.concat(F.lit('"'), body, F.lit(f'"@{lang}' if lang else f'"^^<{datatype}>' if datatype else '"'))


def is_iri(term: Column) -> Column:
    return term.startswith("<")


def is_blank(term: Column) -> Column:
    return term.startswith("_:")


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def lexical(term: Column) -> Column:
    """A literal's value, null for other terms."""
    text = read = F.regexp_extract(term, r'(?s)^"(.*)"[^"]*$', 1)
    # escapes are read from left to right in pairs, so that an escaped backslash before a letter stays one
    for letter, meant in (("n", "\n"), ("r", "\r"), ("t", "\t")):
        read = F.regexp_replace(read, rf"(?s)\G((?:[^\\]|\\[^{letter}])*+)\\{letter}", f"$1{meant}")
    read = F.regexp_replace(read, r"(?s)\\(.)", "$1")
    return F.when(is_literal(term), F.when(text.contains("\\"), read).otherwise(text))


def plain(term: Column) -> Column:
    """The text of any term."""
    return F.when(is_iri(term), F.substring(term, F.lit(2), F.length(term) - 2)).when(is_literal(term), lexical(term)).otherwise(term)


def datatype(term: Column) -> Column:
    """A literal's datatype as IRI text: xsd:string without one, rdf:langString with a language tag."""
    named = F.regexp_extract(term, r'"\^\^<([^>]*)>$', 1)
    tagged = term.rlike(r'"@[A-Za-z0-9-]+$')
    return F.when(is_literal(term), F.when(named != "", named).when(tagged, f"{RDF}langString").otherwise(f"{XSD}string"))


def lang(term: Column) -> Column:
    """A literal's language tag, empty without one, null for other terms."""
    return F.when(is_literal(term), F.regexp_extract(term, r'"@([A-Za-z0-9-]+)$', 1))


def number(term: Column) -> Column:
    """A literal's value as a double, null if it is none."""
    return lexical(term).try_cast("double")


def term_of(text: Column, namespace: str) -> Column:
    """A cell as a term: an IRI in ``namespace`` if the text allows one, else a literal."""
    return F.when(text.rlike(BAD_IRI), literal_col(text)).otherwise(iri_col(F.concat(F.lit(namespace), text)))
