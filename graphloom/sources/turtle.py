"""Turtle for metadata: shapes, templates and ontologies, which the driver plans with.

Instance data at scale belongs in N-Triples, which is read in parallel.
"""

from __future__ import annotations

import hashlib
import re

from ..terms import A, RDF, XSD, literal

_TOKENS = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
  | (?P<long>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?''')
  | (?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<iri><[^<>"{}|^`\s]*>)
  | (?P<directive>@prefix\b|@base\b|(?i:PREFIX|BASE)(?=\s))
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<type>\^\^)
  | (?P<blank>_:[A-Za-z0-9_](?:[A-Za-z0-9_.-]*[A-Za-z0-9_-])?)
  | (?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
  | (?P<name>(?:[^\W\d_][\w.-]*)?:(?:[\w:%-]|\\.|\.(?=[\w:%\\-]))*)
  | (?P<word>true\b|false\b|a(?=[\s<\[]))
  | (?P<mark>[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(s: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), s)


def read(text: str, prefixes: dict[str, str] | None = None) -> list[tuple[str, str, str]]:
    """The triples of a Turtle text, in order, without repeats; ``prefixes`` are known from the start and added to."""
    known = prefixes if prefixes is not None else {}
    tokens, at = [], 0
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m:
            raise ValueError(f"not Turtle, line {text.count(chr(10), 0, at) + 1}: {text[at : at + 40]!r}")
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    scope = hashlib.sha256(text.encode()).hexdigest()[:8]
    out: dict[tuple[str, str, str], None] = {}
    base, fresh, i = "", 0, 0

    def blank():
        nonlocal fresh
        fresh += 1
        return f"_:g{scope}x{fresh}"

    def take(expected: str | None = None):
        nonlocal i
        if i >= len(tokens) or expected and tokens[i][1] != expected:
            raise ValueError(f"expected {expected or 'a term'}, got {tokens[i][1] if i < len(tokens) else 'the end'}")
        i += 1
        return tokens[i - 1]

    def node() -> str:
        nonlocal i
        kind, t = take()
        if kind == "iri":
            t = _unescape(t[1:-1])
            return f"<{t if ':' in t else base + t}>"
        if kind == "name":
            head, local = t.split(":", 1)
            if head not in known:
                raise ValueError(f"unknown prefix {head}:")
            return f"<{known[head]}{re.sub(r'[\\](.)', r'\1', local)}>"
        if kind == "blank":
            return f"_:b{scope}{t[2:]}"
        if kind in ("str", "long"):
            value = _unescape(t[3:-3] if kind == "long" else t[1:-1])
            if i < len(tokens) and tokens[i][0] == "lang":
                return literal(value, lang=take()[1][1:])
            if i < len(tokens) and tokens[i][0] == "type":
                take()
                return literal(value, node()[1:-1])
            return literal(value)
        if kind == "num":
            return literal(t, XSD + ("double" if "e" in t.lower() else "decimal" if "." in t else "integer"))
        if kind == "word":
            return A if t == "a" else literal(t, XSD + "boolean")
        if t == "[":
            b = blank()
            if tokens[i][1] != "]":
                facts(b)
            take("]")
            return b
        if t == "(":
            items = []
            while tokens[i][1] != ")":
                items.append(node())
            take(")")
            cells = [blank() for _ in items] + [f"<{RDF}nil>"]
            for c, x, rest in zip(cells, items, cells[1:]):
                out[(c, f"<{RDF}first>", x)] = None
                out[(c, f"<{RDF}rest>", rest)] = None
            return cells[0]
        raise ValueError(f"unexpected {t}")

    def facts(s: str) -> None:
        nonlocal i
        while True:
            p = node()
            while True:
                out[(s, p, node())] = None
                if i >= len(tokens) or tokens[i][1] != ",":
                    break
                i += 1
            while i < len(tokens) and tokens[i][1] == ";":
                i += 1
                if i >= len(tokens) or tokens[i][1] in ".]":
                    return
            if i >= len(tokens) or tokens[i - 1][1] != ";":
                return

    while i < len(tokens):
        if tokens[i][0] == "directive":
            word = take()[1]
            if word.lower().endswith("prefix"):
                head = take()[1][:-1]
                known[head] = node()[1:-1]
            else:
                base = node()[1:-1]
            if word.startswith("@"):
                take(".")
            continue
        alone = tokens[i][1] == "["
        s = node()
        if not (alone and i < len(tokens) and tokens[i][1] == "."):
            facts(s)
        take(".")
    return list(out)


def write(triples: list[tuple[str, str, str]], prefixes: dict[str, str]) -> str:
    """A small graph as Turtle, grouped by subject."""

    def say(t: str) -> str:
        if t == A:
            return "a"
        for p, ns in prefixes.items():
            if t.startswith(f"<{ns}") and re.fullmatch(r"[A-Za-z_][\w-]*", t[1 + len(ns) : -1]):
                return f"{p}:{t[1 + len(ns) : -1]}"
        return t

    lines = [f"@prefix {p}: <{ns}> ." for p, ns in prefixes.items()]
    for s in dict.fromkeys(t[0] for t in triples):
        lines.append(f"\n{say(s)} " + " ;\n    ".join(f"{say(p)} {say(o)}" for x, p, o in triples if x == s) + " .")
    return "\n".join(lines) + "\n"
