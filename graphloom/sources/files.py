"""Graphs and workbooks from files of any place that Spark can read: each file is parsed in a task, none by the driver.

The format follows from the file's name, or else from how it begins.  N-Triples are read line by
line, in parallel within a file; Turtle and RDF/XML a file a task, whose triples leave in batches.
"""

from __future__ import annotations

import hashlib
import io
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ..terms import A, RDF, literal
from . import ntriples
from .turtle import read as read_turtle  # a function goes to the tasks by value, a module would not

# tasks need no copy of this package on the executors
cloudpickle.register_pickle_by_value(sys.modules["graphloom"])

NAMES = {"ttl": "turtle", "n3": "turtle", "turtle": "turtle", "rdf": "xml", "xml": "xml", "owl": "xml"}
BATCH = 10_000
XML = "http://www.w3.org/XML/1998/namespace"


def format_of(path: str, head: bytes) -> str:
    """turtle or xml."""
    known = NAMES.get(path.rpartition(".")[2].lower())
    return known or ("xml" if re.match(rb"(\xef\xbb\xbf)?\s*<(\?xml|rdf:RDF|!DOCTYPE)", head) else "turtle")


# --- RDF/XML


class XmlReader:
    """The triples of an RDF/XML text, element by element."""

    def __init__(self, body: bytes, base: str = ""):
        self.scope = hashlib.sha256(body).hexdigest()[:8]
        self.fresh, self.body, self.base = 0, body, base

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        root = ElementTree.parse(io.BytesIO(self.body)).getroot()
        base = root.get(f"{{{XML}}}base", self.base)
        nodes = list(root) if root.tag == f"{{{RDF}}}RDF" else [root]
        for n in nodes:
            yield from self.node(n, base, root.get(f"{{{XML}}}lang"))[1]

    def blank(self) -> str:
        self.fresh += 1
        return f"_:x{self.scope}n{self.fresh}"

    @staticmethod
    def name(tag: str) -> str:
        return f"<{tag[1:].replace('}', '', 1)}>" if tag.startswith("{") else f"<{tag}>"

    @staticmethod
    def iri(text: str, base: str) -> str:
        if ":" in text.split("/", 1)[0]:
            return f"<{text}>"
        if text.startswith("#") or not text:
            return f"<{base.partition('#')[0]}{text}>"
        return f"<{re.sub(r'[^/]*$', '', base.partition('#')[0])}{text}>"

    def _rdf(self, e, name: str) -> str | None:
        return e.get(f"{{{RDF}}}{name}")

    def node(self, e, base: str, lang: str | None) -> tuple[str, list[tuple[str, str, str]]]:
        base, lang = e.get(f"{{{XML}}}base", base), e.get(f"{{{XML}}}lang", lang)
        about, ident, named = self._rdf(e, "about"), self._rdf(e, "ID"), self._rdf(e, "nodeID")
        s = self.iri(about, base) if about is not None else self.iri(f"#{ident}", base) if ident is not None else f"_:x{self.scope}{named}" if named is not None else self.blank()
        out = [] if e.tag == f"{{{RDF}}}Description" else [(s, A, self.name(e.tag))]
        out += self.attributes(e, s, base, lang)
        count = 0
        for p in e:
            tag = p.tag
            if tag == f"{{{RDF}}}li":
                count += 1
                tag = f"{{{RDF}}}_{count}"
            out += self.property(p, s, self.name(tag), base, lang)
        return s, out

    def attributes(self, e, s: str, base: str, lang: str | None) -> list[tuple[str, str, str]]:
        """Property attributes: all that is neither syntax nor xml."""
        out = []
        for k, v in e.attrib.items():
            if k == f"{{{RDF}}}type":
                out.append((s, A, self.iri(v, base)))
            elif not k.startswith((f"{{{RDF}}}", f"{{{XML}}}")):
                out.append((s, self.name(k), literal(v, lang=lang)))
        return out

    def property(self, e, s: str, p: str, base: str, lang: str | None) -> list[tuple[str, str, str]]:
        base, lang = e.get(f"{{{XML}}}base", base), e.get(f"{{{XML}}}lang", lang)
        resource, named, kind, parse = (self._rdf(e, n) for n in ("resource", "nodeID", "datatype", "parseType"))
        more: list[tuple[str, str, str]] = []
        if parse == "Resource":
            o = self.blank()
            for q in e:
                more += self.property(q, o, self.name(q.tag), base, lang)
        elif parse == "Collection":
            items = [self.node(x, base, lang) for x in e]
            cells = [self.blank() for _ in items] + [f"<{RDF}nil>"]
            o = cells[0]
            for cell, rest, (item, facts) in zip(cells, cells[1:], items):
                more += [(cell, f"<{RDF}first>", item), (cell, f"<{RDF}rest>", rest), *facts]
        elif parse == "Literal":
            o = literal((e.text or "") + "".join(ElementTree.tostring(x, "unicode") for x in e), f"{RDF}XMLLiteral")
        elif len(e):
            o, more = self.node(e[0], base, lang)
        elif resource is not None or named is not None or self.attributes(e, s, base, lang):
            o = self.iri(resource, base) if resource is not None else f"_:x{self.scope}{named}" if named is not None else self.blank()
            more = self.attributes(e, o, base, lang)
        else:
            o = literal(e.text or "", kind and self.iri(kind, base)[1:-1], None if kind else lang or None)
        out = [(s, p, o), *more]
        ident = self._rdf(e, "ID")
        if ident is not None:
            r = self.iri(f"#{ident}", base)
            out += [(r, A, f"<{RDF}Statement>"), (r, f"<{RDF}subject>", s), (r, f"<{RDF}predicate>", p), (r, f"<{RDF}object>", o)]
        return out


def parse(path: str, body: bytes) -> Iterator[tuple[str, str, str]]:
    """The triples of one file; a text that is neither format raises with its path."""
    try:
        if format_of(path, body[:200]) == "xml":
            yield from XmlReader(body, path)
        else:
            yield from read_turtle(body.decode("utf-8-sig"))
    except (ValueError, ElementTree.ParseError) as e:
        raise ValueError(f"{path}: {e}") from e


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], pa.string()) for k, c in enumerate("spo")})

    for batch in batches:
        for path, body in zip(batch.column(0), batch.column(1)):
            rows: list[tuple[str, str, str]] = []
            for t in parse(path.as_py(), body.as_py()):
                rows.append(t)
                if len(rows) == BATCH:
                    yield told(rows)
                    rows = []
            if rows:
                yield told(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The triples of a file or of all files in a folder, nested ones included, of any of the three formats.

    A file that cannot be parsed is an error that names it.  Repeated triples are one.
    """
    lines = path.lower().endswith((".nt", ".nq"))
    parts = []
    single = lines or path.rpartition("/")[2].rpartition(".")[0] != ""
    if lines or not single:
        parts.append(ntriples.read(spark, path, None if lines else "*.nt"))
    if not lines:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
        if not single:
            files = files.where("lower(path) rlike '[.](" + "|".join(NAMES) + ")$' and path not like '%.ipynb_checkpoints%'")
        parts.append(files.mapInArrow(_triples, "s string, p string, o string"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.dropDuplicates()


# --- workbooks

SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _text_of(e) -> str:
    return "".join(t.text or "" for t in e.iter(f"{SHEET}t"))


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(body: bytes) -> Iterator[tuple[str, list[str | None]]]:
    """(sheet, cells) row by row; numbers and dates are as they are stored, empty cells none."""
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        shared = [_text_of(e) for e in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot()] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        for sheet in ElementTree.parse(z.open("xl/workbook.xml")).getroot().iter(f"{SHEET}sheet"):
            target = targets[sheet.get(RELATION)]
            with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
                for _, e in ElementTree.iterparse(f):
                    if e.tag != f"{SHEET}row":
                        continue
                    cells: list[str | None] = []
                    for c in e.iter(f"{SHEET}c"):
                        at = _column(c.get("r")) if c.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        v, kind = c.find(f"{SHEET}v"), c.get("t")
                        text = _text_of(c) if kind == "inlineStr" else None if v is None else v.text
                        cells[at] = shared[int(text)] if kind == "s" and text is not None else {"0": "False", "1": "True"}.get(text, text) if kind == "b" else text
                    e.clear()
                    yield sheet.get("name"), cells


def _records(limit: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())

        def told(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], kind)], ["rtype", "fields"])

        for batch in batches:
            for body in batch.column(0):
                head, last, n, rows = [], None, 0, []
                for sheet, cells in sheets(body.as_py()):
                    if sheet != last:
                        head, last, n = cells, sheet, 0
                        continue
                    n += 1
                    if limit and n > max(0, limit - 2):
                        continue
                    cells += [None] * (len(head) - len(cells))
                    rows.append((sheet, [(k, v) for k, v in dict(zip(head, cells)).items() if k is not None]))
                    if len(rows) == BATCH:
                        yield told(rows)
                        rows = []
                if rows:
                    yield told(rows)

    return run


def workbooks(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(rtype, fields) of every sheet of a workbook, or of all in a folder; the first row is the header, at most ``limit`` - 2 rows of each sheet."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("lower(path) like '%.xlsx'").select("content")
    return files.mapInArrow(_records(limit), "rtype string, fields map<string,string>")
