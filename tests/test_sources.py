"""Files of several formats parsed in tasks, workbooks, and commits of named graphs."""

import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.catalog import Engine
from graphloom.operators import graph
from graphloom.sources import files, records, turtle
from graphloom.sources.snapshots import Conflict, GraphTable
from graphloom.terms import A, RDF, iri, literal

E = "urn:e#"
HEAD = f"@prefix e: <{E}> .\n"

XML = f"""<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="{E}" xml:base="http://b/dir/doc" xml:lang="en">
  <e:Thing rdf:about="urn:e#a" e:size="3"><e:p rdf:resource="other"/><e:q rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</e:q>
    <e:near><e:Thing rdf:nodeID="n"/></e:near><e:list rdf:parseType="Collection"><rdf:Description rdf:about="#x"/><rdf:Description rdf:about="#y"/></e:list></e:Thing>
  <rdf:Description rdf:nodeID="n" ><e:label xml:lang="">plain</e:label><e:label>said</e:label><e:has rdf:parseType="Resource"><e:k>v</e:k></e:has></rdf:Description>
  <rdf:Seq rdf:ID="seq"><rdf:li>one</rdf:li><rdf:li rdf:resource="urn:e#two"/></rdf:Seq>
  <rdf:Description rdf:about="urn:e#b"><e:p rdf:ID="stmt" rdf:resource="urn:e#c"/><e:empty/><e:with e:k="w"/><e:raw rdf:parseType="Literal">x<i>y</i></e:raw></rdf:Description>
</rdf:RDF>"""

SAME = HEAD + f"""@prefix rdf: <{RDF}> .
e:a a e:Thing ; e:size "3"@en ; e:p <http://b/dir/other> ; e:q 5 ; e:near _:n ; e:list ( <http://b/dir/doc#x> <http://b/dir/doc#y> ) .
_:n a e:Thing ; e:label "plain", "said"@en ; e:has [ e:k "v"@en ] .
<http://b/dir/doc#seq> a rdf:Seq ; rdf:_1 "one"@en ; rdf:_2 e:two .
e:b e:p e:c ; e:empty ""@en ; e:with [ e:k "w"@en ] ; e:raw "x<i>y</i>"^^rdf:XMLLiteral .
<http://b/dir/doc#stmt> a rdf:Statement ; rdf:subject e:b ; rdf:predicate e:p ; rdf:object e:c .
"""


def test_rdf_xml_says_what_turtle_says(spark):
    frame = lambda t: spark.createDataFrame(t, "s string, p string, o string")
    assert graph.isomorphic(frame(list(files.parse("x.rdf", XML.encode()))), frame(turtle.read(SAME)))


def test_formats_are_guessed():
    assert files.format_of("a.ttl", b"<?xml") == "turtle" and files.format_of("a.owl", b"") == "xml"
    assert files.format_of("a", b"\xef\xbb\xbf <?xml ?>") == "xml" and files.format_of("a.txt", b"@prefix") == "turtle"


def test_a_folder_of_many_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for k in range(40):
        (tmp_path / "deep" / f"t{k}.ttl").write_text(HEAD + f"e:t{k} e:in e:x .")
        (tmp_path / f"x{k}.rdf").write_text(f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="{E}"><rdf:Description rdf:about="urn:e#x{k}"><e:in rdf:resource="urn:e#x"/></rdf:Description></rdf:RDF>')
        (tmp_path / f"n{k}.nt").write_text(f"<{E}n{k}> <{E}in> <{E}x> .\n")
    (tmp_path / "notes.txt").write_text("not a graph")
    g = files.read(spark, str(tmp_path))
    assert g.where(F.col("p") == iri(f"{E}in")).count() == 120 == g.count()
    assert files.read(spark, str(tmp_path / "x3.rdf")).count() == 1 and files.read(spark, str(tmp_path / "n3.nt")).count() == 1
    (tmp_path / "bad.ttl").write_text("e:x ???")
    with pytest.raises(Exception, match="bad.ttl"):
        files.read(spark, str(tmp_path)).count()


def test_an_engine_reads_any_format(spark, tmp_path):
    (tmp_path / "m.rdf").write_text(f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:o="http://www.w3.org/2002/07/owl#"><o:Ontology rdf:about="urn:m"/></rdf:RDF>')
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "s.xml").write_text(XML)
    engine = Engine(spark, str(tmp_path / "store"))
    assert engine.model_from_file(str(tmp_path / "m.rdf")).name == "urn:m"
    assert len(engine.load_directory(str(tmp_path / "lib"), {}, E).shapes) > 20


def workbook(path, sheets):
    """A small workbook with shared and inline strings, a number, a truth value and gaps."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>si</t></r><r><t>ze</t></r></si></sst>")
        for k, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>ok</t></is></c></row>'
    body = "".join(f'<row r="{k + 2}"><c r="A{k + 2}" t="inlineStr"><is><t>n{k}</t></is></c><c r="C{k + 2}" t="b"><v>{k % 2}</v></c></row>' for k in range(5))
    workbook(tmp_path / "a.xlsx", {"one": head + body, "two": head + '<row r="2"><c r="B2"><v>2.5</v></c></row>', "none": ""})
    rows = records.from_xlsx(spark, str(tmp_path)).collect()
    assert sorted((r.rtype, r.fields["name"], r.fields["size"], r.fields["ok"]) for r in rows if r.rtype == "one") == [("one", f"n{k}", None, "True" if k % 2 else "False") for k in range(5)]
    assert [r.fields for r in rows if r.rtype == "two"] == [{"name": None, "size": "2.5", "ok": None}] and len(rows) == 6
    assert records.from_xlsx(spark, str(tmp_path / "a.xlsx"), limit=4).where("rtype = 'one'").count() == 2


# --- commits


def rows(spark, *names):
    return spark.createDataFrame([(iri(E + n), A, literal("x")) for n in names], "s string, p string, o string")


def names(df):
    return sorted(r.s[len(E) + 1 : -1] for r in df.collect())


def test_two_writers_are_merged_or_one_wins(spark, tmp_path):
    table = GraphTable(spark, str(tmp_path / "g"))
    with table.transaction() as t:
        t.append("one", rows(spark, "a", "a"))
        t.append("two", rows(spark, "z"))
    first, second, third, fourth = (table.transaction() for _ in range(4))
    a, b, c, d = (x.__enter__() for x in (first, second, third, fourth))
    a.append("one", rows(spark, "b", "c"))
    b.append("one", rows(spark, "c", "d"))
    c.replace("one", rows(spark, "only"))
    d.delete("two")
    assert names(a.load("one")) == ["a", "b", "c"] and names(table.load("one")) == ["a"]
    first.__exit__(None, None, None)
    second.__exit__(None, None, None)
    assert names(table.load("one")) == ["a", "b", "c", "d"]
    with pytest.raises(Conflict):
        third.__exit__(None, None, None)
    fourth.__exit__(None, None, None)
    assert names(table.load("one")) == ["a", "b", "c", "d"] and table.graph_ids() == ["one"]
    assert names(table.load("two", version=1)) == ["z"]


def test_an_error_leaves_nothing_and_versions_come_back(spark, tmp_path):
    table = GraphTable(spark, str(tmp_path / "g"))
    with table.transaction() as t:
        t.append("one", rows(spark, "a"))
    before = table.data.names()
    with pytest.raises(RuntimeError), table.transaction() as t:
        t.append("one", rows(spark, "b"))
        raise RuntimeError
    assert table.data.names() == before and names(table.load("one")) == ["a"]
    with table.transaction() as t:
        t.replace("one", rows(spark, "c"))
    assert table.restore(1) == 3 and names(table.load("one")) == ["a"]
    assert len(table.vacuum()) == 1 and table.versions() == [3] and names(table.load("one")) == ["a"]
    with table.transaction() as t:
        t.append("one", rows(spark, "d"))
    assert names(table.load("one")) == ["a", "d"] and table.version() == 4


def test_an_engine_takes_back_all_of_a_failed_transaction(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    m = engine.create_model("urn:m")
    engine.add(m, rows(spark, "a"))
    with pytest.raises(RuntimeError), engine.transaction():
        engine.create_model("urn:other")
        engine.add(m, rows(spark, "b"))
        m.manifest.append((iri(E + "s"), A, iri(E + "t")))
        engine.create_library("urn:lib")
        assert engine.graph(m).count() == 3
        raise RuntimeError
    assert set(engine.models) == {"urn:m"} and not engine.libraries and m.manifest == [] and engine.graph(m).count() == 2
    with engine.transaction():
        engine.add(m, rows(spark, "b"))
        engine.create_model("urn:other")
    assert engine.graph(m).count() == 3 and engine.table.version() == 3
    other = Engine(spark, str(tmp_path / "store"))
    assert engine.save() != other.save()
