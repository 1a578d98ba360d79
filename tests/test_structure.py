import datetime as dt
import json

import pytest

from corpuslens.__main__ import main
from corpuslens.engine import Engine
from corpuslens.operators import embedding, structure
from corpuslens.sources import readers

NOW = dt.datetime(2025, 1, 1)


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")


def test_definitions(spark):
    rows = structure.definitions(texts(spark, "import os\n\nclass A:\n    def f(self):\n        pass\n\nasync def g():\n    pass\n", None, "", "no code"), "python").collect()
    assert [(r.name, r.start_line, r.end_line) for r in rows] == [("A", 3, 3), ("f", 4, 6), ("g", 7, 8)]
    assert rows[0].body == "class A:" and rows[2].body == "async def g():\n    pass"
    rows = structure.definitions(texts(spark, "pub fn go() {\n}\nimpl<T> X {}\ntype Y"), "rust").collect()
    assert [r.name for r in rows] == ["go"]
    rows = structure.definitions(texts(spark, "export default () => 1\nfunction (a) {}"), "javascript").collect()
    assert [r.name for r in rows] == ["anonymous_javascript"] * 2


def test_headings(spark):
    text = "intro\n# One\nbody\n## Two ##\n```\n# not a heading\n```\n# Three\n### Four\n## Five\n#tag"
    rows = structure.headings(texts(spark, text, None, "", "plain")).orderBy("line").collect()
    assert [(r.line, r.depth, r.title, r.parent) for r in rows] == [(2, 1, "One", None), (4, 2, "Two", 2), (8, 1, "Three", None), (9, 3, "Four", 8), (10, 2, "Five", 8)]
    assert [r.body for r in rows] == ["body", "```\n# not a heading\n```", "", "", "#tag"]


def test_object_keys(spark):
    rows = structure.object_keys(texts(spark, '{"b": {"z": 1, "a": []}, "a": "x"}', "[1]", "{", None)).collect()
    assert [tuple(r) for r in rows] == [(0, "a", '"x"'), (0, "b", '{\n  "a": [],\n  "z": 1\n}')]


def test_keys_of_yaml_and_toml(spark):
    rows = structure.object_keys(texts(spark, 'b = 1\n[a]\nx = [1, "y"]\nd = 2024-01-02', "= broken", None), kind="toml").collect()
    assert [tuple(r) for r in rows] == [(0, "a", 'x = [1, "y"]\nd = 2024-01-02'), (0, "b", "1")]
    pytest.importorskip("yaml")
    rows = structure.object_keys(texts(spark, "b:\n  - 1\n  - é\na: x\n7: no", "- list", "a: [", None), kind="yaml").collect()
    assert [tuple(r) for r in rows] == [(0, "b", "- 1\n- é\n"), (0, "a", "x\n")]


def test_keyed_chunks(spark):
    rows = structure.keyed_chunks(texts(spark, '{"a": 1, "b": "x"}', "[1]", " \n", "", None)).orderBy("doc_id", "pos").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "a", "1"), (0, 1, "b", '"x"'), (1, 0, None, "[1]")]


MARKDOWN = "intro [a](b.md) and [c](https://d)\nmore\n\n# One\n![pic](p.png) x\n```\n# code [q](r)\n\ny\n```\n## Two\nlast [e](../f.md \"t\")\n\n  \n"


def test_blocks(spark):
    docs = texts(spark, MARKDOWN, None, "", " \n\n")
    rows = structure.blocks(docs).orderBy("line").collect()
    assert [(r.line, r.kind, r.section, r.body) for r in rows] == [
        (1, "paragraph", None, "intro [link:b.md]a and c\nmore"), (5, "paragraph", 4, "pic x"), (7, "code", 4, "# code [q](r)\n\ny"), (12, "paragraph", 11, "last [link:../f.md]e"),
    ]
    edges = structure.contains(structure.headings(docs), structure.blocks(docs)).collect()
    assert {(r.src, r.dst, r.kind) for r in edges} == {(None, 4, "section"), (4, 11, "section"), (None, 1, "paragraph"), (4, 5, "paragraph"), (4, 7, "code"), (11, 12, "paragraph")}
    assert {r.target for r in structure.references(docs).collect()} == {"b.md", "../f.md"}


def test_lookup(spark):
    names = spark.createDataFrame([(1, "Anna Lund"), (2, "Anna"), (3, "ANNA"), (4, "Bo")], "id int, name string")
    assert structure.lookup(names, "anna").first().id == 3
    assert structure.lookup(names, "lun").first().id == 1
    assert structure.lookup(names, "nobody").count() == 0
    assert [r.id for r in structure.suggest(names, "ann").collect()] == [3, 2, 1]


def test_tags_and_metadata(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.index(spark.createDataFrame([(i, i, "copper kettle", "markdown", None, 13, NOW) for i in "ab"], "doc_id string, name string, content string, content_type string, content_hash string, size long, modified timestamp"))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id string")
    e.tag(ids("a", "b"), "new")
    e.tag(ids("a"), "new")
    assert e.tags().count() == 2
    e.untag(ids("b"), "new")
    assert [r.doc_id for r in e.query("copper kettle", now=NOW, tag="new").collect()] == ["a"]
    rows = lambda v: spark.createDataFrame([("a", "k", v), ("b", "k", v)], "doc_id string, key string, value string")
    e.set_metadata(rows("1"))
    e.set_metadata(rows("0"))
    assert {tuple(r) for r in e.metadata().collect()} == {("a", "k", "0"), ("b", "k", "0")}
    e.delete(ids("a"))
    assert e.tags().count() == 0 and e.metadata().count() == 1 and e.documents().count() == 1


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Kettles\ncopper kettle")
    at = ["--home", str(tmp_path / "home")]
    main([*at, "index", str(tmp_path / "in")])
    main([*at, "query", "copper kettle"])
    main([*at, "status"])
    out = capsys.readouterr().out
    assert "indexed 1, skipped 0" in out and "a.md" in out and "markdown\t1" in out


COLUMNS = "doc_id string, name string, content string, content_type string, content_hash string, size long, modified timestamp"


def test_vectors_reindex_and_paths(spark, tmp_path):
    docs = lambda **x: spark.createDataFrame([(f"/d/{k}", k, v, "plaintext", None, 1, NOW) for k, v in x.items()], COLUMNS)
    e = Engine(spark, str(tmp_path))
    assert e.vectors().count() == 0 and e.nearest([1.0]).count() == 0
    e.index(docs(a="my_one and your_two", b="your_two, her_three", c="nothing here"))
    assert [(r.step, r.name, r.shared) for r in e.connect("my_one", "her_three").collect()] == [(0, "my_one", None), (1, "your_two", 1), (2, "her_three", 1)]
    assert e.connect("my_one", "nobody").count() == 0
    assert e.embed() == 3
    asked = embedding.hashed_words()()(["nothing here"])[0].tolist()
    best = e.nearest(asked, 2).collect()
    assert best[0].id == "/d/c" and best[0].score == 1.0
    assert e.reindex(docs(a="my_one and your_two", b="changed")) == (1, 1, 1)
    assert {r.doc_id for r in e.vectors().collect()} == {"/d/a", "/d/b"}
    assert [r.folder for r in e.folders().collect()] == ["/d"]
    assert Engine.databases(spark, str(tmp_path)) == ["default"] and Engine.databases(spark, str(tmp_path / "none")) == []
    e.tag(spark.createDataFrame([("/d/b",)], "doc_id string"), "new")
    found = json.loads(e.envelope("changed", now=NOW).first().json)
    assert found["query"] == "changed" and [(r["path"], r["tags"]) for r in found["results"]] == [("/d/b", ["new"])]
    assert json.loads(e.envelope("absent", now=NOW).first().json)["results"] == []


def test_quoted_tables(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,,"b, c"\n1,"x ""y"" z","two\nlines",more\n\n4\n')
    found = {r.name: r.content for r in readers.files(spark, str(tmp_path)).collect()}
    assert found == {"q.csv": 'Columns: a, , b, c\n\na: 1 | x "y" z | b, c: two\nlines | more\na: 4'}
