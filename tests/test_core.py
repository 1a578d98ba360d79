import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuslens import catalogue
from corpuslens.engine import Engine
from corpuslens.operators import chunking, graph, resolution
from corpuslens.plans.queryplan import parse_query
from corpuslens.sources import readers

DATA = "/root/testdata/sf0.001"
NOW = dt.datetime(2025, 1, 1)


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if x is None or x != x else round(float(x), 5) if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", catalogue.queries())
def test_query_equals_sql(spark, name):
    found = catalogue.queries()[name](spark, DATA).toPandas()
    if name in catalogue.oracle_sql():
        c = duckdb.connect()
        for f in os.listdir(DATA):
            c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
        assert plain(found) == plain(c.sql(catalogue.oracle_sql()[name]).df())


def docs(spark, rows):
    return spark.createDataFrame([(i, i, t, "markdown", None, len(t), m) for i, t, m in rows], "doc_id string, name string, content string, content_type string, content_hash string, size long, modified timestamp")


def test_lexical_ranking(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.index(docs(spark, [("a.md", "# Cluster rollout\nContainer orchestration deployment guide", NOW), ("b.md", "# Bread\nBaking bread at home", NOW), ("c.md", "# Lamps\nOffice lighting", NOW)]))
    assert e.query("orchestration deployment", now=NOW).first().doc_id == "a.md"


def test_unchanged_documents_are_skipped(spark, tmp_path):
    e, d = Engine(spark, str(tmp_path)), docs(spark, [("a.md", "one", NOW)])
    assert e.index(d) == (1, 0)
    assert e.index(d) == (0, 1)
    assert e.index(docs(spark, [("a.md", "two", NOW)])) == (1, 0)
    assert [r.content for r in e.documents().collect()] == ["two"]


def test_recency(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.index(docs(spark, [("new.md", "zebra stripes", NOW), ("old.md", "zebra stripes", NOW - dt.timedelta(days=365)), ("other.md", "nothing here", NOW)]))
    flat = {r.doc_id: r.score for r in e.query("zebra", now=NOW).collect()}
    boosted = {r.doc_id: r.score for r in e.query("zebra", recent=True, now=NOW).collect()}
    assert flat.keys() == boosted.keys() == {"new.md", "old.md"}
    assert boosted["new.md"] > boosted["old.md"] and boosted["new.md"] > flat["new.md"]


def test_parser():
    assert parse_query("alpha beta", NOW).keywords == ["alpha", "beta"] and not parse_query("alpha beta", NOW).negations
    assert parse_query("deploys not CI/CD", NOW).negations == ["CI/CD"]
    p = parse_query("blog post about rust", NOW)
    assert p.type_filter == "markdown" and "rust" in p.keywords
    assert parse_query("cannot be javascript context", NOW).type_filter is None


@pytest.mark.parametrize("n", [999, 1000, 1001, 4500])
def test_chunks(n):
    text = ("Some words stand here. " * 300)[:n]
    out = chunking.chunk_text(text)
    assert all(0 < len(c) <= 1000 for c in out) and "".join("".join(out).split()) == "".join(text.split())
    assert all(len(c) <= 1000 for c in chunking.chunk_text("x" * n))
    assert chunking.chunk_text("tiny\n\nalso tiny") == ["tiny also tiny"]


def test_sections(spark):
    rows = chunking.sections(spark.createDataFrame([(1, "import os\ndef f():\n  pass\nclass A:\n  def g(self):\n    pass")], "doc_id int, text string"), "doc_id", "text").orderBy("section").collect()
    assert [(r.section, r.start_line, r.end_line) for r in rows] == [(1, 2, 3), (2, 4, 4), (3, 5, 6)]


def test_levels_name_the_heaviest_parent(spark):
    edges = spark.createDataFrame([(1, 2, 5), (1, 3, 9), (2, 4, 1), (3, 4, 2), (5, 6, 1)], "a long, b long, weight long")
    found = {r.node: (r.depth, r.parent) for r in graph.levels(edges, 1, 5).collect()}
    assert found == {1: (0, None), 2: (1, 1), 3: (1, 1), 4: (2, 3)}


def test_resolution_is_greedy_and_idempotent(spark):
    names = [(1, "Dr. Jane Ellen Smith", "person"), (2, "Jane Ellen Smith", "person"), (3, "Smith", "person"), (4, "J. Smith", "person"), (5, "Acme Corp", "organization"), (6, "Acme", "organization"), (7, "Bob", "person")]
    found = {r.alias_id: r.canonical_id for r in resolution.resolve(spark.createDataFrame(names, "id long, name string, entity_type string")).collect()}
    assert set(found) & set(found.values()) == set()
    assert 7 not in found and len(found) == 4


def test_resolution_finds_names_inside_words(spark):
    names = [(1, "Yorkshire", "location"), (2, "York", "location"), (3, "東京都新宿区", "location"), (4, "京都新宿", "location"), (5, "Yor", "location"), (6, "Rosemary Anne", "person"), (7, "mary anne", "person"), (8, "mary", "person")]
    found = {r.alias_id: r.canonical_id for r in resolution.resolve(spark.createDataFrame(names, "id long, name string, entity_type string")).collect()}
    assert found == {2: 1, 4: 3, 7: 6}


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Hi")
    (tmp_path / "t.tsv").write_text("x\ty\n1\t2\n3\n")
    (tmp_path / "p.html").write_text("<p>One &amp; two</p><script>x</script>")
    (tmp_path / "skip.bin").write_text("no")
    found = {r.name: r for r in readers.files(spark, str(tmp_path)).collect()}
    assert set(found) == {"a.md", "t.tsv", "p.html"}
    assert found["t.tsv"].content == "Columns: x, y\n\nx: 1 | y: 2\nx: 3"
    assert found["p.html"].content.strip() == "One & two"


def test_query_words_are_cut_like_the_index(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.index(docs(spark, [("a.md", "rust for ci/cd pipelines", NOW), ("b.md", "rust in the kitchen, ci of a cd", NOW), ("c.md", "nothing", None)]))
    assert {r.doc_id for r in e.query("rust?", now=NOW).collect()} == {"a.md", "b.md"}
    assert {r.doc_id for r in e.query("rust not CI/CD", now=NOW).collect()} == {"b.md"}
    assert {r.id for r in e.phrase(["ci", "cd"]).collect()} == {"a.md"}
    assert e.query("", now=NOW).count() == 0 and Engine(spark, str(tmp_path), "empty").query("rust").count() == 0


def test_dates_entities_and_replaced_documents(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.index(docs(spark, [("a.md", "zebra MyClass v1.2.3", NOW), ("b.md", "zebra", NOW - dt.timedelta(days=400)), ("c.md", "zebra", None)]))
    assert {r.doc_id for r in e.query("zebra", now=NOW, after=NOW - dt.timedelta(days=9)).collect()} == {"a.md", "c.md"}
    assert {r.doc_id for r in e.query("zebra", now=NOW, before=NOW - dt.timedelta(days=9)).collect()} == {"b.md", "c.md"}
    flat, recent = ({r.doc_id: r.score for r in e.query("zebra", now=NOW, recent=x).collect()} for x in (False, True))
    assert recent["c.md"] == flat["c.md"] and recent["a.md"] > flat["a.md"]
    named = {r.doc_id: r.score for r in e.query("zebra", now=NOW, names=["MyClass", "Other"]).collect()}
    assert named["a.md"] == pytest.approx(flat["a.md"] + 0.15) and named["b.md"] == flat["b.md"]
    assert {(r.a, r.b, r.weight) for r in e.edges().collect()} == {("MyClass", "v1.2.3", 1)} and e.related("MyClass").first().dst == "v1.2.3"
    e.index(docs(spark, [("a.md", "lion", NOW)]))
    assert e.mentions().count() == 0 and {r.doc_id for r in e.query("zebra", now=NOW).collect()} == {"b.md", "c.md"}
    assert [r.doc_id for r in e.query("lion", now=NOW).collect()] == ["a.md"]


def test_fused_with_vectors(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.index(docs(spark, [("a.md", "zebra zebra", NOW), ("b.md", "zebra and much more of it", NOW), ("v.md", "striped horse", NOW)]))
    dense = spark.createDataFrame([("v.md", 0.9), ("a.md", 0.1)], "id string, score double")
    assert e.query("zebra", now=NOW, dense=dense, alpha=0.9).first().doc_id == "v.md"
    assert {r.doc_id for r in e.query("zebra", now=NOW, dense=dense, alpha=0.0).collect()} == {"a.md", "b.md"}


def test_mentions_of_every_kind_and_any_length(spark):
    text = "See https://x.y/z). Mail a.b@c.d on 2024-01-02, March 4, 2024 or 03/04/2024; v1.2.3-rc1 of MyClass, snake_case and The_"
    rows = [(1, text), (2, "a" + "_b" * 300_000), (3, "1" * 300_000), (4, "a." * 200_000), (5, None), (6, "")]
    found = graph.located_mentions(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    one = {(r.entity_type, r.value) for r in found if r.id == 1}
    assert one >= {("url", "https://x.y/z"), ("email", "a.b@c.d"), ("date", "2024-01-02"), ("date", "March 4, 2024"), ("date", "03/04/2024"), ("version", "v1.2.3-rc1"), ("identifier", "MyClass"), ("identifier", "snake_case")}
    assert all(text.encode()[r.offset :].startswith(r.value.encode()) for r in found if r.id == 1)
    assert [r.value for r in found if r.id == 2] == [rows[1][1]] and not [r for r in found if r.id in (3, 5, 6)]


def test_titles_and_endings_go_by_type(spark):
    rows = [(1, "Vice President Jane Roe", "person"), (2, "Jane Roe", "person"), (3, "President Hotel", "organization"), (4, "Hotel", "location"), (5, "Acme Holdings", "organization"), (6, "acme", "organization")]
    found = {r.alias_id: r.canonical_id for r in resolution.resolve(spark.createDataFrame(rows, "id long, name string, entity_type string")).collect()}
    assert found == {2: 1, 6: 5}


def test_best_spans_apart(spark):
    from corpuslens.operators import spans

    rows = [(1, [(0.9, 2, 5), (0.8, 4, 7), (0.7, 5, 6), (0.7, 0, 2)]), (2, [])]
    found = spark.createDataFrame(rows, "id int, s array<struct<score:double,start:int,end:int>>").select("id", spans.apart(F.col("s")).alias("s")).collect()
    assert {r.id: [(x.start, x.end) for x in r.s] for r in found} == {1: [(0, 2), (2, 5), (5, 6)], 2: []}


def test_a_text_that_comes_back_is_a_change(spark, tmp_path):
    from corpuslens.streaming.watch import ingest_available

    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    rows = lambda t: spark.createDataFrame([(1, t), (2, "same")], "doc_id long, text string")
    hashes = []
    for t in ("one", "two", "one"):
        rows(t).coalesce(1).write.mode("append").parquet(source)
        hashes.append({r.doc_id: r.hash for r in ingest_available(spark, rows("").schema, source, state).collect()})
    assert hashes[0] == hashes[2] != hashes[1] and all(len(h) == 2 for h in hashes)


def test_small_scalars(spark):
    from corpuslens.functions import text as T

    row = spark.createDataFrame([("x\n  # Title here \n# Other", "a \0b  \fc\t\nd\n", 1536, "2024-03")], "md string, pdf string, n long, d string")
    got = row.select(T.markdown_title(F.col("md")), T.pdf_cleaned(F.col("pdf")), T.bytes_written(F.col("n")), T.date_argument(F.col("d"))).first()
    assert tuple(got) == ("Title here", "a b\n\nc\nd", "1.5 KB", dt.datetime(2024, 3, 1))


def test_copies_of_a_name_are_no_pairs(spark):
    kinds = [("Large Ring", "location"), ("Ring", "location"), ("Anvil", "location"), ("Jane Roe", "person"), ("J. Roe", "person")]
    rows = [(i, *kinds[i % 5]) for i in range(20_000)] + [(0, "Roe", "person"), (5, "Jane Roe", "person")]  # ids are unique within a type only
    found = sorted(map(tuple, resolution.resolve(spark.createDataFrame(rows, "id long, name string, entity_type string")).collect()))
    first = {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}
    assert found == sorted([(i, first[i % 5]) for i in range(20_000) if first[i % 5] != i] + [(0, 3), (5, 3)])


def test_dull_words_are_cut_before_patterns_and_nothing_changes(spark, monkeypatch):
    import random

    r = random.Random(5)
    bits = ["May", "x_May", "June", "5,", "5", "2024", "2024-01-02", " ", " ", "٥", "a.b@c.d", "@", "/", "~/x", "./w", "http://a", "v1.2", "1.2.3-rc", "aB", "MyClass", "A_B", "s_t", "ABc", "Foo", "ñu", "Ñu", "wor.d", "京", ";", "-", ",", "\u0085"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", " ", "\n", "\t", "  ", "\x0b", "\x1f"]) for _ in range(r.randrange(30))) for _ in range(4000)]
    texts += ["plain words, " * 100_000, "x_May and 5, 2024", "in May 5, 2024", "May", " May  5 2024 "]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(8)
    cut = df.select("id", F.length(graph._telling(F.col("text"))).alias("n")).where(f"id = {4000}").first().n
    found = sorted(map(tuple, graph.mentions(df, "id", "text").collect()))
    monkeypatch.setattr(graph, "_telling", lambda text: text)
    assert cut < 10 and found == sorted(map(tuple, graph.mentions(df, "id", "text").collect())) and len(found) > 5000


def test_vector_pairs_by_blocks(spark, monkeypatch):
    import random

    from corpuslens.operators import retrieval

    monkeypatch.setattr(retrieval, "BLOCK", 3)  # many blocks, some of them empty
    r = random.Random(7)
    rows = [(r.choice("ab"), i, [r.choice([-0.5, 0.1, 0.3, 0.7, 1.0]) for _ in range(3)]) for i in range(60)]
    rows += [("a", 5, [1.0, 1.0, 1.0]), ("a", 90, [float("nan"), 0.0, 0.0]), ("a", 91, [float("inf"), 0.0, 1.0]), ("a", 92, [1e300, 1e300, -1e300]), ("a", 93, [1.0, None, 1.0]), ("a", 94, None), ("a", 95, []), ("a", 96, [1.0] * 4), ("b", 97, [1.0] * 4), ("b", 98, [1.0] * 4), (None, 99, [1.0] * 3)]
    v = spark.createDataFrame(rows, "label string, id long, vector array<double>")
    x, y = v.select("label", F.col("id").alias("a"), F.col("vector").alias("ea")), v.select("label", F.col("id").alias("b"), F.col("vector").alias("eb"))
    plain = x.join(y, "label").where("a < b").select("label", "a", "b", F.round(retrieval.dot(F.col("ea"), F.col("eb")), 6).alias("score")).where("score >= 0.3")
    found, wanted = (sorted(map(str, df.collect())) for df in (retrieval.pairs_above(v, 0.3), plain))
    assert found == wanted and len(found) > 300
    assert "CartesianProduct" not in (p := retrieval.pairs_above(v, 0.3)._jdf.queryExecution().toString()) and "FlatMapGroupsInArrow" in p


def test_pairs_come_in_parts_by_what_is_read(spark, monkeypatch, tmp_path):
    import itertools
    import random
    from collections import Counter, defaultdict

    r = random.Random(3)
    rows = [(r.choice([1, 2, 3, 4, None]), r.choice([7, 8, 9, None]), r.choice([*range(12), None])) for _ in range(300)]
    chunks = defaultdict(set)
    for chunk, doc, entity in rows:
        if None not in (chunk, doc, entity):
            chunks[chunk, doc].add(entity)
    weight, documents = Counter(), defaultdict(set)
    for (_, doc), held in chunks.items():
        for pair in itertools.combinations(sorted(held), 2):
            weight[pair] += 1
            documents[pair].add(doc)
    made = spark.createDataFrame(rows, "chunk long, doc long, entity long")
    assert graph._parts(made) == 8
    made.coalesce(1).write.parquet(str(tmp_path / "m"))
    df = spark.read.parquet(str(tmp_path / "m"))
    monkeypatch.setattr(graph, "PART_MB", 1e-4)
    edges = graph.cooccurrence(df)
    assert {(x.a, x.b): (x.weight, x.doc_count) for x in edges.collect()} == {p: (n, len(documents[p])) for p, n in weight.items()}
    assert graph._parts(df) > 8 and edges._jdf.queryExecution().toString().count("REPARTITION_BY_NUM") >= 2
    near = graph.neighbours(graph.cooccurrence(graph.beside(df, 5)), 5)
    assert {(x.dst, x.weight) for x in near.collect()} == {(sum(p) - 5, n) for p, n in weight.items() if 5 in p}


def test_nodes_are_counted_in_one_reading(spark, tmp_path):
    from corpuslens.operators import entities

    spark.createDataFrame([("a", "v1.2 and v1.2, MyClass"), ("b", "v1.2"), ("c", None)], "id string, text string").write.parquet(str(tmp_path / "t"))
    found = entities.counted_nodes(graph.mentions(spark.read.parquet(str(tmp_path / "t")), "id", "text"))
    assert {(r.name, r.entity_type, r.chunks) for r in found.collect()} == {("v1.2", "version", 2), ("MyClass", "identifier", 1)}
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
