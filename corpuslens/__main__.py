"""The command line: python -m corpuslens [--home HOME] [--db DB] index FOLDER | query TEXT | tag PATH TAG | untag PATH TAG | delete PATH
| graph NAME | connect FROM TO | reindex | embed | folders | databases | tags | status."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpuslens.engine import Engine
from corpuslens.operators import structure
from corpuslens.sources import readers


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpuslens")
    p.add_argument("--home", default=".corpuslens")
    p.add_argument("--db", default="default")
    commands = p.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("folder")
    index.add_argument("--exclude", action="append", default=[])
    query = commands.add_parser("query")
    query.add_argument("text")
    query.add_argument("--limit", type=int, default=10)
    query.add_argument("--threshold", type=float, default=0.0)
    query.add_argument("--recent", action="store_true")
    query.add_argument("--tag")
    query.add_argument("--json", action="store_true")
    for name in ("tag", "untag", "delete"):
        one = commands.add_parser(name)
        one.add_argument("path")
        if name != "delete":
            one.add_argument("tag")
    near = commands.add_parser("graph")
    near.add_argument("name")
    near.add_argument("--limit", type=int, default=10)
    path = commands.add_parser("connect")
    path.add_argument("start")
    path.add_argument("goal")
    path.add_argument("--depth", type=int, default=4)
    for name in ("tags", "status", "reindex", "embed", "folders", "databases"):
        commands.add_parser(name)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("corpuslens").getOrCreate()
    engine = Engine(spark, a.home, a.db)
    if a.command == "index":
        docs = readers.files(spark, a.folder, a.exclude)
        print("indexed {}, skipped {}".format(*engine.index(docs)))
        return 0
    if a.command in ("tag", "untag", "delete"):
        ids = spark.createDataFrame([(a.path,)], "doc_id string")
        engine.delete(ids) if a.command == "delete" else getattr(engine, a.command)(ids, a.tag)
        return 0
    if a.command == "reindex":
        docs = readers.files(spark, readers.present(spark, [r.folder for r in engine.folders().toLocalIterator()]))
        print("indexed {}, skipped {}, deleted {}".format(*engine.reindex(docs)))
        return 0
    if a.command == "embed":
        print(engine.embed(), "documents with vectors")
        return 0
    if a.command == "databases":
        print(*Engine.databases(spark, a.home), sep="\n")
        return 0
    if a.command == "query":
        how = {"threshold": a.threshold, "recent": a.recent, "tag": a.tag}
        rows = engine.envelope(a.text, a.limit, **how) if a.json else engine.query(a.text, a.limit, **how)
    elif a.command == "graph":
        rows = engine.related(a.name, a.limit)
        if rows.isEmpty():
            rows = structure.suggest(engine.nodes(), a.name).select(F.lit("not found; did you mean"), "name")
    elif a.command == "connect":
        rows = engine.connect(a.start, a.goal, a.depth)
    elif a.command == "folders":
        rows = engine.folders().orderBy("folder")
    elif a.command == "tags":
        rows = engine.tags().groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")
    else:
        rows = engine.status()
    for row in rows.toLocalIterator():
        print(*row, sep="\t")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
