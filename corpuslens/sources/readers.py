"""Files and tables to the documents_in schema: doc_id, name, content, content_type, content_hash, size, modified."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.functions.text import html_text

# Content types by extension.
TYPES = {
    "md": "markdown", "markdown": "markdown", "txt": "plaintext", "text": "plaintext", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "pdf": "pdf",
    "html": "html", "htm": "html", "csv": "csv", "tsv": "csv", "rs": "code:rust", "py": "code:python", "js": "code:javascript", "ts": "code:typescript", "go": "code:go", "sol": "code:solidity",
}
EXCLUDED = ["node_modules", ".git", "target", "__pycache__"]


def content_type(path: Column) -> Column:
    """By extension; null for an extension that is not read."""
    known = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def files(spark: SparkSession, folder: str | list[str], exclude: list[str] | None = None) -> DataFrame:
    """The readable files below a folder (or several), without hidden, excluded and empty ones; the hash is of the raw bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    hidden = "|".join(rf"/{n.replace('.', chr(92) + '.')}/" for n in [*EXCLUDED, *(exclude or [])])
    rows = rows.where(~F.col("path").rlike(hidden) & ~F.col("path").rlike(r"/\.[^/]+$")).withColumn("content_type", content_type(F.col("path"))).where("content_type is not null")
    raw = F.decode("content", "UTF-8")
    csv_only = F.when(F.col("content_type") == "csv", raw)  # no other text goes to Python
    table = table_text(csv_only, F.when(F.lower("path").endswith(".tsv"), "\t").otherwise(","))
    text = F.when(F.col("content_type") == "html", html_text(raw)).otherwise(F.coalesce(table, raw))
    return rows.select(F.col("path").alias("doc_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), text.alias("content"), "content_type", F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def present(spark: SparkSession, folders: list[str]) -> list[str]:
    """Those of the folders that are there."""
    paths = [(f, spark._jvm.org.apache.hadoop.fs.Path(f)) for f in folders]
    return [f for f, p in paths if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]


@F.pandas_udf(T.StringType())
def table_text(raw: pd.Series, separator: pd.Series) -> pd.Series:
    """Columns: a, b and a blank line, then each row as a: 1 | b: 2. Fields may be quoted, rows ragged; rows that can't be read are left out."""

    def one(text: str | None, mark: str) -> str | None:
        if text is None:
            return None
        csv.field_size_limit(max(len(text), 1 << 17))
        rows = csv.reader(io.StringIO(text, newline=""), delimiter=mark)
        head, out = None, []
        while True:
            try:
                row = next(rows)
            except StopIteration:
                break
            except csv.Error:
                continue
            if not row:
                continue
            if head is None:
                head = row
                out += ["Columns: " + ", ".join(head), ""]
            else:
                out.append(" | ".join(f"{head[k]}: {v}" if k < len(head) and head[k] else v for k, v in enumerate(row)))
        return "\n".join(out)

    return pd.Series([one(t, m) for t, m in zip(raw, separator)], dtype=object)
