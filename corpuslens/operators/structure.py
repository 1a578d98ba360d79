"""Structure of documents: code definitions, markdown headings and blocks, keys of JSON, YAML and TOML; names of entities looked up."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a line that opens a definition begins with, by language; other languages take the last row.
DEFINITIONS = {
    "rust": ["fn ", "pub fn ", "struct ", "pub struct ", "enum ", "pub enum ", "impl ", "trait ", "pub trait ", "mod ", "pub mod "],
    "python": ["def ", "class ", "async def "],
    "javascript": ["function ", "class ", "const ", "export function ", "export class ", "export const ", "export default "],
    "typescript": ["function ", "class ", "const ", "export function ", "export class ", "export const ", "export default "],
    "go": ["func ", "type "],
    "solidity": ["function ", "contract ", "library ", "interface "],
    "": ["fn ", "def ", "function ", "class "],
}
_KEYWORDS = "fn|def|function|class|struct|enum|impl|trait|mod|type|func|const|contract|library|interface"


def definitions(df: DataFrame, language: str = "", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, name, start_line, end_line (from 1, inclusive), body of each definition.

    A definition goes from its opening line to the one before the next; lines before the first are dropped.
    Each text is cut within its row: no exchange. Null and empty texts, and texts without definitions, give no rows.
    """
    opens = "^(?:" + "|".join(p.rstrip() + " " for p in DEFINITIONS.get(language, DEFINITIONS[""])) + ")"
    lines = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")
    starts = F.filter(F.transform(F.col("lines"), lambda line, i: F.when(F.ltrim(line).rlike(opens), i)), lambda i: i.isNotNull())
    cut = F.transform("starts", lambda s, k: F.struct(s.alias("from"), F.coalesce(F.get("starts", k + 1), F.size("lines")).alias("to")))
    rows = df.select(F.col(id_col).alias("doc_id"), lines.alias("lines")).select("doc_id", "lines", starts.alias("starts")).select("doc_id", "lines", F.explode(cut).alias("at"))
    head = F.ltrim(F.get("lines", F.col("at.from")))
    bare = F.regexp_replace(head, rf"^(?:pub )*(?:export )*(?:default )*(?:async )*(?:(?:{_KEYWORDS}) )?", "")
    name = F.regexp_extract(bare, r"^[\p{L}\p{N}_]*", 0)
    return rows.select(
        "doc_id", F.when(name == "", F.lit(f"anonymous_{language}")).otherwise(name).alias("name"), (F.col("at.from") + 1).alias("start_line"), F.col("at.to").alias("end_line"),
        F.array_join(F.slice("lines", F.col("at.from") + 1, F.col("at.to") - F.col("at.from")), "\n").alias("body"),
    )


def heading_parent(parent: str, pos: str, depth: str) -> Column:
    """Under the same parent, the position of the nearest earlier heading of less depth (1 to 6), or null."""
    before = Window.partitionBy(parent).orderBy(pos).rangeBetween(Window.unboundedPreceding, -1)
    return F.greatest(*[F.when(F.col(depth) > k, F.max(F.when(F.col(depth) == k, F.col(pos))).over(before)) for k in range(1, 6)])


# What opens or closes fenced code, a heading, and what a link and an image look like.
_FENCE, _HEADING = r"^ {0,3}(?:```|~~~)", r"^ {0,3}#{1,6}(?:\s|$)"
_IMAGE, _RELATIVE, _LINK = r"!\[([^\]\[]*)\]\([^)]*\)", r"\[([^\]\[]*)\]\((?!https?://|#)([^)\s]+)[^)]*\)", r"\[([^\]\[]*)\]\([^)]*\)"


def _markdown_lines(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, line (from 1), raw, fences (of fenced code, up to here), depth (of a heading, else null), section (the last heading's line)."""
    lines = df.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text, r"\r?\n")).alias("n", "raw")).withColumn("line", F.col("n") + 1).drop("n")
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("fences", F.count(F.when(F.col("raw").rlike(_FENCE), 1)).over(upto))
    depth = F.when((F.col("fences") % 2 == 0) & F.col("raw").rlike(_HEADING), F.length(F.regexp_extract("raw", r"^ *(#+)", 1)))
    return lines.withColumn("depth", depth).withColumn("section", F.last(F.when(F.col("depth").isNotNull(), F.col("line")), True).over(upto))


def headings(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line (from 1), depth, title, parent (a line, or null), body of each markdown heading; none is looked for in fenced code.

    The body is what follows up to the next heading, of any depth. Ids must be unique. Null texts give no rows.
    """
    lines = _markdown_lines(df, id_col, text).where("section is not null")
    rest = F.transform(F.array_sort(F.collect_list(F.when(F.col("depth").isNull(), F.struct("line", "raw")))), lambda x: x["raw"])
    title = F.trim(F.regexp_replace(F.max(F.when(F.col("depth").isNotNull(), F.col("raw"))), r"^ *#+\s*|\s+#+\s*$", ""))
    cut = lines.groupBy("doc_id", "section").agg(F.max("depth").alias("depth"), title.alias("title"), F.trim(F.array_join(rest, "\n"), F.lit(" \n")).alias("body"))
    cut = cut.withColumnRenamed("section", "line")
    return cut.select("doc_id", "line", "depth", "title", heading_parent("doc_id", "line", "depth").alias("parent"), "body")


def blocks(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line (from 1), kind (paragraph or code), section (line of the heading above, or null), body of each block of markdown.

    Paragraphs end at blank lines, headings and fences. In them a link to a relative target becomes
    [link:target] and its text, other links and images their text. Ids must be unique; null and blank texts give no rows.
    """
    fence = F.col("raw").rlike(_FENCE)
    kind = F.when(fence, "fence").when(F.col("fences") % 2 == 1, "code").when(F.col("depth").isNotNull(), "heading").when(F.trim("raw") == "", "blank").otherwise("paragraph")
    lines = _markdown_lines(df, id_col, text).withColumn("kind", kind)
    by_line = Window.partitionBy("doc_id").orderBy("line")
    opens = F.coalesce(F.col("kind") != F.lag("kind").over(by_line), F.lit(True))
    lines = lines.withColumn("opens", opens).withColumn("block", F.count(F.when(F.col("opens"), 1)).over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "\n")
    cut = lines.where(F.col("kind").isin("code", "paragraph")).groupBy("doc_id", "block").agg(F.min("line").alias("line"), F.first("kind").alias("kind"), F.max("section").alias("section"), body.alias("body"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("body", _IMAGE, "$1"), _RELATIVE, r"[link:$2]$1"), _LINK, "$1")
    body = F.trim(F.when(F.col("kind") == "paragraph", plain).otherwise(F.col("body")), F.lit(" \t\n"))
    return cut.select("doc_id", "line", "kind", "section", body.alias("body")).where("body <> ''")


def contains(sections: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, src (a heading's line; null: the document), dst (line), kind: what headings() and blocks() lie under."""
    inner = sections.select("doc_id", F.col("parent").alias("src"), F.col("line").alias("dst"), F.lit("section").alias("kind"))
    return inner.unionByName(parts.select("doc_id", F.col("section").alias("src"), F.col("line").alias("dst"), "kind"))


def references(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, target of each relative link, once a document."""
    marks = F.regexp_extract_all("body", F.lit(r"\[link:([^\]]+)\]"), F.lit(1))
    return blocks(df, id_col, text).where("kind = 'paragraph'").select("doc_id", F.explode(marks).alias("target")).distinct()


def _json_keys(text: str) -> dict | None:
    found = json.loads(text)
    return {k: json.dumps(found[k], indent=2, sort_keys=True, ensure_ascii=False) for k in sorted(found)} if isinstance(found, dict) else None


def _yaml_keys(text: str) -> dict | None:
    try:
        import yaml
    except ImportError:
        return None
    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError:
        return None
    # A bare value is followed by a line that ends the document.
    dumped = lambda v: yaml.safe_dump(v, sort_keys=False, allow_unicode=True).removesuffix("...\n")
    return {k: dumped(v) for k, v in found.items() if isinstance(k, str)} if isinstance(found, dict) else None


def _toml_value(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ", ".join(map(_toml_value, value)) + "]"
    if isinstance(value, dict):
        return "{ " + ", ".join(f"{k} = {_toml_value(v)}" for k, v in value.items()) + " }"
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def _toml_keys(text: str) -> dict | None:
    found = tomllib.loads(text)
    return {k: "\n".join(f"{x} = {_toml_value(y)}" for x, y in v.items()) if isinstance(v, dict) else _toml_value(v) for k, v in sorted(found.items())}


_KEYS = {"json": _json_keys, "yaml": _yaml_keys, "toml": _toml_keys}


def _keys(kind: str):
    @F.pandas_udf("array<struct<key:string,value:string>>")
    def parsed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str | None) -> list[dict]:
            try:
                found = _KEYS[kind](t or "")
            except (ValueError, RecursionError):
                return []
            return [{"key": k, "value": v} for k, v in (found or {}).items()]

        for s in texts:
            yield s.map(one)

    return parsed


def object_keys(df: DataFrame, id_col: str = "doc_id", text: str = "text", kind: str = "json") -> DataFrame:
    """doc_id, key, value of each top-level key of an object of this kind (json, yaml, toml), the value written out; other texts give no rows.

    JSON and TOML have their keys in order, JSON's inner ones too; TOML writes the tables in a table inline. YAML needs
    the yaml package on the workers: without it there are no rows.
    """
    return df.select(F.col(id_col).alias("doc_id"), F.explode(_keys(kind)(text)).alias("at")).select("doc_id", "at.key", "at.value")


def keyed_chunks(df: DataFrame, id_col: str = "doc_id", text: str = "text", kind: str = "json") -> DataFrame:
    """doc_id, pos, title, body: a chunk for each top-level key; a text without keys is one chunk without a title. Null and blank texts give no rows."""
    rows = df.where(F.trim(F.col(text), F.lit(" \t\r\n")) != "").select(F.col(id_col).alias("doc_id"), F.col(text).alias("body"), _keys(kind)(text).alias("keys"))
    rows = rows.select("doc_id", "body", F.posexplode_outer("keys").alias("pos", "at"))
    return rows.select("doc_id", F.coalesce("pos", F.lit(0)).alias("pos"), F.col("at.key").alias("title"), F.coalesce("at.value", "body").alias("body"))


def lookup(entities: DataFrame, name: str, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """The entity of this name in any case, or else that with the shortest name (then by name and id) that holds it; one row at most."""
    plain, asked = F.lower(name_col), name.lower()
    return entities.where(plain.contains(asked)).orderBy(F.desc(plain == asked), F.length(name_col), name_col, id_col).limit(1)


def suggest(entities: DataFrame, part: str, name_col: str = "name", limit: int = 20) -> DataFrame:
    """Entities whose name holds part in any case, by name."""
    return entities.where(F.lower(name_col).contains(part.lower())).orderBy(name_col).limit(limit)
