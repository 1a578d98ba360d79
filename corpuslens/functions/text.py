"""Scalar text functions, as column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the query language.
STOP_WORDS = ["the", "a", "an", "about", "that", "which", "where", "files", "documents", "find", "show", "get", "me", "all", "related", "to", "of", "for", "with"]
QUESTION_WORDS = ["what", "how", "why", "when", "where", "who", "which", "does", "can", "should"]
# Tags that end a line, and entities; the ampersand is decoded last.
BLOCK_TAGS = "p|div|br|h1|h2|h3|h4|h5|h6|li|ul|ol|tr|td|th|table|section|article|header|footer|blockquote|pre"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]

BETWEEN = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Index terms: lower-case runs of letters and digits, of 40 bytes at most."""
    return F.filter(F.split(F.lower(text), BETWEEN), lambda t: (t != "") & (F.octet_length(t) <= 40))


def keywords(text: Column) -> Column:
    """Query words: parted by white space, lower case, longer than one character, no stop words."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def html_text(html: Column) -> Column:
    """The text of a page: without scripts, styles and tags, a line break for each block tag."""
    for tag in ("script", "style", "noscript"):
        html = F.regexp_replace(html, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", "")
    html = F.regexp_replace(html, rf"(?i)</?({BLOCK_TAGS})(\s[^>]*)?/?>", "\n")
    html = F.regexp_replace(html, r"<[^>]*>", "")
    for entity, char in ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n"))


def snippet(content: Column, terms: list[str]) -> Column:
    """About 300 characters around the first term met, cut at blanks, with dots where text is left out."""
    n = F.length(content)
    at = F.least(F.lit(2**31 - 1), *[F.when(F.instr(F.lower(content), t) > 0, F.instr(F.lower(content), t) - 1) for t in terms])
    found = at < 2**31 - 1
    last_blank = lambda end: F.length(F.substring(content, F.lit(1), end)) - F.instr(F.reverse(F.substring(content, F.lit(1), end)), " ")
    has = lambda end: F.instr(F.substring(content, F.lit(1), end), " ") > 0
    raw = F.when(found, F.least(at + 150, n)).otherwise(F.when(n > 300, 299).otherwise(n))
    end = F.when((raw < n) & has(raw), last_blank(raw)).otherwise(raw)
    low = F.greatest(at - 150, F.lit(0))
    near = F.when(low == 0, 0).otherwise(low - 1)
    blank = F.locate(" ", content, 1)
    blank = F.call_function("locate", F.lit(" "), content, near + 1)
    start = F.when(~found, 0).otherwise(F.when((near > 0) & (blank > 0), blank).otherwise(near))
    body = F.trim(F.substring(content, start + 1, F.greatest(end - start, F.lit(0))))
    return F.concat(F.when(found & (start > 0), "...").otherwise(""), body, F.when(found & (end < n), "...").otherwise(""))


def dynamic_alpha(query: Column, n_keywords: Column) -> Column:
    """How far to trust vectors for a query, from its shape."""
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    n = F.size(words)
    lower = F.transform(words, lambda w: F.lower(w))
    code = F.exists(words, lambda w: w.contains("_") | w.contains("::") | w.contains(".") | (w.rlike(r"\p{Lu}") & w.rlike(r"\p{Ll}") & ~w.rlike(r"^.\p{Ll}*$")))
    stops = F.size(F.filter(lower, lambda w: w.isin(STOP_WORDS)))
    parts = [
        (F.coalesce(F.get(lower, F.lit(0)), F.lit("")).isin(QUESTION_WORDS), 0.15),
        (n_keywords <= 2, -0.15),
        (n >= 5, 0.1),
        (query.contains('"'), -0.25),
        (code, -0.2),
        ((n > 0) & (stops > 0.4 * n), 0.1),
    ]
    total = F.lit(0.5)
    for when, by in parts:
        total = total + F.when(when, by).otherwise(0.0)
    return F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.05), total)), 6)


def yaml_quoted(text: Column) -> Column:
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), F.regexp_replace(text, r"[\x00-\x1f]", ""), F.lit('"'))


def markdown_title(content: Column) -> Column:
    """What follows the first line that begins with "# ", or null."""
    title = F.trim(F.regexp_extract(content, r"(?m)^[ \t]*# (.*)$", 1))
    return F.when(content.rlike(r"(?m)^[ \t]*# "), title)


def pdf_cleaned(text: Column) -> Column:
    """Text out of a PDF without zeros and line-end blanks; a form feed ends a paragraph."""
    text = F.replace(F.replace(text, F.lit("\0"), F.lit("")), F.lit("\f"), F.lit("\n\n"))
    return F.regexp_replace(F.regexp_replace(text, r"[^\S\n]+(?=\n|\z)", ""), r"\n\z", "")


def date_argument(s: Column) -> Column:
    """A timestamp of yyyy-MM-dd, yyyy-MM or yyyy; null for anything else."""
    s = F.trim(s)
    full = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), s).when(s.rlike(r"^\d{4}-\d{1,2}$"), F.concat(s, F.lit("-01"))).when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01-01")))
    return F.try_to_timestamp(full, F.lit("yyyy-M-d"))


def bytes_written(n: Column) -> Column:
    """A size for people: B, KB or MB, ties to the even digit."""
    small, mb = F.concat(n.cast("string"), F.lit(" B")), F.concat(F.format_string("%.1f", F.bround(n / (1024.0 * 1024.0), 1)), F.lit(" MB"))
    return F.when(n < 1024, small).when(n < 1024 * 1024, F.concat(F.format_string("%.1f", F.bround(n / 1024.0, 1)), F.lit(" KB"))).otherwise(mb)
