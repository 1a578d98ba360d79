"""Plain-language queries to plans (driver side: one query is one small record)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from corpuslens.functions.text import QUESTION_WORDS, STOP_WORDS

# Words that name a type, in the order in which they are tried.
TYPE_WORDS = [
    (("blog posts", "blog post", "markdown", "md"), "markdown"),
    (("code", "script", "function", "source"), "code"),
    (("configuration", "config", "json", "yaml", "yml"), "yaml"),
    (("plain text", "notes", "text"), "plaintext"),
]
NEGATIONS = ["not", "except", "excluding", "without"]


@dataclass(frozen=True)
class QueryPlan:
    keywords: list[str] = field(default_factory=list)
    negations: list[str] = field(default_factory=list)
    type_filter: str | None = None
    scope_filter: str | None = None
    after: datetime | None = None
    before: datetime | None = None
    confidence: float = 0.5
    alpha: float = 0.5


def _word(text: str) -> re.Pattern:
    return re.compile(rf"(?<!\w){re.escape(text)}(?!\w)", re.IGNORECASE)


def parse_query(query: str, now: datetime | None = None) -> QueryPlan:
    """Negations, scope, type, date and keywords of a query; `now` anchors relative dates."""
    now = now or datetime.now()
    rest, negations = query, []
    for word in NEGATIONS:
        if m := _word(word).search(rest):
            negations, rest = rest[m.end() :].split(), rest[: m.start()]
            break
    scope = None
    if m := re.search(r"\b(?:in|under)\s+((?:~|\.)?/\S*)", rest):
        scope, rest = m[1], rest[: m.start()] + rest[m.end() :]
    kind = None
    for words, name in TYPE_WORDS:
        if hit := next((m for w in words if (m := _word(w).search(rest))), None):
            kind, rest = name, rest[: hit.start()] + rest[hit.end() :]
            break
    after = None
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    for words, since in (("today", midnight), ("this week", now - timedelta(days=now.weekday())), ("last month", now - timedelta(days=30)), ("recent", now - timedelta(days=7))):
        if m := _word(words).search(rest):
            after, rest = since, rest[: m.start()] + rest[m.end() :]
            break
    keywords = [w for w in rest.lower().split() if len(w) > 1 and w not in STOP_WORDS]
    confidence = 0.5 + 0.2 * (len(keywords) >= 2) + 0.1 * bool(kind) + 0.1 * bool(scope)
    return QueryPlan(keywords, negations, kind, scope, after, None, min(1.0, confidence), dynamic_alpha(query, keywords))


def _mixed(word: str) -> bool:
    return any(c.isupper() for c in word) and any(c.islower() for c in word) and not re.fullmatch(r".[^\W\d_A-Z]*", word)


def dynamic_alpha(query: str, keywords: list[str]) -> float:
    words = query.split()
    alpha = 0.5
    alpha += 0.15 * bool(words and words[0].lower() in QUESTION_WORDS) - 0.15 * (len(keywords) <= 2) + 0.1 * (len(words) >= 5)
    alpha -= 0.25 * ('"' in query) + 0.2 * any("_" in w or "::" in w or "." in w or _mixed(w) for w in words)
    alpha += 0.1 * bool(words and sum(w.lower() in STOP_WORDS for w in words) > 0.4 * len(words))
    return round(min(0.95, max(0.05, alpha)), 6)
