"""Licence scans: normalised sentences become identifiers, and ordered rules match the identifier sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, normalised (lower case, every other character run one space).
SENTENCES = {
    "s01": "licensed under the apache license version 2 0",
    "s02": "released under the mit license",
    "s03": "this work is licensed under the gnu general public license version 3",
    "s04": "licensed under cc by nc 4 0",
    "s05": "licensed under the apache license version 2 0 the license",
    "s06": "you may not use this file except in compliance with the license",
    "s07": "you may obtain a copy of the license at",
    "s08": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "s09": "see the license for the specific language governing permissions and limitations under the license",
    "s10": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "s11": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "s12": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "s13": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "s14": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "s15": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "s16": "this work is licensed under a creative commons attribution 4 0 international license",
    "s17": "this is free and unencumbered software released into the public domain",
    "s18": "spdx license identifier mit",
    "s19": "spdx license identifier apache 2 0",
    "s20": "spdx license identifier gpl 3 0 or later",
}

# Rules in the order in which they are tried; longer sequences come before their parts.
RULES = [
    ("apache-2.0", ["s05", "s06", "s07"]),
    ("apache-2.0", ["s05", "s06"]),
    ("mit", ["s10", "s11"]),
    ("bsd-2-clause", ["s12", "s13", "s14"]),
    ("apache-2.0", ["s01"]),
    ("apache-2.0", ["s08", "s09"]),
    ("apache-2.0", ["s19"]),
    ("mit", ["s02"]),
    ("mit", ["s10"]),
    ("mit", ["s18"]),
    ("gpl-3.0", ["s03"]),
    ("gpl-3.0", ["s15"]),
    ("gpl-3.0", ["s20"]),
    ("cc-by-nc-4.0", ["s04"]),
    ("cc-by-4.0", ["s16"]),
    ("unlicense", ["s17"]),
]

# Where a sentence ends, in patterns that Java and RE2 read alike.
_STOP = r"([.!?;:])\s+"
_LEAD = r"\n\s*(\n|Licensed |Released |This |Permission |Redistribution|SPDX|Copyright )"
_OTHER = r"[^a-z0-9]+"
_CUT = "\x01"


def sentences(text: Column) -> Column:
    """The sentences of a text: a stop followed by white space ends one, and so does an empty line or a line break before a word that opens licence lines."""
    marked = F.regexp_replace(F.regexp_replace(text, _LEAD, f"{_CUT}$1"), _STOP, f"$1{_CUT}")
    return F.filter(F.transform(F.split(marked, _CUT), lambda s: F.trim(F.regexp_replace(F.lower(s), _OTHER, " "))), lambda s: s != "")


_WORDS = "(?:[a-z0-9]+ ){1,16}"


def _gnu(kind: str, version: str, title: str) -> str:
    """The sentences of one version of a GNU licence: notices with later versions or without, the version before or after the publisher, short forms, and the licence's own title."""
    name, fsf = f"gnu {kind}general public license", "as published by the free software foundation"
    head = f"(?:[a-z0-9]+ ){{1,8}}is free software you can redistribute it and or modify it under the terms of the {name} "
    notice = f"{head}(?:{fsf} (?:either )?version {version} of the license or at your option any later version|{fsf} version {version}(?: of the license)?(?: only)?|version {version}(?: only)? {fsf})"
    short = f"(?:this [a-z]+ is )?(?:licensed|released|distributed) under the (?:terms of the )?{name} v(?:ersion)? ?{version}(?: only| or later)?"
    return f"(?:{notice}|{short}|{name} version {title})"


def _cc(kind: str, short: str, version: str) -> str:
    """The sentences of one version of a Creative Commons licence, by its name or by its short one."""
    long = f"(?:the |a )?creative commons attribution{kind} {version}(?: unported| international| generic)?(?: public)? license"
    return f"(?:(?:this|the) [a-z]+ is )?licensed under (?:{long}|(?:the |a )?(?:creative commons )?cc {short} {version}(?: license)?)"


_PRIOR = "be used to endorse or promote products derived from this software without (?:specific )?prior written permission"
_EPL = "(?:all rights reserved )?this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?{} 0(?: which (?:accompanies this distribution(?: and )?)?(?:is available at)?)?"
_ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
_KINDS = {"by": "", "by sa": " share ?alike", "by nd": " no ?deriv(?:ative)?s", "by nc": " non ?commercial", "by nc sa": " non ?commercial share ?alike", "by nc nd": " non ?commercial no ?deriv(?:ative)?s"}

#: More known sentences, as patterns over normalised text. The SQL knows the fixed ones only; these are tried after them.
MORE = {
    "no-endorsement": f"(?:neither the names? of {_WORDS}nor the names of {_WORDS}may|the names? of {_WORDS}(?:may|must) not) {_PRIOR}",
    "advertising": "all advertising materials mentioning features or use of this software must display the following acknowledge?ment",
    "acknowledgement": "this product includes software developed by (?:[a-z0-9]+ ){0,30}?[a-z0-9]+",
    "gpl-2.0": _gnu("", "2(?: 0)?", "2 june 1991"),
    "gpl-3.0": _gnu("", "3(?: 0)?", "3 29 june 2007"),
    "lgpl-2.0": _gnu("(?:library|lesser) ", "2(?: 0)?", "2 june 1991"),
    "lgpl-2.1": _gnu("(?:library|lesser) ", "2 1", "2 1 february 1999"),
    "lgpl-3.0": _gnu("lesser ", "3(?: 0)?", "3 29 june 2007"),
    "agpl-3.0": _gnu("affero ", "3(?: 0)?", "3 19 november 2007"),
    "apache-2.0": "apache license version 2 0 january 2004",
    "mpl-2.0": "(?:this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0|mozilla public license version 2 0)",
    "mpl-1.1": "the contents of this file are subject to the mozilla public license version 1 1(?: the license)?",
    "isc": f"{_ISC} provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd": _ISC,
    "bsl-1.0": "(?:distributed under the boost software license version 1 0|boost software license version 1 0 (?:17th )?august 17(?:th)? 2003|permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following)",
    "epl-1.0": _EPL.format(1),
    "epl-2.0": _EPL.format(2),
    "zlib": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "cc0-1.0": f"(?:to the extent possible under law {_WORDS}(?:has|have) (?:waived|dedicated) all copyright and related or neighboring rights to {_WORDS}?[a-z0-9]+|(?:licensed under )?(?:the )?(?:creative commons )?cc0 1 0(?: universal)?(?: public domain dedication)?)",
    **{f"cc {k} {v}".replace(" ", "-"): _cc(kind, k, v.replace(".", " ")) for k, kind in _KINDS.items() for v in ("1.0", "2.0", "2.5", "3.0", "4.0")},
}

#: Rules over these: longer ones, tried before the fixed ones; each other sentence is a rule by itself, but for the clauses.
LONGER = [
    *[("bsd-4-clause", ["s12", "s13", "s14", "advertising", *rest]) for rest in (["acknowledgement", "no-endorsement"], ["no-endorsement"], [])],
    ("bsd-3-clause", ["s12", "s13", "s14", "no-endorsement"]),
]
SINGLE = [(k, [k]) for k in MORE if k not in ("no-endorsement", "advertising", "acknowledgement")]

#: Any other SPDX line, which gives the identifiers that it holds.
_SPDX = r"(?<=\|)spdx[ |]license[ |]identifier[ |]([a-z0-9]+(?: [a-z0-9]+){0,30})(?=\|)"

#: What every known sentence holds one of; other texts need no look.
_MAY = r"(?i)licens|permission|redistribution|unencumbered|advertising|product\s|misrepresented|possible|cc0"
#: A piece that only numbers an item of a list, and what else may number one at the start of a line, after comment marks.
_ITEM = r"^(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})$"
_LINE = r"(?m)^[^\p{L}\p{N}\r\n]*(?:(?i:rem|dnl)[ \t]+)?(?:(?:[0-9]{1,2}|[A-Za-z]|[ivx]{1,4})[.)][ \t]+)?"


def _pieces(text: Column) -> Column:
    """What stops and line breaks part, normalised as sentences are; comment marks, list numbers and what holds no letter or digit are left out."""
    bare = F.regexp_replace(text, _LINE, "")
    parts = F.split(F.regexp_replace(bare, _STOP, f"$1{_CUT}"), f"[{_CUT}\r\n]+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(F.lower(s), _OTHER, " "))), lambda s: (s != "") & ~s.rlike(_ITEM))


def _known() -> list[tuple[str, str]]:
    """(identifier, pattern) over pieces joined by |, longest fixed ones first: a known sentence takes whole pieces and may run across the ends of pieces."""
    every = [*sorted(SENTENCES.items(), key=lambda x: (-len(x[1]), x[0])), *MORE.items()]
    return [(k, r"(?<=\|)" + v.replace(" ", "[ |]") + r"(?=\|)") for k, v in every]


def _names(found: Column) -> Column:
    """Licence names; what stands on an SPDX line is parted and written as the others are."""
    found = F.flatten(F.transform(found, lambda x: F.split(F.regexp_replace(x, " (?:only|or later)(?= |$)", ""), " (?:or|and|with) ")))
    return F.transform(found, lambda x: F.replace(F.regexp_replace(x, r"(?<![a-z0-9])([0-9]+) ([0-9]+)(?![a-z0-9])", "$1.$2"), F.lit(" "), F.lit("-")))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences, n_known, sentence_ids, licenses and open_ids (the last three comma-joined, in text order) of every row.

    A known sentence begins and ends where a stop, a line break or the text does, and may run across others
    inside. n_sentences counts what sentences() gives, however many lines of one are known. Rules take adjacent
    known sentences only; list numbers between them don't count. open_ids: known sentences that complete no
    rule. Null or empty text: no sentences and empty strings. Any text length is one row's array; equal rows
    give equal results; no rows give none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    line = F.concat(F.lit("|"), F.concat_ws("|", _pieces(text)), F.lit("|"))
    for k, pattern in _known():
        line = F.regexp_replace(line, pattern, f"<{k}>")
    line = F.regexp_replace(line, _SPDX, "<spdx>{$1}")
    rows = df.select(F.col(id_col).alias("doc_id"), F.size(sentences(text)).cast("long").alias("n_sentences"), F.when(text.rlike(_MAY), line).otherwise("").alias("line"))
    ids = F.lit("<([^>]+)>")
    found = F.regexp_extract_all("line", ids, F.lit(1))
    line = F.replace("line", F.lit("<spdx>"), F.lit(""))
    for name, rule in [*LONGER, *RULES, *SINGLE]:
        line = F.replace(line, F.lit("|".join(f"<{i}>" for i in rule)), F.lit(f"{{{name}}}"))
    rows = rows.select("doc_id", "n_sentences", found.alias("found"), line.alias("line"))
    names = _names(F.regexp_extract_all("line", F.lit(r"\{([^}]+)\}"), F.lit(1)))
    return rows.select("doc_id", "n_sentences", F.size("found").cast("long").alias("n_known"), F.concat_ws(",", "found").alias("sentence_ids"), F.concat_ws(",", names).alias("licenses"), F.concat_ws(",", F.regexp_extract_all("line", ids, F.lit(1))).alias("open_ids"))


def oracle() -> str:
    """The same in DuckDB but for open_ids, for the fixed known sentences, where they are one of the text's own sentences each, without comment marks or list numbers."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quoted(v)}: {quoted(k)}" for k, v in SENTENCES.items()) + "}"
    line = "array_to_string(list_transform(ids, lambda i: '<' || i || '>'), '')"
    for name, ids in RULES:
        line = f"replace({line}, {quoted(''.join(f'<{i}>' for i in ids))}, {quoted('{' + name + '}')})"
    return f"""
WITH cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '{_LEAD}', chr(1) || '\\1', 'g'), '{_STOP}', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: trim(regexp_replace(lower(p), '{_OTHER}', ' ', 'g'))), lambda p: p <> '') AS sent FROM cut),
k AS (SELECT doc_id, len(sent)::BIGINT AS n_sentences, list_transform(sent, lambda p: coalesce({known}[p], '-')) AS ids FROM s)
SELECT doc_id, n_sentences, len(list_filter(ids, lambda i: i <> '-'))::BIGINT AS n_known, array_to_string(list_filter(ids, lambda i: i <> '-'), ',') AS sentence_ids,
       array_to_string(regexp_extract_all({line}, '\\{{([^}}]+)\\}}', 1), ',') AS licenses FROM k
"""
