"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuslens.llm import ann, bpe, common, decontam, licenses, linededup, ngramjoin, pii, quality, sharding, tokencount

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, n_removed int, row long, sig string"
ODD = [None, "", " \n\t ", "Same line here now ok.", "Same line here now ok.", "é" * 9000, "1 " * 4000, "a b", "A  B", "\0\x01", "<|endoftext|> x <|startoftext|>"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Rows with near copies, edited lines and everything odd; doc_id 7 twice and one row without."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    base = ["\n".join(" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    texts = list(ODD) + base
    for t in base[:15]:
        for _ in range(3):
            w = re.split(r"( |\n)", t)
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(0, len(w), 2)] = word()
            texts.append("".join(w))
    rows = [(k, t, "en", 5, 9, "s") for k, t in enumerate(texts)]
    rows += [(7, base[3], "en", 1, 1, "s"), (7, base[3], "en", 1, 1, "s"), (None, base[4], None, None, None, None)]
    rng.shuffle(rows)
    df = common.keep(spark.createDataFrame(rows, SCHEMA).repartition(3), "corpus")
    return df, [tuple(r) for r in df.select("doc_id", "text").collect()]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(spark, corpus):
    df, rows = corpus
    found = sharding.shard(df, shards=16).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(k, [])) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(empty(spark)).count() == 0


def test_matrix_has_its_sums_and_law():
    m = sharding.matrix([5, 0, 9, 2], [4, 4, 4, 4], 1)
    assert [sum(r) for r in m] == [5, 0, 9, 2] and [sum(c) for c in zip(*m)] == [4] * 4
    rng = random.Random(2)
    drawn = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(drawn) - 6) < 0.15 and abs(np.var(drawn) - 20 * 0.3 * 0.7 * 80 / 99) < 0.35


def test_licenses(spark):
    texts = [None, "", "Released under the MIT License.", "x. Licensed under the Apache License, Version 2.0.\nBye.", "Permission is hereby granted to nobody.", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
    df = spark.createDataFrame([(k, t, "", 0, 0, "") for k, t in enumerate(texts)], SCHEMA)
    assert [r.licenses for r in licenses.scan(df).orderBy("doc_id").collect()] == ["", "", "mit", "apache-2.0", "", "bsd-2-clause"]
    assert licenses.scan(empty(spark)).count() == 0


def licensed(spark, texts):
    df = spark.createDataFrame([(k, t, "", 0, 0, "") for k, t in enumerate(texts)], SCHEMA)
    return licenses.scan(df).orderBy("doc_id").collect()


GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
BSD = [
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.",
]


def test_licenses_in_canonical_form(spark):
    texts = ["SPDX-License-Identifier: MIT", "x\nSPDX-License-Identifier: Apache-2.0\n", "SPDX-License-Identifier: GPL-3.0-or-later", GPL, "\n\n".join(BSD)]
    found = licensed(spark, texts)
    assert [r.licenses for r in found] == ["mit", "apache-2.0", "gpl-3.0", "gpl-3.0", "bsd-2-clause"]
    assert [r.sentence_ids for r in found] == ["s18", "s19", "s20", "s15", "s12,s13,s14"]


APACHE = """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_licenses_in_comments_and_lines_without_a_stop(spark):
    marked = ["\n".join(f"{m} {line}".rstrip() for line in APACHE.split("\n")) for m in ("#", "//", " *", "--", "")]
    found = licensed(spark, [*marked, "/*\n" + marked[2] + "\n */\nint x;"])
    assert {(r.sentence_ids, r.licenses) for r in found} == {("s05,s06,s07,s08,s09", "apache-2.0,apache-2.0")}
    texts = ["Released under the MIT License\nmore prose here.", "Some prose\n# Released under the MIT License\r\nx = 1", "# " + GPL.replace("\n", "\n# "), "(a) " + BSD[0] + "\n" + BSD[1].replace("1.", "(1)") + "\n" + BSD[2].replace("2.", "b)"), "It was not released under the MIT License at all."]
    assert [r.licenses for r in licensed(spark, texts)] == ["mit", "mit", "gpl-3.0", "bsd-2-clause", ""]


GNU = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License\nas published by the Free Software Foundation; either\nversion {2} of the License, or (at your option) any later version."
ENDORSE = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."
COMMON = [
    ("\n\n".join([*BSD, ENDORSE]), "bsd-3-clause"),
    ("\n".join(b.replace("1.", "*").replace("2.", "*") for b in [*BSD, ENDORSE.replace("3.", "*")]), "bsd-3-clause"),
    ("\n".join([*BSD, "3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\nThis product includes software developed by the organization.", ENDORSE.replace("3.", "4.")]), "bsd-4-clause"),
    (GNU.format("program", "", "2"), "gpl-2.0"), (GNU.format("library", "Lesser ", "2.1"), "lgpl-2.1"), (GNU.format("library", "Library ", "2"), "lgpl-2.0"), (GNU.format("program", "Lesser ", "3"), "lgpl-3.0"),
    (GPL.replace("GNU General", "GNU Affero General"), "agpl-3.0"), (GPL.replace("This program", "Foo Bar"), "gpl-3.0"),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n", "gpl-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "isc"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.", "0bsd"),
    ("// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt)", "bsl-1.0"),
    ("All rights reserved. This program and the accompanying materials\nare made available under the terms of the Eclipse Public License v1.0\nwhich accompanies this distribution, and is available at\nhttp://www.eclipse.org/legal/epl-v10.html", "epl-1.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0"),
    ("Licensed under CC BY-NC-ND 3.0", "cc-by-nc-nd-3.0"), ("This work is licensed under the Creative Commons Attribution-NonCommercial 2.5 Generic License.", "cc-by-nc-2.5"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "cc0-1.0"),
    ("1. The origin of this software must not be misrepresented; you must not\n   claim that you wrote the original software.", "zlib"),
    ("/* SPDX-License-Identifier: LGPL-2.1-only */", "lgpl-2.1"), ("# SPDX-License-Identifier: MIT OR Apache-2.0\nx = 1", "mit,apache-2.0"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"), ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "gpl-2.0,classpath-exception-2.0"),
]


def test_common_licenses_are_known(spark):
    assert [r.licenses for r in licensed(spark, [t for t, _ in COMMON])] == [name for _, name in COMMON]
    assert [(r.open_ids, r.licenses) for r in licensed(spark, ["See here.\n" + ENDORSE, BSD[0], "\n".join(BSD)])] == [("no-endorsement", ""), ("s12", ""), ("", "bsd-2-clause")]


def test_every_license_sentence_and_rule_is_found(spark):
    assert [r.sentence_ids for r in licensed(spark, [f"{v}." for v in licenses.SENTENCES.values()])] == [*licenses.SENTENCES]
    assert [r.licenses for r in licensed(spark, [". ".join(licenses.SENTENCES[i] for i in ids) + "." for _, ids in licenses.RULES])] == [name for name, _ in licenses.RULES]


def test_line_dedup(spark, corpus):
    df, rows = corpus
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, want = [], []
    for k in order:
        doc_id, text = rows[k]
        kept = []
        for line in [] if text is None else text.split("\n"):
            s = {w for w in re.split(r"[\W_]+", line.lower()) if w}
            if not s or not any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        want.append((str(doc_id), None if text is None else "\n".join(kept)))
    found = linededup.dedup(df)
    assert set(found.columns) == {*df.columns, "n_lines"}
    assert Counter((str(r.doc_id), r.text) for r in found.collect()) == Counter(want)
    assert linededup.dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("counted", [1, 1 << 30])
def test_line_dedup_is_the_same_whatever_is_counted(spark, corpus, counted, monkeypatch):
    df, _ = corpus
    want = Counter((r.doc_id, r.text, r.n_removed) for r in linededup.dedup(df).collect())
    monkeypatch.setattr(linededup, "COUNTED", counted)
    assert Counter((r.doc_id, r.text, r.n_removed) for r in linededup.dedup(df).collect()) == want


def test_line_dedup_makes_sets_outside_lambdas(spark, corpus, monkeypatch):
    """What stands in a lambda or under one is interpreted word by word: there, sets and sorting took most of the query's time."""
    plans, keep = {}, common.keep
    monkeypatch.setattr(common, "keep", lambda df, tag: (plans.setdefault(tag, df._jdf.queryExecution().optimizedPlan().toString()), keep(df, tag))[1])
    linededup.dedup(corpus[0])
    assert not re.search(r"lambdafunction\((array_distinct|sort_array|named_struct|split)|(transform|aggregate)\((array_distinct|sort_array)", plans["lines"])


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("block", [1 << 25, 200])
def test_decontamination(spark, corpus, block, monkeypatch):
    df, rows = corpus
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    items = [(k, t) for k, t in enumerate([" ".join(words(rows[j][1])[2:30]) for j in range(0, len(rows), 4)] + ["a b", None, "", "1 " * 20])]
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = Counter()
    for doc_id, text in rows:
        w, hit, who = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if x := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    who |= x
        want[doc_id, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(map(str, who))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.judged(decontam.find(df, bench)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == want
    cleaned = decontam.clean(df, bench)
    assert cleaned.columns == df.columns and cleaned.count() == sum(n for k, n in want.items() if not k[5])
    assert decontam.find(df, bench.limit(0)).where("size(spans) > 0").count() == 0 and decontam.find(empty(spark), bench).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1200, 24))
    v[100:500] = v[0]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(1300, None), (1400, [0.0] * 24), (1500, [float("nan")] * 24), (1600, [None] * 24), (1700, [1.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = {}
    for r in ann.neighbours(df).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 1200, 100):
        far = np.sqrt(((v - v[q]) ** 2).sum(1))
        best = [k for k in np.lexsort((np.arange(1200), far)).tolist() if k != q][:10]
        assert len(found[q]) == 10 and all(abs(far[k] - s) < 1e-9 for k, s in found[q])
        hits, total = hits + len(set(best) & {k for k, _ in found[q]}), total + 10
        if q in (0, 100, 200, 300, 400):
            assert [k for k, _ in found[q]] == best
    assert set(found) == set(range(0, 1200, 100)) and hits / total >= 0.9
    few = ann.neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1)]
    assert ann.neighbours(df.limit(0)).count() == 0


def test_token_counts_and_round_trip(spark, corpus):
    df, rows = corpus
    rng = random.Random(9)
    signs = [*"  \n\t''srtvemdlLE'09!?._-éß 　中🙂Σςİ²Ⅷ\x1c", "<|endoftext|>", "'re", "'ll"]
    texts = [t for _, t in rows] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    data = spark.createDataFrame([(k, t, "", 0, 0, "") for k, t in enumerate(texts)], SCHEMA).repartition(3)
    whole = [t or "" for t in texts]
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(k, len(t.encode()), len(e.ids), len(e.ids) > 30) for k, (t, e) in enumerate(zip(whole, Tokenizer.from_file(path).encode_batch(whole, add_special_tokens=False)))]
    assert sorted(map(tuple, tokencount.count(data, path, limit=30).collect())) == want
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    t = Tokenizer.from_file(path)
    t.no_truncation()
    want = [(k, len(e.ids), e.ids, t.decode(e.ids, skip_special_tokens=False)) for k, e in enumerate(t.encode_batch(whole, add_special_tokens=False))]
    assert sorted(map(tuple, bpe.encode(data, path, digest=False).collect())) == want
    assert tokencount.count(empty(spark), path).count() == bpe.encode(empty(spark), path).count() == 0


def test_quality(spark):
    rng = random.Random(3)
    good = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 300)))
    bad = lambda: good()[: rng.randint(10, 900)] + " ".join(w.upper() + "!!" for w in good().split())
    rows = [(k, good() if k % 2 else bad(), "", 0, 0, "") for k in range(400)] + [(1000, None, "", 0, 0, ""), (1001, "", "", 0, 0, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(None, 1), (5, None), (9999, 0)], "doc_id long, quality int")
    model = quality.train(df, labels)
    found = {r.doc_id: r for r in quality.score(df, model).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([found[k].predicted == k % 2 for k in held]) > 0.95
    assert found[1000].score == found[1001].score and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, r in found.items() if r.predicted}
    assert quality.score(empty(spark), quality.train(df, labels.limit(0))).count() == 0


def test_gradient():
    rng = np.random.default_rng(0)
    m, x, bounds, y = quality.Model(), rng.standard_normal((9, quality.FEATURES)), np.array([0, 4, 9]), np.array([1.0, 0.0])
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    loss = lambda: -np.mean(np.log(np.where(y > 0, quality._sigmoid(m.forward(x, bounds)["y"]), 1 - quality._sigmoid(m.forward(x, bounds)["y"]))))
    for k, g in m.gradient(x, bounds, y).items():
        at = (0,) * m.p[k].ndim
        m.p[k][at] += 1e-6
        up = loss()
        m.p[k][at] -= 2e-6
        assert abs((up - loss()) / 2e-6 - g[at]) < 1e-5
        m.p[k][at] += 1e-6


def test_ngram_join_of_long_texts(spark):
    """Sets on both sides of widths of summaries, with similarities around the threshold."""
    rng = random.Random(11)
    texts = []
    for size in (530, 1020, 1060, 2100):
        words = [f"w{rng.randrange(400)}" for _ in range(size)]
        for edits in (0, 0, *[size // 55 + k for k in range(-4, 5, 2)]):
            own = words[: size - rng.randrange(20)]
            for k in rng.sample(range(len(own)), edits):
                own[k] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    df = common.keep(spark.createDataFrame([(k, t, "en", 0, 0, "s") for k, t in enumerate(texts)], SCHEMA).repartition(3), "long")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert len(set(brute_links(rows)[1])) not in (4, len(rows))  # some link, some don't
    agrees(spark, df, rows)


def test_ngram_join(spark, corpus):
    df, rows = corpus
    agrees(spark, df, rows)
    assert ngramjoin.linked(empty(spark)).count() == 0


def brute_links(rows):
    """(sets of shingles, component) of each row."""
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    return sets, root


def agrees(spark, df, rows):
    sets, root = brute_links(rows)
    least = {}
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            least[r] = min(least.get(r, 1 << 60), rows[k][0])
    want = Counter((rows[k][0], len(sets[k]), least.get(root[k])) for k in range(len(rows)))
    assert Counter(tuple(r) for r in ngramjoin.linked(df).collect()) == want
    one = ngramjoin.one_of_each(df)
    assert one.columns == df.columns and one.count() == len(set(root))


def test_trie_join():
    rng = np.random.default_rng(5)
    pool = np.sort(rng.integers(0, 1 << 60, 60, dtype=np.uint64))
    sets = [np.sort(rng.choice(pool, rng.integers(1, 55), replace=False)) for _ in range(60)] + [pool[:50], pool[1:50], pool[2:50]]
    rows = [(k, s.astype(">u8").tobytes()) for k, s in enumerate(sets)]
    for x in sets:
        want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(x, s)) >= 60 * len(np.union1d(x, s))]
        assert sorted(ngramjoin.trie_join(x, rows, 60)) == want


def luhn(s):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(s)))) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, d: 16 <= len(d) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 8 <= len(d) <= 15),
]


def test_pii(spark, corpus):
    rng = random.Random(8)
    signs = [*"0123456789" * 2, *" -.+()@ab_é", "4111 1111 1111 1111", "10.0.0.255", "+1 (555) 123-4567", "a.b@c.de"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(600)] + ["4111-1111-1111-1111", "1" * 5000, "x" * 3000, None, ""] + [t for _, t in corpus[1]]
    df = spark.createDataFrame([(k, t, "", 0, 0, "") for k, t in enumerate(texts)], SCHEMA).repartition(3)
    df = common.keep(df, "texts")  # read alike each time
    for r in pii.digest(pii.spans(df)).collect():
        want = [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, texts[r.doc_id] or "") if ok(m.group(), re.sub("[^0-9]", "", m.group()))]
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and r.spans.startswith(line)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in want) for kind, *_ in BASE)
    assert pii.spans(empty(spark)).count() == 0


def test_terms_that_disclose_are_generalised(spark):
    texts = [f"case {w} filed by zorblax about mail bob@corp.example today" for w in "abcdefgh"] + [f"plain words about {w} today" for w in "abcdefghijklmnopqrstuvwxyz" * 8]
    df = spark.createDataFrame([(k, t, "", 0, 0, "") for k, t in enumerate(texts)], SCHEMA).coalesce(2)
    r = pii.digest(pii.spans(df)).where("doc_id = 0").first()
    told = {texts[0][int(a) : int(b)] for kind, a, b in (s.split(":") for s in r.spans.split(",")) if kind in ("generalise", "remove")}
    assert "zorblax" in told and "today" not in told and "about" not in told
    assert "zorblax" not in pii.sanitise(df).where("doc_id = 0").first().text and "[EMAIL]" in pii.sanitise(df).where("doc_id = 0").first().text


def told(spark, texts, doc_id=0):
    """The disclosing terms that spans() finds in one of the texts."""
    df = spark.createDataFrame([(k, t, "", 0, 0, "") for k, t in enumerate(texts)], SCHEMA).coalesce(2)
    r = pii.digest(pii.spans(df)).where(f"doc_id = {doc_id}").first()
    return {texts[doc_id][int(a) : int(b)] for kind, a, b in (s.split(":") for s in r.spans.split(",") if s) if kind in ("generalise", "remove")}


PLAIN = [f"plain words filed about {w} today by mail" for w in "abcdefghijklmnopqrstuvwxyz" * 8]


@pytest.mark.parametrize("copies", [1, 2])
def test_entities_of_one_or_two_texts_are_covered(spark, copies):
    found = told(spark, [f"{w} filed by zorblax about mail bob@corp.example today" for w in ("one", "two")[:copies]] + PLAIN)
    assert "zorblax" in found and not found & {"filed", "today", "about", "mail"}


def test_copies_do_not_hide_disclosing_terms(spark):
    texts = [f"{w} filed by zorblax about mail bob@corp.example today" for w in ("one", "two", "six")]
    found = told(spark, texts * 20 + PLAIN)
    assert "zorblax" in found and found == told(spark, texts + sorted(set(PLAIN)))


def test_disclosing_terms_are_marked_in_the_whole_text(spark):
    text = "A \"zorblax\" unit.\n" + "plain words filed about today by mail " * 40 + "bob@corp.example " + "today by mail " * 2000 + "(Zorblax-7x9) é zorblax, bob\tzorblax"
    df = spark.createDataFrame([(k, t, "", 0, 0, "") for k, t in enumerate([text, *PLAIN])], SCHEMA)
    r = pii.spans(df).where("doc_id = 0").first()
    want = [(m.start(), m.end()) for m in re.finditer(r"\w+", text) if m.group().lower() in ("zorblax", "unit", "7x9", "é", "bob") and not 0 <= m.start() - text.index("bob@") < 16]
    assert sorted((x.start, x.end) for x in r.extra) == want
    assert "zorblax" not in pii.sanitise(df).where("doc_id = 0").first().text.lower()


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (103, 100)], "a long, b long")
    found = {r.node: r.root for r in common.components(links).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100}


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = common.table(spark, d, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{common.shared_dir(spark)}/stage-{k}-{random.random()}"
        stage(spark, docs, d).write.parquet(path)
        after = spark.read.parquet(path)
        assert k == 4 or after.columns == docs.columns
        assert 0 < after.count() <= docs.count(), name
        docs = after
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect())) == sorted(map(tuple, docs.collect()))

def test_rows_keep_their_numbers_however_the_table_is_split(spark, corpus):
    """The same numbers, and so the same results, at any parallelism and size of split."""
    df, _ = corpus
    path = df.kept_path
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for size in ("1k", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = common.numbered(spark.read.parquet(path))
            found.append(sorted((r.row, r.doc_id or -1) for r in rows.select("row", "doc_id").collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] and len({r for r, _ in found[0]}) == df.count()


def test_scratch_is_released_alone(spark):
    other = common.keep(spark.range(3), "other")
    with common.scratch() as own:
        mine = common.keep(spark.range(4), "mine")
    assert own == [mine.kept_path]
    common.release(spark, own)
    assert other.count() == 3
    with pytest.raises(Exception):
        mine.collect()


def test_tokenizers_know_the_library_s_characters():
    """Every assigned class of characters, also those newer than Python's tables, splits words as the library has it."""
    points = [k for k in range(0x20000) if not 0xD800 <= k < 0xE000 and not (0x3400 <= k < 0xD7A0 and k % 16 and not 0xA000 <= k < 0xAC00)]
    texts = [f"a{chr(k)}b {chr(k)} 1{chr(k)}'s" for k in points]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = str(public_tokenizers.path(name))
        library = Tokenizer.from_file(path)
        library.no_truncation(), library.no_padding()
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        if name.startswith("byte"):
            assert [len(w) for w in want] == tokencount.count_texts(texts, tokencount.Merges(path))
        else:
            mine = bpe.WordTokenizer(path)
            assert [" ".join(map(str, w)) for w in want] == [mine.text(t)[1] for t in texts]


def test_addresses_of_any_length(spark):
    """Long runs and domains neither fail nor take long; matches are the plain pattern's."""
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    texts = ["x@" + ".".join(["ab"] * 300_000), "a." * 500_000 + " b@c.d", "a@b.c_d@e.f.g%h@i.j a@b@c.d @a.b x@y", "a@b.c.d@e.f", "+" * 200_000 + "@x.y"]
    df = spark.createDataFrame([(k, t, "", 0, 0, "") for k, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: [(x["start"], x["end"]) for x in r.base if x["kind"] == 0] for r in pii.spans(df).collect()}
    assert found == {k: [m.span() for m in plain.finditer(t)] for k, t in enumerate(texts[:1] + ["b@c.d"] + texts[2:])} | {1: [(1_000_001, 1_000_006)]}
