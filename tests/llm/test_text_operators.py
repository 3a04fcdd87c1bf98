"""Dedup, joins, decontamination and language identification against brute force."""

import collections
import hashlib
import random
import re
import textwrap

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheetlake.llm import decontamination, exact_dedup, language_id, license_scan, ngram_join, substring_dedup
from sheetlake.llm.components import components
from sheetlake.llm.queries import ORACLES, QUERIES
from sheetlake.llm.words import BLANKS, NOT_ALNUM, byte_table, ngrams, text_runs

SF = "/root/testdata/sf0.001"
LONG = "word " * 3000 + "x" * 20_000
TABLES = ("documents", "benchmark", "conversations", "embeddings")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def odd_rows(base):
    """Near copies of some texts, nulls, blanks, short and long texts, ties and repeated rows."""
    rng = random.Random(5)
    rows = []
    for k in range(40):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(len(words))] = f"zz{rng.randrange(99)}"
        rows.append((10_000 + k, " \n".join(words)))
    return rows + [
        (10_100, None), (10_101, ""), (10_102, " \t "), (10_103, "a b"), (10_104, "A  b"), (10_105, "a b c"),
        (None, "a b"), (None, None), (10_106, base[0]), (10_106, base[1]), (10_106, base[1]), (10_107, LONG),
        (10_108, LONG.upper()), (10_109, "w " * 500), (10_110, "W " * 400),
    ]


@pytest.fixture(scope="module")
def rows(spark):
    read = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(120).collect()
    rows = [(r.doc_id, r.text) for r in read]
    return rows + odd_rows([t for _, t in rows if len(t) > 900][:8])


def frame(spark, rows):
    """With extra columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = ("mark", "keep_id", "n_words", "row", "n", "cls", "root", "kept", "spans", "score", "_sha", "at")
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in extra])


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \tAé\x00\n0_") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " ", "x" * 1000]
    batch = pa.record_batch({"text": pa.array(texts)})
    for limit in (10, 1 << 20):
        for gaps, lower, pattern in (
            (BLANKS, False, r"[^\x20\x09-\x0D]+"), (NOT_ALNUM, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
        ):
            seen, grams, at = {}, {}, 0
            for run in text_runs(iter([batch.slice(0, 100), batch.slice(100)]), byte_table(gaps, lower), limit=limit):
                hashes = run.word_hashes()
                threes = ngrams(hashes, 3)
                for k in range(run.rows.num_rows):
                    words = re.findall(pattern, lowered(texts[at]) if lower else texts[at] or "")
                    at += 1
                    assert run.first[k + 1] - run.first[k] == len(words)
                    for i, w in enumerate(words):
                        assert seen.setdefault(w, hashes[run.first[k] + i]) == hashes[run.first[k] + i]
                    for i in range(len(words) - 2):
                        g = threes[run.first[k] + i]
                        assert grams.setdefault(tuple(words[i : i + 3]), g) == g
            assert len(set(seen.values())) == len(seen) and len(set(grams.values())) == len(grams)
            assert at == len(texts)


def test_cover_brings_every_pair_of_positions_together():
    cover, period = set(substring_dedup.COVER), substring_dedup.PERIOD
    for d in range(period):
        assert any((i + d) % period in cover for i in cover)
    assert substring_dedup.ANCHOR + period - 1 == substring_dedup.WINDOW


def test_substring_dedup(spark, rows):
    found = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    owner = {}
    for (i, _), w in zip(rows, words, strict=True):
        for a in range(len(w) - 49):
            if i is not None:
                owner[tuple(w[a : a + 50])] = min(owner.get(tuple(w[a : a + 50]), 1 << 60), i)
    want, lost = collections.Counter(), 0
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for a in range(len(w) - 49):
            if i is not None and owner[tuple(w[a : a + 50])] < i:
                gone[a : a + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
        lost += any(gone)
    assert lost > 20
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == want
    for r in found:
        assert r.kept_text is None or hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def brute_components(rows, least_links=50):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    places = collections.defaultdict(list)
    parent = list(range(len(rows)))

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = 0
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in places[g]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                links += 1
                parent[top(i)] = top(j)
        for g in s:
            places[g].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), 1 << 60), d)
    assert links >= least_links
    return [(d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_ngram_join(spark, rows):
    found = ngram_join.ngram_components(frame(spark, rows)).collect()
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in found)
    assert got == collections.Counter(brute_components(rows))


def test_ngram_join_without_order_or_rounds(spark, rows, monkeypatch):
    """The list of frequent n-grams and the rounds change the work, not the result."""
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "SPARE", 1 << 40)
    monkeypatch.setattr(ngram_join, "OFTEN", 1 << 40)
    part = rows[60:]
    found = ngram_join.ngram_components(frame(spark, part)).collect()
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in found)
    assert got == collections.Counter(brute_components(part))


def test_sketches_keep_similar_sets_and_drop_others(spark):
    """No similar pair differs in too many bits; near copies that fall short of the threshold are not written as pairs."""
    rng, rows, similar = np.random.default_rng(3), [], []
    for n in (1, 2, 7, 40, 400, 3000):
        for shared in (100, 90, 86, 85, 65, 40, 0):
            both = n * shared // 100
            grams = rng.integers(0, 1 << 64, 2 * n - both, np.uint64)
            x, y = np.unique(grams[:n]), np.unique(grams[n - both :])
            bits = [dict(zip(ngram_join.SKETCH, ngram_join.sketch(s).tolist(), strict=True)) for s in (x, y)]
            assert sum((a ^ b).bit_count() for a, b in zip(*[[v & (1 << 64) - 1 for v in b.values()] for b in bits], strict=True)) <= len(np.setxor1d(x, y))
            similar.append(100 * both >= 75 * (2 * n - both))
            rows.append((len(rows), n, shared, *bits))
    sketch = "struct<" + ",".join(f"{k}:bigint" for k in ngram_join.SKETCH) + ">"
    pairs = spark.createDataFrame(rows, f"i int, n int, shared int, a {sketch}, b {sketch}")
    kept = pairs.select("i", "n", "shared", ngram_join.near_sketches(F.col("n"), F.col("n"), "a", "b").alias("near")).collect()
    assert all(r.near for r in kept if similar[r.i])
    assert not any(r.near for r in kept if r.n in (40, 400) and r.shared <= 65)


def brute_roots(links):
    root = {v: v for link in links for v in link}
    for _ in root:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    return root


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 199), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(61)} | {k: 100 for k in range(100, 140)} | {199: 199, 200: 199}


def test_components_of_a_large_group_take_few_stages(spark):
    links = [(d, 1000 + d % 3) for d in range(300)] + [(d, 1000 + d % 2) for d in range(0, 300, 50)] + [(5000 + d, 4000 + d) for d in range(50)]
    table = spark.createDataFrame(links, "x long, y long").repartition(6)
    spark.sparkContext.setJobGroup("components", "")
    try:
        got = {r.node: r.root for r in components(table).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds]
    assert got == brute_roots(links)
    assert len(stages) <= 30


@pytest.mark.parametrize("seed", range(3))
def test_components_across_tasks(spark, seed):
    rng = np.random.default_rng(seed)
    chain = rng.permutation(120).tolist()
    links = list(zip(chain[:-1], chain[1:], strict=True)) if seed else []
    links += [(int(a) + 200, int(b) + 200) for a, b in rng.integers(0, 60, (40, 2))]
    table = spark.createDataFrame(links, "x long, y long").repartition(8)
    found = components(table).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.root for r in found} == brute_roots(links)


def test_exact_dedup(spark, rows):
    def plain(t):
        return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")

    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[plain(t)].append(d)
    want = collections.Counter()
    for d, t in rows:
        ids = [x for x in groups[plain(t)] if x is not None]
        keep = min(ids, default=None)
        want[d, keep, len(groups[plain(t)]), d == keep, hashlib.sha256(plain(t).encode()).hexdigest()] += 1
    found = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == want
    kept = exact_dedup.drop_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    left = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert left == collections.Counter(
        (d, t) for d, t in rows if d == min((x for x in groups[plain(t)] if x is not None), default=None)
    )


def test_texts_are_hashed_once(spark, rows):
    """The bit table and the rows tested by it read written digests, not the texts again."""
    plan = exact_dedup.exact_duplicates(frame(spark, rows))._jdf.queryExecution().analyzed().toString()
    assert "sha2(" not in plan and "text_sha256" in plan


def test_rows_that_stay_are_not_moved(spark, rows):
    """Only rows that a bit table can't clear meet the dropped ones; the texts of the others are not shuffled."""
    plan = ngram_join.drop_near_duplicates(frame(spark, rows))._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union"
    stay, meet = (plan.children().apply(k).toString() for k in (0, 1))
    assert "LeftAnti" not in stay and "LeftAnti" in meet


def test_bit_table_may_be_full(spark, rows, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_duplicates(frame(spark, rows)).collect()))
    monkeypatch.setattr(exact_dedup, "MIN_BITS", 32768)
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 0)
    monkeypatch.setattr(exact_dedup, "PROBES", 1)
    assert sorted(map(str, exact_dedup.exact_duplicates(frame(spark, rows)).collect())) == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)

    def plain(rows):  # the last digit of a distance depends on the order of the sum
        return sorted(tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in rows)

    assert plain(df.select(*names).collect()) == plain(cur.fetchall())


ITEMS = [
    (1, " ".join(f"w{i}" for i in range(30))), (2, "Ab-cd e"), (3, None), (4, "..."), (None, "secret thing"),
    (5, " ".join(f"w{i}" for i in range(5, 18))), (5, "tail of item"), (6, "one"),
]


def brute_contamination(text):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words, hit, items = re.findall(word, lowered(text)), set(), set()
    for i, t in ITEMS:
        w = re.findall(word, lowered(t))
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            for b in range(len(words) - n + 1):
                if words[b : b + n] == w[a : a + n]:
                    hit.update(range(b, b + n))
                    items.add(i)
    names = ",".join(sorted(str(i) for i in items if i is not None))
    return (len(words), len(hit), len(items - {None}), hashlib.sha256(names.encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(words))


@pytest.mark.parametrize("pass_bytes", [1 << 20, 60])
def test_decontamination(spark, pass_bytes, monkeypatch):
    monkeypatch.setattr(decontamination.find_items, "__defaults__", (13, pass_bytes))
    rng = random.Random(2)
    texts = [None, "", " - ", "AB cd E x", "Secret\nthing", "one", "x " * 100 + "one", LONG, LONG + " one"]
    texts += [" ".join(rng.choice(["w%d" % (k % 30), "q"]) if rng.random() < 0.1 else f"w{k % 30}" for k in range(n)) for n in range(1, 90)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "one"), (3, texts[3])]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(spark, rows)
    found = decontamination.contamination(docs, items).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found)
    assert got == collections.Counter((d, *brute_contamination(t)) for d, t in rows)
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter(
        (d, t) for d, t in rows if not brute_contamination(t)[-1]
    )


def test_search_skips(monkeypatch):
    """Most positions of a text without windows are never looked at."""
    finder = decontamination.searchers([(1, ITEMS[0][1])])[0]
    looked = []
    finder.skip = type("D", (dict,), {"get": lambda s, k, d: looked.append(k) or dict.get(s, k, d)})(finder.skip)
    assert not list(finder.search([b"q"] * 1200))
    assert len(looked) <= 101


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()
    assert found.where("score < 0 or score > 1").count() == 0
    assert found.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).count() == held.count()


def test_language_edge_cases(spark):
    texts = ["the cat and the dog", "le chat et le chien", "der Hund und die Katze"]
    rows = [(k, texts[k % 3] * (1 + k % 4), ("en", "fr", "de")[k % 3]) for k in range(90)]
    rows += [(200, None, "en"), (201, "", None), (202, "12 --", "en"), (None, "the cat", "xx"), (203, LONG, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = df.select("*", F.lit("own").alias("row"), F.lit("own").alias("score"))
    found = language_id.predict_languages(docs).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[k].lang_pred == ("en", "fr", "de")[k % 3] for k in range(90))
    assert [(by_id[k].lang_pred, by_id[k].score) for k in (200, 201, 202)] == [("und", 0.0)] * 3
    assert by_id[None].lang_pred == "en" and by_id[203].lang_pred in ("en", "fr", "de")
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(90))
    assert not {200, 201, 202} & {r.doc_id for r in kept.collect()}
    nothing = docs.where("lang is null")
    assert {r.lang_pred for r in language_id.predict_languages(nothing).collect()} == {"und"}


def test_unsure_rows_are_kept(spark):
    texts = [f"{w} {w}{w}" for w in ("abc", "def", "ghi", "jkl")]
    rows = [(k, texts[k % 4], f"l{k % 4}") for k in range(80)] + [(100, "zz", None), (101, "abc def ghi jkl", None), (102, "1 --", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    scores = {r.doc_id: r.score for r in language_id.predict_languages(docs).collect()}
    assert min(scores[100], scores[101]) < 0.5
    assert sorted(r.doc_id for r in language_id.keep_identified(docs).collect()) == [*range(80), 100, 101]
    unlabelled = docs.where("lang is null")
    assert sorted(r.doc_id for r in language_id.keep_identified(unlabelled).collect()) == [100, 101]


def test_temperature_is_found():
    import numpy as np

    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3)) * 2
    labels = np.array([rng.choice(3, p=language_id.softmax(x)) for x in logits])
    assert abs(language_id.fit_temperature(logits * 5, labels) - 5) < 0.5


def test_licenses(spark):
    mit = """/* Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal in the Software without
 * restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
 * sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
 * to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in all copies or substantial
 * portions of the Software.
 */"""
    cases = {
        mit: "MIT",
        "Some words. Licensed under the Apache License, Version 2.0. More": "Apache 2.0",
        "Aa.\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.":
            "GPL 3,CC BY NC 4.0",
        "Released under the MIT License.\nReleased under the MIT License.": "MIT",
        "we took his license away": "", "": "", None: "", LONG: "", LONG + "\nReleased under the MIT License.": "MIT",
    }
    rows = [(k, t) for k, t in enumerate(cases)]
    found = license_scan.scan_licenses(frame(spark, [*rows, rows[0]])).collect()
    assert len(found) == len(rows) + 1
    assert {r.doc_id: r.licenses for r in found} == {k: cases[t] for k, t in rows}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
ENDORSE = """
3. Neither the name of the Copyright Holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
GPL = """This program is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{then} either version {v} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
HEADERS = {
    MIT: "MIT", APACHE: "Apache 2.0", BSD: "BSD-2-Clause", BSD + ENDORSE: "BSD-3-Clause", ISC: "ISC", MPL: "MPL 2.0",
    GPL.format(stop=":", kind="", then=",", v="3"): "GPL 3 or later", GPL.format(stop=";", kind="", then=";", v="2"): "GPL 2 or later",
    GPL.format(stop=";", kind="Lesser ", then=";", v="2.1"): "LGPL 2.1 or later",
    GPL.format(stop=":", kind="Affero ", then=",", v="3"): "AGPL 3 or later",
    "This work is licensed under the GNU General Public License, version 3.": "GPL 3",
    "Released under the GNU Lesser General Public License, version 3 or later.": "LGPL 3 or later",
    "Distributed under the terms of the GNU Affero General Public License.": "AGPL",
    "Released under the BSD License.": "BSD", "This project is released under the MIT License.": "MIT",
    "To the extent possible under law, Some Author has waived all copyright and related or neighboring rights to This Work.": "CC0",
    "This work is dedicated to the Public Domain.": "CC0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC ATTRIBUTION SHAREALIKE 4.0",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
}


@pytest.mark.parametrize("width", [30, 52, 64, 72, 79, 1000])
@pytest.mark.parametrize("sign", ["", " * ", "# ", "   "])
def test_standard_headers(width, sign):
    for header, want in HEADERS.items():
        parts = ["\n".join(textwrap.wrap(p.strip(), width, break_long_words=False)) for p in header.split("\n\n")]
        text = "\n".join((sign + x).rstrip() for x in ("Copyright (c) 2020 Some Author\n\n" + "\n\n".join(parts) + "\n\nMore Words").split("\n"))
        assert ",".join(dict.fromkeys(license_scan.match_rules(license_scan.sentence_ids(text)))) == want, text


def test_lines_joined_and_cut():
    def found(text):
        return ",".join(license_scan.match_rules(license_scan.sentence_ids(text)))

    assert found("Some Title\nReleased under the MIT\nLicense\nLicensed under CC BY 4.0\nOther words") == "MIT,CC BY 4.0"
    assert found(" * Copyright Some One\n * Released under the MIT License\n * Words of it") == "MIT"
    assert found("Released into the public\n// domain.") == "CC0"
    assert found("This License\n" * 20_000 + "Released under the BSD\nLicense") == "BSD"


def test_spdx_lines():
    cases = {
        "// SPDX-License-Identifier: MIT\nint main;": "MIT", "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */": "GPL 2.0",
        "# SPDX-License-Identifier: (MIT OR Apache-2.0)\n# Words": "MIT,Apache 2.0", "SPDX-License-Identifier: LGPL-2.1+.": "LGPL 2.1 or later",
        "x\nSPDX-License-Identifier: AGPL-3.0-or-later and words. Released under the BSD License.": "AGPL 3.0 or later,BSD",
        "SPDX-License-Identifier: CC-BY-SA-4.0 More": "CC BY SA 4.0", "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
        "SPDX-License-Identifier: NONE": "", "SPDX-License-Identifier:": "", "SPDX-License-Identifier: Zlib": "Zlib",
    }
    for text, want in cases.items():
        assert ",".join(license_scan.match_rules(license_scan.sentence_ids(text))) == want, text


def test_rules_are_ordered():
    row = [("bsd-grant", ""), ("bsd-source", ""), ("bsd-binary", ""), ("bsd-endorse", ""), ("mit", "")]
    assert license_scan.match_rules(row) == ["BSD-3-Clause", "MIT"]
    assert license_scan.match_rules([*row[:3], row[4]]) == ["BSD-2-Clause", "MIT"]
    assert license_scan.match_rules([row[1], row[0], row[2]]) == []


@pytest.mark.parametrize(
    "operator",
    [substring_dedup.remove_repeats, ngram_join.ngram_components, exact_dedup.exact_duplicates,
     license_scan.scan_licenses],
)
def test_empty_table(spark, operator):
    assert operator(frame(spark, [])).collect() == []
