"""License scans by sentence rules.

A text is cut into sentences, each is normalised and looked up among known licence sentences; what is
found is a row of sentence identifiers.  A line that starts with a capital may start a sentence or go on
with one: the lines are looked up joined as well as one by one.  Ordered rules, the longer ones first, are matched against that
row: a rule's identifiers must follow each other, other known sentences may not stand between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.tables import arrow_map

#: What follows a version that later ones may replace.
LATER = r"(?:( or)(?: at your option)?(?: any)?( later)(?: version)?)?"
#: The notice of the Free Software Foundation; its version may stand in a sentence of its own.
FSF = (
    r"(?:this (?:work|program|file|library|software|project) is free software )?you (?:can|may) redistribute (?:it|this \w+) and or modify (?:it )?"
    r"under the terms of(?: version ([0-9.]+) of)? the {}(?: version ([0-9.]+))?(?: (?:only )?as published by the free software foundation)?"
    r"(?: (?:either )?version ([0-9.]+)(?: of the license)?)?" + LATER
)
#: Known sentences: identifier, pattern over the normalised sentence; groups are kept as the version.
SENTENCES = [
    ("cc", r"(?:this work is )?licensed under (?:a |the )?(?:cc|creative commons)((?: (?:by|nc|sa|nd|zero|attribution|noncommercial|sharealike|noderivatives|noderivs))*(?: [0-9.]+)?)(?: (?:international|unported))?(?: license)?"),
    ("cc0", r"(?:this work is )?(?:released|dedicated) (?:in)?to the public domain(?: under cc0)?"),
    ("cc0-waive", r"to the extent possible under law (?:.* )?(?:has|have) waived all copyright and related or neighboring rights to .*"),
    ("gpl-notice", FSF.format("gnu general public license")),
    ("lgpl-notice", FSF.format("gnu (?:lesser|library) general public license")),
    ("agpl-notice", FSF.format("gnu affero general public license")),
    ("fsf-version", rf"either version ([0-9.]+)(?: of the license)?{LATER}|version ([0-9.]+) of the license{LATER}"),
    ("gpl", r"(?:this (?:work|program|file|software|project) is )?(?:licensed|released|distributed) under the (?:terms of the )?gnu general public license(?: gpl)?(?: version ([0-9.]+))?( or later)?"),
    ("lgpl", r"(?:this (?:work|program|file|library|software|project) is )?(?:licensed|released|distributed) under the (?:terms of the )?gnu lesser general public license(?: lgpl)?(?: version ([0-9.]+))?( or later)?"),
    ("agpl", r"(?:this (?:work|program|file|software|project) is )?(?:licensed|released|distributed) under the (?:terms of the )?gnu affero general public license(?: agpl)?(?: version ([0-9.]+))?( or later)?"),
    ("apache", r"(?:this (?:work|file|software|project) is )?licensed under the apache license(?: version ([0-9.]+))?(?: the license)?"),
    ("apache-comply", r"you may not use this file except in compliance with the license"),
    ("apache-copy", r"you may obtain a copy of the license at(?: .*)?"),
    ("apache-asis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", r"(?:this (?:work|program|file|software|project) is )?(?:released|licensed|distributed) under the (?:terms of the )?mit license"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc-grant", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", r"(?:this (?:work|program|file|software|project) is )?(?:released|licensed|distributed) under the (?:terms of the )?(?:(new|modified|simplified|[234] clause) )?bsd license"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", r"(?:1 )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", r"(?:2 )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", r"(?:3 )?neither the name of .* nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("as-is", r"the software is provided as is (?:without warranty of any kind express or implied|and .* disclaims all warranties).*"),
    ("mpl", r"this source code form is subject to the terms of the mozilla public license v ([0-9.]+)"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
]

#: Ordered rules: the first that matches at a place of the identifier row takes it.
RULES = [
    ("Apache", ("apache", "apache-comply", "apache-copy", "apache-asis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit", "mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant", "as-is")),
    ("ISC", ("isc-grant",)),
    ("AGPL", ("agpl-notice", "fsf-version")),
    ("LGPL", ("lgpl-notice", "fsf-version")),
    ("GPL", ("gpl-notice", "fsf-version")),
    ("AGPL", ("agpl-notice",)),
    ("LGPL", ("lgpl-notice",)),
    ("GPL", ("gpl-notice",)),
    ("AGPL", ("agpl",)),
    ("LGPL", ("lgpl",)),
    ("GPL", ("gpl",)),
    ("Apache", ("apache",)),
    ("BSD", ("bsd",)),
    ("MIT", ("mit",)),
    ("MPL", ("mpl",)),
    ("CC0", ("cc0",)),
    ("CC0", ("cc0-waive",)),
    ("CC", ("cc",)),
    ("Unlicense", ("unlicense",)),
    ("", ("spdx",)),
]

#: A sentence without one of these words is none of the known ones; words may stand on two lines of a comment.
HINT = re.compile(
    r"licen[cs]|permission|redistribut|copyright|warrant|public[\s/*#;%-]+domain|later[\s/*#;%-]+version|endorse|\bcopy\b", re.I
)
#: A sentence ends at a line that is blank or starts a list, or at its stop; lines within are joined.
ENDS = re.compile(r"(?<=[.;:!?])(?<!\sv\.)\s+|\n[\s/*#;%-]*\n|\n(?=\s*(?:[*#/]*\s*)(?:[0-9]+[.)]|-)\s)")
#: A line within a sentence that may start another one.
LINES = re.compile(r"\n(?=[\s/*#;%-]*[A-Z])")
#: Joined lines are looked up to so many words: the longest known sentence has 73, a name in it some more.
LONGEST = 200
#: An SPDX identifier, a line that names licences by an expression of them, and identifiers with a version.
SPDX_ID = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9.:+-]*[A-Za-z0-9+])?")
SPDX = re.compile(
    rf"(?i:SPDX-License-Identifier):[ \t]*(\(*{SPDX_ID.pattern}\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*{SPDX_ID.pattern}\)*)*)"
)
SPDX_FAMILY = re.compile(r"(A?GPL|LGPL|Apache|MPL|CC0|CC)-(.+?)(-only|-or-later|\+)?", re.I)
COMMENT = re.compile(r"^[\s/*#;%-]+", re.M)
KNOWN = [(name, re.compile(pattern)) for name, pattern in SENTENCES]
#: The first three words of any known sentence.
FIRST = re.compile(
    r"(?:this (?:(?:work|program|file|software|project|library) is|is free|source code)|(?:licensed|released|distributed) (?:under|to|into) "
    r"|dedicated (?:in)?to the|to the extent|you (?:may|can) |either version|version [0-9.]+ of|unless required by|permission (?:is|to) "
    r"|the (?:above copyright|software is)|(?:[123] )?(?:redistributions? |neither the)|(?:[123] )redistributions)"
)


def normalised(sentence: str) -> str:
    """Lower case, comment signs and punctuation gone but for dots within numbers, single spaces."""
    text = COMMENT.sub(" ", sentence).lower()
    text = re.sub(r"(?<![0-9])\.|\.(?![0-9])|[^a-z0-9.]+", " ", text)
    return " ".join(text.split())


def spdx_ids(expression: str) -> list[tuple[str, str]]:
    """One entry per licence of an SPDX expression, exceptions and operators left out."""
    found, after = [], ""
    for one in SPDX_ID.findall(expression):
        word = one.upper()
        if word not in ("AND", "OR", "WITH", "NONE", "NOASSERTION") and after != "WITH":
            if m := SPDX_FAMILY.fullmatch(one):
                later = " or later" if m[3] and m[3].lower() != "-only" else ""
                one = f"{m[1]} {m[2].replace('-', ' ')}{later}"
            found.append(("spdx", one))
        after = word
    return found


def known(plain: str) -> tuple[str, str, bool] | None:
    """Identifier and version of a normalised sentence, and whether its pattern leaves the end open."""
    for name, pattern in KNOWN:
        if m := pattern.fullmatch(plain):
            return name, " ".join(g.strip() for g in m.groups() if g), pattern.pattern.endswith((".*", ".*)?"))
    return None


def line_ids(sentence: str) -> list[tuple[str, str]]:
    """Known sentences among the lines of what may be one sentence: the most lines win, the fewest if the end is open."""
    found = []
    plains = [p for p in map(normalised, LINES.split(sentence)) if p]
    at = 0
    while at < len(plains):
        best, run, words = None, "", 0
        if FIRST.match(" ".join(plains[at : at + 3]) + " "):
            for to in range(at, len(plains)):
                words += plains[to].count(" ") + 1
                if to > at and words > LONGEST:
                    break
                run = f"{run} {plains[to]}".lstrip()
                if now := known(run):
                    if best is None or not now[2]:
                        best = (*now, to + 1)
        if best:
            found.append(best[:2])
        at = best[3] if best else at + 1
    return found


def sentence_ids(text: str | None) -> list[tuple[str, str]]:
    """Known sentences of a text in order: (identifier, version)."""
    found = []
    if not text or not HINT.search(text):
        return found
    for k, part in enumerate(SPDX.split(text)):
        if k % 2:
            found += spdx_ids(part)
            continue
        for sentence in ENDS.split(part):
            if sentence and HINT.search(sentence):
                found += line_ids(sentence)
    return found


def match_rules(ids: list[tuple[str, str]]) -> list[str]:
    """Licences in the order of the row; sentences that no rule takes are stepped over."""
    out, at = [], 0
    while at < len(ids):
        for licence, rule in RULES:
            part = ids[at : at + len(rule)]
            if tuple(x for x, _ in part) == rule:
                version = next((v for _, v in part if v), "")
                out.append(f"{licence} {version.upper() if licence == 'CC' else version}".strip())
                at += len(rule)
                break
        else:
            at += 1
    return out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids and licenses (in order, each once) of every row.

    A null, empty or licence-free text has none; sentences are found anywhere in the whole text.
    Repeated rows and null doc_ids come back as they are; an empty table gives no rows.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sentence_ids(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch(
                [batch.column(0), pa.array([len(f) for f in found], pa.int64()),
                 pa.array([",".join(x for x, _ in f) for f in found], pa.string()),
                 pa.array([",".join(dict.fromkeys(match_rules(f))) for f in found], pa.string())],
                names=["doc_id", "n_sentences", "sentence_ids", "licenses"],
            )

    schema = "doc_id long, n_sentences long, sentence_ids string, licenses string"
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), emit, schema)
