"""Operator 2: license detection by ordered signature rules, in DataFrame functions only.

A text is reduced to its words: A-Z lower-cased, everything ASCII that is no letter or digit a gap. Each rule is a regular
expression over words, gated by a keyword that is derived from it as a run that every match holds, so a rule's expression runs only
on texts with its keyword. A detection is an interval of words with a priority. A detection that lies inside
another of another rule is suppressed if the other has a better priority, or the same priority and more words,
or the same words and an earlier place in the list. What remains gives the labels.

Three base phrases are searched besides, without suppression: every place where their words stand consecutively.

All work is done inside the row (higher-order functions over arrays), so there is no shuffle, and a hot key has no effect.

Defined cases: a null or empty text has no words, no labels and score 0. Repeated rows give repeated results.
An empty table gives no rows. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: label -> phrase; fixed by the contract.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))


def literals(pattern: str) -> list[str]:
    """The runs of plain characters that every match of a pattern holds: what is outside groups and classes and not optional."""
    runs, run, at = [], "", 0
    while at < len(pattern):
        c = pattern[at]
        end = at + 1
        if c in "([":
            depth, end = 1, at + 1
            while depth:
                depth += (pattern[end] == c) - (pattern[end] == {"(": ")", "[": "]"}[c])
                end += 1
        counted = re.compile(r"[?*+]|\{[0-9,]+\}").match(pattern, end)
        if c in "([" or counted:
            runs.append(run)
            run, at = "", counted.end() if counted else end
        else:
            run += c
            at = end
    return [r for r in [*runs, run] if r.strip()]


#: The worst priority, and a detection: rule, label, priority, weight, first word and end.
WORST = 5
HIT = "struct<i:int,label:string,p:int,w:double,s:bigint,e:bigint>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is over words separated by one blank; ``priority`` 0 is the best; ``weight`` is the evidence it gives."""

    label: str
    pattern: str
    priority: int
    weight: float

    @property
    def keyword(self) -> str:
        """The longest run of characters that every match holds, the first of the longest; the rule runs on texts with it alone."""
        return max(literals(self.pattern), key=len)


def _families() -> list[tuple[str, str, list[str]]]:
    """label stem, name as a pattern over words, versions."""
    return [
        ("apache", r"apache(?: software)?", ["1 0", "1 1", "2 0"]),
        ("gpl", r"(?:gnu )?general public", ["1", "2", "3", "2 0", "3 0"]),
        ("lgpl", r"(?:gnu )?(?:lesser|library) general public", ["2", "2 1", "3", "3 0"]),
        ("agpl", r"(?:gnu )?affero general public", ["1", "3", "3 0"]),
        ("gfdl", r"(?:gnu )?free documentation", ["1 1", "1 2", "1 3"]),
        ("mpl", r"mozilla public", ["1 0", "1 1", "2 0"]),
        ("epl", r"eclipse public", ["1 0", "2 0"]),
        ("cddl", r"common development and distribution", ["1 0", "1 1"]),
        ("cpl", r"common public", ["1 0"]),
        ("eupl", r"european union public", ["1 0", "1 1", "1 2"]),
        ("osl", r"open software", ["1 0", "2 0", "2 1", "3 0"]),
        ("afl", r"academic free", ["1 1", "1 2", "2 0", "2 1", "3 0"]),
        ("artistic", r"artistic", ["1 0", "2 0"]),
        ("bsl", r"boost software", ["1 0"]),
        ("ofl", r"(?:sil )?open font", ["1 0", "1 1"]),
        ("odbl", r"open database", ["1 0"]),
        ("odc-by", r"open data commons attribution", ["1 0"]),
        ("ms-pl", r"microsoft public", []),
        ("ms-rl", r"microsoft reciprocal", []),
        ("mit", r"mit", []),
        ("isc", r"isc", []),
        ("zlib", r"zlib(?: libpng)?", []),
        ("bsd-2", r"(?:bsd 2 clause|simplified bsd|freebsd)", []),
        ("bsd-3", r"(?:bsd 3 clause|new bsd|modified bsd|revised bsd)", []),
        ("bsd-4", r"(?:bsd 4 clause|original bsd)", []),
        ("wtfpl", r"do what the [a-z]+ you want to public", ["1", "2"]),
        ("psf", r"python software foundation", ["2", "2 0"]),
        ("php", r"php", ["3 0", "3 01"]),
        ("ecl", r"educational community", ["1 0", "2 0"]),
        ("ncsa", r"(?:university of illinois )?ncsa open source", []),
        ("upl", r"universal permissive", ["1 0"]),
        ("cecill", r"cecill(?: free software)?", ["1 0", "1 1", "2 0", "2 1"]),
        ("ipl", r"ibm public", ["1 0"]),
        ("spl", r"sun public", ["1 0"]),
        ("qpl", r"q public", ["1 0"]),
        ("npl", r"netscape public", ["1 0", "1 1"]),
    ]


def rules() -> list[Rule]:
    """The signature rules, in order. Families with versions and forms are written out from their parts."""
    out: list[Rule] = []
    licence = r"licen[cs]e"
    for stem, name, versions in _families():
        for v in versions:
            label = f"{stem}-{v.replace(' ', '.')}"
            out.append(Rule(label, rf"{name} {licence} (?:version |v)?{v}(?: or later| or any later version| only)?", 1, 1.0))
            out.append(Rule(label, rf"{name} {licence} as published by [^ ]+(?: [^ ]+){{0,6}} version {v}", 1, 1.0))
            out.append(Rule(label, rf"version {v} of the {name} {licence}", 1, 1.0))
        out.append(Rule(stem, rf"(?:licensed|released|distributed|available) under (?:the terms of )?(?:the )?{name} {licence}", 2, 0.9))
        out.append(Rule(stem, rf"{name} {licence}", 3, 0.8))
    # short identifiers, as in a header line
    for short, versions in (("gpl", ["1 0", "2 0", "3 0"]), ("lgpl", ["2 0", "2 1", "3 0"]), ("agpl", ["1 0", "3 0"]), ("apache", ["1 0", "1 1", "2 0"]), ("mpl", ["1 0", "1 1", "2 0"]), ("epl", ["1 0", "2 0"]), ("bsd", ["2 clause", "3 clause"])):
        for v in versions:
            out.append(Rule(f"{short}-{v.replace(' clause', '').replace(' ', '.')}", rf"spdx license identifier {short} {v}(?: only| or later)?", 0, 1.0))
    for short in ("mit", "isc", "zlib", "unlicense", "cc0 1 0", "wtfpl", "ncsa"):
        out.append(Rule(short.replace("cc0 1 0", "cc0-1.0"), rf"spdx license identifier {short}", 0, 1.0))
    # Creative Commons: elements by versions, in short and in words
    words = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    for parts in ("by nc sa", "by nc nd", "by nc", "by sa", "by nd", "by"):
        stem = "cc-" + parts.replace(" ", "-")
        long = " ".join(words[p] for p in parts.split())
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            out.append(Rule(f"{stem}-{v.replace(' ', '.')}", rf"cc {parts} {v}", 1, 1.0))
            out.append(Rule(f"{stem}-{v.replace(' ', '.')}", rf"creative commons {long} {v}", 1, 1.0))
            out.append(Rule(f"{stem}-{v.replace(' ', '.')}", rf"creative commons {long} (?:international |unported |generic )?{licence} {v}", 1, 1.0))
        out.append(Rule(stem, rf"cc {parts}", 3, 0.8))
        out.append(Rule(stem, rf"creative commons {long}(?: {licence})?", 3, 0.8))
    return out + [Rule(*r) for r in SIGNATURES]


#: Sentences and headers that are telling by themselves: label, pattern over words, priority, weight.
SIGNATURES = (
    ("cc0-1.0", r"cc0(?: 1 0)?(?: universal)?", 2, 0.9),
    ("cc0-1.0", r"has waived all copyright and related or neighboring rights", 1, 1.0),
    ("cc0-1.0", r"the person who associated a work with this deed", 1, 1.0),
    ("public-domain", r"(?:dedicated to|released into|placed in|in) the public domain", 2, 0.9),
    ("public-domain", r"the author(?: hereby)? disclaims copyright to this source code", 1, 1.0),
    ("public-domain", r"no copyright is claimed", 2, 0.9),
    ("public-domain", r"not subject to copyright protection", 2, 0.8),
    ("unlicense", r"free and unencumbered software released into the public domain", 1, 1.0),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", 1, 1.0),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", 1, 1.0),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", 1, 1.0),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use", 1, 1.0),
    ("mit", r"(?:mit x11|x11|expat) licen[cs]e", 2, 0.9),
    ("mit-0", r"mit no attribution", 1, 1.0),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose", 1, 1.0),
    ("isc", r"the software is provided as is and the author disclaims all warranties", 2, 0.9),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", 0, 1.0),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", 2, 0.9),
    ("bsd", r"redistributions of source code must retain the above copyright notice", 3, 0.8),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", 3, 0.8),
    ("bsd-3", r"neither the name of [^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used to endorse", 1, 1.0),
    ("bsd-4", r"all advertising materials mentioning features or use of this software must display", 1, 1.0),
    ("bsd-3-clear", r"no express or implied licenses to any party s patent rights are granted", 1, 1.0),
    ("bsd-0", r"(?:zero clause|0 clause) bsd", 1, 1.0),
    ("apache-2.0", r"licensed under the apache licen[cs]e version 2 0", 0, 1.0),
    ("apache-2.0", r"you may not use this file except in compliance with the licen[cs]e", 2, 0.9),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing", 2, 0.9),
    ("apache-2.0", r"without warranties or conditions of any kind either express or implied", 3, 0.8),
    ("apache-2.0", r"www apache org licenses licen[cs]e 2 0", 1, 1.0),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", 1, 1.0),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 1, 1.0),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", 0, 1.0),
    ("agpl", r"under the terms of the gnu affero general public licen[cs]e", 0, 1.0),
    ("gpl", r"you should have received a copy of the gnu general public licen[cs]e along with this program", 2, 0.9),
    ("lgpl", r"you should have received a copy of the gnu lesser general public licen[cs]e", 1, 1.0),
    ("gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose", 4, 0.5),
    ("gpl", r"write to the free software foundation", 4, 0.4),
    ("gpl", r"www gnu org licenses", 4, 0.5),
    ("gpl-classpath", r"as a special exception the copyright holders of this library give you permission to link", 1, 1.0),
    ("gpl-font", r"as a special exception if you create a document which uses this font", 1, 1.0),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", 1, 1.0),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts", 1, 1.0),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", 0, 1.0),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[cs]e", 1, 1.0),
    ("mpl", r"mozilla org mpl", 3, 0.8),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", 1, 1.0),
    ("epl", r"www eclipse org legal epl", 2, 0.9),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", 1, 1.0),
    ("cpl", r"accompanying program is provided under the terms of this common public licen[cs]e", 1, 1.0),
    ("eupl", r"licensed under the eupl", 1, 1.0),
    ("ofl", r"this font software is licensed under the sil open font licen[cs]e", 1, 1.0),
    ("ofl", r"scripts sil org ofl", 2, 0.9),
    ("ofl", r"with reserved font name", 3, 0.7),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 1, 1.0),
    ("zlib", r"altered source versions must be plainly marked as such", 1, 1.0),
    ("zlib", r"the origin of this software must not be misrepresented", 1, 1.0),
    ("bsl", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 0, 1.0),
    ("bsl", r"www boost org licen[cs]e 1 0", 1, 1.0),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document", 1, 1.0),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed", 1, 1.0),
    ("beerware", r"(?:the )?beer ware licen[cs]e", 1, 1.0),
    ("beerware", r"you can buy me a beer in return", 1, 1.0),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", 1, 1.0),
    ("perl", r"under the same terms as perl itself", 1, 1.0),
    ("ruby", r"under the same terms as ruby", 1, 1.0),
    ("psf", r"psf is making python available to licensee on an as is basis", 1, 1.0),
    ("ncsa", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software", 0, 1.0),
    ("openssl", r"this product includes software developed by the openssl project", 1, 1.0),
    ("ssleay", r"this product includes cryptographic software written by eric young", 1, 1.0),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided", 0, 1.0),
    ("jpeg", r"this software is based in part on the work of the independent jpeg group", 1, 1.0),
    ("libpng", r"this copy of the libpng notices is provided for your convenience", 1, 1.0),
    ("freetype", r"portions of this software are copyright [^ ]+(?: [^ ]+){0,4} the freetype project", 1, 1.0),
    ("unicode", r"unicode inc licen[cs]e agreement data files and software", 1, 1.0),
    ("w3c", r"w3c software (?:and document )?(?:notice and )?licen[cs]e", 1, 1.0),
    ("vim", r"vim licen[cs]e", 2, 0.9),
    ("postgresql", r"postgresql licen[cs]e", 2, 0.9),
    ("sleepycat", r"sleepycat licen[cs]e", 2, 0.9),
    ("json", r"the software shall be used for good not evil", 1, 1.0),
    ("busl-1.1", r"business source licen[cs]e(?: 1 1)?", 1, 1.0),
    ("sspl-1.0", r"server side public licen[cs]e", 1, 1.0),
    ("elastic-2.0", r"elastic licen[cs]e(?: 2 0)?", 1, 1.0),
    ("commons-clause", r"commons clause licen[cs]e condition", 1, 1.0),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter) licen[cs]e", 1, 1.0),
    ("openrail", r"(?:creativeml )?open rail m(?: licen[cs]e)?", 1, 1.0),
    ("odbl", r"this database is made available under the open database licen[cs]e", 0, 1.0),
    ("odbl", r"any rights in individual contents of the database are licensed under the database contents licen[cs]e", 0, 1.0),
    ("pddl", r"public domain dedication and licen[cs]e", 1, 1.0),
    ("cdla-permissive", r"community data licen[cs]e agreement permissive", 1, 1.0),
    ("cdla-sharing", r"community data licen[cs]e agreement sharing", 1, 1.0),
    ("ogl", r"open government licen[cs]e(?: v(?:ersion)? ?[123](?: 0)?)?", 1, 1.0),
    ("ogl", r"contains public sector information licensed under", 1, 1.0),
    ("cc", r"this work is licensed under a creative commons", 3, 0.8),
    ("cc", r"creativecommons org licenses [a-z]+(?: [a-z]+)* [1-4] [05]", 2, 0.9),
    ("cc0-1.0", r"creativecommons org publicdomain zero 1 0", 1, 1.0),
    ("cc", r"some rights reserved", 4, 0.5),
    ("free-art", r"free art licen[cs]e(?: 1 3)?", 1, 1.0),
    ("gpl", r"gnu gpl", 3, 0.8),
    ("lgpl", r"gnu lgpl", 3, 0.8),
    ("agpl", r"gnu agpl", 3, 0.8),
    ("gpl-2.0", r"gplv2", 2, 0.9),
    ("gpl-3.0", r"gplv3", 2, 0.9),
    ("lgpl-2.1", r"lgplv2 1", 2, 0.9),
    ("lgpl-3.0", r"lgplv3", 2, 0.9),
    ("agpl-3.0", r"agplv3", 2, 0.9),
    ("as-is", r"(?:is )?provided (?:by [^ ]+(?: [^ ]+){0,6} )?as is", 4, 0.4),
    ("as-is", r"in no event shall the (?:authors|copyright holders|copyright owner|author|regents)", 4, 0.4),
    ("as-is", r"use at your own risk", 5, 0.2),
    ("reserved", r"(?:all|some|no) rights reserved", 4, 0.5),
    ("reserved", r"may not be reproduced (?:or distributed |stored |transmitted )?(?:in any form )?without (?:the )?(?:prior )?(?:written )?permission", 3, 0.7),
    ("reserved", r"no part of this (?:publication|book|work|document) may be reproduced", 3, 0.7),
    ("reserved", r"unauthorized (?:copying|reproduction|distribution) of this (?:file|work|document)", 3, 0.7),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9]", 4, 0.4),
    ("copyright", r"(?:the )?copyright holders? and contributors", 5, 0.2),
    ("proprietary", r"proprietary and confidential", 3, 0.7),
    ("proprietary", r"confidential and proprietary", 3, 0.7),
    ("proprietary", r"this (?:software|document) (?:is|contains) (?:the )?(?:confidential|proprietary) information of", 2, 0.8),
    ("proprietary", r"trade secrets? of", 5, 0.2),
    ("noncommercial", r"for non ?commercial (?:use|purposes) only", 3, 0.7),
    ("noncommercial", r"for (?:personal|academic|educational|research)(?: and [a-z]+)? use only", 3, 0.7),
    ("noncommercial", r"may not be used for commercial purposes", 3, 0.7),
    ("evaluation", r"for evaluation purposes only", 3, 0.7),
    ("eula", r"end user licen[cs]e agreement", 3, 0.7),
    ("eula", r"by (?:installing|downloading|using) (?:this|the) software you agree", 3, 0.7),
    ("attribution", r"attribution is required", 4, 0.4),
    ("attribution", r"please (?:cite|credit) the (?:author|authors|source)", 5, 0.2),
    ("licensed", r"(?:licensed|released) under", 5, 0.2),
    ("licensed", r"see (?:the )?licen[cs]e(?: [a-z]+)? for (?:more |further )?(?:details|information)", 5, 0.2),
)


def word_line(text: Column) -> Column:
    """The words with two blanks between and one at each end, so that no two words share a blank; no words: one blank."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    line = F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), GAPS, "  ")
    return F.substring(line, F.lit(2), F.length(line) - 2)


def bound(pattern: str) -> str:
    """A pattern over single-blank words as one over the word line."""
    return " " + pattern.replace(" ?", "(?:  )?").replace(" ", "\0").replace("(?:\0\0)?", "(?:  )?").replace("\0", "  ") + " "


def once(value: Column, use: Callable) -> Column:
    """``use(value)``, where the value is computed once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(items: Column, kind: str, state: Column, step: Callable, give: Callable) -> Column:
    """``give(state, item)`` for each item in order, with the state that the items before it have made by ``step``; as an array of ``kind``.

    Two levels of arrays, each of about the square root of the items, so that appending does not copy the whole result each time.
    """
    none, nested = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    made = lambda st, out: F.struct(st.alias("state"), out.alias("out"))
    one = lambda a, x: made(step(a["state"], x), F.concat(a["out"], F.array(give(a["state"], x))))

    def whole(given: Column) -> Column:
        all_, width = given["items"], given["width"]
        block = lambda a, at: F.aggregate(F.slice(all_, at, width), made(a["state"], none), one, lambda b: made(b["state"], F.concat(a["out"], F.array(b["out"]))))
        return F.aggregate(F.sequence(F.lit(1), F.size(all_), width), made(state, nested), block, lambda a: F.flatten(a["out"]))

    sized = lambda x: F.struct(x.alias("items"), F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int").alias("width"))
    return once(items, lambda x: F.when(F.size(x) == 0, none).otherwise(once(sized(x), whole)))


def spans(line: Column, pattern: Column) -> Column:
    """Word intervals [start, end) of all matches, left to right, from the matched parts and the parts between."""
    words = lambda s: ((F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))) / F.lit(2)).cast("long")
    pair = lambda gap, hit: F.struct(words(gap).alias("gap"), words(hit).alias("hit"))
    zipped = lambda found: F.zip_with(F.slice(F.split(line, pattern, -1), F.lit(1), F.size(found)), found, pair)
    step = lambda at, x: at + x["gap"] + x["hit"]
    give = lambda at, x: F.struct((at + x["gap"]).alias("s"), (at + x["gap"] + x["hit"]).alias("e"))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    placed = lambda found: scan(zipped(found), "struct<s:bigint,e:bigint>", F.lit(0).cast("long"), step, give)
    return once(F.regexp_extract_all(line, pattern, F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)))


def _gates(listed: list[Rule]) -> list[str]:
    """Few runs of characters of which every match of any rule holds one: words of the rules' plain parts, those that serve most rules first."""
    holds: dict[str, set[int]] = {}
    for i, r in enumerate(listed):
        plain = literals(r.pattern)
        words = {w for x in plain for w in x.split() if len(w) >= 5} | ({"licen"} if any("licen" in x for x in plain) else set())
        pairs = {"  ".join(x.split()[k : k + 2]) for x in plain for k in range(len(x.split()) - 1)}
        for w in words or pairs or {r.keyword.replace(" ", "  ")}:
            holds.setdefault(w, set()).add(i)
    out, left = [], set(range(len(listed)))
    while left:
        best = min(holds, key=lambda w: (-len(holds[w] & left), w))
        out.append(best)
        left -= holds[best]
    return out


def surviving(hits: Column) -> Column:
    """The detections that none contains with a better claim, by one sweep.

    Sorted by start, longer ones first, then by priority and place in the list, whatever contains a detection with a better
    claim comes before it; so the farthest end so far of each priority decides.
    """
    key = lambda h: F.struct(h["s"], -h["e"], h["p"], h["i"])
    ordered = F.array_sort(hits, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))
    reach = F.array_repeat(F.lit(-1).cast("long"), WORST + 1)
    step = lambda far, h: F.transform(far, lambda end, p: F.when(p >= h["p"], F.greatest(end, h["e"])).otherwise(end))
    give = lambda far, h: F.when(F.element_at(far, h["p"] + 1) >= h["e"], F.lit(None)).otherwise(h)
    return F.filter(scan(ordered, HIT, reach, step, give), lambda h: h.isNotNull())


def detect(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, base (label, s, e), detections (label, s, e, weight) kept after suppression."""
    listed = rules()
    table = [{"i": i, "label": r.label, "keyword": r.keyword.replace(" ", "  "), "pattern": bound(r.pattern), "p": r.priority, "w": r.weight} for i, r in enumerate(listed)]
    table = F.from_json(F.lit(json.dumps(table)), "array<struct<i:int,label:string,keyword:string,pattern:string,p:int,w:double>>")  # folded into one constant
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), word_line(F.col("text")).alias("line"))
    gates = F.from_json(F.lit(json.dumps(_gates(listed))), "array<string>")
    some = F.exists(gates, lambda gate: F.contains(F.col("line"), gate))

    def places(label: str, phrase: str) -> Column:
        pattern, none = F.lit(bound(phrase)), F.array().cast("array<struct<label:string,s:long,e:long>>")
        named = F.transform(spans(F.col("line"), pattern), lambda x: F.struct(F.lit(label).alias("label"), x["s"].alias("s"), x["e"].alias("e")))
        return F.when(F.contains("line", pattern), named).otherwise(none)

    base = F.concat(*[places(label, phrase) for label, phrase in BASE])
    gated = F.filter(table, lambda r: F.contains(F.col("line"), r["keyword"]))
    hits = F.flatten(F.transform(gated, lambda r: F.transform(spans(F.col("line"), r["pattern"]), lambda x: F.struct(r["i"].alias("i"), r["label"].alias("label"), r["p"].alias("p"), r["w"].alias("w"), x["s"].alias("s"), x["e"].alias("e")))))
    found = rows.select(
        "doc_id",
        ((F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))) / 2).cast("long").alias("n_words"),
        base.alias("base"),
        F.when(some, hits).otherwise(F.array().cast(f"array<{HIT}>")).alias("hits"),
    )

    kept = F.when(F.size("hits") < 2, F.col("hits")).otherwise(surviving(F.col("hits")))
    return found.select("doc_id", "n_words", "base", kept.alias("detections"))


def summarise(found: DataFrame) -> DataFrame:
    """The digest columns of each document."""
    label_list = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    base_labels = F.transform("base", lambda b: b["label"])
    score = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["w"])), F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["s"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["s"])).alias("last_word"),
        label_list(base_labels).alias("base_labels"),
        label_list(F.concat(base_labels, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        score.alias("score"),
    )
