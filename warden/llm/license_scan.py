"""License scan: ordered signature rules behind a keyword gate.

A text becomes its words (A-Z lower-cased, joined by blanks). A rule has a
regular expression over that form, the words it cannot match without (the
gate), a label, a priority and a weight. Only rules whose gate words all occur
are tried. Overlapping detections are resolved in order of priority, then
length, then place: one that lies inside a kept one is suppressed.

Rules, in order of priority: SPDX lines, of which every operand of an
expression counts (``A OR (B AND C)``); grants with a version; passages of the
licenses' own texts (``BODIES``); names with a version and short forms such as
GPLv3 or LGPL-2.1+; grants and names without a version; notices.

Base phrases are counted apart and are never suppressed.

Defined cases: null and empty texts have no words, no labels (empty strings)
and score 0; very long texts are read whole, rule by rule; an empty table gives
no rows; of detections of one priority the longer is kept, of equally long ones
the first; repeated rows give repeated rows; further columns, whatever their
names, are left out.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM, batch, map_batches, pick

#: Fixed phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Words that are poor gates.
COMMON = frozenset("you just what want this that with think only not for the and use may all any under version other software".split())
#: label; names as regular expressions over words; identifiers; versions (empty: unversioned).
FAMILIES = (
    ("agpl", r"(?:gnu )?affero general public licen[sc]e", "agpl", "1 3"),
    ("lgpl", r"gnu (?:lesser|library) general public licen[sc]e", "lgpl", "2 2.1 3"),
    ("gpl", r"gnu general public licen[sc]e|gnu gpl", "gpl", "1 2 3"),
    ("gfdl", r"gnu free documentation licen[sc]e", "gfdl", "1.1 1.2 1.3"),
    ("apache", r"apache (?:software )?licen[sc]e", "apache", "1.0 1.1 2.0"),
    ("mit", r"mit licen[sc]e|expat licen[sc]e", "mit", ""),
    ("bsd-2", r"(?:2|two) clause bsd licen[sc]e|simplified bsd licen[sc]e", "bsd 2 clause", ""),
    ("bsd-3", r"(?:3|three) clause bsd licen[sc]e|(?:new|modified|revised) bsd licen[sc]e", "bsd 3 clause", ""),
    ("bsd-4", r"(?:4|four) clause bsd licen[sc]e|original bsd licen[sc]e", "bsd 4 clause", ""),
    ("bsd-0", r"(?:0|zero) clause bsd licen[sc]e", "0bsd", ""),
    ("isc", r"isc licen[sc]e", "isc", ""),
    ("mpl", r"mozilla public licen[sc]e", "mpl", "1.0 1.1 2.0"),
    ("epl", r"eclipse public licen[sc]e", "epl", "1.0 2.0"),
    ("cpl", r"common public licen[sc]e", "cpl", "1.0"),
    ("ipl", r"ibm public licen[sc]e", "ipl", "1.0"),
    ("cddl", r"common development and distribution licen[sc]e", "cddl", "1.0 1.1"),
    ("eupl", r"european union public licen[sc]e", "eupl", "1.0 1.1 1.2"),
    ("osl", r"open software licen[sc]e", "osl", "1.0 2.0 2.1 3.0"),
    ("afl", r"academic free licen[sc]e", "afl", "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", r"artistic licen[sc]e", "artistic", "1.0 2.0"),
    ("boost", r"boost software licen[sc]e", "bsl", "1.0"),
    ("zlib", r"zlib licen[sc]e|zlib libpng licen[sc]e", "zlib", ""),
    ("libpng", r"libpng licen[sc]e", "libpng", "2.0"),
    ("openssl", r"openssl licen[sc]e", "openssl", ""),
    ("php", r"php licen[sc]e", "php", "3.0 3.01"),
    ("python", r"python software foundation licen[sc]e|psf licen[sc]e", "psf", "2.0"),
    ("ruby", r"ruby licen[sc]e", "ruby", ""),
    ("postgresql", r"postgresql licen[sc]e", "postgresql", ""),
    ("wtfpl", r"do what the fuck you want to public licen[sc]e", "wtfpl", ""),
    ("unlicense", r"the unlicense", "unlicense", ""),
    ("zpl", r"zope public licen[sc]e", "zpl", "1.1 2.0 2.1"),
    ("sil-ofl", r"sil open font licen[sc]e", "ofl", "1.0 1.1"),
    ("cecill", r"cecill(?: free software)? licen[sc]e", "cecill", "1.0 2.0 2.1"),
    ("ms-pl", r"microsoft public licen[sc]e", "ms pl", ""),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", "ms rl", ""),
    ("sspl", r"server side public licen[sc]e", "sspl", "1"),
    ("busl", r"business source licen[sc]e", "busl", "1.1"),
    ("elastic", r"elastic licen[sc]e", "elastic", "2.0"),
    ("upl", r"universal permissive licen[sc]e", "upl", "1.0"),
    ("ncsa", r"university of illinois ncsa open source licen[sc]e|ncsa licen[sc]e", "ncsa", ""),
    ("lppl", r"latex project public licen[sc]e", "lppl", "1.0 1.2 1.3a 1.3c"),
    ("odbl", r"open (?:data commons open )?database licen[sc]e", "odbl", "1.0"),
    ("odc-by", r"open data commons attribution licen[sc]e", "odc by", "1.0"),
    ("pddl", r"public domain dedication and licen[sc]e", "pddl", "1.0"),
    ("cc0", r"creative commons zero|cc0", "cc0", "1.0"),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd", "cc by nc nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike|cc by nc sa", "cc by nc sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", r"creative commons attribution non ?commercial|cc by nc", "cc by nc", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:ative)?s|cc by nd", "cc by nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", r"creative commons attribution share ?alike|cc by sa", "cc by sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by", r"creative commons attribution|cc by", "cc by", "1.0 2.0 2.5 3.0 4.0"),
    ("openrail", r"open ?rail(?: m)? licen[sc]e", "openrail", ""),
    ("llama", r"llama (?:2|3|3 1) community licen[sc]e", "llama", ""),
    ("ncbi-pd", r"ncbi public domain notice", "ncbi pd", ""),
    ("vim", r"vim licen[sc]e", "vim", ""),
    ("w3c", r"w3c software notice and licen[sc]e|w3c licen[sc]e", "w3c", ""),
)
#: Identifiers that stand in SPDX lines only.
IDENTIFIERS = (
    "mit 0", "bsd 3 clause clear", "bsd 3 clause lbnl", "bsd 1 clause", "blueoak 1 0 0", "ecl 2 0", "efl 2 0", "ntp", "hpnd", "curl", "x11", "fsfap", "json", "beerware", "mulanpsl 2 0", "rpl 1 5", "qpl 1 0", "sleepycat",
    "watcom 1 0", "simpl 2 0", "vsl 1 0", "xnet", "zend 2 0", "aal", "apsl 2 0", "catosl 1 1", "cnri python", "cua opl 1 0", "entessa", "fair", "frameworx 1 0", "intel", "liliq p 1 1", "miros", "motosoto", "multics", "naumen",
    "ngpl", "nokia", "oclc 2 0", "oldap 2 8", "spl 1 0", "unicode 3 0", "ucl 1 0", "osl 3 0", "polyform noncommercial 1 0 0", "polyform small business 1 0 0", "etalab 2 0", "ogl uk 3 0", "cdla permissive 2 0", "cdla sharing 1 0",
    "bigscience openrail m", "hippocratic 2 1", "parity 7 0 0", "prosperity 3 0 0", "crossword", "glide", "imagemagick", "info zip", "jasper 2 0", "libtiff", "mtll", "netcdf", "nlpl", "rsa md", "sgi b 2 0", "tcl", "xpp",
)
#: Passages of the licenses' own texts and deeds, one on a line.
BODIES = {
    "mit": r"""permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
to deal in the software without restriction including without limitation the rights to use copy modify merge publish
the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
in no event shall the authors or copyright holders be liable for any claim damages or other liability""",
    "x11": r"""the name of the x consortium shall not be used in advertising or otherwise to promote the sale""",
    "isc": r"""permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
provided that the above copyright notice and this permission notice appear in all copies""",
    "bsd-2": r"""redistributions of source code must retain the above copyright notice
redistributions in binary form must reproduce the above copyright notice
this software is provided by the (?:regents|copyright holders|authors?) and contributors as is and any express or implied warranties
redistribution and use in source and binary forms with or without modification are permitted""",
    "bsd-3": r"""neither the names? of .{1,80}? nor the names of (?:its|their) contributors
may be used to endorse or promote products derived from this software without specific prior written permission""",
    "bsd-4": r"""all advertising materials mentioning features or use of this software must display the following acknowledge?ment""",
    "apache": r"""you may not use this file except in compliance with the license
you may obtain a copy of the license at https? www apache org licenses license 2 0
unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache license version 2 0 january 2004
grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
the end user documentation included with the redistribution if any must include the following acknowledge?ment""",
    "gpl": r"""this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
this program is distributed in the hope that it will be useful but without any warranty
you should have received a copy of the gnu general public licen[sc]e along with this
everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
the licenses for most software are designed to take away your freedom to share and change it
is a free copyleft license for software and other kinds of works
you may convey verbatim copies of the program s source code as you receive it
this general public license does not permit incorporating your program into proprietary programs
you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program""",
    "lgpl": r"""you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e along with this
a program that contains no derivative of any portion of the library but is designed to work with the library
this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library)
the lesser general public license applies to some specially designated software packages""",
    "agpl": r"""must prominently offer all users interacting with it remotely through a computer network
you should have received a copy of the gnu affero general public licen[sc]e along with this""",
    "gfdl": r"""the purpose of this license is to make a manual textbook or other functional and useful document free
permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation
with no invariant sections no front cover texts and no back cover texts""",
    "mpl": r"""this source code form is subject to the terms of the mozilla public licen[sc]e
if a copy of the mpl was not distributed with this file you can obtain one at
incompatible with secondary licenses as defined by the mozilla public licen[sc]e
the contents of this file are subject to the mozilla public licen[sc]e""",
    "epl": r"""the accompanying program is provided under the terms of this eclipse public licen[sc]e
this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e""",
    "cpl": r"""any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement""",
    "cddl": r"""subject to the terms of the common development and distribution licen[sc]e
when distributing covered code include this cddl header in each file""",
    "eupl": r"""licen[sc]ed under the eupl
may be distributed under the european union public licen[sc]e""",
    "boost": r"""to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
machine executable object code generated by a source language processor""",
    "zlib": r"""altered source versions must be plainly marked as such and must not be misrepresented
the origin of this software must not be misrepresented you must not claim that you wrote the original software
this notice may not be removed or altered from any source distribution""",
    "unlicense": r"""this is free and unencumbered software released into the public domain
anyone is free to copy modify publish use compile sell or distribute this software""",
    "wtfpl": r"""you just do what the fuck you want
verbatim or modified copies of this license document and changing it is allowed as long as the name is changed""",
    "cc0": r"""has dedicated the work to the public domain by waiving all of his or her rights
has waived all copyright and related or neighbou?ring rights
creativecommons org publicdomain zero""",
    "cc-by-nc-nd": r"""creativecommons org licenses by nc nd""",
    "cc-by-nc-sa": r"""creativecommons org licenses by nc sa""",
    "cc-by-nc": r"""you may not use the material for commercial purposes
creativecommons org licenses by nc""",
    "cc-by-nd": r"""if you remix transform or build upon the material you may not distribute the modified material
creativecommons org licenses by nd""",
    "cc-by-sa": r"""you must distribute your contributions under the same license as the original
text is available under the creative commons attribution share ?alike
creativecommons org licenses by sa""",
    "cc-by": r"""you must give appropriate credit provide a link to the license and indicate if changes were made
remix transform and build upon the material for any purpose even commercially
distributed under the terms of the creative commons attribution licen[sc]e which permits unrestricted use
creativecommons org licenses by""",
    "artistic": r"""the intent of this document is to state the conditions under which a package may be copied
you may otherwise modify your copy of this package in any way provided that you insert a prominent notice""",
    "python": r"""psf is making python available to licensee on an as is basis
psf hereby grants licensee a nonexclusive royalty free world wide license""",
    "php": r"""products derived from this software may not be called php""",
    "openssl": r"""this product includes software developed by the openssl project
the names openssl toolkit and openssl project must not be used to endorse""",
    "w3c": r"""permission to copy modify and distribute this work with or without modification for any purpose and without fee""",
    "postgresql": r"""for any purpose without fee and without a written agreement is hereby granted""",
    "sil-ofl": r"""can be bundled embedded redistributed and or sold with any software provided that each copy
no modified version of the font software may use the reserved font names?""",
    "ncsa": r"""developed by .{1,60}? university of illinois at urbana champaign""",
    "beerware": r"""as long as you retain this notice you can do whatever you want with this stuff
if we meet some day and you think this stuff is worth it you can buy me a beer""",
    "json": r"""the software shall be used for good not evil""",
    "sspl": r"""functionality of the program or a modified version available to third parties as a service""",
    "busl": r"""the right to copy modify create derivative works redistribute and make non production use of the licensed work
additional use grant .{0,80}? change date""",
    "elastic": r"""you may not provide the software to third parties as a hosted or managed service""",
    "commons-clause": r"""the license does not grant to you the right to sell the software
commons clause license condition""",
    "openrail": r"""use based restrictions as referenced in paragraph
you agree not to use the model or derivatives of the model""",
    "llama": r"""llama materials and any modifications or derivative works
monthly active users of the products or services made available by or for licensee""",
    "ms-pl": r"""each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution""",
    "odbl": r"""this database is made available under the open database licen[sc]e
any rights in individual contents of the database are licensed under""",
    "ofl-data": r"""you are free to copy distribute transmit and adapt our data as long as you credit""",
    "ogl": r"""contains public sector information licen[sc]ed under the open government licen[sc]e""",
    "fsfap": r"""copying and distribution of this file with or without modification are permitted in any medium without royalty""",
    "hpnd": r"""the name of .{1,60}? not be used in advertising or publicity pertaining to distribution of the software without specific""",
    "eula": r"""this end user licen[sc]e agreement is a legal agreement between you
by (?:installing|downloading) copying or otherwise using the (?:software|product) you agree to be bound by the terms
you may not (?:modify )?reverse engineer decompile or disassemble
the (?:software|product) is licensed not sold
all title and intellectual property rights in and to the (?:software|product)
without prejudice to any other rights .{1,60}? may terminate this (?:eula|agreement)""",
    "proprietary": r"""unauthori[sz]ed copying of this file via any medium is strictly prohibited
confidential and proprietary
proprietary and confidential
may not be (?:copied|reproduced|redistributed|published|broadcast)(?: published)?(?: or)?(?: redistributed)? without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent)
no part of this (?:publication|book|work|document) may be reproduced
contains trade secrets? (?:and|or) (?:confidential|proprietary) information
no licen[sc]e express or implied by estoppel or otherwise
for internal use only
not for (?:further )?distribution
not for (?:further )?redistribution
not for resale""",
    "non-commercial": r"""for non ?commercial (?:use|purposes|research) only
academic use only
research use only
educational use only
for evaluation purposes only
may not be used for commercial purposes""",
}
#: Rules without a family: label, expression, weight.
NOTICES = (
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", 0.8),
    ("public-domain", r"this (?:work|file|code) is (?:in|part of) the public domain", 0.8),
    ("public-domain", r"no copyright is claimed", 0.6),
    ("proprietary", r"all rights reserved", 0.4),
    ("copyleft", r"copyleft licen[sc]e", 0.4),
    ("dual", r"dual licen[sc]ed", 0.4),
    ("warranty-disclaimer", r"without warrant(?:y|ies) of any kind", 0.3),
    ("warranty-disclaimer", r"the implied warrant(?:y|ies) of merchantability", 0.3),
    ("warranty-disclaimer", r"in no event shall .{1,120}? be liable", 0.3),
)
#: Short forms with a version: label, names, versions.
SHORT = (
    ("agpl", "agpl", "1 3"), ("lgpl", "lgpl", "2 2.1 3"), ("gpl", "gpl", "1 2 3"), ("gfdl", "gfdl fdl", "1.1 1.2 1.3"), ("mpl", "mpl", "1.0 1.1 2.0"), ("epl", "epl", "1.0 2.0"), ("cddl", "cddl", "1.0 1.1"), ("eupl", "eupl", "1.1 1.2"),
    ("apache", "apache asl", "1.1 2.0"), ("cecill", "cecill", "1.0 2.0 2.1"), ("sil-ofl", "ofl", "1.0 1.1"), ("lppl", "lppl", "1.2 1.3c"), ("sspl", "sspl", "1"), ("busl", "busl bsl", "1.1"), ("odbl", "odbl", "1.0"), ("upl", "upl", "1.0"),
)


class Rule:
    """A signature; ``gates``: for each spelling, the words that it cannot match without. The group ``at``, if there is one, is what is detected."""

    def __init__(self, label: str, expr: str, priority: int, weight: float, gate: str | None = None):
        self.label, self.priority, self.weight = label, priority, weight
        self._find = re.compile(rf"(?<![^ ])(?:{expr})(?![^ ])".encode()).finditer
        self._at = "at" if "(?P<at>" in expr else 0
        expr = gate or expr
        self.gates = [_required(x) for x in (expr.replace("licen[sc]e", "license"), expr.replace("licen[sc]e", "licence"))]

    def open(self, words: set[bytes]) -> bool:
        return any(words.issuperset(g) for g in self.gates)

    def spans(self, form: bytes) -> Iterator[tuple[int, int]]:
        return (m.span(self._at) for m in self._find(form))


def _required(expr: str) -> list[bytes]:
    """Whole plain words outside brackets, the longest first, common ones last."""
    bare, depth = "", 0
    for c in re.sub(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)\??", lambda m: " " if m[0].startswith("(?: ") or m[0].endswith(" )?") else "~", expr):
        depth += c == "("
        bare += "" if depth else c
        depth -= c == ")"
    found = [w for w in bare.split(" ") if re.fullmatch(r"[a-z0-9]+", w)]
    if not found:
        raise ValueError(f"no word gates {expr!r}")
    return [w.encode() for w in sorted(found, key=lambda w: (w in COMMON, -len(w)))]


def _spaced(version: str) -> str:
    return version.replace(".", " ").removesuffix(" 0")


def _spdx(label: str, ident: str) -> Iterator[Rule]:
    """An SPDX line's first operand, and one after an operator."""
    for before, weight in (("", 0.99), (r"(?:(?!spdx )[a-z0-9]+ ){1,24}?(?:or|and|with) ", 0.95)):
        yield Rule(label, rf"spdx license identifier {before}(?P<at>{ident}(?: only| or later)?)", 0, weight, f"spdx license identifier {ident}")


@functools.lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """In order of priority."""
    grant = r"(?:licensed|released|distributed|available|published) (?:under|subject to)(?: the)?(?: terms of)?(?: the)?"
    out = []
    for label, names, ident, versions in FAMILIES:
        for name in re.split(r"\|(?![^(]*\))", names):
            for v in versions.split():
                tail = rf"(?: version| v)? {_spaced(v)}(?: 0)?"
                out.append(Rule(label, rf"{grant} {name}{tail}(?: or later)?", 1, 0.95))
                out.append(Rule(label, rf"{name}{tail}", 3, 0.8))
            out.append(Rule(label, rf"{grant} {name}", 4, 0.85))
            out.append(Rule(label, name, 5, 0.6))
        for v in versions.split():
            out += _spdx(label, rf"{ident} {v.replace('.', ' ')}")
        out += _spdx(label, ident)
    for label, names, versions in SHORT:
        for name in names.split():
            for v in versions.split():  # GPL 3, GPL v3, GPL-3.0-only; GPLv3, GPL3
                major, *rest = _spaced(v).split()
                tail = "".join(f" {x}" for x in rest) + "(?: 0)?(?: only| or later)?"
                out.append(Rule(label, rf"(?:gnu )?{name} (?:version |v ?)?{major}{tail}", 3, 0.7))
                out += [Rule(label, rf"{name}{mark}{major}{tail}", 3, 0.7) for mark in ("v", "")]
    for ident in IDENTIFIERS:
        out += _spdx(ident.replace(" ", "-"), ident)
    for label, passages in BODIES.items():
        out += [Rule(label, expr, 2, 0.9) for expr in passages.splitlines()]
    out += [Rule(label, expr, 6, weight) for label, expr, weight in NOTICES]
    return tuple(sorted(out, key=lambda r: r.priority))


@functools.lru_cache(maxsize=1)
def _keyed() -> dict[bytes, list[Rule]]:
    """The keyword prefilter: rules by the longest word of each of their gates."""
    out: dict[bytes, list[Rule]] = {}
    for r in rules():
        for key in {g[0] for g in r.gates}:
            out.setdefault(key, []).append(r)
    return out


@functools.lru_cache(maxsize=1)
def _keys() -> frozenset[bytes]:
    return frozenset(_keyed()) | {max(p.encode().split(), key=len) for p, _ in PHRASES}


def detect(form: bytes, words: set[bytes], keys: frozenset[bytes] | set[bytes]) -> list[tuple[int, int, str, float]]:
    """Kept detections (start, end, label, weight) in bytes of the blank-joined form."""
    tried = {id(r): r for k in keys for r in _keyed().get(k, ()) if r.open(words)}.values()
    found = {(r.priority, a - b, a, b, r.label, r.weight) for r in tried for a, b in r.spans(form)}
    kept: list[tuple[int, int, str, float]] = []
    starts: list[int] = []  # of the kept spans that lie in no other one; their ends rise with them
    ends: list[int] = []
    for _, _, a, b, label, weight in sorted(found):
        i = bisect_right(starts, a)
        if i and ends[i - 1] >= b:
            continue
        kept.append((a, b, label, weight))
        j = i
        while j < len(starts) and ends[j] <= b:
            j += 1
        if i and starts[i - 1] == a:
            i -= 1
        starts[i:j], ends[i:j] = [a], [b]
    return kept


def phrase_places(form: bytes) -> list[tuple[int, str]]:
    """(byte place, label) of every place of a base phrase."""
    out = []
    for phrase, label in PHRASES:
        p, at = phrase.encode(), -1
        while (at := form.find(p, at + 1)) >= 0:
            if (at == 0 or form[at - 1] == 32) and (at + len(p) == len(form) or form[at + len(p)] == 32):
                out.append((at, label))
    return sorted(out)


def _word_numbers(form: bytes, places: set[int]) -> dict[int, int]:
    """The word that each byte place is in, counted in one pass."""
    out, n, last = {}, 0, 0
    for p in sorted(places):
        n += form.count(b" ", last, p)
        out[p], last = n, p
    return out


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, list[dict]]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    words = text.encode().translate(ALNUM).split() if text else []
    here = _keys().intersection(words)
    if not here:
        return len(words), 0, None, None, "", "", 0.0, []
    form = b" ".join(words)
    base = phrase_places(form)
    kept = detect(form, set(words), here)
    word_of = _word_numbers(form, {p for p, _ in base} | {p for a, b, _, _ in kept for p in (a, b)}).__getitem__
    miss = 1.0
    for *_, weight in kept:
        miss *= 1 - weight
    base_labels = sorted({x for _, x in base})
    labels = sorted({*base_labels, *(x for _, _, x, _ in kept)})
    spans = [{"first": word_of(a), "last": word_of(b), "label": label, "weight": w} for a, b, label, w in sorted(kept)]
    places = [word_of(a) for a, _ in base]
    return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(base_labels), ",".join(labels), round(1 - miss, 6), spans


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("weight", pa.float64())]))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document; ``detections`` has the kept spans in words, first and last included."""
    docs = pick(docs, id_col, text_col)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS)
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [scan(t.as_py()) for t in b.column(1)]
        schema = pa.schema([b.schema.field(0), *map(pa.field, names, kinds)])
        yield batch(schema, b.column(0), *([r[k] for r in rows] for k in range(len(kinds))))

    return map_batches(docs, run, f"`{id_col}` {docs.schema[0].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<first:long,last:long,label:string,weight:double>>")
