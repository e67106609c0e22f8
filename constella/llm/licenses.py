"""Licence scanning by sentence rules.

A text is cut into sentences, each is normalised to its words and mapped to the identifier of a known licence
sentence: by a lookup of its words as they are, or, for sentences with names, years or versions in them, among the
patterns that share its rarest known word. The sequence of identifiers is matched against licence rules, in their
order: at each place the first rule whose identifiers follow one another wins, with at most ``GAP`` unknown sentences
between them, or any number in the body of a long licence. Known sentences that no rule takes are reported as well.

Every known sentence holds one of ``ANCHORS``; a text without any of them is done at once. Null or empty text
has no sentence; rows of one identifier, and repeated rows, are each reported; other columns are ignored whatever their
names; an empty table gives no rows. Where rules tie the first listed wins. A sentence of any length is looked up: no
pattern has more than one part of open length before its fixed words, so that takes time in proportion to its length.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from constella.llm import _store

#: Unknown sentences that may stand between two of a rule, and characters of a sentence that is looked up: any number.
GAP, LONGEST = 2, sys.maxsize

# Known sentences as patterns over normalised words, and the licences that sequences of them name.
SENTENCES = {
    "spdx": r"spdx license identifier (?P<name>[a-z0-9 ]+)",
    "apache-ref": r"(?:.* )?(?:licensed|released|distributed|available) under (?:the terms of )?the apache (?:software )?license,? (?:version |v)?(?P<version>2)(?: 0)?(?: the license)?",
    "apache-compliance": r"you may not use this (?:file|work|software) except in compliance with the license",
    "apache-obtain": r"you may obtain a copy of the license at(?: .*)?",
    "apache-unless": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": r"see the license for the specific language governing permissions and limitations under the license",
    "gpl-ref": r"(?:.* )?licensed under (?:the terms of )?the (?:gnu )?(?P<family>lesser |affero )?(?:gnu )?general public license,?(?: version| v)? ?(?P<version>2|3)?(?P<later>(?: 0)? or (?:\(?at your option\)? )?(?:any )?later(?: version)?)?(?: 0)?",
    "gpl-free": r"(?:this program|this library|.{1,60}) is free software you can redistribute it and or modify it under the terms of the gnu (?P<family>lesser |affero )?general public license as published by the free software foundation either version (?P<version>2|2 1|3) of the license or at your option any later version",
    "gpl-hope": r"(?:this program|this library|.{1,60}) is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": r"see the gnu (?:lesser |affero )?general public license for more details",
    "gpl-received": r"you should have received a copy of the gnu (?:lesser |affero )?general public license along with this (?:program|library)(?: .*)?",
    "mit-ref": r"(?:.* )?(?:licensed|released|distributed|available) under (?:the terms of )?the mit license",
    "mit-grant": r"(?:mit license )?(?:copyright .{1,80} )?permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": r"in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-ref": r"(?:.* )?(?:licensed|released|distributed) under (?:the terms of )?(?:the |a )?(?P<clauses>2|3|two|three)? ?(?:clause )?bsd(?: style)? license",
    "bsd-grant": r"(?:.* )?redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": r"(?:1 )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": r"(?:2 )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": r"(?:3 )?neither the names? of .{1,120} may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": r"this software is provided by .{1,80} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-grant": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-ref": r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0",
    "mpl-obtain": r"if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0",
    "cc-ref": r"(?:.* )?licensed under (?:a |the )?(?:cc|creative commons) (?P<terms>(?:by|attribution)(?:[ ](?:nc|nd|sa|noncommercial|noderivatives|sharealike|non commercial|no derivatives|share alike))*) (?P<version>[1-4] [05])(?: (?:international|unported))?(?: license)?",
    "cc-zero": r"(?:.* )?(?:licensed under |released under |dedicated under )cc0(?: 1 0)?(?: universal)?(?: license)?",
    "bsd-advert": r"(?:3 )?all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment(?: .*)?",
    "bsd-liability": r"in no event shall .{1,80} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "zlib-as-is": r"this software is provided as is without any express or implied warranty",
    "zlib-liability": r"in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": r"(?:1 )?the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "boost-title": r"boost software license version 1 0(?: august 17th 2003)?",
    "boost-grant": r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "wtfpl": r"(?:0 )?you just do what the fuck you want to",
    "gpl3-title": r"(?:gnu general public license )?version 3 29 june 2007",
    "gpl3-preamble": r"the gnu general public license is a free copyleft license for software and other kinds of works",
    "gpl2-title": r"(?:gnu general public license )?version 2 june 1991",
    "gpl2-preamble": r"the licenses for most software are designed to take away your freedom to share and change it",
    "lgpl21-title": r"(?:gnu lesser general public license )?version 2 1 february 1999",
    "lgpl21-first": r"this is the first released version of the lesser gpl",
    "lgpl3-incorporates": r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "agpl3-title": r"(?:gnu affero general public license )?version 3 19 november 2007",
    "agpl3-preamble": r"the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "license-verbatim": r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "apache-title": r"(?:apache license )?version 2 0 january 2004(?: http.*)?",
    "apache-terms": r"(?:1 )?(?:definitions )?license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    "end-of-terms": r"end of terms and conditions",
    "mpl-title": r"mozilla public license version 2 0",
    "mpl-contributor": r"(?:1 1 )?(?:contributor )?means each individual or legal entity that creates contributes to the creation of or owns covered software",
    "epl-title": r"eclipse public license v(?:ersion)? ?(?P<version>[12] 0)",
    "epl-accompanying": r"the accompanying program is provided under the terms of this eclipse public license agreement",
    "artistic2-establishes": r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed",
    "artistic1-intent": r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package while giving the users of the package the right to use and distribute the package in a more or less customary fashion plus the right to make reasonable modifications",
    "cddl-title": r"common development and distribution license(?: cddl)? version (?P<version>1 [01])",
    "unlicense": r"this is free and unencumbered software released into the public domain",
    "reserved": r"(?:copyright .{1,80} )?all rights reserved",
}
#: Licence, identifiers in order, and whether any number of other sentences may stand between them.
RULES = [
    ("AGPL-3.0-only", ["agpl3-title", "agpl3-preamble", "end-of-terms"], True),
    ("AGPL-3.0-only", ["agpl3-title", "agpl3-preamble"], True),
    ("LGPL-3.0-only", ["gpl3-title", "license-verbatim", "lgpl3-incorporates"], True),
    ("LGPL-3.0-only", ["lgpl3-incorporates"], True),
    ("LGPL-2.1-only", ["lgpl21-title", "lgpl21-first", "end-of-terms"], True),
    ("LGPL-2.1-only", ["lgpl21-title", "lgpl21-first"], True),
    ("GPL-3.0-only", ["gpl3-title", "gpl3-preamble", "end-of-terms"], True),
    ("GPL-3.0-only", ["gpl3-title", "gpl3-preamble"], True),
    ("GPL-2.0-only", ["gpl2-title", "gpl2-preamble", "end-of-terms"], True),
    ("GPL-2.0-only", ["gpl2-title", "gpl2-preamble"], True),
    ("Apache-2.0", ["apache-title", "apache-terms", "end-of-terms"], True),
    ("Apache-2.0", ["apache-title", "apache-terms"], True),
    ("MPL-2.0", ["mpl-title", "mpl-contributor"], True),
    ("EPL-{version}", ["epl-title", "epl-accompanying"], True),
    ("EPL-{version}", ["epl-title"], False),
    ("CDDL-{version}", ["cddl-title"], False),
    ("Artistic-2.0", ["artistic2-establishes"], False),
    ("Artistic-1.0", ["artistic1-intent"], False),
    ("Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant", "zlib-origin"], False),
    ("Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant"], False),
    ("BSL-1.0", ["boost-title", "boost-grant"], True),
    ("BSL-1.0", ["boost-grant"], False),
    ("WTFPL", ["wtfpl"], False),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-name", "bsd-as-is", "bsd-liability"], False),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-name", "bsd-as-is"], False),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is", "bsd-liability"], False),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability"], False),
    ("Apache-2.0", ["apache-ref", "apache-compliance", "apache-obtain", "apache-unless", "apache-see"], False),
    ("Apache-2.0", ["apache-ref", "apache-compliance", "apache-unless", "apache-see"], False),
    ("GPL-{family}{version}-or-later", ["gpl-free", "gpl-hope", "gpl-details", "gpl-received"], False),
    ("GPL-{family}{version}-or-later", ["gpl-free", "gpl-hope", "gpl-details"], False),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is"], False),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"], False),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"], False),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"], False),
    ("ISC", ["isc-grant"], False),
    ("MPL-2.0", ["mpl-ref", "mpl-obtain"], False),
    ("MPL-2.0", ["mpl-ref"], False),
    ("{name}", ["spdx"], False),
    ("Apache-2.0", ["apache-ref"], False),
    ("GPL-{family}{version}-or-later", ["gpl-free"], False),
    ("GPL-{family}{version}{later}", ["gpl-ref"], False),
    ("MIT", ["mit-ref"], False),
    ("BSD-{clauses}-Clause", ["bsd-ref"], False),
    ("CC-{terms}-{version}", ["cc-ref"], False),
    ("CC0-1.0", ["cc-zero"], False),
    ("Unlicense", ["unlicense"], False),
    ("Proprietary", ["reserved"], False),
]
ANCHORS = ("licens", "copyright", "permission", "redistribut", "warrant", "rights reserved", "free software", "public domain", "mozilla", "as is", "express or implied", "terms and conditions", "misrepresented", "what the fuck", "gpl", "version 3", "version 2", "entity that creates", "held liable", "be liable", "advertising materials", "artistic control")

_VARIABLE = re.compile(r"[][()|?*+.{}\\]")
#: Sentences that are always the same words, by these; and patterns of the others by a word that each of them must hold.
_SAME = {p: k for k, p in SENTENCES.items() if not _VARIABLE.search(p)}


def _needed(pattern: str) -> str:
    """The longest word that stands outside of all choices of a pattern."""
    flat, depth, words = [], 0, pattern.replace("\\", "")
    for k, c in enumerate(words):
        depth += c in "([{"
        flat.append(c if not depth and c not in "?*+.|" and words[k + 1 : k + 2] not in ("?", "*", "+", "{") else " ")
        depth -= c in ")]}"
    found = [w for w in "".join(flat).split() if re.search(rf"(?:^| ){w}(?: |$)", "".join(flat))]
    return max(found, key=len)


_BY_WORD: dict[str, list[tuple[str, re.Pattern]]] = {}
for _name, _pattern in SENTENCES.items():
    if _pattern not in _SAME:
        _BY_WORD.setdefault(_needed(_pattern), []).append((_name, re.compile(_pattern)))
_FROM: dict[str, list[tuple[str, list[str], bool]]] = {}
for _rule in RULES:
    _FROM.setdefault(_rule[1][0], []).append(_rule)
_ORDER = {name: k for k, name in enumerate(SENTENCES)}
_SENTENCE_END = re.compile(r"(?:[.!?;]|(?<!dentifier):)(?=[\s\"')\]]|\Z)|\n[^\S\n]*(?:[#*/;-]+[^\S\n]*)?(?=\n)|\n(?=[^\S\n]*(?:[#*/]+[^\S\n]*)?(?:[-*•]|\(?[a-z0-9]\)|[0-9]+\.)[^\S\n])")
_NOT_WORD = re.compile(r"[^a-z0-9]+")


def normalise(sentence: str) -> str:
    return _NOT_WORD.sub(" ", sentence.lower()).strip()


def _known(sentence: str) -> tuple[str, dict] | None:
    """The identifier of a sentence and the named parts in it."""
    words = normalise(sentence)
    if name := _SAME.get(words):
        return name, {}
    options = {name: p for w in set(words.split()) if w in _BY_WORD for name, p in _BY_WORD[w]}
    for name in sorted(options, key=_ORDER.__getitem__):
        if m := options[name].fullmatch(words):
            return name, {k: (v or "").strip() for k, v in m.groupdict().items()}
    return None


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Spans of sentences: up to an end mark, an empty line, or a new list item."""
    at = 0
    for m in _SENTENCE_END.finditer(text):
        if text[at : m.start()].strip():
            yield at, m.end()
        at = m.end()
    if text[at:].strip():
        yield at, len(text)


def identify(text: str) -> list[tuple[int, str, int, int, dict]]:
    """(number, identifier, start, end, parts) of the known sentences; lines that are known by themselves come before the sentence they stand in."""
    out, number = [], 0
    for lo, hi in sentences(text):
        at, lines = lo, []
        for line in text[lo:hi].splitlines(keepends=True):
            if line.strip():
                lines.append((at + len(line) - len(line.lstrip()), at + len(line.rstrip())))
            at += len(line)
        known = [(k, a, b, f) for k, (a, b) in enumerate(lines) if (f := _known(text[a:b]))]
        if not known and len(lines) > 1 and (f := _known(text[lo:hi])):
            known, lines = [(0, lines[0][0], hi, f)], lines[:1]
        out += [(number + k, f[0], a, b, f[1]) for k, a, b, f in known]
        number += len(lines) if known else 1
    return out


# How parts of names are written.
_WORDS = {"two": "2", "three": "3", "attribution": "BY", "noncommercial": "NC", "non commercial": "NC", "noderivatives": "ND", "no derivatives": "ND", "sharealike": "SA", "share alike": "SA"}


def _named(rule: str, parts: dict) -> str:
    own = dict(parts)
    if "terms" in own:
        for k in sorted(_WORDS, key=len, reverse=True):
            own["terms"] = own["terms"].replace(k, _WORDS[k])
        own["terms"], own["version"] = own["terms"].upper().replace(" ", "-"), own["version"].replace(" ", ".")
    elif rule.startswith("GPL-{"):
        family = {"lesser": "L", "affero": "A"}.get(own.get("family", ""), "")
        version = {"": "", "2": "-2.0", "2 1": "-2.1", "3": "-3.0"}[own.get("version", "")]
        later = "-or-later" if own.get("later") or rule.endswith("or-later") else "-only" if version else ""
        return f"{family}GPL{version}{later}"
    elif "name" in own:
        return "-".join(w.upper() if w in ("mit", "gpl", "bsd", "cc", "by", "mpl", "isc") else w for w in own["name"].split()).replace("apache-2-0", "Apache-2.0")
    elif rule.startswith(("EPL", "CDDL")):
        own["version"] = own["version"].replace(" ", ".")
    elif "clauses" in own:
        n = _WORDS.get(own["clauses"], own["clauses"])
        return f"BSD-{n}-Clause" if n else "BSD"
    return rule.format(**own)


def recognise(text: str | None) -> tuple[list[dict], list[dict]]:
    """(licences, sentences left over) of one text, with their spans in code points."""
    low = (text or "").lower()
    if not any(a in low for a in ANCHORS):
        # Words may be split by white space or marks; each anchor of two words is looked for in its normal form too.
        if not any(" " in a and a.split()[0] in low and a in normalise(low) for a in ANCHORS):
            return [], []
    found, licences, left, k = identify(text), [], [], 0
    while k < len(found):
        for name, ids, apart in _FROM.get(found[k][1], ()):
            if own := _follow(found, k, ids, apart):
                parts = {}
                for x in own:
                    parts |= {a: b for a, b in x[4].items() if b or a not in parts}
                licences.append({"license": _named(name, parts), "start": own[0][2], "end": own[-1][3]})
                k = found.index(own[-1], k) + 1
                break
        else:
            left.append({"sentence": found[k][1], "start": found[k][2], "end": found[k][3]})
            k += 1
    return licences, left


def _follow(found: list, k: int, ids: list[str], apart: bool) -> list | None:
    """The known sentences from place k that match a rule, if they do; with ``apart`` others may stand between them."""
    own = [found[k]]
    if not apart:
        own = found[k : k + len(ids)]
        return own if [x[1] for x in own] == ids and all(b[0] - a[0] <= GAP + 1 for a, b in zip(own, own[1:], strict=False)) else None
    for wanted in ids[1:]:
        k = next((j for j in range(k + 1, len(found)) if found[j][1] == wanted), -1)
        if k < 0:
            return None
        own.append(found[k])
    return own


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licences and unmatched known sentences of every document, in text order."""
    span = [("start", pa.int64()), ("end", pa.int64())]
    found, left = pa.list_(pa.struct([("license", pa.string()), *span])), pa.list_(pa.struct([("sentence", pa.string()), *span]))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [recognise(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([x[0] for x in both], found), pa.array([x[1] for x in both], left)], ["doc_id", "licenses", "unmatched"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(texts, f"doc_id {kind}, licenses array<struct<license:string,start:long,end:long>>, unmatched array<struct<sentence:string,start:long,end:long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_store.table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",").alias("licenses"), spans.alias("spans"), F.size("unmatched").cast("long").alias("n_unmatched"))


