import re

import pytest

from constella.llm import licenses as L

MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (MIT, ["MIT"]), (APACHE, ["Apache-2.0"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Released under the MIT License.", ["MIT"]), ("x y\nAll rights reserved.\nz", ["Proprietary"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]), ("SPDX-License-Identifier: MIT", ["MIT"]), ("Licensed under the GNU Lesser General Public License v2 or later", ["LGPL-2.0-or-later"]),
        ("All\n rights  reserved.", ["Proprietary"]), ("licenses are nice", []), (None, []), ("", []), ("Released under the MIT License\nand more words", ["MIT"]), ("licensed under the 3-clause BSD license!", ["BSD-3-Clause"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    ],
)
def test_recognised(text, want):
    licences, left = L.recognise(text)
    assert [x["license"] for x in licences] == want
    for x in licences:
        assert text[x["start"] : x["end"]].strip() and not text[x["start"]].isspace()


def test_order_gap_and_leftovers():
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    assert [x["sentence"] for x in L.recognise(notice)[1]] == ["mit-notice"]
    grant, as_is = MIT.split("\n\n")[1], MIT.split("\n\n")[3]
    filler = "An unknown sentence. "
    assert [x["license"] for x in L.recognise(f"{grant}\n\n{filler * 2}{notice}\n\n{as_is}")[0]] == ["MIT"]
    assert L.recognise(f"{grant}\n\n{filler * 3}{notice}\n\n{as_is}")[0] == []


def test_every_rule_names_known_sentences_and_every_sentence_holds_an_anchor():
    for _, ids, _ in L.RULES:
        assert set(ids) <= set(L.SENTENCES)
    for name, p in L.SENTENCES.items():
        assert any(L.normalise(a) in p.replace("(?:", "").replace(")", "") for a in L.ANCHORS) or name in ("spdx", "apache-ref", "cddl-title"), name


LINES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "All rights reserved.": "Proprietary",
}


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {}
    for r in docs.collect():
        want[r.doc_id] = sorted((m.start(), LINES[m[0]], m.end()) for line in LINES for m in re.finditer("(?m)^" + re.escape(line) + "$", r.text))
    got = L.scan(docs).collect()
    assert len(got) == len(want) and sum(map(len, want.values())) > 10
    assert all([(x.start, x.license, x.end) for x in r.licenses] == want[r.doc_id] for r in got)


def test_empty_table_and_nulls(spark):
    docs = spark.createDataFrame([(None, None), (1, "MIT"), (1, "All rights reserved")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.licenses)) for r in L.scan(docs).collect()) == [(0, 0), (1, 0), (1, 1)]
    assert L.scan(docs.limit(0)).count() == 0


GPL3 = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.

""" + "  Sections one to seventeen stand here. They are left out. So are their lists.\n\n" * 30 + "                     END OF TERMS AND CONDITIONS\n"
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software."""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (GPL3, ["GPL-3.0-only"]), (GPL3.replace("GNU GENERAL", "GNU LESSER GENERAL").replace("The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.", "This version of the GNU Lesser General Public License incorporates\nthe terms and conditions of version 3 of the GNU General Public\nLicense, supplemented by the additional permissions listed below."), ["LGPL-3.0-only"]),
        (ZLIB[: ZLIB.index("\n\n1.")], ["Zlib"]), ("Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\").", ["EPL-2.0"]),
        ("This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.", ["Artistic-2.0"]), ("COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0", ["CDDL-1.0"]),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nThe licenses for most software are designed to take away your freedom to share and change it.", ["GPL-2.0-only"]),
    ],
)
def test_bodies_of_licences(text, want):
    assert [x["license"] for x in L.recognise(text)[0]] == want


def one_by_one(sentence):
    """Every pattern in turn, without a lookup."""
    words = L.normalise(sentence)
    for name, p in L.SENTENCES.items():
        if len(sentence) <= L.LONGEST and (m := re.fullmatch(p, words)):
            return name, {k: (v or "").strip() for k, v in m.groupdict().items()}
    return None


def test_lookups_agree_with_all_patterns(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + [GPL3, ZLIB, MIT, APACHE, *LINES]
    seen = 0
    for t in texts:
        for lo, hi in L.sentences(t):
            for part in (t[lo:hi], *t[lo:hi].splitlines()):
                assert L._known(part) == one_by_one(part), part
                seen += L._known(part) is not None
    assert seen > 40


def test_long_texts_and_other_columns(spark):
    filler = "no licence in here\n" * 200_000
    docs = spark.createDataFrame([(1, f"{filler}Released under the MIT License.\n{filler}", "x", 1), (2, "license " * 300_000, None, 2)], "doc_id long, text string, licenses string, start int")
    got = {r.doc_id: r for r in L.scan(docs).collect()}
    assert [(x.license, x.start) for x in got[1].licenses] == [("MIT", len(filler))] and got[2].licenses == []


@pytest.mark.parametrize("gap", [" ", "\n * "])
@pytest.mark.parametrize(
    ("before", "known", "after", "name", "license"),
    [
        ("word ", "released under the MIT License", "", "mit-ref", "MIT"), ("word ", "licensed under CC BY-NC 4.0", "", "cc-ref", "CC-BY-NC-4.0"), ("word ", "licensed under the GNU General Public License, version 3", "", "gpl-ref", "GPL-3.0-only"),
        ("licensed under ", "licensed under a 2-clause BSD license", "", None, None), ("word ", "licensed under the Apache License, Version 2.0", "", "apache-ref", "Apache-2.0"),
        ("", "You may obtain a copy of the License at", " word", "apache-obtain", None), ("", "SPDX-License-Identifier: mit", " word", "spdx", None), ("word ", "CC BY-NC 4.0", "", None, None),
    ],
)
def test_sentences_of_any_length_are_known(gap, before, known, after, name, license):
    for n in (700, 40_000):
        text = (before * n).replace(" ", gap) + known + (after * n).replace(" ", gap)
        found = L._known(text)
        assert len(text) > 3_500 and (found and found[0]) == next((k for k, p in L.SENTENCES.items() if re.fullmatch(p, L.normalise(text))), None)
        if name:
            assert found[0] == name
        if license:
            assert [x["license"] for x in L.recognise(f"First sentence. {text}. Last sentence.")[0]] == [license]
