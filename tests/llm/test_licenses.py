import re

import pytest

from lodevec.llm import licenses as L
from lodevec.llm.queries import op10_licenses

MODEL = L.train()


def slow(rows):
    """Whole paragraphs that are confirmed, else their lines, by the model's plain classifier."""
    out = []

    def add(i, k, line, found):
        if found[0] != L.UNKNOWN:
            out.append((i, k, line, found[0], round(found[1], 5), round(found[2], 5), found[3]))

    for i, text in rows:
        if text is None:
            continue
        for k, body in enumerate(re.split(L.BLANK, text)):
            lines, whole = body.split("\n"), MODEL.classify(body)
            if len(lines) > 1 and whole[3]:
                add(i, k, None, whole)
            else:
                for n, line in enumerate(lines):
                    add(i, k, n, MODEL.classify(line))
    return sorted(out, key=str)


def rounded(frame):
    return sorted(((r[0], r.paragraph, r.line, r.family, round(r.chance, 5), round(r.similarity, 5), r.confirmed) for r in frame.collect()), key=str)


#: Notices in words that neither templates nor calibration have.
HELD_OUT = {
    "MIT": ["Everything here is licensed under MIT.", "Source code: MIT License", "It is free to use under the MIT license"],
    "Apache-2.0": ["The tools are licensed under Apache 2.0", "You may obtain a copy under the Apache License, Version 2.0", "Code is covered by the Apache License"],
    "BSD": ["The parser is licensed under the 3-Clause BSD License", "Released under a BSD license.", "This code is BSD licensed"],
    "GPL": ["You can redistribute the tool under the GNU GPL", "This is GPL software, version 2 or any later version", "The code falls under the GNU General Public License v2"],
    "LGPL": ["The bindings are released under the LGPL license", "Linked code falls under the GNU Lesser General Public License"],
    "AGPL": ["Our service is licensed under the GNU Affero General Public License", "The backend falls under AGPL"],
    "MPL-2.0": ["The engine is licensed under MPL 2.0", "Code in this folder falls under the Mozilla Public License"],
    "EPL": ["The tools are licensed under the Eclipse Public License v1.0", "Released under EPL 2.0"],
    "ISC": ["The package is licensed under ISC", "Released under the ISC License"],
    "BSL-1.0": ["The headers are licensed under the Boost Software License"],
    "BUSL": ["The database is licensed under the Business Source License"],
    "CC-BY-NC": ["Pictures are licensed under CC BY-NC", "Creative Commons Attribution-NonCommercial applies to the photos"],
    "CC-BY-SA": ["Articles are licensed under CC BY-SA", "Shared under the Creative Commons Attribution-ShareAlike License"],
    "CC-BY": ["The corpus is licensed under CC BY 4.0", "Creative Commons Attribution 4.0"],
    "CC0": ["The list is in the public domain, CC0 1.0", "Released to the public under CC0"],
    "proprietary": ["2021 Example Corp. All rights reserved", "This document is proprietary and confidential"],
}
PROSE = [
    "The mit of the goalkeeper was found on the field.", "He was a public servant for most of his life.", "The version of events told by the driver was not true.", "They were granted a license to fish in the lake.",
    "A general of the army was in charge of the region.", "The commons of the village are used by all.", "Software is eating the world, said the author.", "The apache tribe lived in the south.",
    "Her creative work was shown in the gallery.", "It was published in the spring and sold well.", "The terms of the contract were not clear.", "You can use the bridge free of charge.",
    "The foundation gave the money to a school.", "Under the table lay a dog.", "The file was closed and the case was over.", "The right to vote was reserved to men.",
    "The sea was boosted by a storm.", "Attribution of the painting is not certain.", "His license was revoked by the state.", "The public was not allowed to see the document.",
]


def test_held_out_notices_and_prose():
    pairs = [(f, MODEL.classify(t)[0]) for f, ts in HELD_OUT.items() for t in ts] + [(L.UNKNOWN, MODEL.classify(t)[0]) for t in PROSE]
    notices = sum(want != L.UNKNOWN for want, _ in pairs)
    right = sum(want == got != L.UNKNOWN for want, got in pairs)
    said = sum(got != L.UNKNOWN for _, got in pairs)
    assert right / notices >= 0.9 and right / said >= 0.9
    seen = {t for ts in [*L.TEMPLATES.values(), *L.CALIBRATION.values()] for t in ts}
    assert not seen & {t for ts in HELD_OUT.values() for t in ts}


def test_one_deciding_word_is_enough():
    assert MODEL.classify("Licensed under the GNU Affero General Public License, version 3")[0::3] == ("AGPL", True)
    assert MODEL.classify("Licensed under the GNU General Public License, version 3")[0::3] == ("GPL", True)
    assert MODEL.classify("Licensed under the Eclipse Public License, version 2.0")[0::3] == ("EPL", True)
    plain = L.Model(["GPL"], ["gnu"], [[5.0, 0.0]], [0.0, 1.0], [("GPL", L.bigrams_of(L.words_of("licensed under the gnu general public license version 3")))], L.slots_of(["gnu"]))
    assert plain.classify("licensed under the gnu affero general public license version 3")[3] is False
    assert plain.classify("licensed under the gnu general public license version 3")[3] is True


def test_wrapped_notices_are_one_paragraph(spark):
    notice = L.TEMPLATES["MIT"][-1].split()
    wrapped = "\n".join(" ".join(notice[i : i + 10]) for i in range(0, len(notice), 10))
    rows = [(1, "A title\n\n" + wrapped + "\n \t\nprose and more prose"), (2, "some words of prose that go on and on for a while\nReleased under the MIT License.\nmore words of prose, and then some"), (3, wrapped)]
    found = rounded(L.scan(spark.createDataFrame(rows, "doc_id long, text string"), MODEL))
    assert [(f[0], f[1], f[2], f[3], f[6]) for f in found] == [(1, 1, None, "MIT", True), (2, 0, 1, "MIT", True), (3, 0, None, "MIT", True)]
    assert found == slow(rows)


@pytest.mark.parametrize(("line", "family"), [
    ("Released under the MIT License.", "MIT"),
    ("licensed under the apache license, version 2.0!", "Apache-2.0"),
    ("This library is licensed under the GNU General Public License, version 2.", "GPL"),
    ("All of this work is licensed under CC BY-NC 4.0", "CC-BY-NC"),
    ("distributed under the Mozilla Public License, version 2.0", "MPL-2.0"),
    ("The fisherman renewed his license in the public office.", L.UNKNOWN),
    ("A licensed guide led the general public under the bridge", L.UNKNOWN),
    ("", L.UNKNOWN),
])
def test_families(line, family):
    found, _, alike, confirmed = MODEL.classify(line)
    assert found == family and (family == L.UNKNOWN or alike >= L.LEAST_SHARED and confirmed)


def test_templates_and_prose_are_told_apart():
    assert all(MODEL.classify(t)[0] == f and MODEL.classify(t)[2] == 1.0 for f, ts in L.TEMPLATES.items() for t in ts)
    assert all(MODEL.classify(t)[0] == L.UNKNOWN for t in L.ORDINARY)


def test_training_repeats():
    assert L.train() == MODEL


def test_hostile_rows(spark, docs, no_docs):
    line = "Licensed under the Apache License, Version 2.0."
    more = [(20, line + "\n" + line, "en"), (20, line + "\n" + line, "en"), (None, line, None), (21, "\n".join(["word"] * 5000 + [line]), None), (22, "x" * 50_000 + " " + line, None)]
    frame = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True)
    want = slow([(r.doc_id, r.text) for r in frame.collect()])
    assert rounded(L.scan(frame, MODEL)) == want and len([w for w in want if w[0] == 20]) == 2 and {w[0] for w in want} == {None, 9, 20, 21, 22}
    assert L.scan(no_docs, MODEL).count() == 0


def test_query_is_native_and_right(spark, sf_dir):
    found = op10_licenses(spark, sf_dir)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rounded(found) == slow(rows)
