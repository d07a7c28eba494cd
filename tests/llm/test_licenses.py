"""The licence scan against the same model in plain Python, on statements held back, and on text that only looks like one."""

import math
import random
import re
import textwrap

import pytest

from lodespark.llm import licenses as L


def judged(p, c):
    w = L.words(p)
    g = {*L.grams(w), *L.novelty(w, set(c.vocabulary))}
    scores = [(b + sum(c.weights[x][k] for x in g if x in c.weights)) / c.temperature for k, b in enumerate(c.bias)]
    total = sum(math.exp(s - max(scores)) for s in scores)
    family = c.families[scores.index(max(scores))] if 1 / total >= L.THRESHOLD else L.UNKNOWN
    similar, joined, own = 0.0, f" {' '.join(w)} ", set(L.shingles(w))
    for t, needed in c.templates.get(family, ()):
        if all(f" {n} " in joined for n in needed):
            similar = max(similar, 1.0 if len(t) == 1 else len(set(t) & own) / len(t))
    return family, round(1 / total, 9), round(similar, 9), similar >= L.SIMILAR


def windows(p):
    w = p.split()
    return [p] if len(L.words(p)) <= L.MOST_WORDS else [" ".join(w[i : i + n]) for n in L.WINDOWS for i in range(0, len(w), n // 2)]


def plain(text, c):
    found, line = [], 0
    gated = lambda x: any(g in x.lower() for g in L.GATES)
    for block in re.split(L.BLANK, text or ""):
        lines = block.split("\n")
        lead = re.match(r"^\s*", block)[0].count("\n")
        passages = [block] * (len(lines) > 1) + lines + [s for x in lines for s in re.split(L.SENTENCE, x)]
        passages = [w for p in dict.fromkeys(passages) if gated(p) for w in windows(p)]
        verdicts = [v for v in (judged(p, c) for p in passages if gated(p) and not re.search(L.DENIED, p)) if v[0] != L.UNKNOWN]
        sure = [v for v in verdicts if v[3]] or verdicts
        found += [(line + lead, *max((v for v in sure if v[0] == f), key=lambda v: v[1:])) for f in sorted({v[0] for v in sure})]
        line += len(lines) + 1
    return found


TEXTS = [
    "Released under the MIT License.", "intro\nLicensed under CC BY-NC 4.0.\nmore", "This work is licensed under the GNU General Public License, version 3.", "LICENSED!! UNDER!! THE!! APACHE!! LICENSE,!! VERSION!! 2.0.",
    "He lost his license under the bridge.", "the mit team released the plan", "Mit und.", None, "", "\n\n", "Some GNU Affero General Public License, version 3 text", "under the version of a general license you copy",
    "word " * 20_000 + "\nReleased under the MIT License.", "Licensed under the Foo License, version 9.", "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "word " * 300 + "released under the MIT License " + "word " * 300,
    "One.\n\n\n\nA long way down. Licensed under the ISC License. And more.\n\n  \nSPDX-License-Identifier: GPL-2.0-only\n\nReleased under the MIT License or the Apache License 2.0.",
]


def families(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r.licences for r in L.scan(docs).collect()}


def test_sql_equals_plain_model(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x")], "doc_id bigint, text string, extra string")
    c = L.train()
    for r in L.scan(docs).collect():
        assert [(x.paragraph, x.family, round(x.probability, 9), round(x.similarity, 9), x.confirmed) for x in r.licences] == plain(TEXTS[r.doc_id], c) and r.extra == "x"


def test_every_template_has_a_gate_and_confirms_itself():
    c = L.train()
    for f, notices in L.NOTICES.items():
        for text in [*L.NAMES[f], *(f"SPDX-License-Identifier: {x}" for x in L.IDENTIFIERS[f]), *(t for t, _ in notices)]:
            assert any(g in text.lower() for g in L.GATES), text
        for text, _ in notices:
            assert judged(text, c)[0] == f and judged(text, c)[3], (f, text)


CASES = {
    "GNU General Public License, version 2.": "gpl-2.0", "Licensed under the GNU General Public License, version 2.": "gpl-2.0", "Mozilla Public License Version 1.1": "mpl-1.1", "Apache License, Version 1.1": "apache-1.1",
    "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0",
    "The MIT License debate continues among students.": None, "MIT researchers said the study was published under a new name.": None, "Licensed under the GPL.": None, "Licensed under the GNU General Public License, version 4.": None,
    "Licensed under the Creative Commons Attribution 3.0 Unported License.": None, "Released under the Artistic License 2.0.": None, "Copyright 2020 Foo. Released under the BSD 2-Clause License.": "bsd-2-clause",
}


def test_versions_apart_and_mentions_unknown(spark):
    out = families(spark, list(CASES))
    assert {t: [(x.family, x.confirmed) for x in out[i]] for i, t in enumerate(CASES)} == {t: [(f, True)] if f else [] for t, f in CASES.items()}


HELD_LEADS = ["You may use this under the", "This library is offered under the", "All code here falls under the", "Open sourced under the", "Terms: the"]
HELD_MENTIONS = ["Opponents of the {} argued that", "The lecture compared the {} to", "Nobody expected the {} to change", "An essay about the {} won"]
HELD_OTHER = [
    "The licence of the pub was withdrawn after the fire.", "A pilot needs a license before the first flight.", "The library published version 3 of its catalogue.", "Permission to land was given at noon.", "The public debate about software patents goes on.",
    "Students of the MIT sold their free tickets.", "The redistribution of land was completed in 1952.", "Taxi licenses are sold by the city.", "Apache warriors and their terms of peace.", "He endorses the new candidate.",
]


@pytest.fixture(scope="module")
def held_back():
    """(family, text) in wording that the training has not seen."""
    rnd, out = random.Random(99), []
    for f, names in L.NAMES.items():
        for name in names:
            out += [(f, f"{lead} {name}. {rnd.choice(['', 'Please read it.'])}") for lead in HELD_LEADS]
            out += [(L.UNKNOWN, f"{m.format(name)} {L.made_up(rnd, 4)}") for m in HELD_MENTIONS]
    return out + [(L.UNKNOWN, t) for t in HELD_OTHER]


def test_held_back_statements(held_back):
    c = L.train()
    found = [(f, judged(t, c)) for f, t in held_back]
    grants = [(f, v) for f, v in found if f != L.UNKNOWN]
    others = [v for f, v in found if f == L.UNKNOWN]
    right, unknown = sum(v[0] == f for f, v in grants), sum(v[0] == L.UNKNOWN for _, v in grants)
    wrong, alarms = len(grants) - right - unknown, sum(v[0] != L.UNKNOWN for v in others)
    confirmed_wrong = sum(v[3] and v[0] != f for f, v in grants)
    print(f"grants {len(grants)}: right {right}, unknown {unknown}, another family {wrong} (confirmed {confirmed_wrong}); other text {len(others)}: taken for a grant {alarms}")
    assert right >= 0.8 * len(grants) and not confirmed_wrong and wrong <= 0.01 * len(grants) and alarms <= 0.05 * len(others)
    # calibration: the mean probability of the answers is near the share that is right
    sure = [(v[1], v[0] == f) for f, v in found]
    assert abs(sum(p for p, _ in sure) / len(sure) - sum(r for _, r in sure) / len(sure)) < 0.1


def test_empty_table_and_columns_of_any_name(spark):
    assert L.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    names = ["blocks", "sizes", "found", "_blocks", "lines", "t", "b", "i", "l", "x", "v", "vs", "us", "f", "y", "z", "a", "w"]
    docs = spark.createDataFrame([("Released under the MIT License.", *range(len(names)))], ", ".join(["text string", *(f"{n} int" for n in names)]))
    out = L.scan(docs).first()
    assert [out[n] for n in names] == list(range(len(names))) and [x.family for x in out.licences] == ["mit"]


def test_wrapped_statements(spark):
    texts, want = [], []
    for f, notices in L.NOTICES.items():
        for text, _ in notices:
            wrapped = textwrap.fill(text, 72, break_on_hyphens=False)
            texts += ["Some title\n\n\n" + wrapped + "\n\nA river runs through the town.\nIt is long.", "\n".join("# " + x for x in wrapped.split("\n"))]
            want += [(3, f), (0, f)]
    out = families(spark, [*texts, "intro\n\nThis work is licensed under the Creative Commons\nAttribution-NonCommercial 4.0 International License", "\n".join(L.OTHER)])
    for i, (at, f) in enumerate(want):
        assert [(x.paragraph, x.family, x.confirmed) for x in out[i]] == [(at, f, True)], texts[i]
    assert [(x.family, x.confirmed) for x in out[len(want)]] == [("cc-by-nc-4.0", True)] and not out[len(want) + 1]


FILLER = " ".join(f"word{i}" for i in range(440))
SEVERAL = {
    "This is not released under the MIT License.": [], "Unlike software released under the MIT License, ours is proprietary.": [], "Is the GPLv3 compatible with the Apache License 2.0?": [],
    "The code isn't licensed under the Apache License, Version 2.0.": [], "It was never distributed under the GNU General Public License, version 3.": [], "This is no longer available under the MIT License.": [],
    "Released under the MIT License. It is not released under the Apache License 2.0.": ["mit"], "You may not use this file except under the Apache License, Version 2.0.": ["apache-2.0"],
    "SPDX-License-Identifier: MIT OR Apache-2.0": ["apache-2.0", "mit"], "// SPDX-License-Identifier: (GPL-2.0-only AND BSD-3-Clause)": ["bsd-3-clause", "gpl-2.0"], "This crate is dual-licensed under MIT or Apache-2.0.": ["apache-2.0", "mit"],
    "Licensed under either of the Apache License 2.0 or the MIT License.": ["apache-2.0", "mit"], f"Released under the MIT License {FILLER}": ["mit"], f"{FILLER} released under the MIT License {FILLER}": ["mit"],
}


def test_denied_several_and_long_statements(spark):
    out = families(spark, list(SEVERAL))
    assert {t[:60]: sorted(x.family for x in out[i] if x.confirmed) for i, t in enumerate(SEVERAL)} == {t[:60]: f for t, f in SEVERAL.items()}


def test_a_notice_within_a_very_long_line(spark):
    texts = [f"{FILLER} {text} {FILLER}" for f, notices in L.NOTICES.items() for text, _ in notices]
    want = [f for f, notices in L.NOTICES.items() for _ in notices]
    out = families(spark, texts)
    found = [f in {x.family for x in out[i]} for i, f in enumerate(want)]
    print(f"notices within 880 other words found: {sum(found)} of {len(found)}")
    assert sum(found) >= 0.9 * len(found)
