"""Licence statements: a trained paragraph classifier, confirmed by templates.

A sparse logistic regression over a passage's words and word pairs tells licences,
their versions apart, from each other and from all other text; the number of words
it has never met counts too, so that prose about a licence is not taken for its
statement. It is fitted here on statements put together from the phrases below and
on sentences that only look like such, in a few thousand rows on the driver; a
temperature fitted on statements held back calibrates its probabilities, the unknown
class's among them. A prediction is confirmed where a template of that licence and
version agrees. Scanning is done in SQL expressions only.

Paragraphs end at blank lines. A paragraph's passages are its sentences, its lines
and, if it has several lines, all of it, so wrapped statements are found as well.
A passage has to have one of the ``GATES``, which every name, identifier and notice
below has; so most text is passed over by looking for these alone."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import unused

THRESHOLD, SHINGLE, SIMILAR = 0.5, 5, 0.8
UNKNOWN = "unknown"
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Classes of passages by how many of their words are new, and by their share in quarters.
NEW_WORDS, SHARES = 6, 4
#: One of these is in each name, identifier and notice, in lower case.
GATES = ["licens", "licenc", "gpl", "cc by", "cc-by", "cc0", "permission", "redistribut", "unencumbered", "endorse"]
BLANK, LEADING, SENTENCE = r"\n[ \t\r]*\n", r"^\s*", r"(?<=[.!?])\s+(?=[A-Z(])"
#: A passage of more words is looked at in windows of so many words, each beginning in the middle of the one before, so that one is hardly longer than the statement in it.
MOST_WORDS, WINDOWS = 400, (8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384)
#: Passages that deny what they name, or ask about it. What may be done only under a licence is not denied.
DENIED = r"(?i)(?:\b(?:not|never|no longer|unlike|nor|neither|rather than|instead of)|n['’]t)\s+(?:(?!except|unless|other)[\w'’-]+\s+){0,3}under\b|\?\s*$"
#: Several licences in one statement: an expression of identifiers, and two names after the same words.
EXPRESSION, OPERATOR = r"(?i)SPDX-License-Identifier:\s*([^\n*#/]+)", r"(?i)\s+(?:OR|AND|WITH)\s+"
DUAL = r"(?i)licen[sc]ed\s+under\s+(?:either\s+|both\s+)?(?:of\s+)?(?:the\s+)?((?:[A-Za-z0-9 ,+-]|\.(?=\d)){2,40}?\s+(?:or|and)\s+(?:the\s+)?(?:[A-Za-z0-9 +-]|\.(?=\d)){2,40})"

# Fixed public wording: names as statements give them, identifiers, and notices.
NAMES = {
    "mit": ["MIT License", "MIT licence", "MIT/Expat License", "Expat License", "MIT open source license"],
    "isc": ["ISC License", "ISC licence", "Internet Systems Consortium License"],
    "unlicense": ["The Unlicense", "Unlicense", "Unlicense license"],
    "zlib": ["zlib License", "zlib/libpng License"],
    "bsl-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License - Version 1.0"],
    "bsd-2-clause": ["BSD 2-Clause License", "BSD-2-Clause license", "Simplified BSD License", "two-clause BSD license"],
    "bsd-3-clause": ["BSD 3-Clause License", "BSD-3-Clause license", "New BSD License", "Modified BSD License", "three-clause BSD license"],
    "apache-1.1": ["Apache License, Version 1.1", "Apache Software License, Version 1.1", "Apache License 1.1"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache Software License, Version 2.0", "Apache License v2.0"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GNU GPL v2", "GPL-2.0 license", "GPLv2", "GNU General Public License version 2 or later"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GNU GPL v3", "GPL-3.0 license", "GPLv3", "GNU General Public License version 3 or later"],
    "lgpl-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL version 2.1", "LGPL-2.1 license", "LGPLv2.1"],
    "lgpl-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL version 3", "LGPL-3.0 license", "LGPLv3"],
    "agpl-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL version 3", "AGPL-3.0 license", "AGPLv3"],
    "mpl-1.1": ["Mozilla Public License Version 1.1", "Mozilla Public License, v. 1.1", "MPL-1.1 license", "Mozilla Public License 1.1"],
    "mpl-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "MPL-2.0 license", "Mozilla Public License 2.0"],
    "epl-1.0": ["Eclipse Public License v1.0", "Eclipse Public License, Version 1.0", "Eclipse Public License 1.0"],
    "epl-2.0": ["Eclipse Public License v2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"],
    "cc-by-4.0": ["CC BY 4.0", "CC-BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 license"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 license"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0 license"],
    "cc-by-nd-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-nc-sa-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc0-1.0": ["CC0 1.0 Universal", "CC0 1.0 Public Domain Dedication", "CC0 1.0 Universal Public Domain Dedication", "CC0 1.0 license"],
}
IDENTIFIERS = {
    "mit": ["MIT"], "isc": ["ISC"], "unlicense": ["Unlicense"], "zlib": ["Zlib"], "bsl-1.0": ["BSL-1.0"], "bsd-2-clause": ["BSD-2-Clause"], "bsd-3-clause": ["BSD-3-Clause"],
    "apache-1.1": ["Apache-1.1"], "apache-2.0": ["Apache-2.0"], "gpl-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"], "gpl-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "lgpl-2.1": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"], "lgpl-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"], "agpl-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "mpl-1.1": ["MPL-1.1"], "mpl-2.0": ["MPL-2.0"], "epl-1.0": ["EPL-1.0"], "epl-2.0": ["EPL-2.0"], "cc-by-4.0": ["CC-BY-4.0"], "cc-by-sa-4.0": ["CC-BY-SA-4.0"], "cc-by-nc-4.0": ["CC-BY-NC-4.0"],
    "cc-by-nd-4.0": ["CC-BY-ND-4.0"], "cc-by-nc-sa-4.0": ["CC-BY-NC-SA-4.0"], "cc0-1.0": ["CC0-1.0"],
}
GPL_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
CC_NOTICE = "This work is licensed under a Creative Commons {} 4.0 International License."
BSD_NOTICE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_TWO = BSD_NOTICE + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THREE = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
APACHE_FIVE = " 3. The end-user documentation included with the redistribution, if any, must include the following acknowledgment: This product includes software developed by the Apache Software Foundation."
MPL_OLD = "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"
EPL_NOTICE = "This program and the accompanying materials are made available under the terms of the Eclipse Public License {} which accompanies this distribution"
#: Notices in full, each with the phrases that its version hangs on.
NOTICES = {
    "mit": [("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["deal in the software without restriction"])],
    "isc": [("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["with or without fee"])],
    "unlicense": [("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ["free and unencumbered software"])],
    "zlib": [("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ["alter it and redistribute it freely"])],
    "bsl-1.0": [("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software", ["person or organization obtaining"]), ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", ["boost software license version 1.0"])],
    "bsd-2-clause": [(BSD_TWO, ["redistributions in binary form"])],
    "bsd-3-clause": [(BSD_TWO + BSD_THREE, ["endorse or promote products"]), (BSD_THREE, ["endorse or promote products"])],
    "apache-1.1": [(BSD_TWO + APACHE_FIVE, ["developed by the apache software foundation"])],
    "apache-2.0": [("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["license-2.0"])],
    "gpl-2.0": [(GPL_NOTICE.format("General Public License", "2"), ["either version 2 of the license", "gnu general public license"])],
    "gpl-3.0": [(GPL_NOTICE.format("General Public License", "3"), ["either version 3 of the license", "gnu general public license"])],
    "lgpl-2.1": [(GPL_NOTICE.format("Lesser General Public License", "2.1"), ["either version 2.1 of the license", "lesser general public license"])],
    "lgpl-3.0": [(GPL_NOTICE.format("Lesser General Public License", "3"), ["either version 3 of the license", "lesser general public license"])],
    "agpl-3.0": [(GPL_NOTICE.format("Affero General Public License", "3"), ["either version 3 of the license", "affero general public license"])],
    "mpl-1.1": [(MPL_OLD, ["mozilla public license version 1.1"])],
    "mpl-2.0": [("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ["mozilla public license v 2.0"])],
    "epl-1.0": [(EPL_NOTICE.format("v1.0"), ["eclipse public license v1.0"])],
    "epl-2.0": [(EPL_NOTICE.format("2.0"), ["eclipse public license 2.0"])],
    "cc-by-4.0": [(CC_NOTICE.format("Attribution"), ["commons attribution 4.0"])],
    "cc-by-sa-4.0": [(CC_NOTICE.format("Attribution-ShareAlike"), ["attribution-sharealike 4.0"])],
    "cc-by-nc-4.0": [(CC_NOTICE.format("Attribution-NonCommercial"), ["attribution-noncommercial 4.0"])],
    "cc-by-nd-4.0": [(CC_NOTICE.format("Attribution-NoDerivatives"), ["attribution-noderivatives 4.0"])],
    "cc-by-nc-sa-4.0": [(CC_NOTICE.format("Attribution-NonCommercial-ShareAlike"), ["attribution-noncommercial-sharealike 4.0"])],
    "cc0-1.0": [("To the extent possible under law, the authors have waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.", ["cc0 1.0"])],
}
LEADS = ["Released under the", "Licensed under the", "Licensed under", "This work is licensed under the", "This project is licensed under the terms of the", "Distributed under the", "Published under the", "Available under the", "Made available under the terms of the", "Code is provided under the", "License:", "This software is free under the terms of the", "is released under the", "is distributed under", "Subject to the terms of the", "You can redistribute it under the", "This package may be used under the", "Use of this code is governed by the", "The source is covered by the", "open source under the", "Everything in this folder is under the", "It may be copied under the", "License for this file: the"]
TAILS = ["", "", "See the LICENSE file for details.", "Copyright 2020 the authors.", "All rights reserved.", "A copy is included in this repository."]
#: Ways to speak of a licence without a grant; {} is its name.
MENTIONS = ["The {} debate continues among", "Critics say that the {} is", "Unlike the {}, this contract", "He wrote a history of the {} and", "A comparison of the {} with other terms shows", "Lawyers disagree on the {} in", "The company refused the {} for its", "It is not compatible with the {} because", "Many people confuse the {} with", "Her talk on the {} was", "a study about the {} found", "before the {} was written", "the authors of the {} met in", "this code was never under the {} and"]
#: Licences that are none of the above, or of no stated version.
FOREIGN = ["Foo License, version 9", "Acme Software License", "Public License of the city", "General Public License", "GNU General Public License", "GNU GPL", "GNU General Public License, version 1", "GPL version 7", "Apache License", "Apache License, Version 1.0", "Apache License, Version 3.0", "Mozilla Public License", "Mozilla Public License Version 1.0", "Mozilla Public License, v. 3.0", "Eclipse Public License", "BSD license", "BSD 4-Clause License", "LGPL", "GNU Lesser General Public License", "GNU Lesser General Public License, version 2", "AGPL", "GNU Affero General Public License, version 1", "Creative Commons license", "CC BY 3.0", "CC BY-SA 3.0", "CC BY-NC 2.5", "Creative Commons Attribution 3.0 Unported License", "Creative Commons Attribution-ShareAlike 3.0 license", "Artistic License 2.0", "Microsoft Public License", "European Union Public Licence 1.2", "Business Source License 1.1", "proprietary license of the vendor", "terms of the agreement with the customer", "SIL Open Font License 1.1", "Python Software Foundation License", "Common Development and Distribution License 1.0"]
OTHER = [
    "All rights reserved.", "He lost his driving licence in March.", "The license plate of the car was red and white.", "A fishing license is sold at the counter.", "The general public was invited to the opening.",
    "Version 3 of the plan was published under protest.", "Version 2.0 of the report is available under the menu.", "Apache helicopters flew over the valley.", "Researchers at MIT released a study on sleep.", "The software is free for students.",
    "Permission was granted by the city to any person with a ticket.", "The terms of the contract were made available to the public.", "See the file for details.", "The foundation published its yearly report.", "The creative team shares common goals.",
    "Copyright law was changed in 1998.", "This work is the result of four years of study.", "Released prisoners returned to the town.", "The band released its third album under a new name.", "Distributed systems fail in parts.",
    "The mozilla team met in public.", "Redistribution of wealth was the main subject.", "Conditions are met when the pressure drops.", "Attribution of the painting is disputed.", "International flights leave at 4.0 per hour.",
    "The GNU is a large antelope.", "He added a clause to the new contract.", "The universal remote has 1.0 volts.", "The public domain of the function is the real line.", "Commercial use of the hall is not permitted.",
    "This is the source of the river.", "The code of the door is known to the staff.", "She is licensed to practise medicine in two states.", "The shop is licensed for the sale of wine.", "The license of the radio station was renewed.",
    "MIT researchers said the study was published under a false name.", "MIT students released the results under the terms of a grant.", "The report of MIT was published under embargo.", "Eclipse watchers met in public.", "A boost in sales of 2.0 percent was reported.",
    "A restaurant license costs more than a shop license in this town.", "The software license market grew by 3.0 percent.", "The team at Apache released version 2.0 of its server.", "Commons debates are published the next day.", "He works at the Free Software Foundation.",
    "Permission to use the pool is hereby refused to all children.", "You may obtain a copy of the report at the office.", "This file is subject to change without notice.", "The contents of this box are subject to customs.", "Modification of the building was not permitted.",
    "Mit dem Auto und der Bahn.", "Er kam mit einem Freund.", "Die Arbeit wurde mit Erfolg beendet und unter dem Namen gedruckt.", "Der Vertrag ist unter der Nummer 2.0 zu finden.", "Le livre est sous licence depuis mars.", "La licencia de pesca se vende en la tienda.",
]
#: Ordinary words that statements have too, mixed into the text that is none.
COMMON = "mit und as or one may copy copies files file authors 2020 1.0 1.1 2.0 2.1 3.0 4.0 2 3 1 without with under version deal except program documentation associated binary obtain obtaining compliance conditions following provided permitted source form subject terms either modify forms person charge free details see use public general open international released software distributed published available made code work project this the is of to a and in it its any rights copyright notice must reproduce materials list"


@dataclass(frozen=True)
class Classifier:
    families: tuple[str, ...]  # the last one is UNKNOWN
    bias: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]  # by word, pair of words or class of new words
    vocabulary: tuple[str, ...]  # words that are not new
    temperature: float
    templates: dict[str, tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]]  # (shingles, phrases needed) of each statement of a family


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams(w: list[str]) -> set[str]:
    return {*w, *(" ".join(p) for p in zip(w, w[1:], strict=False))}


def novelty(w: list[str], vocabulary: set[str]) -> list[str]:
    """The classes of new words: how many, and what share."""
    n = sum(x not in vocabulary for x in w)
    return [f"<new {min(n, NEW_WORDS)}>", f"<share {n * SHARES // max(len(w), 1)}>"]


def shingles(w: list[str], size: int = SHINGLE) -> tuple[str, ...]:
    return tuple(dict.fromkeys(" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))))


def made_up(rnd: random.Random, n: int) -> str:
    """Words that no vocabulary has."""
    return " ".join("".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 4))) + rnd.choice("xqjw") for _ in range(n))


def statements(seed: int = 1, leads=LEADS, tails=TAILS, mentions=MENTIONS, other=OTHER, repeat: int = 1) -> list[tuple[str, str]]:
    """(family, text): phrases put together, notices with words left out or cut short, and text that is neither."""
    rnd, out = random.Random(seed), []
    for _ in range(repeat):
        for family, names in NAMES.items():
            for name in names:
                out += [(family, f"{made_up(rnd, rnd.choice([0, 0, 0, 1, 2, 3]))} {lead} {name}. {rnd.choice(tails)}".strip()) for lead in leads]
                out += [(family, f"{made_up(rnd, rnd.randrange(1, 4))} {rnd.choice(['under', 'under the'])} {name}. {made_up(rnd, rnd.choice([0, 0, 2]))}") for _ in range(3)]
                out += [(family, f"{name}. {tail}") for tail in tails[1:]] + [(family, name)]
                out += [(UNKNOWN, f"{made_up(rnd, rnd.randrange(0, 4))} {m.format(name)} {made_up(rnd, rnd.randrange(2, 7))}") for m in rnd.sample(mentions, min(6, len(mentions)))]
                out += [(UNKNOWN, f"{made_up(rnd, rnd.randrange(1, 5))} {rnd.choice(['the', 'of the', 'about the', 'on the', 'to the', 'and the', 'that the'])} {name} {made_up(rnd, rnd.randrange(1, 6))}") for _ in range(4)]
                out += [(UNKNOWN, f"{rnd.choice(mentions).format(name)} {rnd.choice(other).lower()}"), (UNKNOWN, f"{made_up(rnd, rnd.randrange(5, 14))} {name} {made_up(rnd, rnd.randrange(3, 9))}")]
            for x in IDENTIFIERS[family]:
                out += [(family, f"{start} {x}") for start in ("SPDX-License-Identifier:", "License:", "license", f"{made_up(rnd, 1)} SPDX-License-Identifier:") for _ in range(3)]
            for text, _ in NOTICES[family]:
                w = text.split()
                out += [(family, " ".join(x for x in w if rnd.random() > 0.06)) for _ in range(12)]
                out += [(family, f"{text} {made_up(rnd, rnd.randrange(0, 5))}") for _ in range(8)]
        for name in FOREIGN:
            out += [(UNKNOWN, f"{made_up(rnd, rnd.choice([0, 0, 1, 2]))} {lead} {name}. {rnd.choice(tails)}".strip()) for lead in rnd.sample(leads, min(8, len(leads)))]
            out += [(UNKNOWN, name), (UNKNOWN, f"SPDX-License-Identifier: {name.split()[0]}-{rnd.randrange(5, 9)}.{rnd.randrange(5, 9)}")]
        out += [(UNKNOWN, text) for text in other for _ in range(6)]
        vocabulary = sorted({w for text in (*other, COMMON, *leads) for w in words(text)})
        out += [(UNKNOWN, " ".join(rnd.choices(vocabulary, k=rnd.randrange(2, 40)))) for _ in range(300)]
        out += [(UNKNOWN, " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 12))) + " " + made_up(rnd, rnd.randrange(1, 12))) for _ in range(300)]
        out += [(UNKNOWN, f"{rnd.choice(leads)} {made_up(rnd, rnd.randrange(1, 5))}") for _ in range(200)]
    rnd.shuffle(out)
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache(maxsize=2)
def train(seed: int = 1, steps: int = 250, sparse: float = 2e-4, least: int = 3) -> Classifier:
    """Multinomial logistic regression by proximal gradient steps; ``sparse`` sets weights of little use to zero."""
    rows = statements(seed)
    families = (*NAMES, UNKNOWN)
    held = np.arange(len(rows)) % 5 == 0
    count: dict[str, int] = {}
    for (_, text), h in zip(rows, held, strict=True):
        for g in grams(words(text)) if not h else ():
            count[g] = count.get(g, 0) + 1
    known = sorted(g for g, n in count.items() if n >= least)
    vocabulary = {g for g in known if " " not in g}
    index = {g: i for i, g in enumerate([*known, *(f"<new {i}>" for i in range(NEW_WORDS + 1)), *(f"<share {i}>" for i in range(SHARES + 1))])}
    x = np.zeros((len(rows), len(index) + 1), np.float32)
    x[:, -1] = 1
    for i, (_, text) in enumerate(rows):
        w = words(text)
        x[i, [index[g] for g in (*grams(w), *novelty(w, vocabulary)) if g in index]] = 1
    y = np.eye(len(families), dtype=np.float32)[[families.index(f) for f, _ in rows]]
    w, before = (np.zeros((x.shape[1], len(families)), np.float32) for _ in range(2))
    own, want = x[~held], y[~held]
    v = np.ones(own.shape[1], np.float32)
    for _ in range(20):  # the largest singular value, by powers
        v = own.T @ (own @ v)
        norm = float(np.linalg.norm(v))
        v /= norm
    rate = 3 / norm * len(own)
    for step in range(steps):
        look = w + step / (step + 3) * (w - before)
        grad = own.T @ (softmax(own @ look) - want) / len(own)
        before, w = w, look - rate * grad
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * sparse, 0)
    out = (x[held] @ w).astype(np.float64)
    temperatures = np.geomspace(0.2, 5, 60)
    losses = [-np.log(np.maximum((softmax(out / t) * y[held]).sum(axis=1), 1e-12)).mean() for t in temperatures]
    temperature = float(temperatures[int(np.argmin(losses))])
    used = {g: tuple(np.round(w[i].astype(float), 4).tolist()) for g, i in index.items() if np.any(np.round(w[i], 4))}
    bias = tuple(np.round(w[-1].astype(float), 4).tolist())
    return Classifier(families, bias, used, tuple(sorted(vocabulary)), temperature, templates())


def templates() -> dict:
    """Per family: names and identifiers, which must be there as they are, and notices, of which most must be, and their own phrases."""
    out = {}
    for f in NAMES:
        phrases = [" ".join(words(n)) for n in NAMES[f]]
        phrases += [f"{lead} {x.lower()}" for x in IDENTIFIERS[f] for lead in ("spdx-license-identifier", "license")]
        long = [(shingles(words(text)), tuple(" ".join(words(p)) for p in needed)) for text, needed in NOTICES[f]]
        out[f] = tuple(dict.fromkeys(((p,), (p,)) for p in phrases)) + tuple(long)
    return out


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array(values) -> str:
    return f"array({', '.join(values)})"


def named(expression: str, name: str, then: str) -> str:
    """SQL for ``then``, in which ``name`` stands for the expression, which is evaluated once."""
    return f"transform(array({expression}), {name} -> {then})[0]"


def gated(lower: str) -> str:
    """SQL for whether lower-cased text has any of the gates."""
    return "(" + " or ".join(f"contains({lower}, {quoted(g)})" for g in GATES) + ")"


def verdict(p: str, c: Classifier) -> str:
    """SQL for (family, probability, similarity, confirmed) of a passage; family is the unknown one where none reaches THRESHOLD."""
    keys = array(quoted(g) for g in c.weights)
    values = array(array(f"{v}D" for v in row) for row in c.weights.values())
    start = array(f"{b}D" for b in c.bias)
    struct = lambda t: f"named_struct('s', {array(quoted(s) for s in t[0])}, 'n', {array(quoted(n) for n in t[1])})"
    known = ", ".join(f"{quoted(f)}, {array(struct(t) for t in ts)}" for f, ts in c.templates.items())
    families = array(quoted(f) for f in c.families)
    new = f"size(filter(a.w, x -> not array_contains({array(quoted(v) for v in c.vocabulary)}, x)))"
    classes = named(new, "n", f"array(concat('<new ', least(n, {NEW_WORDS}), '>'), concat('<share ', n * {SHARES} div greatest(size(a.w), 1), '>'))")
    pairs = "transform(slice(a.w, 2, greatest(size(a.w) - 1, 0)), (x, i) -> concat(a.w[i], ' ', x))"
    add = f"(t, g) -> coalesce(zip_with(t, element_at(map_from_arrays({keys}, {values}), g), (u, v) -> u + v), t)"
    own = f"transform(sequence(1, greatest(size(f.w) - {SHINGLE - 1}, 1)), i -> array_join(slice(f.w, i, {SHINGLE}), ' '))"
    there = "forall(t.n, n -> contains(concat(' ', array_join(f.w, ' '), ' '), concat(' ', n, ' ')))"
    similar = named(own, "o", f"array_max(transform(element_at(map({known}), f.family), t -> if({there}, if(size(t.s) = 1, 1D, size(array_intersect(t.s, o)) / cast(size(t.s) as double)), 0D)))")
    steps = (
        ("a", f"named_struct('w', regexp_extract_all(lower({p}), {quoted('(' + WORD + ')')}, 1))"),
        ("b", f"named_struct('w', a.w, 'g', array_distinct(concat(a.w, {pairs}, {classes})))"),
        ("d", f"named_struct('w', b.w, 's', aggregate(b.g, {start}, {add}))"),
        ("e", f"named_struct('w', d.w, 'sum', aggregate(d.s, 0D, (t, v) -> t + exp((v - array_max(d.s)) / {c.temperature}D)), 'at', cast(array_position(d.s, array_max(d.s)) as int))"),
        ("f", f"named_struct('w', e.w, 'family', if(1 / e.sum >= {THRESHOLD}D, {families}[e.at - 1], {quoted(UNKNOWN)}), 'probability', 1 / e.sum)"),
        ("h", f"named_struct('family', f.family, 'probability', f.probability, 'similarity', coalesce({similar}, 0D))"),
    )
    out = f"named_struct('family', h.family, 'probability', h.probability, 'similarity', h.similarity, 'confirmed', h.similarity >= {SIMILAR}D)"
    for name, step in reversed(steps):
        out = named(step, name, out)
    return out


def scan(docs: DataFrame, text_col: str = "text", classifier: Classifier | None = None) -> DataFrame:
    """``docs`` with a column licences: an array of (paragraph, family, probability, similarity, confirmed).

    A paragraph has the number of its first line, counted from 0. Of its passages that
    name one family, the one that is confirmed or else most probable counts; what is not
    confirmed counts only in a paragraph in which nothing is. Null and empty texts, and
    texts without any gate, have no licences; texts of any length are taken whole. A passage
    that denies or asks about a licence names none; of an expression of several, each is named. Rows
    that repeat are treated alike. All other columns stay, whatever their names, but
    licences is replaced."""
    c = classifier or train()
    keep = [x for x in docs.columns if x != "licences"]
    blocks_col, lines_col, found_col = unused(docs, "blocks", "sizes", "found")
    text = f"`{text_col}`"
    has = named(f"lower({text})", "t", gated("t"))
    blocks = f"split({text}, {quoted(BLANK)})"
    first = docs.select(*(f"`{x}`" for x in keep), F.expr(f"if({has}, {blocks}, null)").alias(blocks_col))
    first = first.withColumn(lines_col, F.expr(f"if({blocks_col} is null, null, transform({blocks_col}, b -> size(split(b, '\\n'))))"))
    # a blank line stands between two paragraphs; further ones begin the second
    line = f"aggregate(slice({lines_col}, 1, i), 0, (t, n) -> t + n + 1) + size(split(regexp_extract(b, {quoted(LEADING)}, 0), '\\n')) - 1"
    sentences = f"flatten(transform(l, x -> split(x, {quoted(SENTENCE)})))"
    parts = f"filter(flatten(transform(concat(regexp_extract_all(x, {quoted(EXPRESSION)}, 1), regexp_extract_all(x, {quoted(DUAL)}, 1)), e -> split(regexp_replace(e, '[()]', ' '), {quoted(OPERATOR)}))), y -> size(split(x, {quoted(OPERATOR)})) > 1)"
    several = f"flatten(transform(filter(l, x -> not rlike(x, {quoted(DENIED)})), x -> transform({parts}, y -> concat('SPDX-License-Identifier: ', regexp_replace(trim(y), '(?i)^the ', '')))))"
    windows = named("split(trim(x), '\\\\s+')", "ws", f"flatten(transform(array({', '.join(map(str, WINDOWS))}), n -> transform(sequence(0, greatest(0, (size(ws) - 1) div (n div 2))), j -> array_join(slice(ws, j * (n div 2) + 1, n), ' '))))")
    passages = named("split(b, '\\n')", "l", f"array_distinct(concat(if(size(l) > 1, array(b), slice(l, 1, 0)), l, {sentences}, {several}))")
    asked = lambda xs: f"filter({xs}, x -> {gated('lower(x)')} and not rlike(x, {quoted(DENIED)}))"
    count = f"size(regexp_extract_all(lower(x), {quoted('(' + WORD + ')')}, 1))"
    gates = asked(f"flatten(transform({asked(passages)}, x -> if({count} <= {MOST_WORDS}, array(x), {windows})))")
    known = f"filter(transform({gates}, x -> {verdict('x', c)}), v -> v.family <> {quoted(UNKNOWN)})"
    sure = "if(exists(vs, v -> v.confirmed), filter(vs, v -> v.confirmed), vs)"
    best = "array_max(transform(filter(us, u -> u.family = f), u -> named_struct('p', u.probability, 's', u.similarity, 'c', u.confirmed)))"
    row = f"named_struct('paragraph', {{line}}, 'family', f, 'probability', {best}.p, 'similarity', {best}.s, 'confirmed', {best}.c)"
    per_block = named(known, "vs", named(sure, "us", f"transform(array_sort(array_distinct(transform(us, u -> u.family))), f -> {row.format(line='z')})"))
    all_blocks = f"flatten(transform(filter(transform({blocks_col}, (b, i) -> named_struct('b', b, 'z', if({gated('lower(b)')}, {line}, null))), y -> y.z is not null), y -> {named('y.z', 'z', named('y.b', 'b', per_block))}))"
    kind = "array<struct<paragraph:int,family:string,probability:double,similarity:double,confirmed:boolean>>"
    return first.select(*(f"`{x}`" for x in keep), F.expr(f"coalesce(if(size({blocks_col}) > 0, {all_blocks}, null), cast(array() as {kind}))").alias("licences"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = lambda test: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("licences", test), lambda x: x["family"]))), ",")
    probability = F.round(F.array_max(F.transform("licences", lambda x: x["probability"])), 6)
    return out.select("doc_id", F.size("licences").cast("bigint").alias("n_statements"), names(lambda x: F.lit(True)).alias("families"), names(lambda x: x["confirmed"]).alias("confirmed"), probability.alias("probability"))


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLE: dict[str, str] = {}
