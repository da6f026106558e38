"""Licence scans: a trained paragraph classifier, confirmed by templates.

Units are paragraphs, which blank lines and lines of signs alone separate; comment marks are no words. A longer
paragraph is cut into overlapping windows that run across line ends. The lines of a paragraph are looked at one by
one as well, so that several notices in it are told apart. A unit's features are its hashed words and word pairs. One
logistic regression tells licence notices from other text, and one per family tells the families apart; all are fitted
on notices made from the templates (whole, cut, framed and with other text around) and on other text, of the corpus and
with words of notices in another sense, and calibrated on wordings that were held out. A notice is of a family if its
calibrated probability is high enough and a template of the family shares enough word pairs with it; otherwise, if it
speaks like a notice, it is ``unknown``. The words that hold those pairs are where the notice stands: of two families in one place the one with more pairs counts, and
hits that touch are one notice.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardmap.llm import arrays, logistic
from wardmap.llm.keys import ROW_HASH, ROW_ID, keyed, type_of

WINDOW, STEP = 40, 20
BITS = 18
#: Paragraphs of other text that the classifier is fitted on, one per document.
SAMPLE = 1500
#: Least probability of a notice that a template confirms, and of one that names no known family.
LEAST_NOTICE, LEAST_UNKNOWN = 0.05, 0.7
LEAST_FAMILY, LEAST_SHARED = 0.5, 0.5
#: Word pairs that a template must share at least, if it has so many.
LEAST_PAIRS = 3
#: Word pairs of usual phrases that a notice of an unknown licence has at least.
LEAST_GENERIC = 2
#: Units of up to so many words are read as a whole.
SHORT = 8
SEED = 11

# Usual notices by family.
NOTICES = {
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3",
             "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "Apache": ["Licensed under the Apache License, Version 2.0",
               "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0",
               "SPDX-License-Identifier: Apache-2.0"],
    "BSD": ["Released under the BSD 3-Clause License", "Licensed under the BSD license",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSL": ["Distributed under the Boost Software License, Version 1.0",
            "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
            "and accompanying documentation covered by this license", "SPDX-License-Identifier: BSL-1.0"],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 "
              "International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons "
                 "Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-NC-ND": ["Licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons "
                    "Attribution-NonCommercial-NoDerivatives 4.0 International License",
                    "SPDX-License-Identifier: CC-BY-NC-ND-4.0"],
    "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons "
                    "Attribution-NonCommercial-ShareAlike 4.0 International License",
                    "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons "
                 "Attribution-NoDerivatives 4.0 International License", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons "
                 "Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work",
            "Released under CC0 1.0 Universal", "This work is dedicated to the public domain",
            "This is free and unencumbered software released into the public domain"],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public "
            "License 2.0", "Licensed under the Eclipse Public License"],
    "EUPL": ["Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission",
             "Licensed under the European Union Public Licence", "SPDX-License-Identifier: EUPL-1.2"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3",
            "Licensed under the GPL version 2", "it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation, either version 3 of the License, or any later version",
            "SPDX-License-Identifier: GPL-3.0-or-later"],
    "ISC": ["Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any "
            "purpose with or without fee is hereby granted, provided that the above copyright notice and this "
            "permission notice appear in all copies", "SPDX-License-Identifier: ISC"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1",
             "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
             "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT license",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction",
            "SPDX-License-Identifier: MIT"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
            "Licensed under the Mozilla Public License", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved. No part of this work may be reproduced without the written permission of the "
                    "publisher", "Copyright, all rights reserved", "All rights reserved.",
                    "© 2020 Example Corp. All rights reserved.", "Copyright (c) 2019 The Example Company. All rights reserved.",
                    "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.",
                    "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited"],
}
# Names of licences, in the languages they are given in.
NAMES = {
    "AGPL": ["GNU Affero General Public License, Version 3", "AGPL Version 3"],
    "Apache": ["Apache License, Version 2.0", "Apache-Lizenz, Version 2.0", "Apache 2.0"],
    "BSD": ["BSD-3-Clause License", "BSD-Lizenz", "BSD"],
    "BSL": ["Boost Software License, Version 1.0"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International", "Creative Commons Namensnennung 4.0 International",
              "Creative Commons Reconocimiento 4.0 Internacional"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Namensnennung - Nicht kommerziell 4.0 International",
                 "Creative Commons Attribution - Pas d'Utilisation Commerciale 4.0 International",
                 "Creative Commons Reconocimiento-NoComercial 4.0 Internacional"],
    "CC-BY-NC-ND": ["CC BY-NC-ND 4.0", "Creative Commons Namensnennung - Nicht kommerziell - Keine Bearbeitungen 4.0 International",
                    "Creative Commons Attribution - Pas d'Utilisation Commerciale - Pas de Modification 4.0 International",
                    "Creative Commons Reconocimiento-NoComercial-SinObraDerivada 4.0 Internacional"],
    "CC-BY-NC-SA": ["CC BY-NC-SA 4.0",
                    "Creative Commons Namensnennung - Nicht kommerziell - Weitergabe unter gleichen Bedingungen 4.0 International",
                    "Creative Commons Attribution - Pas d'Utilisation Commerciale - Partage dans les Mêmes Conditions 4.0 "
                    "International", "Creative Commons Reconocimiento-NoComercial-CompartirIgual 4.0 Internacional"],
    "CC-BY-ND": ["CC BY-ND 4.0", "Creative Commons Namensnennung - Keine Bearbeitungen 4.0 International",
                 "Creative Commons Attribution - Pas de Modification 4.0 International",
                 "Creative Commons Reconocimiento-SinObraDerivada 4.0 Internacional"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Namensnennung - Weitergabe unter gleichen Bedingungen 4.0 International",
                 "Creative Commons Attribution - Partage dans les Mêmes Conditions 4.0 International",
                 "Creative Commons Reconocimiento-CompartirIgual 4.0 Internacional"],
    "CC0": ["CC0 1.0 Universal"],
    "EPL": ["Eclipse Public License 2.0"],
    "EUPL": ["EUPL, Version 1.2", "European Union Public Licence"],
    "GPL": ["GNU General Public License, Version 3", "GPL Version 2"],
    "ISC": ["ISC License"],
    "LGPL": ["GNU Lesser General Public License, Version 2.1", "LGPL Version 3"],
    "MIT": ["MIT License", "MIT-Lizenz", "MIT"],
    "MPL": ["Mozilla Public License, Version 2.0", "MPL 2.0"],
}
# How notices name a licence, in four languages.
PHRASES = [
    "Licensed under the {}", "Released under the {}", "Distributed under the terms of the {}", "Lizenziert unter der {}",
    "Dieses Werk ist unter der {} lizenziert", "Veröffentlicht unter der {}", "Publié sous la licence {}",
    "Cette œuvre est mise à disposition selon les termes de la licence {}", "Publicado bajo la licencia {}",
    "Esta obra está bajo una licencia {}",
]
#: Words that names of several licences have in common.
COMMON_WORDS = frozenset("license licence lizenz version public general software international internacional 0 1 2 3 4 v".split())


def wordings(family: str) -> list[tuple[str, frozenset[str]]]:
    """The family's notices, and its names in the usual phrases with the words that tell the licence."""
    named = [(phrase.format(name), frozenset(words_of(name)) - COMMON_WORDS)
             for name in NAMES.get(family, ()) for phrase in PHRASES]
    return [(notice, frozenset()) for notice in NOTICES[family]] + named


def words_of(text: str) -> list[str]:
    """Words in lower case, without the signs and letters beyond ASCII that are glued to others."""
    found = re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", text.lower())
    return [re.sub(r"[^\x00-\x7f]+", "", w) or w for w in found]


#: By family: word pairs of each wording, and the words of which a shared pair must hold one (none: any will do).
TEMPLATES = {family: [(frozenset(zip(words := words_of(text), words[1:], strict=False)), telling)
                      for text, telling in wordings(family)] for family in NOTICES}
UNKNOWN = "unknown"
#: Notices of no family above, for the class of unknown ones.
OTHERS = ["Licensed under the Example Community License, version 1", "Released under the Sample Software Licence",
          "This work is licensed under the terms of its own license agreement",
          "Use of this text is subject to the license terms of the provider", "Distributed under a custom license",
          "The license of this file can be found in the accompanying LICENSE file",
          "Lizenziert unter der Beispiel-Lizenz, Version 2", "Dieses Werk steht unter der Lizenz der Gemeinde",
          "Publié sous la licence Exemple", "Cette œuvre est publiée sous licence libre de la ville",
          "Publicado bajo la licencia Ejemplo", "Esta obra está bajo una licencia propia"]
#: Pairs of words of which a notice of no known family has some.
USUAL = ["Released under the license", "under the terms of the", "Lizenziert unter der", "unter der Lizenz", "sous licence",
         "sous la licence", "bajo la licencia", "bajo una licencia"]
GENERIC = frozenset(p for text in [*OTHERS, *USUAL] for p in zip(words_of(text), words_of(text)[1:], strict=False))
#: Other text that is there whatever the corpus holds; much of it has words of notices in another sense.
PLAIN = ["The weather was fine and we went for a walk along the river", "She opened the door and looked at the garden",
         "Prices rose by two per cent in the first quarter of the year", "This is a text about the history of the town",
         "Der Zug kam mit Verspätung an und wir gingen zu Fuß nach Hause", "La ville se trouve au bord de la mer",
         "El libro cuenta la historia de una familia del norte", "In no other part of the work may these words appear",
         "He lost his driver's license and had to walk to work", "A fishing license is needed to fish in the lake",
         "The doctor was granted a license to practise medicine in the state", "They were released under the new law last week",
         "The bar applied for a liquor license under the city rules",
         "The band released the album under a new label", "Two prisoners were released under the terms of the agreement",
         "The hunting license is valid under state law for a year", "Taxi drivers must be licensed by the city council",
         "Her license plate was found under the bridge near the public garden", "The court ruled on the copyright of the song",
         "The general told the public that the version was wrong", "Students of the Massachusetts institute released a report",
         "The apache people lived in the south west of the country", "The creative use of common words made the poem famous",
         "Permission was granted to build a house on the land", "The software was sold without warranty of any kind",
         "The right to vote was reserved for men until the war", "The tickets were distributed under the trees at noon",
         "The film is based on a public domain novel of the last century",
         "Der Führerschein wurde ihm unter strengen Auflagen zurückgegeben", "Le permis de conduire a été délivré sous conditions",
         "Obtuvo la licencia de conducir bajo la nueva ley", "Die Lizenz zum Töten ist ein Film der Reihe"]
FRAMES = ["", "This text is ", "The file is ", "Note: ", "Dieses Werk: ", "Cette œuvre : ", "Este texto: "]
#: Units that may be notices are not taken as examples of other text.
DOUBTFUL = re.compile(r"(?i)licen[cs]e|copyright|copyleft|rights reserved|public domain|released under|spdx|creative")


#: Words that comments begin their lines with.
MARKS = ["dnl", "rem"]
#: A licence is called by a name, not only "the license".
NAMED = re.compile(
    r"(?i)\b(?!(?:the|this|that|these|an?|of|your|its|or|and|such|under|any|said|same|above|following)\b)\w[\w.-]*\s+"
    r"licen[cs]e\b")


class Model(NamedTuple):
    """Weights of notices; the columns of the word pairs that wordings have; the weights of the families
    (``families[i]`` for column ``columns[i]``, 0 for others); and bias, slope and shift of notices and of each family."""

    notice: np.ndarray
    pairs: np.ndarray
    columns: np.ndarray
    families: np.ndarray
    bias: np.ndarray
    slope: np.ndarray
    shift: np.ndarray


def word_columns(texts: arrays.Texts) -> tuple[arrays.Spans, np.ndarray, np.ndarray]:
    """Words, and the columns of each word and of each pair of words (the first and the next of one text)."""
    spans = arrays.find_spans(texts, arrays.ALPHANUMERIC)
    hashes = arrays.span_hashes(texts, spans, arrays.LOWERED)
    _, marks = next(arrays.text_slices(pa.array(MARKS)))
    mark = np.isin(hashes, arrays.span_hashes(marks, arrays.find_spans(marks, arrays.ALPHANUMERIC)))
    if mark.any():
        lines = np.searchsorted(spans.starts, arrays.find_lines(texts).starts)
        leading = np.zeros(len(mark) + 1, bool)
        leading[lines] = True
        keep = ~(mark & leading[:-1])
        starts = spans.starts[keep]
        spans = arrays.Spans(starts, spans.ends[keep], np.searchsorted(starts, texts.offsets))
        hashes = hashes[keep]
    shift = np.uint64(64 - BITS)
    return (spans, (arrays.gram_hashes(hashes, 1) >> shift).astype(np.int64),
            (arrays.gram_hashes(hashes, 2) >> shift).astype(np.int64))


def sparse(units: list[str]) -> logistic.Sparse:
    """Feature rows of short texts."""
    columns, counts = [], []
    for unit in units:
        _, texts = next(arrays.text_slices(pa.array([unit])))
        _, one, two = word_columns(texts)
        columns.append(np.unique(np.concatenate([one, two])))
        counts.append(len(columns[-1]))
    joined = np.concatenate(columns) if columns else np.zeros(0, np.int64)
    return logistic.Sparse(joined, np.ones(len(joined)), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))


def examples(other: list[str]) -> tuple[list[str], list[str | None], list[str]]:
    """Notices made from the wordings with their family, and other text with None; and what each is made from."""
    rng = random.Random(SEED)
    texts: list[str] = [*other, *PLAIN * 4]
    families: list[str | None] = [None] * len(texts)
    sources = [*other, *PLAIN * 4]
    around = [w for t in texts[-200:] for w in t.split()]
    every = [(family, text, 6 if telling else 24) for family in NOTICES for text, telling in wordings(family)]
    for family, notice, times in every + [(UNKNOWN, text, 24) for text in OTHERS]:
        words = notice.split()
        for i in range(times):
            size = len(words) if i % 3 < 2 or len(words) < 6 else rng.randint(max(3, len(words) * 2 // 3), len(words))
            start = rng.randint(0, len(words) - size)
            middle = rng.choice(FRAMES) + " ".join(words[start:start + size])
            if i % 2:
                middle = " ".join([*rng.choices(around, k=rng.randint(0, 15)), middle,
                                   *rng.choices(around, k=rng.randint(0, 15))])
            texts.append(middle)
            families.append(family)
            sources.append(notice)
    return texts, families, sources


def trained(other: list[str]) -> Model:
    """Fit on the examples of four fifths of the wordings and other texts, and calibrate on those of the rest.

    No wording that probabilities are calibrated on has been fitted; the weights are then fitted again on all.
    """
    texts, families, sources = examples(other)
    whole = sparse(texts)
    used = np.unique(whole.columns)
    x = logistic.Sparse(np.searchsorted(used, whole.columns), whole.values, whole.first)
    # One of each five wordings of a family, and of other texts, by hash.
    order: dict[str | None, list[str]] = {}
    for family, source in sorted(set(zip(families, sources, strict=True)), key=lambda x: zlib.crc32(x[1].encode())):
        order.setdefault(family, []).append(source)
    out = {source for some in order.values() for source in some[::5]}
    held = np.array([s in out for s in sources])
    notice = np.array([f is not None for f in families])
    parts = []
    for family in [None, *NOTICES]:
        use = np.ones(len(texts), bool) if family is None else notice
        y = (notice if family is None else np.array([f == family for f in families])).astype(np.int64)
        fit = lambda rows: logistic.fit(x.rows(rows), y[rows], len(used),   # noqa: E731, B023
                                         penalty=2e-4 if family is None else 1e-3, steps=400 if family is None else 120)
        part = logistic.margins(x.rows(use & held), *fit(use & ~held))
        # Both classes weigh the same: how frequent a licence is in a corpus is not known.
        seen = y[use & held]
        share = np.where(seen == 1, len(seen) / max(1, 2 * seen.sum()), len(seen) / max(1, 2 * (1 - seen).sum()))
        slope, shift = logistic.calibrate(part, seen, share)
        weights, bias = fit(use)
        parts.append((weights, bias, max(slope, 0.1), shift))
    gate = np.zeros(1 << BITS, np.float32)
    gate[used] = parts[0][0]
    families = np.stack([p[0] for p in parts[1:]], axis=1).astype(np.float32)
    _, known = next(arrays.text_slices(pa.array([*(text for f in NOTICES for text, _ in wordings(f)), *OTHERS, *USUAL])))
    pairs = np.zeros(1 << BITS, bool)
    pairs[word_columns(known)[2]] = True
    return Model(gate, pairs, used, families, *[np.array([p[i] for p in parts]) for i in (1, 2, 3)])


def family_margins(model: Model, columns: np.ndarray) -> np.ndarray:
    place = np.minimum(np.searchsorted(model.columns, columns), len(model.columns) - 1)
    return model.families[place[model.columns[place] == columns]].sum(axis=0) + model.bias[1:]


def windows(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first word, word after the last) of the windows of runs of words."""
    size = last - first
    n = np.where(size > WINDOW, 1 + -(-(size - WINDOW) // STEP), (size > 0).astype(np.int64))
    of = np.repeat(np.arange(len(n)), n)
    start = first[of] + STEP * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
    return of, start, np.minimum(start + WINDOW, last[of])


def units_of(texts: arrays.Texts, spans: arrays.Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, word after the last, whether it is only of a line) of the units, and of the lines of
    paragraphs with several lines, which come first."""
    lines = arrays.find_lines(texts)
    first = np.searchsorted(spans.starts, lines.starts)
    last = np.searchsorted(spans.starts, lines.ends)
    full = np.flatnonzero(last > first)
    row, first, last = lines.row[full], first[full], last[full]
    begins = np.ones(len(full) + 1, bool)
    begins[1:-1] = (np.diff(full) > 1) | (row[1:] != row[:-1])
    begin, end = np.flatnonzero(begins[:-1]), np.flatnonzero(begins[1:])
    several = np.flatnonzero(~(begins[:-1] & begins[1:]))
    line, start, stop = windows(first[several], last[several])
    paragraph, start_all, stop_all = windows(first[begin], last[end])
    return (np.concatenate([row[several[line]], row[begin[paragraph]]]), np.concatenate([start, start_all]),
            np.concatenate([stop, stop_all]), np.arange(len(line) + len(paragraph)) < len(line))


def distinct_sums(weights: np.ndarray, one: np.ndarray, two: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Sum of the weights of each unit's distinct features."""
    keys = []
    for columns, n in ((one, last - first), (two, last - first - 1)):
        of = np.repeat(np.arange(len(n)), n)
        place = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        keys.append(of << BITS | columns[place])
    key = np.unique(np.concatenate(keys))
    return np.bincount(key >> BITS, weights=weights[key & ((1 << BITS) - 1)], minlength=len(first))


def confirmed(words: list[str], family: str) -> tuple[int, int, int] | None:
    """(pairs shared, first word, word after the last) of the template of a family that shares most with a unit."""
    pairs = set(zip(words, words[1:], strict=False))
    best = None
    for theirs, telling in TEMPLATES[family]:
        both = pairs & theirs
        shared = len(both)
        if shared < max(LEAST_SHARED * min(len(theirs), len(pairs)), min(LEAST_PAIRS, len(theirs))) or not shared:
            continue
        if telling and not any(a in telling or b in telling for a, b in both):
            continue
        # A notice of three words begins or ends its line or paragraph.
        ends = {*zip(words[:3], words[1:3], strict=False), (words[-2], words[-1])}
        if len(theirs) < LEAST_PAIRS and len(words) > SHORT and not ends & theirs:
            continue
        # The shortest run of words with all the pairs that are shared.
        at = [(i, p) for i, p in enumerate(zip(words, words[1:], strict=False)) if p in theirs]
        held: Counter = Counter()
        left, place = 0, (len(words), 0, len(words))
        for i, p in at:
            held[p] += 1
            while len(held) == shared:
                start, gone = at[left]
                place = min(place, (i + 2 - start, start, i + 2))
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                left += 1
        if best is None or (shared, -place[0]) > (best[0], best[1] - best[2]):
            best = (shared, place[1], place[2])
    return best


class Hit(NamedTuple):
    """A unit that is a notice: its words' places, its probability, and (pairs shared, first, last, family) of what
    templates confirm in it."""

    first: int
    last: int
    line: bool
    p: float
    text: str
    families: list[tuple[int, int, int, str]]


def notices_of(hits: list[Hit]) -> list[tuple[str, float]]:
    """(family, probability) of the notices of a text, each once though several units hold it."""
    placed: list[list] = []
    candidates = [(-n, last - first, first, last, family, h.p) for h in hits for n, first, last, family in h.families]
    for _, _, first, last, family, p in sorted(candidates):
        over = [x for x in placed if first < x[1] and x[0] < last]
        if not over:
            placed.append([first, last, family, p])
        elif over[0][2] == family:
            over[0][:] = [min(first, over[0][0]), max(last, over[0][1]), family, max(p, over[0][3])]
    notices: list[list] = []
    for first, last, family, p in sorted(placed):
        if notices and notices[-1][2] == family and first <= notices[-1][1] + STEP:
            notices[-1][1], notices[-1][3] = max(last, notices[-1][1]), max(p, notices[-1][3])
        else:
            notices.append([first, last, family, p])
    # Units of no family: what goes on with a notice without naming a licence is part of it.
    rest = sorted((h for h in hits if not h.families), key=lambda h: (not h.line, h.first))
    more = bool(notices)
    while more:
        more = False
        for h in [h for h in rest if not NAMED.search(h.text)]:
            beside = [x for x in notices if h.first <= x[1] + STEP and x[0] - STEP <= h.last]
            if beside:
                x = beside[0]
                x[0], x[1], x[3] = min(x[0], h.first), max(x[1], h.last), max(x[3], h.p)
                rest.remove(h)
                more = True
    # The others: lines, then paragraphs that hold no notice yet.
    before = None
    for h in rest:
        same = [x for x in notices if h.first < x[1] and x[0] < h.last or h.line and x[2] == UNKNOWN and before is not None
                and before.last == x[1] == h.first and not before.text.rstrip().endswith((".", "!", "?"))]
        if same:
            same[0][3] = max(same[0][3], h.p)
            if same[0][2] == UNKNOWN:
                same[0][0], same[0][1] = min(same[0][0], h.first), max(same[0][1], h.last)
        else:
            notices.append([h.first, h.last, UNKNOWN, h.p])
        before = h
    return [(x[2], x[3]) for x in sorted(notices)]


def scan(texts: arrays.Texts, model: Model):
    """For each text: number of units, and (family, probability) of its notices; units of one notice count once."""
    spans, one, two = word_columns(texts)
    row, first, last, line = units_of(texts, spans)
    # No unit scores more than its positive weights, words that come again included; the sums are differences of
    # running ones, and a pair is counted where it begins. What is left is scored by its distinct features.
    gate = model.notice
    ones = np.concatenate([[0.0], np.cumsum(np.maximum(gate[one], 0), dtype=np.float64)])
    twos = np.concatenate([[0.0], np.cumsum(np.maximum(gate[two], 0), dtype=np.float64)])
    at = lambda sums, i: sums[np.minimum(i, len(sums) - 1)]
    most = model.bias[0] + ones[last] - ones[first] + at(twos, np.maximum(last - 1, first)) - at(twos, first)
    needed = (np.log(LEAST_NOTICE / (1 - LEAST_NOTICE)) - model.shift[0]) / model.slope[0]
    # Wordings confirm by two pairs at least, and so do usual phrases.
    paired = np.concatenate([[0], np.cumsum(model.pairs[two])])
    shared = at(paired, np.maximum(last - 1, first)) - at(paired, first)
    maybe = np.flatnonzero((most >= needed - 1e-3) & (shared >= 2))
    p = np.zeros(len(row))
    p[maybe] = logistic.probabilities(model.slope[0] * distinct_sums(gate, one, two, first[maybe], last[maybe])
                                      + model.slope[0] * model.bias[0] + model.shift[0])
    hits: dict[int, list[Hit]] = {}
    decoded = lambda a, b: texts.data[a:b].tobytes().decode("utf-8", "replace")
    for i in np.flatnonzero(p >= LEAST_NOTICE):
        columns = np.unique(np.concatenate([one[first[i]:last[i]], two[first[i]:max(first[i], last[i] - 1)]]))
        shares = logistic.probabilities(model.slope[1:] * family_margins(model, columns) + model.shift[1:])
        words = [words_of(decoded(spans.starts[j], spans.ends[j]))[0] for j in range(first[i], last[i])]
        families = []
        for family, share in zip(NOTICES, shares, strict=True):
            found = confirmed(words, family) if share >= LEAST_FAMILY else None
            if found:
                families.append((found[0], int(first[i]) + found[1], int(first[i]) + found[2], family))
        # What names no family has to speak like a notice.
        speaks = p[i] >= LEAST_UNKNOWN and len(GENERIC & set(zip(words, words[1:], strict=False))) >= LEAST_GENERIC
        if not families and not speaks:
            continue
        stop = spans.starts[last[i]] if last[i] < len(spans.starts) else len(texts.data)
        text = decoded(spans.starts[first[i]], min(stop, texts.offsets[row[i] + 1]))
        hits.setdefault(int(row[i]), []).append(
            Hit(int(first[i]), int(last[i]), bool(line[i]), float(p[i]), text, families))
    return np.bincount(row[~line], minlength=texts.rows), [notices_of(hits.get(i, [])) for i in range(texts.rows)]


def other_paragraphs(docs: DataFrame, id_column: str, text_column: str, sample: int) -> list[str]:
    """At most ``sample`` units of other text, one from each of the documents with the smallest hashes."""
    rows = keyed(docs, id_column, text_column).where("__text <> ''")
    order = F.xxhash64(ROW_ID, ROW_HASH).alias("order")
    chosen = rows.select(order).distinct().orderBy("order").limit(sample)
    texts = rows.select(order, "__text").join(F.broadcast(chosen), "order").dropDuplicates(["order"])

    def pick(batches):
        for batch in batches:
            names, out = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, one = next(arrays.text_slices(pa.array([text]), 1 << 62))
                spans, _, _ = word_columns(one)
                _, first, last, _ = units_of(one, spans)
                if len(first):
                    i = int(name % len(first))
                    unit = one.data[spans.starts[first[i]]:spans.ends[last[i] - 1]].tobytes().decode("utf-8", "replace")
                    if not DOUBTFUL.search(unit):
                        names.append(name)
                        out.append(unit)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.string())],
                                             ["order", "unit"])

    found = texts.select("order", "__text").mapInArrow(pick, "order bigint, unit string").collect()
    return [r["unit"] for r in sorted(found)]


def licence_scan(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE,
) -> DataFrame:
    """doc_id, n_units, n_notices, licences and probability of every document row.

    ``licences`` lists the distinct families found, sorted and comma-joined, ``unknown`` among them where a
    notice is of none; ``probability`` is the highest of a notice, null without one. A null or blank text has no
    units. Whole texts are scanned. An empty table gives an empty result; in a corpus without other
    text a few plain sentences stand for it. Repeated rows give repeated results. Other columns are not read.
    """
    model = trained(other_paragraphs(docs, id_column, text_column, sample))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            counts, found = [], []
            for _, texts in arrays.text_slices(batch.column("__text")):
                n, notices = scan(texts, sent.value)
                counts.append(n)
                found += notices
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW_ID), pa.array(np.concatenate(counts).astype(np.int64) if counts else [], pa.int64()),
                 pa.array([len(f) for f in found], pa.int64()),
                 pa.array([",".join(sorted({x for x, _ in f})) for f in found], pa.string()),
                 pa.array([max((p for _, p in f), default=None) for f in found], pa.float64())],
                ["doc_id", "n_units", "n_notices", "licences", "probability"])

    return keyed(docs, id_column, text_column).mapInArrow(
        run, f"doc_id {type_of(docs, id_column)}, n_units bigint, n_notices bigint, licences string, probability double")
