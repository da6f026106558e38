import random
import textwrap

from conftest import documents, words

from wardmap.llm.licences import NOTICES, UNKNOWN, licence_scan

PLANTED = [
    ("Released under the MIT License.", "MIT"), ("LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!!", "Apache"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), ("Licensed under CC BY-SA 4.0", "CC-BY-SA"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including", "MIT"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met:", "BSD"), ("Licensed under the Village Fair License, version 7.", UNKNOWN),
]


def plain(seed, n=120):
    return "\n".join(" ".join(words(n // 4, seed + i, 3000)) for i in range(4))


def test_planted_notices_and_clean_texts(spark):
    rows = [(i, plain(i), "s") for i in range(400)]
    for i, (notice, _) in enumerate(PLANTED):
        rows.append((1000 + i, plain(5000 + i) + "\n" + notice + "\n" + plain(6000 + i), "s"))
        rows.append((2000 + i, " ".join([*words(100, i, 3000), notice, *words(100, i + 50, 3000)]), "s"))
    rows += [(3000, plain(1) + "\n" + PLANTED[0][0] + "\n" + PLANTED[2][0], "s"), (3001, "this is of the the the " * 200, "s")]
    found = {r.doc_id: r for r in licence_scan(documents(spark, rows)).collect()}
    for i, (_, family) in enumerate(PLANTED):
        assert found[1000 + i].licences == family, PLANTED[i]
        assert found[2000 + i].licences == family or family == UNKNOWN
        assert found[1000 + i].n_notices == 1 and found[1000 + i].probability > 0.8
    assert found[3000].licences == "GPL,MIT"
    assert sum(found[i].licences != "" for i in range(400)) == 0 and found[3001].licences == ""


def test_held_out_wordings(spark):
    """Family notices in new wordings: other frames, other text around, other punctuation."""
    rng = random.Random(9)
    rows, families = [], []
    for family, notices in NOTICES.items():
        for notice in notices:
            around = words(rng.randint(0, 12), rng.random().__hash__() % 1000, 3000)
            rows.append((len(rows), f"Remark -- {notice.replace(',', ' ;')}: {' '.join(around)}", "s"))
            families.append(family)
    more = [(10_000 + i, plain(i), "s") for i in range(300)]
    found = {r.doc_id: r.licences for r in licence_scan(documents(spark, rows + more)).collect()}
    right = sum(found[i] == f for i, f in enumerate(families))
    assert right >= 0.9 * len(families)


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_wrapped_notices(spark):
    """Notices of every family, wrapped and in comments, are one notice of that family."""
    rows, families = [], []
    for family, notices in NOTICES.items():
        for notice in notices:
            for width in (24, 36, 72):
                for mark in ("", " * ", "# ", "dnl "):
                    text = "\n".join(mark + part for part in textwrap.wrap(notice + ".", width))
                    rows.append((len(rows), f"{plain(len(rows))}\n{mark}\n{text}\n{mark}\n{plain(9000 + len(rows))}", "s"))
                    families.append(family)
    rows.append((10_000, f"{plain(3)}\n\n{APACHE}\n\n{plain(4)}", "s"))
    rows.append((10_001, f"{plain(5)}\n\nLicensed under the GNU Lesser\nGeneral Public License, version 2.1\n\n{plain(6)}\n"
                         f"Released under the\nMIT License.\n{plain(7)}", "s"))
    rows += [(20_000 + i, plain(i), "s") for i in range(300)]
    found = {r.doc_id: r for r in licence_scan(documents(spark, rows)).collect()}
    wrong = [(f, rows[i][1].split("\n")[5:-5], found[i].licences, found[i].n_notices) for i, f in enumerate(families)
             if (found[i].licences, found[i].n_notices) != (f, 1)]
    assert not wrong, (len(wrong), len(families), wrong[:8])
    assert (found[10_000].licences, found[10_000].n_notices) == ("Apache", 1)
    assert (found[10_001].licences, found[10_001].n_notices) == ("LGPL,MIT", 2)
    assert not any(found[20_000 + i].n_notices for i in range(300))


def test_edge_cases(spark, edge_rows):
    docs = documents(spark, edge_rows)
    found = licence_scan(docs).collect()
    assert len(found) == len(edge_rows)
    assert all(r.n_units == 0 and r.licences == "" and r.probability is None for r in found if r.doc_id in (1, 2, 3))
    assert licence_scan(docs.limit(0)).count() == 0
    assert licence_scan(documents(spark, [(1, "Released under the MIT License", "s")])).first().licences == "MIT"


OTHER_WORDINGS = [
    ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA"), ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND"),
    ("© 2020 Example Corp. All rights reserved.", "proprietary"), ("All rights reserved.", "proprietary"),
    ("Copyright 2021 Miller and Sons. All rights reserved.", "proprietary"), ("(c) 2018 Jane Doe, all rights reserved", "proprietary"),
    ("Dieses Programm ist unter der Apache-Lizenz, Version 2.0 lizenziert.", "Apache"),
    ("Dieses Werk steht unter der GNU General Public License, Version 3.", "GPL"),
    ("Cette œuvre est mise à disposition selon les termes de la Licence Creative Commons Attribution 4.0 International.", "CC-BY"),
    ("Esta obra está bajo una licencia Creative Commons Reconocimiento-CompartirIgual 4.0 Internacional.", "CC-BY-SA"),
    ("Veröffentlicht unter der MIT-Lizenz.", "MIT"), ("Ce logiciel est publié sous la licence MIT.", "MIT"),
    ("This library is distributed under the Boost Software License, Version 1.0. See the file for details.", "BSL"),
    ("Licensed under the EUPL, Version 1.2.", "EUPL"), ("The code is available under the ISC License.", "ISC"),
    ("You can use it under the terms of the Mozilla Public License 2.0.", "MPL"),
    ("The source is made available to you under the terms of the Eclipse Public License 2.0", "EPL"),
]
NO_NOTICES = [
    "She obtained a fishing license under the new state law.", "He renewed his driver's license in the spring.",
    "The album appeared in May, with all rights reserved for the artist by the label.", "The prisoners were released under the amnesty.",
    "A software engineer spoke about the general public and its version of events.", "Sie machte unter der Woche den Führerschein.",
    "The MIT campus lies beside the river, and the public may visit it.", "Creative people have much in common with each other.",
    "Il a obtenu une licence de lettres à Paris.", "The court granted the pub a license to sell drinks until two.",
]


def test_wordings_that_are_no_templates(spark):
    rows = [(i, plain(i) + "\n\n" + text + "\n\n" + plain(i + 700), "s") for i, (text, _) in enumerate(OTHER_WORDINGS)]
    rows += [(1000 + i, plain(i) + "\n\n" + text + "\n\n" + plain(i + 700), "s") for i, text in enumerate(NO_NOTICES)]
    rows += [(2000 + i, plain(i), "s") for i in range(300)]
    found = {r.doc_id: r for r in licence_scan(documents(spark, rows)).collect()}
    wrong = [(text, found[i].licences) for i, (text, family) in enumerate(OTHER_WORDINGS) if found[i].licences != family]
    assert not wrong, wrong
    wrong = [(text, found[1000 + i].licences) for i, text in enumerate(NO_NOTICES) if found[1000 + i].licences]
    assert not wrong, wrong
    assert not any(found[2000 + i].n_notices for i in range(300))


def test_unknown_licences_in_any_language(spark):
    texts = ["Publié sous la licence Exemple Ouverte.", "Licensed under the Village Fair License, version 7.",
             "Lizenziert unter der Musterdorf-Lizenz, Version 4."]
    rows = [(i, plain(i) + "\n\n" + t, "s") for i, t in enumerate(texts)] + [(100 + i, plain(i + 50), "s") for i in range(200)]
    found = {r.doc_id: r.licences for r in licence_scan(documents(spark, rows)).collect()}
    assert [found[i] for i in range(3)] == [UNKNOWN] * 3
