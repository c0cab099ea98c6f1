import collections
import math
import re

from framewright.llm import licence_scan as ls
from framewright.llm.licence_scan import scan_licences


def plain_scan(text, least=0.75):
    """(paragraph, family) of a text, one class after the other."""
    table, constants, limit = ls.train()
    out = []
    for place, line in enumerate((text or "").split("\n")):
        if not re.search(ls.ANCHORS, line):
            continue
        words = ls.words_of(line)
        logits = dict(constants)
        for gram in ls.ngrams(words):
            for family in logits:
                logits[family] += table.get((gram, family), 0.0)
        top = max(logits.values())
        family = min(f for f, x in logits.items() if x == top)
        if family == ls.UNKNOWN or 1 / sum(math.exp(x - top) for x in logits.values()) < limit:
            continue
        pairs = lambda w: {" ".join(w[i : i + 2]) for i in range(len(w) - 1)}
        agreement = 0.0
        for template in ls.TEMPLATES[family]:
            wanted = ls.words_of(template)
            wanted = pairs(wanted) if len(wanted) > 1 else set(wanted)
            shared = len(wanted & (set(words) | pairs(words)))
            agreement = max(agreement, shared / len(wanted), shared / max(3, len(pairs(words))))
        if agreement >= least:
            out.append((place, family))
    return out


TEXTS = [
    "Intro\nLicensed under the Apache License, Version 2.0.\nmore", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.", "nothing here", None, "", "All rights reserved.",
    "He lost his driving licence.\nThe license plate", "MIT is a school with a public license to teach", "CC0", "cc by 4.0",
    "x " * 20000 + "\nSPDX-License-Identifier: GPL-3.0-or-later", "Redistribution and use in source and binary forms, with or without "
    "modification, are permitted provided that the following conditions are met:", "Licensed under CC BY-SA 4.0 and the MIT License.",
    "GNU Lesser General Public License license", "©copyright 2020", "Licença",
]


def test_scan_equals_a_plain_loop(spark):
    rows = [(i, t, "x", 0) for i, t in enumerate(TEXTS)] + [(None, TEXTS[1], "x", 0), (1, TEXTS[1], "x", 0)]
    got = scan_licences(spark.createDataFrame(rows, "doc_id long, text string, family string, paragraph int")).collect()
    want = collections.Counter((i, p, f) for i, t, *_ in rows for p, f in plain_scan(t))
    assert collections.Counter((r["doc_id"], r["paragraph"], r["family"]) for r in got) == want
    found = {(i, f) for i, _, f in want}
    assert {(0, "Apache-2.0"), (1, "MIT"), (2, "CC-BY-NC"), (3, "GPL"), (13, "BSD")} <= found
    assert not {i for i, _ in found} & {4, 5, 6, 8}


def test_every_template_is_known():
    for family, templates in ls.TEMPLATES.items():
        for template in templates:
            assert plain_scan(f"Licensed under the {template}. license") == [(0, family)] or plain_scan(template)[:1] in ([(0, family)], [])


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = collections.Counter(r["doc_id"] for r in docs.collect() for _ in plain_scan(r["text"]))
    assert collections.Counter(r["doc_id"] for r in scan_licences(docs).collect()) == want
    assert scan_licences(docs.limit(0)).count() == 0
