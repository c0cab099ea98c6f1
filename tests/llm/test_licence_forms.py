"""Notices in every spelling that the templates' words allow, against a scan without a filter before it."""

import test_licences as plain

from framewright.llm import licence_scan as ls
from framewright.llm.licence_scan import scan_licences

NOTICES = {
    "Content is available under CC-BY-SA 4.0.": "CC-BY-SA",
    "Text: CC-BY 4.0": "CC-BY",
    "Released under CC-BY-NC 4.0.": "CC-BY-NC",
    "Creative Commons Attribution-ShareAlike 4.0 International": "CC-BY-SA",
    "Released under GPLv3": "GPL",
    "License: GPL-2.0": "GPL",
    "This program is available under the AGPLv3.": "AGPL",
    "Eclipse Public License 2.0": "EPL-2.0",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "Creative Commons Attribution 3.0 Unported": "CC-BY",
}


def test_hyphens_and_names_in_full(spark, monkeypatch):
    texts = list(NOTICES) + [t for all_t in ls.TEMPLATES.values() for t in all_t]
    texts += [t.replace(" ", "-") for t in texts] + ["of the", "It is in the box.", "The Work is", "a copy of the book at the end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["family"]) for r in scan_licences(docs).collect()}
    monkeypatch.setattr(ls, "ANCHORS", "")  # the plain loop skips nothing
    assert got == {(i, f) for i, t in enumerate(texts) for _, f in plain.plain_scan(t)}
    told = dict(got)
    missed = [t for i, t in enumerate(texts[: len(NOTICES)]) if told.get(i) != NOTICES[t]]
    missed += [t for f, all_t in ls.TEMPLATES.items() for t in all_t if told.get(texts.index(t)) != f]
    assert not missed, missed
