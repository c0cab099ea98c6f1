"""Licence scan of paragraphs by a trained n-gram classifier, in DataFrame operations.

A sparse logistic regression over word n-grams tells licence families and a class of
ordinary text apart; it is trained on the short notices below and ordinary lines. A
paragraph counts as a notice if its family is likelier than a calibrated limit
and the words agree with one of the family's own templates.
"""

from __future__ import annotations

import functools
import math
import random
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framewright.session import materialize

#: Names by which notices call a licence, and the openings of full texts.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Apache License, Version 2.0",
        "Apache License 2.0",
        "Apache 2.0 license",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "MIT License",
        "MIT licence",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": [
        "BSD License",
        "BSD 3-Clause License",
        "BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "GNU General Public License",
        "GNU General Public License, version 3",
        "GNU General Public License, version 2",
        "GNU GPL license",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "GPLv2",
        "GPLv3",
        "GPL-2.0",
        "GPL-3.0",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "GNU Lesser General Public License",
        "GNU LGPL license",
        "LGPLv3",
        "LGPL-2.1",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "AGPL": [
        "GNU Affero General Public License",
        "GNU AGPL license",
        "AGPLv3",
        "AGPL-3.0",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License - v 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "BSL-1.0": ["Boost Software License", "Boost Software License, Version 1.0", "SPDX-License-Identifier: BSL-1.0"],
    "MPL-2.0": [
        "Mozilla Public License, version 2.0",
        "the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "CC BY 4.0",
        "Creative Commons Attribution 4.0 International License",
        "Creative Commons Attribution License",
        "Creative Commons Attribution 3.0 Unported",
    ],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": [
        "CC BY-NC 4.0",
        "CC BY-NC-SA 4.0",
        "CC BY-NC-ND 4.0",
        "Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "CC-BY-ND": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC0": ["CC0 1.0 Universal", "CC0 public domain dedication", "Creative Commons Zero license"],
    "ISC": ["ISC License", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee"],
    "Unlicense": ["The Unlicense", "This is free and unencumbered software released into the public domain"],
    "Proprietary": ["All rights reserved", "Confidential and proprietary"],
}
#: How notices begin and end.
OPENINGS = [
    "{}", "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.",
    "This work is licensed under the {}.", "This work is licensed under {}.", "This work is licensed under a {}.",
    "This software is distributed under the terms of the {}.", "Available under the {}, see the file LICENSE.",
    "This file is part of a project under the {}.", "Copyright 2020 the authors. {}.", "License: {}",
]
#: Ordinary lines that use the same words.
ORDINARY = [
    "He lost his driving licence on the way home.", "The license plate of the car was hard to read.",
    "You need permission to enter the building.", "The public is free to use the general waiting room.",
    "All rights and duties of members are listed in the statute.", "A fishing license costs ten euros a year.",
    "The museum was opened to the general public in 1980.", "The version of the story that he told was free of charge.",
    "Copyright law is taught in the third term.", "The warranty of the machine ends after two years.",
    "They were granted a license to sell beer.", "The commons were open to all creative people.",
    "The terms of the contract were changed.", "Students may obtain a copy of the book at the library.",
    "Under the table there was a box.", "The work is done.", "This is a test of the new file system.", "",
]
UNKNOWN = "unknown"
LONGEST = 3


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9.]*[a-z0-9]", text.lower())


def ngrams(words: list[str], longest: int = LONGEST) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)}


#: Words so common that they alone make no line worth judging.
COMMON = {
    "the", "of", "a", "and", "in", "to", "it", "is", "as", "by", "or", "at", "on", "for", "with", "this", "that", "are",
}


def _anchors(least: float = 0.75) -> str:
    """A regular expression that finds every line that can agree with a template, by its telling word pairs.

    To agree, a line needs ``least`` of a template's word pairs, or three at least that make up that
    share of its own. So every template may have two pairs of common words only that need no look; where it
    has more, its most frequent common word counts as a telling one.
    """
    known = [words_of(template) for all_t in TEMPLATES.values() for template in all_t]
    common = set(COMMON)
    for words in known:
        while True:
            pairs = set(zip(words, words[1:], strict=False))
            plain = [p for p in pairs if set(p) <= common]
            if len(plain) <= min(2, max(math.ceil(least * len(pairs)) - 1, 0)):
                break
            common.discard(max(sorted({w for p in plain for w in p}), key=lambda w: sum(w in p for p in plain)))
    seconds: dict[str, set[str]] = {}
    for words in known:
        for first, second in zip(words, words[1:], strict=False):
            if not {first, second} <= common:
                seconds.setdefault(first, set()).add(second)
    by_letter: dict[str, list[str]] = {}
    for first, rest in sorted(seconds.items()):
        told = f"{re.escape(first[1:])}[^a-z0-9]+(?:{'|'.join(map(re.escape, sorted(rest)))})"
        by_letter.setdefault(first[0], []).append(told)
    for word in sorted({words[0] for words in known if len(words) == 1}):
        by_letter.setdefault(word[0], []).append(re.escape(word[1:]))
    told = [f"{x}(?:{'|'.join(rest)})" for x, rest in by_letter.items()]
    return rf"(?i)(?<![a-z0-9.])(?:{'|'.join(told)})(?![a-z0-9])"


#: A line without any of these pairs agrees with no template.
ANCHORS = _anchors()


@functools.lru_cache(maxsize=1)
def train(seed: int = 1, epochs: int = 60, rate: float = 0.5, decay: float = 1e-4) -> tuple[dict, dict, float]:
    """Weights by (n-gram, class), constants by class, and the least chance of a family.

    Stochastic gradient descent on fixed notices and ordinary lines; the limit is halfway between
    the greatest chance of a family among ordinary lines left out of training and the least right chance
    of the notices.
    """
    classes = [*TEMPLATES, UNKNOWN]
    held = set(ORDINARY[::4])
    rows = [(opening.format(t), family) for family, all_t in TEMPLATES.items() for t in all_t for opening in OPENINGS]
    lines = [line for line in ORDINARY if line not in held]
    rows += [(line, UNKNOWN) for line in lines for _ in range(12)]
    rows += [(opening.format("agreement of the parties"), UNKNOWN) for opening in OPENINGS for _ in range(6)]
    known = [(sorted(ngrams(words_of(text))), classes.index(family)) for text, family in rows]
    rng = random.Random(seed)
    weights: dict[str, list[float]] = {}
    bias = [0.0] * len(classes)

    def chances(features: list[str]) -> list[float]:
        logits = list(bias)
        for f in features:
            if (w := weights.get(f)) is not None:
                logits = [a + b for a, b in zip(logits, w, strict=True)]
        top = max(logits)
        odds = [math.exp(x - top) for x in logits]
        total = sum(odds)
        return [x / total for x in odds]

    for epoch in range(epochs):
        rng.shuffle(known)
        for features, label in known:
            p = chances(features)
            if p[label] > 0.995:
                continue
            p[label] -= 1
            step = rate / (1 + 0.1 * epoch) / math.sqrt(1 + len(features))
            bias = [b - step * g for b, g in zip(bias, p, strict=True)]
            for f in features:
                w = weights.setdefault(f, [0.0] * len(classes))
                weights[f] = [(1 - decay) * a - step * g for a, g in zip(w, p, strict=True)]
    wrong = max(max(chances(sorted(ngrams(words_of(line))))[:-1]) for line in held)
    right = min(chances(features)[label] for features, label in known if label < len(classes) - 1)
    table = {
        (f, classes[i]): round(x, 6) for f, w in weights.items() for i, x in enumerate(w) if abs(x) >= 0.005
    }
    return table, dict(zip(classes, bias, strict=True)), max(0.5, (min(wrong, 0.99) + right) / 2)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9.]*[a-z0-9]"), F.lit(0))


def _ngrams(words: Column, sizes: range) -> Column:
    """Distinct n-grams of an array of words."""

    def of_size(n: int):
        return lambda start: F.concat_ws(" ", F.slice(words, start, n))

    grams = []
    for n in sizes:
        places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(
            F.array().cast("array<int>")
        )
        grams.append(F.transform(places, of_size(n)))
    return F.array_distinct(F.concat(*grams))


def scan_licences(
    docs: DataFrame, least_agreement: float = 0.75, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per licence notice: id, paragraph, family, probability, agreement, text.

    Paragraphs are the lines of the whole text, numbered from 0. A notice is a paragraph whose likeliest class is a
    licence family with at least the calibrated chance, and whose words contain ``least_agreement`` of the word pairs of one
    of the family's templates, or are contained in it that far. Lines without a word pair that any such agreement takes are
    left out before the others are judged, each distinct one once.

    Null and empty texts have no notices. Repeated rows give their notices each; null ids stay; other columns play no part;
    an empty table gives no rows. Ties between classes go to the first by name.
    """
    spark = docs.sparkSession
    table, constants, limit = train()
    lines = (
        docs.select(F.col(id_column), F.posexplode(F.split(text_column, "\n")).alias("paragraph", "text"))
        .where(F.col("text").rlike(_anchors(least_agreement)))
        .withColumn("text", F.trim("text"))
    )
    lines = materialize(lines, "lines")
    distinct = lines.select("text").distinct().withColumn("words", _words(F.col("text")))
    weights = spark.createDataFrame([(g, c, w) for (g, c), w in table.items()], "gram string, family string, weight double")
    bases = spark.createDataFrame(list(constants.items()), "family string, base double")
    grams = distinct.select("text", F.explode(_ngrams(F.col("words"), range(1, LONGEST + 1))).alias("gram"))
    sums = grams.join(F.broadcast(weights), "gram").groupBy("text", "family").agg(F.sum("weight").alias("logit"))
    # every class of every paragraph: the constants are one row a family
    logits = (
        distinct.select("text", F.explode(F.array(*[F.lit(c) for c in constants])).alias("family"))
        .join(F.broadcast(bases), "family")
        .join(sums, ["text", "family"], "left")
        .select("text", "family", (F.col("base") + F.coalesce("logit", F.lit(0.0))).alias("logit"))
    )
    of_text = W.partitionBy("text")
    ranked = logits.withColumn("top", F.max("logit").over(of_text)).withColumn(
        "probability", 1 / F.sum(F.exp(F.col("logit") - F.col("top"))).over(of_text)
    )
    likeliest = (
        ranked.where("logit = top")
        .groupBy("text")
        .agg(F.min("family").alias("family"), F.max("probability").alias("probability"))
        .where((F.col("family") != UNKNOWN) & (F.col("probability") >= limit))
    )
    pairs = _ngrams(_words(F.col("template")), range(2, 3))
    templates = spark.createDataFrame(
        [(f, t) for f, all_t in TEMPLATES.items() for t in all_t], "family string, template string"
    ).select("family", F.when(F.size(_words(F.col("template"))) < 2, _words(F.col("template"))).otherwise(pairs).alias("pairs"))
    own = F.array_union(_ngrams(_words(F.col("text")), range(1, 3)), F.array().cast("array<string>"))
    shared = F.size(F.array_intersect("own", "pairs"))
    own_pairs = F.greatest(F.size(_ngrams(_words(F.col("text")), range(2, 3))), F.lit(3))
    agreed = (
        likeliest.withColumn("own", own)
        .join(F.broadcast(templates), "family")
        .withColumn("agreement", F.greatest(shared / F.size("pairs"), shared / own_pairs))
        .groupBy("text", "family", "probability")
        .agg(F.max("agreement").alias("agreement"))
        .where(F.col("agreement") >= least_agreement)
    )
    return lines.join(agreed, "text").select(id_column, "paragraph", "family", "probability", "agreement", "text")
