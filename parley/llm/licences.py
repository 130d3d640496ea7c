"""Licence scan: a trained paragraph classifier, confirmed by templates.

Lines that were wrapped (``WRAP`` characters or more without closing punctuation) are joined with
the next one to paragraphs. Their distinct normalised texts are classified once: a multinomial
logistic regression over word 1- to 3-grams gives each licence family, ``unknown`` (a licence of no
known family) and ``none`` (no statement of a licence) a probability. It is trained here on
paragraphs generated from the notices below, in ``VARIANTS`` forms each: with and without
copyright lines and phrases around them, words dropped, doubled and replaced, made-up licence names
for ``unknown``. Its temperature is fitted on paragraphs generated apart, so that probabilities are
calibrated. A paragraph of a family with less than ``SURE`` is unknown; one most like no
statement gives no row. A family is confirmed if ``SAME`` or more of the n-grams of one of
its templates occur in the paragraph.

The model is sparse: it has the n-grams that hold an anchor; anchors are the fewest words that
cover what tells the licence paragraphs of the training set from others. So a paragraph without
an anchor has no known n-gram and is ``none`` by the model itself, and texts without an anchor
needn't be taken apart.

Scoring runs in Spark expressions alone: n-grams are exploded, joined to the weights (a table as
large as the notices make it, so of fixed size) and summed. Weights are whole millionths, so sums
are exact in any order. Copied paragraphs are classified once, whatever their number.

Defined results: null and empty texts give no row; long texts are read whole; ties between
families go to the first by name; equal rows give equal rows; null ids are kept; other columns are
not looked at, so none can clash.
"""

from __future__ import annotations

import json
import math
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store

SURE, SAME = 0.6, 0.6
GRAMS = (1, 2, 3)
WRAP = 40
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
JOINED = rf"([^\n]{{{WRAP - 1}}}[^.!?:;\s])[ \t\r]*\n"
UNKNOWN, NONE = "unknown", "none"
VARIANTS, SEED = 6, 11
ANCHOR_ODDS, LEAST_ODDS = 2.0, 1.0  # log odds of licence paragraphs against others: of a telling n-gram, and of an anchor
# Notices by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "License: MIT", "Lizenz: MIT", "Licence MIT", "MIT licensed",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "This software is released under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0", "License: Apache 2.0", "Apache License 2.0", "Apache-2.0 licensed",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
        "Licensed to the Apache Software Foundation under one or more contributor license agreements.",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.", "Licensed under the BSD license.", "This code is under a 2-clause BSD license", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "License: BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GPL version 2 or later license", "Licensed under the GNU GPL v3", "Distributed under the GNU GPL v3", "License: GPLv3", "License: GPL v2", "GPLv2", "GPLv3",
        "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "lizenziert unter der GNU General Public License", "sous licence GNU GPL",
        "This program is free software: you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL license", "Licensed under the GNU LGPL version 3", "SPDX-License-Identifier: LGPL-2.1-only", "License: LGPLv3", "LGPLv2.1", "License: LGPL",
        "you can redistribute this library under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0", "Released under the MPL 2.0 license", "under the Mozilla Public License version 1.1", "SPDX-License-Identifier: MPL-2.0", "License: MPL 2.0",
        "If a copy of the MPL was not distributed with this file, you can obtain one at mozilla.org/MPL/2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Released under a Creative Commons Attribution license", "Text is available under the license CC BY 3.0", "license: cc-by-4.0", "Available under CC BY 4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Released under CC BY-NC-SA 4.0 license", "licensed for noncommercial use under Creative Commons BY-NC", "license: cc-by-nc-4.0", "Available under CC BY-NC-ND 4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the Creative Commons Attribution-ShareAlike license", "Released under CC BY-SA 3.0 license", "license: cc-by-sa-4.0", "Released under CC BY-SA 4.0",
    ],
    "public-domain": [
        "This work is in the public domain.", "Released into the public domain under CC0 1.0 license", "This is free and unencumbered software released into the public domain.", "dedicated to the public domain with no rights reserved", "SPDX-License-Identifier: Unlicense", "Available under CC0 1.0",
        "license: cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "gemeinfrei, public domain",
    ],
    "proprietary": [
        "All rights reserved.", "Copyright, all rights reserved.", "No part of this publication may be reproduced without prior written permission", "proprietary and confidential, all rights reserved", "Unauthorized copying of this file is strictly prohibited", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.",
    ],
}
# Statements of licences of no known family; {} is a made-up name.
OTHERS = ["Licensed under the {} License.", "Released under the {} Public License, version 1.", "This work is licensed under the terms of the {} license.", "License: {}", "Lizenz: {}", "distributed under the {} licence agreement", "subject to the {} license terms", "SPDX-License-Identifier: {}-1.0"]
# Texts that state no licence, some with the same words.
PLAIN = [
    "He lost his driving license in the city.", "She asked for permission to leave early.", "The warranty on the washing machine has expired.", "a license to fish in these waters", "The board granted a broadcasting license to the station", "with kind permission of the family", "copyright law is taught in the second year",
    "a warrant for the arrest was issued", "The license fee rises next year", "he got permission from the mayor", "the public was asked to leave the domain of the king", "The new version of the software was released in March and copies were distributed to any person in the list",
    "the source code and the binary files are stored in this form, with documentation, in the library", "you can use this file without any program", "under the terms of the treaty no rights were granted", "the work of the foundation is free of charge", "the following conditions are met in all later years",
    "a creative project of the house of commons", "They may not obtain part of the software from other people", "the author of this publication is a contributor to one or more written agreements", "General of the army, published in the year 3.0 of the new era, 2.0 and 1.0 and 4.0", "the apache people live in the south",
    "er kommt mit dem hund und mit der katze aus der stadt", "sie geht mit ihm in das haus, das alt ist, und alle sind dort", "le chien et le chat sont dans la maison de la ville avec les enfants", "tous les jours il va sous le pont", "el perro y la casa de los padres con todos los otros", "the house by the river is as old as the town, and it was sold to a man at the end of the year",
    "for the last time in the history of our country there is no one who has been to that place", "Attribution of the painting to an international or local master is by no means certain, if at all possible", "it is subject to change", "see the clause above", "identifier of the record", "this list shall be included in the next edition",
    "the text is available in the file under the table, and only a copy of the notice was put into the box", "only this text and that file, into the archive, available to all, under no roof", "the organisation has its site at example.org", "an agreement was reached, and the notice is available under the old text", "they copy the file into another file and put a notice under it, only for the archive",
    "it was built by hand, by the river", "a team led by her and by him", "written by one, read by another", "step by step, side by side", "prices rose by 4.0 percent, by far the most", "one by one they came by", "by and large", "the public, by day, under the bridge", "a part of it, in part by mistake", "the file is open", "under it all",
    "this was done for them by this man for the work of this part, and this file is for this version", "for this and for that, by day and by night, the work is done by part of the crew, free for all", "Lesser known towns redistribute the wealth of the region", "a program of the general public broadcaster", "written permission of the school is needed for the trip", "the unlicensed driver was stopped", "version two of the plan",
]
# What stands around notices.
AROUND = ["", "", "", "Copyright (c) {year} {name}.", "This file is part of {name}.", "See the LICENSE file for details.", "{name} {year}.", "by {name}", "Copyright {year} {name} and contributors."]


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams(text: str) -> set[str]:
    w = words(text)
    return {" ".join(w[i : i + n]) for n in GRAMS for i in range(len(w) - n + 1)}


def generated(seed: int, variants: int = VARIANTS) -> list[tuple[str, str]]:
    """(paragraph, class) of every notice, as it is and in ``variants`` changed forms."""
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice(("ba", "ko", "ri", "tem", "lu", "ness", "ova", "quin")) for _ in range(rng.randint(2, 3))).title()

    def changed(text: str) -> str:
        out = []
        for w in text.split(" "):
            u = rng.random()
            out += [] if u < 0.04 else [w, w] if u < 0.06 else [name()] if u < 0.09 else [w]
        parts = [rng.choice(AROUND), " ".join(out), rng.choice(AROUND)]
        return " ".join(p.format(year=rng.randint(1990, 2030), name=name()) for p in parts if p)

    rows = []
    for family, notices in TEMPLATES.items():
        for t in notices:
            rows += [(t, family)] + [(changed(t), family) for _ in range(variants)]
    for t in OTHERS:
        rows += [(changed(t.format(name())), UNKNOWN) for _ in range(3 * variants)]
    for t in PLAIN:
        rows += [(t, NONE)] + [(" ".join(w for w in t.split(" ") if rng.random() > 0.1), NONE) for _ in range(variants)]
    return rows


def anchors(rows: list[tuple[str, str]]) -> frozenset[str]:
    """Words of which each n-gram that tells licence paragraphs from others has one.

    Such n-grams are ``ANCHOR_ODDS`` or more likelier in licence paragraphs. Words are taken in
    order of their own odds while they cover one that has none so far.
    """
    yes, no = {}, {}
    for text, kind in rows:
        for g in grams(text):
            into = no if kind == NONE else yes
            into[g] = into.get(g, 0) + 1
    n, m = sum(k != NONE for _, k in rows), sum(k == NONE for _, k in rows)
    odds = lambda g: math.log((yes.get(g, 0) + 0.5) / n) - math.log((no.get(g, 0) + 0.5) / m)
    told = {w for ts in (*TEMPLATES.values(), OTHERS) for t in ts for w in words(t) if len(w) > 1 and not w[0].isdigit()}
    left = [set(g.split(" ")) for g, c in yes.items() if c >= 3 and odds(g) >= ANCHOR_ODDS]
    found = set()
    for w in sorted(told, key=lambda w: (-odds(w), w)):
        rest = [g for g in left if w not in g]
        if len(rest) < len(left) and odds(w) >= LEAST_ODDS:
            found.add(w)
            left = rest
    return frozenset(found)


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@lru_cache(1)
def train(rounds: int = 150, rate: float = 0.08, ridge: float = 2e-5):
    """(classes, {n-gram: whole millionths by class}, biases, anchors), temperature included."""
    classes = (*sorted(TEMPLATES), NONE, UNKNOWN)
    rows, held = generated(SEED), generated(SEED + 1)
    hooks = anchors(rows)
    once: dict[str, int] = {}
    for t, _ in rows:
        for g in grams(t):
            once[g] = once.get(g, 0) + 1
    names = sorted(g for g, n in once.items() if n > 1 and not hooks.isdisjoint(g.split(" ")))
    at = {g: i for i, g in enumerate(names)}

    def matrix(some) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(some), len(names)))
        for r, (t, _) in enumerate(some):
            x[r, [at[g] for g in grams(t) if g in at]] = 1.0
        return x, np.eye(len(classes))[[classes.index(k) for _, k in some]]

    x, y = matrix(rows)
    weight = (len(rows) / len(classes) / y.sum(0)) @ y.T
    w, b, empty = np.zeros((len(names), len(classes))), np.zeros(len(classes)), np.eye(len(classes))[classes.index(NONE)]
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for i in range(1, rounds + 1):  # gradient steps scaled by running moments
        d = (y - _soft(x @ w + b)) * weight[:, None] / len(rows)
        # a paragraph without a known n-gram states nothing
        slopes = (x.T @ d - ridge * w, d.sum(0) + 0.1 * (empty - _soft(b[None])[0]))
        for k, (value, g) in enumerate(zip((w, b), slopes)):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    hx, hy = matrix(held)
    z = hx @ w + b
    heat = min((h / 20 for h in range(4, 80)), key=lambda h: -np.log((_soft(z / h) * hy).sum(1).clip(1e-12)).mean())
    micro = np.rint(1e6 * w / heat).astype(np.int64)
    return classes, {g: tuple(micro[i].tolist()) for g, i in at.items()}, tuple(np.rint(1e6 * b / heat).astype(np.int64).tolist()), tuple(sorted(hooks))


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small fixed table, as one literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def _templates() -> list[tuple[str, int, int, str]]:
    return [(f, i, len(grams(t)), g) for f, ts in TEMPLATES.items() for i, t in enumerate(ts) for g in sorted(grams(t))]


def anchor_pattern(hooks) -> str:
    """A pattern that any text with an anchor as a word has; common beginnings are written once."""

    def tree(some: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for w in some:
            heads.setdefault(w[:1], []).append(w[1:])
        end = heads.pop("", None) is not None
        parts = [re.escape(h) + tree(rest) for h, rest in sorted(heads.items())]
        if not parts:
            return ""
        return ("(?:" + "|".join(parts) + ")" + ("?" if end else "")) if end or len(parts) > 1 else parts[0]

    return f"(?<![a-z]){tree(sorted(hooks))}(?![a-z0-9])"


def scan(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, paragraph, family, probability, containment, confirmed) of each licence paragraph."""
    spark = docs.sparkSession
    classes, micro, biases, hooks = train()
    may = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.lower("text").rlike(anchor_pattern(hooks)))
    lines = may.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", JOINED, "$1 "), "\n")).alias("paragraph", "raw"))
    lines = lines.select("doc_id", "paragraph", F.regexp_extract_all(F.lower("raw"), F.lit(f"({WORD})"), 1).alias("w"))
    lines = lines.filter(F.arrays_overlap("w", F.array(*(F.lit(h) for h in hooks))))
    lines = lines.select("doc_id", "paragraph", F.array_join("w", " ").alias("para"))
    lines = store(lines.withColumn("pid", F.unhex(F.md5("para"))), "paragraphs")
    # each text once, in the task that its hash names: all sums by text are made there, without another shuffle
    paras = lines.select("para").distinct()

    def n_grams(w, n: int):
        all_n = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
        return F.when(F.size(w) >= n, all_n).otherwise(F.array().cast("array<string>"))

    # the words are bound once: within the inner lambda they would be split anew for each n-gram
    of = F.transform(F.array(F.split("para", " ")), lambda w: F.array_distinct(F.concat(*(n_grams(w, n) for n in GRAMS))))[0]
    weights = F.broadcast(_rows(spark, [{"gram": g, "z": v} for g, v in sorted(micro.items())], "gram:string,z:array<bigint>"))
    same = F.broadcast(_rows(spark, [dict(zip(("family", "template", "size", "gram"), t)) for t in _templates()], "family:string,template:int,size:int,gram:string"))
    bag = paras.select("para", F.explode(of).alias("gram"))
    sums = bag.join(weights, "gram").groupBy("para").agg(*(F.sum(F.col("z")[k]).alias(f"z{k}") for k in range(len(classes))))
    z = [F.col(f"z{k}") + b for k, b in enumerate(biases)]
    top = F.greatest(*z)
    odds = F.array(*(F.exp((x - top) / 1e6) for x in z))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    best = F.when(top == z[0], 0)
    for k in range(1, len(classes)):
        best = best.when(top == z[k], k)
    scored = sums.withColumn("e", odds).withColumn("k", best)
    scored = scored.select("para", F.get(F.array(*(F.lit(f) for f in classes)), F.col("k")).alias("guess"), F.round(F.get("e", F.col("k")) / total, 6).alias("probability"))
    scored = scored.filter(F.col("guess") != NONE)
    known = scored.select("*", F.explode(of).alias("gram")).join(same.withColumnRenamed("family", "guess"), ["gram", "guess"], "left")
    key = ["para", "guess", "probability"]
    found = known.groupBy(*key, "template").agg(F.coalesce(F.count("size") / F.max("size"), F.lit(0.0)).alias("c"))
    found = found.groupBy(*key).agg(F.round(F.max("c"), 6).alias("containment"))
    family = F.when(F.col("probability") >= SURE, F.col("guess")).otherwise(F.lit(UNKNOWN))
    found = found.select(F.unhex(F.md5("para")).alias("pid"), family.alias("family"), "probability", "containment")
    found = found.withColumn("containment", F.when(F.col("family") == UNKNOWN, 0.0).otherwise(F.col("containment")))
    out = lines.drop("para").join(found, "pid")
    return out.select("doc_id", "paragraph", "family", "probability", "containment", (F.col("containment") >= SAME).alias("confirmed"))


def op6_licences(spark, sf_dir: str) -> DataFrame:
    """Licence paragraphs of all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> dict[str, str]:
    """The query's SQL; it holds the trained weights, so it is made when asked for."""
    classes, micro, biases, hooks = train()
    q = lambda s: "'" + s.replace("'", "''") + "'"
    weights = ", ".join(f"({q(g)}, {', '.join(map(str, v))})" for g, v in sorted(micro.items()))
    temps = ", ".join(f"({q(f)}, {i}, {n}, {q(g)})" for f, i, n, g in _templates())
    zs = [f"z{k}" for k in range(len(classes))]
    joined = JOINED.replace("'", "''")
    n_grams = ", ".join(f"list_transform(range(1, greatest(1, len(w) - {n - 2})), lambda i: array_to_string(w[i:i + {n - 1}], ' '))" for n in GRAMS)
    return {"op6_licences": f"""
with weights(gram, {', '.join(zs)}) as (values {weights}),
temps(family, template, size, gram) as (values {temps}),
t as (select doc_id, string_split(regexp_replace(text, '{joined}', '\\1 ', 'g'), chr(10)) as ls from documents where text is not null),
l as (select doc_id, generate_subscripts(ls, 1) - 1 as paragraph, unnest(ls) as raw from t),
c as (select doc_id, paragraph, regexp_extract_all(lower(raw), '{WORD}') as w from l),
d as (select * from c where list_has_any(w, [{', '.join(map(q, hooks))}])),
p as (select distinct w from d),
b as (select w, unnest(list_distinct(flatten([{n_grams}]))) as gram from p),
s as (select b.w, {', '.join(f"sum({z}) + {k} as {z}" for z, k in zip(zs, biases))} from b join weights on b.gram = weights.gram group by b.w),
e as (select *, greatest({', '.join(zs)}) as top from s),
r as (
  select w, case {' '.join(f"when top = {z} then {q(f)}" for z, f in zip(zs, classes))} end as guess,
         round(1.0 / ({' + '.join(f"exp(cast({z} - top as double) / 1e6)" for z in zs)}), 6) as probability
  from e
), x as (select b.w, family, template, count(*) / max(size) as c from b join temps on b.gram = temps.gram group by all),
u as (select w, family, round(max(c), 6) as c from x group by all),
f as (
  select r.w, case when probability >= {SURE} then guess else '{UNKNOWN}' end as family, probability, coalesce(u.c, 0.0) as c
  from r left join u on r.w = u.w and r.guess = u.family where guess <> '{NONE}'
)
select d.doc_id, cast(d.paragraph as int) as paragraph, f.family, f.probability,
       cast(case when f.family = '{UNKNOWN}' then 0.0 else f.c end as double) as containment,
       case when f.family = '{UNKNOWN}' then false else f.c >= {SAME} end as confirmed
from d join f on d.w = f.w
"""}


QUERIES = {"op6_licences": op6_licences}
ORACLE: dict[str, str] = {}  # see :func:`oracle`
