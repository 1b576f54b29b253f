"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

The lines of a text are read as one run of words, so that a notice may be wrapped anywhere, in
overlapping windows of ``WINDOW`` words that cover it whole.  Words that every notice has
(``ANCHORS``) get further, closer windows: the line they are in and ``CLOSE`` words around them.
Words and word pairs are hashed and a multinomial logistic regression with an elastic-net penalty
(so most weights are zero) names a licence family or ``none``.  It is trained on notices made from
the templates by rule, alone and between words of the corpus, and on windows drawn from the corpus
that resemble no template; a held-out fifth calibrates the temperature and the constant of
``none``.  A named family is confirmed where enough word pairs of one of its templates are there.

``paragraph`` is the line (from 0) in which the template's words begin.  Findings of a family that
share words are one result, and words that another family's template explains better confirm none.  The clause that both BSD licences have is named as the shorter one.

Only DataFrame functions and MLlib transformers are used.  Bounds: about ``NEGATIVES`` corpus
windows are drawn by hash for training; everything is scanned.

Edge cases: null and empty texts have no words and give no rows; rows that repeat give one result;
different texts under one doc_id, or without one, give results each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightledger.llm.common import store, table

WINDOW, STRIDE = 96, 80
CLOSE, STEP = 36, 12
VARIANTS, LONG, PROSE = 5, 16, 256
COMPARED = 4
FEATURES = 1 << 12
NEGATIVES, SAMPLED_DOCUMENTS = 2_000, 400
ALIKE, UNLIKE, LEAST = 0.6, 0.3, 0.1
NONE = "none"
TOKEN = r"[\p{L}\p{N}]+(?:\.\p{N}+)*"

# How licences are named, how notices name them, and characteristic passages.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "Expat License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license"],
    "BSD-3-Clause": ["BSD 3-Clause License", "three-clause BSD license", "New BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "two-clause BSD license", "Simplified BSD License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0 license"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0 license"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0 license"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0 license"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0 license"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero v1.0 Universal", "CC0 public domain dedication"],
    "ISC": ["ISC License", "ISC licence"],
    "Unlicense": ["the Unlicense", "Unlicense license"],
}
NOTICES = [
    "Licensed under {the}{name}.",
    "Released under {the}{name}.",
    "This work is licensed under {the}{name}.",
    "This software is distributed under the terms of {the}{name}.",
    "Available under {the}{name}, see the file LICENSE.",
    "The code is made available under {the}{name}.",
]
PASSAGES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software",
    ],
    "Apache-2.0": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
    ],
    "BSD-2-Clause": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or any later version",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
        "the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software",
    ],
}
# Words of which every notice or passage has one.
ANCHORS = [
    "agpl", "apache", "bsd", "cc", "cc0", "commons", "disclaims", "expat", "gnu", "gpl", "isc", "lgpl", "licence", "licenced",
    "license", "licensed", "mozilla", "mpl", "permission", "redistribute", "redistribution", "redistributions",
    "spdx", "sublicense", "unencumbered", "unlicense", "warranties", "warranty",
]
NEAR_MISSES = [
    "The driver showed the licence to the officer.",
    "A new version of the report was released under pressure.",
    "The general public is invited to the foundation.",
    "All names in this work are made up.",
    "The software is available in version 2.0 and version 3.",
    "Terms of the agreement are distributed to the public.",
]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def windows(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, place (of the first word), words and their lines (from 0) of every window of every text."""
    anchor = lambda w: w.isin(ANCHORS)
    texts = documents.where(F.col("text").rlike(r"[\p{L}\p{N}]")).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.transform(F.split("text", "\n"), words).alias("by_line")
    )
    texts = texts.select(
        "doc_id",
        "text_hash",
        "by_line",
        F.flatten("by_line").alias("all"),
        F.flatten(F.transform("by_line", lambda ws, i: F.array_repeat(i, F.size(ws)))).alias("line_of"),
    )
    last = F.size("all") - 1
    anchored = F.filter(F.sequence(F.lit(0), last), lambda i: anchor(F.get("all", i)))
    texts = texts.withColumn("close", F.array_distinct(F.transform(anchored, lambda i: F.greatest(F.lit(0), i - i % STEP - STEP))))
    piece = lambda at, n: F.struct(
        at.alias("place"), F.slice("all", at + 1, n).alias("words"), F.slice("line_of", at + 1, n).alias("lines")
    )
    whole = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), last - (WINDOW - STRIDE)), F.lit(STRIDE)), lambda at: piece(at, WINDOW))
    around = F.transform("close", lambda at: piece(at, CLOSE))
    begins = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get("line_of", i) != F.get("line_of", i - 1)))
    alone = F.zip_with(
        begins,
        F.filter("by_line", lambda ws: F.size(ws) > 0),
        lambda i, ws: F.struct(i.alias("place"), ws.alias("words"), F.array_repeat(F.get("line_of", i), F.size(ws)).alias("lines")),
    )
    alone = F.filter(alone, lambda r: (F.size(r["words"]) <= WINDOW) & F.exists(r["words"], anchor))
    alone = F.when(F.size("close") > 0, alone).otherwise(F.slice(alone, 1, 0))
    texts = texts.select("doc_id", "text_hash", F.explode(F.concat(whole, around, alone)).alias("w"))
    return texts.select("doc_id", "text_hash", "w.place", "w.words", "w.lines")


def notices() -> list[tuple[str, str]]:
    """Family and text of every training notice, by rule from the fixed values."""
    out = []
    for family, names in NAMES.items():
        out += [(family, f"SPDX-License-Identifier: {family}")]
        out += [(family, n.format(the=the, name=name)) for name in names for n in NOTICES for the in ("", "the ") if not (the and name.startswith("the "))]
        out += [(family, p) for p in PASSAGES.get(family, [])]
    return out


def _local(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    structs = F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("text")) for a, b in rows])
    return spark.range(1).select(F.explode(structs).alias("r")).select("r.*")


def in_prose(made: DataFrame, prose: DataFrame) -> DataFrame:
    """Family and words of every notice: alone, cut at its end or start as at the edge of a window,
    close to words of the corpus, and in the middle of a window of them."""
    bucket = lambda h: F.pmod(h, F.lit(PROSE))
    shelf = prose.groupBy(bucket(F.col("h")).alias("shelf")).agg(F.min_by("words", "h").alias("prose"))
    long = F.size("words") > LONG
    made = made.withColumn("v", F.explode(F.sequence(F.lit(0), F.when(long, VARIANTS * 3).otherwise(VARIANTS) - 1)))
    made = made.withColumns({"turn": F.xxhash64("words", "v"), "variant": F.col("v") % VARIANTS})
    n = F.size("words")
    most = F.ceil(n * (0.6 + 0.4 * F.pmod(F.xxhash64("turn", "v"), F.lit(1000)) / 1000)).cast("int")
    cut = F.when(long & (F.col("variant") == 2), F.slice("words", 1, most))
    cut = cut.when(long & (F.col("variant") == 3), F.slice("words", n - most + 1, most)).otherwise(F.col("words"))
    made = made.withColumn("shelf", bucket(F.col("turn"))).withColumn("notice", cut).join(shelf, "shelf", "left")
    room = F.when(F.col("variant") == 0, 0).when(F.col("variant") == 1, CLOSE).otherwise(WINDOW) - F.size("notice")
    room = F.greatest(F.lit(0), room)
    before = F.pmod(F.xxhash64("turn"), room + 1).cast("int")
    prose = F.coalesce("prose", F.slice("words", 1, 0))
    return made.select("family", F.concat(F.slice(prose, 1, before), "notice", F.slice(prose, before + 1, room - before)).alias("words"))


def neighbours(words_: Column) -> Column:
    """The word pairs of a word list, in order; a single word stands for itself."""
    return F.zip_with(F.slice(words_, 1, F.greatest(F.size(words_) - 1, F.lit(1))), F.slice(words_, 2, WINDOW * 4), lambda a, b: F.concat_ws(" ", a, b))


def pairs_of(words_: Column) -> Column:
    """The distinct word pairs of a word list."""
    return F.array_distinct(neighbours(words_))


def _templates(spark: SparkSession) -> DataFrame:
    """Family and word pairs of each of its templates: its names, its identifier and the passages."""
    rows = [(f, n) for f, names in NAMES.items() for n in names] + [(f, p) for f, ps in PASSAGES.items() for p in ps]
    rows += [(f, f"SPDX-License-Identifier: {f}") for f in NAMES]
    pairs = _local(spark, rows).select("family", pairs_of(words(F.col("text"))).alias("p"))
    return store(pairs.groupBy("family").agg(F.collect_list("p").alias("templates")), "license-templates")


def resemblance(pairs: Column, templates: list[list[str]]) -> Column:
    """The largest share of a template's word pairs that are present."""
    shares = [F.size(F.array_intersect(pairs, F.array(*[F.lit(x) for x in t]))) / len(t) for t in templates]
    return F.array_max(F.array(*shares))


@dataclass
class Scanner:
    model: LogisticRegressionModel
    families: list[str]
    compared: DataFrame
    temperature: float = 1.0
    offset: float = 0.0

    def logits(self, rows: DataFrame) -> DataFrame:
        out = self.model.transform(featured(rows)).withColumn("z", vector_to_array("rawPrediction"))
        return out.drop("features", "rawPrediction", "probability", "prediction", "grams")

    def named(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``words``) that are named a family: family, probability, similarity, confirmed.

        Where all families together reach ``LEAST``, the ``COMPARED`` likeliest are compared with their
        templates; an unconfirmed one is kept only if it is likelier than all else."""
        none = self.families.index(NONE)
        # Exploding a list of one keeps filters on what follows from being restated over the model.
        out = self.logits(rows).withColumn("z", F.explode(F.array("z")))
        s = F.transform("z", lambda x, i: F.exp(F.least(F.lit(500.0), x / self.temperature + F.when(i == none, self.offset).otherwise(0.0))))
        out = out.withColumn("s", F.explode(F.array(s)))
        out = out.withColumn("total", F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x))
        out = out.where(F.get("s", F.lit(none)) <= (1 - LEAST) * F.col("total"))
        likely = F.transform("s", lambda x, i: F.struct((x / F.col("total")).alias("probability"), i.alias("at")))
        likely = F.filter(likely, lambda r: r["at"] != none)
        out = out.withColumn("c", F.explode(F.slice(F.sort_array(likely, asc=False), 1, COMPARED)))
        family = F.element_at(F.array(*[F.lit(f) for f in self.families]), F.col("c.at") + 1)
        first = F.get("s", F.col("c.at")) == F.array_max("s")
        out = out.withColumns({"family": family, "probability": F.col("c.probability"), "first": first}).drop("c", "total")
        out = out.withColumn("pairs", neighbours(F.col("words"))).join(F.broadcast(self.compared), "family")
        share = lambda t: F.size(F.array_intersect("pairs", t)) / F.size(t)
        fit = F.array_max(F.transform("templates", lambda t: F.struct(share(t).alias("share"), F.size(t).alias("n"), t.alias("t"))))
        out = out.withColumn("fit", fit).drop("templates", "z", "s")
        hits = F.filter(F.sequence(F.lit(0), F.size("pairs") - 1), lambda i: F.array_contains("fit.t", F.get("pairs", i)))
        out = out.withColumn("hits", hits)
        # Where the template's pairs lie closest; common pairs also occur elsewhere.
        near = lambda i: F.filter("hits", lambda j: (j >= i) & (j < i + F.col("fit.n") * 3 / 2))
        run = F.array_max(F.transform("hits", lambda i: F.struct(F.size(near(i)).alias("n"), (-i).alias("first"), F.array_max(near(i)).alias("last"))))
        out = out.withColumn("run", run)
        begin = F.coalesce(-F.col("run.first"), F.lit(0))
        out = out.withColumns(
            {
                "similarity": F.col("fit.share"),
                "confirmed": F.col("fit.share") >= ALIKE,
                "paragraph": F.get("lines", begin),
                "start": F.col("place") + begin,
                "end": F.col("place") + F.coalesce(F.col("run.last") + 1, F.lit(0)),
            }
        )
        return out.where("confirmed OR first").drop("pairs", "fit", "hits", "run", "first")


def featured(rows: DataFrame) -> DataFrame:
    """Hashed words and word pairs of ``words``."""
    rows = rows.withColumn("grams", F.concat("words", neighbours(F.col("words"))))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(rows)


def train(documents: DataFrame) -> Scanner:
    """A scanner whose unknown class comes from ``documents``."""
    spark = documents.sparkSession
    compared = _templates(spark)
    templates = {r["family"]: r["templates"] for r in compared.collect()}
    families = sorted(NAMES) + [NONE]
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    made = _local(spark, notices() + [(NONE, t) for t in NEAR_MISSES]).select("family", words(F.col("text")).alias("words"))
    # Written, since plans over the long lists of literals take minutes to prepare.
    made = store(made, "license-notices")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    some = windows(documents.where(draw * float(max(1, documents.count())) < SAMPLED_DOCUMENTS))
    some = store(some.select("words", F.xxhash64("words").alias("h")).distinct(), "license-windows")
    unlike = resemblance(pairs_of(F.col("words")), [t for ts in templates.values() for t in ts]) < UNLIKE
    turn = F.pmod("h", F.lit(1 << 30)) / float(1 << 30) * float(max(1, some.count())) < NEGATIVES
    drawn = store(some.where(turn).where(unlike), "license-prose")
    rows = in_prose(made, drawn).unionByName(drawn.select(F.lit(NONE).alias("family"), "words"))
    rows = rows.distinct().withColumn("held", F.pmod(F.xxhash64("family", "words"), F.lit(5)) == 0)
    rows = store(rows.withColumn("label", label.cast("double")), "license-training")
    sizes = {r["family"]: r["n"] for r in rows.where("NOT held").groupBy("family").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = F.element_at(F.create_map(*[F.lit(v) for f, n in sizes.items() for v in (f, 100.0 / n * (4 if f == NONE else 1))]), F.col("family"))
    fitting = featured(rows.where("NOT held")).withColumn("weight", weight).select("features", "label", "weight")
    regression = LogisticRegression(maxIter=60, regParam=2e-4, elasticNetParam=0.5, family="multinomial", weightCol="weight", standardization=False)
    scanner = Scanner(regression.fit(fitting), families, compared)
    held = scanner.logits(rows.where("held")).select("z", "label").collect()
    scanner.temperature, scanner.offset = calibrated(np.array([r["z"] for r in held]), np.array([int(r["label"]) for r in held]), families.index(NONE))
    return scanner


def calibrated(z: np.ndarray, label: np.ndarray, none: int) -> tuple[float, float]:
    """Temperature and constant of the unknown class with the least log loss on held-out rows."""
    best = (np.inf, 1.0, 0.0)
    for temperature in (0.5, 0.7, 1.0, 1.4, 2.0):
        for offset in (-2.0, -1.0, 0.0, 1.0, 2.0):
            s = z / temperature
            s[:, none] += offset
            s = s - s.max(1, keepdims=True)
            loss = -(s[np.arange(len(s)), label] - np.log(np.exp(s).sum(1))).mean()
            best = min(best, (loss + 1e-4 * abs(offset) + 1e-4 * abs(np.log(temperature)), temperature, offset))
    return best[1], best[2]


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed of every named paragraph."""
    found = train(documents).named(windows(documents))
    best = F.struct("confirmed", "similarity", "probability")
    key = ["doc_id", "text_hash", "family"]
    found = found.groupBy(*key, "start", "paragraph").agg(F.max("end").alias("end"), F.max(best).alias("b"))
    # A family is not confirmed by words that another one's template explains better; both lie
    # within a window's length, so only a few findings are looked at.
    close = Window.partitionBy("doc_id", "text_hash").orderBy("start").rangeBetween(-WINDOW, WINDOW)
    found = found.withColumn("rivals", F.collect_set(F.struct("family", "start", "end", "b.similarity")).over(close))
    beaten = F.exists(
        "rivals",
        lambda r: (r["family"] != F.col("family"))
        & (r["similarity"] > F.col("b.similarity"))
        & (r["start"] < F.col("end"))
        & (r["end"] > F.col("start")),
    )
    found = found.withColumn("b", F.struct((F.col("b.confirmed") & ~beaten).alias("confirmed"), "b.similarity", "b.probability")).drop("rivals")
    # Findings of one family that share words are one.
    order = Window.partitionBy(*key).orderBy("start", "paragraph")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1))
    found = found.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sure = F.min(F.when(F.col("b.confirmed"), F.col("paragraph")))
    merged = found.groupBy(*key, "run").agg(F.coalesce(sure, F.min("paragraph")).alias("paragraph"), F.max("b").alias("b"))
    merged = merged.groupBy(*key, "paragraph").agg(F.max("b").alias("b"))
    return merged.select("doc_id", "paragraph", "family", "b.probability", "b.similarity", "b.confirmed")


def query(spark, folder):
    """Licence notices in all documents."""
    return scan(table(spark, folder, "documents"))
