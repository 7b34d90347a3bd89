"""Licence scan by a trained paragraph classifier, in DataFrame functions and Spark ML.

A sparse logistic regression over word n-grams names the licence family of a paragraph or
calls it unknown; the probability it must reach is calibrated on held-out unknown paragraphs. A
prediction counts once the paragraph shares enough word pairs with a template of that family.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
FEATURES = 3000  # n-grams that training knows
VARIANTS, SHORT_VARIANTS, SHORT = 24, 6, 6  # of each template in the training rows; words of a short one
ORDINARY = 2000  # paragraphs of the corpus that show the unknown class, half of them with a cue
WINDOW, STEP = 48, 24  # words
FALSE_RATE = 0.005
COVERAGE, PAIRS = 0.6, 3  # share and number of common word pairs; a shorter text needs all it has
UNLIKE = 0.3  # paragraphs with a lower coverage by every template show the unknown class
FOLLOWING, LINE_CHARS = 12, 600  # lines that a window may run on to, and what is read of each
WORD = r"[a-z0-9]+(?:[.+'-][a-z0-9]+)*\+?"

# Sentences by which licences are announced or that their texts are made of.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License, see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under "
        "the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Distributed under the terms of the GNU GPL version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free "
        "Software Foundation",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the "
        "LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ],
    "CC0-1.0": [
        "Dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
        "International License.",
    ],
    "CC-BY-NC-ND": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
        "International License.",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 "
        "International License.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced or distributed without "
        "the prior written permission of the publisher.",
        "This software is proprietary and confidential; unauthorized copying is prohibited.",
    ],
}
# Short names and identifiers of the families, and how notices use them.
NAMES = {
    "MIT": ["MIT"], "Apache-2.0": ["Apache-2.0", "Apache 2.0", "Apache Version 2.0"],
    "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL v3", "GPLv3", "GNU GPL v3"],
    "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL v2", "GPLv2", "GNU GPL v2"],
    "LGPL": ["LGPL-2.1", "LGPL-3.0", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "GNU LGPL", "LGPLv3"],
    "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL v3", "AGPLv3", "GNU AGPL v3"],
    "BSD": ["BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD 2-Clause", "BSD 3-Clause", "New BSD", "Simplified BSD"],
    "MPL-2.0": ["MPL-2.0", "MPL 2.0", "Mozilla Public 2.0"], "ISC": ["ISC"],
    "CC0-1.0": ["CC0-1.0", "CC0 1.0", "CC0"], "CC-BY": ["CC-BY-4.0", "CC BY 4.0", "CC-BY"],
    "CC-BY-SA": ["CC-BY-SA-4.0", "CC BY-SA 4.0", "CC-BY-SA"],
    "CC-BY-NC": ["CC-BY-NC-4.0", "CC BY-NC 4.0", "CC-BY-NC"],
    "CC-BY-NC-SA": ["CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0", "CC-BY-NC-SA"],
    "CC-BY-NC-ND": ["CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0", "CC-BY-NC-ND"],
    "CC-BY-ND": ["CC-BY-ND-4.0", "CC BY-ND 4.0", "CC-BY-ND"],
}
NOTICES = ["SPDX-License-Identifier: {}", "{} License", "{} licensed", "Licensed under {}", "Licensed under the {}",
           "under the {} License", "License: {}", "released under {}"]
TITLES = {"Apache-2.0": ["Apache License Version 2.0, January 2004"],
          "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU GPL v3", "GPLv3"],
          "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GNU GPL v2", "GPLv2"],
          "LGPL": ["GNU LESSER GENERAL PUBLIC LICENSE"], "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3"],
          "MPL-2.0": ["Mozilla Public License Version 2.0"], "MIT": ["The MIT License (MIT)"]}
# Sentences with the same words that grant nothing.
ORDINARY_SENTENCES = [
    "The driver had to show a valid license at the border.",
    "A fishing licence costs more in the summer than in the winter.",
    "She studied copyright law before she moved to the city.",
    "The bar lost its license to sell alcohol last year.",
    "The warranty of the machine ended after two years.",
    "The public domain of the lake is open to all visitors.",
    "They wrote a book about the history of copyright and its reform.",
    "License plates in this country are blue and white.",
    "The version of the story that he told was different.",
    "The conditions of the road were met with patience.",
    "The software was sold with a manual and a warranty card.",
    "The company licensed its patents to a rival for a fee.",
]
#: A paragraph without any of these words is unknown; each template has at least one.
CUES = (r"(?i)licen[cs]|copyright|\b[al]?gpl|redistribut|warrant|permission|public domain|all rights|"
        r"free software|cc0|proprietary|public licen|creative commons|source code|\bcc[ -]by|released under")


@dataclass(frozen=True)
class LicenceModel:
    pipeline: PipelineModel
    labels: list[str]
    threshold: float


def _rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    cells = [F.struct(F.lit(a).alias("family"), F.lit(b).alias("text")) for a, b in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))


def template_texts() -> list[tuple[str, str]]:
    """Family and text: sentences, titles, and notices with every short name."""
    named = [(k, notice.format(name)) for k, names in NAMES.items() for name in names for notice in NOTICES]
    return [(k, t) for group in (TEMPLATES, TITLES) for k, ts in group.items() for t in ts] + named


def templates(spark: SparkSession) -> DataFrame:
    return _rows(spark, template_texts())


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def pairs(ws: Column) -> Column:
    """Neighbouring words."""
    return F.filter(F.transform(ws, lambda w, i: F.concat_ws(" ", w, F.get(ws, i + 1))),
                    lambda g: g.contains(" "))


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, line, start, words``: windows that start in a line that holds a cue.

    A window is read as it stands in its line, and run on over the next lines of its paragraph, up
    to a blank line, so that a hard-wrapped notice is read whole; long lines are read in overlapping windows, so that a
    notice inside does not get lost among other words. Every line of every whole text is
    looked at. A window without a cue is no licence by definition.
    """
    lines = F.split("text", "\n")
    rest = F.slice("lines", F.col("at.line") + 2, FOLLOWING)
    blank = F.array_position(F.transform(rest, lambda t: F.trim(t) == ""), F.lit(True))
    rest = F.transform(F.when(blank > 0, F.slice(rest, F.lit(1), blank.cast("int") - 1)).otherwise(rest),
                       lambda t: F.substring(t, 1, LINE_CHARS))
    cued = F.filter(F.transform("lines", lambda t, i: F.struct(i.alias("line"), t.alias("text"))),
                    lambda r: r["text"].rlike(CUES))
    found = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
             .where(F.col("text").rlike(CUES)).select("doc_id", lines.alias("lines"))
             .select("doc_id", "lines", F.explode(cued).alias("at"))
             .select("doc_id", "at.line", words(F.col("at.text")).alias("own"),
                     words(F.array_join(rest, " ")).alias("next")))
    starts = F.sequence(F.lit(0), F.greatest(F.size("own") - 1, F.lit(0)), F.lit(STEP))
    window = lambda ws: F.slice(ws, F.col("start") + 1, WINDOW)
    return (found.withColumn("start", F.explode(starts))
            .withColumn("words", F.explode(F.array_distinct(F.array(
                window(F.col("own")), window(F.concat("own", "next"))))))
            .where((F.col("start") == 0) | (F.size("words") > WINDOW - STEP))
            .where(F.array_join("words", " ").rlike(CUES)).drop("own", "next"))


def _common(known: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Templates with their pairs, and number and share of the pairs that a text has in common."""
    own = _with_grams(known.withColumn("words", words(F.col("text")))).select(
        F.col("family").alias("known"), F.col("text").alias("template"), F.col("pairs").alias("own"),
        F.col("words").alias("own_words"))
    # a single word is compared as it stands
    both = F.when((F.size("own") == 0) | (F.size("pairs") == 0),
                  (F.col("words") == F.col("own_words")).cast("int")).otherwise(
        F.size(F.array_intersect("pairs", "own")))
    shorter = F.greatest(F.least(F.size("pairs"), F.size("own")), F.lit(1))
    return own, both, both / shorter


def training_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``family, words, held_out``: varied templates, and ordinary paragraphs as unknown.

    A variant drops a tenth of a template's words and, every other one, stands between other
    words. Unknown are the fixed sentences and two samples of the corpus, ``ORDINARY`` / 2 each at
    most: lines without a cue, and windows as they get scored that are unlike every template.
    """
    many = F.when(F.size(words(F.col("text"))) <= SHORT, SHORT_VARIANTS).otherwise(VARIANTS)
    known = templates(spark).withColumn("variant", F.explode(F.sequence(F.lit(0), many - 1)))
    dropped = F.filter(words(F.col("text")), lambda w, i: (F.col("variant") < 4) | (F.pmod(
        F.xxhash64(w, i, F.col("variant"), F.col("text")), F.lit(10)) > 0))
    plain = _rows(spark, [(UNKNOWN, t) for t in ORDINARY_SENTENCES])
    plain = plain.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    # about as many documents, by a hash of their ids
    share = int(1e6 * min(1.0, ORDINARY / max(docs.count(), 1)))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) <= share)

    def drawn(rows: DataFrame) -> DataFrame:
        return (rows.withColumn("draw", F.xxhash64("words")).dropDuplicates(["draw"]).orderBy("draw")
                .limit(ORDINARY // 2).select(F.lit(UNKNOWN).alias("family"), "words",
                                             F.pmod("draw", F.lit(1024)).cast("int").alias("variant")))

    lines = (some.select(F.explode(F.split("text", "\n")).alias("text"))
             .where((F.length("text") > 0) & ~F.col("text").rlike(CUES))
             .select(F.slice(words(F.col("text")), 1, WINDOW).alias("words")).where(F.size("words") > 0))
    windows = _with_grams(paragraphs(some).select("words").distinct()).withColumn("w", F.xxhash64("words"))
    own = _with_grams(templates(spark).withColumn("words", words(F.col("text")))).select(
        F.col("text").alias("template"), F.size("pairs").alias("n"), F.explode("pairs").alias("pair"))
    like = (windows.select("w", F.size("pairs").alias("size"), F.explode("pairs").alias("pair"))
            .join(F.broadcast(own), "pair").groupBy("w", "template")
            .agg((F.count(F.lit(1)) / F.max(F.least("n", "size"))).alias("coverage"))
            .where(F.col("coverage") >= UNLIKE))
    unlike = windows.join(like, "w", "left_anti").select("words")
    filler = F.slice(words(F.lit(" ".join(ORDINARY_SENTENCES))),
                     F.pmod(F.xxhash64("variant", "text"), F.lit(60)).cast("int") + 1, 12)
    varied = known.unionByName(plain).withColumn("words", dropped).withColumn(
        "words", F.when(F.col("variant") % 2 == 1, F.concat(filler, "words")).otherwise(F.col("words")))
    out = varied.select("family", "words", "variant").unionByName(drawn(lines)).unionByName(drawn(unlike))
    return out.select("family", "words", (F.pmod("variant", F.lit(4)) == 2).alias("held_out"))


def _with_grams(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pairs", F.array_distinct(pairs(F.col("words")))).withColumn(
        "grams", F.concat(F.array_distinct("words"), "pairs"))


def _probable(model: PipelineModel, labels: list[str], rows: DataFrame) -> DataFrame:
    """Most probable family other than unknown, and its probability."""
    p = vector_to_array("probability")
    known = [F.struct(F.get(p, i).alias("probability"), F.lit(x).alias("family"))
             for i, x in enumerate(labels) if x != UNKNOWN]
    out = model.transform(rows).withColumn("best", F.greatest(*known))
    return out.withColumn("family", F.col("best.family")).withColumn("p", F.col("best.probability"))


def fit(spark: SparkSession, docs: DataFrame) -> LicenceModel:
    """Train on a bounded number of rows and calibrate on those held out."""
    rows = _with_grams(training_rows(spark, docs)).persist()
    indexer = StringIndexer(inputCol="family", outputCol="label",
                            stringOrderType="alphabetAsc").fit(rows)
    model = Pipeline(stages=[
        CountVectorizer(inputCol="grams", outputCol="features", vocabSize=FEATURES, minDF=4,
                        binary=True),
        LogisticRegression(maxIter=30, regParam=2e-4, elasticNetParam=1.0, family="multinomial"),
    ]).fit(indexer.transform(rows.where(~F.col("held_out"))))
    unknown = _probable(model, indexer.labels, rows.where(F.col("held_out") & (F.col("family") == UNKNOWN))
                        .drop("family"))
    bound = unknown.agg(F.percentile_approx("p", 1 - FALSE_RATE, 10_000)).first()[0]
    rows.unpersist()
    return LicenceModel(model, list(indexer.labels), max(0.5, bound or 0.0))


def scan(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """Licences found: ``doc_id, line, family, probability, template, coverage``.

    ``line`` counts from 0 (where the notice's window starts), ``template`` is the sentence that confirmed the family and ``coverage``
    the share of common word pairs in the shorter of both. A line may name several families.
    Null and empty texts hold none; rows with a null id are reported under null; a repeated row
    counts once. Other columns are ignored.
    """
    found = (_probable(model.pipeline, model.labels, _with_grams(paragraphs(docs)))
             .where(F.col("p") >= model.threshold).select("doc_id", "line", "family", "p", "pairs", "words"))
    own, common, coverage = _common(templates(docs.sparkSession))
    least = F.least(F.lit(PAIRS), F.greatest(F.least(F.size("pairs"), F.size("own")), F.lit(1)))
    # the templates are the fixed values above
    confirmed = (found.join(F.broadcast(own), F.col("family") == F.col("known"))
                 .withColumn("common", common).withColumn("coverage", coverage)
                 .where((F.col("common") >= least) & (F.col("coverage") >= COVERAGE)))
    best = F.max(F.struct("coverage", "common", "template"))
    return (confirmed.groupBy("doc_id", "line", "family")
            .agg(F.max("p").alias("probability"), best.alias("best"))
            .select("doc_id", "line", "family", "probability", F.col("best.template").alias("template"),
                    F.col("best.coverage").alias("coverage")))
