"""License scans (operator 1): a trained paragraph classifier, in DataFrame functions and Spark's own logistic regression.

Paragraphs (lines) that mention a licence word are candidates; all others are class unknown. A sparse multinomial
logistic regression over hashed word n-grams names a candidate's family. It answers unknown below a probability that is
calibrated on held-out paragraphs, and its answer counts only if the paragraph's word trigrams match a template of the
family.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqedge.llm.common import cut, or_empty, quoted, table

UNKNOWN = "unknown"
# Notices of each family.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "This project is available under the Apache 2.0 license."],
    "MIT": ["Released under the MIT License.", "This software is distributed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version.",
            "You should have received a copy of the GNU General Public License along with this program.", "Released under the GPL v3."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "You can redistribute this library and/or modify it under the terms of the GNU Lesser General Public License.", "Released under the LGPL v3."],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License.", "Released under the AGPL v3."],
    "BSD": ["Released under the BSD License.", "Licensed under the 3-Clause BSD License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "This is free and unencumbered software released into the public domain."],
    "proprietary": ["Copyright. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
# Sentences that mention licence words and grant nothing.
OTHERS = [
    "She renewed her driving license at the office last week.", "The restaurant lost its liquor license after the inspection.", "Copyright law was debated in parliament for two years.",
    "The washing machine comes with a warranty of two years.", "The fishing license costs twenty euros per season.", "The court ruled that the license fee had to be repaid.",
    "Students from MIT visited the laboratory in spring.", "The Apache tribes lived in the south of the continent.", "An Apache helicopter landed near the river.",
    "The mozilla conference was held in the old town.", "A creative commons for artists opened in the market hall.", "The public domain of the city includes parks and squares.",
    "He was given license to speak on behalf of the council.", "The minister asked how many licenses were issued in the north.", "A free software course starts in the autumn.",
    "The general public is invited to the opening of the museum.", "Taxes redistribute income between regions.", "The publisher printed copies of the book in permanent ink.",
    "The warranty does not cover the battery of the phone.", "The copyright office moved to a new building.", "Their license plate was found near the road.",
    "The licensed trade employs many people in this region.", "The version of the story that she told was different.", "Permission to enter the building was refused.",
]
#: A paragraph without any of these is unknown.
ANCHOR = (r"(?i)licen[sc]|copyright|copyleft|warrant|redistribut|public domain|rights reserved|creative commons|permission|proprietary|"
          r"\b(?:mit|apache|mozilla|bsd|l?gpl|agpl|cc0|cc[ -]by|spdx)\b")
FEATURES, CROP, SIMILAR = 1 << 13, 8, 0.5
#: Of held-out paragraphs that are no licence, so many must stay below the calibrated probability.
SPECIFICITY = 0.99


def words(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), "[^a-z0-9]+"), lambda w: w != "")


def grams(w: Column, n: int) -> Column:
    """The word n-grams; a shorter paragraph is one gram."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))


def terms(w: Column) -> Column:
    return F.concat(w, F.when(F.size(w) > 1, grams(w, 2)).otherwise(F.array().cast("array<string>")), F.when(F.size(w) > 2, grams(w, 3)).otherwise(F.array().cast("array<string>")))


def training_rows(spark: SparkSession) -> DataFrame:
    """(id, label, w): every template and every other sentence, whole, in crops of at least CROP words, and between
    words of the others. The rows are fixed by the lists above."""
    families = [*TEMPLATES, UNKNOWN]
    lines = [(float(k), t) for k, f in enumerate(families) for t in TEMPLATES.get(f, OTHERS)]
    base = spark.createDataFrame(lines, "label double, line string").select("label", "line", words(F.col("line")).alias("w"))
    crops = base.filter(F.size("w") > CROP).select("label", "line", F.explode(F.sequence(F.lit(1), F.size("w") - CROP + 1)).alias("at"), "w").select("label", "line", F.slice("w", F.col("at"), CROP).alias("w"))
    crops = crops.filter(F.array_join("w", " ").rlike(ANCHOR))
    # Mixed rows: a line after and before four words of some other sentence.
    others = F.array(*[words(F.lit(x)) for x in OTHERS])
    mixed = base.select("label", "line", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"), "w").withColumn(
        "x", F.element_at(others, (F.pmod(F.xxhash64("line", "i"), F.lit(len(OTHERS))) + 1).cast("int")))
    mixed = mixed.select("label", "line", F.when(F.col("i") % 3 == 0, F.concat("w", F.slice("x", 1, 4))).when(F.col("i") % 3 == 1, F.concat(F.slice("x", 1, 4), F.col("w"))).otherwise(
        F.concat(F.slice("x", 1, 3), F.col("w"), F.slice("x", 4, 3))).alias("w"))
    rows = base.select("label", "line", "w").unionByName(crops).unionByName(mixed)
    return rows.select(F.xxhash64("line", "w").alias("id"), "label", "w")


def train(spark: SparkSession):
    """(model, families, least probability): fitted on three quarters of the rows; of the held-out others, SPECIFICITY
    stay below the least probability for a family."""
    families = [*TEMPLATES, UNKNOWN]
    rows = cut(training_rows(spark).select("id", "label", terms(F.col("w")).alias("terms")), "license-train")
    rows = HashingTF(inputCol="terms", outputCol="features", numFeatures=FEATURES, binary=True).transform(rows).coalesce(2).cache()
    held = F.pmod("id", F.lit(4)) == 0
    model = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.2, maxIter=30).fit(rows.filter(~held))
    p = vector_to_array("probability")
    scored = model.transform(rows.filter(held & (F.col("label") == len(families) - 1))).select(F.array_max(F.slice(p, 1, len(families) - 1)).alias("p"))
    least = max(0.5, scored.agg(F.coalesce(F.percentile("p", F.lit(SPECIFICITY)), F.lit(0.5)).alias("p")).first()["p"])
    rows.unpersist()
    return model, families, least


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, key, n_paragraphs, line, family, probability, similarity): each candidate paragraph with its line number
    from 0, or one row without a line where a document has none. ``family`` is unknown unless calibrated and confirmed."""
    model, families, least = train(docs.sparkSession)
    t = or_empty(quoted(text))
    lines = F.split(t, "\n")
    candidates = F.when(t.rlike(ANCHOR), F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("x"))), lambda s: s["x"].rlike(ANCHOR)))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), quoted(key).alias("key"), F.size(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_paragraphs"),
                       candidates.alias("c"))  # a row's number is taken before its candidates are exploded
    rows = rows.select("uid", "key", "n_paragraphs", F.explode_outer("c").alias("c")).select("uid", "key", "n_paragraphs", "c.line", "c.x")
    rows = rows.withColumn("w", words(or_empty(F.col("x")))).withColumn("terms", terms(F.col("w")))
    scored = model.transform(HashingTF(inputCol="terms", outputCol="features", numFeatures=FEATURES, binary=True).transform(rows))
    p = F.slice(vector_to_array("probability"), 1, len(families) - 1)
    scored = scored.withColumn("p", F.array_max(p)).withColumn("guess", F.element_at(F.array(*[F.lit(f) for f in families]), F.array_position(p, F.array_max(p)).cast("int")))
    tri = F.array_distinct(grams(F.col("w"), 3))
    alike = lambda line: F.size(F.array_intersect(tri, F.array_distinct(grams(words(F.lit(line)), 3)))) / F.least(F.size(tri), F.size(F.array_distinct(grams(words(F.lit(line)), 3))))
    similarity = reduce(lambda rest, f: F.when(F.col("guess") == f, F.greatest(F.lit(0.0), *[alike(x) for x in TEMPLATES[f]])).otherwise(rest), TEMPLATES, F.lit(0.0))
    scored = scored.withColumn("similarity", F.when(F.col("line").isNotNull(), similarity))
    sure = F.col("line").isNotNull() & (F.col("p") >= least) & (F.col("similarity") >= SIMILAR)
    return scored.select("uid", F.col("key").alias(key), "n_paragraphs", "line", F.when(F.col("line").isNotNull(), F.when(sure, F.col("guess")).otherwise(UNKNOWN)).alias("family"),
                         F.when(F.col("line").isNotNull(), F.col("p")).alias("probability"), "similarity")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: key, n_paragraphs, n_candidates, n_license, licenses (families, sorted, comma-joined; empty if none).

    Null and empty texts have no paragraphs; repeated rows and equal or null keys are scanned one by one; an empty table
    gives no rows; other columns play no part.
    """
    found = F.when(F.col("family") != UNKNOWN, F.col("family"))
    return paragraphs(docs, key, text).groupBy("uid", key, "n_paragraphs").agg(
        F.count("line").alias("n_candidates"), F.count(found).alias("n_license"), F.array_join(F.array_sort(F.collect_set(found)), ",").alias("licenses")).drop("uid")


def op1_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
