"""Licence scan: a paragraph classifier over sparse word n-grams. DataFrame and ML functions only.

A multinomial logistic regression over hashed word 1- to 3-grams is trained on paragraphs made from the licence
statements below (with and without words around them) against paragraphs of the corpus that name no licence. A
paragraph of the corpus is classified; it counts as a licence when the probability of the best family reaches the
threshold that was calibrated on held-out training rows (else: unknown), and a comparison with the family's templates
confirms it.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlift.llm.store import written

# Statements by which works name their licence.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "under the terms of the Apache License, Version 2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                   "the License", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy "
            "of this software and associated documentation files", "Permission is hereby granted, free of charge, to any person "
            "obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
            "restriction", "SPDX-License-Identifier: MIT"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3",
            "you can redistribute it and/or modify it under the terms of the GNU General Public License",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
            "SPDX-License-Identifier: GPL-3.0-or-later"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met",
            "Released under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
                "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 License"],
    "cc-by": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "proprietary": ["All rights reserved", "No part of this work may be reproduced without written permission"],
}
# Names that are a notice if they are a whole line, perhaps with "the" before or "license" in brackets.
TITLES = {"apache-2.0": ["Apache License", "Apache License, Version 2.0"], "mit": ["MIT License"],
          "gpl": ["GNU General Public License", "GNU General Public License, version 3"],
          "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License"], "mpl-2.0": ["Mozilla Public License, v. 2.0"]}
FAMILIES = sorted(TEMPLATES)
# A notice may be wrapped: a line is also read together with up to so many lines before and after it in its paragraph.
BEFORE, AFTER = 3, 3
UNKNOWN = len(FAMILIES)
TRAIN_PARAGRAPHS = 2000  # bound of the sample of corpus paragraphs that the classifier is fitted on
FEATURES = 1 << 14
CONFIRM = 0.8
TOKEN = r"[^\p{L}\p{N}]+"


def _words(t: str) -> Column:
    return F.filter(F.split(F.lower(t), TOKEN), lambda x: x != "")


def _cues() -> str:
    """A paragraph that can be confirmed holds most words of a template, so also the rarest word of one: a word that no
    ordinary text uses often. This is the list of those words, one for each template at least."""
    return r"(?i)\b(?:licen[sc]ed?|licenses|spdx|permission|redistribut\w+|reserved|reproduced)\b"


def paragraphs(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, paragraph, t): the lines of a text that hold a word other than white space."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
                        .alias("paragraph", "t"))
    return lines.where(F.length(F.trim("t")) > 0)


def _wrapped(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, paragraph, t, alone, key): every line with a licence word, alone and in windows of its neighbours, which end at blank
    lines. ``key`` tells the rows of the table apart; ``paragraph`` is the line's number, whatever the window."""
    lines = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("key"),
                        F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"))
    near = F.expr(f"""filter(transform(lines, (x, i) -> if(x rlike r'{_cues()}', struct(i AS paragraph, least(i, {BEFORE}) AS own,
        slice(lines, greatest(i - {BEFORE}, 0) + 1, least(i, {BEFORE}) + 1 + {AFTER}) AS near), null)), r -> r IS NOT NULL)""")
    at = lines.select("id", "key", F.explode(near).alias("r")).select("id", "key", "r.*")
    sizes = F.array(*[F.struct(F.lit(x).alias("before"), F.lit(y).alias("after")) for x in range(BEFORE + 1) for y in range(AFTER + 1)])
    part = "slice(near, own - before + 1, before + after + 1)"
    return (at.select("*", F.explode(sizes).alias("w")).select("*", "w.*")
            .where("own >= before AND own + after < size(near)")
            .where(f"before + after = 0 OR NOT exists({part}, x -> length(trim(x)) = 0)")
            .selectExpr("id", "key", "paragraph", "before + after AS size", f"array_join({part}, ' ') AS t"))


def _features() -> Pipeline:
    steps, cols = [SQLTransformer(statement="SELECT *, substring(t, 1, 2147483647) AS whole FROM __THIS__"),
                   RegexTokenizer(inputCol="whole", outputCol="w1", pattern=TOKEN)], []
    for n in (1, 2, 3):
        if n > 1:
            steps.append(NGram(n=n, inputCol="w1", outputCol=f"w{n}"))
        steps.append(HashingTF(numFeatures=FEATURES, binary=True, inputCol=f"w{n}", outputCol=f"f{n}"))
        cols.append(f"f{n}")
    return Pipeline(stages=[*steps, VectorAssembler(inputCols=cols, outputCol="features")])


def training_rows(lines: DataFrame) -> DataFrame:
    """(t, label, part): licence statements alone and inside corpus paragraphs, and plain corpus paragraphs; ``part`` 0
    is held out for calibration. The corpus sample are the paragraphs with the smallest hashes among those without a
    licence word, ``TRAIN_PARAGRAPHS`` at most."""
    spark = lines.sparkSession
    plain = (lines.where(~F.col("t").rlike(_cues())).select(F.substring("t", 1, 400).alias("t"), F.xxhash64("id", "paragraph", "t").alias("h"))
             .orderBy("h", "t").limit(TRAIN_PARAGRAPHS))
    plain = written(plain.withColumn("part", F.pmod("h", F.lit(5))).withColumn("nr", F.pmod(F.shiftright("h", 8), F.lit(97))), "plain")
    rows = spark.createDataFrame([(s, float(i)) for i, f in enumerate(FAMILIES) for s in TEMPLATES[f] + TITLES.get(f, [])], "s string, label double")
    forms = rows.select("label", F.explode(F.array(F.col("s"), F.concat("s", F.lit(".")), F.lower("s"), F.upper("s"),
                                                   F.concat(F.lit("Copyright the authors. "), F.col("s"), F.lit(".")))).alias("t"))
    around = (plain.where("nr < 8").join(rows.hint("broadcast"), F.pmod(F.xxhash64("h", "s"), F.lit(4)) == 0)
              .select("label", F.concat("s", F.lit(". "), F.substring("t", 1, 120)).alias("t"), "part"))
    return (forms.select("t", "label", F.lit(1).cast("long").alias("part")).union(forms.select("t", "label", F.lit(0).cast("long")))
            .union(around.select("t", "label", "part")).union(plain.select("t", F.lit(float(UNKNOWN)), "part")))


def _best() -> list[Column]:
    p = F.slice(vector_to_array("probability"), 1, UNKNOWN)
    return [F.array_max(p).alias("probability_of_family"),
            (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("family_nr")]


def fit(lines: DataFrame):
    """(feature model, classifier, threshold): the threshold is the smallest probability, 0.5 at least, above that of
    99% of the held-out paragraphs that name no licence."""
    rows = training_rows(lines)
    prepare = _features().fit(rows)
    ready = written(prepare.transform(rows).select("features", "label", "part"), "training")
    model = LogisticRegression(maxIter=40, regParam=0.001, elasticNetParam=0.0, family="multinomial").fit(
        ready.where("part <> 0").coalesce(2))
    held = model.transform(ready.where("part = 0")).select(*_best(), "label").where(F.col("label") == UNKNOWN)
    top = held.agg(F.percentile_approx("probability_of_family", 0.99, 10000)).first()[0]
    return prepare, model, max(0.5, float(top or 0.0))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line that names a licence: id_col, paragraph (line number from 0), family, probability, similarity.

    A line is classified alone and together with its neighbours up to blank lines, as notices are wrapped; the smallest
    window that is confirmed decides, and a wrapped notice is reported at its first line with a licence word. ``similarity`` is the largest share of a template's distinct words that it holds, of
    templates of its family; it is confirmed from 0.8 on. Paragraphs below the calibrated probability, or without a confirming template, are
    of unknown licence and not returned. Null, empty and word-free texts have none; equal rows each get their rows; null ids are
    allowed; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    lines = paragraphs(docs, id_col, text)
    named = _wrapped(docs, id_col, text)
    # only what a template can confirm is classified, so the windows of a line cost little
    # (a generator between the steps keeps the words from being split anew for each template)
    named = named.select("*", F.explode(F.array(F.array_distinct(_words("t")))).alias("words"))
    named = named.select("*", F.explode(F.array(F.array(*[_similarity("words", f) for f in FAMILIES]))).alias("similar"))
    named = written(named.where(F.array_max("similar") >= CONFIRM).drop("words"), "named")
    if named.isEmpty():
        kind = docs.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"`{id_col}` {kind}, paragraph int, family string, probability double, similarity double")
    prepare, model, least = fit(lines)
    got = model.transform(prepare.transform(named)).select("id", "key", "paragraph", "size", "similar", *_best())
    got = got.where(F.col("probability_of_family") >= least)
    got = got.withColumn("similarity", F.get("similar", F.col("family_nr"))).where(F.col("similarity") >= CONFIRM)
    family = F.get(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family_nr")).alias("family")
    got = got.select("id", "key", "paragraph", "size", family, F.col("probability_of_family").alias("probability"), "similarity")
    # a line's smallest window decides; a wrapped notice is reported once, at its first line
    got = got.groupBy("id", "key", "paragraph").agg(F.min_by(F.struct("family", "probability", "similarity", "size"), F.struct(
        "size", -F.col("probability"), "family")).alias("b")).select("id", "key", "paragraph", "b.*")
    line = Window.partitionBy("id", "key", "family").orderBy("paragraph")
    first = F.lag("paragraph").over(line)
    again = (F.col("size") > 0) & F.coalesce(F.col("paragraph") - first <= BEFORE + AFTER, F.lit(False))
    return got.withColumn("again", again).where(~F.col("again")).select(F.col("id").alias(id_col), "paragraph", "family", "probability", "similarity")


def _similarity(words: str, family: str) -> Column:
    """The largest share of a template's distinct words, 1 for a line that is one of the family's titles."""
    shares = [F.size(F.array_intersect(F.col(words), bag)) / F.size(bag)
              for bag in (F.array_distinct(_words(F.lit(s))) for s in TEMPLATES[family])]
    plain = F.filter(words, lambda x: x != "the")
    for s in TITLES.get(family, []):
        shares.append(F.when((F.col("size") == 0) & (plain == F.array_distinct(_words(F.lit(s)))), 1.0).otherwise(0.0))
    return F.greatest(*shares)
