"""Licence detection in paragraphs with a trained classifier and template comparison.

Every paragraph with a word is classified by a sparse (elastic-net)
logistic regression over hashed word n-grams, trained on variants of the templates below and on
paragraphs of the corpus. A family counts if its probability reaches the calibrated
threshold and if one of its templates' word pairs are largely in the paragraph; what looks like a licence otherwise
is ``unknown``. All of it is DataFrame functions and Spark's own ML.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.common import stored

NONE, UNKNOWN = "none", "unknown"
#: Notices as licences and their usual headers word them.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright by the author, all rights reserved.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
    ],
}
#: Sentences with such words that grant or reserve nothing.
OTHER = [
    "He lost his driver's license after the accident.",
    "The board will license new teachers in the spring.",
    "The copyright debate continued in parliament for years.",
    "Public domain characters are popular in films.",
    "Her pilot licence was renewed last week without warranty questions.",
    "The shop sells software and license plates.",
    "They asked permission to enter the building and it was granted.",
    "A marriage license is issued by the county.",
    "The fishing licence costs ten pounds a year.",
    "Their licence to trade was revoked.",
    "Critics say copyright terms are too long.",
    "The warranty on the car has expired.",
]
FEATURES, VARIANTS, MIN_PROBABILITY, MIN_SIMILARITY = 1 << 13, 20, 0.5, 0.6


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once, not for each element of the arrays in f."""
    return F.transform(F.array(value), f).getItem(0)


def pairs(own: Column) -> Column:
    """Different pairs of neighbouring words; a single word is a pair with nothing."""
    return _bound(
        own, lambda a: F.array_distinct(F.transform(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1))), lambda w, i: F.concat_ws(" ", w, F.get(a, i + 1))))
    )


def grams(own: Column) -> Column:
    return _bound(own, lambda a: F.array_distinct(F.concat(a, pairs(a))))


def _literal_rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("paragraph")) for a, b in rows]))
    return spark.range(1).select(each.alias("x")).select("x.*")


def training_set(corpus: DataFrame, max_negatives: int) -> DataFrame:
    """(family, words, held): template variants with words left out, and paragraphs that are none.

    ``corpus``: (doc_id, text); about ``max_negatives`` documents, drawn by the hash of both, give negatives.
    """
    spark = corpus.sparkSession
    rows = [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [(NONE, t) for t in OTHER]
    base = _literal_rows(spark, rows).withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    base = base.withColumn("words", words(F.col("paragraph")))
    # variant 0 is whole; others lack each word with one chance in twelve
    lacks = F.filter("words", lambda w, i: (F.col("variant") == 0) | (F.pmod(F.hash(w, i, "variant"), F.lit(12)) > 0))
    made = base.select("family", lacks.alias("words"), (F.col("variant") % 5 == 4).alias("held"))
    share = min(1.0, max_negatives / max(1, corpus.count()))
    chosen = corpus.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))))
    plain = chosen.select(F.explode(F.split("text", r"[\n\r]+")).alias("paragraph"))
    negative = plain.select(F.lit(NONE).alias("family"), words(F.col("paragraph")).alias("words"), (F.crc32(F.col("paragraph").cast("binary")) % 5 == 4).alias("held"))
    negative = negative.where(similarity(pairs(F.col("words"))) < MIN_SIMILARITY)  # the others may be notices
    return made.unionAll(negative.repartition(1)).where(F.size("words") > 0)  # about ``max_negatives`` documents' paragraphs


class Classifier:
    """The fitted regression and its calibrated threshold."""

    def __init__(self, corpus: DataFrame, max_negatives: int = 500):
        self.families = [NONE, *TEMPLATES]
        self.hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features")
        rows = training_set(corpus, max_negatives).withColumn("grams", grams(F.col("words")))
        label = F.array_position(F.lit(self.families), F.col("family")) - 1
        rows = stored(rows.withColumn("label", label.cast("double")), "licence_training").coalesce(1)
        fitting = LogisticRegression(maxIter=30, regParam=0.0005, elasticNetParam=0.5, family="multinomial")
        self.model: LogisticRegressionModel = fitting.fit(self.hashing.transform(rows.where("not held")).select("features", "label"))
        held = self._probabilities(rows.where("held AND family = 'none'"))
        top = held.agg(F.percentile("best", F.lit(0.999))).first()[0]
        self.threshold = max(MIN_PROBABILITY, top or 0.0)

    def _probabilities(self, rows: DataFrame) -> DataFrame:
        """``rows`` (grams) with family, best (its probability, of those that are no ``none``) and none."""
        scored = self.model.transform(self.hashing.transform(rows))
        of = F.transform(vector_to_array("probability"), lambda p, i: F.struct(F.when(i > 0, p).otherwise(-1.0).alias("p"), i.alias("i")))
        best = F.array_max(of)
        return scored.withColumns({"_best": best, "none": F.get(vector_to_array("probability"), F.lit(0))}).withColumns(
            {"best": F.col("_best.p"), "family": F.get(F.lit(self.families), F.col("_best.i"))}
        )

    def classified(self, rows: DataFrame) -> DataFrame:
        """``rows`` (grams) with family, probability and none."""
        kept = rows.columns
        return self._probabilities(rows).select(*kept, F.col("family").alias("_family"), F.col("best").alias("_probability"), F.col("none").alias("_none"))


def similarity(own_pairs: Column, family: Column | None = None) -> Column:
    """Largest share of a template, of the family or of any, whose word pairs are among the given ones."""

    def among(own):
        best = F.lit(0.0)
        for name, texts in TEMPLATES.items():
            shares = []
            for t in texts:
                target = pairs(words(F.lit(t)))
                shares.append(F.size(F.array_intersect(own, target)) / F.size(target))
            best = F.greatest(best, *shares) if family is None else F.when(family == name, F.greatest(F.lit(0.0), *shares)).otherwise(best)
        return best

    return _bound(own_pairs, among)


def scan(docs: DataFrame, max_negatives: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, notice, licence, family, probability, similarity) of each paragraph with a licence.

    ``paragraph``: its number in the text, from 0, lines without text counted; ``notice``: its
    text; ``licence``: the family, or ``unknown`` where the threshold or the templates
    don't confirm it; of equally likely families the last one named in TEMPLATES. Null and empty texts and paragraphs that are no licence give no row; identical rows give
    identical rows; an empty table gives none. Further columns aren't read.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    classifier = Classifier(own, max_negatives)
    lines = own.select("doc_id", F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("paragraph", "notice"))
    named = lines.withColumn("_words", words(F.col("notice"))).where(F.size("_words") > 0)
    named = named.withColumns({"grams": grams(F.col("_words")), "_pairs": pairs(F.col("_words"))})
    found = classifier.classified(named).where("_none < 0.5").withColumn("_similarity", similarity(F.col("_pairs"), F.col("_family")))
    sure = (F.col("_probability") >= classifier.threshold) & (F.col("_similarity") >= MIN_SIMILARITY)
    return found.select(
        "doc_id",
        "paragraph",
        "notice",
        F.when(sure, F.col("_family")).otherwise(UNKNOWN).alias("licence"),
        F.col("_family").alias("family"),
        F.col("_probability").alias("probability"),
        F.col("_similarity").alias("similarity"),
    )
