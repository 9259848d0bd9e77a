"""Licence notices by a trained paragraph classifier, confirmed by templates.

All by DataFrame functions and Spark's own learners: paragraphs are turned into sparse
word n-grams, and a multinomial logistic regression names the family, an unknown one, or none.
What it names must also share its n-grams, and the words that only that family's
templates have, with a template; notices that fail this are of an unknown family.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlytics.sources.staging import cut_lineage

NONE, UNKNOWN = "none", "unknown"
# How notices of each family read.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "Lizenziert unter der MIT-Lizenz.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "Lizenziert unter der Apache-Lizenz, Version 2.0.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPLv3 or later.",
        "GPL version 3",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "BSD": [
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}
# How notices of some other families read.
OTHERS = [
    "Licensed under the Mozilla Public License 2.0.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Licensed under the ISC license.",
    "Licensed under the GNU Lesser General Public License, version 2.1.",
    "Licensed under the GNU Lesser General Public License, version 3.",
    "Licensed under the GNU Affero General Public License, version 3.",
    "Licensed under the GNU General Public License, version 2.",
    "Licensed under the Eclipse Public License 2.0.",
    "Licensed under the zlib license.",
    "Licensed under CC BY-ND 4.0.",
    "Licensed under CC BY-NC-SA 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Dedicated to the public domain under CC0 1.0 Universal.",
    "This work is in the public domain.",
    "This is free and unencumbered software released into the public domain.",
    "SPDX-License-Identifier: MPL-2.0",
    "Distributed under the terms of its own licence, see the file COPYING.",
]
#: What sentences are told apart by before they are learnt from, so that prose with one is: stems of the words that templates are about, in some languages, and short names.
ANCHORS = (
    "licen", "lizen", "copyright", "\u00a9", "copyleft", "rights", "redistribut", "permission", "warrant", "gnu", "gpl", "cc by", "cc-by", "cc0",
    "creative commons", "public domain", "domaine public", "dominio p", "gemeinfrei", "spdx", "derechos", "droits", "rechte vorbehalten",
)
#: A line that goes on where the one before broke off, with the signs of a comment.
WRAP = r"(?<![.!?:;\s])\r?\n[ \t*#/]*+(?=[a-z(\"])"
#: Where sentences end.
SENTENCE = r"(?<=[a-z]{3}[.!?])\s+|(?<=[0-9][.])\s+"
#: About so many paragraphs of the corpus are learnt from as being none.
SAMPLE = 4_000
FEATURES = 1 << 14
ROUNDS = 30
#: Held-out paragraphs named at this probability or more must be right this often.
PRECISION = 0.98
#: Share of the shorter side's n-grams that a paragraph and a template have in common, and of the template's own words.
OVERLAP, OWN = 0.5, 0.75
#: Prose with an anchor that shares less than this with every template is learnt from as being none.
FAR = 0.2
#: Notices of made-up families for each template of at most so many words.
MADE_UP, SHORT = 12, 14


def _words(text) -> F.Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _grams(words) -> F.Column:
    """Words, and pairs of them."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.array_distinct(F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words))


def paragraphs(docs: DataFrame, anchors: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, paragraph, sentence, body): sentences of ``docs``, by paragraph and place in it, from 0.

    A paragraph is a line with the lines that go on in the middle of its sentence. All sentences are given, or those
    with one of ``anchors`` if there are any.
    """
    whole = F.regexp_replace("text", WRAP, " ")
    lines = docs.filter(_anchored("text", anchors)).select("doc_id", F.posexplode(F.split(whole, "\n")).alias("paragraph", "line"))
    parts = lines.select("doc_id", "paragraph", F.posexplode(F.split("line", SENTENCE)).alias("sentence", "body"))
    return parts.filter(_anchored("body", anchors))


def _templates(spark: SparkSession) -> DataFrame:
    """(family, words, own): templates with the words that no other family's templates have."""
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    # Fixed and few: in one partition they are grouped and joined without shuffles.
    said = spark.createDataFrame(rows, "family string, body string").coalesce(1).select("family", "body", _words(F.col("body")).alias("words"))
    word = said.select("body", "family", F.explode(F.array_distinct("words")).alias("word"))
    alone = word.withColumn("families", F.size(F.collect_set("family").over(Window.partitionBy("word")))).filter("families = 1 AND word RLIKE '[a-z]'")
    own = alone.groupBy("body").agg(F.sort_array(F.collect_set("word")).alias("own"))
    return said.join(own, "body", "left").select("family", "words", F.coalesce("own", F.array().cast("array<string>")).alias("own"))


def _others(spark: SparkSession) -> DataFrame:
    """(family, words): notices of other families."""
    said = spark.createDataFrame([(text,) for text in OTHERS], "body string").coalesce(1)
    return said.select(F.lit(UNKNOWN).alias("family"), _words(F.col("body")).alias("words"))


def _made_up(spark: SparkSession) -> DataFrame:
    """(family, words): notices of other families, and of families that do not exist, by other words for a template's own."""
    short = _templates(spark).filter((F.size("words") <= SHORT) & (F.size("own") > 0)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(MADE_UP))))
    # Words of the draw's own making, for one of the template's own words at least.
    sure = F.get("own", F.pmod("draw", F.size("own")))
    other = F.transform(
        "words",
        lambda w: F.when(F.array_contains("own", w) & ((w == sure) | (F.pmod(F.xxhash64(w, "draw"), F.lit(2)) == 0)), F.concat(F.lit("x"), F.hex(F.pmod(F.xxhash64(w, "draw"), F.lit(1 << 20))))).otherwise(w),
    )
    return _others(spark).unionByName(short.select(F.lit(UNKNOWN).alias("family"), other.alias("words")))


def _notices(spark: SparkSession) -> DataFrame:
    """One row: all notices that are learnt from, fixed and few, as ``_overlap`` takes them."""
    notices = _templates(spark).select("words").unionByName(_made_up(spark).select("words")).select(_grams(F.col("words")).alias("grams"))
    return notices.agg(F.collect_set(F.struct("grams", F.array().cast("array<string>").alias("own"))))


def _template_cuts(spark: SparkSession) -> DataFrame:
    """(family, words): templates, and their beginnings and ends of six words and more, as notices are often cut."""
    n = F.size("words")
    cut = _templates(spark).withColumn("k", F.explode(F.when(n > 6, F.sequence(F.lit(6), n)).otherwise(F.array(n))))
    ends = F.array(F.slice("words", 1, F.col("k")), F.slice("words", n - F.col("k") + 1, F.col("k")))
    return cut.select("family", F.explode(ends).alias("words"))


def _anchored(column: str, anchors: tuple[str, ...] = ANCHORS) -> F.Column:
    if not anchors:
        return F.col(column).isNotNull()
    return reduce(or_, [F.contains(F.lower(column), F.lit(a)) for a in anchors])


@dataclass
class LicenceModel:
    """Least probabilities from which on a family, and a notice of whatever family, are named."""

    stages: PipelineModel
    families: list[str]
    least: float
    least_notice: float


def _share(column: str, share: float) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(column), 1) <= F.lit(min(int(share * 2**63), 2**63 - 1))


def _overlap(templates: str, grams: str) -> F.Column:
    """Greatest share of n-grams in common with a template whose own words are there, 0 if there is none."""

    def one(t: F.Column) -> F.Column:
        shared = F.size(F.array_intersect(t["grams"], F.col(grams))) / F.least(F.size(t["grams"]), F.size(grams)).cast("double")
        own = F.size(F.array_intersect(t["own"], F.col(grams))) >= OWN * F.size(t["own"])
        # A cut template need not have its own words, if all of it is there.
        return F.when(own | (shared >= 1), shared).otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(templates, one)), F.lit(0.0))


def fit_licences(docs: DataFrame, sample: int = SAMPLE) -> LicenceModel:
    """Train on the templates and about ``sample`` sentences of ``docs`` (text), chosen by a hash from whole texts.

    One in five examples is held out; the least probability for naming a family that a template confirms, or
    any notice, is the smallest at which the held-out ones named are right often enough. If none is, that is
    an error. Without any text there is no class of none, and nothing is of an unknown family.
    """
    spark = docs.sparkSession
    ends = _template_cuts(spark).unionByName(_made_up(spark))
    texts = docs.filter("text IS NOT NULL").select("text")
    drawn_texts = texts.filter(_share("text", min(1.0, sample / max(1, texts.count()))))
    said = drawn_texts.select(F.explode(F.split(F.regexp_replace("text", WRAP, " "), "\n|" + SENTENCE)).alias("body")).distinct()
    said = cut_lineage(said.select("body", _words(F.col("body")).alias("words")).filter(F.size("words") > 0), "sentences")
    quiet, loud = said.filter(~_anchored("body")), said.filter(_anchored("body"))
    none = quiet.filter(_share("body", min(1.0, sample / max(1, quiet.count())))).select(F.lit(NONE).alias("family"), "words")
    # An anchor in prose is no notice: each of the quiet sentences also stands with one.
    anchors = F.array(*[F.lit(a) for a in ("license", "licence", "copyright", "rights", "permission", "licensed", "warranty")])
    drawn = F.get(anchors, F.pmod(F.xxhash64("words"), F.lit(7)))
    hard = none.filter(F.size("words") > 3).select("family", F.concat(F.slice("words", 1, 3), F.array(drawn), F.slice("words", 4, 10)).alias("words"))
    # So does prose that has an anchor and is far from all notices.
    notices = _notices(spark)
    far = loud.filter(_share("body", min(1.0, sample / max(1, loud.count())))).withColumn("grams", _grams(F.col("words")))
    far = far.withColumn("templates", notices.scalar()).filter(_overlap("templates", "grams") < FAR).select(F.lit(NONE).alias("family"), "words")
    examples = ends.unionByName(none).unionByName(hard).unionByName(far).filter(F.size("words") > 0)
    # What several families say, such as the beginnings of their templates, tells none of them; whole templates are always learnt.
    whole = _templates(spark).select("words").unionByName(_others(spark).select("words")).agg(F.collect_set("words"))
    several = examples.groupBy("words").agg(F.min("family").alias("family"), F.count_distinct("family").alias("families"))
    examples = several.filter("families = 1").drop("families").withColumn("grams", _grams(F.col("words")))
    drawn = (F.pmod(F.xxhash64("words"), F.lit(5)) == 0) & ~F.array_contains("whole", F.col("words"))
    examples = cut_lineage(examples.withColumn("whole", whole.scalar()).withColumn("held", drawn).drop("whole"), "examples")
    # Families weigh alike, however many cuts their templates have.
    sizes = examples.groupBy("family").agg((F.lit(1.0) / F.count("*")).alias("weight"))
    examples = examples.join(F.broadcast(sizes), "family")
    learnt = examples.filter("NOT held")
    index = StringIndexer(inputCol="family", outputCol="label", handleInvalid="keep", stringOrderType="alphabetAsc").fit(examples)
    stages = [
        HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True),
        LogisticRegression(maxIter=ROUNDS, regParam=1e-4, family="multinomial", weightCol="weight"),
    ]
    fitted = Pipeline(stages=stages).fit(index.transform(learnt))
    model = LicenceModel(fitted, list(index.labels), 0.0, float("inf"))
    held = _compared(_named(examples.filter("held"), model)).select("family", "named", "probability", "notice", "overlap")
    held = cut_lineage(held, "held_out")
    model.least = _least(held.filter(F.col("overlap") >= OVERLAP), "probability", F.col("named") == F.col("family"))
    if NONE in model.families:
        model.least_notice = _least(held, "notice", F.col("family") != NONE)
    return model


def _least(held: DataFrame, column: str, right: F.Column) -> float:
    """The least value of ``column``, 0.5 at least, from which on held-out examples are ``right`` often enough."""
    down = Window.orderBy(F.desc(column))
    kept = held.groupBy(column).agg(F.sum(right.cast("int")).alias("right"), F.count("*").alias("n"))
    precise = kept.select(column, (F.sum("right").over(down) / F.sum("n").over(down)).alias("precision"))
    least = precise.filter(F.col("precision") >= PRECISION).agg(F.min(column)).first()[0]
    if least is None:
        raise ValueError(f"no {column} at which {PRECISION:.0%} of the held-out examples are named rightly")
    return max(0.5, float(least))


def _named(examples: DataFrame, model: LicenceModel) -> DataFrame:
    """``examples`` (words, grams) with the likeliest known family, its probability, and that of any notice."""
    scored = model.stages.transform(examples.withColumn("label", F.lit(0.0))).withColumn("p", vector_to_array("probability"))
    names = F.array(*[F.lit(f) for f in model.families])
    best = F.array_max(F.transform("p", lambda x, i: F.struct(x.alias("p"), (-i).alias("at"))))
    family = F.get(names, -F.col("best")["at"])
    none = F.get("p", F.lit(model.families.index(NONE))) if NONE in model.families else F.lit(1.0)
    # Generated, so that filters on them do not bring all of the above before each of their own mentions.
    scored = scored.select(*examples.columns, F.inline(F.array(F.struct("p"))))
    scored = scored.select(*examples.columns, F.inline(F.array(F.struct(best.alias("best"), (1 - none).alias("notice")))))
    known = ~family.isin(NONE, UNKNOWN)
    return scored.withColumns({"named": F.when(known, family), "probability": F.when(known, F.col("best")["p"])}).drop("best")


def _compared(named: DataFrame) -> DataFrame:
    """``named`` with the overlap of its rows with the templates, fixed and few, of the family they are named."""
    templates = _templates(named.sparkSession).groupBy(F.col("family").alias("named"))
    templates = templates.agg(F.collect_list(F.struct(_grams(F.col("words")).alias("grams"), "own")).alias("templates"))
    return named.join(F.broadcast(templates), "named", "left").withColumn("overlap", _overlap("templates", "grams"))


def find_licences(docs: DataFrame, model: LicenceModel, anchors: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, paragraph, sentence, family, probability, overlap, body): licence notices of ``docs`` (doc_id, text).

    A known family's ``probability`` is the classifier's, its ``overlap`` the share of n-grams in common
    with its nearest template; both must be high enough. Any other sentence that is surely a notice, and has an anchor or
    enough in common with a notice that was learnt from, is of
    family ``unknown``, with the probability that it is a notice and the overlap with the likeliest known family, or 0. Ties of
    probability go to the first family in alphabetic order. NULL and empty texts
    have none; texts are read whole; repeated rows get equal rows, an empty table
    none; further columns are not read.
    """
    said = paragraphs(docs.select("doc_id", "text"), anchors).withColumn("words", _words(F.col("body"))).filter(F.size("words") > 0)
    likely = _named(said.withColumn("grams", _grams(F.col("words"))), model)
    likely = likely.filter((F.col("probability") >= model.least) | (F.col("notice") >= model.least_notice))
    both = _compared(likely)
    known = (F.col("probability") >= model.least) & (F.col("overlap") >= OVERLAP)
    known = F.coalesce(known, F.lit(False))
    near = _anchored("body") | (_overlap("notices", "grams") >= OVERLAP)
    both = both.withColumn("notices", _notices(docs.sparkSession).scalar()).filter(known | ((F.col("notice") >= model.least_notice) & near))
    family = F.when(known, F.col("named")).otherwise(UNKNOWN)
    probability = F.when(known, F.col("probability")).otherwise(F.col("notice"))
    place = [F.col("paragraph").cast("long"), F.col("sentence").cast("long")]
    return both.select("doc_id", *place, family.alias("family"), probability.alias("probability"), "overlap", "body")
