import math
import re

import pytest

from postlytics.llm import licenses

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return licenses.fit_licences(spark.read.parquet(f"{TABLES}/documents.parquet"))


def test_notices_in_prose(spark, model):
    rows = [
        (1, "Some prose here.\nReleased under the MIT License. More prose follows.\nAll rights reserved."),
        (2, "He had a license to fish and the rights to the river, by permission of the king."),
        (3, "You may obtain a copy. Licensed under the Apache License, Version 2.0 (the License) now."),
        (4, "This work is licensed under the GNU General Public License, version 3."),
        ((1 << 53) + 1, "Licensed under CC BY-NC 4.0."),
        (6, None),
        (7, ""),
        (8, "All rights reserved."),
        (8, "All rights reserved."),
        (None, "Licensed under the Frobozz licence of the great underground empire"),
    ]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, family string, probability double")
    found = licenses.find_licences(docs, model)
    assert sorted((r.doc_id, r.paragraph, r.sentence, r.family) for r in found.collect()) == [
        (1, 1, 0, "MIT"),
        (1, 2, 0, "all-rights-reserved"),
        (3, 0, 1, "Apache-2.0"),
        (4, 0, 0, "GPL-3.0"),
        (8, 0, 0, "all-rights-reserved"),
        (8, 0, 0, "all-rights-reserved"),
        ((1 << 53) + 1, 0, 0, "CC-BY-NC-4.0"),
    ]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert licenses.find_licences(docs.limit(0), model).count() == 0


def test_planted_notices_are_all_found(spark, model):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    lines = [line for r in docs.collect() for line in (r.text or "").split("\n")]
    planted = sum(line.count(t) for line in lines for family in licenses.TEMPLATES.values() for t in family[:1])
    found = licenses.find_licences(docs, model).collect()
    assert len(found) == planted > 0
    everywhere = licenses.find_licences(docs, model, anchors=()).filter("family <> 'unknown'")
    assert sorted(map(str, everywhere.collect())) == sorted(map(str, found))


def test_other_families_are_unknown(spark, model):
    wanted = {
        "Licensed under the Mozilla Public License 2.0.": "unknown",
        "Licensed under the ISC license.": "unknown",
        "This is in the public domain": "unknown",
        "Licensed under the GNU Lesser General Public License, version 3.": "unknown",
        "Licensed under the GPLv3 or later.": "GPL-3.0",
        "CC-BY 4.0": "CC-BY-4.0",
        "Die Software steht unter der MIT-Lizenz": "MIT",
        "SPDX-License-Identifier: MIT": "MIT",
        "The driver lost his driving licence in May.": None,
    }
    docs = spark.createDataFrame(list(enumerate(wanted)), "doc_id long, text string")
    found = {r.body: r.family for r in licenses.find_licences(docs, model).collect()}
    assert found == {text: family for text, family in wanted.items() if family}


def test_wrapped_notice_is_one_row(spark, model):
    notice = "This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version."
    long = "word " * 200_000 + "\n" + notice + "\n" + " \n" * 200_000
    found = licenses.find_licences(spark.createDataFrame([(1, long)], "doc_id long, text string"), model).collect()
    assert [(r.paragraph, r.sentence, r.family, r.overlap) for r in found] == [(1, 0, "GPL-3.0", 1.0)]


def test_scores_are_the_models(spark, model):
    """Probabilities from coefficients, word by word; ties go to the first family."""
    table, logit = model.stages.stages
    weights, shift = logit.coefficientMatrix.toArray(), logit.interceptVector.toArray()
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    found = licenses.find_licences(docs, model).collect()
    for body, family, probability in {(r.body, r.family, r.probability) for r in found}:
        words = [w for w in re.split(r"[\W_]+", body.lower()) if w]
        grams = {*words, *(" ".join(pair) for pair in zip(words, words[1:]))}
        slots = sorted({table.indexOf(g) for g in grams})
        score = [math.exp(shift[y] + sum(weights[y, s] for s in slots)) for y in range(len(shift))]
        names = [*model.families, *["?"] * len(score)][: len(score)]
        best = names[score.index(max(score))]
        share = 1 - score[names.index("none")] / sum(score) if family == "unknown" else max(score) / sum(score)
        assert (family == "unknown" or best == family) and probability == pytest.approx(share)


def test_odd_documents(documents, nothing, model):
    assert licenses.find_licences(documents, model).count() == 0
    untaught = licenses.fit_licences(nothing)
    assert licenses.find_licences(nothing, untaught).count() == 0
    assert {r.family for r in licenses.find_licences(documents, untaught).collect()} <= set(licenses.TEMPLATES)


def test_sentences_without_an_anchor_are_scored(spark, model):
    cut = "any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
    docs = spark.createDataFrame([(1, "Some prose here.\n" + cut + "\nMore of this. And more.")], "doc_id long, text string")
    assert not any(a in cut.lower() for a in licenses.ANCHORS)
    assert [r.body for r in licenses.paragraphs(docs).orderBy("paragraph", "sentence").collect()] == ["Some prose here.", cut, "More of this.", "And more."]
    assert [(r.paragraph, r.sentence) for r in licenses.find_licences(docs, model).collect()] == [(1, 0)]
