"""Licence scan with a trained paragraph classifier (op 10), in DataFrame functions only.

A paragraph is a line with a word.  Its features are the hashed word bigrams
that occur in the licence templates, present or not; a multinomial logistic
regression (``pyspark.ml``) tells the licence families and the class "unknown"
apart.  Training rows are the templates with part of their bigrams dropped and
ordinary paragraphs mixed in, and for "unknown" ordinary paragraphs of a
bounded sample and small fragments of templates.  On held-out rows a
temperature is fitted and the least probability is set at which an unknown
paragraph passes with a rate of at most ``FALSE_RATE``.  A prediction stands
only if the paragraph has enough of a template of the predicted family.

A paragraph without any template bigram has the score of the intercepts, which
is below that probability, so only the others are scored; the features are few.

Cases: a null or empty text has no paragraphs; rows that repeat doc_id and text
get one result; an empty table gives no rows (the model is then trained on the templates alone).
"""

from __future__ import annotations

import json
import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlab.llm.common import once, saved

UNKNOWN = "unknown"
SAMPLE_DOCS = 2_000  # documents whose paragraphs train "unknown", about
SAMPLE_PARAGRAPHS = 3_000
COVERAGE = 0.6  # of a template's bigrams
FALSE_RATE = 0.005
TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)

#: The usual notices of the licence families.
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
             "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
             "Licensed under the GNU Affero General Public License, version 3."],
    "apache": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "Licensed under the Apache License, Version 2.0."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met:", "Released under the BSD 3-Clause License."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "Licensed under CC BY-SA 4.0."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "This work is licensed under the GNU General Public License, version 3."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
             "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
             "Licensed under the GNU Lesser General Public License, version 3."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction.", "Released under the MIT License."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "Licensed under the Mozilla Public License, version 2.0."],
    "public-domain": ["This is free and unencumbered software released into the public domain.",
                      "Released into the public domain under CC0 1.0."],
}


def _grams(rows: DataFrame, line: str, out: str) -> DataFrame:
    """``rows`` with the hashes of the word bigrams of column ``line``; lower-cased letters and digits make words."""
    words = rows.withColumn("_w", F.filter(F.split(F.lower(line), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))
    n = F.size("_w")
    hashes = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.xxhash64(F.col("_w")[i], F.col("_w")[i + 1]))
    return words.withColumn(out, F.when(n >= 2, hashes).otherwise(F.array().cast("array<bigint>"))).drop("_w")


def templates(spark: SparkSession) -> DataFrame:
    """(family, tid, grams) of the templates."""
    rows = [{"family": f, "tid": f"{f}-{i}", "line": t} for f, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    kind = "array<struct<family:string,tid:string,line:string>>"
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), kind)).alias("x")).select("x.*")
    return _grams(table, "line", "grams").drop("line")


def paragraphs(docs: DataFrame, vocabulary: list[int]) -> DataFrame:
    """(doc_id, th, no, hit): the lines that have a template bigram, with those they have."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    known = F.lit(json.dumps(vocabulary))
    vocab = docs.sparkSession.range(1).select(F.from_json(known, "array<bigint>").alias("vocab"))  # of the templates
    rows = _grams(lines, "line", "grams").crossJoin(F.broadcast(vocab))
    return rows.select("doc_id", "th", "no", once(F.array_intersect("grams", "vocab")).alias("hit")).where(F.size("hit") > 0)


def _kept(seed: str, share: float) -> Column:
    """``grams`` without a part of them that the hash of (row, bigram, seed) picks."""
    return F.filter("grams", lambda g: F.pmod(F.xxhash64(F.col("rid"), g, F.lit(seed)), F.lit(1000)) < int(1000 * share))


def training_rows(docs: DataFrame, tpl: DataFrame, vocabulary: list[int], copies: int = 40,
                  sample_docs: int = SAMPLE_DOCS, sample: int = SAMPLE_PARAGRAPHS) -> DataFrame:
    """(family, hit): template bigrams of labelled paragraphs."""
    share = max(1, min(1_000_000, round(1_000_000 * sample_docs / max(1, docs.count()))))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    found = paragraphs(some, vocabulary).select("hit")
    # Ordinary paragraphs: those that hold no template as the template check sees it.
    whole = tpl.agg(F.collect_list("grams").alias("all"))
    plain = found.crossJoin(F.broadcast(whole)).where(~F.exists("all", lambda t: F.size(F.array_intersect("hit", t)) >= COVERAGE * F.size(t)))
    plain = plain.select("hit").orderBy(F.xxhash64("hit"), "hit").limit(sample)
    plain = saved(plain.select("hit", (F.monotonically_increasing_id()).alias("pid")), "licence-plain")
    n = plain.count()
    more = tpl.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("rid", F.xxhash64("tid", "copy"))
    # Most of a template, some of it with an ordinary paragraph around; and fragments that are no notice.
    notice = more.select("family", "rid", "copy", _kept("most", 0.85).alias("hit"))
    piece = more.where("copy % 4 = 0").select(F.lit(UNKNOWN).alias("family"), "rid", "copy", _kept("few", 0.25).alias("hit"))
    if n:
        at = F.row_number().over(Window.orderBy("pid")) - 1  # at most ``sample`` rows
        beside = plain.withColumn("slot", at).select("slot", F.col("hit").alias("other"))
        mixed = notice.where("copy % 2 = 0").withColumn("slot", F.pmod("rid", F.lit(n)).cast("int")).join(beside, "slot")
        mixed = mixed.select("family", "rid", "copy", F.array_union("hit", "other").alias("hit"))
        notice = notice.where("copy % 2 = 1").union(mixed)
    plain = plain.select(F.lit(UNKNOWN).alias("family"), F.xxhash64("pid").alias("rid"), F.lit(0).alias("copy"), "hit")
    empty = plain.sparkSession.range(20).select(F.lit(UNKNOWN).alias("family"), F.xxhash64("id").alias("rid"), F.lit(0).alias("copy"),
                                                F.array().cast("array<bigint>").alias("hit"))
    return notice.union(piece).union(plain).union(empty).select("family", "rid", "hit")


class LicenceModel:
    """Sparse weights per bigram, intercepts, temperature and the least probability of a family."""

    def __init__(self, families, vocabulary, weights, intercepts, temperature, least):
        self.families, self.vocabulary, self.weights = families, vocabulary, weights
        self.intercepts, self.temperature, self.least = intercepts, temperature, least

    def row(self, spark: SparkSession) -> DataFrame:
        """The model as a table of one row: weights as a map from bigram to one number per class."""
        table = {"weights": [{"g": v, "w": w} for v, w in zip(self.vocabulary, self.weights) if any(w)], "intercepts": self.intercepts}
        kind = "struct<weights:array<struct<g:bigint,w:array<double>>>,intercepts:array<double>>"
        one = spark.range(1).select(F.from_json(F.lit(json.dumps(table)), kind).alias("m"))
        return one.select(F.map_from_entries("m.weights").alias("weights"), "m.intercepts")

    def scores(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``hit``) with the class scores."""
        one = self.row(rows.sparkSession)  # one row, bounded by the templates
        add = F.aggregate("hit", F.col("intercepts"), lambda a, g: F.when(F.map_contains_key("weights", g), F.zip_with(
            a, F.element_at("weights", g), lambda x, y: x + y)).otherwise(a))
        return rows.crossJoin(F.broadcast(one)).select(*rows.columns, once(add).alias("scores"))


def _log_sum(temperature: float, top: Column) -> Column:
    return F.log(F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp((s - top) / temperature)))


def _best(families: list[str]) -> Column:
    """The highest score of a family; the class "unknown" comes first."""
    return F.array_max(F.slice("scores", 2, len(families) - 1))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LicenceModel:
    spark = docs.sparkSession
    tpl = templates(spark)
    vocabulary = sorted({g for r in tpl.collect() for g in r.grams})  # a few hundred bigrams of the templates
    families = [UNKNOWN, *sorted(TEMPLATES)]
    vocab = F.from_json(F.lit(json.dumps(vocabulary)), "array<bigint>")
    label = F.element_at(F.map_from_arrays(F.array(*map(F.lit, families)), F.array(*[F.lit(float(i)) for i in range(len(families))])), F.col("family"))
    rows = training_rows(docs, tpl, vocabulary, sample_docs=sample_docs).withColumn("label", label)
    rows = saved(rows.withColumn("held", F.pmod(F.xxhash64("rid", F.lit("held")), F.lit(4)) == 0), "licence-training")
    dense = F.transform(vocab, lambda v: F.array_contains("hit", v).cast("double"))
    lr = LogisticRegression(maxIter=60, regParam=1e-3, elasticNetParam=0.5, standardization=False, family="multinomial")
    fit = lr.fit(rows.where("not held").select("label", array_to_vector(dense).alias("features")).repartition(4))
    weights = [[round(float(x), 6) for x in col] for col in fit.coefficientMatrix.toArray().T]
    weights += [[0.0] * len(families)] * (len(vocabulary) - len(weights))
    classes = len(fit.interceptVector)
    weights = [w + [0.0] * (len(families) - classes) for w in weights]
    intercepts = [float(x) for x in fit.interceptVector] + [-30.0] * (len(families) - classes)
    model = LicenceModel(families, vocabulary, weights, intercepts, 1.0, 0.5)
    held = saved(model.scores(rows.where("held")), "licence-held")
    top, own = F.array_max("scores"), F.get("scores", F.col("label").cast("int"))
    losses = held.agg(*[F.avg(_log_sum(t, top) - (own - top) / t).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).first()
    model.temperature = min(zip(losses, TEMPERATURES))[1] if losses[0] is not None else 1.0
    passed = F.exp(-_log_sum(model.temperature, _best(families)))
    q = held.where("label = 0").agg(F.percentile_approx(passed, 1 - FALSE_RATE, 10_000)).first()[0]
    model.least = min(0.95, max(0.5, math.ceil((q or 0.0) * 1000) / 1000))
    return model


def licences(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """(doc_id, th, no, family, probability) of every paragraph that is a licence notice."""
    spark = docs.sparkSession
    rows = model.scores(paragraphs(docs, model.vocabulary))
    best = _best(model.families)
    names = F.array(*map(F.lit, model.families))
    family = F.get(names, (F.array_position("scores", best) - 1).cast("int"))
    rows = rows.select("doc_id", "th", "no", "hit", family.alias("family"), F.exp(-_log_sum(model.temperature, best)).alias("probability"))
    rows = rows.where((F.col("probability") >= model.least) & (F.col("family") != UNKNOWN))
    tpl = templates(spark).groupBy("family").agg(F.collect_list("grams").alias("templates"))  # a dozen rows
    rows = rows.join(F.broadcast(tpl), "family")
    enough = F.exists("templates", lambda t: F.size(F.array_intersect("hit", t)) >= COVERAGE * F.size(F.array_distinct(t)))
    return rows.where(enough).select("doc_id", "th", "no", "family", "probability")


def licence_scan(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """(doc_id, n_paragraphs, n_licence, licences, probability) for every row; licences: sorted families, comma-joined."""
    docs = docs.select("doc_id", "text")
    model = model or train(docs)
    found = licences(docs, model).groupBy(F.col("doc_id").alias("i"), F.col("th").alias("t")).agg(
        F.countDistinct("no").alias("n_licence"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("licences"),
        F.max("probability").alias("probability"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != "")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(lines).cast("long").alias("n_paragraphs"))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))
    return rows.join(found, same, "left").select(
        "doc_id", "n_paragraphs", F.coalesce("n_licence", F.lit(0)).cast("long").alias("n_licence"),
        F.coalesce("licences", F.lit("")).alias("licences"), "probability")


def op10_licence_scan(docs: DataFrame) -> DataFrame:
    return licence_scan(docs)
