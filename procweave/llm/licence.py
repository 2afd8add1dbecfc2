"""Licence scan: a trained paragraph classifier over word n-grams, confirmed against templates. SQL and ML columns only.

A passage (a paragraph, or a window of a long one) is given to a logistic regression over hashed word n-grams whose classes are
licence families and ``unknown``. Families stand if the probability of all together passes a threshold calibrated on passages with a
cue and no template and if the passage holds enough of one of a family's templates; families other than the most probable also
need their name, or a whole template, in the passage. Every template has a cue word, so only passages with a cue can be
confirmed, and only those are scored; all texts are searched for cues as a whole.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.llm.common import numbered, settle, table

#: Fixed: licence families with their names and a few sentences of each.
FAMILIES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 license", "Apache-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "BSD-3-Clause"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "CC0-1.0": ["Creative Commons CC0 1.0 Universal public domain dedication", "CC0 1.0", "CC0-1.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPLv3", "GPL-3.0"],
    "ISC": ["ISC License", "ISC"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0"],
    "MIT": ["MIT License", "MIT licence terms", "MIT"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"],
}
SENTENCES = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version"],
}
PATTERNS = ["Licensed under {}", "Licensed under the {}", "Released under the {}", "This work is licensed under the {}", "This software is distributed under the terms of the {}", "Available under the {}", "SPDX-License-Identifier: {}"]
NO_FAMILY = ["See the license file for details", "This work is licensed under the terms agreed with the publisher", "All rights reserved. No license is granted", "A driving license is required", "The license fee is due each year", "Released under the cover of darkness", "Permission to enter was granted", "Distributed to the public", "License"]
UNKNOWN = "unknown"
#: Fixed: every template holds a word that begins so.
CUES = "(?i)licen[cs]|spdx|permission|redistribution|under the|under cc"
#: Fixed: what a list of licences begins with, as word pairs.
LEADS = ["licensed under", "released under", "distributed under", "available under", "license identifier"]
WINDOW, STEP = 48, 24
NAMES = [UNKNOWN, *FAMILIES]


def _rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(a).alias("family"), F.lit(t).alias("passage")) for a, t in rows])
    return spark.range(1).select(F.explode(pairs).alias("r")).select("r.*")


def templates() -> list[tuple[str, str]]:
    stated = [(f, p.format(n)) for f, names in FAMILIES.items() for n in names for p in PATTERNS]
    return stated + [(f, s) for f, sentences in SENTENCES.items() for s in sentences]


def words(passage: str) -> str:
    """SQL for the lower-case words of a passage; a dot inside a word or number is kept."""
    return f"array_remove(split(regexp_replace(lower({passage}), '\\\\.(?![0-9])', ' '), '[^0-9a-z.]+'), '')"


def _bigrams(ws: str) -> str:
    return f"array_distinct(CASE WHEN size({ws}) < 2 THEN {ws} ELSE transform(sequence(1, size({ws}) - 1), i -> concat_ws(' ', {ws}[i - 1], {ws}[i])) END)"


def _grams(passages: DataFrame) -> DataFrame:
    """Adds ``ws``, its distinct ``bigrams``, and ``grams`` of one to three words for the classifier."""
    triples = "CASE WHEN size(ws) < 3 THEN array() ELSE transform(sequence(2, size(ws) - 1), i -> concat_ws(' ', ws[i - 2], ws[i - 1], ws[i])) END"
    return passages.withColumn("ws", F.expr(words("passage"))).withColumn("bigrams", F.expr(_bigrams("ws"))).withColumn("grams", F.concat("ws", "bigrams", F.expr(triples)))


def passages(docs: DataFrame, cued: bool) -> DataFrame:
    """``docs`` (rid, text) cut to ``rid, line, at, passage``: lines, long ones as overlapping windows; with or without a cue."""
    has = F.col("text").rlike(CUES)
    lines = docs.filter(has if cued else F.col("text").isNotNull()).select("rid", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    lines = lines.filter(has if cued else ~has).withColumn("parts", F.split(F.trim("text"), r"[\x20\x09-\x0D]+"))
    windows = f"transform(sequence(0, greatest(0, size(parts) - {WINDOW - STEP} - 1) DIV {STEP}), k -> struct(CAST(k * {STEP} AS INT) AS at, array_join(slice(parts, CAST(k * {STEP} + 1 AS INT), {WINDOW}), ' ') AS passage))"
    out = lines.select("rid", "line", F.explode(F.expr(windows)).alias("w")).select("rid", "line", "w.at", "w.passage")
    return out.filter(F.col("passage").rlike(CUES)) if cued else out


def _known(spark: SparkSession) -> DataFrame:
    """Per family: ``forms`` (word pairs of its templates), ``names`` (words between blanks). The templates are a fixed list."""
    forms = _grams(_rows(spark, templates())).groupBy("family").agg(F.collect_set("bigrams").alias("forms"))
    named = _rows(spark, [(f, n) for f, names in FAMILIES.items() for n in names]).withColumn("ws", F.expr(words("passage")))
    return forms.join(named.groupBy("family").agg(F.collect_set("ws").alias("names")), "family")


LIKENESS = "aggregate(forms, 0D, (a, f) -> greatest(a, size(array_intersect(f, bigrams)) / size(f)))"


def train(docs: DataFrame, features: int = 1 << 14) -> tuple[PipelineModel, float]:
    """The classifier and its threshold, from the templates and all distinct passages with a cue and no template.

    ``docs`` (rid, text). Two thirds of the passages, by a hash, are examples of no family; over the others the threshold is the 99th percentile of the
    families' probability, and 0.5 at least. Passages without a cue are never scored, so none is an example; statements are also put
    between the first words of four of them.
    """
    spark = docs.sparkSession
    stated = settle(_rows(spark, templates()))
    # All forms of all families as one row.
    forms = _grams(stated).agg(F.collect_set("bigrams").alias("forms"))
    every = passages(docs, cued=True).filter("passage <> ''").select("passage").distinct()
    cued = settle(_grams(every).crossJoin(F.broadcast(forms)).filter(F.expr(LIKENESS) < 0.75).select("passage", F.xxhash64("passage").alias("h")))
    plain = passages(docs, cued=False).filter("passage <> ''").select("passage", F.xxhash64("passage").alias("h"))
    # The first by their hash: every task keeps a short list, so no passage is shuffled.
    context = settle(plain.orderBy("h", "passage").limit(64).distinct().orderBy("h", "passage").limit(4).select(F.concat_ws(" ", F.slice(F.split("passage", " "), 1, 8)).alias("before")))
    mixed = stated.crossJoin(F.broadcast(context)).select("family", F.concat_ws(" ", "before", "passage").alias("passage"))
    apart = _rows(spark, [(UNKNOWN, s) for s in NO_FAMILY])
    none = cued.filter("pmod(h, 3) > 0").select(F.lit(UNKNOWN).alias("family"), "passage").unionByName(apart)
    examples = _grams(stated.unionByName(mixed).unionByName(none))
    label = F.array_position(F.array(*map(F.lit, NAMES)), F.col("family")) - 1
    ready = settle(examples.select(label.cast("double").alias("label"), "grams"))
    steps = [HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True), LogisticRegression(maxIter=60, regParam=1e-4, family="multinomial")]
    model = Pipeline(stages=steps).fit(ready)
    held = model.transform(_grams(cued.filter("pmod(h, 3) = 0").join(apart.select("passage"), "passage", "left_anti")))
    bar = held.select((1 - vector_to_array("probability")[0]).alias("b")).agg(F.percentile_approx("b", 0.99, 10_000)).first()[0]
    return model, max(0.5, bar or 0.5)


def classify(docs: DataFrame, model: PipelineModel, threshold: float, least: float = 0.75) -> DataFrame:
    """``docs`` (rid, text): per passage with a cue and family ``rid, line, at, passage, family, probability, likeness, confirmed``.

    Each passage has a row of its most probable family, and of others that are confirmed. ``likeness`` is the share of the nearest
    template of the family whose word pairs stand in the passage; a name in a list of licences needs no template around it.
    """
    spark = docs.sparkSession
    scored = model.transform(_grams(passages(docs, cued=True))).withColumn("p", vector_to_array("probability"))
    best = F.expr("array_max(slice(p, 2, size(p)))")
    top = F.element_at(F.array(*map(F.lit, NAMES)), F.array_position(F.expr("slice(p, 2, size(p))"), best).cast("int") + 1)
    scored = scored.select("rid", "line", "at", "passage", "ws", "bigrams", "p", top.alias("top"), (1 - F.col("p")[0] >= threshold).alias("passed"))
    rank = F.array_position(F.array(*map(F.lit, NAMES)), F.col("family")).cast("int")
    each = scored.join(F.broadcast(_known(spark)), (F.col("family") == F.col("top")) | F.col("passed")).withColumn("likeness", F.expr(LIKENESS))
    stands = "instr(concat(' ', array_join(ws, ' '), ' '), concat(' ', array_join(m, ' '), ' ')) > 0"
    each = each.withColumn("named", F.expr(f"exists(names, m -> {stands})"))
    # One word may be a name of something else, so it needs its template.
    listed = F.expr(f"exists(names, m -> size(m) > 1 AND {stands})") & F.arrays_overlap("bigrams", F.array(*map(F.lit, LEADS)))
    holds = (F.col("likeness") >= least) & ((F.col("family") == F.col("top")) | F.col("named") | (F.col("likeness") >= 1)) | listed
    each = each.withColumn("confirmed", F.col("passed") & holds).filter("family = top OR confirmed")
    return each.select("rid", "line", "at", "passage", "family", F.element_at("p", rank).alias("probability"), "likeness", "confirmed")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``rid``, the id, ``families`` (sorted, comma-joined), ``n_confirmed`` and ``n_unknown`` lines, and the best ``probability``.

    Lines whose cue leads to no confirmed family count as unknown. Texts that are null or without a cue have no families and no
    counts; rows with equal ids are separate. Very long texts are searched and cut in windows as a whole. Of families with equal probability the
    first in the alphabet counts as the most probable one. Other columns are not read, whatever their names; an empty table gives no rows.
    """
    source = numbered(docs, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model, threshold = train(source)
    lines = classify(source, model, threshold).groupBy("rid", "line").agg(
        F.max("confirmed").alias("confirmed"), F.max(F.when(F.col("confirmed"), F.col("probability"))).alias("probability"),
        F.collect_set(F.when(F.col("confirmed"), F.col("family"))).alias("families"),
    )
    found = settle(lines.groupBy("rid").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))).alias("families"), F.sum(F.col("confirmed").cast("long")).alias("yes"),
        F.sum((~F.col("confirmed")).cast("long")).alias("no"), F.max("probability").alias("probability"),
    ))
    return source.select("rid", "id").join(found, "rid", "left").select(
        "rid", F.col("id").alias(id_col), F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"),
        F.coalesce("yes", F.lit(0)).alias("n_confirmed"), F.coalesce("no", F.lit(0)).alias("n_unknown"), "probability",
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("rid")
