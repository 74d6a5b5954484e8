"""License scans: a trained paragraph classifier, in DataFrame expressions and JVM estimators only.

Paragraphs (lines) become sparse word 1-grams and 2-grams; a multinomial logistic regression with L1 names the
licence family, `unknown` (a licence that is none of the families') or `none`. It is trained here: on parts of the
templates below, on statements made from the families' names, for `unknown` on the same statements about other
licences, and for `none` on statements about other things and a bounded sample of the corpus's own lines. A first fit
leaves out whole names, with all that is made of them, and two whole families; the threshold on the probability is
calibrated on these, so that families it doesn't know become `unknown`. A second fit has everything. Comparison with
the family's names and, by word 3-grams, with its templates confirms what passes the threshold, or makes it `unknown`.

Only words of the templates and names, other than everyday ones, count as evidence; a paragraph without any has no
features and is `none` whatever the model, so such paragraphs never leave the scan.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import materialize

#: Bound on the corpus lines that join the training table, by a hash of the line.
SAMPLE_LINES = 2_000
FEATURES, MAX_ITER, REG, L1_SHARE = 1 << 12, 25, 0.0005, 0.3
#: Least share of a paragraph's 3-grams that its family's templates must have.
MIN_OVERLAP = 0.5
# Names of licence families as statements give them.
NAMES = {
    "Apache": ("the Apache License, Version 2.0", "Apache License 2.0", "the Apache Software License"),
    "BSD": ("the BSD License", "the 3-Clause BSD License", "the BSD 2-Clause License", "a BSD-style license"),
    "CC-BY": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution License"),
    "CC-BY-NC": ("CC BY-NC 4.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "the Creative Commons Attribution-ShareAlike License"),
    "CC0": ("CC0 1.0 Universal", "the CC0 Public Domain Dedication", "Creative Commons Zero"),
    "AGPL": ("the GNU Affero General Public License, version 3", "the AGPL", "GNU AGPLv3"),
    "GPL": ("the GNU General Public License, version 3", "the GNU General Public License, version 2", "the GNU GPL", "GPLv3"),
    "LGPL": ("the GNU Lesser General Public License, version 2.1", "the LGPL", "GNU LGPLv3"),
    "ISC": ("the ISC License",),
    "MIT": ("the MIT License", "MIT License", "the MIT license (MIT)"),
    "MPL": ("the Mozilla Public License, version 2.0", "MPL 2.0"),
    "EPL": ("the Eclipse Public License, version 2.0", "EPL 2.0"),
    "Unlicense": ("the Unlicense",),
}
# Short identifiers of the families, and names of licences of no family here.
IDENTIFIERS = {"Apache": "Apache-2.0", "BSD": "BSD-3-Clause", "CC-BY": "CC-BY-4.0", "CC-BY-NC": "CC-BY-NC-4.0", "CC-BY-SA": "CC-BY-SA-4.0", "CC0": "CC0-1.0", "AGPL": "AGPL-3.0-only", "GPL": "GPL-3.0-only", "LGPL": "LGPL-2.1-only", "ISC": "ISC", "MIT": "MIT", "MPL": "MPL-2.0", "EPL": "EPL-2.0", "Unlicense": "Unlicense"}
UNNAMED = ("WTFPL", "the zlib License", "the Artistic License 2.0", "the Boost Software License", "a proprietary license", "the PostgreSQL License", "the Beerware License", "the Academic Free License", "a custom license", "our vendor license", "the Open Database License", "the Vim License")
#: Families that the first fit doesn't know.
LEFT_OUT = ("ISC", "EPL")
STATEMENTS = ("Licensed under {n}.", "Released under {n}.", "This work is licensed under {n}.", "This software is distributed under the terms of {n}.", "This project is available under {n}; see the LICENSE file for details.", "The source code is released under {n}.", "License: {n}", "SPDX-License-Identifier: {n}", "{n}", "Content is made available under {n} unless otherwise noted.")
# Opening paragraphs of the families' notices.
TEMPLATES = {
    "Apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. You should have received a copy of the GNU General Public License along with this program.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "MPL": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
}
#: Statements in the same words that grant no licence.
OTHER = ("You need a driving license to rent a car.", "The city requires a business license and a permit.", "The software version 2.0 was released in March.", "All rights reserved by the general public library.", "Free copies of this work are available in the library.", "A copy of the notice was distributed to all persons.", "The license plate number is public.", "This project is available for sale under other terms.", "Apache helicopters were seen over the city.", "The MIT campus is open to the public.", "See the file for details of the work.", "The conditions of use are published in this notice.", "He was granted permission to publish the source.", "Commercial use of the binary file is limited.", "Version 3 of the program is subject to review.", "The creative director and the commons committee met.", "Merge the two lists and distribute them.", "Attribution of the painting is doubtful.", "Mozilla and Eclipse are names of programs.", "License renewal fees apply.")
#: Everyday words that are no evidence.
COMMON = frozenset("a above all along an and any anyone are as at be by can car city copy either for form from he her his holder if in including is it its later law library list made may means met name names of on one open option or other out over person persons program public real see sell should so source such that the their them this to unless use used was were which who whom will with without work writing you your read written".split())


def words_of(text: Column) -> Column:
    """Lower-case runs of letters, digits, dots, plus and minus signs, without such signs at their ends."""
    return F.filter(F.transform(F.split(F.lower(text), "[^a-z0-9.+-]+"), lambda w: F.btrim(w, F.lit(".+-"))), lambda w: w != "")


def _plain(text: str) -> list[str]:
    low = "".join(c if c.isascii() and c.isalnum() or c in ".+-" else " " for c in text.lower())
    return [x for w in low.split() if (x := w.strip(".+-"))]


def _sources() -> list[tuple[str, str, str]]:
    """(family, source, text): templates, and statements made from the names; source: what the text is made from."""
    named = [(f, n) for f, names in NAMES.items() for n in (*names, IDENTIFIERS[f])] + [("unknown", n) for n in UNNAMED]
    return [*((f, f"template {f}", t) for f, t in TEMPLATES.items()), *((f, n, s.format(n=n)) for f, n in named for s in STATEMENTS)]


def evidence() -> list[str]:
    return sorted({w for f, _, t in _sources() if f != "unknown" for w in _plain(t)} - COMMON)


def _training() -> list[tuple[str, str, str]]:
    """(family, source, paragraph): sources whole, in parts, and with other words before and after."""
    out = []
    for family, source, text in _sources():
        w = text.split()
        out += [(family, source, text)] * 2
        if len(w) > 24:
            out += [(family, source, " ".join(w[i : i + n])) for n in (14, 22, 34) for i in range(0, len(w) - n + 1, 5)]
        out += [(family, source, f"Copyright (c) 20{len(w) % 30:02d} the authors. {text}"), (family, source, f"{text} All rights reserved.")]
    other = [("none", t, t) for t in OTHER for _ in range(4)] + [("none", t, " ".join(t.split()[i:])) for t in OTHER for i in (1, 2, 3)]
    return out + other


def _once(x: Column, fn) -> Column:
    """fn of x, with x evaluated once (a lambda that mentions a column's expression evaluates it for every element)."""
    return F.get(F.transform(F.array(x), fn), 0)


def features(words: Column, known: Column) -> Column:
    """1-grams and 2-grams that hold an evidence word."""

    def both(w: Column) -> Column:
        flags = F.transform(w, lambda x: F.struct(x.alias("w"), F.array_contains(known, x).alias("k")))
        one = F.filter(w, lambda x: F.array_contains(known, x))
        pairs = F.zip_with(F.slice(flags, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(flags, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(a.k | b.k, F.concat(a.w, F.lit(" "), b.w)))
        return F.concat(one, F.array_compact(pairs))

    return _once(words, both)


def grams(words: Column, width: int = 3) -> Column:
    """Distinct hashes of the 3-grams; of shorter sequences, of the whole."""

    def hashes(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))
        return F.array_distinct(F.when(F.size(w) >= width, each).otherwise(F.array(F.xxhash64(w))))

    return _once(words, hashes)


class Scanner:
    """The trained model with its threshold."""

    def __init__(self, lines: DataFrame):
        """lines (line): corpus lines with evidence; at most SAMPLE_LINES of the most different hash are learned from,
        as `none`, unless they share a 3-gram with a template."""
        spark = lines.sparkSession
        self.known = F.array(*map(F.lit, evidence()))
        self.classes = [*sorted(NAMES), "unknown", "none"]
        sources = spark.createDataFrame([(f, t) for f, _, t in _sources() if f != "unknown"], "family string, line string")
        own = sources.select("family", F.explode(grams(words_of(F.col("line")))).alias("g")).groupBy("family").agg(F.collect_set("g").alias("templates"))
        names = [(f, [f" {' '.join(_plain(n))} " for n in (*names, IDENTIFIERS[f])]) for f, names in NAMES.items()]
        self.templates = materialize(own.join(spark.createDataFrame(names, "family string, names array<string>"), "family"), "licence-templates")
        seen = F.array(*(F.lit(r[0]) for r in self.templates.select(F.explode("templates")).distinct().collect()))  # of the fixed templates
        some = lines.select("line").distinct().orderBy(F.xxhash64("line"), "line").limit(SAMPLE_LINES)
        other = some.where(~F.arrays_overlap(grams(words_of(F.col("line"))), seen)).select(F.lit("none").alias("family"), F.col("line").alias("source"), "line")
        rows = spark.createDataFrame(_training(), "family string, source string, line string").unionByName(other)
        rows = rows.withColumn("label", (F.array_position(F.array(*map(F.lit, self.classes)), F.col("family")) - 1).cast("double"))
        apart = (F.pmod(F.xxhash64("source"), F.lit(4)) == 0) & ~F.startswith("source", F.lit("template ")) | F.col("family").isin(*LEFT_OUT)
        rows = rows.withColumn("held_out", apart).withColumn("f", features(words_of(F.col("line")), self.known)).coalesce(1)
        self.tf = HashingTF(numFeatures=FEATURES, binary=True, inputCol="f", outputCol="x")
        table = self.tf.transform(materialize(rows, "licence-training"))
        fit = LogisticRegression(featuresCol="x", labelCol="label", maxIter=MAX_ITER, regParam=REG, elasticNetParam=L1_SHARE, standardization=False, family="multinomial").fit
        self.model = fit(table.where("not held_out"))
        # the threshold that gets most held-out paragraphs right, of equals the highest; left-out families, and what is
        # doubtful, should be unknown
        scored = self._scored(table.where("held_out")).select("label", "family", "family_id", "probability")
        unknown, none = len(self.classes) - 2, len(self.classes) - 1
        want = F.when(F.col("family").isin(*LEFT_OUT), unknown).otherwise(F.col("label").cast("int"))
        grid = scored.select("*", F.explode(F.array(*(F.lit(k / 20) for k in range(6, 20)))).alias("t"))
        said = F.when((F.col("probability") >= F.col("t")) | (F.col("family_id") == none), F.col("family_id")).otherwise(unknown)
        right = grid.groupBy("t").agg(F.avg((said == want).cast("double")).alias("share"))
        top = right.orderBy(F.desc("share"), F.desc("t")).first()
        self.threshold, self.held_out_accuracy = (top["t"], top["share"]) if top else (0.5, None)
        self.model = fit(table)

    def _scored(self, table: DataFrame) -> DataFrame:
        p = vector_to_array("probability")
        out = self.model.transform(table).withColumn("family_id", F.col("prediction").cast("int"))
        return out.withColumn("probability", F.element_at(p, F.col("family_id") + 1)).drop("rawPrediction", "prediction", "x")

    def classify(self, lines: DataFrame) -> DataFrame:
        """lines (a column `line` among them) with family, probability and overlap (the
        share of its 3-grams that the templates have); family is a name, `unknown` or `none`."""
        w = words_of(F.col("line"))
        scored = self._scored(self.tf.transform(lines.withColumn("f", features(w, self.known)))).drop("f")
        scored = scored.withColumn("family", F.get(F.array(*map(F.lit, self.classes)), F.col("family_id")))
        both = scored.join(F.broadcast(self.templates), "family", "left")  # a row a family
        overlap = F.coalesce(F.size(F.array_intersect(grams(w), "templates")) / F.size(grams(w)), F.lit(0.0))
        text = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
        named = _once(text, lambda t: F.exists("names", lambda n: F.contains(t, n)))
        both = both.withColumns({"overlap": overlap, "named": F.coalesce(named, F.lit(False))})
        sure = (F.col("probability") >= self.threshold) & (F.col("named") | (F.col("overlap") >= MIN_OVERLAP))
        verdict = F.when(F.col("family") == "none", "none").when(sure, F.col("family")).otherwise("unknown")
        return both.withColumn("family", verdict).drop("templates", "names", "named", "family_id")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, licences (confirmed families, sorted, joined by commas; empty if none), n_licences and
    n_unknown (paragraphs confirmed and doubtful), best_probability (of the confirmed; null without), for every row.

    Paragraphs are lines with at least one word. Null and empty texts have none. Repeated rows are rows of their own."""
    known = F.array(*map(F.lit, evidence()))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\r\n]+"), lambda x: F.trim(x) != "")
    # lower-cased words of the whole line at once; one look-up a word
    likely = F.filter(lines, lambda x: F.arrays_overlap(words_of(x), known))
    narrow = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.size(lines).cast("long").alias("n_paragraphs"), likely.alias("lines"))
    narrow = materialize(narrow, "licence-lines")
    each = narrow.select("rid", F.explode("lines").alias("line"))
    found = Scanner(each).classify(each)
    sure = ~F.col("family").isin("none", "unknown")
    by_doc = found.groupBy("rid").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(sure, F.col("family")))), ",").alias("licences"),
        F.sum(sure.cast("long")).alias("n_licences"),
        F.sum((F.col("family") == "unknown").cast("long")).alias("n_unknown"),
        F.max(F.when(sure, F.col("probability"))).alias("best_probability"),
    )
    zero = F.lit(0).cast("long")
    return narrow.join(by_doc, "rid", "left").select("doc_id", "n_paragraphs", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_licences", zero).alias("n_licences"), F.coalesce("n_unknown", zero).alias("n_unknown"), "best_probability")
