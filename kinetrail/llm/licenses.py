r"""License scans by diagonal voting.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z in lower case. The hashes of
all ``K``-word grams of all texts are joined to the gram positions of the templates, a table of
constant size. A hit votes for its diagonal, text position minus template position. Per text and
template, votes are counted by diagonal, diagonals at most ``SLACK`` apart are merged, so that
a few added or missing words do not break a match, and a merged diagonal is verified: its
distinct template grams, over all of the template's, must reach ``LEAST`` within a span of at
most STRETCH times the template's words, and hold the words that tell the license from its kin. Everything is DataFrame
expressions. Grams that no template has are dropped before rows are made of them, by a set of constant size.

Base phrases are found by their words in sequence and always label; verified templates add
labels. A null doc_id stays null. Null texts are empty: no words, null first and last, empty labels, score 0. Rows that
repeat get the same result each: hits are kept by doc_id and a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, written

K = 4
SLACK = 3
LEAST = 0.6
STRETCH = 1.5
#: Base phrases and their labels: fixed values.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Texts and notices of well-known public licenses: label, text, and four words without which a text is another license's. Fixed values.
TEMPLATES = (
    ("mit", "Released under the MIT License.", None),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", None),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        None,
    ),
    ("apache", "Licensed under the Apache License, Version 2.0.", None),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", None),
    (
        "apache",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        None,
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "the gnu general public"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "the gnu general public",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "the gnu lesser general",
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "the gnu affero general",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", None),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        None,
    ),
    (
        "bsd-3",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        None,
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies",
        None,
    ),
    (
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        None,
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        None,
    ),
    (
        "bsl",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
        "to use, reproduce, display, distribute, execute, and transmit the Software",
        None,
    ),
    (
        "epl",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
        "the eclipse public license",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        None,
    ),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License", "creative commons attribution 4"),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons attribution sharealike"),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License", "commons attribution noncommercial 4"),
    ("cc-by-nd", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License", "commons attribution noderivatives 4"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", None),
)
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, BREAKS), "")


def grams(words: Column, k: int = K) -> Column:
    """Hashes of all k-word grams, in order; none for fewer words."""
    n = F.size(words) - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(F.array().cast("array<bigint>"))


def template_grams(spark: SparkSession, templates: tuple = TEMPLATES, k: int = K) -> DataFrame:
    """(gram, template, label, core, at, n_grams, n_template_words) of all templates; core: where the words are that must be there, else -1."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"), F.lit(core).cast("string").alias("core")) for i, (label, text, core) in enumerate(templates)])
    words = spark.range(1).select(F.explode(rows).alias("r")).select("r.template", "r.label", words_of(F.col("r.text")).alias("w"), F.xxhash64(F.split("r.core", " ")).alias("c"), "r.core")
    hashed = words.select("template", "label", "core", "c", F.size("w").alias("n_template_words"), let(F.col("w"), lambda w: grams(w, k)).alias("g"))
    core = F.when(F.col("core").isNull(), -1).otherwise(F.array_position("g", F.col("c")).cast("int") - 1).alias("core")
    return hashed.select("template", "label", core, "n_template_words", F.size("g").alias("n_grams"), F.posexplode("g").alias("at", "gram"))


def verified(docs: DataFrame, templates: tuple = TEMPLATES, k: int = K) -> DataFrame:
    """(doc_id, text_hash, template, label, first, last, coverage): template passages in texts, words first to last."""
    # Hashed before it is exploded: what stands beside a generator is computed for each row it makes.
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), let(words_of(F.col("text")), lambda w: grams(w, k)).alias("grams"))
    known = template_grams(docs.sparkSession, templates, k)
    kept = [r.gram for r in known.select("gram").distinct().collect()]  # the templates' size is constant
    found = F.filter(F.transform("grams", lambda g, i: F.when(g.isin(kept), F.struct(i.alias("pos"), g.alias("gram")))), lambda x: x.isNotNull())
    keyed = hashed.select("doc_id", "text_hash", F.explode(found).alias("x")).select("doc_id", "text_hash", "x.pos", "x.gram")
    hits = keyed.join(F.broadcast(known), "gram")
    diagonal = hits.groupBy("doc_id", "text_hash", "template", "label", "core", "n_grams", "n_template_words", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("places"), F.min("pos").alias("low"), F.max("pos").alias("high")
    )
    diagonal = written(diagonal)
    of = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(of) > SLACK, F.lit(True))
    merged = (
        diagonal.withColumn("_new", apart.cast("int"))
        .withColumn("_group", F.sum("_new").over(of))
        .groupBy("doc_id", "text_hash", "template", "label", "core", "n_grams", "n_template_words", "_group")
        .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("low").alias("first"), (F.max("high") + k - 1).alias("last"))
        .withColumn("n", F.size("places"))
    )
    span = F.col("last") - F.col("first") + 1
    good = (F.col("n") >= LEAST * F.col("n_grams")) & (span <= STRETCH * F.col("n_template_words")) & ((F.col("core") < 0) | F.array_contains("places", F.col("core")))
    return merged.where(good).select("doc_id", "text_hash", "template", "label", "first", "last", (F.col("n") / F.col("n_grams")).alias("coverage"))


def _base(words: Column) -> Column:
    """Struct of n_words, n_base, first_word, last_word and base_labels."""
    found = []
    for phrase, label in PHRASES:
        parts = phrase.split(" ")
        ends = F.filter(F.transform(words, lambda w, i: F.when(w == parts[-1], i)), lambda i: i.isNotNull())  # noqa: B023
        starts = F.transform(ends, lambda i: i - (len(parts) - 1))  # noqa: B023

        def all_there(i: Column, parts: list[str]) -> Column:
            ok = i >= 0
            for k, part in enumerate(parts[:-1]):
                ok = ok & F.coalesce(F.get(words, i + k) == part, F.lit(False))
            return ok

        found.append((F.filter(starts, _with(all_there, parts)), label))

    def result(*lists: Column) -> Column:
        every = F.concat(*lists)
        names = F.array_compact(F.array(*[F.when(F.size(x) > 0, F.lit(label)) for x, (_, label) in zip(lists, found, strict=True)]))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.size(every).cast("long").alias("n_base"),
            F.array_min(every).cast("long").alias("first_word"),
            F.array_max(every).cast("long").alias("last_word"),
            F.array_sort(F.array_distinct(names)).alias("base"),
        )

    a, b, c = (x for x, _ in found)
    full = let(a, lambda x: let(b, lambda y: let(c, lambda z: result(x, y, z))))
    none = F.array().cast("array<int>")
    return F.when(F.array_contains(words, "license"), full).otherwise(result(none, none, none))


def _with(body, parts: list[str]):
    return lambda i: body(i, parts)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base counts and labels, all labels and score of every document."""
    texts = docs.select("doc_id", "text")
    base = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), let(words_of(F.col("text")), _base).alias("b"))
    passages = verified(texts)
    more = passages.groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"))
    more = written(more.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "more", "coverage"))
    met = written(base).join(more, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    every = F.array_sort(F.array_distinct(F.concat(F.col("b.base"), F.coalesce("more", F.array().cast("array<string>")))))
    return met.select(
        "doc_id",
        "b.n_words",
        "b.n_base",
        "b.first_word",
        "b.last_word",
        F.array_join("b.base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.coalesce("coverage", F.lit(0.0)).alias("score"),
    )
