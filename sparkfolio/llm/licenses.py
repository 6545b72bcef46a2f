"""License scans: MinHash bands over overlapping text windows, exact shingle containment after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm.windows import references, shingle_hashes, small, windows

# Notices by which works say their licence.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain"),
]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def min_hashes(shingles: str, count: int) -> Column:
    """The smallest of ``count`` hashes of the shingles."""
    return F.expr(f"transform(sequence(1, {count}), h -> aggregate({shingles}, 9223372036854775807L, (m, x) -> least(m, xxhash64(h, x))))")


def bands(hashes: str, rows: int, count: int) -> Column:
    """Each band's number and the hash of its ``rows`` MinHashes."""
    parts = [F.struct(F.lit(b).alias("band"), F.xxhash64(*[F.element_at(hashes, b * rows + r + 1) for r in range(rows)]).alias("value")) for b in range(count)]
    return F.explode(F.array(*parts))


def scan(
    docs: DataFrame, notices: DataFrame, *, doc_id: str = "doc_id", text: str = "text", license: str = "license", notice: str = "text",
    width: int = 5, containment: float = 0.8, rows: int = 2, count: int = 20,
) -> DataFrame:
    """Documents which hold a licence notice: ``doc_id``, ``license``, ``start``, ``n_words``, ``containment``, ``n_places``.

    One row a document and licence, for the place that holds the largest share of a notice's ``width``-word shingles (of
    a shorter notice: the whole), ties the first; ``n_places`` counts the places at or over ``containment``. Words are
    lower-cased runs of letters and digits.

    Null and empty texts hold nothing, null and empty notices are nowhere. Rows with the same id and text count once. A
    null doc_id is reported as null. Empty tables give an empty result. Other columns play no part.

    Windows overlap: one for each place where a shingle stands as in a notice of that length (see ``windows``). Containment
    0.8 in a window of the notice's size is a Jaccard similarity of 2/3 or more, so a pair misses all of 20 bands of two
    with probability (1 - 4/9) ** 20, under 1 in 100,000.
    """
    named = notices.select(F.struct(F.col(f"`{license}`").alias("license"), F.xxhash64(f"`{notice}`").alias("text")).alias("key"), F.col(f"`{notice}`").alias("words"))
    refs = references(named, "key", "words", width)
    total = refs.count()
    found = windows(docs, refs, doc_id=doc_id, text=text)
    own = shingle_hashes("hashes", width)
    for few in range(1, width):
        own = F.when(F.col("n") == few, shingle_hashes("hashes", few)).otherwise(own)
    found = found.select("id", "start", "n", F.array_distinct(own).alias("own")).where(F.size("own") > 0)
    found = found.withColumn("mins", min_hashes("own", rows * count))
    index = refs.select("ref", "n", F.array_distinct("shingles").alias("shingles")).withColumn("mins", min_hashes("shingles", rows * count))
    index = index.select("ref", "n", "shingles", bands("mins", rows, count).alias("b")).select("ref", "n", "shingles", "b.band", "b.value")
    probes = found.select("id", "start", "n", "own", bands("mins", rows, count).alias("b")).select("id", "start", "n", "own", "b.band", "b.value")
    met = probes.join(small(index, total * count), ["n", "band", "value"])
    share = F.size(F.array_intersect("own", "shingles")) / F.size("shingles")
    held = met.select("id", "start", "n", F.col("ref.license").alias("license"), share.alias("containment")).where(F.col("containment") >= containment).distinct()
    best = held.groupBy("id", "license").agg(
        F.max(F.struct("containment", (-F.col("start")).alias("back"), "n")).alias("best"), F.count_distinct("start").alias("n_places"))
    return best.select(
        F.col("id").alias(doc_id), F.col("license").alias(license), (-F.col("best.back")).alias("start"), F.col("best.n").alias("n_words"),
        F.col("best.containment").alias("containment"), "n_places")
