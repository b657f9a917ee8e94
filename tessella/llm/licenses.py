"""License scans with DataFrame functions alone.

Text windows overlap by half and are twice as long as the templates of their class, so a notice always lies whole in
one of them. A window collides with a template when one of `bands` MinHash values is the same; with a Jaccard
similarity of at least 0.19 (the least for containment 0.8 in such a window), 64 bands miss it with a probability of
0.81**64, about 1e-6. A collision needs one of the template's shingles in the window, so windows without any shingle
of any template are left out before minima are taken. Candidates are verified by exact shingle containment.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import doc_columns, once

# Short license notices.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Between words: ASCII characters that are neither letters nor digits.
SPLIT = r"[\x00-/:-@\[-`{-\x7f]+"
WORDS = 5
#: Most shingles of all templates together; the templates are literals of the plan.
MAX_SHINGLES = 100_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPLIT), "")


def shingles(w: Column) -> Column:
    """Hashes of the runs of five words, in order; none for shorter texts."""
    return F.when(F.size(w) >= WORDS, F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*(w[i + j] for j in range(WORDS))))).otherwise(F.array().cast("array<bigint>"))


def _bands(window: Column, seeds: list[int]) -> Column:
    """One MinHash for each seed: hashes are uniform, so the least of them after an exclusive or picks a uniform member."""
    return F.transform(F.array(*map(F.lit, seeds)), lambda c: F.array_min(F.transform(window, lambda h: h.bitwiseXOR(c))))


def _starts(n: Column, half: int) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1, F.lit(half)), lambda i: F.struct(F.lit(half).alias("half"), i.alias("start")))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", containment: float = 0.8, bands: int = 64) -> DataFrame:
    """(doc_id, license, n_shared, n_shingles, first_word): the templates of which some window of the document holds the given share of
    shingles. n_shared is the most that one window holds, first_word the start of the first such window.

    Null, empty and short texts match nothing. Rows that repeat an id give one row for each template. Templates of fewer
    than five words, and more than MAX_SHINGLES shingles of templates, are ValueErrors.
    """
    spark = docs.sparkSession
    templates = NOTICES if templates is None else templates
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string").select("license", words(F.col("text")).alias("w")).select("license", F.array_distinct(shingles(F.col("w"))).alias("shingles")).collect()
    if any(not r.shingles for r in rows) or sum(len(r.shingles) for r in rows) > MAX_SHINGLES:
        raise ValueError("templates of fewer than five words, or too many of them")
    random_bits = random.Random(7)
    seeds = [random_bits.getrandbits(63) for _ in range(bands)]
    found = doc_columns(docs, id_col, text_col).select("doc_id", words(F.col("text")).alias("w")).select("doc_id", once(shingles(F.col("w"))).alias("s"))
    universe = F.array(*(F.lit(h) for h in sorted({h for r in rows for h in r.shingles})))
    if not rows:
        universe = F.array().cast("array<bigint>")
    found = found.filter(F.arrays_overlap("s", universe))
    known = spark.createDataFrame([(r.license, r.shingles, 1 << (len(r.shingles) - 1).bit_length()) for r in rows], "license string, t array<bigint>, half int")
    halves = sorted({1 << (len(r.shingles) - 1).bit_length() for r in rows}) or [1]
    starts = F.flatten(F.array(*(_starts(F.size("s"), h) for h in halves)))
    windows = found.select("doc_id", "s", F.explode(starts).alias("at")).select("doc_id", "at.half", "at.start", F.slice("s", F.col("at.start") + 1, F.col("at.half") * 2).alias("window")).filter(F.arrays_overlap("window", universe))
    keyed = windows.select("doc_id", "half", "start", "window", F.posexplode(_bands(F.col("window"), seeds)).alias("band", "value"))
    wanted = known.select("license", "t", "half", F.posexplode(_bands(F.col("t"), seeds)).alias("band", "value"))
    # at most MAX_SHINGLES * bands rows
    candidates = keyed.join(F.broadcast(wanted), ["half", "band", "value"]).select("doc_id", "license", "start", F.size(F.array_intersect("t", "window")).alias("shared"), F.size("t").alias("n"))
    return candidates.filter(F.col("shared") >= F.col("n") * containment).groupBy("doc_id", "license").agg(F.max("shared").cast("long").alias("n_shared"), F.max("n").cast("long").alias("n_shingles"), F.min("start").cast("long").alias("first_word"))


def scan_sql(templates: dict[str, str] | None = None, containment: float = 0.8) -> str:
    """The same rows without MinHash: every window against every template."""
    values = ", ".join(f"('{k}', '{v}')" for k, v in sorted((NOTICES if templates is None else templates).items()))
    cut = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '" + SPLIT.replace("'", "''") + "'), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT license, {cut} AS w FROM (VALUES {values}) v(license, text)),
  ts AS (SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
  tn AS (SELECT license, count(*) AS n, pow(2, ceil(log2(count(*))))::BIGINT AS half FROM ts GROUP BY license),
  d AS (SELECT doc_id, {cut} AS w FROM documents),
  ds AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
  hit AS (SELECT ds.doc_id, license, n, half, p, s FROM ds JOIN ts USING (s) JOIN tn USING (license)),
  win AS (SELECT doc_id, license, n, k * half AS start, count(DISTINCT s) AS shared
    FROM (SELECT *, p // half AS k FROM hit UNION ALL SELECT *, p // half - 1 AS k FROM hit) WHERE k >= 0 GROUP BY doc_id, license, n, half, k)
SELECT doc_id, license, max(shared)::BIGINT AS n_shared, max(n)::BIGINT AS n_shingles, min(start)::BIGINT AS first_word FROM win WHERE shared >= n * {containment} GROUP BY doc_id, license
"""
