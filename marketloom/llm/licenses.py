"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

SHINGLE = 3
BANDS = 48
CONTAINED = 0.8
#: Public license notices. Notices of fewer than three words cannot be told from running text.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def with_shingles(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the hashes of a text's three-word shingles, A-Z lower-cased; empty below three words and for null."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORDS), 0)
    d = df.withColumn("_words", words)
    n = F.size("_words") - SHINGLE + 1
    hashed = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(*[F.element_at("_words", i + k) for k in range(SHINGLE)]))
    return d.withColumn(out, F.when(n >= 1, hashed).otherwise(F.array().cast("array<bigint>"))).drop("_words")


def _signature(hashes, bands: int):
    """One min-hash a band (bands of one row): two sets with Jaccard similarity J collide in some band with probability 1 - (1 - J)^bands."""
    def low(seed: int):
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(seed))))

    return F.array(*[low(s) for s in range(bands)])


def scan(documents: DataFrame, templates: Mapping[str, str] = TEMPLATES, bands: int = BANDS, contained: float = CONTAINED) -> DataFrame:
    """doc_id, license, containment, first_word: every license notice of every whole text, one row per document and template.

    Templates of up to c shingles (c a power of two) are sought in windows of 2c shingles that start every c, so a whole notice lies
    inside some window and has a Jaccard similarity above 1/4 to it: with 48 bands it is missed with probability under 0.75^48 = 1e-6.
    A window without any template shingle cannot share a minimum with a template, so signatures are formed for the others only.
    Candidates are verified: at least `contained` of the template's distinct shingles lie in the window. containment is the best window's
    share, first_word the first shingle of the earliest such window that belongs to the template.

    Null and short texts have no notice; repeated rows give one row each only if their doc_id differs; a null doc_id is kept as null.
    Only the templates, a table of fixed size, meet the hits; texts are never shuffled.
    """
    spark = documents.sparkSession
    known = with_shingles(spark.createDataFrame(sorted(templates.items()), "license string, notice string"), "notice", "t").withColumn("t", F.array_distinct("t")).where(F.size("t") > 0)
    known = known.withColumn("c", F.expr("cast(pow(2, ceil(log2(greatest(size(t), 2)))) as int)"))
    parts = {r["c"]: r["h"] for r in known.select("c", F.explode("t").alias("h")).groupBy("c").agg(F.sort_array(F.collect_set("h")).alias("h")).collect()}
    if not parts:
        return documents.select("doc_id").limit(0).withColumns({"license": F.lit(""), "containment": F.lit(0.0), "first_word": F.lit(0).cast("long")})
    docs = with_shingles(documents.select("doc_id", F.col("text").alias("text")), "text", "h").drop("text")

    def windows(c: int, hashes: list[int]):
        """Struct array (c, window, its shingles) of the windows of one size that hold a template shingle."""
        at = F.filter(F.transform("h", lambda x, i: F.when(x.isin(hashes), i)), lambda i: i.isNotNull())
        k = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.floor(i / c).cast("int"), F.greatest(F.floor(i / c).cast("int") - 1, F.lit(0))))))
        return F.transform(k, lambda w: F.struct(F.lit(c).alias("c"), w.alias("w"), F.slice("h", w * c + 1, F.lit(2 * c)).alias("s")))

    hits = docs.select("doc_id", F.explode(F.concat(*[windows(c, h) for c, h in sorted(parts.items())])).alias("x")).select("doc_id", "x.*")
    drawn = hits.withColumn("sig", _signature(F.col("s"), bands)).select("doc_id", "c", "w", "s", F.posexplode("sig").alias("band", "low"))
    table = known.withColumn("sig", _signature(F.col("t"), bands)).select("license", "t", "c", F.posexplode("sig").alias("band", "low"))
    pairs = drawn.join(F.broadcast(table), ["c", "band", "low"]).drop("band", "low").dropDuplicates(["doc_id", "c", "w", "license"])  # the templates: a fixed table
    common = F.size(F.array_intersect("t", "s"))
    sure = pairs.withColumn("containment", common / F.size("t")).where(F.col("containment") >= contained)
    first = F.col("w") * F.col("c") + F.array_min(F.filter(F.transform("s", lambda x, i: F.when(F.array_contains("t", x), i)), lambda i: i.isNotNull()))
    return sure.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min(first).cast("long").alias("first_word"))


def op9_licenses(spark, folder: str) -> DataFrame:
    return scan(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))


def oracle() -> str:
    """DuckDB form: the same windows, compared with every template without hashing."""
    words = rf"regexp_extract_all(translate({{}}, '{UPPER}', '{LOWER}'), '{WORDS}')"
    notices = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    gram = lambda w: f"list_transform(range(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2])"
    return f"""with n as (select license, {words.format('notice')} w from (values {notices}) t(license, notice)),
t as (select license, list_distinct({gram('w')}) g from n where len(w) > 2),
tc as (select license, len(g) size, cast(pow(2, ceil(log2(greatest(len(g), 2)))) as int) c, unnest(g) g from t),
d as (select doc_id, {words.format('text')} w from documents where text is not null),
ds as (select doc_id, unnest(range(0, len(w) - 2)) p, unnest({gram('w')}) g from d where len(w) > 2),
h as (select distinct doc_id, license, size, c, p, tc.g from ds join tc using (g)),
k as (select doc_id, license, size, p, g, unnest(list_distinct([p // c, greatest(p // c - 1, 0)])) w from h),
v as (select doc_id, license, w, count(distinct g) / any_value(size) containment, min(p) p from k group by all having count(distinct g) >= {CONTAINED} * any_value(size))
select doc_id, license, max(containment) containment, min(p)::bigint first_word from v group by all"""
