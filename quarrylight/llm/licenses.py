"""License scan: an exact set-similarity join of text blocks with license notices.

A block is a line of a text, or a window of BLOCK words of a longer line, each window half over the
next; across lines, windows over the words of the whole text are blocks too, and the words that match
must then stand in a run a third longer than the notice at most.  It matches a notice when it holds at least THRESHOLD of the notice's distinct words.  Words are
ordered by how many documents hold them, rare ones first, counted over the whole table.  A match must
then share a word of the notice's prefix (prefix filter), the block must have enough words (length
filter), and the words left after the first shared one must suffice (positional filter); what passes
is verified on the full sets.  Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.runtime import written
from quarrylight.llm.textbytes import words_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
THRESHOLD = 0.8
BLOCK = 64

# Phrases that name a license wherever their words stand consecutively.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Notices whose words a block must contain for the most part.
NOTICES = (
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(low: Column) -> Column:
    return F.array_remove(F.split(low, BREAKS), "")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def phrase_places(words: Column, low: Column, phrase: list[str]) -> Column:
    """Word places where a phrase begins; looked for only in texts that hold all its words."""
    held = F.lit(True)
    for word in dict.fromkeys(phrase):
        held = held & F.contains(low, F.lit(word))

    def begins(word: Column, i: Column) -> Column:
        here = word == phrase[0]
        for k, other in enumerate(phrase[1:], 1):
            here = here & F.coalesce(F.get(words, i + k) == other, F.lit(False))
        return F.when(here, i.cast("long"))

    return F.when(held, F.filter(F.transform(words, begins), lambda x: x.isNotNull())).otherwise(F.array().cast("array<bigint>"))


def token_order(docs: DataFrame, tokens: list[str]) -> list[str]:
    """Notice words by document count over the whole table, rare ones first.  As many rows as notice words."""
    held = docs.select(F.explode(F.array_intersect(words(lowered(F.col("text"))), _strings(tokens))).alias("token"))
    counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return sorted(tokens, key=lambda t: (counts.get(t, 0), t))


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES, threshold: float = THRESHOLD, across_lines: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    score is the largest share of a notice found in one block, 0 without a match.  Null and empty texts
    have no words and no labels.  ``across_lines`` finds notices that are wrapped over lines.  Copies and equal ids each give their row; an empty table gives none.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sets = [(label, sorted(set(words_of(text)))) for label, text in notices]
    order = token_order(docs, sorted({t for _, own in sets for t in own}))
    rank = {t: i for i, t in enumerate(order)}
    index, full = [], []
    for n, (label, own) in enumerate(sets):
        ranks = sorted(rank[t] for t in own)
        need = math.ceil(threshold * len(ranks) - 1e-9)
        n_words = len(words_of(notices[n][1]))
        full.append((n, label, ranks, need, n_words + n_words // 3))
        index += [(ranks[k], n, k, len(ranks), need) for k in range(len(ranks) - need + 1)]
    prefix = sorted({order[r] for r, *_ in index})
    least = min((need for *_, need, _ in full), default=1)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", lowered(F.col("text")).alias("low")).withColumn("words", words(F.col("low")))
    split_phrases = [(label, words_of(phrase)) for label, phrase in phrases]
    places = [phrase_places(F.col("words"), F.col("low"), own) for _, own in split_phrases]
    lines = F.transform(F.split("low", "\n"), words)
    windows = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - (BLOCK // 2 + 1), F.lit(0)), F.lit(BLOCK // 2)), lambda s: F.slice(w, s + 1, BLOCK))
    ranks_of = F.create_map(*[x for t, r in rank.items() for x in (F.lit(t), F.lit(r))])
    ranked = lambda w: F.array_sort(F.transform(F.array_intersect(w, _strings(order)), lambda t: F.element_at(ranks_of, t)))
    held = lambda cut: F.filter(cut, lambda w: F.arrays_overlap(w, _strings(prefix)))
    blocks_of = lambda cut, run: F.filter(F.transform(held(cut), lambda w: F.struct(ranked(w).alias("ranks"), run(w).cast("array<int>").alias("run"))), lambda b: F.size(b["ranks"]) >= least)
    as_ranks = blocks_of(F.flatten(F.transform(lines, windows)), lambda w: F.lit(None))
    if across_lines:
        in_order = lambda w: F.transform(w, lambda t: F.coalesce(F.try_element_at(ranks_of, t), F.lit(-1)))
        as_ranks = F.when(F.size(lines) > 1, F.concat(as_ranks, blocks_of(windows(F.col("words")), in_order))).otherwise(as_ranks)
    none = F.array().cast("array<struct<ranks:array<int>,run:array<int>>>")
    base = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), (F.array(*places) if places else F.array().cast("array<array<bigint>>")).alias("places"), F.when(F.arrays_overlap("words", _strings(prefix)), as_ranks).otherwise(none).alias("blocks"))
    base = written(base, "licenses")

    index_df = spark.createDataFrame(index, "rank int, notice int, notice_at int, notice_size int, need int")
    full_df = spark.createDataFrame(full, "notice int, label string, notice_ranks array<int>, need int, longest int")
    blocks = base.select("row", F.explode(F.array_distinct("blocks")).alias("block"))
    tokens = blocks.select("row", "block", F.posexplode("block.ranks").alias("at", "rank"))
    left = lambda size, at: F.col(size) - 1 - F.col(at)
    hits = tokens.withColumn("size", F.size("block.ranks")).join(F.broadcast(index_df), "rank")  # as many rows as the notices' prefixes
    hits = hits.where((F.col("size") >= F.col("need")) & (F.col("at") <= F.col("size") - F.col("need")) & (1 + F.least(left("notice_size", "notice_at"), left("size", "at")) + F.least("notice_at", "at") >= F.col("need")))
    pairs = hits.select("row", "block", "notice").distinct()
    shared = lambda ranks: F.size(F.array_intersect(ranks, F.col("notice_ranks")))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("block.run") - F.col("longest") + 1, F.lit(1))), lambda k: shared(F.slice("block.run", k, F.col("longest"))))
    checked = pairs.join(F.broadcast(full_df), "notice").where(shared(F.col("block.ranks")) >= F.col("need"))
    checked = checked.withColumn("common", F.when(F.col("block.run").isNull(), shared(F.col("block.ranks"))).otherwise(F.array_max(runs))).where(F.col("common") >= F.col("need"))
    found = checked.groupBy("row").agg(F.collect_set("label").alias("own"), F.max(F.col("common") / F.size("notice_ranks")).alias("score"))

    all_places = F.flatten("places")
    named = [F.when(F.size(F.col("places")[k]) > 0, F.lit(label)) for k, (label, _) in enumerate(split_phrases)]
    base_labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*named) if named else F.array().cast("array<string>"))))
    out = base.select("row", "doc_id", "n_words", F.size(all_places).cast("long").alias("n_base"), F.array_min(all_places).alias("first_word"), F.array_max(all_places).alias("last_word"), base_labels.alias("base"))
    out = out.join(found, "row", "left")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>")))), ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), across_lines=True)


def sql_twin() -> str:
    """The same result by comparing every block with every notice."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda v: "[" + ", ".join(map(quoted, v)) + "]"
    longest = lambda text: len(words_of(text)) + len(words_of(text)) // 3
    notices = ", ".join(f"({n}, {quoted(label)}, {listed(sorted(set(words_of(text))))}, {longest(text)})" for n, (label, text) in enumerate(NOTICES))
    phrases = ", ".join(f"({quoted(label)}, {listed(words_of(text))})" for label, text in PHRASES)
    rule = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    return f"""
WITH notice(n, label, tokens, longest) AS (VALUES {notices}),
phrase(label, p) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT rid, doc_id, low, regexp_extract_all(low, {rule}) AS w FROM d),
hit AS (SELECT rid, label, i - 1 AS i FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0), phrase WHERE w[i] = p[1] AND w[i:i + len(p) - 1] = p),
base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS base FROM hit GROUP BY rid),
line AS (SELECT rid, regexp_extract_all(line, {rule}) AS w FROM (SELECT rid, unnest(string_split(low, chr(10))) AS line FROM d)),
block AS (SELECT rid, list_distinct(w[s + 1:s + {BLOCK}]) AS b FROM (SELECT rid, w, unnest(range(0, greatest(len(w) - {BLOCK // 2}, 1), {BLOCK // 2})) AS s FROM line WHERE len(w) > 0)),
lined AS (SELECT rid, label, len(list_intersect(b, tokens)) / len(tokens) AS share FROM block, notice WHERE len(list_intersect(b, tokens)) >= ceil({THRESHOLD} * len(tokens) - 1e-9)),
wide AS (SELECT rid, w[s + 1:s + {BLOCK}] AS b FROM (SELECT rid, w, unnest(range(0, greatest(len(w) - {BLOCK // 2}, 1), {BLOCK // 2})) AS s FROM w WHERE contains(low, chr(10)) AND len(w) > 0)),
run AS (SELECT rid, label, tokens, list_distinct(b[k + 1:k + longest]) AS r FROM (SELECT rid, label, tokens, longest, b, unnest(range(0, greatest(len(b) - longest + 1, 1))) AS k FROM wide, notice WHERE len(list_intersect(list_distinct(b), tokens)) >= ceil({THRESHOLD} * len(tokens) - 1e-9))),
own AS (FROM lined UNION ALL SELECT rid, label, len(list_intersect(r, tokens)) / len(tokens) AS share FROM run WHERE len(list_intersect(r, tokens)) >= ceil({THRESHOLD} * len(tokens) - 1e-9)),
mine AS (SELECT rid, list(DISTINCT label) AS own, max(share) AS score FROM own GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       array_to_string(coalesce(base, []), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ',') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN mine USING (rid)
"""
