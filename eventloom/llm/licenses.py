"""License scans by an exact set-similarity join, in DataFrame functions only.

A block is a window of the whole text, ``REACH`` times as long as a template, lines or not.  It
matches the template when it holds at least ``THRESHOLD`` of the template's distinct words,
in the template's order (longest common subsequence, at least ``THRESHOLD`` of its words), and all
of the words that tell this notice from another one.  Template words are ordered by how many
documents of the corpus hold them, rarest first.  A template of n words that needs o of them must
share one of its first n - o + 1 words with the block (prefix filter); the block must hold o
template words (length filter); a shared word at places i and j leaves at most
1 + min(rest of either) words in common (positional filter).  What is left is verified exactly.  A
window that matches holds a prefix word, so only windows around places of prefix words are looked at.

One scan of the texts gives word counts, base phrases and each document's template words;
only documents whose words could meet some template go on to the join.  The index, and the
words that are counted, are those of the templates: their size doesn't depend on the data.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventloom.llm.rows import located
from eventloom.runtime import written

THRESHOLD = 0.8
#: Words of a window by words of the template: room for what stands before each line of a comment.
REACH = 1.25
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, with their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Templates: label, a notice or a clause of a license text (at most 63 words each), and the words that other notices haven't.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0", "apache"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ""),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work", ""),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general"),
    ("lgpl", "this library is free software licensed under the gnu lesser general public license", "lesser"),
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ""),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license", "affero"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ""),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ""),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ""),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", ""),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ""),
)


def words_of(text: Column) -> Column:
    """Words of a text with A to Z lower-cased. (The Kelvin sign is the only other letter with an ASCII lower case alone.)"""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(low, NO_WORD, -1), "")


def _need(n: int, threshold: float) -> int:
    return ceil(threshold * n - 1e-9)


def _vocabulary(templates) -> list[str]:
    return sorted({w for _, t, _ in templates for w in t.split()})


def _places(words: Column) -> Column:
    """Array of (place, label): where the words of a phrase stand one after the other."""

    def label(i: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, name in PHRASES:
            same = [F.coalesce(F.get(words, i + k) == w, F.lit(False)) for k, w in enumerate(phrase.split())]
            found = F.when(reduce(lambda a, b: a & b, same), F.lit(name)).otherwise(found)
        return found

    firsts = sorted({p.split()[0] for p, _ in PHRASES})
    seconds = [p.split()[1] for p, _ in PHRASES]
    might = F.arrays_overlap(words, F.array(*map(F.lit, firsts))) & F.arrays_overlap(words, F.array(*map(F.lit, seconds)))
    empty = F.array().cast("array<struct<place: int, label: string>>")
    numbered = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.struct(i.alias("place"), label(i).alias("label")))
    return F.when(might, F.filter(numbered, lambda x: x["label"].isNotNull())).otherwise(empty)


def _scanned(docs: DataFrame, templates, threshold: float) -> DataFrame:
    """One scan: doc_id, n_words, places, held (distinct template words), text of those that could match."""
    vocabulary = _vocabulary(templates)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), words_of(F.col("text")).alias("words"))
    rows = rows.select(
        "doc_id", "text", F.size("words").cast("long").alias("n_words"), _places(F.col("words")).alias("places"),
        F.array_intersect("words", F.array(*map(F.lit, vocabulary))).alias("held"),
    )
    could = reduce(
        lambda a, b: a | b,
        [F.size(F.array_intersect("held", F.array(*map(F.lit, sorted(set(t.split())))))) >= _need(len(set(t.split())), threshold) for _, t, _ in templates],
    )
    return rows.withColumn("text", F.when(could, F.col("text")))


def _matches(rows: DataFrame, templates, order: dict[str, int], threshold: float) -> DataFrame:
    """(_at, block, template, label, containment) of all blocks that match; block is the place of a prefix word in it."""
    spark = rows.sparkSession
    forms, index = [], []
    for k, (label, text, key) in enumerate(templates):
        words = [order[w] for w in text.split()]
        ranks = sorted(set(words))
        need = _need(len(ranks), threshold)
        index += [(rank, k, i, len(ranks), need) for i, rank in enumerate(ranks[: len(ranks) - need + 1])]
        masks = [sum(1 << i for i, w in enumerate(words) if w == rank) for rank in range(len(order))]
        forms.append((k, label, sorted(set(words)), len(words), _need(len(words), threshold), ceil(REACH * len(words)), masks, (1 << len(words)) - 1, [order[w] for w in key.split()]))
    span = max(f[5] for f in forms)
    prefix = {rank for rank, *_ in index}
    rank_of = F.create_map(*[x for w, i in order.items() for x in (F.lit(w), F.lit(i))])
    docs = rows.filter("text is not null").select("_at", words_of(F.col("text")).alias("words"))
    numbered = F.transform("words", lambda w, i: F.struct(i.alias("place"), w.alias("w")))
    hits = F.filter(numbered, lambda x: x["w"].isin([w for w, i in order.items() if i in prefix]))

    def around(x: Column) -> Column:
        first = F.greatest(x["place"] - (span - 1), F.lit(0))
        near = F.slice("words", first + 1, x["place"] - first + span)
        return F.struct(x["place"].alias("block"), (x["place"] - first).alias("c"), F.transform(near, lambda w: F.coalesce(rank_of[w], F.lit(-1))).alias("near"))

    tokens = docs.select("_at", F.explode(F.transform(hits, around)).alias("x")).select("_at", "x.*")
    tokens = tokens.withColumn("rank", F.get("near", F.col("c"))).withColumn("ranks", F.array_sort(F.array_remove(F.array_distinct("near"), -1)))
    prefixes = F.broadcast(spark.createDataFrame(index, "rank int, template int, i int, size int, need int"))
    bound = 1 + F.least(F.col("size") - F.col("i"), F.size("ranks") - F.array_position("ranks", F.col("rank")) + 1) - 1
    met = tokens.join(prefixes, "rank").filter((F.size("ranks") >= F.col("need")) & (bound >= F.col("need")))
    columns = "template int, label string, full array<int>, n_words int, ordered int, reach int, masks array<bigint>, whole bigint, keys array<int>"
    full = F.broadcast(spark.createDataFrame(forms, columns))

    def in_order(window: Column) -> Column:
        """Longest common subsequence with the template: a bit stays set for each of its words that is left out."""

        def step(v: Column, rank: Column) -> Column:
            u = v.bitwiseAND(F.coalesce(F.get("masks", rank), F.lit(0).cast("long")))
            return (v + u).bitwiseOR(v - u).bitwiseAND(F.col("whole"))

        return F.col("n_words") - F.bit_count(F.aggregate(window, F.col("whole"), step))

    def held(at: Column) -> Column:
        window = F.slice("near", at + 1, F.col("reach"))
        shared = F.size(F.array_intersect("full", window))
        told = F.size(F.array_intersect("keys", window)) == F.size("keys")
        return F.when((shared >= F.col("need")) & told & (in_order(window) >= F.col("ordered")), shared)

    starts = F.sequence(F.greatest(F.col("c") - F.col("reach") + 1, F.lit(0)), F.col("c"))
    near_enough = met.join(full, "template").filter(F.size(F.array_intersect("full", "ranks")) >= F.col("need"))
    verified = near_enough.withColumn("shared", F.array_max(F.transform(starts, held))).filter("shared is not null")
    return verified.select("_at", "block", "template", "label", (F.col("shared") / F.size("full")).alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(documents with _at, matches): matches are (_at, block, template, label, containment), all that meet the threshold."""
    spark = docs.sparkSession
    rows, _ = located(written(_scanned(docs, templates, threshold), "license-scan"))  # it has no column _at of its own
    counts = {r.w: r.n for r in rows.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = {w: i for i, w in enumerate(sorted(_vocabulary(templates), key=lambda w: (counts.get(w, 0), w)))}
    return rows, _matches(rows, templates, order, threshold).distinct()


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Contract columns for every row of ``docs``.

    Null and empty texts have no word and no label; texts of any length count whole; repeated rows
    stay; of templates that match equally all give their labels; an empty table gives no row; other
    columns, whatever their names, are not looked at. score: the best containment of a matched template; 1 where a base phrase stands; else 0.
    """
    rows, matches = scan(docs.select("doc_id", "text"))
    found = matches.groupBy("_at").agg(F.collect_set("label").alias("added"), F.max("containment").alias("best"))
    labels = F.array_distinct(F.transform("places", lambda p: p["label"]))
    places = F.transform("places", lambda p: p["place"].cast("long"))
    none = F.array().cast("array<string>")
    return rows.join(found, "_at", "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("added", none))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    """DuckDB SQL for op8: every window of a text that holds enough of a template's words at all, without filters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    split = lambda c: f"regexp_extract_all(translate({c}, '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]::VARCHAR[]"
    forms = []
    for k, (label, t, key) in enumerate(TEMPLATES):
        words = t.split()
        own = sorted(set(words))
        masks = ", ".join(f"'{w}': {sum(1 << i for i, x in enumerate(words) if x == w)}" for w in own)
        forms.append(f"({k}, '{label}', {quoted(own)}, {quoted(key.split())}, MAP {{{masks}}}, {len(words)}, {_need(len(own), THRESHOLD)}, {_need(len(words), THRESHOLD)}, {ceil(REACH * len(words))})")
    phrases = ", ".join(f"('{label}', {quoted(p.split())}, {len(p.split())})" for p, label in PHRASES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, {split('text')} AS words FROM d),
p(label, phrase, k) AS (VALUES {phrases}),
hits AS (SELECT r, label, i FROM (SELECT r, words, label, phrase, k, unnest(range(0, len(words))) AS i FROM w, p
  WHERE list_contains(words, phrase[1]) AND list_contains(words, phrase[2])) WHERE words[i + 1:i + k] = phrase),
base AS (SELECT r, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM hits GROUP BY r),
t(k, label, own, keys, masks, n, need, ordered, reach) AS (VALUES {", ".join(forms)}),
blocks AS (SELECT r, t.*, words[i:i + reach - 1] AS block FROM (SELECT w.r, w.words, t.k AS tk, unnest(range(1, len(words) + 1)) AS i FROM w, t
  WHERE len(list_intersect(own, words)) >= need) JOIN t ON t.k = tk),
near AS (SELECT *, len(list_intersect(own, block)) AS shared FROM blocks),
kept AS (SELECT * FROM near WHERE shared >= need AND list_has_all(block, keys)),
told AS (SELECT *, list_reduce(list_prepend((1::BIGINT << n) - 1, list_transform(block, lambda x: coalesce(masks[x], 0)::BIGINT)),
  lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << n) - 1)) AS open FROM kept),
added AS (SELECT r, list(label) AS labels, max(shared / len(own)) AS best FROM told WHERE n - bit_count(open) >= ordered GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(added.labels, [])))), ','), '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN added USING (r)
"""


ORACLE = _oracle()
