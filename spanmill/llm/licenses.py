r"""License scans: phrases by place, and an exact set-similarity join against license templates.

Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lowered. Blocks are windows of twice as many words as
one starts after the other: BLOCK_STEP, or more where a template is longer, so any run of words as long as the longest template
lies whole in a block. A block matches a
template if it holds at least ``threshold`` of the template's distinct words. The join finds every such block:

* words are ordered by document frequency over the whole corpus, rarest first,
* prefix filter: a matching block holds one of a template's first |T| - need + 1 words,
* length filter: a block with fewer than ``need`` template words of any kind cannot match,
* positional filter: with the first shared word at place i of the template and j of the block, at most
  1 + min(|T| - i - 1, |B| - j - 1) words can be shared,
* what is left is counted exactly.

DataFrame expressions only.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.session import cut

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Own wording of usual notices, by label.
TEMPLATES = {
    "apache": "licensed under the apache license version 2 0",
    "apache-notice": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "gpl": "licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "cc-by": "licensed under a creative commons attribution international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
    "warranty": "the software is provided as is without warranty of any kind express or implied",
}
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
THRESHOLD = 0.85
#: Words of a block, and from one to the next; more of both where a template is longer.
BLOCK_WORDS, BLOCK_STEP = 64, 32


def _array(words):
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _any_word(low, text, words: list[str]):
    """Whether text has one of words as a whole word. Plain searches in the lower-cased text go first: they rule most texts out."""
    part = r"[0-9A-Za-z\x80-\x{10FFFF}]"
    return F.exists(_array(words), lambda w: low.contains(w)) & text.rlike(f"(?i)(?<!{part})(?:{'|'.join(re.escape(w) for w in words)})(?!{part})")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (best containment; 1 with a phrase, 0 with neither).

    Null and empty texts have no words, no labels and score 0. Rows that repeat an id are scanned on their own. Other
    columns are not read, whatever their names. No rows give no rows.
    """
    sets = {k: sorted(set(re.findall(r"[0-9a-z]+", v))) for k, v in templates.items()}
    block_step = max(BLOCK_STEP, *(len(re.findall(r"[0-9a-z]+", v)) - 1 for v in templates.values()))  # repeated words count
    need = {k: max(1, -int(-threshold * len(v) // 1)) for k, v in sets.items()}
    vocabulary = sorted({w for v in sets.values() for w in v})
    raw = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), raw.alias("_raw"), F.lower(raw).alias("_low"))

    # Document frequencies of the template words over all documents, at most len(vocabulary) numbers. Any one order is
    # exact, so words between single spaces will do.
    seen = rows.select(F.explode(F.array_intersect(F.split("_low", " "), _array(vocabulary))).alias("w")).groupBy("w").count().collect()
    found = {r["w"]: r["count"] for r in seen}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (found.get(w, 0), w)))}
    ordered = {k: sorted(rank[w] for w in v) for k, v in sets.items()}
    prefixes = {k: v[: len(v) - need[k] + 1] for k, v in ordered.items()}
    rare = sorted({r for v in prefixes.values() for r in v})
    by_rank = sorted(rank, key=rank.get)

    starters = sorted({p.split()[0] for p in PHRASES})
    low, text = F.col("_low"), F.col("_raw")
    hit = reduce(or_, [reduce(and_, [low.contains(w) for w in p.split()]) for p in PHRASES])
    near = _any_word(low, text, [by_rank[r] for r in rare])
    words = F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))
    # In steps, so that no expression is written out (and run) twice.
    base = rows.select("doc_id", "_raw", F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), hit.alias("_hit"), near.alias("_near"))
    base = base.withColumn("_words", F.when(F.col("_hit") | F.col("_near"), words)).drop("_raw")
    places = F.filter(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: F.array_contains(_array(starters), F.element_at("_words", i + 1))),
            lambda i: F.struct(i.alias("at"), F.get(F.filter(F.array(*[F.struct(F.array(*[F.lit(x) for x in p.split()]).alias("p"), F.lit(label).alias("label")) for p, label in PHRASES.items()]), lambda p: F.slice("_words", i + 1, F.size(p["p"])) == p["p"]), 0)["label"].alias("label")),
        ),
        lambda x: x["label"].isNotNull(),
    )
    scanned = base.withColumn("_places", F.when(F.col("_hit") & (F.size("_words") > 0), places))
    # Kept once: counts of all rows, words of the few that have a rare template word. A row's number carries its block
    # results back, as ids may repeat.
    scanned = cut(scanned.select("doc_id", "n_words", "_places", F.when(F.col("_near"), F.col("_words")).alias("_words"), F.when(F.col("_near"), F.monotonically_increasing_id()).alias("_row")))
    near_rows = scanned.where("_row IS NOT NULL").select("_row", F.posexplode("_words").alias("_at", "_w"))

    ranks = docs.sparkSession.createDataFrame([(w, r) for w, r in rank.items()], "_w string, _rank int")
    tokens = near_rows.join(F.broadcast(ranks), "_w")
    step = F.floor(F.col("_at") / block_step)
    blocks = tokens.withColumn("_block", F.explode(F.array(step, step - 1))).where("_block >= 0 OR _at < 0")
    blocks = blocks.groupBy("_row", "_block").agg(F.array_sort(F.collect_set("_rank")).alias("_set")).where(F.size("_set") >= min(need.values()))
    plan = docs.sparkSession.createDataFrame(
        [(k, p, i, len(ordered[k]), need[k], ordered[k]) for k, v in prefixes.items() for i, p in enumerate(v)], "_label string, _token int, _i int, _size int, _need int, _template array<int>"
    )
    probes = blocks.select("_row", "_block", "_set", F.posexplode("_set").alias("_j", "_token")).where(F.col("_token").isin(rare))
    pairs = probes.join(F.broadcast(plan), "_token").where((F.size("_set") >= F.col("_need")) & (F.lit(1) + F.least(F.col("_size") - F.col("_i") - 1, F.size("_set") - F.col("_j") - 1) >= F.col("_need")))
    first = F.array_min(F.array_intersect("_set", "_template")) == F.col("_token")  # a pair is counted at its first shared word only
    shared = F.size(F.array_intersect("_set", "_template"))
    matches = pairs.where(first & (shared >= F.col("_need"))).groupBy("_row").agg(F.collect_set("_label").alias("_found"), F.max(shared / F.col("_size")).alias("_best"))

    slim = scanned.select("doc_id", "n_words", "_row", "_places")
    out = slim.where("_row IS NULL").withColumns({"_found": F.lit(None).cast("array<string>"), "_best": F.lit(None).cast("double")}).unionByName(slim.where("_row IS NOT NULL").join(matches, "_row", "left"))
    n_base = F.coalesce(F.when(F.col("_places").isNotNull(), F.size("_places")), F.lit(0)).cast("long")
    labels = F.coalesce(F.transform("_places", lambda p: p["label"]), F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.array_min(F.transform("_places", lambda p: p["at"])).cast("long").alias("first_word"), F.array_max(F.transform("_places", lambda p: p["at"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(labels, F.coalesce("_found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce(F.col("_best"), F.lit(0.0))).alias("score"),
    )
