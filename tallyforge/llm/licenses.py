"""License scans by diagonal voting.

The rolling k-grams of words of all texts are joined by hash to the places of the
same k-grams in license templates. A match at word ``i`` of a text and word ``j``
of a template votes for the diagonal ``i - j``. Votes are summed per diagonal,
neighbouring diagonals of one template are merged (a word put in or left out moves
a copy to the next diagonal), and the merged span is verified: the words of every
voting k-gram are compared, not only their hashes, and the share of the template
that the span covers must reach a threshold. A template that a text holds word by
word has a full diagonal, which gives the exact phrase matches.

Everything here is DataFrame functions that run in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import ascii_lower, staged, words

#: What parts words: the ASCII characters that are no digits or letters (texts are in lower case).
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
K = 3

#: Phrases whose exact places count, with their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Opening passages of common licenses, for the method's own labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Diagonals of one template merge when at most so many words apart.
MERGE = 3
#: Share of a template's k-grams that a merged span must hold.
COVERAGE = 0.6
#: A template table of at most so many k-grams is broadcast; a larger one is joined by hash.
SMALL_GRAMS = 100_000


def templates_table(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """A row for each template: tid, label, exact (whether its exact places count) and its words."""
    rows = [(i, label, exact, text.split()) for i, (label, exact, text) in enumerate([(a, True, b) for a, b in phrases] + [(a, False, b) for a, b in templates])]
    if short := [r for r in rows if len(r[3]) < K]:
        raise ValueError(f"templates need {K} words: {short}")
    return spark.createDataFrame(rows, "tid int, label string, exact boolean, tws array<string>")


def template_grams(templates: DataFrame) -> DataFrame:
    """A row for each k-gram place of each template."""
    at = templates.select("tid", "tws", F.posexplode("tws").alias("tpos", "w"))
    gram = F.slice("tws", F.col("tpos") + 1, K)
    return at.filter(F.size("tws") - F.col("tpos") >= K).select("tid", "tpos", (F.size("tws") - (K - 1)).alias("tgrams"), F.xxhash64(*[F.get(gram, F.lit(i)) for i in range(K)]).alias("hash"), gram.alias("tgram"))


def votes(docs: DataFrame, grams: DataFrame, n_grams: int) -> DataFrame:
    """Rows (uid, tid, pos, tpos) of all k-grams of texts that a template has; a row with null tid for each text.

    With a template table that is broadcast, the words stay in an array beside the
    exploded place, so a k-gram is hashed and looked up in generated code without
    being copied, and only the few that match are written out. With a larger one only
    places and hashes are shuffled, and the words of texts with a match once more.
    """
    if n_grams > SMALL_GRAMS:
        docs = staged(docs.select("uid", "ws"), "license-words")
        place = docs.filter(F.size("ws") >= K).select("uid", "ws", F.posexplode("ws").alias("pos", "w"))
        hashed = place.filter(F.col("pos") <= F.size("ws") - K).select("uid", "pos", F.xxhash64(*[F.get("ws", F.col("pos") + i) for i in range(K)]).alias("hash"))
        hit = hashed.join(grams, "hash").drop("hash").join(docs, "uid")
        hit = hit.filter(F.slice("ws", F.col("pos") + 1, K) == F.col("tgram")).select("uid", F.size("ws").cast("long").alias("n_words"), "tid", "pos", "tpos", "tgrams")
        none = docs.select("uid", F.size("ws").cast("long").alias("n_words"))
        return hit.unionByName(none, allowMissingColumns=True)
    ws = docs.select("uid", F.size("ws").cast("long").alias("n_words"), "ws", F.posexplode_outer("ws").alias("pos", "w"))
    key = F.when(F.col("pos") <= F.size("ws") - K, F.xxhash64(*[F.get("ws", F.col("pos") + i) for i in range(K)]))
    hit = ws.withColumn("hash", key).join(F.broadcast(grams) if n_grams <= SMALL_GRAMS else grams, "hash", "left")
    same = F.slice("ws", F.col("pos") + 1, K) == F.col("tgram")
    return hit.filter(F.col("tid").isNull() & (F.coalesce("pos", F.lit(0)) == 0) | same | F.col("tid").isNotNull() & (F.col("pos") == 0)).select("uid", "n_words", F.when(same, F.col("tid")).alias("tid"), "pos", "tpos", "tgrams")


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places where an exact phrase's words stand consecutively;
    first_word and last_word are the smallest and the largest such place, null if
    there is none. Labels are distinct, sorted and joined by commas; an empty
    string if there are none. score is the best coverage of a template, 0 without
    a vote. A null text has no words. Repeated rows each get their row. Only
    doc_id and text are read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    templates = templates_table(spark) if templates is None else templates
    grams = template_grams(templates)
    n_grams = grams.count()
    named = templates.select("tid", "label", "exact")
    # Rows get a key of their own in a narrow table, so a doc_id may repeat or be null.
    texts = docs.select("doc_id", words(ascii_lower(F.col("text")), SEPARATORS).alias("ws")).withColumn("uid", F.struct("doc_id", F.monotonically_increasing_id().alias("row")))
    found = staged(votes(texts, grams, n_grams), "license-votes")
    rows = found.groupBy("uid").agg(F.first("n_words").alias("n_words"))
    diagonal = found.filter("tid is not null").groupBy("uid", "tid", (F.col("pos") - F.col("tpos")).alias("diag"), "tgrams").agg(F.count(F.lit(1)).alias("n_votes"), F.collect_set("tpos").alias("held"))
    run = W.partitionBy("uid", "tid").orderBy("diag")
    new = F.coalesce(F.col("diag") - F.lag("diag").over(run) > MERGE, F.lit(True))
    merged = diagonal.withColumn("part", F.sum(new.cast("int")).over(run))
    span = merged.groupBy("uid", "tid", "part").agg(
        F.max("tgrams").alias("tgrams"),
        F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"),
        F.sum(F.when(F.col("n_votes") == F.col("tgrams"), 1).otherwise(0)).alias("whole"),
        F.min(F.when(F.col("n_votes") == F.col("tgrams"), F.col("diag"))).alias("first"),
        F.max(F.when(F.col("n_votes") == F.col("tgrams"), F.col("diag"))).alias("last"),
    )
    cover = F.size("held") / F.col("tgrams")
    span = span.withColumn("cover", cover).join(F.broadcast(named) if n_grams <= SMALL_GRAMS else named, "tid")
    exact = F.col("exact") & (F.col("whole") > 0)
    by_doc = span.groupBy("uid").agg(
        F.sum(F.when(exact, F.col("whole")).otherwise(0)).alias("n_base"),
        F.min(F.when(exact, F.col("first"))).alias("first_word"),
        F.max(F.when(exact, F.col("last"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(exact, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(exact | (F.col("cover") >= COVERAGE), F.col("label")))), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    out = rows.join(by_doc, "uid", "left")
    return out.select(
        "uid.doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0)).alias("score"),
    )
