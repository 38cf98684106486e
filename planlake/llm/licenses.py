"""License scan by diagonal voting.

All rolling word pairs of every text meet the word pairs of the license templates in an equi-join on
their hash (the pair itself confirms). A hit votes for the diagonal text position minus template
position. Votes are summed by diagonal; diagonals of one template that are at most SLACK apart merge
into one region. A region of a base phrase is one diagonal that holds every pair of it: the phrase word
for word. Other regions are aligned first: the diagonal with most votes is the region's line, and only
votes within SLACK of it count, so hits far away that a chain of diagonals joined to it neither add to a
region nor spoil its extent. The span is then verified: different places of the template (not votes, which
common pairs repeat) must be LEAST of all, within the words that the template's length and SLACK allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Merged diagonals are at most SLACK apart; a region names its license from LEAST of the template's pairs on.
SLACK, LEAST = 3, 0.6
#: Fixed phrases: label, words, whether it is one of the base phrases that are found word for word.
TEMPLATES = [
    ("mit", "mit license", True),
    ("apache", "apache license", True),
    ("gpl", "general public license", True),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", False),
    ("apache-header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", False),
    ("apache-2.0", "licensed under the apache license version 2 0", False),
    ("gpl-3.0", "is licensed under the gnu general public license version 3", False),
    ("gpl-header", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", False),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", False),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", False),
    ("mit-notice", "released under the mit license", False),
    ("mit-notice-text", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", False),
    ("mit-text", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", False),
    ("bsd-text", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", False),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", False),
    ("lgpl-header", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", False),
    ("unlicense", "this is free and unencumbered software released into the public domain", False),
]


def template_pairs(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template, label, base, n_pairs, place, pair of every word pair of the templates, and one row for the sentinel pair ''."""
    rows = [(-1, None, False, 0, 0, "")]
    for t, (label, text, base) in enumerate(templates):
        words = text.split()
        rows += [(t, label, base, len(words) - 1, i, f"{a} {b}") for i, (a, b) in enumerate(zip(words, words[1:]))]
    return spark.createDataFrame(rows, "template int, label string, base boolean, n_pairs int, place int, pair string")


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, spans, n_base, first_word, last_word, base_labels, labels, score of every row of docs (doc_id, text).

    Words are runs of ASCII letters (lower-cased) and digits and of non-ASCII characters. spans: label,
    base, start, end (words) and score of every region. n_base counts the places of base phrases,
    first_word and last_word are their least and greatest start (null if there is none). score is the
    best region's (0 without any). Null and empty texts have no words. Repeated rows stay; other columns
    are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(text, SPLIT), lambda w: w != "")
    # the sentinel brings every document through the join; words reach the lambda as one column
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", words.alias("_words"))
    pairs = F.transform(F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get("_words", i + 1)))
    rows = rows.select("_row", "doc_id", F.size("_words").alias("_n"), F.posexplode(F.concat(F.array(F.lit("")), pairs)).alias("_at", "_pair"))
    known = template_pairs(spark, templates)  # some hundred rows, from the constant above
    hits = rows.withColumn("_h", F.xxhash64("_pair")).join(F.broadcast(known.withColumn("_h", F.xxhash64("pair"))), "_h").where(F.col("_pair") == F.col("pair"))
    votes = hits.groupBy("_row", "template", (F.col("_at") - 1 - F.col("place")).alias("diagonal")).agg(
        F.first("doc_id").alias("doc_id"), F.max("_n").alias("_n"), F.first("label").alias("label"), F.first("base").alias("base"), F.max("n_pairs").alias("n_pairs"),
        F.count("*").alias("votes"), F.collect_set("place").alias("places"), F.min("place").alias("from"), F.max("place").alias("to"),
    )
    line = W.partitionBy("_row", "template").orderBy("diagonal")
    slack = F.when(F.col("base"), 0).otherwise(SLACK)
    votes = votes.withColumn("_new", F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= slack, 0).otherwise(1)).withColumn("_region", F.sum("_new").over(line))
    main = F.max(F.struct("votes", (-F.col("diagonal")).alias("d"))).over(W.partitionBy("_row", "template", "_region"))
    votes = votes.withColumn("_line", -main["d"]).where(F.abs(F.col("diagonal") - F.col("_line")) <= SLACK)
    regions = votes.groupBy("_row", "template", "_region").agg(
        F.first("doc_id").alias("doc_id"), F.max("_n").alias("_n"), F.first("label").alias("label"), F.first("base").alias("base"), F.max("n_pairs").alias("n_pairs"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"), F.min(F.col("diagonal") + F.col("from")).alias("start"), F.max(F.col("diagonal") + F.col("to") + 2).alias("end"),
    )
    share = F.try_divide("votes", "n_pairs")
    ok = F.when(F.col("base"), F.col("votes") == F.col("n_pairs")).otherwise((share >= LEAST) & (F.col("end") - F.col("start") <= F.col("n_pairs") + 1 + 2 * SLACK))
    regions = regions.withColumn("_ok", F.coalesce((F.col("template") >= 0) & ok, F.lit(False))).withColumn("score", F.when(F.col("_ok"), share).otherwise(0.0))
    base = F.col("_ok") & F.col("base")
    span = F.struct("label", "base", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "score")
    join = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return (
        regions.groupBy("_row")
        .agg(
            F.first("doc_id").alias("doc_id"), F.max("_n").cast("long").alias("n_words"), F.sort_array(F.collect_list(F.when(F.col("_ok"), span))).alias("spans"),
            F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            join(F.when(base, F.col("label"))).alias("base_labels"), join(F.when(F.col("_ok"), F.col("label"))).alias("labels"), F.max("score").alias("score"),
        )
        .drop("_row")
    )
