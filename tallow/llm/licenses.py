"""License scans by diagonal voting, natively.

All rolling word 2-grams of a text are hashed and joined to the positions of the same 2-grams in the
templates, a small fixed table. A hit at word p against template position q votes for the diagonal
p - q, the word at which the template would begin. Votes are summed by diagonal; neighbouring diagonals
of a longer template merge (words inserted or left out); a span is verified by the share of the
template's informative 2-grams found in it. A phrase needs all its 2-grams on one diagonal, which is
the phrase itself standing there.

Cases: null text counts as empty. Repeated rows are counted once each and returned once each; rows that
share an id but not the text are apart. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The phrases and labels asked for.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Short notices, found whole.
NOTICES = (
    ("the mit license", "mit"),
    ("the apache license", "apache"),
    ("apache license version 2 0", "apache"),
    ("the bsd license", "bsd"),
    ("3 clause bsd license", "bsd"),
    ("2 clause bsd license", "bsd"),
    ("mozilla public license", "mpl"),
    ("lesser general public license", "lgpl"),
    ("affero general public license", "agpl"),
    ("eclipse public license", "epl"),
    ("the isc license", "isc"),
    ("the boost software license", "boost"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("creative commons attribution", "cc-by"),
    ("creative commons zero", "cc0"),
    ("dedicated to the public domain", "public-domain"),
)
#: Passages of licenses, found by a share of their 2-grams.
PASSAGES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unlicense"),
    ("this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit", "cc-by"),
)
#: A 2-gram of two of these words says nothing about a passage.
PLAIN = frozenset("a an and any any are as at be by copy for from in is it of on or that the this to under with".split())


def templates(base: Sequence[tuple[str, str]] = BASE, notices: Sequence[tuple[str, str]] = NOTICES, passages: Sequence[tuple[str, str]] = PASSAGES, least_share: float = 0.6) -> list[tuple]:
    """Rows (template, label, base, place, first word, second word, 2-grams in all, 2-grams needed, slack)."""
    out, n = [], 0
    for texts, is_base, share, slack in ((base, True, 1.0, 0), (notices, False, 1.0, 0), (passages, False, least_share, 6)):
        for text, label in texts:
            words = text.split()
            grams = [(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:])) if not slack or not (a in PLAIN and b in PLAIN)]
            out += [(n, label, is_base, i, a, b, len(grams), -int(-len(grams) * share // 1), slack) for i, a, b in grams]
            n += 1
    return out


def _values(rows: list[tuple]) -> str:
    shown = lambda x: "'" + x + "'" if isinstance(x, str) else str(x).lower()
    return ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


_NAMES = "template, label, base, place, a, b, grams, needed, slack"


def template_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The templates' 2-grams by hash, and a row of template -1 that stands for a text as a whole (hash null there)."""
    t = spark.sql(f"select * from values {_values(rows)} as t({_NAMES})")
    return t.select("template", "label", "base", "place", F.xxhash64("a", "b").alias("h"), "grams", "needed", "slack")


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: list[tuple] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    table = template_table(docs.sparkSession, rows or templates())
    w = F.col("w")
    hashes = F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    whole = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), words(F.col(text)).alias("w"))
    # rows alike in id and text are told apart by the task that reads them, so that many of them do not meet in one task
    whole = whole.select("doc_id", "t", F.spark_partition_id().alias("part"), F.size("w").cast("bigint").alias("n_words"), hashes.alias("hs"))
    # the last element pairs the last word with nothing; a leading null keeps texts without any hit
    places = whole.select("doc_id", "t", "part", "n_words", F.posexplode(F.concat(F.array(F.lit(None).cast("bigint")), "hs")).alias("at", "h"))
    hits = places.join(F.broadcast(table), "h", "left").filter("at = 0 or template is not null")
    hits = hits.select("doc_id", "t", "part", "n_words", (F.col("at") - 1).cast("bigint").alias("word"), F.coalesce("template", F.lit(-1)).alias("template"), "label", "base", "place", "grams", "needed", "slack")
    hits = hits.repartition("doc_id", "t", "part")  # all that follows groups within a document
    votes = hits.groupBy("doc_id", "t", "part", "n_words", "template", "label", "base", "grams", "needed", "slack", (F.col("word") - F.coalesce("place", F.lit(0))).alias("diagonal"))
    votes = votes.agg(F.collect_set("place").alias("places"), F.count("*").alias("copies"), F.min("word").alias("first"), F.max("word").alias("last"))
    along = Window.partitionBy("doc_id", "t", "part", "template").orderBy("diagonal")
    votes = votes.withColumn("begins", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.col("slack"), F.lit(True)).cast("int"))
    votes = votes.withColumn("span", F.sum("begins").over(along))
    spans = votes.groupBy("doc_id", "t", "part", "n_words", "template", "label", "base", "grams", "needed", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("found"), F.min("diagonal").alias("start"), F.max("copies").alias("copies"))
    good = (F.col("template") >= 0) & (F.col("found") >= F.col("needed"))
    is_base = good & F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = spans.groupBy("doc_id", "t", "part", "n_words").agg(
        F.max(F.when(F.col("template") < 0, F.col("copies"))).alias("copies"),
        F.sum(F.when(is_base, 1).otherwise(0)).cast("bigint").alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).alias("last_word"),
        joined(is_base).alias("base_labels"),
        joined(good).alias("labels"),
        F.coalesce(F.max(F.when(F.col("template") >= 0, F.col("found") / F.col("grams"))), F.lit(0.0)).alias("score"),
    )
    out = out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle(rows: list[tuple] | None = None) -> str:
    return rf"""
with tpl as (select * from (values {_values(rows or templates())}) as t({_NAMES})),
d as (select row_number() over () as r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p as (select r, w, unnest(range(0, len(w) - 1)) as i from d where len(w) > 1),
g as (select r, i, w[i + 1] as a, w[i + 2] as b from p),
v as (select r, template, label, base, grams, needed, slack, i - place as diagonal, list(distinct place) as places
      from g join tpl using (a, b) group by all),
s as (select *, case when diagonal - lag(diagonal) over (partition by r, template order by diagonal) <= slack then 0 else 1 end as begins from v),
u as (select *, sum(begins) over (partition by r, template order by diagonal) as span from s),
spans as (select r, template, label, base, grams, needed, span, min(diagonal) as start,
                 len(list_distinct(flatten(list(places)))) as found from u group by all),
m as (select r, count(*) filter (base and found >= needed) as n_base, min(start) filter (base and found >= needed) as first_word,
             max(start) filter (base and found >= needed) as last_word,
             string_agg(distinct label, ',' order by label) filter (base and found >= needed) as base_labels,
             string_agg(distinct label, ',' order by label) filter (found >= needed) as labels, max(found / grams::double) as score
      from spans group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from d left join m using (r)
"""
