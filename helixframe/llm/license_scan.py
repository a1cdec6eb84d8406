"""License scans by diagonal voting.

Native: the rolling k-gram hashes of all words are joined to the template positions; matches vote for the offset
diagonal (place in the text less place in the template), and neighbouring diagonals are merged. Matched grams are
compared word by word with the template's; a span counts by the longest chain of them that is in order in the text
and in the template. Only matches are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Label and phrase of the base search.
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
#: Sentences of the licenses' usual headers, notices and bodies.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("lgpl", "see the gnu lesser general public license for more details"),
    ("agpl", "the terms of the gnu affero general public license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0", "licensed under the cc0 1 0 universal public domain dedication"),
)
GRAM = 3
#: Diagonals this near are merged: a few words more or fewer inside the notice.
NEAR = 2
#: Part of a long template's size by which diagonals may be apart as well.
WIDE = 0.25
#: Part of a template's words that a span must hold in order.
LEAST_COVER = 0.8
DELIMITER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one letter outside A-Z that lower() turns into a letter a-z; another stands in for it.
KELVIN, STAND_IN = "\u212a", "\u0138"


def joined_words(text: Column) -> Column:
    """Lower-cased words with one space before, between and after them. What lower() does to letters beyond A-Z changes no word of ASCII letters."""
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(STAND_IN)))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, DELIMITER, " ")), F.lit(" "))


def word_count(joined: Column) -> Column:
    return F.when(joined == "  ", 0).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) - 1)


def gram_texts(joined: Column, n_words: Column, k: int = GRAM) -> Column:
    """All k-grams as an array of arrays: element j holds those that start at words j, j + k, and so on. Each is one linear scan."""
    scan = F.lit(" ".join(["[^ ]++"] * k))
    out, start = [], F.lit(2)
    for j in range(k):
        found = F.regexp_extract_all(joined.substr(start, F.length(joined)), scan, F.lit(0))
        out.append(F.when(n_words >= k + j, found).otherwise(F.array().cast("array<string>")))
        start = F.call_function("locate", F.lit(" "), joined, start) + 1
    return F.array(*out)


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    """(template, place, hash, size) of the templates, each with at least k words."""
    rows = [(i, at, " ".join(words[at : at + k]), len(words)) for i, (_, text) in enumerate(templates) for words in [text.split()] for at in range(len(words) - k + 1)]
    return spark.createDataFrame(rows, "template int, place int, gram string, size int").select("template", "place", "size", F.col("gram").alias("words"), F.xxhash64("gram").alias("hash"))


def base_places(words: Column, phrases=PHRASES) -> Column:
    """Places of the phrases: structs of first word, last word and label, phrase by phrase."""
    def places(label: str, parts: list[str]) -> Column:
        def stands(i: Column) -> Column:
            out = F.get(words, i) == parts[0]
            for j, w in enumerate(parts[1:], 1):
                out = out & F.coalesce(F.get(words, i + j) == w, F.lit(False))
            return out

        at = F.filter(F.transform(words, lambda w, i: i), stands)
        return F.transform(at, lambda i: F.struct(i.alias("first"), (i + len(parts) - 1).alias("last"), F.lit(label).alias("label")))

    return F.concat(*(places(label, phrase.split()) for label, phrase in phrases))


def base_pattern(phrases=PHRASES) -> str:
    """A regular expression that finds whether any phrase stands in joined words."""
    return f" (?:{'|'.join(p for _, p in phrases)}) "


def chain_cover(hits: Column, k: int = GRAM) -> Column:
    """Words of the longest chain of matched grams (at, place) that go up in the text and in the template."""

    def longer(chain: Column, hit: Column) -> Column:
        ways = F.transform(chain, lambda e: F.when((e["at"] < hit["at"]) & (e["place"] < hit["place"]), e["best"] + F.least(F.lit(k), hit["at"] - e["at"], hit["place"] - e["place"])).otherwise(F.lit(k)))
        return F.concat(chain, F.array(F.struct(hit["at"].alias("at"), hit["place"].alias("place"), F.coalesce(F.array_max(ways), F.lit(k)).alias("best"))))

    chains = F.aggregate(F.array_sort(hits), F.array().cast("array<struct<at:int,place:int,best:int>>"), longer)
    return F.array_max(F.transform(chains, lambda e: e["best"]))


def matched_spans(rows: DataFrame, templates=TEMPLATES, k: int = GRAM, near: int = NEAR, least: float = LEAST_COVER, wide: float = WIDE) -> DataFrame:
    """Verified spans of rows (key, joined, n): key, template, first and last word, cover.

    Diagonals are merged twice, over gaps of `near` words and of a part of the template; a span may come from both.
    """
    spark = rows.sparkSession
    grams = template_grams(spark, templates, k)
    lanes = rows.select("key", F.posexplode(gram_texts(F.col("joined"), F.col("n"), k)).alias("lane", "found"))
    hits = lanes.select("key", "lane", F.posexplode("found").alias("turn", "gram")).select("key", (F.col("turn") * k + F.col("lane")).alias("at"), "gram", F.xxhash64("gram").alias("hash")).join(F.broadcast(grams), "hash").where(F.col("gram") == F.col("words"))
    votes = hits.groupBy("key", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.min("at").alias("first"), (F.max("at") + k).alias("end"), F.collect_set("place").alias("places"), F.first("size").alias("size"))
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    gaps = {"near": F.lit(near), "wide": F.greatest(F.lit(near), F.floor(F.col("size") * wide).cast("int"))}
    votes = votes.withColumns({name: F.sum(F.when(F.coalesce(step > gap, F.lit(True)), 1).otherwise(0)).over(order) for name, gap in gaps.items()})
    matches = F.transform("places", lambda p: F.struct((F.col("diagonal") + p).alias("at"), p.alias("place")))
    votes = votes.select("key", "template", "first", "end", "size", matches.alias("hits"), F.inline(F.array(*(F.struct(gap.alias("gap"), F.lit(name).alias("kind"), F.col(name).alias("run")) for name, gap in gaps.items()))))
    merged = votes.groupBy("key", "template", "kind", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.flatten(F.collect_list("hits")).alias("hits"), F.first("size").alias("size"), F.first("gap").alias("gap"))
    # The words that the matched grams stand for, in any order, are a bound; a span much longer than its template is no copy of it.
    held = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["place"], h["place"] + k - 1)))))
    short = F.col("end") - F.col("first") <= F.col("size") + F.col("gap")
    cover = F.when(short, F.when(held >= least * F.col("size"), chain_cover(F.col("hits"), k) / F.col("size")))
    return merged.withColumn("cover", cover).where(F.col("cover") >= least).select("key", "template", "first", (F.col("end") - 1).alias("last"), "cover")


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, k: int = GRAM, least: float = LEAST_COVER) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base places come from the phrases. The method adds a template's label where the template's words stand, up to
    1 - least of them missing or changed. The score is 1 where a base phrase stands, else the best cover. A null
    text has no words. Rows keep their own result even if ids repeat or are null; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), joined_words(F.col("text")).alias("joined"))
    rows = rows.withColumn("n", word_count(F.col("joined")))
    # Only texts that hold a phrase are split, into a column of their own, so that the lambdas don't split them again.
    rows = rows.withColumn("words", F.when(F.col("joined").rlike(base_pattern(phrases)), F.split(F.trim("joined"), " ")).otherwise(F.array().cast("array<string>")))
    base = rows.select("doc_id", "key", F.col("n").cast("long").alias("n_words"), base_places(F.col("words"), phrases).alias("base"))
    found = matched_spans(rows.select("key", "joined", "n"), templates, k, least=least)
    label = F.element_at(F.array(*(F.lit(name) for name, _ in templates)), F.col("template") + 1)
    added = found.groupBy("key").agg(F.collect_set(label).alias("added"), F.max("cover").alias("cover"))
    out = base.join(added, "key", "left")
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda x: x["label"]), F.coalesce("added", F.array().cast("array<string>")))))
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.transform("base", lambda x: x["first"])).cast("long").alias("first_word"), F.array_max(F.transform("base", lambda x: x["first"])).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.when(F.size("base") > 0, 1.0).otherwise(F.least(F.coalesce("cover", F.lit(0.0)), F.lit(1.0))).alias("score"),
    )
