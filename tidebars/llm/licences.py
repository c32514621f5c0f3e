"""License scans by diagonal voting.

The rolling word k-gram hashes of every text are joined to the positions of the same k-grams in templates. A
match at word p of a text and word q of a template votes for diagonal p - q. Diagonals of one text and template
that lie within a word or two of each other, where words were put in or left out, are merged; a span counts when
the template words it covers reach the template's threshold. Phrases of the base rule are templates with every
2-gram required on one diagonal.

Words are runs of ASCII letters and digits (lower-cased) and all non-ASCII characters. Templates are a fixed
list, so their table is broadcast; only k-grams that some template has leave a text, with their words, which
are compared again when spans are verified.

Defined results: a null or empty text has no words and no labels; null and repeated doc_ids are scanned row by
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.llm.arrow_text import PUNCTUATION, chunks, ngram_hashes, word_bounds, word_hashes
from tidebars.llm.store import materialize, small_batches

#: Base phrases and labels; fixed values of the contract.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Passages of well-known licences and the labels they vote for; fixed values.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("all-rights-reserved", "all rights reserved"),
)
PHRASE_K, TEMPLATE_K = 2, 3
#: Share of a template's words that a span has to cover (all of them below LONG_TEMPLATE words), and how far apart
#: merged diagonals may be.
COVERAGE, LONG_TEMPLATE, SLACK = 0.8, 9, 2


def _hashes(words: str, k: int) -> np.ndarray:
    data = words.encode()
    starts, ends, _ = word_bounds(np.frombuffer(data, np.uint8), np.array([0, len(data)]), PUNCTUATION, lower=True)
    return ngram_hashes(word_hashes(np.frombuffer(data, np.uint8), starts, ends, lower=True), k)


def template_grams() -> list[tuple]:
    """template, label, base, k, number of words, position, hash, words of every k-gram of the templates."""
    out = []
    for base, k, table in ((True, PHRASE_K, [(label, words) for words, label in PHRASES]), (False, TEMPLATE_K, TEMPLATES)):
        for label, text in table:
            n, words = len(out), text.split()
            for q, h in enumerate(_hashes(text, k).astype(np.int64).tolist()):
                out.append((n, label, base, k, len(words), q, h, " ".join(words[q : q + k])))
    return out


def grams(docs: DataFrame) -> DataFrame:
    """Per row: row (unique), doc_id, n_words, hits: k, word position, hash and words of k-grams that templates have."""
    known = {k: np.unique(np.array([g[6] for g in template_grams() if g[3] == k], np.int64).astype(np.uint64)) for k in (PHRASE_K, TEMPLATE_K)}
    hit_type = pa.list_(pa.struct([("k", pa.int32()), ("pos", pa.int64()), ("h", pa.int64()), ("words", pa.string())]))

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            hits: list[list] = [[] for _ in range(batch.num_rows)]
            for lo, hi, data, at in chunks(batch.column(1)):
                starts, ends, before = word_bounds(data, at, PUNCTUATION, lower=True)
                n_words[lo:hi] = np.diff(before)
                words = word_hashes(data, starts, ends, lower=True)
                for k, table in known.items():
                    own = ngram_hashes(words, k)
                    found = np.flatnonzero(table[np.minimum(np.searchsorted(table, own), len(table) - 1)] == own)
                    doc = np.searchsorted(before, found, side="right") - 1
                    whole = found + k <= before[doc + 1]
                    for p, d in zip(found[whole].tolist(), doc[whole].tolist(), strict=True):
                        text = " ".join(data[starts[p + j] : ends[p + j]].tobytes().decode("utf-8", "replace") for j in range(k))
                        hits[lo + d].append({"k": k, "pos": p - int(before[d]), "h": int(own[p].astype(np.int64)), "words": "".join(c.lower() if c < "\x80" else c for c in text)})
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + batch.num_rows)), batch.column(0), pa.array(n_words), pa.array(hits, hit_type)], names=["row", "doc_id", "n_words", "hits"])
            row += batch.num_rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, n_words long, hits array<struct<k:int,pos:long,h:long,words:string>>")


def spans(spark: SparkSession, hits: DataFrame) -> DataFrame:
    """row, template, label, base, first (word), votes, score of verified spans; hits: row, k, pos, h, words."""
    table = spark.createDataFrame(template_grams(), "template int, label string, base boolean, k int, size int, q int, h long, gram string")
    votes = hits.join(F.broadcast(table), ["k", "h"]).where(F.col("gram") == F.col("words")).withColumn("diagonal", F.col("pos") - F.col("q"))
    lines = votes.groupBy("row", "template", "label", "base", "k", "size", "diagonal").agg(F.collect_set("q").alias("q"), F.min("pos").alias("first"))
    before = F.lag("diagonal").over(Window.partitionBy("row", "template").orderBy("diagonal"))
    slack = F.when(F.col("base"), 0).otherwise(SLACK)
    lines = lines.withColumn("new", F.when(F.coalesce(F.col("diagonal") - before <= slack, F.lit(False)), 0).otherwise(1))
    lines = lines.withColumn("span", F.sum("new").over(Window.partitionBy("row", "template").orderBy("diagonal")))
    merged = lines.groupBy("row", "template", "label", "base", "k", "size", "span").agg(F.array_distinct(F.flatten(F.collect_list("q"))).alias("q"), F.min("first").alias("first"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("q", lambda q: F.sequence(q, q + F.col("k") - 1)))))
    scored = merged.withColumn("score", covered / F.col("size"))
    return scored.where(F.when(F.col("base") | (F.col("size") < LONG_TEMPLATE), F.col("score") == 1.0).otherwise(F.col("score") >= COVERAGE)).select("row", "template", "label", "base", "first", "score")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = materialize(grams(docs), "grams")
    hits = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("x")).select("row", "x.*")
    found = spans(spark, hits)
    base = F.col("base")
    own = found.groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    out = rows.select("row", "doc_id", "n_words").join(own, "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")
    )
