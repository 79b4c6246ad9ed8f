"""License scans by diagonal voting.

A word is a run of letters, digits or characters beyond ASCII, with A-Z lower-cased.  All rolling
word k-gram hashes of every text are joined in Spark to the positions of the license templates'
grams (a constant of this module, so the join is a broadcast of known size).  Matches vote by
document, template and offset diagonal; neighbouring diagonals, as words put in or left out make,
merge; a merged span is verified if its matched grams cover enough of the template's words.
Base phrases are counted on the words themselves in the pass that makes the grams.

The score is the largest covered part of a template over all spans, and at least ``BASE_SCORE`` with a base phrase.

Defined results: null text has no words; without a base phrase the positions are null; label
strings are empty without labels; a text of any length is scanned whole; of spans of one template the best counts;
repeated rows are scanned and returned each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosswind.llm._shared import map_rows

#: Fixed values of the contract.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Own labels and the statements that bear them, short references and whole notices, as words in lower case.
TEMPLATES = (
    ("afl-3.0", "licensed under the academic free license version 3 0"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    ("artistic-2.0", "this is free software you can redistribute it and or modify it under the terms of the artistic license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (
        "bsl-1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
    ),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under the creative commons attribution share alike license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    (
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 2 of the license or at your option any later version",
    ),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("public-domain", "this work has been released into the public domain by its author"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    ),
)
GRAM = 3
#: Diagonals this close, with matches this close, are one span; part of the words to be covered.
NEIGHBOURS = 2
COVERED = 0.8
#: What a base phrase alone scores; beyond that the score is the best span's covered part.
BASE_SCORE = 0.5
WORD_ENTRIES = 300_000

_KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c > 0x7F else 0x20 for c in range(256))
_FIRST = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """The words as UTF-8; all that separates words is ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Hashes()


def gram_hashes(words: list[bytes], k: int = GRAM) -> np.ndarray:
    """Rolling hashes of all runs of k words, never 0, which marks the start of a text."""
    if len(words) < k:
        return np.zeros(0, np.int64)
    one = np.array([_WORDS[w] for w in words], np.uint64)
    n = len(one) - k + 1
    out = one[:n].copy()
    for i in range(1, k):
        out = out * _FIRST + one[i : i + n]
    out ^= out >> np.uint64(31)
    out[out == 0] = 1
    return out.view(np.int64)


def _base(words: list[bytes], phrases: list[list[bytes]]) -> tuple[int, int | None, int | None, int]:
    """Places of all phrases, smallest and largest start, and a bit for each phrase found."""
    n, first, last, bits = 0, None, None, 0
    for b, phrase in enumerate(phrases):
        at = -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(phrase)] == phrase:
                n, bits = n + 1, bits | 1 << b
                first, last = at if first is None else min(first, at), at if last is None else max(last, at)
    return n, first, last, bits


PASS = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("base", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType())),
])


def _labels(bits: Column, names: tuple[str, ...]) -> Column:
    return F.concat(*[F.when(F.getbit(bits, F.lit(i)) == 1, F.array(F.lit(n))).otherwise(F.array().cast("array<string>")) for i, n in enumerate(names)])


def scan(spark: SparkSession, docs: DataFrame, templates=TEMPLATES, base=BASE, gram: int = GRAM) -> DataFrame:
    """A row for each document; see the module."""
    phrases = [p.encode().split() for p, _ in base]

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            n_words, found, arrays = [], [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                n_words.append(len(words))
                found.append(_base(words, phrases))
                arrays.append(np.zeros(1, np.int64))
                arrays.append(gram_hashes(words, gram))
            sizes = [1 + len(a) for a in arrays[1::2]]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            grams = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(arrays)))
            return {"row": batch.column(0), "doc_id": batch.column(1), "n_words": n_words, "n_base": [f[0] for f in found], "first_word": [f[1] for f in found], "last_word": [f[2] for f in found], "base": [f[3] for f in found], "grams": grams.cast(pa.list_(pa.field("element", pa.int64())))}

        return work

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    at = [(0, -1, 0)]
    for t, (_, words) in enumerate(templates):
        at += [(int(h), t, i) for i, h in enumerate(gram_hashes(words.encode().split(), gram))]
    places = spark.createDataFrame(at, "gram long, template int, place int")
    own = ["n_words", "n_base", "first_word", "last_word", "base"]
    votes = (
        map_rows(rows, PASS, make).select("row", "doc_id", *own, F.posexplode("grams").alias("pos", "gram")).join(F.broadcast(places), "gram")
        .select("row", "doc_id", *[F.when(F.col("template") < 0, F.col(c)).alias(c) for c in own], "template", (F.col("pos") - 1).alias("pos"), "place")
        .groupBy("row", "doc_id", "template", (F.col("pos") - F.col("place")).alias("diagonal"))
        .agg(*[F.max(c).alias(c) for c in own], F.min("pos").alias("from"), F.max("pos").alias("to"), F.collect_set("place").alias("places"))
    )
    one = Window.partitionBy("row", "template").orderBy("diagonal")
    length = F.element_at(F.array(*[F.lit(len(w.split())) for _, w in templates]), F.when(F.col("template") < 0, 1).otherwise(F.col("template") + 1))
    apart = (F.col("diagonal") - F.lag("diagonal").over(one) > NEIGHBOURS) | (F.col("from") - F.lag("to").over(one) > length)
    spans = (
        votes.withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(one))
        .groupBy("row", "doc_id", "template", "span")
        .agg(*[F.max(c).alias(c) for c in own], F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    )
    words = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (gram - 1)))))  # of the template
    part = F.when(F.col("template") >= 0, F.size(words) / length).otherwise(F.lit(0.0))
    names = tuple(sorted({n for n, _ in templates}))
    number = F.element_at(F.array(*[F.lit(names.index(n)) for n, _ in templates]), F.when(F.col("template") < 0, 1).otherwise(F.col("template") + 1))
    bit = F.when((F.col("template") >= 0) & (part >= COVERED), F.call_function("shiftleft", F.lit(1).cast("long"), number)).otherwise(F.lit(0).cast("long"))
    out = spans.groupBy("row", "doc_id").agg(*[F.max(c).alias(c) for c in own], F.max(part).alias("part"), F.bit_or(bit).alias("own"))
    base_labels, labels = _labels(F.col("base"), tuple(n for _, n in base)), _labels(F.col("own"), names)
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, labels)), ",").alias("labels"), F.greatest(F.least("part", F.lit(1.0)), F.when(F.col("n_base") > 0, BASE_SCORE).otherwise(0.0)).alias("score"),
    )
