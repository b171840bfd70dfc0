"""License scans by diagonal voting.

All rolling word k-grams of every text are hashed and joined by Spark with the k-gram positions of license templates (a small
fixed table, broadcast). A match at text word i and template word j votes for the diagonal i - j. Votes are grouped by
(text, template, diagonal); diagonals that lie next to each other (words put in or left out) are merged; and the merged spans
are verified on the words of the text. Template phrases that stand word for word (base phrases) are one full diagonal.

Only votes are shuffled: a text without license words has none. Texts are read twice, once for their k-grams and once to verify
the candidates found. A text is known by doc_id and a hash, so rows repeated under one doc_id are answered each for itself.

Defined results: words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; null and empty texts have no words, no
place and a score of 0; score is the best verified similarity of a span to its template, 1 for a base phrase. A null doc_id is a
doc_id like any other: its rows are answered each for itself. An empty table has no rows; other columns are neither read nor returned.
A very long text has its k-grams in one row and is verified span by span; templates may be of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames, text

K = 3
#: Diagonals at most so far apart are one alignment.
NEAR = 2
#: A span is reported if so much of the template stands in it (and it has little else).
SIMILAR = 0.8

# Phrases that are found word for word, with their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Further templates, from the public texts of the licenses and their usual notices.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the gnu lesser general public license", "lgpl"),
    ("under the gnu affero general public license", "agpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]

# Whole public texts, without their titles and names.
TEXTS = [
    (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "mit",
    ),
    (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
        DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "isc",
    ),
    (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
        SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
        (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "bsd",
    ),
    (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""",
        "zlib",
    ),
    (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
        form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        "unlicense",
    ),
]


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    base: bool


def templates() -> list[Template]:
    return [Template(tuple(t.split()), label, True) for t, label in BASE.items()] + [Template(tuple(t.split()), label, False) for t, label in TEMPLATES] + [Template(tuple(_WORD.findall(t.lower())), label, False) for t, label in TEXTS]


#: Words of templates (ASCII).
_WORD = re.compile("[0-9a-z]+")


def _gram_table(every: list[Template], k: int) -> list[tuple[int, int, int]]:
    """(hash, template, position) of every k-gram."""
    out = []
    for number, t in enumerate(every):
        words = text.Words(*text.utf8(pa.array([" ".join(t.words)], pa.string())), text.ALNUM_WORDS)
        if len(words) < k:
            raise ValueError(f"a template has {k} words at least")
        out += [(int(h), number, j) for j, h in enumerate(text.signed(text.windows(words.hashes(), k)))]
    return out


def _identified(docs: DataFrame) -> DataFrame:
    return frames.doc_texts(docs).withColumn("mark", F.xxhash64("text"))


def grams(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, mark (a hash of the text) and the hashes of all its k-grams in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                words = text.Words(*text.utf8(part.column(1)), text.ALNUM_WORDS)
                every = text.windows(words.hashes(), k)
                count = np.maximum(words.count - k + 1, 0)
                own = every[text.ragged(words.first[:-1], count)] if len(every) else every
                yield pa.record_batch({"doc_id": part.column(0), "mark": part.column(2), "grams": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(text.signed(own)))})

    return _identified(docs).mapInArrow(run, "doc_id long, mark long, grams array<long>")


def candidates(docs: DataFrame, every: list[Template], k: int = K) -> DataFrame:
    """doc_id, mark, spans: array of struct(template, start, end, full); full: all k-grams of the template on one diagonal."""
    spark = docs.sparkSession
    table = spark.createDataFrame(_gram_table(every, k), "gram long, template int, at int")  # a fixed, small table
    sizes = F.array(*(F.lit(len(t.words)) for t in every))
    votes = grams(docs, k).select("doc_id", "mark", F.posexplode("grams").alias("pos", "gram")).join(F.broadcast(table), "gram")
    # the positions of a template that vote, at most as many as it has: repeated rows of one text vote for the same ones
    diagonals = votes.groupBy("doc_id", "mark", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("seen"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    diagonals = diagonals.withColumn("size", F.get(sizes, F.col("template"))).withColumn("full", F.size("seen") == F.col("size") - (k - 1))
    order = Window.partitionBy("doc_id", "mark", "template").orderBy("diagonal")
    merged = (
        diagonals.withColumn("new", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True)).cast("int"))
        .withColumn("group", F.sum("new").over(order))
        .groupBy("doc_id", "mark", "template", "group", "size")
        .agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.min(F.col("diagonal") + F.col("lo")).alias("start"), F.max(F.col("diagonal") + F.col("hi") + k).alias("end"), F.array_sort(F.collect_list(F.when(F.col("full"), F.col("diagonal")))).alias("full"))
    )
    # words covered by the matched k-grams
    covered = F.size(F.array_distinct(F.flatten(F.transform("seen", lambda at: F.sequence(at, at + (k - 1))))))
    base = F.array(*(F.lit(t.base) for t in every))
    kept = merged.where((F.get(base, F.col("template")) & (F.size("full") > 0)) | (~F.get(base, F.col("template")) & (covered >= F.col("size") * (SIMILAR - 0.1))))
    return kept.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("template", "start", "end", "full")).alias("spans"))


def similarity(words: list[str], template: tuple[str, ...]) -> float:
    """Of the best stretch: matching words in order, twice, by the words of both."""
    return SequenceMatcher(None, template, words, autojunk=False).ratio()


def best_spans(spans: list[dict]) -> list[dict]:
    """Of spans that overlap, those of the best template (licenses of one family share most of their words)."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (-s["score"], s["start"] - s["end"], s["start"], s["label"])):
        if all(s["end"] <= o["start"] or o["end"] <= s["start"] for o in out):
            out.append(s)
    return sorted(out, key=lambda s: (s["start"], s["label"]))


def scan(docs: DataFrame, every: list[Template] | None = None, k: int = K) -> DataFrame:
    """doc_id, n_words, base: array of struct(label, word), places of base phrases; found: array of struct(label, start, end, score), verified spans."""
    every = every or templates()
    found = frames.cut(candidates(docs, every, k))
    size = 64 + F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + 48 + 8 * F.size(x["full"]))  # as rows are kept in memory
    joined = _identified(docs).join(frames.broadcast_measured(found, size), ["doc_id", "mark"], "left").select("doc_id", "text", "spans")
    place = pa.struct([("label", pa.string()), ("word", pa.int64())])
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch):
                words = text.Words(*text.utf8(part.column(1)), text.ALNUM_WORDS)
                places, spans = [], []
                for i, own in enumerate(part.column(2).to_pylist()):
                    p, s = [], []
                    first, n = int(words.first[i]), int(words.count[i])
                    get = lambda a, b, first=first, n=n: [words.word(first + j).decode() for j in range(max(0, a), min(n, b))]
                    for c in own or ():
                        t = every[c["template"]]
                        if t.base:
                            p += [{"label": t.label, "word": d} for d in c["full"] if tuple(get(d, d + len(t.words))) == t.words]
                            continue
                        a, b = max(0, c["start"]), min(n, c["end"])
                        best = (similarity(get(a, b), t.words), a, b)
                        # an alignment may reach a little further on either side, where k-grams don't show it
                        for x, y in ((a - 1, b), (a, b + 1), (a - 2, b), (a, b + 2)):
                            if x >= 0 and y <= n:
                                best = max(best, (similarity(get(x, y), t.words), x, y), key=lambda v: v[0])
                        if best[0] >= SIMILAR:
                            s.append({"label": t.label, "start": best[1], "end": best[2], "score": best[0]})
                    places.append(p)
                    spans.append(best_spans(s))
                yield pa.record_batch({"doc_id": part.column(0), "n_words": words.count.astype(np.int64), "base": pa.array(places, pa.list_(place)), "found": pa.array(spans, pa.list_(span))})

    return joined.mapInArrow(run, "doc_id long, n_words long, base array<struct<label:string,word:long>>, found array<struct<label:string,start:long,end:long,score:double>>")


def report(docs: DataFrame) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score, and the verified spans as label:start:end."""
    base, found = F.col("base"), F.col("found")
    name = lambda x: x["label"]
    words = F.transform(base, lambda x: x["word"])
    both = F.array_sort(F.array_distinct(F.concat(F.transform(base, name), F.transform(found, name))))
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, name))), ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(found, lambda x: x["score"])), F.lit(0.0))).alias("score"),
        F.array_join(F.array_sort(F.transform(found, lambda x: F.concat_ws(":", x["label"], x["start"], x["end"]))), ",").alias("spans"),
    )


def base_report(docs: DataFrame) -> DataFrame:
    """Of the report, what base phrases alone decide."""
    return report(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


#: base_report in DuckDB's SQL.
BASE_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p as (select * from (values PHRASES) v(label, ws)),
a as (select doc_id, w, label, ws, unnest(range(1, len(w) - len(ws) + 2)) as j from d, p where len(w) >= len(ws)),
h as (select doc_id, label, j - 1 as word from a where w[j : j + len(ws) - 1] = ws),
s as (select doc_id, count(*) as n, min(word) as lo, max(word) as hi, string_agg(distinct label, ',' order by label) as labels from h group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_base, cast(lo as bigint) as first_word, cast(hi as bigint) as last_word, coalesce(labels, '') as base_labels from d left join s on d.doc_id = s.doc_id
""".replace("PHRASES", ", ".join(f"('{label}', {phrase.split()})" for phrase, label in BASE.items()))
