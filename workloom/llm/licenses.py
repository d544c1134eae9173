"""License scans by diagonal voting, in DataFrame operations only.

Every run of ``K`` words of every text is hashed and joined to the places of the same run in the license templates. A hit
votes for a diagonal: its place in the text less that in the template. Diagonals of a template that lie within ``NEAR`` of the
next one are merged, which bridges words left out or put in. A merged diagonal is verified as a span: the template's words
under its hits must be at least ``COVER`` of the template, and the span not much longer than the template.

The template table has a few hundred runs for each text, fixed in this module, so its broadcast is bounded. Texts are read and split
once: a row gives one entry of its own, with the places of the base phrases, and one for each run that meets a template.
These are written under a number for each row, and votes are counted by it.

Defined results
    null text: as an empty one, n_words 0, no labels, score 0. null doc_id: carried through. Repeated rows, and rows that
    share a doc_id or have none: each is judged by its own text. Templates that lie over each other: each that is verified
    gives its label. Empty table: no rows. Very long texts: in proportion to their length. Other columns of the input,
    whatever their names, are not read and not returned.
    score: the largest covered share of a verified template; 0.5 for a base phrase alone; 0 without labels.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from workloom.llm.runtime import materialize

#: Words of a run, gap of diagonals that are merged, and least covered share of a template.
K, NEAR, COVER = 4, 3, 0.75

#: What separates words, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels of the base scan.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Texts, notices and statements of well-known licenses, by SPDX-like label.
TEMPLATES = (
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-2-clause-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-disclaimer-text", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd-3-clause-text", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("zlib-text", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
    ("unlicense-text", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("apache-2.0-text", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program"),
    ("mpl-2.0-text", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0"),
    ("cc-by-deed", "you are free to share copy and redistribute the material in any medium or format adapt remix transform and build upon the material for any purpose even commercially"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-statement", "released under the mit license"),
    ("apache-2.0-notice", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0-statement", "licensed under the apache license version 2.0"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3.0-statement", "this work is licensed under the gnu general public license version 3"),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0-notice", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("cc-by-statement", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc-statement", "licensed under cc by nc 4.0"),
    ("cc-by-sa-statement", "licensed under cc by sa 4.0"),
    ("unlicense-notice", "this is free and unencumbered software released into the public domain"),
)


def lowered(text: Column) -> Column:
    """A null as an empty text; A to Z in lower case, other letters as they are."""
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), SEPARATORS), "")


def _runs(w: Column) -> Column:
    """The hash of the run that begins at each place; none in a text of fewer words."""
    starts = F.slice(w, 1, F.greatest(F.size(w) - (K - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, K)]))


def templates(spark: SparkSession, table: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """run, label, place, length: one row for each run of each template, as one constant expression."""
    pairs = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(text).alias("text")) for label, text in table])
    one = spark.range(1, numPartitions=1).select(F.explode(pairs).alias("t")).select("t.label", _words(F.col("t.text")).alias("_w"))
    return one.select("label", F.size("_w").alias("length"), F.posexplode(_runs(F.col("_w"))).alias("place", "run"))


def _base_places(w: Column, maybe: Column) -> dict[str, Column]:
    """By label: the places where its phrase's words follow each other. maybe: whether a text can hold any phrase."""

    def places(phrase: str) -> Column:
        ws = phrase.split()
        follows = lambda i: F.forall(F.sequence(F.lit(1), F.lit(len(ws) - 1)), lambda j: F.get(w, i + j) == F.get(F.array(*map(F.lit, ws)), j))
        at = F.filter(F.transform(w, lambda x, i: F.when((x == ws[0]) & F.coalesce(follows(i), F.lit(False)), i)), lambda i: i.isNotNull())
        return F.when(maybe, at).otherwise(F.array().cast("array<int>"))

    return {label: places(p) for p, label in PHRASES.items()}


def entries(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Of each row one entry with _at null, and one for each run at _at of its text that stands in a template."""
    maybe = "|".join(SEPARATORS.join(map(re.escape, p.split())) for p in PHRASES)
    low = lowered(F.col("text").cast("string"))
    split = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", low.alias("_low")).select(
        "_row", "doc_id", F.array_remove(F.split("_low", SEPARATORS), "").alias("_w"), F.col("_low").rlike(maybe).alias("_maybe")
    )
    w, found = F.col("_w"), {label: F.col(f"_{label}") for label in PHRASES.values()}
    placed = split.select("_row", "doc_id", "_w", *[c.alias(f"_{label}") for label, c in _base_places(w, F.col("_maybe")).items()])
    every = F.concat(*found.values())
    labels = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for label, c in found.items()]))
    based = placed.select(
        "_row",
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.sort_array(labels).alias("_base"),
        F.concat(F.array(F.lit(None).cast("long")), _runs(w)).alias("_runs"),
    )
    # A select of its own, as what it copies to each run must not have the words in it. It is an outer one, though no array is empty:
    # for others Spark puts a filter on the array's size below, with all that makes the array copied into its lambdas.
    each = based.select(*[c for c in based.columns if c != "_runs"], F.posexplode_outer("_runs").alias("_at", "_run"))
    met = each.join(F.broadcast(table), F.col("_run") == F.col("run"), "left").filter("_at = 0 OR label IS NOT NULL")
    return met.drop("_run", "run").withColumn("_at", F.nullif(F.col("_at"), F.lit(0)) - 1)


def spans(hits: DataFrame) -> DataFrame:
    """_row, label, first (word of the text), covered (share of the template) of every verified span."""
    votes = hits.groupBy("_row", "label", "length", (F.col("_at") - F.col("place")).alias("_diagonal")).agg(
        F.collect_set("place").alias("_places"), F.min("_at").alias("_from"), F.max("_at").alias("_to")
    )
    order = Window.partitionBy("_row", "label").orderBy("_diagonal")
    gap = F.col("_diagonal") - F.lag("_diagonal").over(order)
    merged = votes.withColumn("_new", F.coalesce(gap > NEAR, F.lit(True)).cast("int")).withColumn("_span", F.sum("_new").over(order))
    found = merged.groupBy("_row", "label", "length", "_span").agg(
        F.array_distinct(F.flatten(F.collect_list("_places"))).alias("_places"), F.min("_from").alias("first"), F.max("_to").alias("_to")
    )
    words = F.size(F.array_distinct(F.flatten(F.transform("_places", lambda p: F.sequence(p, p + (K - 1))))))
    covered = words / F.col("length")
    fits = F.col("_to") + K - F.col("first") <= F.col("length") * 1.25 + NEAR
    return found.select("_row", "label", "first", covered.alias("covered")).filter((F.col("covered") >= COVER) & fits)


def scan(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    table = table if table is not None else templates(docs.sparkSession)
    seen = materialize(entries(docs, table))
    found = spans(seen.filter("_at IS NOT NULL")).groupBy("_row").agg(F.collect_set("label").alias("_more"), F.max("covered").alias("_covered"))
    both = seen.filter("_at IS NULL").join(found, "_row", "left")
    labels = F.sort_array(F.array_distinct(F.concat("_base", F.coalesce("_more", F.array().cast("array<string>")))))
    return both.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.when(F.col("_covered").isNotNull(), F.least("_covered", F.lit(1.0))), F.when(F.col("n_base") > 0, 0.5), F.lit(0.0)).alias("score"),
    )


_VALUES = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)
_PHRASE_VALUES = ", ".join(f"('{phrase}', '{label}')" for phrase, label in PHRASES.items())
_CUT = f"list_filter(regexp_split_to_array(translate(%s, '{ascii_uppercase}', '{ascii_lowercase}'), '{SEPARATORS}'), lambda x: x <> '')"

#: DuckDB SQL for the query's rows: runs are compared as words, not as hashes.
ORACLE_SQL = f"""
WITH d AS (SELECT rid, doc_id, {_CUT % "t"} AS w FROM (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)),
place_of AS (SELECT rid, w, unnest(range(len(w))) AS i FROM d),
p AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {_PHRASE_VALUES}) v(phrase, label)),
b AS (SELECT rid, i, label FROM place_of JOIN p ON w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p),
base AS (SELECT rid, count(*) AS n, min(i) AS a, max(i) AS z, list_sort(list_distinct(list(label))) AS labels FROM b GROUP BY 1),
t AS (SELECT label, {_CUT % "text"} AS w FROM (VALUES {_VALUES}) v(label, text)),
tr AS (SELECT label, len(w) AS n, i AS place, array_to_string(w[i + 1 : i + {K}], ' ') AS g FROM (SELECT label, w, unnest(range(len(w) - {K - 1})) AS i FROM t)),
h AS (SELECT rid, label, n, i, place FROM (SELECT rid, i, array_to_string(w[i + 1 : i + {K}], ' ') AS g FROM place_of WHERE i + {K} <= len(w)) JOIN tr USING (g)),
v AS (SELECT rid, label, n, i - place AS diagonal, list(DISTINCT place) AS places, min(i) AS a, max(i) AS z FROM h GROUP BY ALL),
m AS (SELECT *, sum(CASE WHEN gap <= {NEAR} THEN 0 ELSE 1 END) OVER (PARTITION BY rid, label ORDER BY diagonal) AS span
      FROM (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY rid, label ORDER BY diagonal) AS gap FROM v)),
f AS (SELECT rid, label, n, min(a) AS a, max(z) AS z, list_distinct(flatten(list_transform(flatten(list(places)), lambda x: range(x, x + {K})))) AS words
      FROM m GROUP BY rid, label, n, span),
s AS (SELECT rid, list(DISTINCT label) AS labels, max(len(words) / n) AS covered FROM f
      WHERE len(words) / n >= {COVER} AND z + {K} - a <= n * 1.25 + {NEAR} GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(base.a AS BIGINT) AS first_word, CAST(base.z AS BIGINT) AS last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(s.labels, [])))), ',') AS labels,
       coalesce(s.covered, CASE WHEN base.n > 0 THEN 0.5 ELSE 0.0 END) AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN s USING (rid)
"""
