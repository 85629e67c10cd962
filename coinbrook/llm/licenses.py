"""License scans by diagonal voting.

Every rolling pair of words of every text is hashed and joined to the positions of
equal pairs in the license templates; the gram that the template has there (a whole
phrase, or GRAM words of a notice or license text) has to follow word by word. A match
votes for its diagonal (place in the text minus place in the template). Votes are
gathered by text, template and diagonal. Neighbouring diagonals are merged: from each
diagonal on, those at most a band apart in all (SHARE of the template's words, BAND at
least) make a span, so words put in or left out may shift it by that much in total and
no further. A span counts if the grams found in it cover MIN_COVER of the template's
words (phrases: all of them, on one diagonal), and of spans of a template that are less
than a band apart the best covered, then the earliest, stands.

The templates are a fixed table of this module, some hundred rows of grams, so
they alone are broadcast. Every text sends one row besides its votes, so one pass
over the texts is enough, and the texts themselves are never shuffled. The shuffle's
key is the text's content (its id and a 128-bit hash), so a license line in a third of
all texts spreads over all tasks, and a task that is run again sends the same keys.

Defined results: a null or empty text has no words, no spans and score 0; rows that
repeat a document share its votes and are listed as often as they occur; ties between
labels are listed together; an empty table gives an empty result; further columns of
the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coinbrook.llm.common import documents

#: What stands between words, after A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words that are hashed for the join, and words of a notice's grams.
PAIR, GRAM = 2, 4
#: Words that may be put in or left out in a span, in all: this share of the template's, and at least so many.
SHARE, BAND = 0.05, 3
#: Share of a notice's words that a span has to hold.
MIN_COVER = 0.8
#: Diagonals are scaled so that any template's band is as wide.
_SCALE = 1000


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    words: str
    base: bool = False


#: Base phrases, then this scanner's notices.
TEMPLATES = (
    Template("cc_by", "cc-by", "cc by", base=True),
    Template("general_public_license", "gpl", "general public license", base=True),
    Template("all_rights_reserved", "reserved", "all rights reserved", base=True),
    Template("mit_line", "mit", "released under the mit license"),
    Template("mit_grant", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache_line", "apache-2.0", "licensed under the apache license version 2 0"),
    Template("bsd_grant", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl_line", "gpl", "licensed under the gnu general public license version"),
    Template("gpl_grant", "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("lgpl_line", "lgpl", "gnu lesser general public license"),
    Template("mpl_line", "mpl-2.0", "subject to the terms of the mozilla public license"),
    Template("cc_line", "cc-by", "licensed under a creative commons attribution"),
    Template("cc_by_nc", "cc-by-nc", "licensed under cc by nc"),
    Template("unlicense", "unlicense", "free and unencumbered software released into the public domain"),
    Template(
        "mit_text",
        "mit",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or
        sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
        fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other
        liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings
        in the software""",
    ),
    Template(
        "isc_text",
        "isc",
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
        copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with
        regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special
        direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
        negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    ),
    Template(
        "bsd_text",
        "bsd",
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
        documentation and or other materials provided with the distribution
        this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to
        the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or
        contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement
        of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in
        contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the
        possibility of such damage""",
    ),
    Template(
        "zlib_text",
        "zlib",
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising
        from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to
        alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not
        claim that you wrote the original software""",
    ),
    Template(
        "apache_notice",
        "apache-2.0",
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a
        copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed
        under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for
        the specific language governing permissions and limitations under the license""",
    ),
    Template(
        "gpl_notice",
        "gpl",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the
        free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it
        will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu
        general public license for more details""",
    ),
)


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case. ``lower`` also changes letters beyond ASCII, which no template has; the one among them that would become ASCII, the Kelvin sign, is put aside first."""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e9"))), BETWEEN), "")


def template_grams(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Each template's grams: template, t_pos, the gram's words and the hash of its first pair; and the row that every text meets (template -1)."""
    rows = [(-1, -1, 0, [""] * PAIR)]
    for i, t in enumerate(templates):
        words = t.words.split()
        k = len(words) if t.base else min(GRAM, len(words))
        rows += [(i, p, k, words[p : p + k]) for p in range(len(words) - k + 1)]
    df = spark.createDataFrame(rows, "template int, t_pos int, k int, t_gram array<string>")
    return df.withColumn("pair", F.xxhash64(F.col("t_gram")[0], F.col("t_gram")[1]))


#: A document: its id and its text's hash. Rows that repeat it share the key.
_KEY = ["doc_id", "h1", "h2", "n_words"]


def votes(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """The document's key, template, diagonal, pos and t_pos of every match; template -1 once for each row of ``df``."""
    docs = documents(df).select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), words_of(F.col("text")).alias("w"))
    # Each place carries its few words, never the text, and takes them one by one (a slice would copy the whole array): a text's work grows with its length.
    # The number of words is taken inside too: beside the explosion it would keep the words of the text there.
    n_words = F.size("w").cast("long").alias("n_words")
    longest = max([GRAM, *(len(t.words.split()) for t in templates if t.base)])
    places = F.transform(F.sequence(F.lit(0), F.size("w") - PAIR), lambda i: F.struct(F.xxhash64(F.col("w")[i], F.col("w")[i + 1]).alias("pair"), F.array(*[F.get("w", i + j) for j in range(longest)]).alias("gram"), n_words))
    none = F.array().cast("array<struct<pair:bigint,gram:array<string>,n_words:bigint>>")
    own = F.array(F.struct(F.xxhash64(F.lit(""), F.lit("")).alias("pair"), F.array().cast("array<string>").alias("gram"), n_words))
    each = docs.select("doc_id", "h1", "h2", F.posexplode(F.concat(own, F.when(F.size("w") >= PAIR, places).otherwise(none))).alias("p", "place")).select("doc_id", "h1", "h2", "p", "place.*")
    table = F.broadcast(template_grams(df.sparkSession, templates))
    # The own row comes first, so a pair that starts at word i is at i + 1.
    same = (F.col("template") == -1) & (F.col("p") == 0) | (F.col("template") >= 0) & (F.col("p") > 0) & (F.slice("gram", 1, F.col("k")) == F.col("t_gram"))
    hit = each.join(table, "pair").filter(same)
    pos = F.col("p") - 1
    return hit.select(*_KEY, "template", (pos - F.col("t_pos")).alias("diagonal"), pos.alias("pos"), "t_pos", "k")


def spans(hits: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Verified spans by document: template, start, end (words, end exclusive) and cover; n counts equal votes. The own row comes with template -1."""
    of = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.greatest(F.col("template"), F.lit(0)) + 1)
    lengths = [len(t.words.split()) for t in templates]
    exact = (F.col("template") < 0) | of([t.base for t in templates])
    found = F.sequence(F.col("t_pos"), F.col("t_pos") + F.greatest("k", F.lit(1)) - 1)
    lines = hits.groupBy(*_KEY, "template", "diagonal").agg(F.count("*").alias("n"), F.min("pos").alias("start"), F.max(F.col("pos") + F.col("k")).alias("end"), F.array_distinct(F.flatten(F.collect_list(found))).alias("seen"))
    place = lines.withColumn("place", (F.col("diagonal") * (_SCALE / of([float(max(BAND, int(SHARE * n))) for n in lengths]))).cast("long"))
    by = Window.partitionBy(*_KEY, "template").orderBy("place")
    ahead = by.rangeBetween(0, _SCALE)
    banded = lambda one, many: F.when(exact, one).otherwise(many.over(ahead))
    n_seen = F.size(F.when(exact, F.col("seen")).otherwise(F.array_distinct(F.flatten(F.collect_list("seen").over(ahead)))))
    merged = place.select(*_KEY, "template", "place", "n", banded(F.col("start"), F.min("start")).alias("start"), banded(F.col("end"), F.max("end")).alias("end"), (n_seen / of(lengths)).alias("cover"))
    good = merged.filter((F.col("template") < 0) | (F.col("cover") >= F.when(exact, F.lit(1.0)).otherwise(F.lit(MIN_COVER))))
    rank = F.struct("cover", (-F.col("start")).alias("back"), (-F.col("place")).alias("first"))
    best = good.withColumn("best", F.max(rank).over(by.rangeBetween(-_SCALE, _SCALE))).filter(exact | (F.col("best") == rank))
    return best.select(*_KEY, "template", "n", "start", "end", F.when(F.col("template") >= 0, F.col("cover")).alias("cover"))


def scan(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and found_spans (label, start, end), a row for each row of ``df``."""
    label = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.greatest(F.col("template"), F.lit(0)) + 1)
    base = (F.col("template") >= 0) & F.element_at(F.array(*[F.lit(t.base) for t in templates]), F.greatest(F.col("template"), F.lit(0)) + 1)
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, label))), ",")
    found = (
        spans(votes(df, templates), templates)
        .groupBy(*_KEY)
        .agg(
            F.count_if(base).cast("long").alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            joined(base).alias("base_labels"),
            joined(F.col("template") >= 0).alias("labels"),
            F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(F.col("template") >= 0, F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), label.alias("label"))))).alias("found_spans"),
            F.max(F.when(F.col("template") < 0, F.col("n"))).alias("rows"),
        )
    )
    # A row for each row that had this id and text.
    return found.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("row")).drop("h1", "h2", "rows", "row")
