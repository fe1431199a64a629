"""License scans: base phrases, and an exact set-containment join of text blocks with license templates. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.llm.shared import settled

# Label and wording of each template.
TEMPLATES = (
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit-notice", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "isc-license",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "3 this notice may not be removed or altered from any source distribution",
    ),
)

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The base phrases where they stand as whole consecutive words; upper and lower case of A-Z are one.
PHRASE = rf"(?<!{WORD})(?:[Mm][Ii][Tt]|[Aa][Pp][Aa][Cc][Hh][Ee]|[Gg][Ee][Nn][Ee][Rr][Aa][Ll]{GAP}[Pp][Uu][Bb][Ll][Ii][Cc]){GAP}[Ll][Ii][Cc][Ee][Nn][Ss][Ee](?!{WORD})"
LETTERS = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def lowered(text: Column | str) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column | str) -> Column:
    """Words of a text: runs of digits, letters and characters beyond ASCII; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD}+")), F.lit(0)).cast("long")


def _texts(templates: tuple[tuple[str, str], ...]) -> list[tuple[int, str, list[str]]]:
    return [(i, label, sorted(set(words.split()))) for i, (label, words) in enumerate(templates)]


def _need(size: int, threshold: float) -> int:
    """The fewest common words that reach the threshold."""
    return next(n for n in range(size + 1) if n >= threshold * size - 1e-9)


def _stretch(words: int, threshold: float) -> int:
    """Words of a wrapped notice: its template's, and as large a share of others as may be missing."""
    return next(n for n in range(words, 10 * words + 1) if n * threshold >= words - 1e-9)


def _spans(text: Column | str, reach: Column) -> Column:
    """Spans of 2 * ``reach`` words that overlap by half, so that each run of ``reach`` words is in one: arrays of (at, line, part, word).

    A line without a word ends a part; only spans of several lines stay.
    """
    lines = F.transform(F.split(text, "\n"), lambda line: F.regexp_extract_all(lowered(line), F.lit(LETTERS), F.lit(0)))
    # a part is named by the difference between a line's number and how many lines with words stand before it
    numbered = F.filter(F.transform(lines, lambda words, i: F.struct(i.alias("line"), words.alias("words"))), lambda x: F.size(x["words"]) > 0)
    flat = F.flatten(F.transform(numbered, lambda x, n: F.transform(x["words"], lambda w: F.struct(x["line"].alias("line"), (x["line"] - n).alias("part"), w.alias("word")))))
    placed = F.transform(flat, lambda x, at: F.struct(at.alias("at"), x["line"].alias("line"), x["part"].alias("part"), x["word"].alias("word")))
    starts = lambda words: F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), reach)
    # the list of one makes the words once for all spans
    spans = F.flatten(F.transform(F.array(placed), lambda words: F.transform(starts(words), lambda k: F.slice(words, k + 1, 2 * reach))))
    return F.filter(spans, lambda x: F.element_at(x, -1)["line"] > F.element_at(x, 1)["line"])


def scanned(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, template_labels (sorted arrays), score and blocks.

    Base: places where a phrase's words stand one after the other, with the first words' numbers from 0. Templates: a block meets a template
    if it holds at least ``threshold`` of its distinct words (exact). Blocks are the lines of a text and, for notices wrapped over lines,
    all runs of 1 / ``threshold`` times the template's words that no line without words interrupts. Template words are ordered from rare to
    frequent over all documents. Whole texts are joined on the templates' prefixes, the rarest words of which they must hold one, and those that
    hold enough of a template go on: their lines, and spans of words that hold such runs, are joined on the prefixes in their turn,
    checked by length and the places of the joined words, then in full, a span run by run. A text's cost grows with the templates that it meets, not
    with all there are; the templates are broadcast, as the caller has them in memory. A span's cost grows with the square of a template's length. blocks lists (label,
    line number, containment), of a span the best run by its first line; score is the largest containment, 1 where a base phrase stands, else 0.
    A null text has no words and no blocks; repeated rows are answered one by one; an empty table gives no rows. Of a long text only the spans that
    hold enough of a template's words are kept as rows.
    """
    spark = docs.sparkSession
    parts = _texts(templates)
    vocabulary = sorted({w for *_, words in parts for w in words})
    tokens = docs.select("doc_id", "text", F.regexp_extract_all(lowered("text"), F.lit(LETTERS), F.lit(0)).alias("words"))
    known = F.coalesce(F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary))), F.array().cast("array<string>"))  # a look-up a word, however many templates
    read = tokens.select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(F.size("words")).cast("long").alias("n_words"), known.alias("known"))

    stretch = [_stretch(len(words.split()), threshold) for _, words in templates]
    rows = [(i, label, w, len(words), _need(len(words), threshold), stretch[i]) for i, label, words in parts for w in words]
    listed = F.broadcast(spark.createDataFrame(rows, "template int, label string, word string, size int, need int, stretch int"))  # the templates' words, fixed
    counts = read.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    rank = Window.partitionBy("template").orderBy("n", "word")
    ordered = listed.join(counts, "word", "left").na.fill(0, ["n"]).withColumn("place", F.row_number().over(rank))
    ordered = settled(ordered.withColumn("rarer", F.collect_list("word").over(rank.rowsBetween(Window.unboundedPreceding, -1))), "templates")
    everywhere = ordered.groupBy("word").agg(F.first("n").alias("n"))
    prefix = ordered.where(F.col("place") <= F.col("size") - F.col("need") + 1)
    whole = F.broadcast(ordered.groupBy("template").agg(F.first("label").alias("label"), F.collect_list("word").alias("wording")))

    # each text's words meet the prefixes; the null word stands for the document itself, a pair of text and template for its rarest common word
    phrase = F.coalesce(F.col("text").rlike("[Ll][Ii][Cc][Ee][Nn][Ss][Ee]") & F.col("text").rlike(PHRASE), F.lit(False))
    numbered = read.withColumn("phrase", phrase).withColumn("row", F.monotonically_increasing_id())
    probed = numbered.withColumn("word", F.explode(F.concat(F.array(F.lit(None).cast("string")), "known")))
    probed = probed.join(F.broadcast(prefix.select("word", "template", "need", "stretch", "rarer")), "word", "left")
    probed = probed.where(F.col("word").isNull() | ((F.size("known") >= F.col("need")) & ~F.arrays_overlap("known", "rarer")))
    enough = F.size(F.array_intersect("known", "wording")) >= F.col("need")
    probed = probed.join(whole.drop("label"), "template", "left").where(F.col("word").isNull() | enough)
    probed = settled(probed.select("row", "doc_id", "n_words", "phrase", "template", "wording", "need", "stretch", F.when(F.col("template").isNotNull() | F.col("phrase"), F.col("text")).alias("text")), "licensedocs")
    kept = probed.where("template is null").select("row", "doc_id", "n_words", "phrase", "text")
    # a text with the templates that it may hold, its reach and their words
    may = probed.where("template is not null").groupBy("row").agg(F.first("text").alias("text"), F.collect_list(F.struct("wording", "need")).alias("wanted"), F.max("stretch").alias("reach"), F.min("need").alias("least"))
    may = settled(may.withColumn("vocabulary", F.array_distinct(F.flatten("wanted.wording"))), "licensetexts")

    places = F.regexp_extract_all("text", F.lit(PHRASE), F.lit(0))
    between = F.split("text", PHRASE, -1)
    last = F.element_at("places", -1)
    name = F.transform("places", lambda p: F.when(F.lower(p).startswith("m"), "mit").when(F.lower(p).startswith("a"), "apache").otherwise("gpl"))
    based = kept.where("phrase").select("row", "n_words", places.alias("places"), between.alias("between"))
    based = based.select(
        "row", F.size("places").cast("long").alias("n_base"), n_words(F.element_at("between", 1)).alias("first_word"),
        (F.col("n_words") - n_words(F.element_at("between", -1)) - F.when(F.lower(last).startswith("g"), 3).otherwise(2)).cast("long").alias("last_word"), F.array_sort(F.array_distinct(name)).alias("base_labels"),
    )

    lines = may.select("row", "vocabulary", "least", F.posexplode(F.split("text", "\n")).alias("block", "line"))
    lines = lines.select("row", "block", "least", F.array_intersect(F.regexp_extract_all(lowered("line"), F.lit(LETTERS), F.lit(0)), "vocabulary").alias("have"), F.lit(None).cast("array<struct<at:int,line:int,part:int,word:string>>").alias("span"))
    # blocks of spans are numbered below 0, and keep the templates' words with their places
    spans = may.select("row", "vocabulary", "wanted", F.posexplode(_spans("text", F.col("reach"))).alias("nth", "span"))
    spans = spans.select("row", "wanted", (-1 - F.col("nth")).alias("block"), F.filter("span", lambda x: F.array_contains("vocabulary", x["word"])).alias("span"))
    spans = spans.select("row", "wanted", "block", F.array_distinct(F.transform("span", lambda x: x["word"])).alias("have"), "span")
    holding = F.exists("wanted", lambda x: F.size(F.array_intersect("have", x["wording"])) >= x["need"])  # of the text's own templates
    blocks = lines.where(F.size("have") >= F.col("least")).drop("least").unionByName(spans.where(holding).drop("wanted"))
    held = blocks.select("row", "block", "span", F.explode("have").alias("word")).join(F.broadcast(everywhere), "word")
    held = held.groupBy("row", "block").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("sorted"), F.first("span").alias("span"))  # of the templates' words at most
    held = held.select("row", "block", "span", F.transform("sorted", lambda s: s["word"]).alias("have"))
    probes = held.select("row", "block", "span", "have", F.posexplode("have").alias("at", "word"))
    prefix = F.broadcast(prefix.select("template", "word", "size", "need", "stretch", "place"))
    may_reach = 1 + F.least(F.col("size") - F.col("place"), F.size("have") - F.col("at") - 1)
    first = F.row_number().over(Window.partitionBy("row", "block", "template").orderBy("place"))
    candidates = probes.join(prefix, "word").where(F.size("have") >= F.col("need")).withColumn("nth", first).where("nth = 1").where(may_reach >= F.col("need"))
    own = F.filter("span", lambda x: F.array_contains("wording", x["word"]))
    run = F.transform("own", lambda h, i: F.struct(F.size(F.array_distinct(F.transform(F.filter(F.slice("own", i + 1, F.col("stretch")), lambda g: (g["at"] < h["at"] + F.col("stretch")) & (g["part"] == h["part"])), lambda g: g["word"]))).alias("common"), h["line"].alias("line")))
    line = F.struct(F.size(F.array_intersect("have", "wording")).alias("common"), F.col("block").alias("line"))
    verified = candidates.join(whole, "template").withColumn("own", own).withColumn("best", F.when(F.col("span").isNull(), line).otherwise(F.array_max(run))).where("best.common >= need")
    verified = verified.groupBy("row", "template", F.col("best.line").alias("line")).agg(F.first("label").alias("label"), F.first("size").alias("size"), F.max("best.common").alias("common"))
    found = verified.groupBy("row").agg(F.array_sort(F.collect_set("label")).alias("template_labels"), F.max(F.col("common") / F.col("size")).alias("best"), F.array_sort(F.collect_list(F.struct("line", "label", (F.col("common") / F.col("size")).alias("containment")))).alias("blocks"))

    none = F.array().cast("array<string>")
    return kept.select("row", "doc_id", "n_words").join(based.drop("n_words"), "row", "left").join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("template_labels", none).alias("template_labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "blocks",
    )
