"""Source divergence audit: term counts by source, compared between sources once for each distinct vector of counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.llm.bytewords import LETTERS, LOWER, coded_words
from framelake.llm.shared import settled, steps

#: Text bytes of one step: the more, the more often a source's term repeats within it.
STEP = 16 << 20
#: Shares are whole billionths, from counts with this much added to each.
SCALE, ADDED = 1_000_000_000, 2


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each step: occurrences, and documents with one."""
    for rows, data, offsets in steps(batches, most=STEP):
        code, text_no, words = coded_words(LOWER[data], offsets, LETTERS)
        if not len(words):
            continue
        names = [pc.dictionary_encode(rows.column(c)) for c in ("lang", "source")]
        lang, source = (c.indices.to_numpy().astype(np.int64) for c in names)
        group = lang * len(names[1].dictionary) + source
        pair, tf = np.unique(text_no * len(words) + code, return_counts=True)
        key, at = np.unique(group[pair // len(words)] * len(words) + pair % len(words), return_inverse=True)
        n, docs = np.bincount(at, tf, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
        of, term = key // len(words), key % len(words)
        size = len(names[1].dictionary)
        yield pa.RecordBatch.from_arrays([names[0].dictionary.take(pa.array(of // size)), names[1].dictionary.take(pa.array(of % size)), words.take(pa.array(term)).cast(pa.string()), pa.array(n), pa.array(docs.astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def share(n: str, total: str) -> Column:
    """1 + the whole part of ``SCALE`` * (n + ``ADDED``) / total, without overflow."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({n} + {ADDED} as decimal(20, 0))) div cast({total} as decimal(20, 0))")


def apart(p: str, q: str) -> Column:
    """(p - q)^2 / (p + q), whole part: symmetric, and within 64 bits for shares."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source): how far each source's terms are from the other sources' and from the language's.

    Terms are runs of letters and characters beyond ASCII, only A-Z lower-cased; a language keeps those in ``least_docs`` of its documents or more.
    A source's and a language's share of a kept term is smoothed and a whole number. ``pair`` rows rank the language's other sources by the
    divergence summed over all kept terms; ``term`` rows give the ``top`` terms of which a source has a larger share than its language. Ranks go by
    value, then by item in UTF-8.

    Kept terms with the same counts in the same sources are one vector with a multiplicity. The sum over all terms of a pair is that of two sources
    that lack every term, corrected once for each count of one source, and once for each vector that both have; so each pair of a vector's own sources
    is evaluated once, whatever its multiplicity, and absent sources cost nothing. For ``term`` rows a vector's first ``top`` terms are enough, as
    all its terms have one value; these are the original terms that are ranked.

    Null text, lang and source count as ''; texts without a term still make their source occur; a source without kept terms, or a language that keeps
    none, has pairs with what follows from counts of 0 (0 without kept terms). Repeated rows count each; an empty table gives no rows; other columns,
    whatever their names, are left out. A worker holds one step of texts or one longer text.
    """
    t = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    counts = t.mapInArrow(_term_counts, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))  # an entry a source
    kept = settled(kept.where(F.col("docs") >= least_docs).select("lang", "term", "vector"), "keptterms")
    vectors = settled(kept.groupBy("lang", "vector").agg(F.count("*").alias("many")), "countvectors")

    entries = vectors.select("lang", "many", F.inline("vector")).groupBy("lang", "source", "n").agg(F.sum("many").alias("many"))
    entries = settled(entries, "countentries")
    sums = entries.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("many")).alias("n"))
    langs = vectors.groupBy("lang").agg(F.sum("many").alias("terms"), F.sum(F.col("many") * F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x["n"])).alias("lang_n"))
    groups = t.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = groups.select("lang", "source", "terms", (F.col("n") + ADDED * F.col("terms")).alias("total"), (F.col("lang_n") + ADDED * F.col("terms")).alias("lang_total"))
    groups = settled(groups.withColumn("none", F.when(F.col("terms") > 0, share("0L", "total"))), "countgroups")

    left = groups.select("lang", F.col("source").alias("a"), "terms", F.col("total").alias("a_total"), F.col("none").alias("a_none"))
    right = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("b_total"), F.col("none").alias("b_none"))
    pairs = settled(left.join(right, "lang").where("a <> b"), "sourcepairs")  # as many as the result has
    empty = pairs.where("a < b").select("lang", "a", "b", F.when(F.col("terms") > 0, F.col("terms") * apart("a_none", "b_none")).otherwise(0).alias("value"))
    one = entries.withColumnRenamed("source", "a").join(pairs, ["lang", "a"]).withColumn("a_share", share("n", "a_total"))
    one = one.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("many") * (apart("a_share", "b_none") - apart("a_none", "b_none"))).alias("value"))
    both = vectors.select("lang", "many", "vector", F.posexplode("vector").alias("at", "x")).select("lang", "many", F.col("x.source").alias("a"), F.col("x.n").alias("a_n"), F.explode(F.slice("vector", F.col("at") + 2, F.size("vector"))).alias("y"))
    both = both.select("lang", "many", "a", "a_n", F.col("y.source").alias("b"), F.col("y.n").alias("b_n")).join(left, ["lang", "a"]).join(right, ["lang", "b"])
    both = both.withColumns({"a_share": share("a_n", "a_total"), "b_share": share("b_n", "b_total")})
    both = both.select("lang", "a", "b", (F.col("many") * (apart("a_share", "b_share") - apart("a_share", "b_none") - apart("a_none", "b_share") + apart("a_none", "b_none"))).alias("value"))
    summed = empty.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    paired = summed.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.source", "x.item", "value")

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    paired = paired.withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))
    first = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", "vector").orderBy("term"))).where(F.col("place") <= top)
    told = first.select("lang", F.col("term").alias("item"), F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("lang_n"), F.inline("vector")).join(groups, ["lang", "source"])
    told = told.withColumns({"p": share("n", "total"), "q": share("lang_n", "lang_total")}).where("p > q").select("lang", "source", "item", apart("p", "q").alias("value"))
    told = told.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return paired.select("lang", "source", "part", "item", "value", "rank").unionByName(told.select("lang", "source", "part", "item", "value", "rank"))
