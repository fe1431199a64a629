"""Mixing sources to target weights with whole copies and one hashed Bernoulli copy. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.llm.shared import HOT_KEYS, free_names, own_columns, row_hash, settled

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)


def n_tokens() -> Column:
    """Runs of characters other than ASCII white space in the text; 0 for null."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def chance(seed: int, digest: Column, again: Column) -> Column:
    """A number in [0, 1) from the seed, the doc_id, the text's digest and ``again`` (null but for repeated rows), so that reruns agree."""
    hashed = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), digest, F.coalesce(again.cast("string"), F.lit(""))))
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _digest() -> Column:
    return F.coalesce(F.md5("text"), F.lit(""))


def with_chance(rows: DataFrame, digests: DataFrame, whole: Column, seed: int, name: str) -> DataFrame:
    """``rows`` (doc_id, digest column ``name``) with ``name`` replaced by each row's chance. ``digests`` (doc_id, digest) are counted.

    Rows equal in doc_id and text would all decide alike; as there are seldom any, only they are told apart: by ``whole``, a hash of what else tells
    rows apart, and those alike in that too by a number from 0. Such rows can stand for one another, so the numbers that a table's split
    gives them don't matter. They are numbered by counts of the parts they are written in, so no key's rows meet in one task.
    """
    key, part, place, before = free_names(rows, "draw_key", "draw_part", "draw_place", "draw_before")
    again = settled(digests.select(F.xxhash64("doc_id", "digest").alias(key)).groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "again")
    if again.isEmpty():
        return rows.withColumn(name, chance(seed, F.col(name), F.lit(None)))
    often = max(100, again.agg(F.sum("n")).first()[0] // HOT_KEYS)
    hot, others = F.broadcast(again.where(F.col("n") > often).select(key)), again.where(F.col("n") <= often).select(key)  # fewer hot keys than HOT_KEYS
    keyed = rows.withColumn(key, F.xxhash64("doc_id", name))
    rest = keyed.join(hot, key, "left_anti")
    repeated = keyed.join(hot, key, "left_semi").unionByName(rest.join(others, key, "left_semi"))
    repeated = settled(repeated.withColumn(key, F.xxhash64(key, whole)).withColumn(part, F.spark_partition_id()), "repeated")
    counts = repeated.groupBy(key, part).agg(F.count("*").alias("n"))
    begins = counts.select(key, part, F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))  # a row a part
    numbered = repeated.withColumn(place, F.row_number().over(Window.partitionBy(key, part).orderBy(key))).join(begins, [key, part])
    told = numbered.withColumn(name, chance(seed, F.col(name), F.concat(F.lit("|"), F.col(key), F.lit("|"), F.col(before) + F.col(place) - 1)))
    alone = rest.join(others, key, "left_anti").withColumn(name, chance(seed, F.col(name), F.lit(None)))
    return alone.drop(key).unionByName(told.drop(key, part, place, before))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the sources share ``share`` times all tokens by weight.

    Sources are ordered by code point, null last, and take the weights in turn. No target exceeds ``most`` times its source; what is cut is
    shared again by weight until none exceeds. The level at which this ends is found in one pass over the sources in the order in which they
    fill up. This ranks sources, one aggregated row each, not documents.
    """
    everything, by_name = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("place", F.row_number().over(by_name)).withColumn("cap", most * F.col("source_size"))
    ranked = ranked.withColumn("full_at", F.col("cap") / F.col("weight"))
    filling = everything.orderBy("full_at", "place")
    sooner = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(sooner), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(sooner), F.lit(0)))
    ranked = ranked.withColumn("level", level).withColumn("order", F.row_number().over(filling))
    ranked = ranked.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(F.col("level") <= F.col("full_at"), F.col("order"))).over(everything))
    return ranked.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def copies(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target and copies, the times that the mix holds the document.

    A source's repetition rate is target / source_size; each row is taken floor(rate) times and once more if its hashed chance is below
    the fraction. Rows decide one by one, those with equal or null ids too, and alike however the table is split. A null text has size 0, a null source is a source, a source
    without tokens has rate 0; an empty table gives no rows.
    """
    rows = settled(docs.select("doc_id", "source", n_tokens().alias("size"), _digest().alias("digest")), "tokens")
    rates = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    n = (F.floor(rate) + (F.col("digest") < rate - F.floor(rate)).cast("long")).cast("long")
    rows = with_chance(rows, rows, F.xxhash64("source", F.col("source").isNull()), seed, "digest")
    return rows.join(rates, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "source_size", "target", n.alias("copies"))


def mixed(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs`` as the mix has them: each row repeated as :func:`copies` decides, with its own columns. Texts are not shuffled, unless rows repeat ids and texts."""
    light = settled(docs.select("doc_id", "source", n_tokens().alias("size"), _digest().alias("digest")), "tokens")
    rates = targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    of, per, drawn, copy = free_names(docs, "of", "rate", "chance", "copy")
    rates = settled(rates.select(F.col("source").alias(of), rate.alias(per)), "rates")
    keyed = with_chance(docs.withColumn(drawn, _digest()), light.select("doc_id", "digest"), row_hash(docs), seed, drawn)
    n = (F.floor(per) + (F.col(drawn) < F.col(per) - F.floor(per)).cast("long")).cast("int")
    taken = keyed.join(rates, F.col("source").eqNullSafe(F.col(of))).withColumn(copy, F.explode(F.array_repeat(F.lit(0), n)))
    return taken.select(own_columns(docs))
