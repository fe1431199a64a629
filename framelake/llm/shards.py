"""Sharding by fixed virtual slots and a versioned slot-to-shard map. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.llm.shared import free_names, own_columns, row_hash, settled

#: Virtual slots; fixed for a corpus' lifetime, so that only the map is ever edited.
SLOTS = 4096
#: A slot that holds more than this part of a shard's bytes is split; its further parts have numbers beyond the slots, ``SLOTS`` apart.
HEAVY = 0.125
#: Rows that are ranked in one task, about.
RANKED = 100_000


def slot_of(slots: int = SLOTS) -> Column:
    """A row's virtual slot: the hash of its doc_id and text, so that neither one id nor one text fills a slot."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int")


def size_of() -> Column:
    """UTF-8 bytes of the text (null: none) plus 16 for the row."""
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")


def slot_sizes(sized: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, n) of every slot, empty ones too, from rows with virtual_slot and size (and n, if they stand for several); summed before the shuffle."""
    sums = sized.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), (F.sum("n") if "n" in sized.columns else F.count("*")).alias("n"))
    every = sized.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "full_outer").na.fill(0, ["bytes", "n"])


def heavy_slots(sizes: DataFrame, shards: int) -> DataFrame:
    """(virtual_slot, parts) of slots heavier than ``HEAVY`` of a shard's share; there are fewer than shards / ``HEAVY``."""
    share = F.greatest(F.sum("bytes").over(Window.partitionBy(F.lit(0))) / shards * HEAVY, F.lit(1.0))  # over the slots
    return sizes.withColumn("parts", F.ceil(F.col("bytes") / share).cast("int")).where("parts > 1 and n > 1").select("virtual_slot", "parts")


def split_slots(rows: DataFrame, heavy: DataFrame, by: Column, slots: int = SLOTS) -> DataFrame:
    """``rows`` with the virtual_slot of heavy slots' rows dealt over their parts by the number ``by``."""
    parts, = free_names(rows, "parts")
    dealt = rows.join(F.broadcast(heavy.withColumnRenamed("parts", parts)), "virtual_slot", "left")
    part = F.coalesce(F.pmod(by, F.col(parts)), F.lit(0))
    return dealt.withColumn("virtual_slot", (F.col("virtual_slot") + slots * part).cast("int")).drop(parts)


def rebalanced(sizes: DataFrame, shards: int, current: DataFrame | None = None, version: int = 1) -> DataFrame:
    """The next version of the slot-to-shard map: (version, virtual_slot, shard, moved_from, bytes, n).

    ``current`` (virtual_slot, shard) is the map in force. Slots stay where they are as long as their shard's bytes stay within the mean;
    the others, and slots of no shard or of one that is gone, go one by one, largest first, to the shard with the fewest bytes. The fold
    runs over the slots, a fixed number, never over rows.
    """
    held = sizes.join(current.select("virtual_slot", F.col("shard").alias("moved_from")), "virtual_slot", "left") if current is not None else sizes.withColumn("moved_from", F.lit(None).cast("int"))
    mean = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / shards
    filled = F.sum("bytes").over(Window.partitionBy("moved_from").orderBy(F.desc("bytes"), "virtual_slot"))
    held = held.withColumn("stays", F.coalesce((F.col("moved_from") < shards) & (filled <= mean), F.lit(False)))
    listed = held.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "bytes", "n", "moved_from", "stays"))).alias("all"))
    zeros = F.array_repeat(F.lit(0).cast("long"), shards)

    def added(loads: Column, shard: Column, size: Column) -> Column:
        return F.transform(loads, lambda v, i: F.when(i == shard, v + size).otherwise(v))

    def place(acc: Column, s: Column) -> Column:
        to = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        return F.struct(added(acc["loads"], to, s["bytes"]).alias("loads"), F.concat(acc["owners"], F.array(to)).alias("owners"))

    listed = listed.select(F.filter("all", lambda s: s["stays"]).alias("kept"), F.filter("all", lambda s: ~s["stays"]).alias("free"))
    start = F.struct(F.aggregate("kept", zeros, lambda acc, s: added(acc, s["moved_from"], s["bytes"])).alias("loads"), F.array().cast("array<int>").alias("owners"))
    placed = listed.withColumn("owners", F.aggregate("free", start, place)["owners"])
    rows = F.concat(F.transform("kept", lambda s: F.struct(s.alias("s"), s["moved_from"].alias("shard"))), F.transform("free", lambda s, i: F.struct(s.alias("s"), F.get("owners", i).alias("shard"))))
    flat = placed.select(F.explode(rows).alias("r"))
    return flat.select(F.lit(version).alias("version"), F.col("r.s.virtual_slot").alias("virtual_slot"), F.col("r.shard").alias("shard"), F.col("r.s.moved_from").alias("moved_from"), F.col("r.s.bytes").alias("bytes"), F.col("r.s.n").alias("n"))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Appends a version to the stored map; versions are directories, and one that exists is an error, so it is never rewritten or doubled."""
    version = slot_map.agg(F.min("version"), F.max("version")).first()
    if version[0] is None or version[0] != version[1]:
        raise ValueError("a map has rows of one version")
    slot_map.repartition(1).write.mode("error").parquet(f"{path}/v={version[0]}")


def latest_map(stored: DataFrame) -> DataFrame:
    """The map in force: rows of the highest version."""
    return stored.join(F.broadcast(stored.agg(F.max("version").alias("version"))), "version", "left_semi")


def sharded(docs: DataFrame, shards: int = 40, slots: int = SLOTS) -> DataFrame:
    """``docs`` with virtual_slot, shard and map_version; the shards' bytes are near equal. Texts are not shuffled.

    A heavy slot is split by the hash of whole rows, so only rows that are equal in all columns stay together. Columns of ``docs`` with the new
    names are replaced; null ids and texts are hashed like others; an empty table gives no rows.
    """
    own = docs.drop("virtual_slot", "shard", "map_version")
    whole, size = free_names(own, "whole_row", "row_size")
    keyed = own.withColumns({"virtual_slot": slot_of(slots), whole: row_hash(own), size: size_of()})
    light = settled(keyed.select("virtual_slot", F.col(whole).alias("whole"), F.col(size).alias("size")), "slots")
    heavy = settled(heavy_slots(slot_sizes(light, slots), shards), "heavy")
    slot_map = settled(rebalanced(slot_sizes(split_slots(light, heavy, F.col("whole"), slots), slots), shards), "slotmap")
    small = F.broadcast(slot_map.select("virtual_slot", "shard", F.col("version").alias("map_version")))  # one row a slot
    return split_slots(keyed, heavy, F.col(whole), slots).join(small, "virtual_slot").select(*own_columns(own), "virtual_slot", "shard", "map_version")


def shard_places(docs: DataFrame, shards: int = 40, slots: int = SLOTS) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, virtual_slot, shard, place (gapless from 0 in its shard) and map_version.

    Bytes per shard are near equal, whatever rows share an id or a text: a heavy slot is split by the rows' own numbers. Rows are ranked within
    fine parts of a slot that grow in number with the table, and the parts of a shard follow each other. Null texts have 16 bytes and checksum
    0, that of no bytes; repeated rows get places of their own; an empty table gives no rows.
    """
    rows = docs.select("doc_id", size_of().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), slot_of(slots).alias("virtual_slot"))
    rows = settled(rows.withColumn("row", F.monotonically_increasing_id()), "sized")
    heavy = settled(heavy_slots(slot_sizes(rows, slots), shards), "heavy")
    fine = max(1, rows.count() // (slots * RANKED))
    rows = split_slots(rows, heavy, F.col("row"), slots).withColumn("fine", F.pmod(F.xxhash64("doc_id", "text_crc32", "row"), F.lit(fine)).cast("int"))
    counts = settled(rows.groupBy("virtual_slot", "fine").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "counts")
    slot_map = settled(rebalanced(slot_sizes(counts, slots), shards), "slotmap")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "fine").rowsBetween(Window.unboundedPreceding, -1))
    small = F.broadcast(slot_map.select("virtual_slot", "shard", F.col("version").alias("map_version")))  # one row a slot
    begin = counts.join(small, "virtual_slot").select("virtual_slot", "fine", "shard", "map_version", F.coalesce(before, F.lit(0)).alias("begin"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "fine").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("rank", rank).join(begin, ["virtual_slot", "fine"]).select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("begin") + F.col("rank") - 1).cast("long").alias("place"), "map_version")
