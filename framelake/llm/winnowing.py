"""Benchmark decontamination by winnowed k-gram fingerprints, joined and extended to whole shared spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.llm.bytewords import ALNUM, LOWER, bounds, gram_hashes, mixed, word_hashes, words
from framelake.llm.shared import HOT_KEYS, free_names, hash_bitmap, in_bitmap, own_columns, settled, spread_join, steps

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Items whose texts are compared with a document at once; a document that meets more is compared in parts.
ITEMS = 64


def winnowed(h: np.ndarray, text_no: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, fingerprint): of each window of ``span`` words inside one text, its rightmost smallest k-gram hash, k = half the span rounded up.

    Two texts that share ``span`` consecutive words share the fingerprint of that window at the same place in it.
    """
    k = -(-span // 2)
    windows = len(h) - span + 1
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = mixed(gram_hashes(h, k) + np.uint64(span))
    least, where = g[:windows].copy(), np.arange(windows)
    for i in range(1, span - k + 1):
        new = g[i : i + windows]
        lower = new <= least
        least[lower] = new[lower]
        where[lower] = np.flatnonzero(lower) + i
    inside = text_no[:windows] == text_no[span - 1 :]
    at = np.unique(where[inside])
    return at, g[at]


def progressions(no: np.ndarray, g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, fingerprint, first, last, step): each text's places of a fingerprint as even progressions, a place alone with step 0.

    A run of one word has its fingerprint everywhere, a period of p words one at every p-th place; each is one row.
    """
    order = np.lexsort((at, g, no))
    no, g, at = no[order], g[order], at[order].astype(np.int64)
    if not len(at):
        return no, g, at, at, at
    same, gap = (no[1:] == no[:-1]) & (g[1:] == g[:-1]), np.diff(at)
    edge = np.ones(len(at), bool)  # where a run of equal gaps begins, by its first gap
    edge[1:-1] = ~(same[1:] & same[:-1] & (gap[1:] == gap[:-1]))
    begin = np.flatnonzero(same & edge[:-1])
    end = np.flatnonzero(same & edge[1:])
    alone = np.flatnonzero(~np.append(False, same) & ~np.append(same, False))
    pick = np.concatenate([begin, alone])
    return no[pick], g[pick], at[pick], np.concatenate([at[end + 1], at[alone]]), np.concatenate([gap[begin], np.zeros(len(alone), np.int64)])


def _item_prints(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in steps(batches):
        data = LOWER[data]
        starts, ends, text_no = words(data, offsets, ALNUM)
        h = word_hashes(data, starts, ends)
        size = np.bincount(text_no, minlength=rows.num_rows)
        item, first = rows.column("item").to_numpy(), bounds(text_no, rows.num_rows)
        for span in range(1, window + 1):
            own = np.minimum(size, window)[text_no] == span
            at, g = winnowed(h[own], text_no[own], span)
            no = text_no[own][at]
            at = np.flatnonzero(own)[at]
            no, g, begin, last, step = progressions(no, g, at - first[no])
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(item[no]), pa.array(begin), pa.array(last), pa.array(step), pa.array(np.full(len(no), span, np.int32))], ["h", "item", "item_first", "item_last", "item_step", "span"])


def _doc_prints(batches: Iterator[pa.RecordBatch], spans: list[int], bitmap: Broadcast) -> Iterator[pa.RecordBatch]:
    bits = bitmap.value
    for rows, data, offsets in steps(batches):
        data = LOWER[data]
        starts, ends, text_no = words(data, offsets, ALNUM)
        h = word_hashes(data, starts, ends)
        first = bounds(text_no, rows.num_rows)
        at, g = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for span in spans:
            a, x = winnowed(h, text_no, span)
            met = in_bitmap(bits, x)
            at.append(a[met])
            g.append(x[met])
        at, g = np.concatenate(at), np.concatenate(g)
        no = text_no[at]
        no, g, begin, last, step = progressions(no, g, at - first[no])
        order = np.argsort(no, kind="stable")
        no, g, begin, last, step = no[order], g[order], begin[order], last[order], step[order]
        edge = np.searchsorted(no, np.arange(rows.num_rows + 1)).astype(np.int32)
        prints = pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays([pa.array(g.view(np.int64)), pa.array(begin), pa.array(last), pa.array(step)], ["h", "first", "last", "step"]))
        text = rows.column("text").take(pa.array(np.arange(rows.num_rows), mask=np.diff(edge) == 0))  # null unless suspect
        arrays = {**{c: rows.column(c) for c in rows.schema.names if c != "text"}, "n_words": pa.array(np.diff(first).astype(np.int64)), "text": text, "prints": prints}
        yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


@lru_cache(256)
def _item_words(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


def _extended(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(row, items, spans) of rows (row, text, found): what the joined alignments of some items hit in a document, compared word by word."""
    schema = pa.schema([("row", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())])))])
    for batch in batches:
        out: dict[str, list] = {"row": batch.column("row").to_pylist(), "items": [], "spans": []}
        for row in range(batch.num_rows):
            no: dict[bytes, int] = {}
            doc = np.array([no.setdefault(w, len(no)) for w in WORD.findall(batch.column("text")[row].as_py().encode().lower())], np.int64)
            hit, items = np.zeros(len(doc) + 1, np.int64), set()
            for found in batch.column("found")[row].as_py():
                item = np.array([no.get(w, -1) for w in _item_words(found["text"])], np.int64)
                need = min(window, len(item))
                ways = [np.arange(x["low"], x["high"] + 1, max(gcd(x["step"], x["item_step"]), 1)) for x in found["shifts"]]
                for shift in np.unique(np.concatenate(ways)).tolist():
                    a, b = max(shift, 0), min(len(doc), shift + len(item))
                    if b - a < need:
                        continue
                    same = np.concatenate([[False], doc[a:b] == item[a - shift : b - shift], [False]])
                    turn = np.flatnonzero(same[1:] != same[:-1])
                    for s, e in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
                        if e - s >= need:
                            hit[a + s] += 1
                            hit[a + e] -= 1
                            items.add(found["item"])
            on = np.concatenate([[False], np.cumsum(hit)[:-1] > 0, [False]])
            turn = np.flatnonzero(on[1:] != on[:-1]).tolist()
            out["items"].append(sorted(items))
            out["spans"].append([{"first_word": s, "end_word": e} for s, e in zip(turn[::2], turn[1::2], strict=True)])
        yield pa.RecordBatch.from_pydict(out, schema)


def _merged(spans: DataFrame) -> DataFrame:
    """(row, n_hit, spans) of spans (row, first_word, end_word) that may overlap, as words they cover."""
    order = Window.partitionBy("row").orderBy("first_word", "end_word")
    before = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.coalesce(F.col("first_word") > F.col("before"), F.lit(True)).cast("int")).over(order)
    one = spans.withColumn("before", before).withColumn("island", island).groupBy("row", "island").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"))
    return one.groupBy("row").agg(F.sum(F.col("end_word") - F.col("first_word")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("first_word", "end_word"))).alias("spans"))  # of one document's spans


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``carry``, n_words, n_hit, items (sorted ids as strings) and spans of hit words [first_word, end_word).

    Texts are lower-cased (A-Z) and cut into words of digits, letters and characters beyond ASCII. A document word is hit if it lies in an
    occurrence of ``window`` consecutive words of an item of ``benchmark`` (item_id, text), or of a whole item that has fewer. Both sides are
    winnowed, so each such occurrence shares a fingerprint; fingerprints are joined, and every joined alignment is compared word by word along
    the whole item. A bitmap of fixed size passes on all documents' fingerprints that a benchmark of any size can meet; those few are joined
    by a shuffle. A fingerprint's places in a text are joined as even progressions, so runs and periods don't multiply; fingerprints and items that
    many documents have are dealt over many tasks; items of equal text are one text until the end, when their ids are put in.

    Null and wordless texts have no words and no hits, on either side; a null item_id counts as the empty string; repeated
    rows are answered one by one, and items of one id count once. An empty benchmark leaves every document clean. Of a long text, and of the items
    that it meets, a worker holds the words.
    """
    items = benchmark.where("text is not null").groupBy("text").agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("ids"))
    items = settled(items.withColumn("item", F.monotonically_increasing_id()), "items")
    prints = settled(items.select("item", "text").mapInArrow(partial(_item_prints, window=window), "h long, item long, item_first long, item_last long, item_step long, span int"), "itemprints")
    spans = sorted(r[0] for r in prints.select("span").distinct().collect())  # of window numbers at most
    shared = hash_bitmap(prints, "h")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*carry).schema)
    scanned = docs.select(*carry, "text").mapInArrow(partial(_doc_prints, spans=spans, bitmap=shared), f"{kinds}n_words long, text string, prints array<struct<h: long, first: long, last: long, step: long>>")
    scanned = settled(scanned.withColumn("row", F.monotonically_increasing_id()), "docprints")
    suspects = scanned.where("text is not null")
    places = suspects.select("row", F.inline("prints"))
    met = _salted(places, prints, "h")
    way = F.struct((F.col("first") - F.col("item_last")).alias("low"), (F.col("last") - F.col("item_first")).alias("high"), "step", "item_step")
    met = settled(met.groupBy("row", "item").agg(F.collect_set(way).alias("shifts")), "met")
    dealt = met.groupBy("row").agg(F.ceil(F.count("*") / ITEMS).alias("parts"))
    total = met.count()
    often = met.groupBy("item").agg(F.count("*").alias("n"))
    told_apart = met.join(dealt, "row").withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")))
    parts = spread_join(told_apart, items.select("item", "text").join(often, "item"), "item", total)
    found = parts.groupBy("row", "part").agg(F.collect_list(F.struct("item", "text", "shifts")).alias("found"))  # about ITEMS at most
    told = suspects.select("row", "text").join(found, "row").mapInArrow(partial(_extended, window=window), "row long, items array<long>, spans array<struct<first_word: long, end_word: long>>")
    told = settled(told.where(F.size("items") > 0), "hits")
    ids = spread_join(told.select("row", F.explode("items").alias("item")), items.select("item", "ids").join(often, "item"), "item", total)
    ids = ids.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    hits = _merged(told.select("row", F.inline("spans"))).join(ids, "row")
    none = F.array().cast("array<string>")
    return scanned.select("row", *carry, "n_words").join(hits, "row", "left").select(
        *carry, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("spans", F.array().cast("array<struct<first_word: bigint, end_word: bigint>>")).alias("spans")
    )


def _salted(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """``rows`` (with a column row) joined with ``small`` by ``key``, the rows of a frequent key dealt over several tasks, each with all of the key's small rows."""
    counts = settled(rows.groupBy(key).agg(F.count("*").alias("n")), "keycounts")
    often = max(100, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(counts.where(F.col("n") > often).select(key, F.ceil(F.col("n") / often).cast("int").alias("dealt")))  # fewer than HOT_KEYS rows
    left = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce("dealt", F.lit(1))).cast("int")).drop("dealt")
    right = small.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("dealt", F.lit(1)) - 1))).drop("dealt")
    return left.join(right, [key, "salt"]).drop("salt")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; found by text, so that null or repeated ids don't matter."""
    h, crc, size = free_names(docs, "text_hash", "text_crc", "text_size")
    key = {h: F.xxhash64("text"), crc: F.crc32("text"), size: F.length("text")}
    keyed = docs.withColumns(key)
    bad = decontaminated(keyed, benchmark, window, tuple(key)).where("n_hit > 0").select(*key).distinct()
    return keyed.join(bad, list(key), "left_anti").select(own_columns(docs))


def items_digest(items: list[str]) -> str:
    """The digest that the query gives for a list of ids; the query computes it in Spark, tests here."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
