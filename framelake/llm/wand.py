"""Ranked lexical search by WAND: each task ranks shards of documents with heaps and pivots, and the shards' heaps are merged."""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.llm.bytewords import ALNUM, LOWER, coded_words, word_hashes
from framelake.llm.shared import hash_bitmap, in_bitmap, settled, steps, text_bytes

#: Postings of a shard, about: a task ranks one shard after the other and keeps its heaps.
SHARD = 1 << 21
#: Terms of the items that are ranked in one pass over the postings, about.
BLOCK = 1 << 20


def _hashes(words: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(words)
    return word_hashes(data, offsets[:-1], offsets[1:])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term, h) of each distinct term of each item."""
    for rows, data, offsets in steps(batches):
        code, text_no, words = coded_words(LOWER[data], offsets, ALNUM)
        pair = np.unique(text_no * len(words) + code)
        if len(pair):
            no, code = pair // len(words), pair % len(words)
            yield pa.RecordBatch.from_arrays([rows.column("item").take(pa.array(no)), words.take(pa.array(code)).cast(pa.string()), pa.array(_hashes(words)[code].view(np.int64))], ["item", "term", "h"])


def _postings(batches: Iterator[pa.RecordBatch], bitmap: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows with n, all terms of the text, and those terms that items may have, each once, with their numbers of occurrences."""
    for rows, data, offsets in steps(batches):
        code, text_no, words = coded_words(LOWER[data], offsets, ALNUM)
        n = np.bincount(text_no, minlength=rows.num_rows)
        if len(words):
            met = in_bitmap(bitmap.value, _hashes(words))[code]
            code, text_no = code[met], text_no[met]
        pair, tf = np.unique(text_no * max(len(words), 1) + code, return_counts=True)
        no = pair // max(len(words), 1)
        edge = pa.array(np.searchsorted(no, np.arange(rows.num_rows + 1)).astype(np.int32))
        terms = words.take(pa.array(pair % max(len(words), 1))).cast(pa.string())
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(edge, terms), pa.ListArray.from_arrays(edge, pa.array(tf.astype(np.int32)))], ["doc_id", "n", "terms", "tf"])


def ranked_shard(lists: list[tuple[array, array, int]], ids: list[int | None], heap: list[tuple[int, int, int]], k: int) -> int:
    """Puts a shard's documents into an item's ``heap`` of the ``k`` best, (score, 1 if there is an id, -id); returns how many were scored.

    ``lists`` holds each term's ascending documents, impacts and largest impact. The lists stand in order of their next document; the pivot is the
    first list up to which the largest impacts together reach the heap's least score. No document before the pivot's can enter the heap, so the
    lists before it skip to it; where all already stand on it, it is scored. A document that could only tie is scored too, as its id may be smaller.
    """
    scored = 0
    # [next document, place in the list, documents, impacts, largest impact]
    cursors = sorted(([docs[0], 0, docs, impacts, most] for docs, impacts, most in lists), key=lambda c: c[0])
    while cursors:
        least = heap[0][0] if len(heap) == k else 1
        bound = pivot = 0
        for pivot, cursor in enumerate(cursors):
            bound += cursor[4]
            if bound >= least:
                break
        if bound < least:
            break
        doc = cursors[pivot][0]
        if cursors[0][0] == doc:
            score = last = 0
            for last, cursor in enumerate(cursors):
                if cursor[0] != doc:
                    break
                score += cursor[3][cursor[1]]
                cursor[1] += 1
                cursor[0] = cursor[2][cursor[1]] if cursor[1] < len(cursor[2]) else -1
            scored += 1
            entry = (score, 0, 0) if ids[doc] is None else (score, 1, -ids[doc])
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            moved = last + 1
        else:
            moved = pivot
            for cursor in cursors[:pivot]:
                if cursor[0] < doc:
                    cursor[1] = bisect_left(cursor[2], doc, cursor[1])
                    cursor[0] = cursor[2][cursor[1]] if cursor[1] < len(cursor[2]) else -1
        if any(c[0] < 0 for c in cursors[:moved]):
            cursors = [c for c in cursors if c[0] >= 0]
        cursors.sort(key=lambda c: c[0])
    return scored


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A task's rows in shards of about ``SHARD`` postings, by ascending doc_id."""
    part, postings = [], 0
    for batch in batches:
        part.append(batch)
        postings += len(batch.column("tf").flatten())
        if postings >= SHARD:
            yield pa.Table.from_batches(part).sort_by("doc_id").combine_chunks()
            part, postings = [], 0
    if part:
        yield pa.Table.from_batches(part).sort_by("doc_id").combine_chunks()


def _ranked(batches: Iterator[pa.RecordBatch], items: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    """(item, doc_id, score) of a task's best ``k`` documents of each item."""
    item, vocabulary, weight, term, total, length = items.value
    edge = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]]))
    heaps: list[list] = [[] for _ in edge[1:]]
    for shard in _shards(batches):
        n, flat = shard.column("n").to_numpy(), shard.column("terms").combine_chunks()
        doc = np.repeat(np.arange(shard.num_rows), flat.value_lengths().to_numpy())
        found = pc.index_in(flat.flatten(), value_set=vocabulary)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        of_term, tf, doc = found.drop_null().to_numpy(), shard.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)[known], doc[known]
        m = 10 + (90 * n * total) // max(length, 1)
        impact = weight[of_term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.argsort(of_term, kind="stable")
        of_term, doc, impact = of_term[order], doc[order].astype(np.int32), impact[order]
        first = np.searchsorted(of_term, np.arange(len(vocabulary) + 1))
        lists = [(array("i", doc[a:b].tobytes()), array("q", impact[a:b].tobytes()), int(impact[a:b].max())) if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        ids = shard.column("doc_id").to_pylist()
        for heap, a, b in zip(heaps, edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            ranked_shard([lists[t] for t in term[a:b].tolist() if lists[t]], ids, heap, k)
    rows = [(i, -d if has else None, s) for i, heap in zip(item[edge[:-1]].tolist(), heaps, strict=True) for s, has, d in heap]
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item", "doc_id", "score"])


def searched(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``queries`` (item_id, text) the ``k`` documents (doc_id, an integer, and text) of highest score.

    Terms are runs of digits, letters and characters beyond ASCII, only A-Z lower-cased. A term's weight is the whole part of 1000 times the
    logarithm of (2 N + 2) / (2 df + 1), N documents with terms, df of them with this one; its impact on a document grows with its occurrences
    against the document's length. A score is the sum over a query's distinct terms, in whole numbers; equal scores go by ascending doc_id, null
    last; a document without a common term of weight has no score.

    One pass makes each document's postings of the terms that a bitmap of fixed size lets pass; these are written. Each task ranks its rows in shards
    of about ``SHARD`` postings for all items, by WAND with every term's largest impact in the shard, and keeps its heaps from shard to shard; only
    heaps are shuffled. Queries' terms are broadcast in blocks of about ``BLOCK``, one pass over the postings a block.

    A null or wordless text has no terms, on either side; such queries have no rows, nor do queries of an empty table of documents. Repeated rows
    are ranked and asked one by one; other columns, whatever their names, are left out. A worker holds one step of texts or one longer text.
    """
    spark = docs.sparkSession
    items = settled(queries.select("item_id", "text").where("text is not null").withColumn("item", F.monotonically_increasing_id()), "searchitems")
    terms = settled(items.select("item", "text").mapInArrow(_item_terms, "item long, term string, h long"), "searchterms")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = settled(rows.mapInArrow(partial(_postings, bitmap=hash_bitmap(terms, "h")), "doc_id long, n long, terms array<string>, tf array<int>"), "postings")
    total, length = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * total + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = settled(terms.drop("h").join(held, "term").select("item", "term", weight.alias("weight")).where("weight > 0"), "weights")
    blocks = max(1, -(-weighed.count() // BLOCK))
    heaps = []
    for block in range(blocks):
        own = weighed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow().sort_by([("item", "ascending"), ("term", "ascending")])  # about BLOCK rows
        coded = own.column("term").combine_chunks().dictionary_encode()
        code, of_term = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), np.int64)
        of_term[code] = own.column("weight").to_numpy()
        if len(code):
            asked = spark.sparkContext.broadcast((own.column("item").to_numpy(), coded.dictionary, of_term, code, total, length))
            heaps.append(index.where("n > 0").select("doc_id", "n", "terms", "tf").mapInArrow(partial(_ranked, items=asked, k=k), "item long, doc_id long, score long"))
    found = reduce(DataFrame.unionByName, heaps) if heaps else spark.createDataFrame([], "item long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
