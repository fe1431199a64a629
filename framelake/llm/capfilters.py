"""Embedding near-duplicates by spherical-cap filters from random product codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.buckets import Forest, grouped, pairs_of, split_buckets, whole_anchors
from framelake.llm.components import components
from framelake.llm.shared import settled, spread_join

BLOCKS = 3
CODEWORDS = 64
#: Filters that a random vector meets on average.
FILTERS = 24
#: A vector also meets all filters whose score is this close to its best, so that none meets no filter.
SLACK = 0.04


@lru_cache(16)
def product_code(dim: int) -> tuple[np.ndarray, list[np.ndarray], float]:
    """(random rotation, unit codewords of each block of coordinates, score threshold) for ``dim`` coordinates; the same in every process.

    A filter direction is a choice of one codeword in each block; its score is the sum of the blocks' inner products. The threshold is set so
    that random directions meet ``FILTERS`` filters on average, fewer in few dimensions.
    """
    rng = np.random.default_rng(dim)
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    books = []
    for size in (len(x) for x in np.array_split(np.arange(dim), BLOCKS)):
        book = rng.standard_normal((CODEWORDS, size))
        books.append(np.zeros((1, 0)) if not size else np.unique((book / np.linalg.norm(book, axis=1, keepdims=True)).round(12), axis=0))
    probe = rng.standard_normal((64, dim))
    probe /= np.linalg.norm(probe, axis=1, keepdims=True)
    s = [x @ b.T for x, b in zip(np.split(probe, np.cumsum([b.shape[1] for b in books])[:-1], axis=1), books, strict=True)]
    every = (s[0][:, :, None, None] + s[1][:, None, :, None] + s[2][:, None, None, :]).astype(np.float32).ravel()
    met = max(1, min(FILTERS, every.size // 64 // 64)) * len(probe)
    return rotation, books, float(np.partition(every, every.size - met)[every.size - met])


def list_decode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter number) of all filters that each unit vector exceeds; pairs of codewords that can't reach the threshold are pruned."""
    rotation, books, level = product_code(unit.shape[1])
    turned = unit @ rotation
    s = [x @ b.T for x, b in zip(np.split(turned, np.cumsum([b.shape[1] for b in books])[:-1], axis=1), books, strict=True)]
    level = np.minimum(level, sum(x.max(1) for x in s) - SLACK)
    two = s[0][:, :, None] + s[1][:, None, :]
    row, a, b = np.nonzero(two >= (level - s[2].max(1))[:, None, None])
    at, c = np.nonzero(two[row, a, b][:, None] + s[2][row] >= level[row][:, None])
    return row[at], (a[at] * len(books[1]) + b[at]) * len(books[2]) + c


def _filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, weight, label, v) once for each filter, with the bucket's hash and the sorted numbers of all filters of the vector."""
    for batch in batches:
        size = pa.compute.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
        for dim in np.unique(size).tolist():
            for part in np.array_split(np.flatnonzero(size == dim), max(1, (size == dim).sum() // 256)):
                if not len(part):
                    continue
                rows = batch.take(pa.array(part))
                v = rows.column("v").flatten().to_numpy().reshape(len(part), dim).astype(float)
                row, number = list_decode(v / np.linalg.norm(v, axis=1, keepdims=True))
                order = np.lexsort((number, row))
                row, number = row[order], number[order]
                edge = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                filters = pa.ListArray.from_arrays(pa.array(edge), pa.array(number.astype(np.int32)))
                seed = rows.column("group").to_numpy().view(np.uint64)[row]
                bucket = ((seed ^ number.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), pa.array(np.ones(len(row), bool)), pa.array(number.astype(np.int32)), filters.take(at), *(rows.column(c).take(at) for c in ("id", "weight", "label", "v"))],
                    ["bucket", "anchor", "filter", "filters", "id", "weight", "label", "v"],
                )


def _padded(lists: pa.Array, fill: int) -> np.ndarray:
    size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(size), int(size.max(initial=1))), fill, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


def _first_shared(lists: pa.Array, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the pairs' filter ``own`` is the smallest that both have."""
    rows, k = np.unique(np.concatenate([i, j]), return_inverse=True)
    held = lists.take(pa.array(rows))
    left, right = _padded(held, -1), _padded(held, -2)
    ki, kj, out = k[: len(i)], k[len(i) :], np.ones(len(i), bool)
    for at in range(0, len(i), 4096):
        x = left[ki[at : at + 4096]]
        shared = (x[:, :, None] == right[kj[at : at + 4096]][:, None, :]).any(2) & (x < own[at : at + 4096, None])
        out[at : at + 4096] = ~shared.any(1)
    return out


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``x`` with the same row of ``y``; the one formula by which all links are decided."""
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def _dense(ids: np.ndarray, x: np.ndarray, label: np.ndarray, weight: np.ndarray, lists: pa.Array, own: int, anchor: np.ndarray, new: np.ndarray, least: float) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For one large group: the weight that each row links with by pairs whose smallest filter this is, and links that connect what links here."""
    begin, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    size, a, rows = np.diff(begin), np.flatnonzero(anchor), np.flatnonzero(new)
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    below = np.unique(flat[flat < own])

    def member(rows: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Which rows have which of some of the lower filters."""
        out = np.zeros((len(rows), len(column)), np.float32)
        row = np.repeat(np.arange(len(rows)), size[rows])
        number = flat[np.repeat(begin[rows], size[rows]) + np.arange(len(row)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])]
        known = (number >= column[0]) & (number <= column[-1]) & (number < own)
        out[row[known], np.searchsorted(column, number[known])] = 1
        return out

    linked, links, top, first = np.zeros(len(ids)), [], np.iinfo(np.int64).max, []
    for at in range(0, len(rows), 1024):
        p = rows[at : at + 1024]
        dot = unit[p] @ unit[a].T
        near = dot >= least
        i, j = np.nonzero(np.abs(dot - least) < 1e-9)
        near[i, j] = cosines(x[p[i]], x[a[j]]) >= least
        near &= (label[p][:, None] == label[a]) & (ids[p][:, None] != ids[a]) & (~anchor[p][:, None] | (a < p[:, None]))
        # labels spread between these rows and the anchors, which leaves one link a row
        of_anchor = np.minimum(ids[a], np.where(near, ids[p][:, None], top).min(0))
        while True:
            of_row = np.minimum(ids[p], np.where(near, of_anchor, top).min(1))
            now = np.minimum(of_anchor, np.where(near, of_row[:, None], top).min(0))
            if (now == of_anchor).all():
                break
            of_anchor = now
        links += [(ids[p], of_row), (ids[a], of_anchor)]
        first.append(near)
    for c in range(0, len(below), 4096):
        has = member(a, below[c : c + 4096])
        for n, at in enumerate(range(0, len(rows), 1024)):
            if first[n].any():
                first[n] &= member(rows[at : at + 1024], below[c : c + 4096]) @ has.T == 0
    for n, at in enumerate(range(0, len(rows), 1024)):
        p = rows[at : at + 1024]
        linked[p] += first[n] @ weight[a]
        linked[a] += weight[p[anchor[p]]] @ first[n][anchor[p]]
    return linked, links


def _linked(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(a, b, n): links of a spanning forest (n null), and for each vector how many vectors it links with (b null).

    A pair that shares several filters counts only in the bucket of the smallest one. An anchor meets the anchors before it, and both count;
    other rows meet all anchors, and only the row counts, as it is an anchor elsewhere. Large groups are compared as matrices.
    """
    forest = Forest()
    for groups in whole_anchors(batches):
        table, edge = groups.table, groups.edge
        ids, own, weight = (table.column(c).to_numpy() for c in ("id", "filter", "weight"))
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        v, lists = table.column("v").combine_chunks(), table.column("filters").combine_chunks()
        size = pa.compute.list_value_length(v).to_numpy(zero_copy_only=False)
        begin, flat = v.offsets.to_numpy(), v.values.to_numpy()
        who, links = [np.zeros(0, np.int64)], [np.zeros(0)]
        large = groups.anchors * np.add.reduceat(groups.new, edge[:-1]) >= 4096
        for g in np.flatnonzero(large).tolist():
            at = slice(edge[g], edge[g + 1])
            if np.ptp(size[at]) or np.ptp(own[at]):
                large[g] = False  # two buckets of one hash: pairs are compared one by one
                continue
            x = flat[begin[at][:, None] + np.arange(size[edge[g]])].astype(float)
            linked, found = _dense(ids[at], x, label[at], weight[at], lists.take(pa.array(range(edge[g], edge[g + 1]))), int(own[edge[g]]), groups.anchor[at], groups.new[at], least)
            who.append(ids[at][linked > 0])
            links.append(linked[linked > 0])
            for x, y in found:
                forest.add(x[x != y], y[x != y])
        for i, j in pairs_of(groups, large, 1 << 16):
            other = (ids[i] != ids[j]) & (size[i] == size[j]) & (label[i] == label[j])
            i, j = i[other], j[other]
            cosine = np.zeros(len(i))
            for dim in np.unique(size[i]).tolist():
                same = np.flatnonzero(size[i] == dim)
                x, y = (flat[begin[k[same]][:, None] + np.arange(dim)].astype(float) for k in (i, j))
                cosine[same] = cosines(x, y)
            i, j = i[cosine >= least], j[cosine >= least]
            if len(i):
                forest.add(ids[i], ids[j])
                first = _first_shared(lists, own[i], i, j)
                i, j = i[first], j[first]
                both = groups.anchor[j]
                who += [ids[j], ids[i[both]]]
                links += [weight[i].astype(float), weight[j[both]].astype(float)]
        who, of = np.unique(np.concatenate(who), return_inverse=True)
        if len(who):
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.nulls(len(who), pa.int64()), pa.array(np.bincount(of, np.concatenate(links)).astype(np.int64))], ["a", "b", "n"])
        if found := forest.flush():
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.nulls(len(found[0]), pa.int64())], ["a", "b", "n"])
    if found := forest.flush(True):
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.nulls(len(found[0]), pa.int64())], ["a", "b", "n"])


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id and kept.

    Vectors of equal, non-null labels and equal length link if their cosine in double precision is ``least`` or more; every link found is
    verified, so none is below. Candidates are vectors that exceed the same filter direction; two vectors at cosine 0.98 share none with a
    chance well below one in a hundred. Equal vectors are one class with a weight, so copies never make pairs. Vectors that are null, empty,
    zero or hold null or non-finite components, and rows without an id, link with nothing; their component is their own id. Repeated rows are
    vectors of their own that link with each other, and so are different vectors that share a vec_id. An empty table gives no rows.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding") if element in ("float", "double") else F.transform("embedding", lambda x: x.cast("double"))
    kind = element if element in ("float", "double") else "double"
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    if kind == "double":  # squares of doubles beyond these bounds are infinite or zero; the cosine is that of the vector over its largest component
        largest = F.array_max(F.transform(v, F.abs))
        v = F.when((largest > 1e100) & (largest < float("inf")) | (largest > 0) & (largest < 1e-100), F.transform(v, lambda x: x / largest)).otherwise(v)
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), v.alias("v")).withColumn("sound", sound)
    rows = settled(rows.withColumn("key", F.when(F.col("sound"), F.xxhash64("label", "v"))), "vectors")
    classes = rows.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("key").alias("key"))
    classes = settled(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # numbered, as several vectors may share a vec_id
    listed = classes.select("id", "weight", "label", "v", F.xxhash64("label", F.size("v")).alias("group"))
    filtered = listed.mapInArrow(_filtered, f"bucket long, anchor boolean, filter int, filters array<int>, id long, weight long, label string, v array<{kind}>")
    found = settled(grouped(split_buckets(filtered)).mapInArrow(partial(_linked, least=least), "a long, b long, n long"), "caps")
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    tree = components(found.where("b is not null").select("a", "b"))
    told = classes.join(links, "id", "left").join(tree, "id", "left").select("key", "label", "v", "rep", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"), "weight")
    told, total = settled(told, "links"), rows.count()
    least_id = told.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    told = spread_join(told, least_id, "component", total).select("key", F.col("label").alias("told_label"), F.col("v").alias("told_v"), "n_links", "component_id", F.col("weight").alias("n"))
    joined = spread_join(rows.where("sound"), told, "key", total).where((F.col("label") == F.col("told_label")) & (F.col("v") == F.col("told_v")))
    alone = rows.where(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = joined.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
