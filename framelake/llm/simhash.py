"""SimHash near-duplicates by multi-index hashing over three segments of the fingerprint."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.buckets import grouped, linked_forest, split_buckets
from framelake.llm.components import components
from framelake.llm.shared import free_names, own_columns, row_hash, settled, spread_join, steps

#: Bits of each segment of a 64-bit fingerprint, from the lowest bit up.
SEGMENTS = (22, 22, 20)


def _lanes() -> np.ndarray:
    """For each byte value, its bits as eight 8-bit counters in one word."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return (bits.astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(1, dtype=np.uint64)


def majority(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The fingerprint of each group ``h[edge[i]:edge[i + 1]]``: a bit is set if it is in over half of the group's hashes; an empty group gives 0."""
    out = np.zeros(len(edge) - 1, np.uint64)
    full = np.flatnonzero(np.diff(edge))
    if not len(full):
        return out
    size = np.diff(edge)[full]
    # groups are cut into pieces of 255 hashes at most, whose counts fit 8-bit counters
    pieces = -(-size // 255)
    of = np.repeat(np.arange(len(full)), pieces)
    begin = edge[:-1][full][of] + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    lanes, octets = _lanes(), np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    first = np.cumsum(pieces) - pieces
    for byte in range(8):
        summed = np.add.reduceat(lanes[octets[:, byte]], begin)
        counts = np.add.reduceat(np.ascontiguousarray(summed).view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        on = (2 * counts > size[:, None]).astype(np.uint64)
        out[full] |= (on << (np.arange(8, dtype=np.uint64) + np.uint64(8 * byte))).sum(1, dtype=np.uint64)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    for rows, data, offsets in steps(batches):
        raw, hashes, edge = data.tobytes(), [], [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            found = raw[a:b].lower().split()
            if found:
                line = b" ".join(found)
                if len(found) <= shingle:
                    hashes.append(digest(line))
                else:
                    ends = list(accumulate((len(w) + 1 for w in found), initial=-1))
                    hashes += [digest(line[s + 1 : e]) for s, e in zip(ends, ends[shingle:], strict=False)]
            edge.append(len(hashes))
        got = majority(np.array(hashes, np.uint64), np.array(edge))
        yield pa.RecordBatch.from_arrays([*rows.drop_columns(["text"]).columns, pa.array(got.view(np.int64))], [*(c for c in rows.schema.names if c != "text"), "fp"])


def fingerprints(docs: DataFrame, shingle: int = 4, more: str | None = None) -> DataFrame:
    """(doc_id, fp long), with the long column ``more`` before fp if one is named: the SimHash of the lower-cased (A-Z) text's ``shingle``-word shingles, repeats included.

    Words are runs of characters other than white space of ASCII. Fewer words than a shingle: the whole sequence counts as one;
    none, or a null text: 0.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = [more] if more else []
    return docs.select("doc_id", *own, "text").mapInArrow(partial(_fingerprints, shingle=shingle), f"doc_id {kind}, {''.join(f'{c} long, ' for c in own)}fp long")


def segment_radii(distance: int, segments: tuple[int, ...] = SEGMENTS) -> list[int]:
    """Radii r with sum(r + 1) = distance + 1: two fingerprints within ``distance`` agree within r in at least one segment."""
    base, more = divmod(distance + 1, len(segments))
    return [base + (i < more) - 1 for i in range(len(segments))]


def _probes(distance: int) -> list[tuple[int, int, int, int]]:
    """(segment, shift, mask, flipped bits) of every table entry and probe; flipped 0 is the entry itself."""
    out, shift = [], 0
    for s, (bits, radius) in enumerate(zip(SEGMENTS, segment_radii(distance), strict=True)):
        ball = {0} if radius >= 0 else set()
        for _ in range(radius):
            ball |= {x ^ (1 << b) for x in ball for b in range(bits)}
        out += [(s, shift, (1 << bits) - 1, x) for x in sorted(ball)]
        shift += bits
    return out


def _near(table: pa.Table, i: np.ndarray, j: np.ndarray, distance: int) -> np.ndarray:
    ids = table.column("id").to_numpy()
    return np.bitwise_count((ids[i] ^ ids[j]).view(np.uint64)) <= distance


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    yield from linked_forest(batches, partial(_near, distance=distance))


def _table_and_probes(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    probes = _probes(distance)
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for at in range(0, len(fp), 8192):
            ids = fp[at : at + 8192]
            bits = ids.view(np.uint64)
            bucket = np.concatenate([(((bits >> np.uint64(shift)) & np.uint64(mask)) ^ np.uint64(flip)).view(np.int64) * 4 + s for s, shift, mask, flip in probes])
            anchor = np.repeat([not flip for *_, flip in probes], len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(anchor), pa.array(np.tile(ids, len(probes)))], ["bucket", "anchor", "id"])


def fingerprint_links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links that connect all fingerprints (column fp, distinct) within ``distance`` bits, as a forest for each task.

    Each fingerprint stands in one table for each segment and probes that segment's Hamming ball; by the pigeonhole principle the
    balls meet every fingerprint within ``distance``. Matches are verified on all 64 bits.
    """
    rows = distinct.select("fp").mapInArrow(partial(_table_and_probes, distance=distance), "bucket long, anchor boolean, id long")
    return grouped(split_buckets(rows)).mapInArrow(partial(_links, distance=distance), "a long, b long")


def _joined(classes: DataFrame, distance: int) -> DataFrame:
    """``classes`` (column fp, distinct) with the component of each."""
    found = components(fingerprint_links(classes, distance)).withColumnRenamed("id", "fp")
    return classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def simhash_groups(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long, component_id): near-duplicate groups of ``docs`` (columns doc_id, text; others are ignored).

    component_id is the smallest doc_id that is reachable over links of ``distance`` bits or fewer, itself included. Null and blank
    texts have fingerprint 0 and link like others; equal fingerprints, repeated rows too, are one class, so copies never make pairs.
    A null doc_id gets its group's smallest id, null if the group has none. An empty table gives no rows.
    """
    prints = settled(fingerprints(docs, shingle), "simhash")
    classes = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    joined = settled(_joined(classes, distance), "joined")
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    labels = spread_join(joined.withColumnRenamed("n", "rows"), least, "component", classes.count())
    return spread_join(prints, labels.select("fp", "component_id", F.col("rows").alias("n")), "fp", prints.count()).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest by doc_id (null last), fingerprint and a hash of the whole row.

    Rows of one doc_id may stand in several groups. Of rows that are equal in all columns one stays; maps are equal if they are in the same order.
    An empty table gives no rows; a long text is held by one worker.
    """
    key, first_id, first_key = free_names(docs, "row_key", "first_id", "first_key")
    keyed = docs.withColumn(key, row_hash(docs))
    prints = settled(fingerprints(keyed, shingle, key).withColumnRenamed(key, "row_key"), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "fp", "row_key")
    classes = settled(prints.groupBy("fp").agg(F.min(order).alias("rep")), "classes")
    least = _joined(classes, distance).groupBy("component").agg(F.min("rep").alias("rep"))
    first = least.select(F.col("rep.doc_id").alias(first_id), F.col("rep.row_key").alias(first_key))
    kept = keyed.join(first, (F.col(key) == F.col(first_key)) & F.col("doc_id").eqNullSafe(F.col(first_id)), "left_semi")
    if not prints.groupBy("doc_id", "row_key").count().where("count > 1").isEmpty():  # only then are texts shuffled once more
        kept = kept.dropDuplicates(["doc_id", key])
    return kept.select(own_columns(docs))
