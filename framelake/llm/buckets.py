"""Verified links inside hash buckets, with bounded memory and no table of all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.shared import settled

#: A group holds about this many anchors at most; a bucket with more is split by the anchors' hash.
ANCHORS = 4096
#: Pairs compared in one vectorised step.
PAIRS = 1 << 20
#: A list of hot buckets is broadcast up to this many rows of 12 bytes, and joined by a shuffle beyond.
BROADCAST_ROWS = 100_000


def split_buckets(rows: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """Rows (bucket, anchor boolean, id, ...) with a column ``part``: in its bucket each anchor meets each other row, in one part.

    Anchors are counted with map-side aggregation; only buckets with more than ``anchors`` of them are split, so the rest pass unchanged.
    In a split bucket a row is an anchor in one part, by its id's hash, if it is one at all, and a plain row (anchor false) in the others.
    """
    hot = rows.where("anchor").groupBy("bucket").count().where(F.col("count") > anchors)
    hot = settled(hot.select("bucket", F.ceil(F.col("count") / anchors).cast("int").alias("parts")), "hot")
    n = hot.count()
    if not n:
        return rows.withColumn("part", F.lit(0))
    with_parts = rows.join(F.broadcast(hot) if n <= BROADCAST_ROWS else hot, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    roles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), (F.col("anchor") & (p == own)).alias("as_anchor")))
    exploded = with_parts.withColumn("role", F.explode(roles))
    return exploded.withColumn("part", F.col("role.part")).withColumn("anchor", F.col("role.as_anchor")).drop("role", "parts")


def grouped(rows: DataFrame) -> DataFrame:
    """Rows of :func:`split_buckets` dealt by (bucket, part) and sorted, anchors first; Spark's sort spills, nothing is collected."""
    return rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.desc("anchor"), "id")


class Forest:
    """A union-find over linked ids; it gives each id a link to its tree's smallest one, and is emptied whenever it grows past a bound."""

    def __init__(self, most: int = 200_000) -> None:
        self.up: dict[int, int] = {}
        self.most = most

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)

    def roots(self, ids: np.ndarray) -> np.ndarray:
        """The root of each id; an id that isn't linked is its own."""
        return np.array([self.root(x) if x in self.up else x for x in ids.tolist()], np.int64)

    def flush(self, always: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        if not self.up or not (always or len(self.up) > self.most):
            return None
        links = [(x, r) for x in list(self.up) if (r := self.root(x)) != x]
        self.up = {}
        out = np.array(links, np.int64)
        return out[:, 0], out[:, 1]


def runs(bucket: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Positions where a group begins, with the end appended."""
    new = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1
    return np.concatenate([[0], new, [len(bucket)]])


@dataclass
class Groups:
    """Rows of whole or begun groups: where groups begin and the end, each row's group size in anchors, which rows are anchors, which are new."""

    table: pa.Table
    edge: np.ndarray
    anchors: np.ndarray
    anchor: np.ndarray
    new: np.ndarray

    def before(self) -> np.ndarray:
        """How many of its group's first rows a row is to meet: an anchor the anchors before it, another row all anchors."""
        size = np.diff(self.edge)
        return np.where(self.anchor, np.arange(len(self.anchor)) - np.repeat(self.edge[:-1], size), np.repeat(self.anchors, size))


def whole_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[Groups]:
    """Sorted rows (bucket, part, anchor, id, ...) as groups; all anchors of a group stand first. Of a group only its anchors, a bounded number, are carried from batch to batch."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        old = held.num_rows if held is not None else 0
        if old:
            table = pa.concat_tables([held, table])
        table = table.combine_chunks()
        bucket, part, anchor = (table.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "part", "anchor"))
        edge = runs(bucket, part)
        of_anchor = np.concatenate([[0], np.cumsum(anchor)])
        yield Groups(table, edge, of_anchor[edge[1:]] - of_anchor[edge[:-1]], anchor, np.arange(len(anchor)) >= old)
        last = table.slice(edge[-2])
        held = last.filter(last.column("anchor"))


def pairs_of(groups: Groups, leave: np.ndarray | None = None, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchor position, new row's position) of every pair to meet but in groups ``leave``; ``most`` pairs or one row's at a time."""
    first, n = np.repeat(groups.edge[:-1], np.diff(groups.edge)), groups.before()
    if leave is not None:
        n = np.where(np.repeat(leave, np.diff(groups.edge)), 0, n)
    row = np.flatnonzero(groups.new & (n > 0))
    n = n[row]
    end = np.cumsum(n)
    at = 0
    while at < len(row):
        done = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, done + most, "right")))
        p = np.repeat(row[at:to], n[at:to])
        yield first[p] + np.arange(len(p)) - np.repeat(end[at:to] - n[at:to] - done, n[at:to]), p
        at = to


def linked_forest(batches: Iterator[pa.RecordBatch], alike: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray], pairs: int = PAIRS) -> Iterator[pa.RecordBatch]:
    """(a, b): verified links of all groups, reduced to a forest. ``alike`` tells for positions of anchors and partners which pairs link."""
    forest = Forest()

    def told(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    for groups in whole_anchors(batches):
        table = groups.table
        ids = table.column("id").to_numpy()
        for i, j in pairs_of(groups, most=pairs):
            # each row meets its group's first anchor before the others; pairs that are connected by then need no comparison
            lead = np.append(True, j[1:] != j[:-1])
            for some in (lead, ~lead):
                here = np.unique(np.concatenate([i[some], j[some]]))
                root = np.zeros(len(ids), np.int64)
                root[here] = forest.roots(ids[here])
                apart = root[i[some]] != root[j[some]]
                x, y = i[some][apart], j[some][apart]
                if len(x):
                    good = alike(table, x, y)
                    forest.add(ids[x[good]], ids[y[good]])
            if found := forest.flush():
                yield told(found)
    if found := forest.flush(True):
        yield told(found)
