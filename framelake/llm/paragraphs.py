"""Substring dedup: MinHash banding of content-defined paragraphs, exact Jaccard, and components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.llm.buckets import grouped, linked_forest, split_buckets
from framelake.llm.bytewords import ALNUM, LOWER, bounds, gram_hashes, mixed, word_hashes, words
from framelake.llm.components import components
from framelake.llm.shared import hash_bitmap, in_bitmap, let_go, salted_join, settled, settled_at, steps

SHINGLE, SIMILAR, RECALL, MOST_BANDS = 5, 0.8, 0.99, 5
#: A paragraph ends before a word pair whose hash is the smallest among the pairs this near on either side in its line.
NEAR = 5
#: Fewer shingles than these can't be similar to a different set of shingles.
LEAST_SHINGLES = math.ceil(SIMILAR / (1 - SIMILAR) - 1e-9)
#: Shingles that are compared in one vectorised step.
COMPARED = 1 << 21
#: 64-bit words of parities by which most pairs that aren't similar are known before they are compared.
PARITIES = 4
#: The columns of these.
PARITY = [f"parity{i}" for i in range(PARITIES)]
#: A band key has 64 bits less these; in one number with it, so many bits of a class's hash tell classes apart but for one pair in 2^24, far fewer than the bands miss.
CLASS_BITS = 24
#: Paragraphs of a band that are compared with all others in one task.
COMPARED_ANCHORS = 512


def tune_bands(similar: float = SIMILAR, recall: float = RECALL, most_bands: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which at most ``most_bands`` bands find a pair of similarity ``similar`` with chance ``recall``."""
    rows = 1
    while math.ceil(math.log(1 - recall) / math.log(1 - similar ** (rows + 1))) <= most_bands:
        rows += 1
    return math.ceil(math.log(1 - recall) / math.log(1 - similar**rows)), rows


def _lines(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many line ends stand before each word; ``starts`` ascend."""
    return np.cumsum(np.bincount(np.searchsorted(starts, np.flatnonzero(data == 10)), minlength=len(starts))[: len(starts)])


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text_no: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Numbers of the words at which paragraphs begin.

    Paragraphs begin with lines, and within lines where the words themselves say so, so that a passage is cut alike wherever it stands,
    but for a few words at its ends.
    """
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    lines = _lines(data, starts)
    new = np.ones(n, bool)
    new[1:] = (text_no[1:] != text_no[:-1]) | (lines[1:] != lines[:-1])
    line = np.cumsum(new)
    pair = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    pair[:-1] = mixed(h[:-1] * np.uint64(3) + h[1:])
    pair[:-1][line[1:] != line[:-1]] = np.iinfo(np.uint64).max
    least = np.ones(n, bool)
    for d in range(1, NEAR + 1):
        here, there, same = pair[:-d], pair[d:], line[:-d] == line[d:]
        least[:-d] &= ~same | (here < there)
        least[d:] &= ~same | (there < here)
    inner = np.zeros(n, bool)
    inner[NEAR:] = line[NEAR:] == line[:-NEAR]  # not right after a line begins
    # one word again and again has no smallest pair: such a run is a paragraph of its own
    other = new.copy()
    other[1:] |= h[1:] != h[:-1]
    begin = np.flatnonzero(other)
    size = np.diff(np.append(begin, n))
    new[begin[size > NEAR]] = True
    after = (begin + size)[size > NEAR]
    new[after[after < n]] = True
    return np.flatnonzero(new | (least & inner & (pair != np.iinfo(np.uint64).max)))


def _inside(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of all stretches ``begin`` to ``begin + size`` one after the other, where each stretch begins among them, with the end)."""
    edge = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(begin, size) + np.arange(edge[-1]) - np.repeat(edge[:-1], size), edge


def _coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, the number of each value of ``x`` among them)."""
    order = np.argsort(x)
    value = x[order]
    new = np.ones(len(x), bool)
    new[1:] = value[1:] != value[:-1]
    code = np.empty(len(x), np.int64)
    code[order] = np.cumsum(new) - 1
    return value[new], code


def _distinct(x: np.ndarray, edge: np.ndarray) -> pa.ListArray:
    """The distinct values of each group ``x[edge[i]:edge[i + 1]]``, in order."""
    values, code = _coded(x)
    both = np.sort(np.repeat(np.arange(len(edge) - 1), np.diff(edge)) * len(values) + code)
    both = both[np.append(True, both[1:] != both[:-1])]
    size = np.bincount(both // len(values), minlength=len(edge) - 1)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values[both % len(values)]))


def _shingles(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all paragraphs, where each paragraph's begin, with the end): shorter paragraphs are one shingle of all their words."""
    size = end - begin
    at, edge = _inside(begin, np.maximum(size - SHINGLE + 1, 1))
    grams = gram_hashes(h, SHINGLE)
    out = np.empty(edge[-1], np.uint64)
    full = np.repeat(size >= SHINGLE, np.diff(edge))
    out[full] = grams[at[full]]
    short = np.flatnonzero(size < SHINGLE)
    whole = np.full(len(short), 7, np.uint64)
    for i in range(SHINGLE - 1):
        more = size[short] > i
        whole[more] = mixed(whole[more] * np.uint64(31) + h[begin[short][more] + i])
    out[edge[:-1][short]] = whole
    return out, edge


def _paragraphs(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, first word in the text, text hash, first and end among all words) of every paragraph, and all words' hashes: pieces, whole lines and whole blocks.

    Blocks are lines between lines without words. Texts without such lines have no blocks, their lines are their paragraphs. Lines and blocks that a
    smaller paragraph covers whole, or that are too short to be similar to another without being equal to it, are left out: their pieces stand for them.
    """
    low = LOWER[data]
    starts, ends, text_no = words(low, offsets, ALNUM)
    h = word_hashes(low, starts, ends)
    first = bounds(text_no, rows.num_rows)
    begin = cut(data, starts, ends, text_no, h)
    if not len(h):
        none = np.zeros(0, np.int64)
        return none, none, h, none, none, h
    line = _lines(data, starts)
    stretches, smaller = [(begin, np.append(begin[1:], len(h)))], begin
    for apart in (1, 2):
        new = np.flatnonzero(np.append(True, (text_no[1:] != text_no[:-1]) | (line[1:] - line[:-1] >= apart)))
        end = np.append(new[1:], len(h))
        several = (apart == 1) | (np.bincount(text_no[new], minlength=rows.num_rows)[text_no[new]] > 1)
        wide = several & (np.searchsorted(smaller, end) - np.searchsorted(smaller, new) > 1) & (end - new >= LEAST_SHINGLES + SHINGLE - 1)
        stretches.append((new[wide], end[wide]))
        smaller = new
    begin, end = (np.concatenate(x) for x in zip(*stretches, strict=True))
    # the text's hash is over its words in order
    at, whole = _inside(begin, end - begin)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int((end - begin).max()), np.uint64(0x5851F42D4C957F2D))]))
    text = mixed(np.add.reduceat(mixed(h)[at] * powers[np.arange(len(at)) - np.repeat(whole[:-1], end - begin)], whole[:-1]) + (end - begin).astype(np.uint64))
    return text_no[begin], begin - first[text_no[begin]], text, begin, end, h


def _banded(text: np.ndarray, begin: np.ndarray, end: np.ndarray, h: np.ndarray, bands: int, per_band: int) -> tuple[np.ndarray, ...]:
    """(one of each class of equal paragraphs, but for those too short to be similar to others; their shingles, where each one's begin, with the end; their band keys, a row each)."""
    one = np.sort(np.unique(text, return_index=True)[1])
    # a different paragraph can be similar only if one of the two has enough shingles
    one = one[end[one] - begin[one] - SHINGLE + 1 >= LEAST_SHINGLES]
    shingles, edge = _shingles(h, begin[one], end[one])
    keys = np.empty((len(one), bands), np.uint64)
    if len(one):
        seeds = mixed(np.arange(1, bands * per_band + 1, dtype=np.uint64))
        for b in range(bands):
            key = np.full(len(one), b, np.uint64)
            for r in range(per_band):
                key = mixed(key * np.uint64(31) + np.minimum.reduceat((shingles ^ seeds[b * per_band + r]) * np.uint64(0x9E3779B97F4A7C15), edge[:-1]))
            keys[:, b] = key
    return one, shingles, edge, keys >> np.uint64(CLASS_BITS)


def _told(batches: Iterator[pa.RecordBatch], bands: int, per_band: int) -> Iterator[pa.RecordBatch]:
    """Band keys, each with bits of a class's hash: of a key's classes in a step the least and the greatest, which tell whether there are several."""
    for rows, data, offsets in steps(batches):
        _, _, text, begin, end, h = _paragraphs(rows, data, offsets)
        one, _, _, keys = _banded(text, begin, end, h, bands, per_band)
        told = np.sort(((keys << np.uint64(CLASS_BITS)) | (text[one] >> np.uint64(64 - CLASS_BITS))[:, None]).ravel())
        key = told >> np.uint64(CLASS_BITS)
        new = np.append(True, key[1:] != key[:-1])[: len(told)]
        yield pa.RecordBatch.from_arrays([pa.array(told[new | np.append(new[1:], True)[: len(told)]].view(np.int64))], ["told"])


def _placed(batches: Iterator[pa.RecordBatch], bands: int, per_band: int, bitmap: Broadcast) -> Iterator[pa.RecordBatch]:
    """All paragraphs; one of each class in a step has those of its band keys that other classes may have too, and, if there are any, its parities and number of shingles."""
    for rows, data, offsets in steps(batches):
        of, first, text, begin, end, h = _paragraphs(rows, data, offsets)
        one, shingles, edge, keys = _banded(text, begin, end, h, bands, per_band)
        met = in_bitmap(bitmap.value, keys.ravel()).reshape(keys.shape)
        size = np.zeros(len(of), np.int64)
        size[one] = met.sum(1)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(keys[met].view(np.int64)))
        none = size == 0
        some = np.flatnonzero(met.any(1))
        at, inner = _inside(edge[some], np.diff(edge)[some])
        sets = _distinct(shingles[at].view(np.int64), inner) if len(some) else pa.array([], pa.list_(pa.int64()))
        n, parities = np.zeros(len(of), np.int32), np.zeros((len(of), PARITIES), np.uint64)
        n[one[some]] = pa.compute.list_value_length(sets).to_numpy(zero_copy_only=False)
        parities[one[some]] = _parities(sets)
        columns = [pa.array(rows.column("row").to_numpy()[of]), rows.column("doc_id").take(pa.array(of)), pa.array(first), pa.array(first + end - begin), pa.array(text.view(np.int64)), lists, pa.array(n, mask=none)]
        columns += [pa.array(np.ascontiguousarray(x).view(np.int64), mask=none) for x in parities.T]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "first_word", "end_word", "h", "bands", "n", *PARITY])


def _in_hashes(batches: Iterator[pa.RecordBatch], bitmap: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(in_bitmap(bitmap.value, batch.column("h").to_numpy().view(np.uint64))))


def _wanted_shingles(batches: Iterator[pa.RecordBatch], bitmap: Broadcast) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in steps(batches):
        _, _, text, begin, end, h = _paragraphs(rows, data, offsets)
        met = np.flatnonzero(in_bitmap(bitmap.value, text))
        if len(met):
            _, one = np.unique(text[met], return_index=True)
            met = met[one]
            shingles, edge = _shingles(h, begin[met], end[met])
            yield pa.RecordBatch.from_arrays([pa.array(text[met].view(np.int64)), _distinct(shingles.view(np.int64), edge)], ["id", "shingles"])


def _parities(lists: pa.ListArray) -> np.ndarray:
    """For each shingle set, of how many shingles each of ``64 * PARITIES`` remainders is: even or odd, a bit each."""
    flat = lists.flatten().to_numpy().view(np.uint64)
    out = np.zeros(len(lists) * PARITIES, np.uint64)
    at = np.repeat(np.arange(len(lists)) * PARITIES, pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
    at += ((flat >> np.uint64(6)) % np.uint64(PARITIES)).astype(np.int64)
    np.bitwise_xor.at(out, at, np.uint64(1) << (flat & np.uint64(63)))
    return out.reshape(-1, PARITIES)


def _unlike(size: np.ndarray, parities: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs of sets that can't be similar: as many shingles as parities differ are in one of the two only, and similar sets have a ninth of all such at most."""
    apart = np.zeros(len(i), np.int64)
    for word in range(PARITIES):
        apart += np.bitwise_count(parities[i, word] ^ parities[j, word])
    return 9 * apart > size[i] + size[j]


def _similar(table: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of shingle sets (sorted lists) have a Jaccard index of ``SIMILAR`` or more, exactly."""
    lists = table.column("shingles").combine_chunks()
    size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    begin, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    out = np.zeros(len(i), bool)
    may = np.flatnonzero(np.minimum(size[i], size[j]) >= SIMILAR * np.maximum(size[i], size[j]) - 1e-9)
    cost = np.cumsum(size[i[may]] + size[j[may]])
    at = 0
    while at < len(may):
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + COMPARED, "right")))
        pair = may[at:to]
        left, right = (_inside(begin[k[pair]], size[k[pair]]) for k in (i, j))
        values, code = _coded(np.concatenate([flat[left[0]], flat[right[0]]]))
        of = np.concatenate([np.repeat(np.arange(len(pair)), size[k[pair]]) for k in (i, j)])
        both = np.sort(of * len(values) + code)
        common = np.bincount(both[1:][both[1:] == both[:-1]] // len(values), minlength=len(pair))
        out[pair] = 5 * common >= 4 * (size[i[pair]] + size[j[pair]] - common)
        at = to
    return out


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of all sets whose parities and sizes don't rule out that they are similar to another of their band, as a forest."""
    told: tuple[pa.Table | None, ...] = (None,)

    def alike(table: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        nonlocal told
        if told[0] is not table:
            told = table, table.column("n").to_numpy().astype(np.int64), np.column_stack([table.column(c).to_numpy().view(np.uint64) for c in PARITY])
        _, size, parities = told
        return ~_unlike(size, parities, i, j) & (np.minimum(size[i], size[j]) >= SIMILAR * np.maximum(size[i], size[j]) - 1e-9)

    yield from linked_forest(batches, alike, 1 << 17)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    told: tuple[pa.Table | None, ...] = (None,)

    def alike(table: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        nonlocal told
        if told[0] is not table:
            lists = table.column("shingles").combine_chunks()
            told = table, pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), _parities(lists)
        out = ~_unlike(told[1], told[2], i, j)
        out[out] = _similar(table, i[out], j[out])
        return out

    yield from linked_forest(batches, alike, 1 << 17)


def _islands(rows: DataFrame, keys: list[str], apart: Column) -> DataFrame:
    """``rows`` with a number ``island`` that begins anew, in each group, where a stretch is ``apart`` of all before it (whose largest end is ``before``)."""
    order = Window.partitionBy(*keys).orderBy("first_word", "end_word")
    before = rows.withColumn("before", F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return before.withColumn("island", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order)).drop("before")


def repeated_passages(docs: DataFrame, least_words: int = 1) -> DataFrame:
    """Passages that stand elsewhere too: doc_id, first_word, end_word, n_words, component_id and kept, a row for each passage of each document.

    Texts are lower-cased (A-Z), cut into words and into paragraphs: whole lines, blocks of lines where blank lines part a text, and pieces of lines, cut where
    the words' own hashes say so, so that a passage inside other text is cut alike everywhere; runs of one word are pieces. Paragraphs of the same
    words are one class. Different paragraphs are similar if the Jaccard index of their 5-word shingles is 0.8 or more (exact; paragraphs under
    five words are one shingle); candidates share a MinHash band. Similar classes form components. A component is repeated if it occurs in two
    places that don't overlap. Its first occurrence, by doc_id (null first) and place, is kept, the others can go; passages are what repeated
    paragraphs cover together, kept ones and others apart, so a word of both goes. Those under ``least_words`` are left out: a caller that
    removes text gives the length from which a repetition isn't mere usage. component_id is the smallest doc_id where any of the
    passage's components occurs. Whole texts of any length are cut at once. Null and wordless texts have no paragraphs; repeated rows repeat each
    other; a null doc_id is reported as null; an empty table gives no rows.
    """
    bands, per_band = tune_bands()
    kind = docs.schema["doc_id"].dataType.simpleString()
    # band keys are by far the most of what there is to tell of a text: they are shuffled once, as one number each, written nowhere, and made anew where several classes have one
    told = docs.select("text").mapInArrow(partial(_told, bands=bands, per_band=per_band), "told long")
    bucket = F.shiftright("told", CLASS_BITS).bitwiseAND((1 << 64 - CLASS_BITS) - 1)
    met = told.repartition(bucket).groupBy(bucket.alias("bucket")).agg(F.min("told").alias("a"), F.max("told").alias("b")).where("a <> b").select("bucket")
    met, met_keys = settled_at(met, "bandkeys")
    own = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    place = f"row long, doc_id {kind}, first_word long, end_word long, h long"
    parts = own.mapInArrow(partial(_placed, bands=bands, per_band=per_band, bitmap=hash_bitmap(met, "bucket", met.count())), ", ".join([place, "bands array<long>, n int", *(f"{c} long" for c in PARITY)]))
    parts = settled(parts, "paragraphs")
    let_go(docs.sparkSession, met_keys)
    members, met_members = settled_at(parts.select(F.explode("bands").alias("bucket"), F.col("h").alias("id")).distinct(), "members")
    # bands in which the same classes meet need only one of them: 128 bits and a count tell the sets apart
    alike = members.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit("again"))).alias("y"))
    one = alike.where("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    members, one_members = settled_at(members.join(one, "bucket", "left_semi"), "members")
    let_go(docs.sparkSession, met_members)
    # few classes of a band are similar, and 40 bytes of each tell nearly all others: only what is left is compared by its shingles
    sketches = parts.where("n is not null").groupBy(F.col("h").alias("id")).agg(*(F.first(c).alias(c) for c in ("n", *PARITY)))
    rows = split_buckets(members.withColumn("anchor", F.lit(True)), COMPARED_ANCHORS).join(sketches, "id")
    near = grouped(rows).mapInArrow(_may_link, "a long, b long").select(F.explode(F.array("a", "b")).alias("id")).distinct()
    near = settled(near, "near")
    members = settled(members.join(near, "id", "left_semi"), "members")
    let_go(docs.sparkSession, one_members)
    shingles = docs.select("text").mapInArrow(partial(_wanted_shingles, bitmap=hash_bitmap(near, "id", near.count())), "id long, shingles array<long>")
    shingles = shingles.groupBy("id").agg(F.first("shingles").alias("shingles"))
    rows = split_buckets(members.withColumn("anchor", F.lit(True)), COMPARED_ANCHORS).join(shingles, "id")
    similar = components(grouped(rows).mapInArrow(_links, "a long, b long")).withColumnRenamed("id", "h")

    parts = parts.drop("bands", "n", *PARITY)
    counts = parts.groupBy("h").agg(F.count("*").alias("n"))
    classes = counts.join(similar, "h", "left").where("n > 1 or component is not null")  # no other class can be repeated
    labels = settled(classes.select("h", F.coalesce("component", "h").alias("component"), "n"), "labels")
    found = parts.mapInArrow(partial(_in_hashes, bitmap=hash_bitmap(labels, "h", labels.count())), place)
    found = salted_join(found, labels, "h", parts.count()).drop("h")
    places = _islands(found, ["row", "component"], F.col("first_word") >= F.col("before")).groupBy("row", "doc_id", "component", "island").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"))
    places = settled(places.drop("island"), "places")
    first = places.groupBy("component").agg(F.min(F.struct("doc_id", "row", "first_word")).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = salted_join(places, first, "component", places.count()).withColumn("kept", (F.col("first.row") == F.col("row")) & (F.col("first.first_word") == F.col("first_word")))
    passages = _islands(repeated, ["row", "kept"], F.col("first_word") > F.col("before")).groupBy("row", "doc_id", "kept", "island").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.min("first.doc_id").alias("component_id"))
    passages = passages.withColumn("n_words", F.col("end_word") - F.col("first_word")).where(F.col("n_words") >= least_words)
    return passages.select("doc_id", "first_word", "end_word", "n_words", "component_id", "kept")
