"""Quality selection by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.bytewords import ALNUM, LOWER, bounds, gram_hashes, word_hashes, words
from framelake.llm.shared import settled, steps

#: Buckets of the hashed n-gram models.
GRAMS = 1 << 20
#: Shape of the prior of a gram's own ratio (Jeffreys' for counts), and how often the mixture is re-estimated.
SHAPE, ROUNDS = 0.5, 12
#: Labelled target ids are broadcast up to this number, and joined by a shuffle beyond.
BROADCAST_IDS = 500_000
#: Bytes of runs of signs: neither words nor white space.
SIGN = ~ALNUM
SIGN[:33] = SIGN[127] = False


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of all uni- and bigrams of words and runs of signs."""
    data = LOWER[data]
    found = [words(data, offsets, ALNUM), words(data, offsets, SIGN)]
    starts, ends, text_no = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(starts, kind="stable")
    starts, ends, text_no = starts[order], ends[order], text_no[order]
    h = word_hashes(data, starts, ends)
    two = gram_hashes(h, 2)
    same = text_no[:-1] == text_no[1:] if len(text_no) else np.zeros(0, bool)
    return (np.concatenate([h, two[same]]) % np.uint64(GRAMS)).astype(np.int64), np.concatenate([text_no, text_no[:-1][same]])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, good = np.zeros(GRAMS, np.int64), np.zeros((2, GRAMS), np.int64)
    for rows, data, offsets in steps(batches):
        bucket, text_no = grams(data, offsets)
        raw += np.bincount(bucket, minlength=GRAMS)
        wanted, fold = rows.column("wanted").to_numpy(zero_copy_only=False), rows.column("fold").to_numpy()
        for f in (0, 1):
            good[f] += np.bincount(bucket[(wanted & (fold == f))[text_no]], minlength=GRAMS)
    for at in range(0, GRAMS, 1 << 15):
        full = at + np.flatnonzero(raw[at : at + (1 << 15)])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (full, raw[full], good[0][full], good[1][full])], ["bucket", "raw", "good0", "good1"])


def _weights(batches: Iterator[pa.RecordBatch], ratio: Broadcast, length: float | None) -> Iterator[pa.RecordBatch]:
    logs = ratio.value
    for rows, data, offsets in steps(batches):
        bucket, text_no = grams(data, offsets)
        fold = rows.column("fold").to_numpy()
        weight = np.bincount(text_no, logs[1 - fold[text_no], bucket], rows.num_rows).astype(float)  # of no grams it would count integers
        if length is not None:
            weight *= length / np.maximum(np.bincount(text_no, minlength=rows.num_rows), 1)
        key = weight + rows.column("noise").to_numpy()
        bits = key.view(np.int64)
        order = np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(weight), pa.array(key), pa.array(order)], ["doc_id", "log_weight", "sample_key", "rank_bits"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function, by Stirling's series above 6."""
    y, shift = np.asarray(x, float), 0.0
    for _ in range(6):
        shift, y = shift + np.log(y), y + 1
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def _gamma_poisson(x: np.ndarray, mean: np.ndarray, shape: float) -> np.ndarray:
    """Log probability of counts whose rates are spread about ``mean`` as a gamma of this shape, without the counts' factorial."""
    return log_gamma(x + shape) - log_gamma(np.array(shape)) + shape * np.log(shape / (shape + mean)) + x * np.log(mean / (shape + mean))


def log_ratio(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log of target over raw probability of each bucket, from raw and target counts; both models sum to 1, and the raw one is its counts' shares.

    The target model is smoothed towards the raw one: a gram is either ordinary, with the ratio that ordinary grams have in common, or has a
    ratio of its own, and its target probability is the mean of the two weighed by how probable each is given its counts. The common
    ratio, its spread, and how many grams are ordinary are fitted to the counts themselves; no threshold sets evidence to nothing.
    """
    out = np.zeros(len(raw))
    seen = np.flatnonzero(raw)
    if not good.sum():
        return out
    pairs, of, many = np.unique(np.stack([raw[seen], good[seen]]), axis=1, return_inverse=True, return_counts=True)  # equal counts are fitted once
    even, x = pairs[0] * good.sum() / raw.sum(), pairs[1]
    common, own_share, shape = 1.0, 0.1, 50.0
    for _ in range(ROUNDS):
        mean = common * even
        odds = np.clip(_gamma_poisson(x, mean, SHAPE) - _gamma_poisson(x, mean, shape), -50, 50) + np.log(own_share / (1 - own_share))
        own = 1 / (1 + np.exp(-odds))
        own_share = min(max((own * many).sum() / many.sum(), 1e-6), 1 - 1e-6)
        ordinary = np.maximum((1 - own) * many, 1e-300)
        common = max((ordinary * x).sum() / (ordinary * even).sum(), 1e-6)
        mean = common * even
        told = ordinary * mean / (1 + mean / shape)  # counts tell of the spread as far as they are large
        spread = (told * ((x / mean - 1) ** 2 - 1 / mean)).sum() / told.sum()
        shape = 1 / min(max(spread, 1e-4), 1 / (2 * SHAPE))
    logs = np.log(common) + np.log(own * (x + SHAPE) / (mean + SHAPE) + 1 - own)
    out[seen] = logs[of.ravel()]
    return out - np.log((raw * np.exp(out)).sum() / raw.sum())


def kth_largest(values: DataFrame, column: str, k: int) -> int:
    """The exact k-th largest of a long column, by four counts of 16 bits each; only the counts come to the driver."""
    prefix, within = None, values
    for shift in (48, 32, 16, 0):
        digit = F.shiftright(F.col(column), shift)
        counts = sorted(((r[0], r[1]) for r in within.groupBy(digit.alias("d")).count().collect()), reverse=True)  # 65536 rows at most
        for d, n in counts:
            if k <= n:
                prefix = d
                break
            k -= n
        within = within.where(digit == prefix)
    return int(prefix)


def resampled(docs: DataFrame, labels: DataFrame, seed: int = 11, per_gram: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, log_weight, sample_key and kept.

    Target text: all documents that ``labels`` (doc_id, quality, toxic) call of quality 1 and nowhere anything else. log_weight is the log of the
    ratio of the target's and all documents' hashed uni- and bigram models over the whole text. The target is halved by hash, and each document
    is scored by the half it is not in, so that none vouches for itself. With ``per_gram`` all texts are weighed at one length: the
    weight is the mean log ratio of a text's grams, less the target's own mean, times the grams of an average document.

    Keys add Gumbel noise hashed from id and text, and the k largest keys are kept (ties too): a sample without replacement in proportion
    to the weights. k is the target's share of all labelled documents times the number of rows. Null and empty texts have no gram and weight 0;
    rows equal in id and text share their noise and are kept or left together; rows without an id have no label. Without labels nothing is
    known, and all rows are kept; an empty table gives no rows. Ids may be of any type.
    """
    spark = docs.sparkSession
    clean = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.every(clean).alias("wanted"))
    all_labels, targets = known.agg(F.count("*"), F.count_if("wanted")).first()
    ids, n = known.where("wanted"), docs.count()
    u = (F.pmod(F.xxhash64("doc_id", "text", F.lit(seed), F.lit("gumbel")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit("fold")), F.lit(2)).cast("int")
    rows = docs.select("doc_id", "text", (-F.log(-F.log(u))).alias("noise"), fold.alias("fold"))
    marked = rows.select("doc_id", "text", "fold").join(F.broadcast(ids) if targets <= BROADCAST_IDS else ids, "doc_id", "left")
    counted = marked.select("text", "fold", F.coalesce("wanted", F.lit(False)).alias("wanted")).mapInArrow(_counts, "bucket long, raw long, good0 long, good1 long")
    sums = counted.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("raw", "good0", "good1"))).toArrow()  # GRAMS rows at most
    raw, good = np.zeros(GRAMS), np.zeros((2, GRAMS))
    at = sums.column("bucket").to_numpy()
    raw[at], good[0][at], good[1][at] = (sums.column(c).to_numpy() for c in ("raw", "good0", "good1"))
    logs = np.stack([log_ratio(raw, g) for g in good])
    if per_gram:
        logs -= (good[::-1] * logs).sum(1, keepdims=True) / np.maximum(good[::-1].sum(1, keepdims=True), 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(logs.astype(np.float32))  # 8 bytes a bucket
    scored = rows.mapInArrow(partial(_weights, ratio=shared, length=raw.sum() / max(n, 1) if per_gram else None), f"doc_id {kind}, log_weight double, sample_key double, rank_bits long")
    scored = settled(scored, "weights")
    k = round(n * targets / all_labels) if all_labels else n
    kept = F.lit(k > 0) if k in (0, n) else F.col("rank_bits") >= kth_largest(scored, "rank_bits", k)
    return scored.select("doc_id", "log_weight", "sample_key", kept.alias("kept"))
