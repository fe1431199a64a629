"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy over the whole corpus, predicts every token from both sides."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.bytewords import ALNUM, LOWER, bounds, mixed, word_hashes, words
from framelake.llm.shared import hash_bitmap, in_bitmap, settled, steps

#: Output classes, and tokens in each. The commonest words have tokens of their own in the first half; all others share the rest by hash.
CLASSES, PER_CLASS = 48, 48
TOKENS = CLASSES * PER_CLASS
OWN = TOKENS // 2
#: Words seen on either side, and the hidden width.
REACH, WIDTH = 2, 32
#: Tokens in a training step, step size.
BATCH, RATE = 8192, 0.1
#: Words of a part of the corpus that one network is trained on, words that are put in random order at once, and words in a row.
PART, SHUFFLED, ROW = 1 << 20, 1 << 16, 4096
#: Parts of the first wave of training; each later wave begins with the mean of the one before and has as many parts as all before it.
FIRST_WAVE = 8
#: Equal pieces beyond this number are dealt over all parts.
EQUAL_PIECES = 64
#: Parameters in a row that travels to the averaging, and networks that are summed before all are.
CHUNK, TOGETHER = 4096, 64
#: Rows of a group that are added one after the other in a round of summing.
ADDED = 16
#: Positions that are scored in one vectorised step.
SCORED = 1 << 14
#: Words whose counts every scoring task has; rarer ones are joined.
HEAD = 1 << 20

SHAPES = {"context": (2 * REACH, TOKENS + 1, WIDTH), "hidden": (WIDTH,), "classes": (CLASSES, WIDTH), "class_bias": (CLASSES,), "tokens": (CLASSES, PER_CLASS, WIDTH), "token_bias": (CLASSES, PER_CLASS)}


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in steps(batches):
        data = LOWER[data]
        starts, ends, _ = words(data, offsets, ALNUM)
        h, n = np.unique(word_hashes(data, starts, ends), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n): how often each word stands in the whole corpus, by hash; a table in the shared folder."""
    return settled(docs.select("text").mapInArrow(_word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "wordcounts")


def vocabulary(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the commonest words, commonest first."""
    found = counts.orderBy(F.desc("n"), "h").limit(OWN).collect()
    return np.array([r["h"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)


def initial(seed: int = 3, totals: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Parameters before training: small random context and output vectors, and the biases that give each token its share of the corpus (``totals``), or zero."""
    rng = np.random.default_rng(seed)
    out = {k: (rng.standard_normal(s) * (0.1 if len(s) > 1 and "bias" not in k else 0)).astype(np.float32) for k, s in SHAPES.items()}
    if totals is not None:
        grid = totals.reshape(CLASSES, PER_CLASS) + 1.0
        out["class_bias"] = np.log(grid.sum(1) / grid.sum()).astype(np.float32)
        out["token_bias"] = np.log(grid / grid.sum(1, keepdims=True)).astype(np.float32)
    return out


def _rows(shape: tuple[int, ...]) -> tuple[int, ...]:
    """Shape of what is kept of a parameter's squared gradients between waves: one mean a vector, and one number a bias."""
    return (*shape[:-1], 1) if shape[-1] == WIDTH else shape


def packed(params: dict[str, np.ndarray], seen: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Parameters, then the means of the squared gradients seen; where none were, a small number."""
    kept = [np.full(_rows(s), 1e-4, np.float32) if seen is None else seen[k].mean(-1, keepdims=True) if _rows(s) != s else seen[k] for k, s in SHAPES.items()]
    return np.concatenate([*(params[k].ravel() for k in SHAPES), *(x.ravel() for x in kept)]).astype(np.float32)


def _seen(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Squared gradients from the end of :func:`packed` parameters."""
    out, at = {}, sum(int(np.prod(s)) for s in SHAPES.values())
    for k, s in SHAPES.items():
        size = int(np.prod(_rows(s)))
        out[k] = np.broadcast_to(flat[at : at + size].reshape(_rows(s)), s).astype(np.float32)
        at += size
    return out


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        out[k] = flat[at : at + int(np.prod(s))].reshape(s).copy()
        at += int(np.prod(s))
    return out


def shared_tokens(h: np.ndarray) -> np.ndarray:
    """Tokens of words that have none of their own, by hash."""
    return (OWN + mixed(h) % np.uint64(TOKENS - OWN)).astype(np.int64)


def _found(h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each hash is among sorted ``known`` ones, where)."""
    if not len(known):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[at] == h, at


def _tokens(data: np.ndarray, offsets: np.ndarray, known: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of each word, text number, word hash); ``known`` are sorted hashes, ``number`` their tokens."""
    data = LOWER[data]
    starts, ends, text_no = words(data, offsets, ALNUM)
    h = word_hashes(data, starts, ends)
    token = shared_tokens(h)
    own, at = _found(h, known)
    token[own] = number[at[own]]
    return token, text_no, h


def _context(token: np.ndarray, text_no: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Tokens before and after each position; outside the text stands token ``TOKENS``."""
    out = []
    for shift in (*range(-REACH, 0), *range(1, REACH + 1)):
        to = at + shift
        ok = (to >= 0) & (to < len(token))
        to = np.where(ok, to, 0)
        out.append(np.where(ok & (text_no[to] == text_no[at]), token[to], TOKENS))
    return out


def _hidden(params: dict[str, np.ndarray], context: list[np.ndarray]) -> np.ndarray:
    total = params["context"][0].take(context[0], 0)
    for p, c in zip(params["context"][1:], context[1:], strict=True):
        total += p.take(c, 0)
    total += params["hidden"]
    return np.tanh(total, out=total)


def _odds(x: np.ndarray) -> np.ndarray:
    """Unnormalised probabilities of logits ``x``, a column for each position, in their place."""
    x -= x.max(0)
    return np.exp(x, out=x)


def _class_odds(params: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    x = params["classes"] @ h.T
    x += params["class_bias"][:, None]
    return _odds(x)


def _token_odds(params: dict[str, np.ndarray], h: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Odds of the tokens of each position's own class; positions of a class stand together."""
    x = np.empty((PER_CLASS, len(h)), h.dtype)
    for c, a, b in spans:
        np.matmul(params["tokens"][c], h[a:b].T, out=x[:, a:b])
        x[:, a:b] += params["token_bias"][c][:, None]
    return _odds(x)


def _by_class(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order in which positions of a class stand together, (class, begin, end) of those that occur)."""
    order = np.argsort(group.astype(np.int16), kind="stable")
    edge = np.searchsorted(group[order], np.arange(CLASSES + 1)).tolist()
    return order, [(c, a, b) for c, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if a < b]


def log_probabilities(params: dict[str, np.ndarray], token: np.ndarray, context: list[np.ndarray]) -> np.ndarray:
    """Natural log of each token's probability given its context: its class's times its own within the class."""
    group = token // PER_CLASS
    order, spans = _by_class(group)
    group, within, column = group[order], (token - PER_CLASS * group)[order], np.arange(len(token))
    h = _hidden(params, [c[order] for c in context])
    odds = _class_odds(params, h)
    logs = np.log(odds[group, column] / odds.sum(0)).astype(np.float64)
    odds = _token_odds(params, h, spans)
    logs += np.log(odds[within, column] / odds.sum(0))
    out = np.empty(len(token))
    out[order] = logs
    return out


def _row_sums(x: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the rows ``x[at]`` of consecutive groups of ``size`` rows, none empty; the rows of all groups that have an n-th one are added at once, ``ADDED`` of a group in a round."""
    while True:
        chunks = -(-size // ADDED)
        edge = np.cumsum(chunks)
        nth = np.arange(edge[-1]) - np.repeat(edge - chunks, chunks)
        begin = np.repeat(np.cumsum(size) - size, chunks) + ADDED * nth
        left = np.minimum(np.repeat(size, chunks) - ADDED * nth, ADDED)
        order = np.argsort((-left).astype(np.int16), kind="stable")  # longest first
        begin, many = begin[order], np.cumsum(np.bincount(left, minlength=ADDED + 1)[::-1])[::-1]
        total = x.take(at[begin], 0)
        for r in range(1, ADDED):
            if not (m := int(many[r + 1])):
                break
            total[:m] += x.take(at[begin[:m] + r], 0)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        if len(chunks) == len(order):
            return total.take(place, 0)
        x, at, size = total, place, chunks


def gradient(params: dict[str, np.ndarray], token: np.ndarray, context: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Of the mean log-probability."""
    group = token // PER_CLASS
    order, spans = _by_class(group)
    context, group, within = [c[order] for c in context], group[order], (token - PER_CLASS * group)[order]
    h, column, n = _hidden(params, context), np.arange(len(token)), np.float32(len(token))
    d = _class_odds(params, h)
    d *= -1 / (n * d.sum(0))
    d[group, column] += 1 / n
    e = _token_odds(params, h, spans)
    e *= -1 / (n * e.sum(0))
    e[within, column] += 1 / n
    out = {"classes": d @ h, "class_bias": d.sum(1), "tokens": np.zeros_like(params["tokens"]), "token_bias": np.zeros_like(params["token_bias"])}
    dh = np.empty_like(h)
    for c, a, b in spans:
        np.matmul(e[:, a:b], h[a:b], out=out["tokens"][c])
        out["token_bias"][c] = e[:, a:b].sum(1)
        np.matmul(e[:, a:b].T, params["tokens"][c], out=dh[a:b])
    dh += d.T @ params["classes"]
    h *= h
    dh *= np.subtract(1, h, out=h)
    out["hidden"] = dh.sum(0)
    # rows of one place and token side by side, so that they are summed together
    row = np.concatenate([c + p * (TOKENS + 1) for p, c in enumerate(context)])
    order = np.argsort(row.astype(np.int16), kind="stable")
    row = row[order]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    sums = np.zeros((len(context) * (TOKENS + 1), WIDTH), h.dtype)
    sums[row[first]] = _row_sums(dh, np.tile(column, len(context))[order], np.diff(np.append(first, len(row))))
    out["context"] = sums.reshape(params["context"].shape)
    return out


def _dealt(batches: Iterator[pa.RecordBatch], shared: Broadcast, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, place, lead, trail, tokens) of pieces of all texts: int16 tokens with those of their context, ``lead`` before and ``trail`` after."""
    known, number, _ = shared.value
    for rows, data, offsets in steps(batches):
        token, text_no, _ = _tokens(data, offsets, known, number)
        edge = bounds(text_no, rows.num_rows)
        pieces = -(-np.diff(edge) // ROW)
        of = np.repeat(np.arange(rows.num_rows), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = edge[:-1][of] + ROW * nth
        end = np.minimum(begin + ROW, edge[1:][of])
        low, high = np.maximum(begin - REACH, edge[:-1][of]), np.minimum(end + REACH, edge[1:][of])
        place = mixed(rows.column("key").to_numpy().view(np.uint64)[of] + nth.astype(np.uint64))
        raw = token.astype(np.int16)
        cut = [raw[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        arrays = [(place % np.uint64(parts)).astype(np.int64), place.view(np.int64), (begin - low).astype(np.int32), (high - end).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(cut, pa.binary())], ["part", "place", "lead", "trail", "tokens"])


class Trainer:
    """One network that is trained by Adagrad on the pieces it is given, in one pass over every position."""

    def __init__(self, start: np.ndarray, seed: int) -> None:
        self.params, self.rng, self.n = unpacked(start), np.random.default_rng(seed), 0
        self.seen = _seen(start)
        self.held: list[tuple[np.ndarray, int, int]] = []
        self.words = 0

    def add(self, token: np.ndarray, lead: int, trail: int) -> None:
        self.held.append((token, lead, trail))
        self.words += len(token)
        if self.words >= SHUFFLED:
            self.train()

    def train(self) -> None:
        """Trains on all positions held, but for those that are only context."""
        if not self.held:
            return
        token = np.concatenate([t for t, _, _ in self.held]).astype(np.int64)
        size = [len(t) for t, _, _ in self.held]
        piece = np.repeat(np.arange(len(size)), size)
        at = np.concatenate([np.arange(e - n + lead, e - trail) for e, n, (_, lead, trail) in zip(np.cumsum(size).tolist(), size, self.held, strict=True)])
        at = self.rng.permutation(at)
        context = _context(token, piece, at)
        for i in range(0, len(at), BATCH):
            grads = gradient(self.params, token[at[i : i + BATCH]], [c[i : i + BATCH] for c in context])
            for k, g in grads.items():
                g = np.asarray(g, np.float32) * np.float32(np.sqrt(min(BATCH, len(at) - i)))
                self.seen[k] += g * g
                self.params[k] += np.float32(RATE) * g / np.sqrt(self.seen[k])
        self.n += len(at)
        self.held, self.words = [], 0


def _trained(batches: Iterator[pa.RecordBatch], shared: Broadcast, seed: int) -> Iterator[pa.RecordBatch]:
    """(group, block, n, v) of the networks of whole parts, whose rows stand together and in order; each network is weighed by its predictions."""
    start, now, trainer = shared.value[2], None, None

    def told() -> Iterator[pa.RecordBatch]:
        trainer.train()
        if trainer.n:
            flat = packed(trainer.params, trainer.seen)
            blocks = [flat[i : i + CHUNK] for i in range(0, len(flat), CHUNK)]
            columns = [pa.array([now // TOGETHER] * len(blocks), pa.int64()), pa.array(range(len(blocks)), pa.int32()), pa.array([trainer.n] * len(blocks), pa.int64()), pa.array(blocks, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["group", "block", "n", "v"])

    for batch in batches:
        for part, lead, trail, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "lead", "trail", "tokens")), strict=True):
            if part != now:
                if trainer:
                    yield from told()
                now, trainer = part, Trainer(start, seed)
            trainer.add(np.frombuffer(raw, np.int16), lead, trail)
    if trainer:
        yield from told()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, n, v): weighted means of the parameter blocks of one partition; there are as many as the network has, however many rows came."""
    total: dict[int, np.ndarray] = {}
    weight: dict[int, int] = {}
    for batch in batches:
        for block, n, v in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist(), batch.column("v"), strict=True):
            total[block] = total.get(block, 0) + n * v.values.to_numpy().astype(np.float64)
            weight[block] = weight.get(block, 0) + n
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(weight.values()), pa.int64()), pa.array([(total[b] / weight[b]).astype(np.float32) for b in total], pa.list_(pa.float32()))], ["block", "n", "v"])


def _shared_counts(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, n = batch.column("h").to_numpy().view(np.uint64), batch.column("n").to_numpy()
        own, _ = _found(h, shared.value)
        total = np.zeros(TOKENS, np.int64)
        np.add.at(total, shared_tokens(h[~own]), n[~own])
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["token", "n"])


def shared_totals(counts: DataFrame, known: np.ndarray) -> np.ndarray:
    """How often the words of each shared token stand in the corpus; ``known`` are the sorted hashes of words with tokens of their own."""
    shared = counts.sparkSession.sparkContext.broadcast(known)
    out = np.zeros(TOKENS)
    for token, n in counts.mapInArrow(partial(_shared_counts, shared=shared), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():  # of the shared tokens
        out[token] = n
    return out


def _by_place(batches: Iterator[pa.RecordBatch], bitmap: Broadcast, inside: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(in_bitmap(bitmap.value, batch.column("place").to_numpy().view(np.uint64)) == inside))


def _spread(pieces: DataFrame, wave: Column, parts: int) -> DataFrame:
    """``pieces`` with those that are equal many times dealt over all parts, each copy by its number, so that no part has them all.

    Equal pieces are counted with map-side aggregation and made anew from their number, in rows of 1024 first, so none meet in one task. Others that
    pass the bitmap are counted with them and stay where they were.
    """
    many = settled(pieces.groupBy("place").count().where(F.col("count") > EQUAL_PIECES), "equalpieces")
    if many.isEmpty():
        return pieces
    bitmap, columns = hash_bitmap(many, "place"), pieces.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    own, others = (pieces.mapInArrow(partial(_by_place, bitmap=bitmap, inside=x), kinds) for x in (True, False))
    chunks = own.groupBy(*columns).count().withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / 1024))))
    each = F.sequence(F.col("chunk") * 1024, F.least(F.col("count"), (F.col("chunk") + 1) * 1024) - 1)
    copies = chunks.repartition("place", "chunk").withColumn("copy", F.explode(each))
    part = F.when(F.col("copy") == 0, F.col("part")).otherwise(F.pmod(F.xxhash64("place", "copy"), F.lit(parts)))
    return others.unionByName(copies.withColumn("part", part).withColumn("wave", wave).select(columns))


def fit(docs: DataFrame, counts: DataFrame, seed: int = 3, most_waves: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes of the words with own tokens, their tokens, parameters) learned from all texts of ``docs`` (doc_id, text), whose words ``counts`` has.

    Texts are cut into pieces, and pieces dealt by the hash of their id and text into parts of about ``PART`` words, those of rows that are equal
    many times by their number too; the number of parts follows from the words alone, so the result doesn't depend on how the table is split.
    Parts are trained in waves, each as large as all before it: a network is trained on each part of a wave from a common start, predicting every position with the
    words around it as context, the networks are averaged, in groups first, by how many positions they predicted, and the next wave starts
    from the mean, with step sizes that heed the gradients seen so far. So every position is predicted once, and more text goes on
    improving the network. Its size is fixed. ``most_waves`` ends sooner; with 0 only words' shares are learned.
    """
    known, n = vocabulary(counts)
    order = np.argsort(known)
    totals = shared_totals(counts, known[order])
    totals[: len(n)] = n
    start = packed(initial(seed, totals))
    shared = docs.sparkSession.sparkContext.broadcast((known[order], order, start))  # of a fixed size
    parts = max(1, -(-(counts.agg(F.sum("n")).first()[0] or 0) // PART))
    edges = [0, FIRST_WAVE]
    while edges[-1] < parts:
        edges.append(2 * edges[-1])
    wave = sum(((F.col("part") >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    dealt = docs.select("text", F.xxhash64("doc_id", "text").alias("key")).mapInArrow(partial(_dealt, shared=shared, parts=parts), "part long, place long, lead int, trail int, tokens binary")
    pieces = _spread(settled(dealt.withColumn("wave", wave), "pieces", by="wave"), wave, parts)
    sums = "block int, n long, v array<float>"
    for i, (a, b) in list(enumerate(zip(edges[:-1], edges[1:], strict=True)))[:most_waves]:
        at = docs.sparkSession.sparkContext.broadcast((known[order], order, start))
        of_wave = pieces.where(F.col("wave") == i).drop("wave").repartition(2 * (min(b, parts) - a), "part").sortWithinPartitions("part", "place")
        networks = of_wave.mapInArrow(partial(_trained, shared=at, seed=seed + i), f"group long, {sums}")
        mean = networks.repartition("group", "block").mapInArrow(_summed, sums).repartition("block").mapInArrow(_summed, sums).toPandas().sort_values("block")  # one network
        start = np.concatenate([np.asarray(v, np.float32) for v in mean["v"]]) if len(mean) else start
    return known[order], order, packed(unpacked(start))[: sum(int(np.prod(s)) for s in SHAPES.values())]


def word_shares(counts: DataFrame, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(sorted hashes of up to ``HEAD`` frequent words, logs of their counts, log of each shared token's count, the least count of these words).

    The least count is found among counts of which only the first ten binary digits are told apart, so fewer than 2^16 come to the driver.
    """
    digits = F.greatest(F.length(F.bin("n")) - 10, F.lit(0))
    rounded = F.expr("shiftleft(shiftright(n, digits), digits)")
    by_count = sorted(((r[0], r[1]) for r in counts.withColumn("digits", digits.cast("int")).groupBy(rounded.alias("n")).count().collect()), reverse=True)
    least, room = (1 << 63) - 1, HEAD
    for n, many in by_count:
        if many > room:
            break
        least, room = n, room - many
    head = counts.where(F.col("n") >= least).toArrow().sort_by("h")  # HEAD rows at most
    h, n = head.column("h").to_numpy().view(np.uint64), head.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], np.log(n[order]), np.log(np.maximum(shared_totals(counts, known), 1)), least


def _scored(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    (known, number, flat), (head, head_logs, token_logs, _) = shared.value
    params = unpacked(flat)
    for rows, data, offsets in steps(batches):
        token, text_no, h = _tokens(data, offsets, known, number)
        logs = np.zeros(len(token))
        for i in range(0, len(token), SCORED):
            at = np.arange(i, min(i + SCORED, len(token)))
            logs[at] = log_probabilities(params, token[at], _context(token, text_no, at))
        rare = np.flatnonzero(token >= OWN)
        listed, at = _found(h[rare], head)
        logs[rare] -= token_logs[token[rare]]
        logs[rare[listed]] += head_logs[at[listed]]
        rare = rare[~listed]
        edge = bounds(text_no, rows.num_rows)
        n = np.diff(edge).astype(np.int64)
        total = np.bincount(text_no, logs, rows.num_rows).astype(float)
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text_no[rare], np.arange(rows.num_rows + 1)).astype(np.int32)), pa.array(h[rare].view(np.int64)))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), pa.array(total), lists], ["doc_id", "n_tokens", "log_likelihood", "rare"])


def scored_by(docs: DataFrame, counts: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """As :func:`scored`, by a network that :func:`fit` gave, and the word counts that it was given; words not counted count as though they stood once."""
    shares = word_shares(counts, model[0])
    shared = docs.sparkSession.sparkContext.broadcast((model, shares))  # the network's size and HEAD words
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(partial(_scored, shared=shared), f"doc_id {kind}, n_tokens long, log_likelihood double, rare array<long>")
    if shares[3] > 2:  # rarer words may stand more than once
        out = settled(out.withColumn("row", F.monotonically_increasing_id()), "scores")
        rare = out.select("row", F.explode("rare").alias("h")).join(counts.where((F.col("n") > 1) & (F.col("n") < shares[3])), "h")
        more = rare.groupBy("row").agg(F.sum(F.log("n")).alias("more"))
        out = out.join(more, "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "log_likelihood", F.try_divide("log_likelihood", F.nullif("n_tokens", F.lit(0))).alias("mean_log_likelihood"))


def scored(docs: DataFrame, seed: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, log_likelihood (summed conditional log-probabilities of all words) and mean_log_likelihood.

    The commonest words have tokens of their own; the others share tokens by hash, and a word's probability is its token's times the word's share
    of the token's count in the corpus, so that no rare word passes for its token. Whole texts are scored by a network fitted on
    the same table. Texts that are null or have no word have 0 tokens, log-likelihood 0 and no mean. Long texts are trained on in pieces that
    overlap by their context. Repeated rows are scored alike; rows with a null id too; an empty table gives no rows.
    """
    counts = word_counts(docs)
    return scored_by(docs, counts, fit(docs, counts, seed))


def held_out(docs: DataFrame, seed: int = 3, of: int = 10, most_waves: int | None = None) -> float:
    """The mean log-likelihood of a word of the rows whose text's hash is divisible by ``of``, scored by a network that is fitted on the others; equal texts stand on one side."""
    fold = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(of))
    learned, told = docs.where(fold != 0), docs.where(fold == 0)
    counts = word_counts(learned)
    return scored_by(told, counts, fit(learned, counts, seed, most_waves)).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
