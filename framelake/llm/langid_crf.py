"""Language identification of words and texts by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.llm.bytewords import bounds, mixed, word_hashes, words
from framelake.llm.shared import free_names, settled, steps

#: Bytes of words: letters of ASCII and every byte of characters beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True

GRAMS = 1 << 16
SEGMENT = 128
#: Text bytes labelled at once: messages take about 200 bytes a word.
STEP = 1 << 20
#: Words with the usual evidence that a text is given, so that a short one isn't judged by a word or two.
PRIOR_WORDS = 10


@dataclass
class Crf:
    """Emission weights of hashed byte n-grams (affixes are those that touch a word's edge) and of lexicon words; start and transition weights.

    ``seen`` are the n-grams of the texts it was fitted on, ``usual`` the share of a text's n-grams that such a text's peers usually have too.
    """

    langs: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    entries: np.ndarray
    start: np.ndarray
    move: np.ndarray
    seen: np.ndarray | None = None
    usual: float = 0.0


def word_types(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct word, each word's number among them, gram buckets of all distinct words, where each word's grams begin)."""
    h = word_hashes(data, starts, ends)
    kinds, first, of = np.unique(h, return_index=True, return_inverse=True)
    s, size = starts[first], (ends - starts)[first]
    wide = size + 2  # a mark on either side
    base = np.cumsum(wide) - wide
    marked = np.full(int(wide.sum()), 1, np.uint64)  # byte 1 marks an edge
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    marked[np.repeat(base + 1, size) + inner] = data[np.repeat(s, size) + inner]
    left = np.repeat(base + wide, wide) - np.arange(len(marked))  # bytes from here to the word's end
    codes, keys = [], []
    code = marked.copy()
    for n in (2, 3, 4):
        code = code[: len(marked) - n + 1] * np.uint64(256) + marked[n - 1 :]
        ok = np.flatnonzero(left[: len(code)] >= n)
        codes.append((mixed(code[ok] + np.uint64(n << 40)) % np.uint64(GRAMS)).astype(np.int64))
        keys.append(ok)
    where = np.concatenate(keys)
    order = np.argsort(where, kind="stable")
    where = where[order]
    return kinds, of, np.concatenate(codes)[order], np.searchsorted(where, base)


def emissions(model: Crf, kinds: np.ndarray, codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Label scores of each distinct word."""
    if not len(kinds):
        return np.zeros((0, len(model.langs)), np.float32)
    out = np.add.reduceat(model.grams[codes], begin, axis=0)
    if len(model.lexicon):
        at = np.minimum(np.searchsorted(model.lexicon, kinds), len(model.lexicon) - 1)
        known = model.lexicon[at] == kinds
        out[known] += model.entries[at[known]]
    return out


def _segments(scores: np.ndarray, first: np.ndarray, model: Crf, begins: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word factors, which words begin a text, transfer matrix of each segment) by place in the segment, then segment."""
    n, k = scores.shape
    length = min(SEGMENT, max(1, n))
    s = -(-n // length)
    e = np.ones((s * length, k))
    e[:n] = np.exp(scores - scores.max(1, keepdims=True))
    new = np.ones(s * length, bool)
    new[:n] = first
    new[0] |= begins
    e, new = e.reshape(s, length, k).transpose(1, 0, 2).copy(), new.reshape(s, length).T.copy()
    move, start = np.exp(model.move), np.exp(model.start)
    whole = np.broadcast_to(np.eye(k), (s, k, k)).copy()
    for t in range(length):
        whole = np.where(new[t][:, None, None], whole.sum(2, keepdims=True) * start, whole @ move) * e[t][:, None, :]
        whole /= whole.sum((1, 2), keepdims=True)
    return e, new, whole


def transfer(scores: np.ndarray, first: np.ndarray, model: Crf, begins: bool) -> np.ndarray:
    """The transfer matrix over all words, up to a factor; words that aren't at the end of their text must fill whole segments."""
    out = np.eye(len(model.langs))
    for part in _segments(scores, first, model, begins)[2]:
        out = out @ part
        out /= out.sum()
    return out


def forward_backward(scores: np.ndarray, first: np.ndarray, model: Crf, pairs: bool = False, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Exact label marginals of every word, and the expected transitions if asked for. ``first`` marks each text's first word.

    All texts form one sequence whose chain restarts at each first word. It is cut into segments whose transfer matrices are multiplied
    in parallel; a scan over the segments gives the messages at their ends, so the result doesn't depend on the cut. ``before`` and ``after``
    are the messages at both ends where the words are the middle of a text.
    """
    n, k = scores.shape
    e, new, whole = _segments(scores, first, model, before is None)
    length, s = new.shape
    move, start = np.exp(model.move), np.exp(model.start)
    alpha_in, beta_out = np.full((s, k), 1 / k), np.full((s, k), 1 / k)
    if before is not None:
        alpha_in[0] = before
    if after is not None:
        beta_out[-1] = after
    for i in range(s - 1):
        a = alpha_in[i] @ whole[i]
        alpha_in[i + 1] = a / a.sum()
    for i in range(s - 1, 0, -1):
        b = whole[i] @ beta_out[i]
        beta_out[i - 1] = b / b.sum()
    alpha, a = np.empty((length, s, k)), alpha_in
    for t in range(length):
        a = np.where(new[t][:, None], a.sum(1, keepdims=True) * start, a @ move) * e[t]
        a = a / a.sum(1, keepdims=True)
        alpha[t] = a
    gamma, b = np.empty((length, s, k)), beta_out
    total = np.zeros((k, k)) if pairs else None
    for t in range(length - 1, -1, -1):
        g = alpha[t] * b
        gamma[t] = g / g.sum(1, keepdims=True)
        eb = e[t] * b
        if pairs:
            earlier = alpha[t - 1] if t else alpha_in
            joint = earlier[:, :, None] * move * eb[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            total += joint[~new[t]].sum(0)
        b = np.where(new[t][:, None], 1 / k, eb @ move.T)
        b = b / b.sum(1, keepdims=True)
    return gamma.transpose(1, 0, 2).reshape(s * length, k)[:n], total


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of stretches ``begin`` to ``begin + size``."""
    return np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _evidence(seen: np.ndarray, of: np.ndarray, codes: np.ndarray, begin: np.ndarray, text_no: np.ndarray, texts: int) -> np.ndarray:
    """For each text the mean, over its words, of the share of a word's n-grams that are among those seen; 0 without words."""
    share = np.add.reduceat(seen[codes], begin, dtype=np.int64) / np.diff(np.append(begin, len(codes)))
    return np.bincount(text_no, share[of], texts) / np.maximum(np.bincount(text_no, minlength=texts), 1)


def fitted(texts: list[str], labels: list[str], rounds: int = 60, seed: int = 5) -> Crf:
    """A CRF fitted to labelled texts by Adam on the exact likelihood; half of the sequences are made code-switched from pieces of the texts.

    Words that occur three times or more in the texts form the lexicon.
    """
    langs = sorted(set(labels))
    k, rng = len(langs), np.random.default_rng(seed)
    model = Crf(langs, np.zeros((GRAMS, k), np.float32), np.zeros(0, np.uint64), np.zeros((0, k), np.float32), np.zeros(k), np.zeros((k, k)))
    column = pc.utf8_lower(pa.array(texts, pa.string()))
    raw = [x.as_py().encode() for x in column]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    starts, ends, text_no = words(data, offsets, LETTER)
    if not len(starts):
        return model
    kinds, of, codes, begin = word_types(data, starts, ends)
    counts = np.bincount(of)
    listed = np.flatnonzero(counts >= 3)
    model.lexicon, model.entries = kinds[listed], np.zeros((len(listed), k), np.float32)
    y_all, edge = np.array([langs.index(x) for x in labels])[text_no], bounds(text_no, len(texts))
    # of each text's n-grams, those that another text has too
    grams_of = np.repeat(np.arange(len(kinds)), np.diff(np.append(begin, len(codes))))
    in_text = np.unique(text_no * len(kinds) + of)
    of_text, kind = np.divmod(in_text, len(kinds))
    many = np.bincount(np.unique(np.repeat(of_text, np.bincount(grams_of)[kind]) * GRAMS + codes[_ranges(begin[kind], np.bincount(grams_of)[kind])]) % GRAMS, minlength=GRAMS)
    model.seen = many > 0
    model.usual = float(np.median([x for x in _evidence(many > 1, of, codes, begin, text_no, len(texts)) if x > 0] or [0.0]))
    order, first, pieces = [], [], []
    for i in range(len(texts)):
        own = np.arange(edge[i], edge[i + 1])
        if not len(own):
            continue
        order.append(own)
        first.append(np.arange(len(own)) == 0)
        at = 0
        while at < len(own):
            size = int(rng.integers(6, 40))
            pieces.append(own[at : at + size])
            at += size
    rng.shuffle(pieces)
    for i, piece in enumerate(pieces):
        order.append(piece)
        first.append((np.arange(len(piece)) == 0) & (i % 4 == 0))
    order, first = np.concatenate(order), np.concatenate(first)
    y, of = y_all[order], of[order]
    truth = np.zeros((len(y), k))
    truth[np.arange(len(y)), y] = 1
    seen_moves = np.zeros((k, k))
    np.add.at(seen_moves, (y[:-1][~first[1:]], y[1:][~first[1:]]), 1)
    seen_start = truth[first].sum(0)
    params = {"grams": model.grams, "entries": model.entries, "start": model.start, "move": model.move}
    m, v = {p: np.zeros(x.shape) for p, x in params.items()}, {p: np.zeros(x.shape) for p, x in params.items()}
    n = len(y)
    for step in range(1, rounds + 1):
        gamma, moves = forward_backward(emissions(model, kinds, codes, begin)[of], first, model, True)
        by_kind = np.stack([np.bincount(of, truth[:, c] - gamma[:, c], len(kinds)) for c in range(k)], 1)
        grads = {
            "grams": np.stack([np.bincount(codes, by_kind[grams_of, c], GRAMS) for c in range(k)], 1), "entries": by_kind[listed],
            "start": seen_start - gamma[first].sum(0), "move": seen_moves - moves,
        }
        for p, x in params.items():
            g = grads[p] / n - 1e-6 * x
            m[p] = 0.9 * m[p] + 0.1 * g
            v[p] = 0.99 * v[p] + 0.01 * g * g
            x += (0.1 * (m[p] / (1 - 0.9**step)) / (np.sqrt(v[p] / (1 - 0.99**step)) + 1e-9)).astype(x.dtype)
    return model


def held_out() -> Column:
    """Whether crc32 of the doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_lang: int = 150, window: int = 600, total: int = 9600) -> pd.DataFrame:
    """A bounded sample of labelled training rows of every language: ``per_lang`` windows of ``window`` characters of each, or as many as ``total`` allows, one at least.

    Rows are drawn by the hash of their id at a rate set by their language's count, so that the draw is spread over all rows and reruns agree;
    a window's place in its text is hashed too. Rows whose crc32 remainder is 2, and rows without text, lang or id, are never read. The driver
    holds a row a language and the sample: ``total`` windows, or one a language where there are more languages. The model has a quarter of a
    megabyte for each language, of any number.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    counts = settled(rows.groupBy("lang").count(), "langcounts")
    languages = counts.count()
    if not languages:
        return pd.DataFrame({"lang": [], "text": []})
    per = max(1, min(per_lang, total // languages))
    u = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    begin = (F.pmod(F.xxhash64("doc_id", F.lit("window")), F.greatest(F.length("text") - window, F.lit(1))) + 1).cast("int")
    # the draw holds 1.5 times as many rows of each language on average, and all of a rare one, so ranks are of small groups
    often = rows.join(F.broadcast(counts), "lang").where(u < F.when(F.col("count") <= 20 * per, 1.0).otherwise(1.5 * per / F.col("count")))  # a row a language
    drawn = often.select("lang", F.substring("text", begin, F.lit(window)).alias("text"), u.alias("u"), "doc_id")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id"))
    return drawn.withColumn("place", place).where(F.col("place") <= per).toPandas().sort_values(["lang", "u", "doc_id"])[["lang", "text"]]


def fit(docs: DataFrame, per_lang: int = 150) -> Crf | None:
    """A CRF fitted on :func:`sample`; none if no row is labelled."""
    rows = sample(docs, per_lang)
    return fitted(rows["text"].tolist(), rows["lang"].tolist()) if len(rows) else None


def _slices(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds in bytes of the parts in which a long text is labelled, about ``STEP`` bytes each: whole words, and all but the last fill whole segments."""
    at, size = 0, STEP
    while at + size < len(data):
        _, ends, _ = words(data[at : at + size], np.array([0, size]), LETTER)
        full = (len(ends) - 1) // SEGMENT * SEGMENT  # the last word may go on
        if full > 0:
            yield at, at + int(ends[full - 1])
            at, size = at + int(ends[full - 1]), STEP
        else:
            size *= 2
    yield at, len(data)


def _marginals(model: Crf, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(label marginals, text number, evidence) of all words of some texts, in order; a single text longer than ``STEP`` is labelled in parts.

    A long text's parts are first passed for their transfer matrices, which give the messages at their ends, and then labelled one by one.
    """
    parts = [(0, len(data))] if len(offsets) > 2 or len(data) <= STEP else list(_slices(data))

    def read(n: int) -> tuple[np.ndarray, ...] | None:
        low, high = parts[n]
        starts, ends, text_no = words(data[low:high], offsets if len(parts) == 1 else np.array([0, high - low]), LETTER)
        if not len(starts):
            return None
        kinds, of, codes, begin = word_types(data[low:high], starts, ends)
        first = np.append(n == 0, text_no[1:] != text_no[:-1])
        known = np.add.reduceat(model.seen[codes], begin, dtype=np.int64) / np.diff(np.append(begin, len(codes))) if model.seen is not None else np.zeros(len(kinds))
        return emissions(model, kinds, codes, begin)[of], first, text_no, known[of]

    k = len(model.langs)
    before, after = [None] * len(parts), [None] * len(parts)
    if len(parts) > 1:
        across = [transfer(*found[:2], model, n == 0) if (found := read(n)) else np.eye(k) for n in range(len(parts))]
        for n in range(1, len(parts)):
            message = (before[n - 1] if n > 1 else np.full(k, 1 / k)) @ across[n - 1]
            before[n] = message / message.sum()
        for n in range(len(parts) - 1, 0, -1):
            message = across[n] @ (after[n] if n < len(parts) - 1 else np.full(k, 1 / k))
            after[n - 1] = message / message.sum()
    for n in range(len(parts)):
        if found := read(n):
            scores, first, text_no, known = found
            yield forward_backward(scores, first, model, before=before[n], after=after[n])[0], text_no, known


def _label(batches: Iterator[pa.RecordBatch], shared: Broadcast, spans: bool, evidence: bool) -> Iterator[pa.RecordBatch]:
    model: Crf = shared.value
    for rows, _, _ in steps(batches, most=STEP):
        lowered = pc.utf8_lower(pc.fill_null(rows.column("text"), "").cast(pa.large_string()))
        offsets = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + rows.num_rows + 1]
        body = lowered.buffers()[2]
        data = (np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        lang, score = np.full(rows.num_rows, "und", object), np.zeros(rows.num_rows)
        total, n, known = np.zeros((rows.num_rows, len(model.langs))), np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows)
        found: list[list[dict]] = [[] for _ in range(rows.num_rows)]
        for gamma, text_no, seen in _marginals(model, data, offsets):
            edge = bounds(text_no, rows.num_rows)
            if spans:
                best = gamma.argmax(1)
                cut = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (text_no[1:] != text_no[:-1])))
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(best)], strict=True):
                    i = int(text_no[a])
                    first, p = int(n[i]) + a - int(edge[i]), float(gamma[a:b, best[a]].sum())
                    if found[i] and found[i][-1]["end_word"] == first and found[i][-1]["lang"] == model.langs[best[a]]:  # it goes on from the part before
                        found[i][-1]["end_word"], found[i][-1]["p"] = first + b - a, found[i][-1]["p"] + p
                    else:
                        found[i].append({"first_word": first, "end_word": first + b - a, "lang": model.langs[best[a]], "p": p})
            full = np.flatnonzero(np.diff(edge))
            total[full] += np.add.reduceat(gamma, edge[full], axis=0)
            n += np.diff(edge)
            known += np.bincount(text_no, seen, rows.num_rows)
        full = np.flatnonzero(n)
        if len(full):
            share = total[full] / n[full, None]
            lang[full] = np.array(model.langs, object)[share.argmax(1)]
            score[full] = np.clip(share.max(1), 0, 1)
            ascii_letter = np.add.reduceat((data >= 97) & (data < 123), offsets[:-1][full])
            for i in full[ascii_letter == 0].tolist():  # nothing but characters beyond ASCII: are there letters among them?
                if not any(map(str.isalpha, lowered[i].as_py())):
                    lang[i], score[i], found[i] = "und", 0.0, []
        arrays = {**{c: rows.column(c) for c in rows.schema.names}, "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score)}
        if spans:
            for one in (x for row in found for x in row):
                one["p"] /= one["end_word"] - one["first_word"]
            arrays["spans"] = pa.array(found, pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("lang", pa.string()), ("p", pa.float64())])))
        if evidence:
            arrays["evidence"] = pa.array((known + PRIOR_WORDS * model.usual) / (n + PRIOR_WORDS))
        yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


def labelled(docs: DataFrame, model: Crf | None, spans: bool = False, evidence: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score (the language's share of the words' summed marginals) and, if asked for, spans of words of one language and evidence.

    evidence is the mean share of a word's n-grams that the learned texts have too, as though ``PRIOR_WORDS`` usual words stood before the text.
    Whole texts are read; a long one is labelled in parts with the messages carried over, which gives the same marginals. lang_pred is
    ``und`` with score 0 if the text is null or has no letter, or if there is no model. Columns of ``docs`` with the new names are
    replaced; repeated rows are answered one by one; an empty table gives no rows. Nothing is shuffled.
    """
    new = {"lang_pred": "string", "score": "double"} | ({"spans": "array<struct<first_word: bigint, end_word: bigint, lang: string, p: double>>"} if spans else {}) | ({"evidence": "double"} if evidence else {})
    own = docs.drop(*new)
    if model is None:
        nothing = {"lang_pred": F.lit("und"), "score": F.lit(0.0), "spans": F.array(), "evidence": F.lit(0.0)}
        return own.withColumns({c: nothing[c].cast(kind) for c, kind in new.items()})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by GRAMS, the sample's bound and the number of languages
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema] + [f"{c} {kind}" for c, kind in new.items()]
    return own.mapInArrow(partial(_label, shared=shared, spans=spans, evidence=evidence), ", ".join(kinds))


def identified(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """``docs`` in the learned languages: texts without a letter go, and those whose evidence is under ``least`` of the usual.

    Texts of several learned languages stay. How much evidence is usual is measured on the learned texts, each against the others, so the
    bound depends neither on the number of languages nor on their names. With no labelled row nothing is known and no row stays.
    """
    model = fit(docs)
    # the model's columns take the names that labelled gives them; the caller's go by others meanwhile
    mine = ("lang_pred", "score", "evidence")
    names = [f"own_{k}" if c.lower() in mine or "." in c or "`" in c else c for k, c in enumerate(docs.columns)]
    names = [n if n == c else free_names(docs, n)[0] for n, c in zip(names, docs.columns, strict=True)]
    found = labelled(docs.toDF(*names), model, evidence=True).where((F.col("lang_pred") != "und") & (F.col("evidence") >= least * (model.usual if model else 0.0)))
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
