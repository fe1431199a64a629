"""Token counts of whole texts: pieces between safe boundaries are encoded in batches inside Arrow functions, and only lengths come back."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.bytewords import strings
from framelake.llm.shared import steps

#: Bytes of pieces that the library encodes at once; what it returns for them is dropped but for the lengths.
BATCH_BYTES = 1 << 18
#: Text bytes of one step: the more, the more often a piece repeats within it.
STEP = 8 << 20
#: Lengths that a worker remembers, some 60 MB.
REMEMBERED = 1 << 19

WHITE = np.zeros(256, bool)
WHITE[9:14] = WHITE[32] = True
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True


def white_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space characters of Unicode."""
    white = WHITE[data]
    if len(data) > 1:
        two = np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0)))
        white[two] = white[two + 1] = True
    if len(data) > 2:
        a, b, c = data[:-2], data[1:-1], data[2:]
        general = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
        three = np.flatnonzero((a == 0xE2) & general | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80))
        white[three] = white[three + 1] = white[three + 2] = True
    return white


def cuts(data: np.ndarray, offsets: np.ndarray, plain: bool) -> np.ndarray:
    """Places of single white space between two other characters of one text, where a text may be cut without changing its tokens.

    ``plain`` asks for a blank between ASCII letters or digits.
    """
    if len(data) < 3:
        return np.zeros(0, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if plain:
        here = (data[1:-1] == 32) & ALNUM[data[:-2]] & ALNUM[data[2:]]
    else:
        white = white_bytes(data)
        here = WHITE[data[1:-1]] & ~white[:-2] & ~white[2:]
    return np.flatnonzero(here & ~edge[1:-2] & ~edge[2:-1]) + 1


def _splits_at_blanks(settings: dict) -> bool:
    """Whether the pre-tokenizer never has a token over white space and the word after it, but for one leading blank."""
    before = settings.get("pre_tokenizer") or {}
    parts = before.get("pretokenizers", [before])
    patterns = [p for p in parts if p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert")]
    byte_level = [p for p in parts if p.get("type") == "ByteLevel" and p.get("use_regex") and not p.get("add_prefix_space")]
    return (settings.get("normalizer") or {}).get("type") != "Prepend" and bool(patterns or byte_level)


def _counter(kind: str, content: bytes) -> tuple[Callable[[list[str]], list[int]], str]:
    """A function from texts to their numbers of tokens, and where texts may be cut for it: ``white``, ``plain`` or ``never``."""
    if kind == ".json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], "white" if _splits_at_blanks(json.loads(content)) else "never"
    if kind != ".model":
        raise ValueError(f"{kind}: a tokenizer is a .json or .model file")
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_proto=content)
    # a cut drops its blank, as the library puts one before each text; no piece may have a blank within
    safe = len(pieces.encode("a")) == len(pieces.encode(" a")) - 1 or pieces.id_to_piece(pieces.encode("a"))[0].startswith("▁")
    safe = safe and not any("▁" in pieces.id_to_piece(i).lstrip("▁") for i in range(pieces.get_piece_size()))
    return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)], "plain" if safe else "never"


def _by_bytes(pieces: list[str], most: int) -> Iterator[list[str]]:
    """The pieces in batches of about ``most`` bytes."""
    sizes = np.cumsum([len(p) for p in pieces])
    first = 0
    while first < len(pieces):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + most, "right")))
        yield pieces[first:last]
        first = last


def _counted(batches: Iterator[pa.RecordBatch], kind: str, content: Broadcast) -> Iterator[pa.RecordBatch]:
    count, where = _counter(kind, content.value)
    known: dict[str, int] = {}
    for rows, data, offsets in steps(batches, most=STEP):
        cut = np.zeros(0, np.int64) if where == "never" else cuts(data, offsets, where == "plain")
        starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], cut)
        of_text = np.searchsorted(starts, offsets)
        ends = np.append(starts[1:], len(data))
        if where == "plain" and len(cut):
            keep = np.ones(len(data), bool)
            keep[cut] = False
            sizes = ends - starts - np.isin(starts, cut, assume_unique=True)
            pieces = strings(data[keep], np.concatenate([[0], np.cumsum(sizes)]))
        else:
            pieces = strings(data, np.append(starts, len(data)) if len(starts) else np.zeros(1, np.int64))
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(known) > REMEMBERED:
            known.clear()
        for part in _by_bytes([p for p in distinct if p not in known], BATCH_BYTES):
            known.update(zip(part, count(part), strict=True))
        lengths = np.array([known[p] for p in distinct], np.int64)[coded.indices.to_numpy()] if distinct else np.zeros(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        arrays = {**{c: rows.column(c) for c in rows.schema.names if c != "text"}, "n_bytes": pa.array(np.diff(offsets)), "n_tokens": pa.array(np.diff(sums[of_text]))}
        yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    ``tokenizer`` is the path of a ``.json`` file (library tokenizers) or a ``.model`` file (sentencepiece) on the driver; its few megabytes are
    broadcast, so executors need no such file. No special tokens are added, special strings within a text are handled as the library does, nothing
    is truncated or padded. Texts are cut at single white space between two other characters where the file's rules allow it, which changes no
    token; each distinct piece of a step is encoded once, in batches of about ``BATCH_BYTES``, and pieces' lengths are summed by text. Files whose
    rules don't allow cuts encode whole texts.

    A null or empty text has no bytes and no tokens; repeated rows are answered one by one, an empty table gives no rows; other columns, whatever
    their names, are left out. A worker holds one step of texts, or one longer text.
    """
    path = Path(tokenizer)
    content = docs.sparkSession.sparkContext.broadcast(path.read_bytes())
    rows = docs.select("doc_id", "text")
    counted = rows.mapInArrow(partial(_counted, kind=path.suffix, content=content), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
