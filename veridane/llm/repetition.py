"""Quality rules from a suffix array: how much of a text is repeated, and the longest repeat.

The words of a batch of documents become numbers; one suffix array over all of
them is built by prefix doubling on arrays, with LCPs limited to a document.
LCP intervals of at least ``min_repeat`` words are its maximal repeated
substrings; the union of their spans gives the covered fraction, the largest LCP
the longest repeat. A text is kept if neither passes its limit.

The same array gives the base rule's repeated three-word windows (LCP >= 3).

Edge cases: a null text has no words; an empty table gives an empty result;
equal rows give equal results; a text without repeats has covered fraction 0; of
equal repeats each place counts; other columns, whatever their names, are left out
of the query and kept as they are by `keep_good`.
Memory follows the words of a slice of ``batch_words`` or of the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veridane.llm.bpe_speculative import column, slices

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
_OTHERS = bytes(b for b in range(256) if b not in SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))

#: Limits of the method's verdict.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 5, 0.3, 50


def suffix_ranks(words: np.ndarray, doc: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling: the order of all suffixes, and each level's ranks.

    words: numbers from 1; doc: document of each word; left: words from here to the document's end.
    Ranks of level k compare 2**k words; suffixes that end before are smaller and differ between documents only in their words.
    """
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    levels, step = [rank], 1
    longest = int(left.max(initial=0))
    while step < longest:
        second = np.zeros(n, np.int64)
        has = left > step
        at = np.flatnonzero(has)
        second[at] = rank[at + step]
        key = rank * (n + 1) + second
        values, new = np.unique(key, return_inverse=True)
        rank = new.astype(np.int64) + 1
        levels.append(rank)
        step *= 2
        # Repeats across and within documents alike: stop as soon as no two suffixes of one document share a rank.
        mixed = doc * np.int64(n + 2) + rank
        ordered = np.sort(mixed)
        if not (ordered[1:] == ordered[:-1]).any():
            break
    order = np.lexsort((rank, doc))
    return order, levels


def neighbour_lcp(order: np.ndarray, doc: np.ndarray, left: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP of each suffix in order with the one before it, 0 at a document's first."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    a, b = order[:-1].copy(), order[1:].copy()
    at = np.flatnonzero(doc[a] == doc[b])
    a, b = a[at], b[at]
    got = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        room = (left[a] - got >= step) & (left[b] - got >= step)
        i = np.flatnonzero(room)
        same = levels[k][a[i] + got[i]] == levels[k][b[i] + got[i]]
        got[i[same]] += step
        if k == len(levels) - 1:  # the last level may repeat within a document that ends there
            while True:
                i = i[same]
                i = i[(left[a[i]] - got[i] >= step) & (left[b[i]] - got[i] >= step)]
                if not len(i):
                    break
                same = levels[k][a[i] + got[i]] == levels[k][b[i] + got[i]]
                got[i[same]] += step
    lcp[1:][at] = got
    return lcp


def reach(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each position: words of the longest substring from there that occurs twice in its document."""
    best = lcp.copy()
    best[:-1] = np.maximum(best[:-1], lcp[1:])
    out = np.zeros(len(order), np.int64)
    out[order] = best
    return out


def covered(length: np.ndarray, least: int) -> np.ndarray:
    """Words inside the union of spans [i, i + length[i]) with length >= least."""
    n = len(length)
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(length >= least)
    np.add.at(change, at, 1)
    np.add.at(change, at + length[at], -1)
    return np.cumsum(change[:n]) > 0


def measure(texts: list[str | None], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """Counts of each text: words, characters in words, symbols, repeated lines, repeated windows, covered words, longest repeat."""
    raws = [(t or "").encode() for t in texts]
    tokens = [r.split() for r in raws]
    counts = np.array([len(x) for x in tokens], np.int64)
    flat = [w for x in tokens for w in x]
    n = len(flat)
    words = pd.factorize(np.array(flat, object))[0].astype(np.int64) + 1 if n else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)
    order, levels = suffix_ranks(words, doc, left)
    length = reach(order, neighbour_lcp(order, doc, left, levels))
    # A window's three words, not the whole repeat, are what the base rule counts; the unions are equal.
    repeat_words = np.bincount(doc[covered(length, 3)], minlength=len(texts))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, length)
    dup_lines = np.zeros(len(texts), np.int64)
    for i, raw in enumerate(raws):
        lines = [x for x in raw.split(b"\n") if x.strip()]
        dup_lines[i] = len(lines) - len(set(lines))
    return {
        "n_words": counts,
        "word_chars": np.array([len("".join(x.translate(None, _CONTINUATION).decode("latin-1") for x in [b"".join(t)])) for t in tokens], np.int64),
        "n_symbols": np.array([len(r.translate(None, _OTHERS)) for r in raws], np.int64),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words.astype(np.int64),
        "n_covered": np.bincount(doc[covered(length, min_repeat)], minlength=len(texts)).astype(np.int64),
        "longest_repeat": longest,
    }


def batches_of(texts: list[str | None], batch_chars: int) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= batch_chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def verdicts(m: dict[str, np.ndarray], max_covered: float, max_longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of each text."""
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return failed, ~failed & (m["n_covered"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_longest)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, batch_chars: int = 1 << 20) -> DataFrame:
    """A row for each document with its counts and both verdicts. One narrow pass, no shuffle."""
    names = f"{id_col} long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (y for x in batches for y in slices(x, text_col)):
            texts, ids = column(batch, text_col).to_pylist(), column(batch, id_col).cast(pa.int64())
            for a, b in batches_of(texts, batch_chars):
                m = measure(texts[a:b], min_repeat)
                failed, kept = verdicts(m, max_covered, max_longest)
                yield pa.RecordBatch.from_arrays([ids[a:b], *[pa.array(m[c], pa.int64()) for c in COUNTS], pa.array(failed), pa.array(kept)], names=[id_col, *COUNTS, "base_failed", "kept"])

    return docs.select(id_col, text_col).mapInArrow(run, names)


def keep_good(docs: DataFrame, text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, batch_chars: int = 1 << 20) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (y for x in batches for y in slices(x, text_col)):
            texts = column(batch, text_col).to_pylist()
            for a, b in batches_of(texts, batch_chars):
                kept = verdicts(measure(texts[a:b], min_repeat), max_covered, max_longest)[1]
                yield batch.slice(a, b - a).filter(pa.array(kept))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
