"""Token counts of whole documents, huge ones by overlap resynchronisation.

Documents up to ``chunk_chars`` are encoded in batches. A larger one is encoded
as chunks that overlap, with offsets, and the chunks' tokens are spliced at a
stable common boundary: a place q < p inside the overlap where

* both chunks have a token boundary at ASCII white space (the vocabulary's
  normaliser composes, folds and replaces nothing across it and its split rule
  drops it, so what stands on one side can't change the tokens on the other),
* between two such places both chunks have the same tokens at the same offsets.

Without such a place the overlap is doubled, at last to the document's end, so
a count never rests on an unproven splice. Memory: one chunk's encoding.

Edge cases: null text is empty (0 bytes, 0 tokens); an empty table gives an empty
result; special strings in texts are handled as the library's default does;
repeated rows are counted each, also with null ids; of equally good splices the
last is taken, which changes no count; other columns, whatever their names, are
left out.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from veridane.llm.bpe_speculative import column, resolve, slices

ASCII_SPACE = frozenset("\t\n\v\f\r ")


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def lowered(path: str):
    """The same without its normaliser, for plain texts that are lower-cased already."""
    from tokenizers import normalizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = tokenizer.__wrapped__(path)
    tok.normalizer = normalizers.Sequence([])
    return tok


def is_plain(text: str) -> bool:
    """Latin-1 without a special string: it holds no combining marks, so composition changes nothing; each letter has one lower-case letter; white space is dropped anyway."""
    if "<|" in text:
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Chunk:
    """The encoding of text[at:stop]; offsets are looked up only where chunks meet."""

    def __init__(self, tok, plain_tok, text: str, at: int, stop: int):
        part = text[at:stop]
        plain = plain_tok is not None and is_plain(part)
        self.text, self.at, self.stop = text, at, stop
        self.encoding = (plain_tok if plain else tok).encode(part.lower() if plain else part, add_special_tokens=False)
        self.ids = self.encoding.ids

    def split(self, p: int) -> int | None:
        """Number of tokens before p, if all of them end there or before and the next begins at the first character that is no ASCII white space; else None."""
        first = p
        while first < self.stop and self.text[first] in ASCII_SPACE:
            first += 1
        if first >= self.stop:
            return None
        i = self.encoding.char_to_token(first - self.at)
        if i is None or self.encoding.token_to_chars(i)[0] != first - self.at:
            return None
        return i if i == 0 or self.encoding.token_to_chars(i - 1)[1] <= p - self.at else None


def splice(text: str, left: Chunk, right: Chunk, low: int, high: int, proof: int = 16) -> tuple[int, int] | None:
    """(tokens of left, tokens of right) before the last proven common boundary in (low, high), or None."""
    tops: list[tuple[int, int, int]] = []  # place, tokens before it in left, in right
    for p in range(high - 1, low, -1):
        if text[p] in ASCII_SPACE and text[p - 1] not in ASCII_SPACE:
            i, j = left.split(p), right.split(p)
            if i is None or j is None:
                continue
            for top, k, m in tops:
                if top - p >= proof and k > i and left.ids[i:k] == right.ids[j:m]:
                    return k, m
            tops = [*tops, (p, i, j)][:4]
    return None


def encode_huge(tok, text: str, chunk_chars: int, overlap_chars: int, plain_tok=None) -> Iterator[list[int]]:
    """Lists of ids that make up the encoding of the whole text, in order."""
    n, overlap, done = len(text), overlap_chars, 0  # done: tokens of left that are out already
    left = Chunk(tok, plain_tok, text, 0, min(n, chunk_chars + overlap))
    base = 0  # text before it is encoded and out
    while left.stop < n:
        begin = max(left.at, left.stop - overlap)
        right = Chunk(tok, plain_tok, text, begin, min(n, begin + chunk_chars + overlap))
        found = splice(text, left, right, max(begin, base), left.stop)
        if found is None or found[0] < done:  # widen: left reaches further, right begins earlier in it
            overlap *= 2
            stop = min(n, max(left.stop, left.at + chunk_chars) + overlap)
            left = Chunk(tok, plain_tok, text, left.at, stop)
            continue
        yield left.ids[done : found[0]]
        base = begin + right.encoding.token_to_chars(found[1])[0]
        left, done, overlap = right, found[1], overlap_chars
    yield left.ids[done:]


def count_tokens(tok, texts: list[str], chunk_chars: int = 1 << 15, overlap_chars: int = 512, batch_chars: int = 1 << 16, plain_tok=None) -> list[int]:
    """Number of tokens of each text. plain_tok: lowered(), which then takes the texts that are plain."""
    out = [0] * len(texts)
    waiting: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal waiting, held
        plain = [i for i in waiting if plain_tok is not None and is_plain(texts[i])]
        rest = [i for i in waiting if plain_tok is None or not is_plain(texts[i])]
        for which, use, own in ((plain, plain_tok, [texts[i].lower() for i in plain]), (rest, tok, [texts[i] for i in rest])):
            if which:
                for i, e in zip(which, use.encode_batch_fast(own, add_special_tokens=False), strict=True):
                    out[i] = len(e)
        waiting, held = [], 0

    for i, text in enumerate(texts):
        if len(text) > chunk_chars:
            out[i] = sum(map(len, encode_huge(tok, text, chunk_chars, overlap_chars, plain_tok)))
        elif text:
            waiting.append(i)
            held += len(text)
            if held >= batch_chars:
                flush()
    flush()
    return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", limit: int = 2048, chunk_chars: int = 1 << 15, overlap_chars: int = 512) -> DataFrame:
    """A row for each document: UTF-8 bytes, tokens, and whether it has more than `limit` tokens. One narrow pass, no shuffle."""
    kind = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, plain_tok = tokenizer(resolve(vocabulary)), lowered(resolve(vocabulary))
        for batch in (y for x in batches for y in slices(x, text_col)):
            raw = column(batch, text_col)
            counts = count_tokens(tok, [x or "" for x in raw.to_pylist()], chunk_chars, overlap_chars, plain_tok=plain_tok)
            n_bytes = pc.fill_null(pc.binary_length(raw), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, id_col).cast(pa.int64()), n_bytes, pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], schema=kind)

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean")
