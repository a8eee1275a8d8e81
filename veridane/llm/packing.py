"""Cost-balanced packing of documents into training sequences.

A document's ids are followed by an end id. Full sequences are cut off its
front; what is left of it (less than a sequence) is packed with the tails of
other documents: in descending order of length each goes to the sequence of
lowest estimated cost, linear plus quadratic in the length of its pieces, that
has room for it. If none has room, the piece is cut where the emptiest sequence
is full and the rest is queued again by its length. There are only as many
sequences as the tokens of a block need, so a block pads less than one sequence.

Packing is local to a block of about ``block_tokens`` tokens of one Spark task:
no shuffle, no state between tasks, memory bounded by the block and the longest
document. A sequence's number holds its task's partition number in the upper
bits; a task that is run again makes the same numbers.

Edge cases: a null or empty text is a document of its end id alone; an empty table
gives an empty result; rows that repeat, also with the same id, are packed each; a
null id stays null; texts of any length are cut into full sequences and a tail; of
equal lengths the document read first is placed first, of equal costs the sequence
of the smaller number is taken; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from veridane.llm.bpe_speculative import coder, column, resolve, slices

#: Runs that the fast library handles badly are encoded by bpe_speculative, which gives the same ids.
RUN = re.compile(r"\S{8192}|\s{8192}")


@functools.cache
def rank_encoder(path: str):
    """The vocabulary as tiktoken ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def token_ids(text: str, vocabulary: str, ranks: str) -> np.ndarray:
    """Ids as the tokenizers library gives them for `vocabulary`, special strings handled as its default."""
    if not text:
        return np.zeros(0, "<u4")
    if len(text) >= 8192 and RUN.search(text):
        return next(iter(coder(resolve(vocabulary)).encode_batch([text]))).astype("<u4")
    return rank_encoder(resolve(ranks)).encode_to_numpy(text, allowed_special="all").astype("<u4")


def pieces_of(total: int, size: int) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
    """(start, length) of the full pieces, and of the tail."""
    full = [(k, size) for k in range(0, total - size + 1, size)]
    rest = total % size
    return full, (total - rest, rest) if rest else None


class Room:
    """Sequences by remaining room, each room's in a heap by cost; the cheapest one with enough room in O(log size)."""

    def __init__(self, size: int, count: int):
        self.width = 1 << size.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(size + 1)]
        self.best: list[tuple[float, int] | None] = [None] * (2 * self.width)
        self.heaps[size] = [(0.0, k) for k in range(count)]
        self._update(size)

    def _update(self, room: int) -> None:
        at = room + self.width
        self.best[at] = self.heaps[room][0] if self.heaps[room] else None
        while at > 1:
            at //= 2
            a, b = self.best[2 * at], self.best[2 * at + 1]
            self.best[at] = b if a is None else a if b is None or a <= b else b

    def cheapest(self, least: int) -> int | None:
        """The room of the cheapest sequence with at least so much room."""
        low, high, found = least + self.width, 2 * self.width, None
        while low < high:
            for take, node in ((low & 1, low), (high & 1, high - 1)):
                if take and self.best[node] is not None and (found is None or self.best[node] < found[0]):
                    found = (self.best[node], node)
            low, high = (low + 1) // 2, high // 2
        if found is None:
            return None
        node = found[1]
        while node < self.width:
            node = 2 * node if self.best[2 * node] == found[0] else 2 * node + 1
        return node - self.width

    def emptiest(self) -> int:
        node = 1
        while node < self.width:
            node = 2 * node + 1 if self.best[2 * node + 1] is not None else 2 * node
        return node - self.width

    def take(self, room: int) -> tuple[float, int]:
        out = heapq.heappop(self.heaps[room])
        self._update(room)
        return out

    def put(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self._update(room)


def pack_tails(lengths: list[int], size: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(item, start in the item, length, sequence, offset) of each piece; number of sequences."""
    count = -(-sum(lengths) // size)
    room = Room(size, count)
    queue = [(-n, k, 0) for k, n in enumerate(lengths)]
    heapq.heapify(queue)
    out = []
    while queue:
        n, k, start = heapq.heappop(queue)
        n = -n
        free = room.cheapest(n)
        if free is None:
            free = room.emptiest()
        cost, sequence = room.take(free)
        part = min(n, free)
        out.append((k, start, part, sequence, size - free))
        if free > part:
            room.put(free - part, cost + linear * part + quadratic * part * part, sequence)
        if n > part:
            heapq.heappush(queue, (part - n, k, start + part))
    return out, count


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", block_tokens: int = 1 << 21, linear: float = 1.0, quadratic: float = 1 / 2048, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence of at most `size` tokens."""
    fields = [(id_col, pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    names = f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        names += ", ids array<int>"
    kind = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 40, 0
        rows: dict[str, list] = {name: [] for name, _ in fields}
        tails: list[tuple[int | None, int, int, np.ndarray]] = []  # id, tokens of the document, start, ids
        held = 0

        def add(key: int | None, start: int, ids: np.ndarray, total: int, sequence: int, offset: int) -> None:
            raw = ids.tobytes()
            for name, value in zip(rows, (key, start, len(ids), zlib.crc32(raw), total, task + sequence, offset, ids.astype(np.int32)), strict=False):
                rows[name].append(value)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, tails, held, made
            placed, count = pack_tails([len(x[3]) for x in tails], size, linear, quadratic)
            for k, start, n, sequence, offset in placed:
                key, total, first, ids = tails[k]
                add(key, first + start, ids[start : start + n], total, made + sequence, offset)
            made += count
            tails, held = [], 0
            if rows[id_col]:
                yield pa.RecordBatch.from_pydict(rows, schema=kind)
            rows = {name: [] for name, _ in fields}

        for batch in (y for x in batches for y in slices(x, text_col)):
            for key, text in zip(column(batch, id_col).to_pylist(), column(batch, text_col).to_pylist(), strict=True):
                ids = np.append(token_ids(text or "", vocabulary, ranks), np.array([end_id], "<u4"))
                full, tail = pieces_of(len(ids), size)
                for start, n in full:
                    add(key, start, ids[start : start + n], len(ids), made, 0)
                    made += 1
                if tail:
                    tails.append((key, len(ids), tail[0], ids[tail[0] :].copy()))
                held += len(ids)
                if held >= block_tokens:
                    yield from flush()
        yield from flush()

    return docs.select(id_col, text_col).mapInArrow(run, names)
