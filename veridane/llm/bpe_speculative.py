"""BPE encoding and decoding by speculate and verify.

Encoding a batch of texts:

1. *Pre-tokenise* all texts of the batch as one array (``word_bpe_text``).
2. *Speculate*: at every byte the longest vocabulary token is found with a trie
   walked for all positions at once; following those lengths from each word's
   start gives a greedy proposal.
3. *Verify*: a proposal is the true encoding if and only if every adjacent pair
   of its tokens is compatible, that is, no merge rule would have joined a piece
   of the left token with a piece of the right one before either was complete.
   Pairs are tested in numpy and remembered in a fixed-size table.
4. *Repair*: only words with an incompatible pair are merged exactly, all words
   of one length at a time, rule by rule in rank order.

Memory is bounded by the window of text (``window_chars``), whatever a
document's length: long documents are cut before white space that follows other
text, where the split rule always has a boundary.

Edge cases: null text counts as empty and gives no tokens; an empty table gives an
empty result; of equal rules the leftmost pair is merged first; other columns of
the table, whatever their names, are left out; the special string
``<|endoftext|>`` gives its special id, as the tokenizers library does by
default, and is decoded as that string; repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from veridane.llm.word_bpe_text import SPACE, code_points, split_classes, utf8_lengths, word_starts

NONE = np.int64(1 << 40)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of this kind."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class SpeculativeBpe:
    """One vocabulary with its merge rules, and tables for proposals and checks."""

    def __init__(self, path: str, window_chars: int = 1 << 19, known_pairs: int = 1 << 21, known_words: int = 1 << 18):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.window_chars, self.known_words = window_chars, known_words
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        to_byte = byte_alphabet()
        self.token_bytes = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(to_byte[c] for c in token)
        self.decoded = list(self.token_bytes)
        for text, i in self.special.items():
            self.decoded[i] = text.encode()
        self.decoded_len = np.array([len(x) for x in self.decoded], np.int64)
        self.decoded_at = np.concatenate([[0], np.cumsum(self.decoded_len)])[:-1]
        self.decoded_flat = np.frombuffer(b"".join(self.decoded), np.uint8)
        self.byte_id = np.zeros(256, np.int64)
        for c, b in to_byte.items():
            self.byte_id[b] = vocab[c]
        # Each merged token: its two halves and the rank of its rule.
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        self.made = np.full(self.size, -1, np.int64)
        keys, ranks, joined = [], [], []
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if self.made[k] >= 0:
                raise ValueError("two merge rules make one token; pair checks need one rule for each")
            self.left[k], self.right[k], self.made[k] = i, j, rank
            keys.append(i << 20 | j)
            ranks.append(rank)
            joined.append(k)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        self.rank_token = np.array(joined, np.int64)
        self._pair_table()
        self._trie()
        self.known = np.full(known_pairs, -1, np.int64)
        self.words: dict[bytes, np.ndarray] = {}
        # Tokens that their own bytes do not lead to can't be trusted in a proposal.
        self.sound = np.ones(self.size, bool)
        merged = [i for i in range(self.size) if self.made[i] >= 0]
        for i, ids in zip(merged, self.merge_words([self.token_bytes[i] for i in merged]), strict=True):
            self.sound[i] = len(ids) == 1 and ids[0] == i

    # --- tables ---------------------------------------------------------

    def _pair_table(self) -> None:
        """Open addressing from pair key to rank: a gather or two instead of a binary search."""
        bits = max(4, int(len(self.pair_keys) * 4).bit_length())
        self.slot_bits = bits
        self.slot_keys, self.slot_ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        self.probes = 1
        for key, rank in zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), strict=True):
            at, steps = int(self._slot(np.array([key]))[0]), 1
            while self.slot_keys[at] >= 0:
                at, steps = (at + 1) & ((1 << bits) - 1), steps + 1
            self.slot_keys[at], self.slot_ranks[at] = key, rank
            self.probes = max(self.probes, steps)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the rule that joins a and b, or NONE."""
        keys = a << 20 | b
        at = self._slot(keys)
        out = np.where(self.slot_keys[at] == keys, self.slot_ranks[at], NONE)
        open_ = np.flatnonzero((self.slot_keys[at] != keys) & (self.slot_keys[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.slot_bits) - 1)
            found = self.slot_keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def _trie(self) -> None:
        """next[node * 256 + byte] is a node or 0; token[node] is the id that ends there, or -1."""
        nodes: dict[bytes, int] = {b"": 0}
        for token in self.token_bytes:
            for k in range(1, len(token) + 1):
                nodes.setdefault(token[:k], len(nodes))
        self.next = np.zeros(len(nodes) * 256, np.int32)
        for prefix, node in nodes.items():
            if node:
                self.next[nodes[prefix[:-1]] * 256 + prefix[-1]] = node
        self.node_token = np.full(len(nodes), -1, np.int32)
        for i, token in enumerate(self.token_bytes):
            if token:
                self.node_token[nodes[token]] = i

    # --- speculate ------------------------------------------------------

    def propose(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest-match tokens of all words: ids, and the byte at which each begins."""
        n = len(data)
        ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n))).astype(np.int32)
        node = self.next[data]
        best = self.node_token[node]
        length = np.ones(n, np.int32)
        at = np.arange(n, dtype=np.int32)
        depth = 1
        while len(at):
            inside = at + depth < ends[at]
            at, node = at[inside], node[inside]
            node = self.next[node.astype(np.int64) * 256 + data[at + depth]]
            alive = node > 0
            at, node = at[alive], node[alive]
            depth += 1
            token = self.node_token[node]
            whole = token >= 0
            best[at[whole]], length[at[whole]] = token[whole], depth
        first = followed(starts.astype(np.int64), np.append(starts[1:], n), length)
        return best[first].astype(np.int64), first

    # --- verify ---------------------------------------------------------

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of adjacent tokens: would exact merging leave this boundary in place?

        The later of the two tokens is undone again and again; at each step the
        pieces at the boundary existed together until the rank `limit`.
        """
        good = np.ones(len(a), bool)
        at, a, b, limit = np.arange(len(a)), a.copy(), b.copy(), np.full(len(a), NONE - 1)
        while len(at):
            bad = self.pair_rank(a, b) < limit
            good[at[bad]] = False
            go = ~bad & ((self.made[a] >= 0) | (self.made[b] >= 0))
            at, a, b = at[go], a[go], b[go]
            from_left = self.made[a] > self.made[b]
            # Of equal rules the leftmost is applied first: a tie counts against the boundary only on the right.
            limit = np.where(from_left, self.made[a], self.made[b] + 1)
            a = np.where(from_left, self.right[a], a)
            b = np.where(from_left, b, self.left[b])
        return good

    def checked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible(), through a table of fixed size that holds pairs seen lately."""
        keys = (a << 20 | b) << 1
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = (mixed % np.uint64(len(self.known))).astype(np.int64)
        held = self.known[at]
        good = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != keys >> 1)
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            found = self.compatible(fresh >> 21, (fresh >> 1) & 0xFFFFF)
            good[new] = found[back]
            self.known[at[new]] = keys[new] | found[back]
        return good

    # --- repair ---------------------------------------------------------

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging: the lowest rule first, of equal rules the leftmost."""
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) > 64:
                out[i] = self.merge_long(word)
            else:
                by_length.setdefault((len(word) + 3) // 4 * 4, []).append(i)
        for width, group in by_length.items():
            flat = np.zeros((len(group), width), np.int64)
            count = np.array([len(words[i]) for i in group])
            raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in group), np.uint8).reshape(len(group), width)
            flat[:] = self.byte_id[raw]
            rank = np.full((len(group), width), NONE, np.int64)
            if width > 1:
                rank[:, :-1] = self.pair_rank(flat[:, :-1].ravel(), flat[:, 1:].ravel()).reshape(len(group), -1)
            rank[np.arange(width) >= count[:, None] - 1] = NONE
            rows = np.arange(len(group))
            while len(rows):
                at = rank[rows].argmin(1)
                low = rank[rows, at]
                go = low < NONE
                rows, at, low = rows[go], at[go], low[go]
                if not len(rows):
                    break
                shift = np.arange(width)[None, :] + (np.arange(width)[None, :] > at[:, None])
                shift = np.minimum(shift, width - 1)
                ids, ranks = flat[rows[:, None], shift], rank[rows[:, None], shift]
                ids[np.arange(len(rows)), at] = self.rank_token[low]
                count[rows] -= 1
                ranks[:, -1] = NONE
                for side in (0, -1):  # the pairs beside the new token
                    i = at + side
                    ok = (i >= 0) & (i + 1 < count[rows])
                    j = np.clip(i, 0, width - 2)
                    new = self.pair_rank(ids[np.arange(len(rows)), j], ids[np.arange(len(rows)), j + 1])
                    at_all = np.flatnonzero(i >= 0)
                    ranks[at_all, np.minimum(i, width - 1)[at_all]] = np.where(ok, new, NONE)[at_all]
                flat[rows], rank[rows] = ids, ranks
            for k, i in enumerate(group):
                out[i] = flat[k, : count[k]].copy()
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same for one long word, with a heap of candidate pairs."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rule = {k: r for k, r in zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), strict=True)} if not hasattr(self, "_rule") else self._rule
        self._rule = rule
        heap = [(rule[k], i, ids[i], ids[i + 1]) for i in range(n - 1) if (k := ids[i] << 20 | ids[i + 1]) in rule]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.rank_token[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if (k := after[i]) >= 0 and (key := ids[i] << 20 | ids[k]) in rule:
                heapq.heappush(heap, (rule[key], i, ids[i], ids[k]))
            if (k := before[i]) >= 0 and (key := ids[k] << 20 | ids[i]) in rule:
                heapq.heappush(heap, (rule[key], k, ids[k], ids[i]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def repaired(self, words: list[bytes]) -> list[np.ndarray]:
        missing = [w for w in dict.fromkeys(words) if w not in self.words]
        if len(self.words) + len(missing) > self.known_words:
            self.words = {}
            missing = list(dict.fromkeys(words))
        found = dict(zip(missing, self.merge_words(missing), strict=True))
        out = [found[w] if w in found else self.words[w] for w in words]
        for w, ids in found.items():
            if len(w) <= 64 and len(self.words) < self.known_words:
                self.words[w] = ids
        return out

    # --- encode, decode ---------------------------------------------------

    def encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's number of ids. No special strings."""
        joined = "".join(texts)
        lengths = np.array([len(x) for x in texts], np.int64)
        if not joined:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        breaks = np.concatenate([[0], np.cumsum(lengths)])
        points = code_points(joined)
        byte_at = np.concatenate([[0], np.cumsum(utf8_lengths(points))])
        starts = byte_at[word_starts(points, breaks[:-1])]
        raw = joined.encode()
        data = np.frombuffer(raw, np.uint8)
        ids, first = self.propose(data, starts)
        # Pairs within a word; a word fails with any pair that is not compatible.
        begins = np.zeros(len(data) + 1, bool)
        begins[starts] = True
        head = begins[first]
        word = np.cumsum(head) - 1
        inner = np.flatnonzero(~head[1:])
        bad_words = word[inner[~self.checked(ids[inner], ids[inner + 1])]]
        bad_words = np.unique(np.concatenate([bad_words, word[~self.sound[ids]]]))
        edges = np.append(starts, len(data))
        if len(bad_words):
            true = self.repaired([raw[edges[w] : edges[w + 1]] for w in bad_words.tolist()])
            sizes = np.bincount(word, minlength=len(starts))
            new_sizes = sizes.copy()
            new_sizes[bad_words] = [len(x) for x in true]
            fails = np.zeros(len(starts), bool)
            fails[bad_words] = True
            out = np.empty(int(new_sizes.sum()), np.int64)
            slot_fails = np.repeat(fails, new_sizes)
            out[~slot_fails] = ids[~fails[word]]
            out[slot_fails] = np.concatenate(true)
            ids, sizes = out, new_sizes
        else:
            sizes = np.bincount(word, minlength=len(starts))
        totals = np.concatenate([[0], np.cumsum(sizes)])
        text_words = np.searchsorted(starts, byte_at[breaks])
        return ids, np.diff(totals[text_words])

    def _cuts(self, text: str) -> Iterator[str]:
        """Parts of at most window_chars, cut before white space behind other text; a part grows if it has no such place."""
        at, kinds = 0, split_classes()
        while len(text) - at > self.window_chars:
            size = self.window_chars
            while True:
                part = code_points(text[at : at + size])
                space = kinds[part] == SPACE
                safe = np.flatnonzero(space[1:] & ~space[:-1]) + 1
                if len(safe) or at + size >= len(text):
                    break
                size *= 2
            if not len(safe):
                break
            yield text[at : at + int(safe[-1])]
            at += int(safe[-1])
        yield text[at:]

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order; memory follows window_chars and the longest text."""
        pieces: list[str] = []
        shape: list[tuple[int, ...]] = []  # of each waiting text: its parts, a special id as -1 - id
        held = 0

        def flush() -> Iterator[np.ndarray]:
            ids, counts = self.encode_pieces(pieces)
            ends = np.concatenate([[0], np.cumsum(counts)])
            k = 0
            for parts in shape:
                own = []
                for x in parts:
                    if x < 0:
                        own.append(np.array([-1 - x], np.int64))
                    else:
                        own.append(ids[ends[k] : ends[k + 1]])
                        k += 1
                yield own[0] if len(own) == 1 else np.concatenate(own) if own else np.zeros(0, np.int64)

        for text in texts:
            parts: list[int] = []
            done: list[np.ndarray] = []
            for piece in self._split_special(text or ""):
                if isinstance(piece, int):
                    parts.append(-1 - piece)
                elif len(piece) > self.window_chars:
                    if parts:  # what waits of this text keeps its place
                        done.append(self._own(parts, pieces, len(pieces) - sum(x >= 0 for x in parts)))
                        del pieces[len(pieces) - sum(x >= 0 for x in parts) :]
                        parts = []
                    done += [self.encode_pieces([x])[0] for x in self._cuts(piece)]
                else:
                    parts.append(0)
                    pieces.append(piece)
                    held += len(piece)
            if done:
                own = [*done, self._own(parts, pieces, len(pieces) - sum(x >= 0 for x in parts))]
                del pieces[len(pieces) - sum(x >= 0 for x in parts) :]
                yield from flush()
                pieces, shape, held = [], [], 0
                yield np.concatenate(own)
                continue
            shape.append(tuple(parts))
            if held >= self.window_chars:
                yield from flush()
                pieces, shape, held = [], [], 0
        yield from flush()

    def _own(self, parts: list[int], pieces: list[str], at: int) -> np.ndarray:
        ids, counts = self.encode_pieces(pieces[at:])
        ends, k, out = np.concatenate([[0], np.cumsum(counts)]), 0, [np.zeros(0, np.int64)]
        for x in parts:
            if x < 0:
                out.append(np.array([-1 - x], np.int64))
            else:
                out.append(ids[ends[k] : ends[k + 1]])
                k += 1
        return np.concatenate(out)

    def _split_special(self, text: str) -> list[str | int]:
        out: list[str | int] = [text]
        for mark, i in self.special.items():
            if mark in text:
                new: list[str | int] = []
                for x in out:
                    if isinstance(x, int):
                        new.append(x)
                        continue
                    for k, y in enumerate(x.split(mark)):
                        new += ([i] if k else []) + ([y] if y else [])
                out = new
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids' tokens; special ids give their string."""
        length = self.decoded_len[ids]
        total = int(length.sum())
        if not total:
            return b""
        ends = np.cumsum(length)
        at = np.repeat(self.decoded_at[ids] - (ends - length), length) + np.arange(total)
        return self.decoded_flat[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def followed(starts: np.ndarray, stops: np.ndarray, length: np.ndarray, rounds: int = 256) -> np.ndarray:
    """All places that jumps of `length` reach from starts up to their stops, in order: all words go one jump at a time, the few that are left after some rounds one by one."""
    out, at, stop = [], starts, stops
    for _ in range(rounds):
        if not len(at):
            break
        out.append(at)
        at = at + length[at]
        inside = at < stop
        at, stop = at[inside], stop[inside]
    for a, b in zip(at.tolist(), stop.tolist(), strict=True):
        own, jumps, p = [], length[a:b].tolist(), 0
        while p < len(jumps):
            own.append(a + p)
            p += jumps[p]
        out.append(np.array(own, np.int64))
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


@functools.cache
def coder(path: str) -> SpeculativeBpe:
    """One for each worker process and vocabulary."""
    return SpeculativeBpe(path)


def resolve(vocabulary: str) -> str:
    """A path as it stands; a bare file name is one of the installed public vocabularies."""
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text each, or one row."""
    size = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        base = ends[at] - size[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """A row for each document: its number of tokens, digests of the ids and of the decoded text, and on demand both.

    Narrow: one pass over (id, text), no shuffle; other columns are pruned at the scan.
    """
    fields = [pa.field(id_col, pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields.append(pa.field("ids", pa.list_(pa.int32())))
        schema += ", ids array<int>"
    if with_text:
        fields.append(pa.field("decoded", pa.string()))
        schema += ", decoded string"
    kind = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(resolve(vocabulary))
        for batch in (y for x in batches for y in slices(x, text_col)):
            rows: dict[str, list] = {f.name: [] for f in fields}
            rows[id_col] = column(batch, id_col).to_pylist()
            for ids in bpe.encode_batch(column(batch, text_col).to_pylist()):
                plain = bpe.decode_bytes(ids)
                decoded = plain.decode("utf-8", "replace")
                rows["n_tokens"].append(len(ids))
                rows["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    rows["ids"].append(ids.astype(np.int32))
                if with_text:
                    rows["decoded"].append(decoded)
            yield pa.RecordBatch.from_pydict(rows, schema=kind)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
