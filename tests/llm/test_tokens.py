"""Token counts, BPE and packing against the tokenizers library."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veridane.llm import bpe_speculative, packing, token_counts

BYTE, WORD = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["a", "'s", "'", "'ll", "ve", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "😀", "́", "　", "<|endoftext|>", "<|ENDOFTEXT|>", "!", "ing", "\x85", "\x1c", "​", "Σ", "İ", "zzzzzzzz", "The", "\x00"]
texts = st.lists(st.sampled_from(PARTS), max_size=60).map("".join)


def byte_ids(text):
    return BYTE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(texts)
def test_bpe_equals_library(text):
    bpe = bpe_speculative.coder(public_tokenizers.path("byte_bpe_50k.json"))
    ids = next(iter(bpe.encode_batch([text])))
    assert ids.tolist() == byte_ids(text)
    assert bpe.decode(ids) == BYTE.decode(ids.tolist(), skip_special_tokens=False)


def test_bpe_windows_and_all_characters():
    small = bpe_speculative.SpeculativeBpe(public_tokenizers.path("byte_bpe_50k.json"), window_chars=40)
    r = random.Random(1)
    many = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 80))) for _ in range(400)] + ["x" * 500, " " * 300 + "y"]
    assert [i.tolist() for i in small.encode_batch(many)] == [byte_ids(t) for t in many]
    chars = [f"a{chr(c)}1{chr(c)}!" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    # An apostrophe begins a contraction behind a letter or a number only, also behind ones newer than Python's tables.
    chars += [f"{chr(c)}'t" for c in [*range(0x1C80, 0x1C90), *range(0xA7C0, 0xA7E0), *range(0x10000, 0x1F000, 3)]]
    bpe = bpe_speculative.coder(public_tokenizers.path("byte_bpe_50k.json"))
    assert [i.tolist() for i in bpe.encode_batch(chars)] == [e.ids for e in BYTE.encode_batch(chars, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(texts, st.sampled_from([(40, 4), (64, 16), (100, 1), (30, 30)]))
def test_overlaps_resynchronise(text, sizes):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = [i for part in token_counts.encode_huge(token_counts.tokenizer(path), text * 3, *sizes, token_counts.lowered(path)) for i in part]
    assert got == WORD.encode(text * 3, add_special_tokens=False).ids


def test_counts(docs, rows, empty):
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, chunk_chars=5000, overlap_chars=64).collect())
    want = collections.Counter()
    for i, t in [*[(r[0], r[1]) for r in rows], (None, "a null id"), (None, rows[3][1])]:
        n = len(WORD.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 2048] += 1
    assert got == want
    assert token_counts.token_counts(empty).count() == 0


def test_encode_decode(docs, rows, empty):
    got = collections.Counter(tuple(r) for r in bpe_speculative.encode_decode(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    want = collections.Counter()
    for i, t in [*[(r[0], r[1]) for r in rows], (None, "a null id"), (None, rows[3][1])]:
        ids = byte_ids(t)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(BYTE.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert bpe_speculative.encode_decode(empty).count() == 0
    full = bpe_speculative.encode_decode(docs, with_ids=True, with_text=True).filter("doc_id = 3").collect()
    assert all(r["decoded"] == rows[3][1] and r["ids"] == byte_ids(rows[3][1]) for r in full)


def check_packed(pieces, expected, size=1024):
    """pieces against the ids of each document; returns the number of padded tokens."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by_doc) == set(expected)
    for i, own in by_doc.items():
        copies = expected[i]
        streams = collections.Counter()
        for p in own:
            for ids in {tuple(c) for c in copies}:
                if len(ids) == p["doc_tokens"] and zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]:
                    streams[ids] += p["length"]
                    break
            else:
                raise AssertionError(f"a piece of {i} fits no document")
        assert streams == collections.Counter({ids: len(ids) * n for ids, n in collections.Counter(map(tuple, copies)).items()})
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= size
    return len(by_sequence) * size - sum(p["length"] for p in pieces)


def test_packing(docs, rows, empty):
    expected = collections.defaultdict(list)
    for i, t in [*[(r[0], r[1]) for r in rows], (None, "a null id"), (None, rows[3][1])]:
        expected[i].append([*byte_ids(t), 0])
    for block in (1 << 21, 3000):
        pieces = packing.pack(docs, block_tokens=block).collect()
        padded = check_packed(pieces, expected)
        assert block == 3000 or padded < 3 * 1024  # less than a sequence for each of three partitions
    assert packing.pack(empty).count() == 0
    ids = packing.pack(docs, with_ids=True).filter("doc_id = 3 AND start = 0").first()["ids"]
    assert ids == expected[3][0][: len(ids)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60))
def test_tails(lengths):
    placed, count = packing.pack_tails(lengths, 64)
    assert count == -(-sum(lengths) // 64)
    fill, got = collections.defaultdict(list), collections.defaultdict(list)
    for k, start, n, sequence, offset in placed:
        fill[sequence].append((offset, n))
        got[k].append((start, n))
    for parts in (*fill.values(), *got.values()):
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
    assert all(sum(n for _, n in got[k]) == length for k, length in enumerate(lengths))
    assert all(sum(n for _, n in x) <= 64 for x in fill.values())


def plain_tails(lengths, size, linear=1.0, quadratic=1 / 2048):
    """The method by looking at every sequence each time: longest piece first, to the cheapest that holds it, else as much as fits into the emptiest."""
    count = -(-sum(lengths) // size)
    room, cost = [size] * count, [0.0] * count
    queue, out = sorted((-n, k, 0) for k, n in enumerate(lengths)), []
    while queue:
        n, k, start = queue.pop(0)
        fits = [q for q in range(count) if room[q] >= -n]
        q = min(fits, key=lambda q: (cost[q], q)) if fits else min((q for q in range(count) if room[q]), key=lambda q: (-room[q], cost[q], q))
        part = min(-n, room[q])
        out.append((k, start, part, q, size - room[q]))
        room[q] -= part
        cost[q] += linear * part + quadratic * part * part
        if -n > part:
            queue = sorted([*queue, (n + part, k, start + part)])
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60))
def test_tails_go_to_the_cheapest(lengths):
    assert packing.pack_tails(lengths, 64)[0] == plain_tails(lengths, 64)


def test_costs_are_balanced():
    """Estimated costs of the sequences of a block spread less than under first fit, in no more sequences."""
    r = random.Random(5)
    lengths = [min(1023, int(r.paretovariate(1.1) * 30)) for _ in range(3000)]

    def spread(placed):
        cost = collections.Counter()
        for _, _, n, q, _ in placed:
            cost[q] += n + n * n / 2048
        values = np.array(list(cost.values()))
        return values.std() / values.mean(), values.max() / values.mean()

    own, count = packing.pack_tails(lengths, 1024)
    room, first = [1024] * len(lengths), []
    for k, n in enumerate(sorted(lengths, reverse=True)):
        q = next(q for q, x in enumerate(room) if x >= n)
        first.append((k, 0, n, q, 0))
        room[q] -= n
    assert count <= len({x[3] for x in first})
    assert spread(own) < spread(first), (spread(own), spread(first))


@pytest.mark.parametrize("text", ["a" * 9000, " " * 9000 + "x", "ab " * 4000 + "<|endoftext|>"])
def test_long_runs(text):
    assert packing.token_ids(text, "byte_bpe_50k.json", "byte_bpe_50k.tiktoken").tolist() == byte_ids(text)
