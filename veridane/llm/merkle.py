"""Merkle fingerprints of documents over paragraphs and sections.

Tree: a line is a paragraph, cut into leaves where a rolling hash of the last
``WINDOW`` characters says so, so leaves depend on content in any script: some 48
characters on average, at least ``LEAST`` and at most ``MOST``; a paragraph's node
digests its leaves; paragraphs are grouped into sections, which end where a
paragraph's digest says so, so an edit moves no boundary elsewhere; the root
digests the sections. Equal roots mean equal texts. Where roots differ, only
differing branches are followed, from sections by paragraphs to leaves, to locate
all edits (`differences`).

A fingerprint is the root and the tree with 32-bit hashes of all leaves, whatever
the length of the text. Likeness is the share of leaves in common (Dice, with
counts), 1 for equal roots; it is counted down the branches: sections that are
equal at either end are common as a whole, so are paragraphs of what lies between
them, and what is left is compared leaf by leaf.

Pairs of neighbours: a document's edited text takes text from the next one in
descending order of id. The order is dealt out in ranges of about equal bytes.
Their ends come from a histogram of at most ``BINS`` bins, refined where a bin is
too heavy, by ids and then within one id by the hash of its texts, so a hot id is
split as well; nothing else comes to the driver. Each range also gets the first
document of the range behind it, once a task that holds it, so one shuffle of the
texts is enough, and each task streams through its sorted rows.

Edge cases: a null text counts as empty (its tree has no leaf); null ids come
last in the order; rows with one id are ordered by a hash of their text, and
rows equal in both stay in one task; a single row is its own successor; texts of
any length are one tree in one task; an empty table gives an empty result; other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridane.llm.bpe_speculative import column, slices
from veridane.llm.word_bpe_text import code_points

#: Characters that decide on a cut, least and greatest length of a leaf; one place in EVERY is a cut.
WINDOW, LEAST, MOST, EVERY_BITS = 8, 16, 96, 5
SECTION_EVERY = 8
LAST = -(1 << 63)
#: Bins of the histogram of ids and of a refinement, bytes of text in a range, and ranges at most.
BINS, SUB_BINS, RANGE_BYTES, RANGES = 1 << 14, 1 << 10, 64 << 20, 1 << 15


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Tree(NamedTuple):
    root: bytes
    sections: list[bytes]
    section_ends: list[int]  # in paragraphs
    paragraphs: list[bytes]
    paragraph_ends: list[int]  # in leaves
    leaves: list[bytes]
    leaf_lengths: list[int]


def cut_places(text: str) -> list[int]:
    """Places behind which a leaf may end: the rolling hash of the WINDOW characters before them has its top bits zero."""
    points = code_points(text).astype(np.uint32)
    if len(points) < WINDOW:
        return []
    mixed = points * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    rolled, width, factor = mixed, 1, 0x01000193
    while width < WINDOW:  # from hashes of `width` characters to those of twice as many
        rolled = rolled[width:] + rolled[:-width] * np.uint32(factor)
        width, factor = 2 * width, factor * factor & 0xFFFFFFFF
    rolled = rolled * np.uint32(0x85EBCA6B)
    return (np.flatnonzero(rolled >> np.uint32(32 - EVERY_BITS) == 0) + WINDOW).tolist()


class Lines(NamedTuple):
    """The two lower levels of a tree."""

    paragraphs: list[bytes]
    paragraph_ends: list[int]
    leaves: list[bytes]
    leaf_lengths: list[int]


def lines_of(text: str) -> Lines:
    places = [*cut_places(text), len(text) + MOST]
    out = Lines([], [], [], [])
    _, ends, leaves, lengths = out
    at = k = 0
    for line in text.split("\n"):
        stop, own = at + len(line), []
        while at < stop:
            # The window of a place LEAST characters on lies in the leaf, so a leaf depends on itself alone.
            k = bisect_left(places, at + LEAST, k)
            end = min(stop, at + MOST, places[k])
            own.append(hashlib.blake2b(text[at:end].encode(), digest_size=16).digest())
            lengths.append(end - at)
            at = end
        at = stop + 1
        leaves += own
        out.paragraphs.append(digest(b"p" + b"".join(own)))
        ends.append(len(leaves))
    return out


def grown(lines: Lines) -> Tree:
    """The tree above its lines."""
    sections, ends, start = [], [], 0
    for k, p in enumerate(lines.paragraphs):
        if p[0] % SECTION_EVERY == 0 or k == len(lines.paragraphs) - 1:
            sections.append(digest(b"s" + b"".join(lines.paragraphs[start : k + 1])))
            ends.append(k + 1)
            start = k + 1
    return Tree(digest(b"r" + b"".join(sections)), sections, ends, *lines)


def tree(text: str | None) -> Tree:
    return grown(lines_of(text or ""))


def regrown(old: Tree, text: str, same: int) -> Tree:
    """The tree of a text whose first `same` characters are those of old's text: their whole lines are taken over."""
    begin = text.rfind("\n", 0, same) + 1
    n = text.count("\n", 0, begin)
    kept = old.paragraph_ends[n - 1] if n else 0
    rest = lines_of(text[begin:])
    return grown(Lines(old.paragraphs[:n] + rest.paragraphs, old.paragraph_ends[:n] + [kept + e for e in rest.paragraph_ends], old.leaves[:kept] + rest.leaves, old.leaf_lengths[:kept] + rest.leaf_lengths))


def fingerprint(t: Tree) -> str:
    """Root, a colon, and the tree: sections parted by |, their paragraphs by a comma, of 8 hex digits a leaf."""
    shown = [x[:4].hex() for x in t.leaves]
    lines = ["".join(shown[a:b]) for a, b in zip([0, *t.paragraph_ends], t.paragraph_ends, strict=False)]
    return t.root.hex() + ":" + "|".join(",".join(lines[a:b]) for a, b in zip([0, *t.section_ends], t.section_ends, strict=False))


def likeness(a: str, b: str) -> float:
    """Share of leaves in common, from two fingerprints; 0 to 1."""
    if a[:32] == b[:32]:
        return 1.0
    size = lambda node: (len(node) - node.count("|") - node.count(",")) // 8
    x, y = a[33:], b[33:]
    total, common = size(x) + size(y), 0
    for mark in "|,":  # branches that are equal at either end, of the sections and then of the paragraphs between
        p, q = x.split(mark), y.split(mark)
        n, start = min(len(p), len(q)), 0
        while start < n and p[start] == q[start]:
            start += 1
        end = 0
        while end < n - start and p[-1 - end] == q[-1 - end]:
            end += 1
        common += sum(map(size, p[:start])) + sum(map(size, p[len(p) - end :]))
        x, y = (mark.join(side[start : len(side) - end]) for side in (p, q))
    left, right = (Counter(side[k : k + 8] for k in range(0, len(side), 8)) for side in (x.replace("|", "").replace(",", ""), y.replace("|", "").replace(",", "")))
    common += sum(min(n, right[leaf]) for leaf, n in left.items() if leaf in right)
    return 2 * common / total if total else 0.0


def gaps(x: list[bytes], y: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """Ranges [i1, i2) of x and [j1, j2) of y that differ, in order; all between them is equal.

    Equal ends go first; then nodes that occur once on either side, in the longest
    run that is in order on both, hold the two sides together.
    """

    def trimmed(i1: int, i2: int, j1: int, j2: int) -> tuple[int, int, int, int]:
        while i1 < i2 and j1 < j2 and x[i1] == y[j1]:
            i1, j1 = i1 + 1, j1 + 1
        while i1 < i2 and j1 < j2 and x[i2 - 1] == y[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
        return i1, i2, j1, j2

    i1, i2, j1, j2 = trimmed(0, len(x), 0, len(y))
    left, right = Counter(x[i1:i2]), Counter(y[j1:j2])
    place = {node: j for j, node in enumerate(y[j1:j2], j1) if right[node] == 1}
    once = [(i, place[node]) for i, node in enumerate(x[i1:i2], i1) if left[node] == 1 and node in place]
    tails, ends, before = [], [], [-1] * len(once)  # the longest increasing run of places in y
    for k, (_, j) in enumerate(once):
        at = bisect_left(tails, j)
        before[k] = ends[at - 1] if at else -1
        tails[at:], ends[at:] = ([j], [k]) if at == len(tails) else ([j, *tails[at + 1 :]], [k, *ends[at + 1 :]])
    anchors, k = [], ends[-1] if ends else -1
    while k >= 0:
        anchors.append(once[k])
        k = before[k]
    for i, j in [*reversed(anchors), (i2, j2)]:
        gap = trimmed(i1, i, j1, j)
        if gap[0] < gap[1] or gap[2] < gap[3]:
            yield gap
        i1, j1 = i + 1, j + 1


def starts(t: Tree) -> tuple[list[int], list[int]]:
    """First character of each paragraph, and one more past the end; of each leaf, counted from its text's begin."""
    lines, leaves, at, k = [], [], 0, 0
    for end in t.paragraph_ends:
        lines.append(at)
        while k < end:
            leaves.append(at)
            at += t.leaf_lengths[k]
            k += 1
        at += 1
    return [*lines, at], leaves


def differences(a: Tree, b: Tree) -> list[tuple[int, int, int, int]]:
    """(start, stop, start, stop) of all characters of a that differ and of those of b in their place, found by differing branches only.

    Both texts count with one line end behind them: if the parts of a are replaced by those of b, a is b.
    """
    if a.root == b.root:
        return []
    out = []
    (lines_a, leaves_a), (lines_b, leaves_b) = starts(a), starts(b)
    for i1, i2, j1, j2 in gaps(a.sections, b.sections):
        p1, q1 = ([0, *t.section_ends][k] for t, k in ((a, i1), (b, j1)))
        p2, q2 = ([0, *t.section_ends][k] for t, k in ((a, i2), (b, j2)))
        for i1, i2, j1, j2 in gaps(a.paragraphs[p1:p2], b.paragraphs[q1:q2]):
            i1, i2, j1, j2 = i1 + p1, i2 + p1, j1 + q1, j2 + q1
            if i2 - i1 != j2 - j1:
                out.append((lines_a[i1], lines_a[i2], lines_b[j1], lines_b[j2]))
                continue
            for i, j in zip(range(i1, i2), range(j1, j2), strict=True):
                (u1, u2), (v1, v2) = ((([0, *t.paragraph_ends][k]), t.paragraph_ends[k]) for t, k in ((a, i), (b, j)))
                ends_a, ends_b = [*leaves_a[u1:u2], lines_a[i + 1] - 1], [*leaves_b[v1:v2], lines_b[j + 1] - 1]
                for x1, x2, y1, y2 in gaps(a.leaves[u1:u2], b.leaves[v1:v2]):
                    out.append((ends_a[x1], ends_a[x2], ends_b[y1], ends_b[y2]))
    return out


def edited(text: str, after: str) -> str:
    """text with its last third replaced by as much of the beginning of `after`."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k] if k else text


Place = tuple[int, int]


def histogram(rows: DataFrame) -> list[tuple[int, Place, Place]]:
    """(weight, lowest, highest place) of bins of rows (key, g, weight), in ascending order of (key, g); places in a bin are no other bin's.

    Bins of equal width in key first; one that holds over half a range's weight is
    split by key, then, if it holds one key, by g. At most BINS rows and SUB_BINS
    for each bin that is split come to the driver, whatever the size of the table.
    """

    def counted(binned: DataFrame) -> list:
        place = F.struct("key", "g")
        return binned.groupBy("bin").agg(F.sum("weight").alias("weight"), F.min(place).alias("low"), F.max(place).alias("high")).collect()

    def share(value, low, high, n: int):
        of = (value.cast("decimal(20,0)") - low.cast("decimal(20,0)")).cast("double") / ((high.cast("decimal(20,0)") - low.cast("decimal(20,0)")).cast("double") + 1)
        return F.least(F.floor(of * n), F.lit(n - 1)).cast("long")

    ids = rows.filter(F.col("key") != LAST)
    span = ids.agg(F.min("key").alias("low"), F.max("key").alias("high")).first()
    low, high = (F.lit(span[c] or 0).cast("long") for c in ("low", "high"))
    level = rows.withColumn("bin", F.when(F.col("key") == LAST, -1).otherwise(share(F.col("key"), low, high, BINS)))
    spark, done = rows.sparkSession, []
    found = counted(level)
    most = max(1, sum(r["weight"] for r in found) // ranges_of(spark, sum(r["weight"] for r in found)) // 2)
    while True:
        heavy = [r for r in found if r["weight"] > most and r["low"] != r["high"]]
        done += [(r["weight"], tuple(r["low"]), tuple(r["high"])) for r in found if r["weight"] <= most or r["low"] == r["high"]]
        if not heavy:
            return sorted(done, key=lambda b: b[1])
        # At most two bins for each range are heavy.
        split = [(r["bin"], k, r["low"]["key"] != r["high"]["key"], *r["low"], *r["high"]) for k, r in enumerate(heavy)]
        table = spark.createDataFrame(split, "bin long, k long, by_key boolean, low_key long, low_g long, high_key long, high_g long")
        by_key, by_g = share(F.col("key"), F.col("low_key"), F.col("high_key"), SUB_BINS), share(F.col("g"), F.col("low_g"), F.col("high_g"), SUB_BINS)
        part = F.col("k") * SUB_BINS + F.when(F.col("by_key"), by_key).otherwise(by_g)
        level = level.join(F.broadcast(table), "bin").select("key", "g", "weight", part.alias("bin"))
        found = counted(level)


def ranges_of(spark, weight: int) -> int:
    return int(min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-weight // RANGE_BYTES))))


def range_ends(rows: DataFrame) -> list[Place]:
    """The highest place of each range, ascending: neighbouring bins of about equal weight together."""
    bins = histogram(rows)
    total = sum(w for w, _, _ in bins)
    share, held, out = total / ranges_of(rows.sparkSession, total), 0, []
    for k, (weight, _, high) in enumerate(bins):
        held += weight
        if held >= share or k == len(bins) - 1 or held + bins[k + 1][0] > 1.5 * share:
            out.append(high)
            held = 0
    return out


def packed(key: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Places as 16 bytes each that sort as they do."""
    both = np.empty((len(key), 2), ">u8")
    both[:, 0], both[:, 1] = (x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for x in (key, g))
    return np.ascontiguousarray(both).view("S16").ravel()


def neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, extra, key, g, id, text) dealt out and sorted so that a document's successor follows it in its partition."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("key"), F.xxhash64(text_col).alias("g"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ends = range_ends(rows.select("key", "g", (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("weight")))
    heads = packed(*(np.array([e[k] for e in ends], np.int64) for k in (0, 1)))
    names = ["bucket", "extra", "key", "g", "id", "text"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in (y for x in batches for y in slices(x, "text")):
            places = packed(*(column(batch, c).to_numpy(zero_copy_only=False) for c in ("key", "g")))
            bucket = np.searchsorted(heads, places)  # the range whose head is the first >= the place
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.zeros(len(bucket), bool)), *batch.columns], names=names)
            first = {int(bucket[i]): i for i in np.flatnonzero(heads[bucket] == places)[::-1].tolist()}
            rest = [i for b, i in first.items() if b not in sent]
            sent.update(first)
            if rest:  # the range above gets it too; above the highest comes the lowest
                copy = batch.take(pa.array(rest, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array((bucket[rest] + 1) % len(heads)), pa.array(np.ones(len(rest), bool)), *copy.columns], names=names)

    dealt = rows.mapInArrow(deal, "bucket long, extra boolean, key long, g long, id long, text string")
    return dealt.repartitionById(max(1, len(heads)), F.col("bucket").cast("int")).sortWithinPartitions("bucket", "extra", F.desc("key"), F.desc("g"))


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits string"


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: fingerprints of it and its edited text, their likeness, its likeness to the next, and where the trees find edits ("start:stop>start:stop" of either text, comma-joined)."""
    names = [id_col, *[c.split()[0] for c in COLUMNS.split(", ")]]
    kind = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, id, text, tree, fingerprint of the row that waits for its successor
        for batch in (y for x in batches for y in slices(x, "text", 4 << 20)):
            rows: list[tuple] = []
            for bucket, extra, key, text in zip(*[column(batch, c).to_pylist() for c in ("bucket", "extra", "id", "text")], strict=True):
                if extra and (held is None or held[0] != bucket):
                    continue  # a head whose range's last document has had its successor
                text = text or ""
                own = tree(text)
                print_ = fingerprint(own)
                if held is not None and held[0] == bucket:
                    _, held_key, before, before_tree, before_print = held
                    changed = edited(before, text)
                    other = regrown(before_tree, changed, len(before) - len(before) // 3) if changed != before else before_tree
                    other_print = fingerprint(other)
                    found = ",".join(f"{a}:{b}>{c}:{d}" for a, b, c, d in differences(before_tree, other))
                    rows.append((held_key, len(before), hashlib.sha256(changed.encode()).hexdigest(), before_print, other_print, likeness(before_print, other_print), likeness(before_print, print_), found))
                held = None if extra else (bucket, key, text, own, print_)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

    return neighbours(docs, id_col, text_col).mapInArrow(run, f"{id_col} long, {COLUMNS}")
