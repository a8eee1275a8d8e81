"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprints: 64 bits, each the majority over the XXH64 hashes (seed 42) of a
document's three-word shingles, as in ``op9``'s contract.

Embedding: every four bits are a square of two by two, and its rows and columns
are segments of two bits, so a fingerprint has 32 rows and 32 columns. Its vector
holds the bit count, 0 to 2, of each segment. A bit is in one row and one column,
so the Manhattan distance of two vectors, over rows or over columns, is a lower
bound of the Hamming distance of the fingerprints. Counts are kept as bit masks
(count >= 1, count = 2); distances are popcounts. Different fingerprints can have
one vector: the two diagonals of a square have the same counts.

Grid: the squares are cut into ``radius // 2 + 1`` parts (two halves for links of 3
bits), so in one part linked fingerprints differ in at most one bit, and their
vectors by at most 1 over rows and 1 over columns. A cell is one vector of counts in
one part. The range join sends each fingerprint to its own cell in each part (home)
and, as a visitor, to the neighbouring cells in which one row and the column that
crosses it count one more; of two fingerprints a bit apart, one visits the other's
home. Of two random fingerprints some 4e-8 meet (``meeting``; measured in a test),
40 candidates for each of 1e9 distinct fingerprints. What meets is tested by the
Manhattan distance of whole vectors first and then by Hamming distance.

Dense groups: only the components matter, so a linear pass first links neighbours
and first members of each cell; cells whose members all are in one component
already are dropped, and pairs within a component are never kept. What is left
is joined without caps, homes with homes and visitors. Cells of more than ``BLOCK``
members are cut into blocks, in the linear pass as in the join of blocks with
blocks, so no cell is one task.

Exact copies share a fingerprint and are one node. Scale: two homes and some
32 visits of 16 bytes for each distinct fingerprint, dealt out by cell; visits to cells
that are nobody's home go no further.

Edge cases: a null or blank text has fingerprint zero and is linked like any
other; null ids never become a component's id unless a component has no other;
rows that repeat share their component, and of equal ids `keep_one` keeps the
first row; texts of any length are hashed in blocks; empty tables give empty
results; other columns, whatever their names, are kept by `keep_one` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridane.llm.bpe_speculative import column, slices
from veridane.llm.components import components
from veridane.llm.shared import release, written

RADIUS = 3
#: Members of a cell that are joined in one piece.
BLOCK = 4096


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint, as an unsigned number."""
    import xxhash

    tokens = (text or "").encode().lower().split()  # bytes: only A-Z fold, only ASCII white space splits
    if not tokens:
        return 0
    if len(tokens) <= words:
        parts = [b" ".join(tokens)]
    else:
        flat = b" ".join(tokens)
        ends = np.cumsum([len(t) + 1 for t in tokens])
        starts = (ends - [len(t) + 1 for t in tokens]).tolist()
        parts = [flat[a:b] for a, b in zip(starts[: len(tokens) - words + 1], (ends[words - 1 :] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(parts)
    for at in range(0, n, 1 << 16):
        block = parts[at : at + (1 << 16)]
        hashes = np.fromiter((digest(p, seed) for p in block), ">u8", len(block))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """docs with a long column `out` (the fingerprint's bits as a signed number); narrow, Arrow batches."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (y for x in batches for y in slices(x, text_col)):
            prints = np.array([fingerprint(x) for x in column(batch, text_col).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def parts_of(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each part, of whole squares; in one of them, at most one bit of linked fingerprints differs."""
    count = radius // 2 + 1
    if not 0 < count <= 16:
        raise ValueError(f"radius {radius}: not within 0 to 31")
    starts = [16 * k // count * 4 for k in range(count + 1)]
    return [(x, y - x) for x, y in zip(starts, starts[1:], strict=False)]


def meeting(radius: int = RADIUS) -> float:
    """The share of all pairs of random fingerprints that are candidates: the same counts in a part, or one of them the other's visitor."""
    same, visit = 18 / 256, 36 / 256  # of two random squares, and with each of a square's clear bits set in turn
    return sum(same ** (n // 4) + (2 * (n // 4) * visit * same ** (n // 4 - 1) if radius else 0) for _, n in parts_of(radius))


def signed(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits)


def embedding(fp: Column) -> list[Column]:
    """Bit masks of the rows with a bit count of at least 1, of those with 2, and the same of columns; square i is the bits 4i to 4i + 3, row by row."""
    row, column_ = F.shiftrightunsigned(fp, 1), F.shiftrightunsigned(fp, 2)
    rows, columns = signed(0x5555555555555555), signed(0x3333333333333333)
    return [fp.bitwiseOR(row).bitwiseAND(rows), fp.bitwiseAND(row).bitwiseAND(rows), fp.bitwiseOR(column_).bitwiseAND(columns), fp.bitwiseAND(column_).bitwiseAND(columns)]


def cell_of() -> Column:
    """The cell of the fingerprint `at` in the part `part` with the bits `mask`: a hash of the part and its counts."""
    return F.xxhash64("part", *[c.bitwiseAND(F.col("mask")) for c in embedding(F.col("at"))]).alias("cell")


def homes(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(cell, home, fp): each fingerprint's own cell in every part."""
    parts = F.array(*[F.struct(F.lit(k).alias("part"), signed(((1 << n) - 1) << start).alias("mask")) for k, (start, n) in enumerate(parts_of(radius))])
    points = nodes.select("fp", F.col("fp").alias("at"), F.inline(parts))
    return points.select(cell_of(), F.lit(True).alias("home"), "fp")


def visits(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(cell, home, fp): the neighbouring cells in which one row and one column of a fingerprint's vector count one more."""
    moves = F.array(*[F.struct(F.lit(k).alias("part"), signed(((1 << n) - 1) << start).alias("mask"), signed(1 << bit).alias("bit")) for k, (start, n) in enumerate(parts_of(radius)) for bit in range(start, start + n)])
    points = nodes.select("fp", F.inline(moves)).filter(F.col("fp").bitwiseAND(F.col("bit")) == 0).withColumn("at", F.col("fp").bitwiseOR(F.col("bit")))
    return points.select(cell_of(), F.lit(False).alias("home"), "fp")


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def manhattan(a: str, b: str) -> Column:
    """Distance of two vectors of segment counts, over rows or over columns, whichever is larger."""
    some_row, both_row, some_column, both_column = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(embedding(F.col(a)), embedding(F.col(b)), strict=True)]
    return F.greatest(some_row + both_row, some_column + both_column)


def members_of(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(cell, home, block, blocks, home_blocks, head, fp) of all cells that are someone's home and have more than one member."""
    own = homes(nodes, radius)
    keyed = own.union(visits(nodes, radius)) if radius else own
    met = written(keyed.join(own.select("cell").distinct(), "cell", "left_semi"), "met")
    pieces = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = met.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("n_home"), F.min("fp").alias("head")).filter("n > 1")
    sizes = sizes.select("cell", "head", pieces(F.col("n")).alias("blocks"), pieces(F.col("n_home")).alias("home_blocks"))
    return met.join(sizes, "cell").select("cell", "home", F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("block"), "blocks", "home_blocks", "head", "fp")


def candidates(members: DataFrame) -> DataFrame:
    """(a, comp_a, b, comp_b): a is at home in a cell that b shares or visits, in different components; members: (cell, home, block, blocks, home_blocks, fp, comp)."""
    x = F.pmod(F.xxhash64("fp"), "home_blocks").cast("int").alias("x")
    a = members.filter("home").select("cell", x, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), F.col("fp").alias("a"), F.col("comp").alias("comp_a"))
    b = members.select("cell", F.explode(F.sequence(F.lit(0), F.col("home_blocks") - 1)).alias("x"), F.col("block").alias("y"), (~F.col("home")).alias("visits"), F.col("fp").alias("b"), F.col("comp").alias("comp_b"))
    return a.join(b, ["cell", "x", "y"]).filter((F.col("comp_a") != F.col("comp_b")) & (F.col("visits") | (F.col("a") < F.col("b")))).select("a", "comp_a", "b", "comp_b")


def fingerprint_components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, comp) of each distinct fp of prints: comp is the smallest fingerprint that it is linked to."""
    nodes = written(prints.select("fp").distinct(), "fingerprints")
    members = written(members_of(nodes, radius), "cells")
    # Linear pass: neighbours and first members of each cell.
    order = Window.partitionBy("cell", "block").orderBy("fp")
    first = members.select(F.col("fp").alias("a"), F.lag("fp").over(order).alias("prior"), "head").select("a", F.explode(F.array("prior", "head")).alias("b"))
    easy = components(first.filter(F.col("b").isNotNull() & (F.col("a") != F.col("b")) & (distance("a", "b") <= radius)).distinct())
    merged = easy.select(F.col("node").alias("fp"), F.col("label").alias("known"))
    own = written(nodes.join(merged, "fp", "left").select("fp", F.coalesce("known", "fp").alias("comp")), "classes")
    # Range join on cells that hold more than one component.
    classed = written(members.drop("head").join(own, "fp"), "classed")
    mixed = classed.groupBy("cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("cell")
    live = written(classed.join(mixed, "cell", "left_semi"), "mixed")
    found = candidates(live).filter((manhattan("a", "b") <= radius) & (distance("a", "b") <= radius))
    final = components(found.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct())
    release(nodes, members, classed, live)
    return own.join(final.select(F.col("node").alias("comp"), F.col("label").alias("final")), "comp", "left").select("fp", F.coalesce("final", "comp").alias("comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """A row for each document: fingerprint (16 hex digits) and component_id, the smallest id in its component."""
    prints = written(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "fp").select("id", "fp"), "prints")
    classes = fingerprint_components(prints, radius)
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    labelled = written(classes.join(least, "fp"), "labelled")
    ids = labelled.groupBy("comp").agg(F.min("least").alias("component_id"))
    of = written(labelled.join(ids, "comp").select("fp", "component_id"), "members")
    return prints.join(of, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs without all but one row of each component: the one of its smallest id stays, of rows with that id the first."""
    columns = docs.columns
    marked = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    id_at, text_at = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"
    rows = written(with_fingerprint(marked, text_at, "fp").withColumn("row", F.monotonically_increasing_id()), "rows")
    prints = rows.select(F.col(id_at).alias("id"), "fp", "row")
    classes = fingerprint_components(prints, radius)
    # A null id comes last.
    least = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("first"))
    kept = written(classes.join(least, "fp").groupBy("comp").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row")), "kept")
    # One plan at every size: a merge join; kept has a row for each component, so it has no bound to broadcast it by.
    return rows.join(kept.hint("merge"), "row", "left_semi").select(*[F.col(f"c{k}").alias(name) for k, name in enumerate(columns)])
