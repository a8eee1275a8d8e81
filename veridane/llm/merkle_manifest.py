"""Merkle manifest of a dataset: a tree for each source, one tree over their roots, and a proof for each row.

1. *Leaves.* A row's leaf is a digest of its fields, made in the JVM at the scan;
   from then on only digests and ids are moved.
2. *Places.* Leaves are dealt out by ranges of (tree, id, digest) and written in
   order; a leaf's place in its tree is its place in its task plus the leaves of
   that tree in the tasks before, a sum over one row for each tree and task.
3. *Parents, by events.* A partial parent gathers child digests by index. The
   number that it needs follows from its tree's size alone, so the child that
   completes it is the event that emits it, and it in turn goes to its own parent:
   within a task whole subtrees grow without a shuffle. What is still partial at
   a task's edges, at most two parents a level, is the frontier: it is shuffled by
   parent, combined, and the events go on, until no frontier is left. A round
   completes at least the lowest level, so rounds are at most the height, and the
   driver sees nothing but how many partial parents are left.
4. *The tree over trees.* The roots of the sources' trees are leaves of one more
   tree, built the same way.
5. *Proofs, by reverse links.* From the top down, a complete parent hands each
   child its siblings to the left and right, and the path that it has itself been
   given; runs are joined with paths by (tree, level, place), keys that never repeat.

Scale: one shuffle of all leaves by ranges, then frontiers of a few rows a task,
then paths, one for each run of ``ARITY`` leaves. A source of a third of all rows is
cut into ranges like any other, and so are rows of one id, by their digests, and
equal rows, by their row numbers. A task holds one partial parent a level.

Edge cases: nulls are ``-`` in a leaf; a null source is a tree of its own, before all
others; null ids come first in their source; rows of one id in the order of their
leaves, and equal rows are a leaf each, in any order, as it makes no difference;
a tree of one leaf is that leaf, and its proof is of no siblings; an empty table
gives an empty result; texts of any length are hashed whole; other columns,
whatever their names, are left out.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridane.llm.shared import written

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of places that are sent to every task; they are counted.
BROADCAST = 1 << 20
BATCH = 4096

KIDS = "array<struct<k:int,digest:string,id:bigint,shown:string>>"
PART = f"tree string, n bigint, level int, ix bigint, digest string, kids {KIDS}"
PATH = "array<struct<left:string,right:string>>"


def encoded(c: str) -> Column:
    """A field: - for null, else its UTF-8 bytes' number, a colon, and itself."""
    value = F.col(c).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def ranked(items: DataFrame, order: list[str], name: str) -> DataFrame:
    """items with n, the rows of their tree, and place, from 0 in the order given; order tells all rows apart but equal ones."""
    dealt = items.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    held = written(dealt.withColumn("at", F.monotonically_increasing_id()), name)
    task = F.shiftright("at", 33)
    pieces = held.groupBy("tree", task.alias("task")).agg(F.count("*").alias("m"), F.min("at").alias("first"))
    before = Window.partitionBy("tree").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    of_tree = Window.partitionBy("tree")
    starts = written(pieces.select("tree", "task", "first", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"), F.sum("m").over(of_tree).alias("n")), f"{name}-places")
    if starts.limit(BROADCAST + 1).count() <= BROADCAST:
        starts = F.broadcast(starts)
    return held.withColumn("task", task).join(starts, ["tree", "task"]).withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("task", "at", "first", "before")


def size_at(n: int, level: int, arity: int) -> int:
    """Nodes of a level of a tree of n leaves."""
    for _ in range(level):
        n = -(-n // arity)
    return n


def grow(batches: Iterator[pa.RecordBatch], arity: int = ARITY) -> Iterator[pa.RecordBatch]:
    """Partial parents in, complete ones (with their digests) and those that stay partial out.

    One parent a level is open at a time, so rows in the order of (tree, level, ix) are
    combined most; whatever the order, nothing is lost, as a parent that has to give way goes out as it is.
    """
    schema = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("ix", pa.int64()), ("digest", pa.string()), ("kids", pa.list_(pa.struct([("k", pa.int32()), ("digest", pa.string()), ("id", pa.int64()), ("shown", pa.string())])))])
    out: list[dict] = []
    open_: dict[int, dict] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()

    def add(part: dict) -> None:
        """Combines a partial parent with the open one of its level; complete ones go on as a child of their own parent."""
        while True:
            level, held = part["level"], open_.pop(part["level"], None)
            if held is not None:
                if (held["tree"], held["ix"]) == (part["tree"], part["ix"]):
                    part = part | {"kids": held["kids"] + part["kids"]}
                else:
                    out.append(held)
            below = size_at(part["n"], level - 1, arity)
            if len(part["kids"]) < min(arity, below - arity * part["ix"]):
                open_[level] = part
                return
            kids = sorted(part["kids"], key=lambda kid: kid["k"])
            whole = hashlib.sha256("".join(kid["digest"] for kid in kids).encode()).hexdigest()
            out.append(part | {"kids": kids, "digest": whole})
            if below <= arity:  # the root
                return
            kid = {"k": part["ix"] % arity, "digest": whole, "id": None, "shown": None}
            part = {"tree": part["tree"], "n": part["n"], "level": level + 1, "ix": part["ix"] // arity, "digest": None, "kids": [kid]}

    for batch in batches:
        for part in batch.to_pylist():
            add(part)
            if len(out) >= BATCH:
                yield from flush()
    out.extend(open_.values())
    yield from flush()


def forest(placed: DataFrame, name: str, arity: int = ARITY) -> DataFrame:
    """(tree, n, level, ix, digest, kids) of all parents of all trees: placed (tree, n, place, digest, id, shown). Trees of one leaf have none."""
    grown_by = functools.partial(grow, arity=arity)
    kid = F.struct((F.col("place") % arity).cast("int").alias("k"), "digest", "id", "shown")
    leaves = placed.filter("n > 1").select("tree", F.col("n").cast("long").alias("n"), F.lit(1).alias("level"), F.floor(F.col("place") / arity).alias("ix"), F.lit(None).cast("string").alias("digest"), F.array(kid).alias("kids"))
    order = ["tree", "level", "ix"]
    grown = written(leaves.sortWithinPartitions("tree", "ix").mapInArrow(grown_by, PART), f"{name}-parents")
    whole, rounds = grown.filter("digest IS NOT NULL"), 0
    while True:
        frontier = grown.filter("digest IS NULL")
        if not frontier.take(1):
            return whole
        rounds += 1
        grown = written(frontier.repartition(*order).sortWithinPartitions(*order).mapInArrow(grown_by, PART), f"{name}-frontier-{rounds}")
        whole = whole.union(grown.filter("digest IS NOT NULL"))


def height(n: Column, most: int, arity: int) -> Column:
    """Levels above the leaves of a tree of n, for n up to most."""
    out, level, size = F.lit(0), 1, 1
    while size < most:
        out = F.when(n > size, level).otherwise(out)
        level, size = level + 1, size * arity
    return out


def paths_down(parents: DataFrame, tops: DataFrame, most: int, name: str, arity: int = ARITY) -> DataFrame:
    """(tree, id, digest, shown, path, ...) of each leaf of the trees of `parents`: its siblings and those of all above it, from the bottom up, then its tree's own path.

    tops: (tree, n, path, ...), whose further columns go along.
    """
    along = [c for c in tops.columns if c not in ("tree", "n", "path")]
    tops = tops.withColumn("level", height(F.col("n"), most, arity))
    top = 1
    while arity**top < most:
        top += 1
    given = None
    for level in range(top, 0, -1):
        begun = tops.filter(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("ix"), "path", *along)
        given = begun if given is None else begun.unionByName(given)
        joined = parents.filter(F.col("level") == level).select("tree", "ix", "kids").join(given, ["tree", "ix"])
        digests = F.transform("kids", lambda kid: kid["digest"])
        each = joined.select("tree", "ix", "path", *along, digests.alias("d"), F.posexplode("kids").alias("k", "kid"))
        beside = F.struct(F.array_join(F.slice("d", F.lit(1), F.col("k")), "").alias("left"), F.array_join(F.slice("d", F.col("k") + 2, F.lit(arity)), "").alias("right"))
        each = each.withColumn("path", F.concat(F.array(beside), "path"))
        if level == 1:
            return each.select("tree", "kid.id", "kid.digest", "kid.shown", "path", *along)
        given = written(each.select("tree", (F.col("ix") * arity + F.col("k")).alias("ix"), "path", *along), f"{name}-{level}")
    raise AssertionError


def roots(placed: DataFrame, parents: DataFrame) -> DataFrame:
    """(tree, n, root) of each tree; the leaf itself of a tree of one."""
    lone = placed.filter("n = 1").select("tree", F.col("n").cast("long").alias("n"), F.col("digest").alias("root"))
    most = parents.groupBy("tree").agg(F.max("n").alias("n"), F.max(F.struct("level", "digest"))["digest"].alias("root"))
    return lone.union(most)


def proofs(docs: DataFrame, shown: Column | None = None, arity: int = ARITY) -> DataFrame:
    """(doc_id, leaf, shown, siblings, subroot, root) of each row: siblings, (left, right) by level from the bottom up, are its proof.

    shown: the row as it is presented for checking, as an expression of its text; null where it is as it was.
    """
    none = F.lit(None).cast("string")
    text = docs.withColumn("_shown", shown if shown is not None else none).select(*FIELDS, "_shown")
    leaf = digest(*map(encoded, FIELDS))
    told = F.octet_length("_shown").cast("string")
    other = F.when(F.col("_shown").isNotNull(), digest(*[encoded(c) for c in FIELDS[:-1]], told, F.lit(":"), F.col("_shown")))
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))  # null first
    made = text.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf.alias("digest"), other.alias("shown"))
    leaves = written(made.withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = ranked(leaves, ["id", "digest", "row"], "ordered").drop("row")
    parents = forest(placed, "trees", arity)
    subroots = written(roots(placed, parents), "subroots")

    # The tree over the trees: its leaves are the subroots, in the order of their trees' names.
    over = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest"))
    over = ranked(over, ["of"], "over").withColumns({"id": F.lit(None).cast("long"), "shown": F.col("of")})
    above = forest(over, "top", arity)
    root = roots(over, above).select("tree", "n", "root")
    few = int(subroots.count())
    if few <= 1:
        given = subroots.withColumn("path", F.array().cast(PATH)).withColumn("subroot", F.col("root"))
    else:
        down = paths_down(above, root.withColumn("path", F.array().cast(PATH)), few, "top-paths", arity)
        down = down.select(F.col("shown").alias("tree"), "path", F.col("root").alias("whole"))
        given = subroots.join(down, "tree").select("tree", "n", "path", F.col("root").alias("subroot"), F.col("whole").alias("root"))
    given = written(given.select("tree", "n", "path", "subroot", "root"), "tops")

    most = given.agg(F.max("n")).first()[0] or 1
    columns = [F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "shown", F.col("path").alias("siblings"), "subroot", "root"]
    lone = placed.filter("n = 1").select("tree", "id", "digest", "shown").join(given.select("tree", "path", "subroot", "root"), "tree").select(*columns)
    if most == 1:
        return lone
    return paths_down(parents, given, most, "paths", arity).select(*columns).union(lone)


def tampered() -> Column:
    """The text in lower case (A to Z) where 5 divides the CRC-32 of the id; nulls stay."""
    return F.when((F.crc32(F.col("doc_id").cast("string")) % 5 == 0) & F.col("text").isNotNull(), F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def verified(proved: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) from `proofs`."""
    siblings = F.array_join(F.transform("siblings", lambda s: F.concat(s["left"], s["right"])), "")
    # A level of one node has no run; all others have siblings.
    fold = F.aggregate("siblings", F.coalesce("shown", "leaf"), lambda d, s: digest(s["left"], d, s["right"]))
    out = proved.withColumn("folded_root", fold)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """Each row's leaf, roots and proof, and whether the proof holds for the row as it is presented."""
    return verified(proofs(docs, tampered(), arity))


LEVELS, TOP_LEVELS = 5, 2


def _tree(name: str, leaves: str, levels: int) -> str:
    """SQL tables name_0 to name_levels (tree, ix, d, n), with the strings of digests to the left and right of each node."""
    out = f"{name}_0 AS (SELECT *, coalesce(string_agg(d, '') OVER (PARTITION BY tree, ix // 16 ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER (PARTITION BY tree, ix // 16 ORDER BY ix ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}))"
    for k in range(levels):
        up = f"SELECT tree, ix // 16 AS ix, CASE WHEN n = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY ix)) END AS d FROM {name}_{k} GROUP BY tree, ix // 16, n"
        out += f", {name}_{k + 1} AS (SELECT *, coalesce(string_agg(d, '') OVER (PARTITION BY tree, ix // 16 ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER (PARTITION BY tree, ix // 16 ORDER BY ix ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM ({up})))"
    return out


def _leaf(text: str) -> str:
    values = [*FIELDS[:-1], text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values) + ")"


CRC = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"
_FOLDS = [*[f"s{k}" for k in range(LEVELS)], *[f"t{k}" for k in range(TOP_LEVELS)]]


ORACLE = f"""WITH d AS (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN {CRC} % 5 = 0 AND text IS NOT NULL THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS shown, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM documents),
    leaves AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS ix, leaf AS d, doc_id, shown FROM d),
    {_tree('a', 'leaves', LEVELS)},
    subroots AS (SELECT 0 AS tree, tree AS ix, d FROM a_{LEVELS}),
    {_tree('b', 'subroots', TOP_LEVELS)},
    j AS (SELECT s0.doc_id, s0.d AS leaf, b_0.d AS subroot, b_{TOP_LEVELS}.d AS root, s0.shown, {', '.join(f"{t}.n AS n{k}, {t}.l AS l{k}, {t}.r AS r{k}" for k, t in enumerate(_FOLDS))}
      FROM a_0 AS s0 {' '.join(f"JOIN a_{k} AS s{k} ON s{k}.tree = s0.tree AND s{k}.ix = s0.ix // {16**k}" for k in range(1, LEVELS))}
      JOIN b_0 ON b_0.ix = s0.tree {' '.join(f"JOIN b_{k} AS t{k} ON t{k}.ix = s0.tree // {16**k}" for k in range(TOP_LEVELS))} CROSS JOIN b_{TOP_LEVELS}),
    f AS (SELECT *, {', '.join(f"CASE WHEN n{k} > 1 THEN sha256(l{k} || {'coalesce(shown, leaf)' if k == 0 else f'f{k - 1}'} || r{k}) ELSE {'coalesce(shown, leaf)' if k == 0 else f'f{k - 1}'} END AS f{k}" for k in range(len(_FOLDS)))} FROM j)
    SELECT doc_id, leaf, subroot, root, sha256({' || '.join(f"l{k} || r{k}" for k in range(len(_FOLDS)))}) AS proof_sha256, f{len(_FOLDS) - 1} AS folded_root, f{len(_FOLDS) - 1} = root AS verified FROM f"""
