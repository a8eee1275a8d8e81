"""Merkle manifests, secret scans and source divergence against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from veridane.llm import merkle_manifest, secret_scan, source_divergence

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})

# --- manifests ---------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels(nodes, arity):
    """All levels of a tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + arity])) for k in range(0, len(out[-1]), arity)])
    return out


def siblings(tree, ix, arity):
    for level in tree[:-1]:
        first = ix // arity * arity
        yield "".join(level[first:ix]), "".join(level[ix + 1 : first + arity])
        ix //= arity


def plain_manifest(rows, arity=16):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])], arity) for s in names}
    top = levels([trees[s][-1][0] for s in names], arity)
    for at, s in enumerate(names):
        for ix, (_, _, d, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            path = [*siblings(trees[s], ix, arity), *siblings(top, at, arity)]
            tamper = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            folded = leaf([*r[:4], r[4].translate(LOWER)]) if tamper else d
            for a, b in path:
                folded = sha(a + folded + b)
            yield r[0], d, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), folded, folded == top[-1][0]


FIELDS = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string, row long"


def manifest_rows():
    r = random.Random(5)
    rows = []
    for source, n in (("hot", 700), ("a", 1), ("b", 16), ("c", 17), ("", 5), ("é", 33), ("B", 2), (None, 40)):
        rows += [(r.randint(0, 10**6), source, r.choice(["en", None]), r.choice([None, 3]), r.choice([None, "", "Some TEXT", "ÄÖ ok", f"t{k}"])) for k in range(n)]
    rows += [(None, "hot", None, None, None)] * 3 + [(7, "hot", "en", 1, "Twice")] * 20 + [(None, "b", None, None, None), (11, "long", "en", 1, "A long one. " * 20000)]
    rows += [(k, f"s{k}", "en", 1, "X") for k in range(20)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("arity", "parts", "most"), [(16, 7, 1 << 20), (3, 12, 0)])
def test_manifest(spark, monkeypatch, arity, parts, most):
    """Trees of all sizes around the arity, ids null and repeated, equal rows, in few and many tasks, with places sent out and joined."""
    monkeypatch.setattr(merkle_manifest, "BROADCAST", most)
    rows = manifest_rows() if arity == 16 else manifest_rows()[:60]
    df = spark.createDataFrame([(*r, "t", "d", 0) for r in rows], FIELDS).repartition(parts)
    got = collections.Counter(tuple(r) for r in merkle_manifest.manifest(df, arity).collect())
    assert got == collections.Counter(plain_manifest(rows, arity))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_manifests(spark, n):
    rows = [(k, "s", "en", 1, "Text") for k in range(n)]
    got = [tuple(r) for r in merkle_manifest.manifest(spark.createDataFrame([(*r, "t", "d", 0) for r in rows], FIELDS)).collect()]
    assert sorted(got) == sorted(plain_manifest(rows))


def test_frontiers_complete_in_any_order():
    """Children in random order, over random batches: rounds of `grow` end with the same parents."""
    import pyarrow as pa

    r = random.Random(3)
    nodes = [sha(str(k)) for k in range(300)]
    want = levels(nodes, 16)
    part = lambda k: {"tree": "+x", "n": 300, "level": 1, "ix": k // 16, "digest": None, "kids": [{"k": k % 16, "digest": nodes[k], "id": k, "shown": None}]}
    parts, done = [part(k) for k in r.sample(range(300), 300)], {}
    for _ in range(10):
        out = []
        for at in range(0, len(parts), 70):
            for b in merkle_manifest.grow(iter([pa.RecordBatch.from_pylist(parts[at : at + 70])])):
                out += b.to_pylist()
        done |= {(p["level"], p["ix"]): p["digest"] for p in out if p["digest"]}
        parts = sorted((p for p in out if not p["digest"]), key=lambda p: (p["level"], p["ix"]))
    assert not parts and done == {(level, ix): d for level, nodes in enumerate(want) if level for ix, d in enumerate(nodes)}


# --- secrets -----------------------------------------------------------------

PLAIN = (
    (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 12),
    (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
)


def plain_base(text):
    return sorted((m.start(), k, m.end()) for k, (pattern, ok) in enumerate(PLAIN) for m in re.finditer(pattern, text or "", re.ASCII) if ok(m))


def entropy(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in collections.Counter(window).values())


def plain_added(text, base):
    out, confirmed = [], 0
    for m in re.finditer(r"[A-Za-z0-9+/=_-]{20,}", text or ""):
        c = m[0]
        words = secret_scan.WORDS if re.search(secret_scan.PARTED, c) else secret_scan.LONG_WORDS
        if not re.search("[0-9]", c) or not re.search("[A-Za-z]", c) or any(re.search(p, c) for p in secret_scan.ALLOWED) or len(re.sub(words, "", c)) * 5 <= len(c):
            continue
        hits = []
        for k in range(len(c) - 19):
            w = c[k : k + 20]
            kind = 0 if re.fullmatch("[0-9A-Fa-f]+", w) else 1 if re.fullmatch("[0-9a-z]+|[0-9A-Z]+", w) else 2
            if re.search("[0-9]", w) and re.search("[A-Za-z]", w) and entropy(w) >= secret_scan.BITS[kind] - 1e-6:
                hits.append((k, kind))
        if hits:
            a, b = m.start() + hits[0][0], m.start() + hits[-1][0] + 20
            if any(x < b and y > a for x, _, y in base):
                confirmed += 1
            else:
                out.append((a, 3 + hits[0][1], b))
    return out, confirmed


def plain_secrets(i, text):
    base = plain_base(text)
    added, confirmed = plain_added(text, base)
    shown = lambda spans: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return (i, *[sum(k == x for _, k, _ in base) for x in range(3)], sha(shown(base)), shown(sorted(base + added)), len(added), confirmed)


def secret_texts():
    r = random.Random(8)
    some = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    parts = [
        lambda: some("0123456789abcdef", r.randint(10, 45)), lambda: some("0123456789ABCDEF", r.randint(15, 45)), lambda: some(low + digits, r.randint(15, 40)), lambda: some(low + up + digits + "+/", r.randint(15, 60)),
        lambda: "AKIA" + some(up + digits, r.randint(0, 20)), lambda: r.choice(["token", "PassWord", "api_key", "APIKEY", "secret", "passwd"]) + r.choice(["", "'", '"']) + some(" ", r.randint(0, 2)) + r.choice(":=") + some(" ", r.randint(0, 2)) + r.choice(["", "'", '"']) + some(low + digits + "+/_.=-", r.randint(1, 30)),
        lambda: "getUserById2FromDatabaseTable", lambda: "usr/local/lib/python3/site-packages", lambda: "550e8400-e29b-41d4-a716-446655440000", lambda: "sha256-" + some(low + up + digits, 43), lambda: some("aA1", 40), lambda: "é😀", lambda: some(low, r.randint(1, 9)), lambda: some(digits, 25), lambda: "token=password:abcdefghijkl", lambda: "AKIAAKIA",
    ]
    texts = ["".join(r.choice(parts)() + r.choice([" ", " ", "\n", "", "=", "-", '"']) for _ in range(r.randint(0, 25))) for _ in range(300)]
    return [*texts, None, "", "a" * 30000 + "1", "Ab1" * 3000, " ".join(some("0123456789abcdef", 32) for _ in range(900)), " ".join(some(low + up + digits, 32) for _ in range(300))]


def test_secrets(spark, docs, rows, empty):
    texts = [(k, t) for k, t in enumerate(secret_texts())]
    got = collections.Counter(tuple(r) for r in secret_scan.secrets(spark.createDataFrame([*texts, *texts[:9], (None, texts[5][1])], "doc_id long, text string").repartition(5)).collect())
    want = collections.Counter(plain_secrets(i, t) for i, t in [*texts, *texts[:9], (None, texts[5][1])])
    assert got == want
    totals = [sum(r[k] * n for r, n in got.items()) for k in (1, 2, 3, 6, 7)]
    assert min(totals) > 30
    assert collections.Counter(tuple(r) for r in secret_scan.secrets(docs).collect()) == collections.Counter(plain_secrets(i, t) for i, t in [*[(r[0], r[1]) for r in rows], (None, "a null id"), (None, rows[3][1])])
    assert secret_scan.secrets(empty).count() == 0


def test_most_random_strings_are_hits_and_words_are_not(spark):
    r = random.Random(9)
    some = lambda alphabet: "".join(r.choice(alphabet) for _ in range(32))
    low = "abcdefghijklmnopqrstuvwxyz0123456789"
    random_ones = [some(a) for a in ("0123456789ABCDEF", low, low.upper(), low + low.upper() + "+/") for _ in range(150)]
    words = ["Verfassungsbeschwerdeverfahren2024", "src/main/java/com/company2/Handler", "internationalisation_of_20_pages", "111111111111111111111111a", "AbAbAbAb1AbAbAbAb1AbAbAbAb1", "0123456789abcdefABCDEF0123456789", "example-key-8f14e45fceea167a5a36"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*random_ones, *words])], "doc_id long, text string")
    found = {r["doc_id"] for r in secret_scan.scan(df).filter("size(added) > 0").collect()}
    assert len([k for k in found if k < 600]) > 580 and not [k for k in found if k >= 606]


def test_allow_list_of_the_caller(spark):
    value = "Zx81kQpLm09TtRwE5vNbQ7"
    df = spark.createDataFrame([(1, f"a {value} b", "kept", "gone", "kept", 0)], "doc_id long, text string, base2 string, added string, verdict string, c0 int")
    assert secret_scan.scan(df).first()["added"] and not secret_scan.scan(df, allow=(value,)).first()["added"]
    assert secret_scan.scan(df).columns == ["doc_id", "text", "base2", "verdict", "c0", "base", "added", "confirmed"]


# --- divergence --------------------------------------------------------------


def plain_divergence(rows, least, top=10):
    """rows: (text, lang, source)."""
    held, in_docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for t, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        groups[lang].add(source)
        held[lang, source].update(words)
        in_docs[lang].update(set(words))
    for lang, sources in groups.items():
        kept = [w for w, n in in_docs[lang].items() if n >= least]
        of = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept}  # noqa: E731, B023
        p, q = {s: of(held[lang, s]) for s in sources}, of(sum((held[lang, s] for s in sources), collections.Counter()))
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(f(p[s][w], q[w]), w) for w in kept if held[lang, s][w] and p[s][w] > q[w]]
            for part, found, n in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:n], 1):
                    yield lang, s, part, item, value, rank


@pytest.mark.parametrize(("least", "most"), [(2, 1 << 18), (3, 0), (10**6, 1 << 18)])
def test_divergence(spark, monkeypatch, least, most):
    """Null and empty fields, groups without terms, a language of one source, ties, copies; groups sent out and joined; no term kept at all."""
    monkeypatch.setattr(source_divergence, "BROADCAST", most)
    r = random.Random(6)
    words = ["the", "The", "ÉTÉ", "été", "über", "x1y", "don't", "zwei-drei", "漢字", "a", "b", "c", "D", "rare"]
    rows = [(" ".join(r.choices(words, range(1, 15), k=r.randint(0, 30))), r.choice(["en", "en", "de", None, ""]), r.choice(["hot", "hot", "b", "B", None, "", "é"])) for _ in range(150)]
    rows += [(None, "en", "b"), (None, "en", "nothing"), ("123 456", "en", "numbers"), ("solo solo solo", "fr", "only"), ("solo", "fr", "only"), (None, None, None), *[("same words here", "en", "twin1"), ("same words here", "en", "twin2")] * 4, ("word " * 30000, "en", "hot")]
    df = spark.createDataFrame([(*x, 1, "t") for x in rows], "text string, lang string, source string, n long, term string").repartition(4)
    got = [tuple(x) for x in source_divergence.divergence(df, least=least).collect()]
    assert sorted(got) == sorted(plain_divergence(rows, least))


def test_divergence_of_nothing(spark):
    assert source_divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_probabilities_are_exact(spark):
    r = random.Random(7)
    rows = [(c, n) for n in (r.randint(2, 9 * 10**15) for _ in range(300)) for c in (0, n - 2, r.randint(0, n - 2))]
    got = spark.createDataFrame(rows, "c long, n long").select("c", "n", source_divergence.probability(F.col("c"), F.col("n")).alias("p")).collect()
    assert all(x["p"] == 1 + 10**9 * (x["c"] + 2) // x["n"] for x in got)


# --- scopes of written tables ------------------------------------------------


def test_scopes_are_apart_and_nested(spark):
    """A scope deletes what was written in it alone; what it keeps belongs to the scope around it; other threads have scopes of their own."""
    from concurrent.futures import ThreadPoolExecutor

    from veridane.llm.shared import path_of, scope, written

    there = lambda t: spark._jvm.org.apache.hadoop.fs.Path(path_of(t)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path_of(t)))
    with ThreadPoolExecutor(1) as other:
        with scope(spark) as outer:
            a = written(spark.range(1), "a")
            elsewhere = other.submit(lambda: written(spark.range(1), "e")).result()
            with scope(spark) as inner:
                b, c = written(spark.range(1), "b"), written(spark.range(1), "c")
                inner.append(b)
            assert [there(x) for x in (a, b, c, elsewhere)] == [True, True, False, True]
            outer.append(a)
        assert [there(x) for x in (a, b, elsewhere)] == [True, False, True]


def test_only_a_to_z_are_lowered(spark):
    """ASCII texts, lowered at once, and others, by character, give what A-Z alone in lower case gives."""
    from veridane.llm.source_divergence import UPPER, LOWER, lowered

    texts = ["", "ABZ [\\]^_` @ 09 az\x00\x7f", "ÉA İB KC ẞD éE", "\U00010400 ZZ", UPPER]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", lowered(F.col("text")).alias("t")).collect()
    assert [r["t"] for r in sorted(got)] == [t.translate(str.maketrans(UPPER, LOWER)) for t in texts]
