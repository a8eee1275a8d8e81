"""Fingerprints, quality, language, near-dedup, PII, licenses and chats against plain versions."""

import collections
import hashlib
import math
import random

import brute
import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veridane.llm import chat_collapse, language_id, license_scan, license_texts, merkle, repetition, simhash_dedup
from veridane.llm.components import components

BASE = "/root/testdata/sf0.001"


def pairs_of(rows):
    return [*[(r[0], r[1]) for r in rows], (None, "a null id"), (None, rows[3][1])]


# --- Merkle ------------------------------------------------------------------


def replayed(text, other, edits):
    """text with its parts replaced by those of other, from "start:stop>start:stop" of both with a line end behind them."""
    out, at = "", 0
    for e in filter(None, edits.split(",")):
        (x1, x2), (y1, y2) = (map(int, side.split(":")) for side in e.split(">"))
        assert x1 >= at
        out += (text + "\n")[at:x1] + (other + "\n")[y1:y2]
        at = x2
    return (out + (text + "\n")[at:])[:-1]


def test_edits(unique, empty):
    df, rows = unique
    got = {r["doc_id"]: r for r in merkle.compare(df).collect()}
    want = brute.edits(rows)
    assert len(got) == len(want)
    for i, n, digest, text, changed, after in want:
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, digest)
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == changed) == (r["edits"] == "")
        assert math.isclose(r["near_edited"], brute.likeness(text, changed)) and math.isclose(r["near_next"], brute.likeness(text, after))
        assert replayed(text, changed, r["edits"]) == changed
    assert merkle.compare(empty).count() == 0


def test_branches_locate_all_edits():
    """Edits in many places, lines moved, added and dropped, in several scripts: replaying what was located gives the other text, and little else is named."""
    r = random.Random(1)
    scripts = ["abcdefg hij. klm\n", "漢字仮名交じり文、東京都。", "éàü ßß\n\n"]
    some = lambda n: "".join(r.choice(a) for a in [r.choice(scripts)] for _ in range(n))
    for _ in range(400):
        t = u = some(r.randint(0, 1500))
        for _ in range(r.randint(0, 4)):
            i = r.randint(0, len(u))
            u = u[:i] + some(r.choice([0, 1, 3, 80])) + u[min(len(u), i + r.choice([0, 1, 5, 60])) :]
        if r.random() < 0.2:
            u = "\n".join(r.sample(u.split("\n"), u.count("\n") + 1))
        a, b = merkle.tree(t), merkle.tree(u)
        same = next((k for k, (x, y) in enumerate(zip(t, u, strict=False)) if x != y), min(len(t), len(u)))
        assert merkle.regrown(a, u, same) == b
        found = ",".join(f"{w}:{x}>{y}:{z}" for w, x, y, z in merkle.differences(a, b))
        assert replayed(t, u, found) == u
        assert math.isclose(merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)), brute.likeness(t, u))
    line = lambda: "".join(r.choice("abcdefghij") for _ in range(60))
    lines = [line() for _ in range(500)]
    other = [line() if k in (3, 250, 251, 499) else x for k, x in enumerate(lines)]
    found = merkle.differences(merkle.tree("\n".join(lines)), merkle.tree("\n".join(other)))
    assert 3 <= len(found) <= 8 and sum(b - a for a, b, *_ in found) <= 4 * 61 and {a // 61 for a, *_ in found} == {3, 250, 251, 499}


@pytest.mark.parametrize("alphabet", [range(0x4E00, 0x9FFF), range(0x410, 0x450), range(0xE01, 0xE2F), range(0x61, 0x7B)])
def test_one_character_more_in_any_script(alphabet):
    r = random.Random(2)
    text = "".join(chr(r.choice(alphabet)) for _ in range(3000))
    for other in (chr(alphabet[0]) + text, text[:1500] + chr(alphabet[1]) + text[1500:]):
        assert merkle.likeness(*[merkle.fingerprint(merkle.tree(t)) for t in (text, other)]) > 0.9


@pytest.mark.parametrize("ids", ["spread", "one", "null", "extreme"])
def test_ranges_of_ids(spark, monkeypatch, ids):
    """However ids lie, every document meets its successor, and no range is heavy if its rows can be told apart."""
    monkeypatch.setattr(merkle, "RANGE_BYTES", 2000)
    monkeypatch.setattr(merkle, "BINS", 8)
    r = random.Random(4)
    key = {"spread": lambda k: 7 * k, "one": lambda k: 5 if k % 3 else 1000 + k, "null": lambda k: None if k % 3 else k, "extreme": lambda k: r.choice([-1, 1]) * (2**62 + k * 3)}[ids]
    rows = [(key(k), "".join(r.choice("abc ") for _ in range(r.randint(0, 60)))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = merkle.neighbours(df, "doc_id", "text")
    ranges = collections.defaultdict(list)
    for x in dealt.collect():
        ranges[x["bucket"]].append(x)
    sizes = [sum(not x["extra"] for x in part) for part in ranges.values()]
    assert sum(sizes) == 400 and len(sizes) > 8 and max(sizes) < 60
    ordered = [x for b in sorted(ranges, reverse=True) for x in ranges[b] if not x["extra"]]
    places = [(x["key"], x["g"]) for x in ordered]
    assert places == sorted(places, reverse=True)
    for b, part in ranges.items():
        heads = {(x["key"], x["g"]) for x in part if x["extra"]}
        below = [x for x in ranges[(b - 1) % len(ranges)] if not x["extra"]]
        assert heads == {(below[0]["key"], below[0]["g"])}
    got = collections.Counter((x["doc_id"], x["edited_sha256"]) for x in merkle.compare(df).collect())
    texts = {(x["key"], x["g"]): x["text"] for x in ordered}
    want = collections.Counter()
    for k, x in enumerate(ordered):
        after = texts[places[(k + 1) % 400]]
        want[x["id"], hashlib.sha256(merkle.edited(x["text"], after).encode()).hexdigest()] += 1
    assert got == want


def test_fingerprints_survive_nulls_and_repeats(docs, rows):
    got = merkle.compare(docs).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in pairs_of(rows))
    by_text = collections.defaultdict(set)
    texts = dict(pairs_of(rows))
    for r in got:
        if r["doc_id"] is not None:
            by_text[texts[r["doc_id"]] or ""].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values()) and len({next(iter(x)) for x in by_text.values()}) == len(by_text)


def test_one_document_is_its_own_successor(spark):
    r = merkle.compare(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert [x["edited_sha256"] for x in r] == [hashlib.sha256(b"abcdab").hexdigest()] and r[0]["near_next"] == 1.0


# --- quality -----------------------------------------------------------------


def test_quality(docs, rows, empty):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "base_failed", "kept"]
    short = [(i, t) for i, t in pairs_of(rows) if len(t or "") < 20000]
    for size in (1 << 20, 700):
        got = collections.Counter(tuple(r) for r in repetition.quality(docs, batch_chars=size).filter(F.length(F.coalesce("doc_id", F.lit(0)).cast("string")) > 0).select(*names).collect())
        want = collections.Counter((i, *brute.quality(t)) for i, t in short)
        assert not want - got and sum(got.values()) == len(pairs_of(rows))
    assert repetition.quality(empty).count() == 0
    kept = repetition.keep_good(docs)
    assert kept.schema == docs.schema
    assert collections.Counter(r["text"] for r in kept.collect() if len(r["text"]) < 20000) == collections.Counter(t for _, t in short if brute.quality(t)[-1])


def test_repeats_of_random_words():
    r = random.Random(4)
    texts = [None, "", "a", "a a a a a a a", *[" ".join(r.choice("abcdef\n") for _ in range(r.randint(0, 150))) for _ in range(150)]]
    m = repetition.measure(texts)
    failed, kept = repetition.verdicts(m, repetition.MAX_COVERED, repetition.MAX_LONGEST)
    for k, t in enumerate(texts):
        assert (*(int(m[c][k]) for c in repetition.COUNTS[:-1]), failed[k], kept[k]) == brute.quality(t)


def methods_own():
    """Texts that the base rule passes: with repeats just within and just over the method's limits."""
    r = random.Random(21)
    fresh = iter(f"w{k}" for k in range(10**6))
    some = lambda n: " ".join(next(fresh) for _ in range(n))
    out = []
    for n in (49, 50, 51, 52, 80):  # one long passage twice in a long text
        p = some(n)
        out.append(f"{some(200)} {p} {some(150)} {p} {some(100)}")
    for times in (5, 6, 7, 8, 9, 12):  # many short passages twice: 14 words each of 200 and more
        parts = [some(7) for _ in range(times)]
        rest = [some(3) for _ in range(2 * times)]
        mixed = [*parts, *parts]
        r.shuffle(mixed)
        out.append(" ".join(x for pair in zip(rest, mixed, strict=True) for x in pair) + " " + some(200 - 6 * times))
    return out


def test_method_rejects_beyond_the_base_rule(spark):
    """Planted repeats that only the method fails, against brute force and the registered SQL."""
    import duckdb

    from veridane.llm import op5_sql

    texts = methods_own()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in repetition.quality(df).drop("longest_repeat").collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert 0 < sum(not r["kept"] for r in got.values()) < len(texts)
    assert [got[k]["kept"] for k in range(len(texts))] == [brute.quality(t)[-1] for t in texts]
    assert [got[k]["kept"] for k in range(5)] == [True, True, False, False, False]
    assert len({got[k]["kept"] for k in range(5, len(texts))}) == 2
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    names = list(got[0].asDict())
    rows = duck.execute(f"SELECT {', '.join(names)} FROM ({op5_sql.ORACLE})").fetchall()
    assert sorted(rows) == sorted(tuple(r) for r in got.values())


# --- language ------------------------------------------------------------------


def test_language_held_out(spark):
    d = spark.read.parquet(f"{BASE}/documents.parquet")
    got = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.filter("lang = lang_pred").count(), got.count()
    assert n > 30 and right / n >= 0.97


def test_language_edges(docs, rows, empty):
    got = language_id.identify(docs).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in pairs_of(rows))
    texts = dict(pairs_of(rows))
    for r in got:
        if r["doc_id"] is not None:
            letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert (r["lang_pred"] != "und") == letters and 0 <= r["score"] <= 1
    assert language_id.identify(empty).count() == 0
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}
    kept = language_id.keep_known(docs)
    assert kept.columns == docs.columns and kept.filter("text IS NULL OR text = ''").count() == 0


@pytest.mark.parametrize("block", [1 << 18, 4])
def test_scores_equal_a_plain_sum(monkeypatch, block):
    """Also across the ends of blocks."""
    monkeypatch.setattr(language_id, "BLOCK", block)
    texts = ["Ab 1c", "", "é", "abcdefghij klm", "a1b2 c3 İstanbul ΣΑΣ", "zz " * 9]
    model = language_id.Model(["a", "b"], np.log(np.random.default_rng(0).random((64, 2))).astype(np.float32), np.log([0.3, 0.7]))
    langs, scores = model.predict(texts)
    for k, text in enumerate(texts):
        own = model.log_p[brute.grams(text, 64)].astype(float)
        if not len(own):
            assert (langs[k], scores[k]) == ("und", 0.0)
            continue
        z = own.mean(0) * min(len(own), 64) + np.log([0.3, 0.7])
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = int((own.sum(0) + np.log([0.3, 0.7])).argmax())
        assert math.isclose(scores[k], p[best], rel_tol=1e-6) and langs[k] == "ab"[best]


def test_training_equals_plain_counts(spark):
    """Log probabilities and priors from n-grams counted one by one; repeated rows count once, nulls not at all."""
    r = random.Random(3)
    rows = [(k, "".join(r.choice("abç dé") for _ in range(r.randint(0, 40))), r.choice(["x", "y", "z"])) for k in range(60)]
    labelled = [*rows, rows[0], rows[0], (None, "abc", None), (70, None, "x")]
    model = language_id.train(spark.createDataFrame(labelled, "doc_id long, text string, lang string").repartition(3), per_language=10**6)
    assert model.languages == ["x", "y", "z"]
    n = [sum(x[2] == lang for x in [*rows, rows[0], rows[0]]) for lang in "xyz"]
    assert np.allclose(model.prior, np.log(np.array(n) / sum(n)))
    table = np.full((language_id.BUCKETS, 3), 0.5)
    for _, text, lang in rows:
        for b in brute.grams(text, language_id.BUCKETS):
            table[b, "xyz".index(lang)] += 1
    assert np.allclose(model.log_p, np.log(table / table.sum(0)), atol=1e-5)


def test_any_number_of_languages(spark, monkeypatch):
    """More languages take fewer buckets; beyond the bound the most frequent are learnt."""
    rows = [(k, f"{chr(0x4E00 + k % 300) * 5} {k}", f"l{k % 300:03}") for k in range(900)]
    df = spark.createDataFrame([*rows, (900, rows[7][1], "l007")], "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "CELLS", 300 << 12)
    model = language_id.train(df)
    assert len(model.languages) == 300 and len(model.log_p) == 1 << 12
    assert language_id.train(df, max_languages=1).languages == ["l007"]
    right = sum(lang == x[2] for lang, x in zip(model.predict([x[1] for x in rows])[0], rows, strict=True))
    assert right > 850


def test_sample_is_bounded_by_rows(spark):
    """About per_language texts, also if one id or one row repeats."""
    rows = [(1 if k % 2 else k, f"text {k % 500}", "en") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, per_language=200)
    commonest = math.exp(model.log_p.max() - model.log_p.min()) * 0.5  # "t", twice a text
    assert 2 * 20 < commonest < 2 * 400


# --- near-dedup ----------------------------------------------------------------


def test_near_duplicates(docs, rows, empty):
    got = collections.Counter(tuple(r) for r in simhash_dedup.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect())
    assert got == collections.Counter(brute.component_ids(pairs_of(rows)))
    assert simhash_dedup.near_duplicates(empty).count() == 0


def test_links_of_planted_fingerprints(spark):
    """Balls of near fingerprints, dense and in chains, against all pairs."""
    r = random.Random(8)
    prints = {0, 7, (1 << 64) - 1}
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(60):
            p = centre
            for b in r.sample(range(64), r.randint(0, 5)):
                p ^= 1 << b
            prints.add(p)
        for b in r.sample(range(64), 20):  # a chain
            centre ^= 1 << b
            prints.add(centre)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {r["fp"] % (1 << 64): r["comp"] for r in simhash_dedup.fingerprint_components(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    want = brute.components(prints)
    groups = lambda of: sorted(sorted(p for p in of if of[p] == c) for c in set(of.values()))
    assert groups(got) == groups(want)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 31])
def test_vectors_bound_distances(spark, radius):
    """The Manhattan distance of counted segments is at most the Hamming distance; of linked fingerprints, one is at home where the other is or visits."""
    r = random.Random(radius)
    pairs = [(0b1001, 0b0110)]  # the diagonals of a square
    for k in range(400):
        a = b = r.getrandbits(64) if k else 0
        for bit in r.sample(range(64), r.randint(0, min(2 * radius + 1, 40))):
            b ^= 1 << bit
        pairs.append((a, b))
    df = spark.createDataFrame([(k, *[x - (1 << 64) if x >> 63 else x for x in p]) for k, p in enumerate(pairs)], "k long, a long, b long")
    cells = {}
    for c in "ab":
        nodes = df.select(F.col(c).alias("fp")).distinct()
        for x in simhash_dedup.homes(nodes, radius).union(simhash_dedup.visits(nodes, radius)).collect():
            cells.setdefault((c, x["home"], x["fp"] % (1 << 64)), set()).add(x["cell"])
    of = lambda c, home, x: cells.get((c, home, x), set())
    rows = df.select("k", simhash_dedup.distance("a", "b").alias("d"), simhash_dedup.manhattan("a", "b").alias("m")).collect()
    parts = simhash_dedup.parts_of(radius)
    assert sum(n for _, n in parts) == 64 and all(n % 4 == 0 and n for _, n in parts)

    def counts(x, start=0, n=64):
        squares = [[x >> (at + k) & 1 for k in range(4)] for at in range(start, start + n, 4)]
        return [p + q for p, q, _, _ in squares] + [p + q for _, _, p, q in squares], [p + q for p, _, q, _ in squares] + [p + q for _, p, _, q in squares]

    apart = lambda u, v: sum(abs(p - q) for p, q in zip(u, v, strict=True))
    for x, (a, b) in zip(sorted(rows), pairs, strict=True):
        (rows_a, columns_a), (rows_b, columns_b) = counts(a), counts(b)
        assert x["m"] == max(apart(rows_a, rows_b), apart(columns_a, columns_b)) <= x["d"] == (a ^ b).bit_count()
        same = sum(counts(a, *p) == counts(b, *p) for p in parts)
        assert len(of("a", True, a) & of("b", True, b)) == same
        met = same or of("a", True, a) & of("b", False, b) or of("a", False, a) & of("b", True, b)
        assert x["d"] > radius or met
    assert len(of("a", False, pairs[1][0])) == 64 and rows[0]["m"] == 0 < rows[0]["d"]


def test_candidates_of_uniform_fingerprints(spark):
    """As few as computed, at sizes each four times the last; all are in range."""
    for n in (40_000, 160_000, 640_000):
        nodes = spark.range(n).select(F.xxhash64("id", F.lit(5)).alias("fp"))
        members = simhash_dedup.members_of(nodes).withColumn("comp", F.col("fp"))
        want = simhash_dedup.meeting() * n * (n - 1) / 2
        got = simhash_dedup.candidates(members).count()
        print(n, got, want)
        assert abs(got - want) < 5 * math.sqrt(want) + 5


@pytest.mark.parametrize("block", [4096, 3])
def test_blocks_of_hot_cells(spark, monkeypatch, block):
    """A cell that holds far more than a block gives the same components."""
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    r = random.Random(3)
    prints = {sum(1 << b for b in r.sample(range(11, 44), r.randint(0, 7))) for _ in range(250)}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {x["fp"]: x["comp"] for x in simhash_dedup.fingerprint_components(df).collect()}
    want = brute.components(prints)
    groups = lambda of: sorted(sorted(p for p in of if of[p] == c) for c in set(of.values()))
    assert groups(got) == groups(want) and len(set(got.values())) > 5


def test_keep_one(docs, rows, empty):
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.schema.names == docs.schema.names
    of = brute.components([brute.fingerprint(t) for _, t in pairs_of(rows)])
    got = collections.Counter(of[brute.fingerprint(r["text"])] for r in kept.collect())
    assert set(got.values()) == {1} and set(got) == set(of.values())
    least = {}
    for i, t in pairs_of(rows):
        c = of[brute.fingerprint(t)]
        least[c] = min(least.get(c, math.inf), math.inf if i is None else i)
    assert {of[brute.fingerprint(r["text"])]: math.inf if r["doc_id"] is None else r["doc_id"] for r in kept.collect()} == least
    assert simhash_dedup.keep_one(empty).count() == 0


def test_components_of_a_path(spark):
    n = 300
    order = random.Random(2).sample(range(n), n)
    links = spark.createDataFrame([*zip(order, order[1:], strict=False), (1000, 1001)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == dict.fromkeys(range(n), 0) | {1000: 1000, 1001: 1000}


# --- licenses ----------------------------------------------------------------------


def test_licenses(docs, rows, empty):
    out = license_scan.scan(docs).collect()
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out)
    assert got == collections.Counter((i, *brute.phrases(t)) for i, t in pairs_of(rows))
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1 for r in out)
    assert license_scan.scan(empty).count() == 0


def test_spans_with_gaps(spark):
    gpl = license_texts.whole("gpl-3")
    texts = ["x y Licensed under CC BY-NC 4.0.", "Licensed under, well, CC BY-NC 4.0", "licensed cc by", "this file is free and unencumbered software released into the public domain today", None, "see MIT License", license_texts.MIT + " mit license", "intro " + gpl, gpl[: len(gpl) // 2]]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == ("cc-by-nc", 1.0) and got[2] == ("", 0.0) and got[4] == ("", 0.0)
    assert got[1][0] == "cc-by-nc" and 0.7 <= got[1][1] <= 1.0
    # A whole license, whose notice at its end is near those of its family; half of it, which only names itself.
    assert got[7] == ("agpl,gpl,lgpl", 1.0) and got[8] == ("gpl", 0.5)
    assert got[5] == ("mit", 0.5) and got[6] == ("mit", 1.0)  # named alone, and held as a whole


def passages():
    """Whole templates with words dropped, put in, changed and doubled, alone, in other text, and cut short; and stray grams in long chains."""
    r = random.Random(5)
    out = []
    for _, notice in license_texts.TEMPLATES:
        for rate in (0.0, 0.02, 0.05, 0.15):
            w = notice.split()
            for k in range(len(w) - 1, -1, -1):
                if r.random() < rate:
                    w[k : k + 1] = r.choice([[], ["word"], [w[k], "new"], [w[k], w[k]]])
            cut = r.choice([1.0, 1.0, 0.8, 0.5])
            body = " ".join(w[: int(len(w) * cut)])
            out.append(" ".join([*["before"] * r.randint(0, 5), body, *["behind"] * r.randint(0, 5)]))
    grams = [" ".join(license_texts.MIT.split()[k : k + 3]) for k in range(0, 120, 2)]
    return [*out, " x ".join(r.sample(grams, 60)), " x ".join(reversed(grams)), " ".join([license_texts.MIT] * 3), license_texts.MIT + license_texts.BSD_2]


@pytest.mark.parametrize("broadcast", [1 << 18, 3])
def test_votes_equal_the_plain_ones(spark, monkeypatch, broadcast):
    """Labels and scores of edited passages against voting in plain loops, with the templates sent out and shuffled."""
    monkeypatch.setattr(license_scan, "BROADCAST", broadcast)
    texts = passages()
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    want = [brute.voted(t, license_texts.TEMPLATES) for t in texts]
    assert [got[k][0] for k in range(len(texts))] == [w for w, _ in want]
    assert all(math.isclose(got[k][1], w, rel_tol=1e-9) for k, (_, w) in enumerate(want))
    for k, (label, notice) in enumerate(license_texts.TEMPLATES):
        assert " ".join(notice.split()) not in texts[4 * k] or label in got[4 * k][0].split(",")
    assert len({round(s, 6) for _, s in got.values()}) > 10


def test_templates_are_a_table(spark):
    docs = spark.createDataFrame([(1, "one two three four five", 0, "x")], "doc_id long, text string, row int, template string")
    own = spark.createDataFrame([("a", "One, two: three four"), ("b", "four five"), ("c", None), ("a", "One, two: three four")], "label string, notice string")
    r = license_scan.scan(docs, templates=own).first()
    assert (r["labels"], r["score"]) == ("a", 1.0)
    assert license_scan.scan(docs, templates=own.limit(0)).first()["labels"] == ""


# --- chats ---------------------------------------------------------------------------


def chats():
    r = random.Random(6)
    rows, said = [], ["hi", "hello", "why", "so", None, ""]
    for conv in range(60):
        first, n = r.choice([0, 0, 1, 5]), r.randint(1, 5)
        for t in range(n):
            rows.append((conv, first + t, "user" if t % 2 == 0 else "assistant", said[0] if t == 0 else r.choice(said[:3] if conv % 2 else said)))
    rows += [(100, 0, "user", "hi"), (100, 0, "user", "hi"), (101, 0, None, None), (102, 0, "a", "x"), (102, 0, "b", "y"), (103, 0, "b", "y"), (103, 0, "a", "x"), (103, 1, "a", "z")]
    rows += [(None, 0, "user", "hi"), (None, 3, "user", "alone"), (None, None, "user", "alone"), (None, None, None, None), (104, 0, "user", "twin"), (None, 0, "user", "twin"), (105, None, None, "x" * 300000)]
    return rows + rows[:3]


@pytest.mark.parametrize(("block", "crowd", "most"), [(1024, 1 << 16, 1 << 20), (2, 2, 3)])
def test_collapse(spark, monkeypatch, block, crowd, most):
    for name, value in (("BLOCK", block), ("CROWD", crowd), ("BROADCAST", most)):
        monkeypatch.setattr(chat_collapse, name, value)
    rows = chats()
    df = spark.createDataFrame([(*x, 0, "b") for x in rows], "conv_id long, turn long, role string, text string, lone int, block string")
    got = collections.Counter((None if r["conv"] == chat_collapse.NO_ID else r["conv"], r["copies"]) for r in chat_collapse.maximal(chat_collapse.rolling(df)[0]).collect())
    want = brute.maximal_chats(rows)
    assert got == want
    out = chat_collapse.render(df).collect()
    assert set(collections.Counter((r["conv_id"], r["copies"]) for r in out)) == set(want)
    kept = {c for c, _ in want}
    lines = collections.Counter((r["conv_id"], x) for r in out for x in r["rendered"].split("<|im_end|>\n")[:-1])
    assert lines == collections.Counter((c, f"<|im_start|>{role or ''}\n{text or ''}") for c, _, role, text in {x for x in rows if x[0] is not None and x[0] in kept} | {(None, 0, *x[2:]) for x in rows if x[0] is None and x[3] != "hi"})
    assert all(r["n_turns"] <= block * crowd for r in out)


def test_parts_equal_the_sql(spark, monkeypatch):
    """Order and numbers of parts included: a conversation of more rows than CROWD, but none of its parts, is cut by turns alone."""
    monkeypatch.setattr(chat_collapse, "BLOCK", 4)
    monkeypatch.setattr(chat_collapse, "CROWD", 4)
    rows = [(c, 5 + t, "user" if t % 2 == 0 else "assistant", f"t{t}") for c in (1, 2) for t in range(30 if c == 1 else 15)] + [(3, t, "user", f"other {t}") for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = sorted(tuple(r) for r in chat_collapse.render(df).select("conv_id", "part", "n_turns", "copies", "rendered").collect())
    duck = duckdb.connect()
    duck.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    assert got == sorted(duck.execute(f"SELECT conv_id, part, n_turns, copies, rendered FROM ({chat_collapse.ORACLE.replace('// 1024', '// 4')})").fetchall()) and len(got) == 11


def test_a_very_long_conversation(spark):
    """70,000 turns, more than CROWD: 69 parts, whole and in order."""
    df = spark.range(70_000).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "concat('t', id) AS text").repartition(3)
    got = {r["part"]: r["rendered"] for r in chat_collapse.render(df).collect()}
    assert sorted(got) == list(range(69)) and "".join(got[k] for k in range(69)) == "".join(f"<|im_start|>user\nt{t}<|im_end|>\n" for t in range(70_000))


def test_only_crowded_parts_are_cut(spark, monkeypatch):
    """A turn with very many rows cuts its own part; the others stay whole and in order."""
    monkeypatch.setattr(chat_collapse, "BLOCK", 4)
    monkeypatch.setattr(chat_collapse, "CROWD", 5)
    rows = [(1, t, "user", f"t{t}") for t in range(12)] + [(1, 5, "user", f"more {k}") for k in range(40)]
    got = {r["part"]: r["rendered"] for r in chat_collapse.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    whole = lambda ts: "".join(f"<|im_start|>user\nt{t}<|im_end|>\n" for t in ts)
    assert got[0] == whole(range(4)) and got[2] == whole(range(8, 12)) and sorted(p % 2**32 for p in got)[1:-1] == [1] * (len(got) - 2)
    assert sorted("".join(got.values()).split("<|im_end|>\n")[:-1]) == sorted(f"<|im_start|>user\n{x}" for _, _, _, x in rows)


def test_rendering(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (None, 0, "user", None), (3, None, None, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat_collapse.render(df).collect()}
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got == {1: (2, turn("user", "a") + turn("assistant", "b")), None: (1, turn("user", "")), 3: (1, turn("", "z"))}
    assert chat_collapse.render(df.limit(0)).count() == 0
