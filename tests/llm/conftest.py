import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, fp string, found string, c0 string, kind string, bucket string, score string"


def documents():
    """Rows with nulls in any column, empty, blank and very long texts, ties, repeated rows, copies and near copies."""
    r = random.Random(11)
    words = [w + x for w in ("the", "of", "ing", "er", "ça", "über", "ñan", "tion", "sh", "ly") for x in ("", "a", "on", "é", "st", "re")]
    text = lambda n: " ".join(r.choice(words) for _ in range(n)) + ".\n" + " ".join(r.choice(words) for _ in range(n))
    base = [text(r.randint(30, 120)) for _ in range(25)]
    texts = [*base, None, "", " \n\t", "x", "one two", "!!! ... 123", "é" * 40, "<|endoftext|> a<|endoftext|>", "Mixed CASE Words don't they're"]
    texts += [base[0], base[0], base[1] + " extra", base[1].replace("the", "then", 1), base[2].upper()]
    texts += ["mail a.b@c.de and x@y.zz.top 10.0.0.255 or 300.1.1.1 then 1.2.3.4.5 card 4111 1111 1111 1111 call +1 (555) 123-4567 end a@b.c_d@e.f"]
    texts += ["Released under the MIT License.", "licensed under the Apache  License, Version 2.0; GNU General Public License MIT LICENSE mit license", "Licensed under really CC BY-NC 4.0"]
    texts += ["word " * 40000, "q" * 60000, "7" * 30000, "a@" * 20000, "x@y" + ".z" * 30000, " ".join(f"w{k % 977}" for k in range(30000)), "+1" + "(" * 30000]
    rows = [(k, t, r.choice(["en", "fr", "de", None]), "s", len(t or ""), k, None, "f", "c", "k", None, "s") for k, t in enumerate(texts)]
    return [*rows, rows[0], rows[25], (900, None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([*rows, (None, "a null id", "en", *[None] * 9), (None, rows[3][1], None, *[None] * 9)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def unique(spark, rows):
    """The rows with distinct ids, without null ids."""
    seen = {}
    for r in rows:
        seen.setdefault(r[0], r)
    return spark.createDataFrame(list(seen.values()), SCHEMA).repartition(3), [(r[0], r[1]) for r in seen.values()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
