"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training: the documents that may be learnt from are counted by language (two
narrow columns); the ``max_languages`` most frequent ones are learnt, from a
sample of at most about ``per_language`` documents of each, taken by a hash of id
and text (a documented bound; repeated rows are drawn once). Each task counts
hashed n-grams of its part of the sample, and the sums by (language, bucket) make
a matrix of smoothed log probabilities, with the share of each language among
all labelled documents as its prior. The matrix has at most ``CELLS`` floats: with
more than 256 languages there are fewer buckets. Its sums come to the driver as
Arrow columns, at most ``CELLS`` rows of 16 bytes; with four languages some 131,000.

Scoring: the matrix is broadcast; a batch of texts becomes one array of code
points, all n-grams are hashed at once and their rows of the matrix summed by
document. Letters count, all else is a gap; text is lower-cased. Long texts are
hashed in blocks that overlap by the n-grams across their ends.

The score is the posterior of the predicted language from the mean evidence of
an n-gram, taken ``evidence`` times at most, so long texts do not saturate it.

Edge cases: null text or one without letters gives ``und`` with score 0, as do
all texts if nothing can be learnt; an empty table gives an empty result; ties go
to the language first in the alphabet; a null id is neither held out nor learnt
from; repeated rows score alike; other columns, whatever their names, are left
out of the query and kept as they are by `keep_known`.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridane.llm.bpe_speculative import column, slices
from veridane.llm.word_bpe_text import LETTER, char_classes, code_points

ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Characters that are hashed at a time, so memory doesn't follow long texts.
BLOCK = 1 << 18
#: Floats of a model at most, and buckets at most.
CELLS, BUCKETS = 1 << 23, 1 << 15
#: Numbers that scoring holds at a time: texts by languages, and texts by buckets.
SCORED = 1 << 22
GAP = np.uint64(0x20)


def blocks(texts: list[str], size: int | None = None) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """The lower-cased texts in order, cut every `size` characters, in groups of about `size`: (numbers of texts, parts, n-grams that begin in each part).

    A part runs on by the characters that n-grams begun in it need.
    """
    size = size or BLOCK
    numbers, parts, own, held = [], [], [], 0
    for k, text in enumerate(texts):
        text = text.lower()
        for at in range(0, len(text), size):
            numbers.append(k)
            parts.append(text[at : at + size + max(ORDERS) - 1])
            own.append(min(size, len(text) - at))
            held += len(parts[-1])
            if held >= size:
                yield numbers, parts, own
                numbers, parts, own, held = [], [], [], 0
    if parts:
        yield numbers, parts, own


def grams(parts: list[str], own: list[int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, bucket) of every n-gram that begins in the first `own` characters of a part, by part and order."""
    sizes = np.array([len(t) for t in parts], np.int64)
    of = np.repeat(np.arange(len(parts)), sizes)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(np.array(own, np.int64), sizes)
    points = code_points("".join(parts))
    letter = char_classes()[points] == LETTER
    c = np.where(letter, points, GAP).astype(np.uint64)
    found, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    mixed, some = np.zeros(len(c), np.uint64), np.zeros(len(c), bool)
    for n in range(1, max(ORDERS) + 1):
        at = len(c) - n + 1
        if at <= 0:
            break
        mixed = mixed[:at] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(1)
        some = some[:at] | letter[n - 1 :]
        if n in ORDERS:
            ok = some & inside[:at] & (of[:at] == of[n - 1 :])
            h = (mixed + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            found.append(of[:at][ok])
            hashes.append((h[ok] >> np.uint64(40)).astype(np.int64) % buckets)
    return np.concatenate(found), np.concatenate(hashes)


class Model:
    """Languages in order, and log probabilities as buckets x languages."""

    def __init__(self, languages: list[str], log_p: np.ndarray, prior: np.ndarray):
        self.languages, self.log_p, self.prior = languages, log_p, prior

    @functools.cached_property
    def exact(self) -> np.ndarray:
        return self.log_p.astype(np.float64)

    def predict(self, texts: list[str], evidence: int = 64) -> tuple[list[str], np.ndarray]:
        n, k = len(texts), len(self.languages)
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        most = max(1, SCORED // k)
        if n > most:  # so that texts x languages stay bounded
            each = [self.predict(texts[a : a + most], evidence) for a in range(0, n, most)]
            return [x for found, _ in each for x in found], np.concatenate([scores for _, scores in each])
        count, total = np.zeros(n, np.int64), np.zeros((n, k))
        for numbers, parts, own in blocks(texts):
            part, bucket = grams(parts, own, len(self.log_p))
            doc = np.array(numbers)[part]
            count += np.bincount(doc, minlength=n)
            # Counts of texts by buckets, times buckets by languages: one product, whatever the number of languages.
            ids, local = np.unique(numbers, return_inverse=True)
            of, wide = local[part], len(self.log_p)
            step = max(1, SCORED // wide)
            for a in range(0, len(ids), step):
                now = (of >= a) & (of < a + step) if len(ids) > step else slice(None)
                m = min(step, len(ids) - a)
                counts = np.bincount((of[now] - a) * wide + bucket[now], minlength=m * wide).reshape(m, wide)
                total[ids[a : a + m]] += counts.astype(np.float64) @ self.exact
        has = count > 0
        mean = total / np.maximum(count, 1)[:, None]
        z = mean * np.minimum(count, evidence)[:, None] + self.prior
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        best = (total + self.prior).argmax(1)
        score = np.where(has, p[np.arange(n), best], 0.0)
        return [self.languages[j] if ok else UNKNOWN for j, ok in zip(best.tolist(), has.tolist(), strict=True)], score


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 3000, max_languages: int = 1 << 13, smoothing: float = 0.5) -> Model:
    """A model from at most about per_language texts of each of the max_languages most frequent languages in labelled."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    seen = dict(sorted((r["lang"], r["n"]) for r in counts.collect()))
    if not seen:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    buckets = min(BUCKETS, 1 << (CELLS // len(seen)).bit_length() - 1)
    quotas = spark.createDataFrame([(lang, k, per_language / n) for k, (lang, n) in enumerate(seen.items())], "lang string, k int, quota double")
    mark = F.xxhash64("id", "text")
    drawn = rows.withColumn("mark", mark).join(F.broadcast(quotas), "lang").filter(F.pmod("mark", F.lit(1 << 30)) / F.lit(1 << 30) < F.col("quota"))
    sample = drawn.groupBy("k", "mark").agg(F.first("text").alias("text"))
    languages = len(seen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((languages, buckets), np.int64)
        for batch in (y for x in batches for y in slices(x, "text", 4 << 20)):
            lang = column(batch, "k").to_numpy(zero_copy_only=False).astype(np.int64)
            for numbers, parts, own in blocks(column(batch, "text").to_pylist()):
                part, bucket = grams(parts, own, buckets)
                np.add.at(table.reshape(-1), lang[np.array(numbers)][part] * buckets + bucket, 1)
        k, b = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(table[k, b])], names=["k", "b", "n"])

    sums = sample.select("k", "text").mapInArrow(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((buckets, languages), smoothing)
    k, b, n = (sums.column(c).to_numpy() for c in ("k", "b", "n"))
    table[b, k] += n
    prior = np.array(list(seen.values()), float)
    return Model(list(seen), np.log(table / table.sum(0)).astype(np.float32), np.log(prior / prior.sum()))


def predicted(docs: DataFrame, model: Model, text_col: str, lang_out: str, score_out: str) -> DataFrame:
    """docs with two more columns; narrow. The model goes out as one broadcast of bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (y for x in batches for y in slices(x, text_col, 1 << 20)):
            langs, scores = shared.value.predict([t or "" for t in column(batch, text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang_out, score_out])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Is this document kept from training? crc32 of the id as text, modulo folds."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 3000) -> DataFrame:
    """A row for each document: held_out, lang_pred and score."""
    model = train(docs.filter(~held_out(id_col) & F.col(id_col).isNotNull()), id_col, text_col, lang_col, per_language)
    return predicted(docs.select(id_col, text_col), model, text_col, "lang_pred", "score").select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5, per_language: int = 3000) -> DataFrame:
    """The rows of docs whose text is in a known language with a score of at least `least`."""
    model = train(docs.filter(~held_out(id_col) & F.col(id_col).isNotNull()), id_col, text_col, lang_col, per_language)
    names = docs.columns
    numbered = docs.toDF(*[f"c{k}" for k in range(len(names))])
    scored = predicted(numbered, model, f"c{names.index(text_col)}", "lang_pred", "score")
    return scored.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)])
