"""Operator 5: quality classifier by importance resampling.

Two generative models over hashed word n-grams (bags of unigrams and bigrams)
are counted in one pass: the raw model from every document, the target model
from labelled clean documents. A document's log importance weight is the mean of
log(target / raw) over its n-grams, scaled to a text of ``NORMAL_GRAMS`` of them
(the plain sum would rank texts by their length). Documents are drawn without
replacement with probability proportional to their weight by Gumbel top-k: the
k largest values of log weight plus seeded Gumbel noise stay.

k is the number of documents, counted over the whole table, whose log weight
reaches a cut; the cut is calibrated on held-out labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import Scratch, arrow_map, plain_names
from auditframe.llm.textscan import _BASE, mix64, text_slices, word_hashes

BUCKET_BITS = 18
#: Weights are those of a text with so many n-grams; every text counts this many
#: neutral n-grams more, so that a few words are weak evidence.
NORMAL_GRAMS = 200
NEUTRAL_GRAMS = 10
#: Counts that a bucket's target and expected target counts are smoothed by.
PRIOR = 2.0
#: Labelled documents used at most (those with the smallest hash of their id).
LABEL_LIMIT = 20_000
#: One labelled document in so many calibrates the cut and is kept out of the target model.
HOLD_OUT = 4
#: Resolution of the sampling key: keys are compared as integers.
KEY_UNITS = 1_000_000
_SELECT_BINS = 1 << 16


@dataclass(frozen=True)
class Labels:
    """A bounded sample of labelled ids, ascending; good: clean; hold: held out."""

    ids: np.ndarray
    good: np.ndarray
    hold: np.ndarray

    def match(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows with a label, their places in the sample)."""
        known = np.asarray(ids.is_valid())
        values = np.asarray(ids.fill_null(0))
        at = np.minimum(np.searchsorted(self.ids, values), max(len(self.ids) - 1, 0))
        rows = np.flatnonzero(known & (self.ids[at] == values)) if len(self.ids) else np.zeros(0, np.int64)
        return rows, at[rows]


def sample_labels(labels: DataFrame, limit: int = LABEL_LIMIT) -> Labels:
    """``labels`` (doc_id, quality, toxic): clean means quality 1 and not toxic;
    quality 0 is the contrast; other rows and null ids are not used. Of repeated
    ids the worst label counts."""
    rows = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .where("quality = 0 or toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        .select("doc_id", (F.col("quality") == 1).alias("good"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HOLD_OUT)) == 0).alias("hold"))
        .toArrow()
    )
    ids, good, hold = (np.asarray(rows.column(i)) for i in range(3))
    order = np.argsort(ids)
    return Labels(ids[order], good[order].astype(bool), hold[order].astype(bool))


def _grams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, n-gram buckets, row of each n-gram) of consecutive runs of rows.

    Case is part of a word here, unlike in the deduplication operators."""
    shift = np.uint64(64 - BUCKET_BITS)
    for first, raw, offs in text_slices(texts):
        words, at = word_hashes(raw, offs, lower=False)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(at))
        pair = row[1:] == row[:-1]
        two = mix64(words[:-1] * np.uint64(_BASE) + words[1:])[pair]
        yield first, np.concatenate([words >> shift, two >> shift]).astype(np.int64), np.concatenate([row, row[1:][pair]])


def ngram_counts(docs: DataFrame, labels: Labels, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(raw, target) counts per bucket over all documents. Each task adds up its
    own vectors; the sums per bucket (a fixed number) come to the driver."""
    size = 1 << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            rows, at = labels.match(batch.column(0))
            train = np.zeros(batch.num_rows, bool)
            train[rows[labels.good[at] & ~labels.hold[at]]] = True
            for first, bucket, row in _grams(batch.column(1)):
                raw += np.bincount(bucket, minlength=size)
                chosen = train[first + row]
                if chosen.any():
                    target += np.bincount(bucket[chosen], minlength=size)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    sums = (
        docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(run, "bucket bigint, raw bigint, target bigint").groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    )
    raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = np.asarray(sums.column(0))
    raw[at], target[at] = np.asarray(sums.column(1)), np.asarray(sums.column(2))
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(p_target / p_raw) per bucket: the target count against the count that
    the raw model expects of as many n-grams, both smoothed by ``PRIOR``."""
    expected = raw * (target.sum() / max(raw.sum(), 1))
    return np.log(target + PRIOR) - np.log(expected + PRIOR)


def _weights(texts: pa.Array, ratios: np.ndarray) -> np.ndarray:
    total, grams = np.zeros(len(texts)), np.full(len(texts), NEUTRAL_GRAMS, np.int64)
    for first, bucket, row in _grams(texts):
        if len(row):
            part = np.bincount(row, weights=ratios[bucket])
            total[first:first + len(part)] += part
            grams[first:first + len(part)] += np.bincount(row)
    return NORMAL_GRAMS * total / grams


def _noise(id_hash: np.ndarray) -> np.ndarray:
    """Standard Gumbel noise from a 64-bit hash."""
    u = (id_hash.view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5
    return -np.log(-np.log(u / 2.0**53))


def _keys(weights: np.ndarray, id_hash: np.ndarray) -> np.ndarray:
    return np.rint((weights + _noise(id_hash)) * KEY_UNITS).astype(np.int64)


def _id_hash(c: Column, seed: int) -> Column:
    return F.xxhash64(c, F.lit(seed))


def kth_largest(values: DataFrame, col: str, k: int) -> int:
    """Exact k-th largest of a bigint column by narrowing a fixed number of bins;
    only bin counts reach the driver. 1 <= k <= number of rows."""
    lo, hi = values.agg(F.min(col), F.max(col)).first()
    while lo < hi:
        width = -(-(hi - lo + 1) // _SELECT_BINS)
        part = values.where(F.col(col).between(lo, hi))
        counts = part.groupBy(F.expr(f"({col} - ({lo})) div {width}").alias("bin")).count().collect()
        for b, n in sorted(counts, reverse=True):
            if k <= n:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            k -= n
    return lo


def calibrated_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """Cut with the best balanced accuracy on held-out documents; of a range of
    equally good cuts its middle. Without both classes nothing is cut."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(weights)
    w, g = weights[order], good[order]
    low_bad = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    low_good = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    edges = np.concatenate([[w[0] - 1], (w[1:] + w[:-1]) / 2, [w[-1] + 1]])
    score = low_bad - low_good
    score[1:-1][w[1:] == w[:-1]] = -1
    best = np.flatnonzero(score >= score.max() - 1e-12)
    return float(edges[best[len(best) // 2]])


@dataclass(frozen=True)
class Resampler:
    """Fitted model: per-bucket log ratios, the cut, k, and the key of the k-th document."""

    ratios: np.ndarray
    cut: float
    k: int
    least_key: int
    seed: int


def fit(
    scratch: Scratch, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_limit: int = LABEL_LIMIT, seed: int = 0,
) -> tuple[Resampler, DataFrame]:
    """The model and the scored table (id, log_weight, key) of all documents."""
    sample = sample_labels(labels, label_limit)
    ratios = log_ratios(*ngram_counts(docs, sample, id_col, text_col))

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        weights = _weights(batch.column(1), ratios)
        rows, at = sample.match(batch.column(0))
        held = np.zeros(batch.num_rows, np.int8)
        held[rows] = np.where(sample.hold[at], np.where(sample.good[at], 1, 2), 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(weights), pa.array(_keys(weights, np.asarray(batch.column(2)))), pa.array(held.astype(np.int32))],
            names=["id", "log_weight", "key", "held"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), _id_hash(F.col(id_col), seed).alias("h"))
    scored = scratch.write(arrow_map(rows, score, "id bigint, log_weight double, key bigint, held int"))
    # at most label_limit distinct documents; repeated rows of one id count once
    held = scored.where("held > 0").groupBy("id").agg(F.max("log_weight").alias("w"), F.max("held").alias("held")).toArrow()
    cut = calibrated_cut(np.asarray(held.column(1)), np.asarray(held.column(2)) == 1)
    k = scored.where(F.col("log_weight") >= cut).count()
    least = kth_largest(scored, "key", k) if k else 2**63 - 1
    return Resampler(ratios, cut, k, least, seed), scored


def resample(
    scratch: Scratch, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options,
) -> DataFrame:
    """(id, log_weight, gumbel_key, kept) per row of ``docs``.

    Null or blank text has no n-gram and log weight 0. Rows that repeat an id
    share its noise. Documents that tie with the k-th key all stay. Without
    usable labels of both kinds every document stays. Extra columns are ignored;
    an empty table gives an empty result."""
    model, scored = fit(scratch, docs, labels, id_col, text_col, **options)
    return scored.select("id", "log_weight", (F.col("key") / KEY_UNITS).alias("gumbel_key"), (F.col("key") >= model.least_key).alias("kept"))


def keep_resampled(
    scratch: Scratch, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options,
) -> DataFrame:
    """The rows of ``docs`` (all columns) that the resampling keeps: the keys are
    computed again from the fitted model, so no row has to be found by its id."""
    names, docs = docs.columns, plain_names(docs)
    id_col, text_col = (f"c{names.index(c)}" for c in (id_col, text_col))
    model, scored = fit(scratch, docs, labels, id_col, text_col, **options)
    scratch.drop(scored)
    text_at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = _keys(_weights(batch.column(text_at), model.ratios), np.asarray(batch.column(batch.num_columns - 1)))
        yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keys >= model.least_key))

    return arrow_map(docs.select("*", _id_hash(docs[id_col], model.seed).alias("id_hash")), run, docs.schema).toDF(*names)
