"""Quality classifier by importance resampling.

Words and punctuation runs, and pairs of neighbours, are hashed into a fixed number
of buckets. Two bag models are fitted: the target from documents labelled good
(and not toxic), the raw one from the whole corpus. A bucket's ratio of target to
raw has a gamma prior of mean 1, so a bucket that the raw text seldom fills says
little. A document's importance weight is the ratio of its likelihoods under the
two, taken at the length of ``LENGTH`` features so that long documents are not
judged by their length; adding Gumbel noise to the log weights and keeping the k
largest draws k documents without replacement in proportion to their weights.

A few toxic words vanish in a document's mean, so they are evidence of their own:
the ratio of documents labelled toxic to all documents that hold a feature, taken
at the document's strongest feature. Where it exceeds the level that ``KEEP_GOOD``
of the held-out good documents stay within, the excess lowers the log weight as
if the whole length were of that ratio.

Counts cover every document. The labelled sample is bounded (``MAX_LABELS``
documents, by id hash) and joined by broadcast; so are the models, whose size is
the bucket count. Without a given k, k is the number of documents whose noisy
weight reaches the level that ``KEEP_GOOD`` of the labelled good documents reach;
one half of the sample fits the target, the other half sets that level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.ordering import dense_index
from .common import hashed_words, mix, slices, written

BUCKETS = 1 << 18
MAX_LABELS = 20_000
PRIOR = 1.0                     # strength of the ratio's prior, in target features
LENGTH, SHRINK = 100.0, 20.0    # features that a weight stands for; features of ratio 1 added to every document
KEEP_GOOD = 0.995
TOXIC_BUCKETS = 1 << 22         # finer, as a collision would lend a good word a toxic one's ratio
TOXIC_PRIOR = 5.0               # strength of the toxic ratio's prior, in documents labelled toxic
TOKEN = re.compile(r"\w+|[^\w\s]+")


def features(texts) -> tuple[np.ndarray, np.ndarray]:
    """Fine buckets (of TOXIC_BUCKETS; modulo BUCKETS they are the coarse ones) of
    all features of the texts in a row, and the features of each."""
    found, sizes = [], []
    for a, b in slices(texts):
        words, lens = hashed_words([TOKEN.findall(t) if t else [] for t in texts[a:b]])
        place = np.arange(len(words)) - np.repeat(np.cumsum(lens) - lens, lens)
        pairs = mix(np.concatenate([np.zeros(1, np.uint64), words])[:-1] * np.uint64(0x9E3779B97F4A7C15) + words)[: len(words)]
        both = np.stack([words, pairs], 1).ravel()[np.stack([place >= 0, place > 0], 1).ravel()]
        found.append((both % np.uint64(TOXIC_BUCKETS)).astype(np.int32))
        sizes.append(np.maximum(2 * lens - 1, 0))
    return (np.concatenate(found), np.concatenate(sizes)) if found else (np.empty(0, np.int32), np.empty(0, np.int64))


def labelled_sample(labels: DataFrame, id_col: str = "doc_id", limit: int = MAX_LABELS) -> DataFrame:
    """(id, good, toxic, fits) of at most ``limit`` labelled documents, the first by
    id hash; ``fits`` is true for the half that fits the target. An id with several
    labels is good only if all are, and toxic if any is."""
    toxic = F.coalesce("toxic", F.lit(0)) != 0
    good = F.coalesce((F.col("quality") == 1) & ~toxic, F.lit(False))
    per = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(good).alias("good"), F.max(toxic).alias("toxic"))
    return per.orderBy(F.xxhash64("id"), "id").limit(limit).withColumn("fits", F.xxhash64(F.lit("half"), "id") < 0)


def holders(found: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, n): how many documents hold each fine bucket, from features as ``features`` has them."""
    pairs = np.unique(np.repeat(np.arange(len(sizes)) * TOXIC_BUCKETS, sizes) + found)
    return np.unique(pairs & (TOXIC_BUCKETS - 1), return_counts=True)


def toxic_holders(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(buckets, toxic, n) from rows (text, toxic): the fine buckets that two or more
    documents labelled toxic hold, how many do, and the number of such documents.
    What a single one holds says nothing."""
    def count(batches):
        held, n = np.zeros(TOXIC_BUCKETS, np.int32), 0
        for frame in batches:
            texts = frame["text"].tolist()
            for a, b in slices(texts):
                at, more = holders(*features(texts[a:b]))
                held[at] += more
            n += len(frame)
        at = np.flatnonzero(held)
        yield pd.DataFrame({"bucket": np.append(at, -1).astype(np.int32), "n": np.append(held[at], n)})     # -1: documents

    counts = rows.where("toxic").select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = counts.where("n > 1 or bucket = -1").toPandas()           # at most TOXIC_BUCKETS rows, of a bounded sample
    at = got["bucket"].to_numpy() >= 0
    return got["bucket"].to_numpy()[at], got["n"].to_numpy()[at], int(got["n"].to_numpy()[~at].sum())


def fit(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log ratio of target to raw by bucket, and the fine buckets whose ratio of toxic
    to raw is more than even with these, from rows (text, target, toxic)."""
    buckets, toxic, n_toxic = toxic_holders(rows)
    shared = rows.sparkSession.sparkContext.broadcast(buckets)

    def count(batches):
        asked = np.zeros(TOXIC_BUCKETS, bool)
        asked[shared.value] = True
        raw, target, held, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), np.zeros(TOXIC_BUCKETS, np.int32), 0
        for frame in batches:
            texts, good = frame["text"].tolist(), frame["target"].to_numpy(bool)
            n += len(frame)
            for a, b in slices(texts):
                found, sizes = features(texts[a:b])
                of = np.flatnonzero(asked[found])
                docs = np.searchsorted(np.cumsum(sizes), of, "right")
                at, more = holders(found[of], np.bincount(docs, minlength=len(sizes)))
                held[at] += more
                found &= BUCKETS - 1
                raw += np.bincount(found, minlength=BUCKETS)
                target += np.bincount(found[np.repeat(good[a:b], sizes)], minlength=BUCKETS)
        at, fine = np.flatnonzero(raw), np.flatnonzero(held)
        # below 0: fine buckets, and at the end the documents
        yield pd.DataFrame({"bucket": np.concatenate([at, -1 - fine, [-1 - TOXIC_BUCKETS]]).astype(np.int32), "raw": np.concatenate([raw[at], held[fine], [n]]),
                            "target": np.concatenate([target[at], np.zeros(len(fine) + 1, np.int64)])})

    counts = rows.select("text", "target").mapInPandas(count, "bucket int, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    got = counts.toPandas()             # at most BUCKETS rows, and one for each bucket of the toxic sample
    coarse = got[got["bucket"] >= 0]
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[coarse["bucket"]], target[coarse["bucket"]] = coarse["raw"], coarse["target"]
    expected = raw * target.sum() / max(raw.sum(), 1)
    # only the toxic sample's buckets are looked up, so no table of all fine buckets stands on the driver
    fine = got[got["bucket"] < 0].sort_values("bucket", ascending=False)
    place, held = -1 - fine["bucket"].to_numpy(np.int64), fine["raw"].to_numpy(float)
    documents = held[-1] if len(place) and place[-1] == TOXIC_BUCKETS else 0.0
    at = np.minimum(np.searchsorted(place, buckets), max(len(place) - 1, 0))
    of_bucket = np.where(place[at] == buckets, held[at], 0.0) if len(place) else np.zeros(len(buckets))
    ratios = np.maximum(np.log((toxic + TOXIC_PRIOR) / (of_bucket * n_toxic / max(documents, 1) + TOXIC_PRIOR)), 0).astype(np.float32)
    some = np.flatnonzero(ratios)
    return np.log((target + PRIOR) / (expected + PRIOR)).astype(np.float32), buckets[some].astype(np.int32), ratios[some]


def log_weight(spark, models: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """A column function: text -> struct(n_features, mean, toxicity): the log weight
    by the document's mean, and the toxic ratio of its strongest feature."""
    shared = spark.sparkContext.broadcast(models)           # BUCKETS floats, and the toxic sample's buckets

    @F.pandas_udf("n_features long, mean double, toxicity double")
    def weigh(chunks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, at, ratios = shared.value
        bad = np.zeros(TOXIC_BUCKETS, np.float32)
        bad[at] = ratios
        for texts in chunks:
            texts, parts = texts.tolist(), []
            for a, b in slices(texts):
                found, sizes = features(texts[a:b])
                ends = np.cumsum(sizes)
                strongest, some = np.zeros(len(sizes)), sizes > 0
                if some.any():
                    strongest[some] = np.maximum.reduceat(bad[found], (ends - sizes)[some])
                upto = np.concatenate([[0.0], np.cumsum(model[found & (BUCKETS - 1)], dtype=np.float64)])
                parts.append(pd.DataFrame({"n_features": sizes, "mean": (upto[ends] - upto[ends - sizes]) * LENGTH / (sizes + SHRINK), "toxicity": strongest}))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"n_features": [], "mean": [], "toxicity": []})

    return weigh


def gumbel(*cols) -> F.Column:
    """Standard Gumbel noise fixed by the row's id and text."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), *cols), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col(f"row.`{text_col}`").cast("string")
    return packed.select("row", F.col(f"row.`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def fit_and_weigh(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  max_labels: int = MAX_LABELS) -> DataFrame:
    """(row, id, h, sets_level, n_features, mean, toxicity); row holds all columns of ``docs``."""
    sample = F.broadcast(labelled_sample(labels, id_col, max_labels))     # at most max_labels ids
    rows = _rows(docs, id_col, text_col).join(sample, "id", "left")
    marks = [F.coalesce(c, F.lit(False)).alias(name) for c, name in ((F.col("good") & F.col("fits"), "target"), (F.col("toxic"), "toxic"))]
    weigh = log_weight(docs.sparkSession, fit(rows.select("text", *marks)))
    return rows.withColumn("w", weigh("text")).select("row", "id", "h", (F.col("good") & ~F.col("fits")).alias("sets_level"), "w.*")


def with_weights(weighed: DataFrame, level: float | None) -> DataFrame:
    """``weighed`` with log_weight and noisy_weight in place of mean and toxicity;
    ``level`` is the toxicity that costs nothing (None: none costs)."""
    over = F.greatest(F.col("toxicity") - F.lit(level), F.lit(0.0)) if level is not None else F.lit(0.0)
    return (weighed.withColumn("log_weight", F.col("mean") - F.lit(LENGTH) * over)
            .withColumn("noisy_weight", F.col("log_weight") + gumbel("id", "h")).drop("mean", "toxicity"))


def draw(weighed: DataFrame, k: int | None = None) -> tuple[DataFrame, float, float | None]:
    """(ranked, cut, level): the rows (id, h, sets_level, n_features, log_weight,
    noisy_weight) with their 0-based rank by noisy weight, the noisy weight of the
    k-th, and the toxicity that costs nothing. The cut is set without regard to
    toxicity: the good documents that it costs must not pull the cut down."""
    kept = written(weighed.drop("row"), "importance")
    held_out = kept.where("sets_level")
    least, level = held_out.withColumn("noisy", F.col("mean") + gumbel("id", "h")).agg(
        F.expr(f"percentile(noisy, {1 - KEEP_GOOD})"), F.expr(f"percentile(toxicity, {KEEP_GOOD})")).first()
    scored = with_weights(kept, level)
    if k is None:
        k = scored.count() if least is None else scored.where(F.col("noisy_weight") >= least).count()
    ranked = dense_index(scored, [F.col("noisy_weight").desc(), F.col("id").asc_nulls_first(), "h"], "rank")
    last = ranked.where(F.col("rank") < k).agg(F.min("noisy_weight")).first()[0]
    return ranked, float("inf") if last is None else last, level


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None,
             max_labels: int = MAX_LABELS) -> DataFrame:
    """(id, n_features, log_weight, noisy_weight, rank, kept) of every row.

    A null or empty text has no features and weight 0. Repeated rows have equal
    noise and are drawn together. Without a labelled good document all weights are
    even and, unless k is given, all documents are kept.
    """
    ranked, cut, _ = draw(fit_and_weigh(docs, labels, id_col, text_col, max_labels), k)
    return ranked.select(F.col("id").alias(id_col), "n_features", "log_weight", "noisy_weight", "rank",
                         (F.col("noisy_weight") >= cut).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None,
              max_labels: int = MAX_LABELS) -> DataFrame:
    """The rows of ``docs`` that resampling draws, with all their columns. The
    texts are weighed again rather than shuffled to their ranks."""
    weighed = fit_and_weigh(docs, labels, id_col, text_col, max_labels)
    _, cut, level = draw(weighed, k)
    return with_weights(weighed, level).where(F.col("noisy_weight") >= cut).select("row.*")
