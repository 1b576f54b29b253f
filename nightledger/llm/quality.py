"""Quality by positive-unlabelled learning.

Trusted positives are documents labelled 1; everything else about the web is unlabelled, with
good and bad mixed.  A pilot classifier tells positives from unlabelled text.  On any region of
its scores the unlabelled share is at least ``prior`` times the positive share, so the smallest
ratio over the upper regions estimates the class prior; the histograms behind it run over all
documents.  A linear model over shape statistics (and their squares) then minimises the
non-negative unbiased risk

    prior * E+[l(g)] + max(0, Eu[l(-g)] - prior * E+[l(-g)])

with logistic loss: where the second term would fall below zero, its gradient is climbed instead.

The fit sees at most ``POSITIVES`` positives and ``UNLABELLED`` unlabelled rows on average, drawn
by hash.  Statistics are taken from whole texts, once, and written.

Edge cases: a null or empty text has statistics 0 and is scored by them; without a positive the
score is the share of labels 1 that is known, 0.5; null ids and repeated rows are scored as any
row; an empty table gives an empty result; other columns are ignored (kept by :func:`keep`).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightledger.llm.common import fold, one_label, prepare, store, table

POSITIVES = UNLABELLED = 20_000
BINS = 1_000
#: Regions with a smaller share of the positives say too little about the prior.
LEAST_REGION = 0.2
STEPS, RATE, SHRINK = 400, 0.05, 1e-3
THRESHOLD = 0.3
#: Standardised statistics are held within this, so that no single one decides.
CLIP = 3.0

UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
STOPS = b".,;:!?'\"()-"
SYMBOLS = bytes(set(range(33, 127)) - set(UPPER) - set(range(97, 123)) - set(DIGITS) - set(b".,;:?'\"()-"))
#: Words without a letter or digit, as between the cells of a table.
BARE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)").finditer
STATISTICS = (
    "log_words", "word_length", "distinct_words", "upper", "digits", "stops", "symbols", "odd_words",
    "log_lines", "repeated_lines", "repeated_neighbours", "log_line_length", "compressed",
    "bare_marks",
)


def statistics(text) -> list[float]:
    """Shape statistics of one text, in the order of ``STATISTICS``."""
    if not isinstance(text, str) or not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    words = text.lower().split()
    kinds, n = set(words), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]

    def share(chars: bytes) -> float:
        return 1 - len(raw.translate(None, chars)) / len(raw)

    squeezed = zlib.compressobj(1)
    size = len(squeezed.compress(raw)) + len(squeezed.flush())
    return [
        float(np.log1p(len(words))),
        len(text) / n,
        len(kinds) / n,
        share(UPPER),
        share(DIGITS),
        share(STOPS),
        share(SYMBOLS),
        sum(not x.isalpha() for x in kinds) / max(1, len(kinds)),
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        float(np.log1p(len(text) / max(1, len(lines)))),
        min(0.6, size / len(raw)),  # above it lie short texts only
        float(np.log1p(100 * sum(1 for _ in BARE(text)) / n)),
    ]


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64")})
        out["x"] = [statistics(t) for t in batch["text"]]
        yield out


def measured(documents: DataFrame) -> DataFrame:
    """doc_id and statistics ``x`` of every row, written once."""
    prepare(documents.sparkSession)
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return store(plain.mapInPandas(_measure, "doc_id long, x array<double>"), "quality")


@dataclass
class Model:
    """Weights over the standardised statistics and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float = 0.5

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.hstack([z, z * z, np.ones((len(z), 1))])

    def score(self, x: Column) -> Column:
        """The score as a Spark expression over the array of statistics."""
        g = F.lit(float(self.weights[-1]))
        k = len(self.mean)
        for i in range(k):
            z = (F.element_at(x, i + 1) - float(self.mean[i])) / float(self.scale[i])
            z = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), z))
            g = g + z * (F.lit(float(self.weights[i])) + z * float(self.weights[k + i]))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-g))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _descend(gradient, size: int) -> np.ndarray:
    """Adam over full batches, from zero: the same data give the same weights.

    ``gradient`` gives the risk and its gradient; the weights of least risk are returned, since
    climbing back from a negative term may end anywhere."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    least, best = np.inf, w
    for t in range(1, STEPS + 1):
        risk, g = gradient(w)
        risk += SHRINK / 2 * (w[:-1] ** 2).sum()
        if risk < least:
            least, best = risk, w
        g = g + SHRINK * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return best


def pilot(positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """Weights that tell positives from unlabelled rows, both sides weighing the same."""

    def gradient(w):
        gp, gu = positive @ w, unlabelled @ w
        risk = np.logaddexp(0, -gp).mean() + np.logaddexp(0, gu).mean()
        return risk, (positive * (_sigmoid(gp) - 1)[:, None]).mean(0) + (unlabelled * _sigmoid(gu)[:, None]).mean(0)

    return _descend(gradient, positive.shape[1])


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """From histograms of the pilot's scores over all rows of either kind."""
    p = positive[::-1].cumsum() / max(1, positive.sum())
    u = unlabelled[::-1].cumsum() / max(1, unlabelled.sum())
    some = p >= LEAST_REGION
    return float(np.clip((u[some] / p[some]).min(), 0.01, 0.99))


def non_negative(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Weights of least non-negative unbiased risk."""

    def gradient(w):
        gp, gu = positive @ w, unlabelled @ w
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        of_negative = (unlabelled * _sigmoid(gu)[:, None]).mean(0) - prior * (positive * _sigmoid(gp)[:, None]).mean(0)
        risk = prior * np.logaddexp(0, -gp).mean() + max(0.0, negative)
        if negative < 0:
            return risk, -of_negative
        return risk, prior * (positive * (_sigmoid(gp) - 1)[:, None]).mean(0) + of_negative

    return _descend(gradient, positive.shape[1])


def _drawn(frame: DataFrame, most: int) -> np.ndarray:
    """About ``most`` rows by hash, or all where there are fewer."""
    n = frame.count()
    draw = F.pmod(F.xxhash64("doc_id", "x"), F.lit(1 << 30)) / float(1 << 30)
    rows = frame.where(draw * float(n) < float(most)).select("x").toPandas()["x"]
    return np.array([list(r) for r in rows], dtype=float).reshape(len(rows), len(STATISTICS))


def fit(statistics_: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """``statistics_``: measured rows that may be learned from; ``labels``: doc_id, label."""
    good = statistics_.join(labels.where("label = 1").select("doc_id"), "doc_id")
    p, u = _drawn(good, positives), _drawn(statistics_, unlabelled)
    width = 2 * len(STATISTICS) + 1
    if not len(p) or not len(u):
        return Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), np.zeros(width))
    model = Model(u.mean(0), np.maximum(u.std(0), 1e-3), np.zeros(width))
    ep, eu = model.expand(p), model.expand(u)
    model.weights = pilot(ep, eu)

    def histogram(frame: DataFrame) -> np.ndarray:
        bucket = F.least(F.floor(model.score(F.col("x")) * BINS), F.lit(BINS - 1)).cast("int")
        out = np.zeros(BINS)
        for b, n in frame.groupBy(bucket.alias("b")).count().collect():
            out[b] = n
        return out

    model.prior = estimated_prior(histogram(good), histogram(statistics_))
    model.weights = non_negative(ep, eu, model.prior)
    return model


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score of every row; learns outside the held-out fifth only."""
    rows = measured(documents)
    held_out = fold(F.col("doc_id"), 5) == 0
    model = fit(rows.where(~held_out), one_label(labels, "quality"))
    return rows.select("doc_id", held_out.alias("held_out"), model.score(F.col("x")).alias("score"))


def keep(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with their own columns.

    Statistics are computed beside the row here, so that the texts are not shuffled."""
    rows = measured(documents)
    model = fit(rows.where(fold(F.col("doc_id"), 5) != 0), one_label(labels, "quality"))
    rate = F.pandas_udf(_rate, "array<double>")
    return documents.where(model.score(rate(F.col("text"))) >= threshold)


def _rate(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts], index=texts.index, dtype=object)


def query(spark, folder):
    """Quality of every document; accepted from 0.3 on."""
    scored = score(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
