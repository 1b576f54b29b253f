"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The distinct whole vectors, centred by their exact mean, are the rows of a matrix X that stays
distributed.  Each step is one pass: every block of rows forms ``u = X w`` and returns its share of
``X' u``, of ``u' u`` and of the products of ``u`` with all earlier left vectors, which Spark adds up.
The driver holds right vectors, coefficients and a bidiagonal matrix, all of the width of a vector.

Left vectors are never stored: ``u`` of step j is ``X w`` for a short ``w`` that the recurrence
yields, so every pass recomputes them from the blocks, and an executor lost costs its tasks only.
Both sides are reorthogonalised against everything before in each step; a step that loses most of
its length to that is repeated.  Where a space is used up (equal eigenvalues, constant dimensions),
the next step starts from a new direction.  All directions are taken, so the factorisation is
complete, and the singular values of the small bidiagonal matrix are those of X.

Edge cases: a vector that is null or holds null or non-finite entries is dropped; a shorter vector
counts as followed by zeros; repeated rows and ids are returned each but fitted once; a null id is
kept; components without variance (fewer distinct vectors than components, constant dimensions)
are left out; deviations beyond a long saturate; entries beyond 2^53 are rounded in products;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.llm.common import prepare, store, table

SCALE, COMPONENTS, BLOCK = 256, 4, 4_096
#: Lengths below this share of the largest met count as none.
NOTHING = 1e-13
LONGEST = (1 << 63) - 1
OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """What was fitted: count and sums of the distinct vectors, unit components by falling
    variance (rows), their variances, and the total variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and whole entries ``x`` of the vectors that take part."""
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    rows = vectors.where("embedding IS NOT NULL").where(~odd)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def matrix(column: pd.Series, width: int, kind: str = "<i8") -> np.ndarray:
    out = np.zeros((len(column), width), kind)
    for row, x in zip(out, column):
        row[: len(x)] = x
    return out


def _packed(width: int, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                x = matrix(batch["x"].iloc[at : at + BLOCK], width, kind)
                yield pd.DataFrame({"rows": [len(x)], "x": [x.tobytes()]})

    return run


class Blocks:
    """The distinct vectors as a stored table of blocks, and sums over it."""

    def __init__(self, frame: DataFrame, width: int, kind: str):
        self.frame, self.width, self.kind = frame, width, kind
        self.mean = np.zeros(width)

    def total(self, function, kind: str = "double") -> list:
        """Sums, place by place, of the lists that ``function`` makes of each block."""
        width, own, mean = self.width, self.kind, self.mean

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = None
            for batch in batches:
                for data in batch["x"]:
                    x = np.frombuffer(data, own).reshape(-1, width)
                    part = function(x if kind != "double" else x - mean)
                    sums = part if sums is None else sums + part
            if sums is not None:
                values = sums if kind == "double" else [Decimal(int(s)) for s in sums]
                yield pd.DataFrame({"place": np.arange(len(sums), dtype=np.int32), "value": values})

        parts = self.frame.select("x").mapInPandas(run, f"place int, value {kind}")
        return [r.value for r in sorted(parts.groupBy("place").agg(F.sum("value").alias("value")).collect())]

    def sums(self) -> list[int]:
        wide = self.kind == "<i8"

        def each(x: np.ndarray) -> np.ndarray:
            return np.array([sum(map(int, c)) for c in x.T], object) if wide else x.sum(0, dtype=np.int64).astype(object)

        return [int(s) for s in self.total(each, "decimal(38,0)")]

    def products(self, w: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """X'u, products with the earlier left vectors ``X earlier``, and u'u, for ``u = X w``."""
        d, m = self.width, earlier.shape[1]

        def each(x: np.ndarray) -> np.ndarray:
            u = x @ w
            return np.concatenate([x.T @ u, (x @ earlier).T @ u, [u @ u]])

        out = np.array(self.total(each))
        return out[:d], out[d : d + m], float(out[-1])


def _fresh(rng: np.random.Generator, basis: np.ndarray) -> np.ndarray:
    """A unit vector at right angles to the columns of ``basis``."""
    v = rng.normal(size=basis.shape[0])
    for _ in range(3):
        v -= basis @ (basis.T @ v)
        v /= np.linalg.norm(v)
    return v


def bidiagonalise(blocks: Blocks, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors V (columns) and the upper bidiagonal B with ``X V = U B``, for orthonormal U."""
    d, rng = blocks.width, np.random.default_rng(seed)
    right, b = np.zeros((d, d)), np.zeros((d, d))
    # u = X w and X'u of the left vectors so far; those of steps without one stay zero.
    left, images = np.zeros((d, d)), np.zeros((d, d))
    v, beta, largest = _fresh(rng, right[:, :0]), 0.0, 0.0
    for j in range(d):
        right[:, j] = v
        w = v - beta * left[:, j - 1] if j else v
        while True:
            image, along, square = blocks.products(w, left[:, :j])
            w, image = w - left[:, :j] @ along, image - images[:, :j] @ along
            rest = square - along @ along
            if square <= (NOTHING * largest) ** 2 or rest > 0.5 * square:
                break
        alpha = np.sqrt(max(rest, 0.0))
        largest = max(largest, alpha)
        following = None
        if alpha > NOTHING * largest:
            b[j, j] = alpha
            left[:, j], images[:, j] = w / alpha, image / alpha
            following = images[:, j] - alpha * v
            for _ in range(2):
                following -= right[:, : j + 1] @ (right[:, : j + 1].T @ following)
            beta = float(np.linalg.norm(following))
        if j + 1 == d:
            break
        if following is not None and beta > NOTHING * largest:
            b[j, j + 1], v = beta, following / beta
            largest = max(largest, beta)
        else:
            beta, v = 0.0, _fresh(rng, right[:, : j + 1])
    return right, b


def fit(rows: DataFrame, components: int) -> Whitening | None:
    """Whitening of the distinct vectors ``x`` of ``rows``; None where there are none."""
    ends = rows.agg(F.max(F.size("x")).alias("d"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high")).first()
    if not ends.d:
        return None
    largest = max(-ends.low, ends.high)
    kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(ends.d) - F.size("x")))
    distinct = rows.select(padded.alias("x")).distinct()
    blocks = Blocks(store(distinct.mapInPandas(_packed(ends.d, kind), "rows int, x binary"), "blocks"), ends.d, kind)
    n = blocks.frame.agg(F.sum("rows")).first()[0]
    sums = blocks.sums()
    blocks.mean = np.array([s / n for s in sums])
    right, b = bidiagonalise(blocks)
    _, deviations, turned = np.linalg.svd(b)
    total = float((deviations**2).sum() / n)
    kept = min(components, int((deviations > NOTHING * max(deviations[0], 1e-300) * 10).sum()) if deviations[0] > 0 else 0)
    found = turned[:kept] @ right.T
    found /= np.linalg.norm(found, axis=1, keepdims=True)
    found *= np.sign(np.take_along_axis(found, np.abs(found).argmax(1)[:, None], 1)) if kept else 1.0
    variances = deviations[:kept] ** 2 / n
    error = 0.0
    if kept:
        scaled = found.T / np.sqrt(variances)
        middle = np.array(blocks.total(lambda x: (x @ scaled).sum(0))) / n

        def spread(x: np.ndarray) -> np.ndarray:
            z = x @ scaled - middle
            return (z.T @ z).ravel()

        error = float(np.abs(np.array(blocks.total(spread)).reshape(kept, kept) / n - np.eye(kept)).max())
    return Whitening(n, tuple(sums), found, variances, total, error)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Sums over dimensions of (n x - S)^2, exact."""
    most, top = int(np.abs(x.astype(float)).max(initial=0)) + 1, max(map(abs, sums), default=0)
    width = max(1, x.shape[1])
    if width * most * max(most, top) < 1 << 62:
        squares, along = (x * x).sum(1).tolist(), (x @ np.array(sums, np.int64)).tolist()
    else:
        squares = [sum(int(a) ** 2 for a in row) for row in x]
        along = [sum(int(a) * s for a, s in zip(row, sums)) for row in x]
    own = sum(s * s for s in sums)
    return [min(LONGEST, n * n * q - 2 * n * a + own) for q, a in zip(squares, along)]


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """One row per row of ``rows`` and component."""
    scaled, mean, count = model.components.T / np.sqrt(model.variances), model.mean, len(model.variances)
    explained = model.variances / model.total if count else np.empty(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = matrix(batch["x"], len(mean))
            yield pd.DataFrame(
                {
                    "vec_id": batch["vec_id"].astype("Int64").repeat(count).reset_index(drop=True),
                    "component": np.tile(np.arange(1, count + 1, dtype=np.int32), len(x)),
                    "n": np.int64(model.n),
                    "deviation": np.repeat(np.array(_deviations(x, model.n, model.sums), np.int64), count),
                    "whitened": ((x - mean) @ scaled).ravel(),
                    "explained": np.tile(explained, len(x)),
                    "identity_error": model.identity_error,
                }
            )

    return rows.select("vec_id", "x").mapInPandas(run, OUTPUT)


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Whitened components of every vector that takes part."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = store(whole(vectors, scale), "whole")
    model = fit(rows, components)
    return spark.createDataFrame([], OUTPUT) if model is None else apply(rows, model)


def query(spark, folder):
    """The four strongest components of all embeddings."""
    return whiten(table(spark, folder, "embeddings"))
