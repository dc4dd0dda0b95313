"""Cell centres of a vector index, flat or in two levels, and how they are trained."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import stored

SAMPLE_ROWS = 65_536  # rows that centres are trained on, some more or fewer
_ITERATIONS = 10
_ROWS_AT_ONCE = 1_024
_LEAST_TOPS = 4  # top centres that a probe looks below at least


@dataclass(frozen=True)
class Centres:
    """One centre per cell. With ``tops``, each cell lies below the top centre numbered in ``parent``, and probes go top-down."""

    cells: np.ndarray
    tops: np.ndarray | None = None
    parent: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.cells)

    def probe(self, units: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each vector, nearest first.

        In two levels only cells below its nearest top centres are compared: as many tops as have twice ``n`` cells on average, four at least.
        So a probe costs in proportion to the root of the number of cells, and may miss a cell.
        """
        n = min(n, len(self.cells))
        if self.tops is None or self.parent is None:
            return np.argsort(_far(units, self.cells), axis=1, kind="stable")[:, :n]
        wide = min(len(self.tops), max(_LEAST_TOPS, math.ceil(2 * n * len(self.tops) / len(self.cells))))
        below = [np.flatnonzero(self.parent == t) for t in range(len(self.tops))]
        found = np.empty((len(units), n), np.int64)
        for at in range(0, len(units), _ROWS_AT_ONCE):
            part = units[at : at + _ROWS_AT_ONCE]
            order = np.argsort(_far(part, self.tops), axis=1, kind="stable")
            far = np.full((len(part), len(self.cells)), np.inf)
            for t, own in enumerate(below):
                rows = np.flatnonzero((order[:, :wide] == t).any(axis=1))
                if len(rows) and len(own):
                    far[np.ix_(rows, own)] = _far(part[rows], self.cells[own])
            found[at : at + len(part)] = np.argsort(far, axis=1, kind="stable")[:, :n]
        return found


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less the squares of ``x``, which do not change an order."""
    return (centres * centres).sum(axis=1) - 2 * x @ centres.T


def means(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """At most ``k`` distinct centres of the rows of ``x``: seeded far apart, then moved to the means of what is nearest."""
    draw = np.random.default_rng(seed)
    chosen = [x[draw.integers(len(x))]]
    away = np.full(len(x), np.inf)
    while len(chosen) < min(k, len(x)):
        away = np.minimum(away, ((x - chosen[-1]) ** 2).sum(axis=1))
        if away.sum() <= 1e-12:
            break  # all rows are centres already
        chosen.append(x[draw.choice(len(x), p=away / away.sum())])
    centres = np.array(chosen)
    for _ in range(_ITERATIONS):
        near = _far(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def sample_of(df: DataFrame, rows: int, key: str) -> DataFrame:
    """Some ``rows`` rows, drawn from all by a hash of the key; all of a smaller table."""
    scale = 1 << 30
    share = int(min(1.0, rows / max(df.count(), 1)) * scale)
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(scale)) < share)


def train_centres(df: DataFrame, key: str, vec: str, n: int, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Centres:
    """Some ``n`` cell centres in two levels, from a sample of all rows.

    The root of ``n`` top centres come from k-means over the sample; below each, k-means over its share of the sample (one task each, and no more than
    the sample in any) gives it cells in proportion to its rows.
    """
    known = df.filter(F.size(vec) > 0).select(key, vectors.l2_normalize(F.col(vec)).alias("unit"))
    sample = stored(sample_of(known, sample_rows, key).select("unit"), "centre-sample")
    drawn = sample.count()
    if not drawn:
        raise ValueError("no vectors to train centres on")
    rows = sample.withColumn("_features", array_to_vector("unit"))
    tops = KMeans(k=max(1, math.isqrt(n)), seed=seed, maxIter=_ITERATIONS, featuresCol="_features", predictionCol="top").fit(rows)
    placed = tops.transform(rows).select("top", "unit")

    def leaves(table: pa.Table) -> pa.Table:
        unit = table["unit"].combine_chunks()
        x = unit.flatten().to_numpy(zero_copy_only=False).reshape(len(unit), -1).astype(float)
        found = means(x, max(1, round(n * len(x) / drawn)), seed)
        top = table["top"].combine_chunks()[:1].take(pa.array([0] * len(found)))
        return pa.table({"top": top, "centre": pa.array(list(found), pa.list_(pa.float64()))})

    cells = placed.groupBy("top").applyInArrow(leaves, "top int, centre array<double>").collect()  # some n rows
    cells.sort(key=lambda r: (r["top"], r["centre"]))
    return Centres(np.array([r["centre"] for r in cells]), np.array(tops.clusterCenters()), np.array([r["top"] for r in cells]))
