"""Leading principal components of wide vectors by randomised subspace iteration.

The covariance matrix is never formed: every pass multiplies it with a thin matrix by summing,
over the rows, each centred row times its product with that matrix. The sums are added up in
pieces by key in further tasks; the driver holds matrices as wide as the components asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from answerflow.plans.learned import Sums, rows_of, summed
from answerflow.session import durable

# Dimensions in one piece of a sum.
PIECE = 64


@dataclass(frozen=True)
class Components:
    """Mean, directions (one a column) and variances along them, largest first; passes taken."""

    mean: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    passes: int

    def transform(self, df: DataFrame, vector: str = "embedding", output: str = "components") -> DataFrame:
        """Add the coordinates of every vector along the directions; null without a vector."""
        mean, directions = self.mean, self.directions

        @F.pandas_udf("array<double>")
        def along(vectors: pd.Series) -> pd.Series:
            there = vectors.notna()
            out = pd.Series([None] * len(vectors), dtype=object)
            if there.any():
                matrix = np.stack([np.asarray(v, np.float64) for v in vectors[there]])
                out[there.to_numpy()] = pd.Series(list((matrix - mean) @ directions), index=np.flatnonzero(there))
            return out

        return df.withColumn(output, along(F.transform(vector, lambda x: x.cast("double"))))


def fit_components(
    df: DataFrame, components: int = 300, vector: str = "embedding", oversample: int = 16, tolerance: float = 1e-12,
    most_passes: int = 60, seed: int = 42,
) -> Components:
    """The `components` leading principal components of the vectors, all of one length.

    Iteration starts from `components + oversample` random directions and ends when the leading
    variances change by less than `tolerance` of the largest, or after `most_passes`. Rows
    without a vector are left out. With fewer directions than asked for, or no rows, it fails.
    """
    rows = durable(df.select(F.transform(vector, lambda x: x.cast("double")).alias("x")).where("x is not null"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Sums:
        sums: Sums = {}
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch)
                sums[0] = sums.get(0, 0) + x.sum(axis=0)
                sums[1] = sums.get(1, 0) + np.array([float(len(x))])
        return sums

    first = summed(rows, totals)
    if 0 not in first:
        raise ValueError("no rows to fit on")
    n, mean = first[1][0], first[0] / first[1][0]
    dims = len(mean)
    if components > dims:
        raise ValueError(f"{components} components of {dims} dimensions")
    width = min(dims, components + oversample)
    start = np.random.default_rng(seed).standard_normal((dims, width))
    basis, _ = np.linalg.qr(start)
    known = np.full(components, np.inf)
    for step in range(1, most_passes + 1):

        def times(batches: Iterator[pa.RecordBatch], basis: np.ndarray = basis) -> Sums:
            product = np.zeros((dims, width))
            for batch in batches:
                if batch.num_rows:
                    x = rows_of(batch) - mean
                    product += x.T @ (x @ basis)
            return {at: product[at : at + PIECE] for at in range(0, dims, PIECE)}

        pieces = summed(rows, times)
        product = np.concatenate([pieces[at].reshape(-1, width) for at in sorted(pieces)]) / max(n - 1, 1.0)
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        moved = np.max(np.abs(values[:components] - known)) if step > 1 else np.inf
        known = values[:components]
        if width == dims or moved <= tolerance * max(values[0], 1e-300):
            break
        basis, _ = np.linalg.qr(product)
    directions = basis_of(basis, turn, product, values, components, width == dims)
    return Components(mean, directions, np.maximum(known, 0.0), step)


def basis_of(
    basis: np.ndarray, turn: np.ndarray, product: np.ndarray, values: np.ndarray, components: int, whole: bool
) -> np.ndarray:
    """The leading directions in the subspace, with the largest entry of each positive. Unless
    the subspace is the whole space, the last product brings them half a pass further."""
    found = (basis @ turn)[:, :components]
    if not whole:
        further = (product @ turn)[:, :components]
        good = values[:components] > 1e-12 * max(values[0], 1e-300)
        found[:, good] = further[:, good] / values[:components][good]
        found, upper = np.linalg.qr(found)
        found *= np.where(np.diag(upper) < 0, -1.0, 1.0)
    largest = found[np.argmax(np.abs(found), axis=0), np.arange(components)]
    return found * np.where(largest < 0, -1.0, 1.0)
