"""Latent semantic vectors: distributed randomised SVD of sparse TF-IDF rows."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

ROWS = "idx array<int>, val array<double>"
STRIPE = 1024      # terms summed by one reducer
SEED = 11


def _times_gram(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """A^T (A q) over the rows of A: partial sums per task, summed per stripe of terms.

    Only the n_terms x k result, whose size is fixed by the parameters, reaches the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(q)
    n, k = q.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        basis, acc = shared.value, None
        for b in batches:
            for idx, val in zip(b["idx"], b["val"], strict=True):
                if len(idx):
                    acc = np.zeros((n, k)) if acc is None else acc
                    acc[idx] += np.outer(val, np.asarray(val) @ basis[idx])
        if acc is not None:
            yield pd.DataFrame([(s, acc[s:s + STRIPE].tobytes()) for s in range(0, n, STRIPE)], columns=["stripe", "part"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = sum(np.frombuffer(p) for p in pdf["part"])
        return pd.DataFrame({"stripe": [int(pdf["stripe"].iloc[0])], "part": [out.tobytes()]})

    parts = rows.mapInPandas(partial, "stripe int, part binary").groupBy("stripe").applyInPandas(total, "stripe int, part binary")
    out = np.zeros((n, k))
    for r in parts.toLocalIterator():
        out[r["stripe"]:r["stripe"] + STRIPE] = np.frombuffer(r["part"]).reshape(-1, k)
    return out


def randomised_basis(rows: DataFrame, n_terms: int, k: int, rounds: int = 2) -> np.ndarray:
    """Orthonormal n_terms x k basis near the leading right singular vectors of the rows
    (idx, val): subspace iteration from a fixed random start. Rows must be distinct in ``idx``."""
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n_terms, min(k, n_terms))))[0]
    for _ in range(rounds):
        y = _times_gram(rows, q)
        if not y.any():
            return q
        q = np.linalg.qr(y)[0]
    return q
