"""Decompositions of tables of points: their Gram matrix is summed on Spark, what is solved is as large as a point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(points: DataFrame) -> np.ndarray:
    """The products of the coordinates with each other, summed over points(x array<double>): a matrix product for each batch."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf.x)
                g = (x.T @ x).reshape(-1)
                yield pd.DataFrame({"k": np.arange(len(g)), "v": g})

    sums = points.select("x").mapInPandas(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    d = round(len(sums) ** 0.5)
    out = np.zeros(d * d)
    for r in sums:
        out[r.k] = r.v
    return out.reshape(d, d)


def decomposed(points: DataFrame, most: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The economy singular value decomposition of points(id, x), each a row: (id, u array), singular values from the largest, and the right vectors as columns.

    most: so many values at most. Values under a 1e-7th of the largest, which
    squares can't tell from 0, are left out. A vector's largest coordinate is
    positive, so the signs don't depend on the library.
    """
    w, v = np.linalg.eigh(gram(points))
    w, v = w[::-1], v[:, ::-1]
    keep = (w > w.max(initial=0.0) * 1e-14)[: len(w) if most is None else most]
    s, v = np.sqrt(w[: len(keep)][keep]), v[:, : len(keep)][:, keep]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0) if v.size else v

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf.id, "u": list(np.stack(pdf.x) @ v / s)})

    kind = dict(points.dtypes)["id"]
    return points.select("id", "x").mapInPandas(left, f"id {kind}, u array<double>"), s, v


def recomposed(u: DataFrame, s: np.ndarray, v: np.ndarray) -> DataFrame:
    """id, k, x: the coordinates of the points that decomposed took apart, a row for each; a matrix product for each batch."""
    back, d = (v * s).T, len(v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf.u) @ back
                yield pd.DataFrame({"id": np.repeat(pdf.id.to_numpy(), d), "k": np.tile(np.arange(d), len(pdf)), "x": x.ravel()})

    return u.mapInPandas(run, f"id {dict(u.dtypes)['id']}, k long, x double")


def whitening(covariance: np.ndarray, method: str = "zca", epsilon: float = 1e-5) -> np.ndarray:
    """A matrix that takes centred channels to uncorrelated ones of variance 1.

    zca: the symmetric root; pca: onto the principal axes; cholesky: an upper
    triangle; zca_cor and pca_cor: as these, of the correlations, after each
    channel is divided by its deviation.
    """
    scale = np.ones(len(covariance))
    if method in ("zca_cor", "pca_cor"):
        scale = 1 / np.sqrt(np.diag(covariance))
    w, v = np.linalg.eigh(covariance * np.outer(scale, scale))
    w, v = np.maximum(w[::-1], 0) + epsilon, v[:, ::-1]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(len(v))] < 0, -1.0, 1.0)
    if method == "cholesky":
        return np.linalg.cholesky((v / w) @ v.T).T
    axes = (v / np.sqrt(w)).T
    if method in ("pca", "pca_cor"):
        return axes * scale
    if method in ("zca", "zca_cor"):
        return v @ axes * scale
    raise ValueError(f"no such method of whitening: {method}")


def completed(matrix: np.ndarray, known: list[int], channels: list[int]) -> np.ndarray:
    """A matrix of the known channels as one of all channels, which leaves the others as they are."""
    place = {c: i for i, c in enumerate(channels)}
    at = [place[c] for c in known]
    out = np.eye(len(channels))
    out[np.ix_(at, at)] = matrix
    return out
