"""Distances between frame features as Column functions on arrays; sums go in index order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def hist_distance(a: Column, b: Column) -> Column:
    """1 - Pearson correlation, within [0, 2]. Two flat histograms count as equal; NaN counts as 1."""
    n = F.size(a)
    da, db = F.transform(a, lambda x: x - _sum(a) / n), F.transform(b, lambda x: x - _sum(b) / n)
    return _correlation(da, db)


def _correlation(da: Column, db: Column) -> Column:
    top = _sum(F.zip_with(da, db, lambda x, y: x * y))
    low = _sum(F.transform(da, lambda x: x * x)) * _sum(F.transform(db, lambda x: x * x))
    d = F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - F.when(low > 1e-12, top / F.sqrt(low)).otherwise(1.0)))
    return F.when(F.isnan(low) | F.isnan(top), 1.0).otherwise(d)


def centred(a: Column) -> Column:
    """A histogram less its mean: prepare it once where it is compared often."""
    return F.transform(a, lambda x: x - F.aggregate(a, F.lit(0.0), lambda s, y: s + y) / F.size(a))


def centred_distance(da: Column, db: Column) -> Column:
    """hist_distance of histograms that are centred already."""
    return _correlation(da, db)


def array_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of 8-bit samples, as a share of 255."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x) / F.size(a) / 255


def hash_distance(a: Column, b: Column, bits: int = 256) -> Column:
    """Share of unequal bits of hashes packed into arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x) / bits


# Weights of colour histogram, gray image, hash, gray histogram, edge histogram, mean luma and black share.
TRANSITION = {"color_hist": 0.28, "gray_small": 0.22, "dhash": 0.18, "hist": 0.14, "edge_hist": 0.08, "mean_luma": 0.06, "black_ratio": 0.04}
REUSE = {"gray_small": 0.26, "dhash": 0.22, "hist": 0.18, "color_hist": 0.14, "edge_hist": 0.10, "mean_luma": 0.06, "black_ratio": 0.04}


def _score(weights: dict[str, float], a: Column, b: Column, bits: int, hist=hist_distance) -> Column:
    term = {
        "gray_small": lambda x, y: array_distance(x, y), "dhash": lambda x, y: hash_distance(x, y, bits), "mean_luma": lambda x, y: F.abs(x - y) / 255, "black_ratio": lambda x, y: F.abs(x - y),
    }
    total = None
    for name, weight in weights.items():
        part = weight * term.get(name, hist)(a[name], b[name])
        total = part if total is None else total + part
    return total


def transition_score(a: Column, b: Column, bits: int = 256, hist=hist_distance) -> Column:
    """How unlike two frames are, as a cut detector sees it. a, b: structs of features. hist: the distance of the histogram columns."""
    return _score(TRANSITION, a, b, bits, hist)


def reuse_score(a: Column, b: Column, bits: int = 256, hist=hist_distance) -> Column:
    """How unlike a frame and a reference still are."""
    return _score(REUSE, a, b, bits, hist)
