"""Weights from parameter sizes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inverse(x: Column, eps: float, scale: float = 1.0) -> Column:
    """s / (|x| + e)"""
    return scale / (F.abs(x) + eps)


def inverse_squared(x: Column, eps: float, scale: float = 1.0) -> Column:
    """s / (x² + e²)"""
    return scale / (x * x + eps * eps)


def logarithmic(x: Column, total: Column, n: Column, eps: float, scale: float = 1.0) -> Column:
    """s ln((sum|x| + n e) / (|x| + e)) / ln n, with the sum and number of sizes in the group"""
    return scale * F.log((total + n * eps) / (F.abs(x) + eps)) / F.log(n)
