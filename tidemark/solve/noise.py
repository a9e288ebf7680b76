"""Seeded synthetic noise with a power-law spectrum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def powerlaw(size: int, exponent: float, rng: np.random.Generator) -> np.ndarray:
    """A series whose expected spectrum falls as f^-exponent, with unit expected deviation about its mean.

    After Timmer and König (1995): every Fourier coefficient of bin k gets a normal real and a normal imaginary part of
    deviation k^(-exponent/2); bin 0, where the law has no value, takes that of bin 1. Bins without a mirror image (0 and,
    for even sizes, size/2) are real. By Parseval's identity bin k adds mirrors x parts x k^-exponent / size² to the
    expected variance, where both numbers are 2 with a mirror image and 1 without."""
    if size < 2:
        return rng.normal(size=size)
    bins = np.arange(size // 2 + 1)
    mirrored = (bins > 0) & (2 * bins != size)
    deviation = np.maximum(bins, 1.0) ** (-exponent / 2)
    variance = (np.where(mirrored, 4, 1) * deviation**2)[1:].sum() / size**2
    real, imaginary = rng.normal(size=(2, len(bins)))
    return np.fft.irfft(deviation * (real + 1j * mirrored * imaginary), size) / np.sqrt(variance)


def noise(stations: DataFrame, size: int, exponent: float, seed: int = 0) -> DataFrame:
    """station, k, value: `size` values for each station, the same for a station and seed wherever it runs."""

    def run(frames):
        import zlib

        for pdf in frames:
            for s in pdf["station"]:
                v = powerlaw(size, exponent, np.random.default_rng([seed, zlib.crc32(s.encode())]))
                yield pd.DataFrame({"station": s, "k": np.arange(size), "value": v})

    return stations.select("station").dropna().distinct().mapInPandas(run, "station string, k int, value double")
