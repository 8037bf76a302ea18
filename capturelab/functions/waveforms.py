"""Waveform and spectrum features. Length and normalization are built-in; Fourier work is numpy over Arrow batches of captures.

Spark 4.1 can't explode a pandas UDF's array if the UDF's argument holds a lambda function: write such an argument to a table first.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as A

STATS = ("mean", "std", "rms", "peak", "p2p", "energy", "fft_energy", "peak_freq", "peak_amp", "centroid", "bandwidth", "stft_mean", "stft_std", "stft_max", "stft_energy")


def fix_length(signal: Column, length: int, pad: Column | float = 0.0, start: Column | None = None) -> Column:
    """The middle of a longer signal, or what begins at `start`; a shorter one padded on the right."""
    n = F.size(signal)
    start = (F.floor((n - length) / 2) if start is None else start).cast("int") + 1
    padded = F.concat(signal, F.array_repeat(pad if isinstance(pad, Column) else F.lit(pad), F.greatest(F.lit(length) - n, F.lit(0))))
    return F.when(n >= length, F.slice(signal, F.greatest(start, F.lit(1)), F.lit(length))).otherwise(padded)


def random_crop(signal: Column, length: int, key: Column, seed: int = 42, epoch: int = 0, pad: Column | float = 0.0) -> Column:
    """fix_length for training: a part of a longer signal whose place is drawn by seed, epoch and key, so that a task run again draws the same."""
    return fix_length(signal, length, pad, A.draw(seed, f"crop|{epoch}", key) % F.greatest(F.size(signal) - length + 1, F.lit(1)))


def fix_trace(signal: Column, length: int) -> Column:
    """fix_length for level traces: padded with the median of the finite values."""
    finite = F.filter(signal, lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")))
    return fix_length(signal, length, F.coalesce(A.quantile(F.sort_array(finite), 0.5), F.lit(0.0)))


def head(signal: Column, length: int) -> Column:
    """The start of a longer signal; a shorter one padded with its median."""
    n = F.size(signal)
    return F.concat(F.slice(signal, 1, length), F.array_repeat(A.quantile(F.sort_array(signal), 0.5), F.greatest(F.lit(length) - n, F.lit(0))))


def finite(signal: Column) -> Column:
    return F.transform(signal, lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))


def standardized(signal: Column) -> Column:
    """Centred, and scaled by the population deviation unless that is below 1e-8."""
    return A.let(finite(signal), lambda x: A.let(F.struct(A.mean(x).alias("m"), A.std(x).alias("s")), lambda c: F.transform(x, lambda v: (v - c["m"]) / F.when(c["s"] < 1e-8, 1.0).otherwise(c["s"]))))


def unit_rms(signal: Column) -> Column:
    return A.let(F.sqrt(A.mean(F.transform(signal, lambda v: v * v))), lambda r: F.transform(signal, lambda v: F.when(r < 1e-8, v).otherwise(v / r)))


def by_length(signals: pd.Series, work, cells: int = 2**20) -> list:
    """work(matrix) for rows of equal length, at most so many numbers at a time, and its results by row; None for a null or empty row."""
    out, places = [None] * len(signals), {}
    values = signals.to_numpy()
    for i, v in enumerate(values):
        if v is not None and len(v):
            places.setdefault(len(v), []).append(i)
    for n, at in places.items():
        step = max(1, cells // n)
        for k in range(0, len(at), step):
            part = at[k : k + step]
            for i, y in zip(part, work(np.stack([values[i] for i in part]).astype(np.float64)), strict=True):
                out[i] = y
    return out


#: Rows whose results a task holds at once.
ROWS = 512


def _made(kind: str, work):
    """A column function that does work(matrix) by length, with rows of this type."""

    @F.pandas_udf(kind)
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            for k in range(0, len(s), ROWS):
                yield pd.Series(by_length(s.iloc[k : k + ROWS], work), dtype=object)

    return made


def _clean(x: np.ndarray) -> np.ndarray:
    return np.nan_to_num(x, nan=0, posinf=0, neginf=0)


def magnitudes(x: np.ndarray, segment: int, overlap: int) -> np.ndarray:
    """Frequencies x frames of each signal (last axis): magnitudes under a periodic Hann window that sums to 1, without padding."""
    segment = max(1, min(segment, x.shape[-1]))
    hop = segment - min(max(overlap, 0), segment - 1)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment) if segment > 1 else np.ones(1)
    frames = np.lib.stride_tricks.sliding_window_view(x, segment, axis=-1)[..., ::hop, :]
    return np.abs(np.fft.rfft(frames * window, axis=-1)).swapaxes(-1, -2) / window.sum()


def boxed(m: np.ndarray, rows: int, columns: int) -> np.ndarray:
    out = np.zeros((*m.shape[:-2], rows, columns))
    part = m[..., :rows, :columns]
    out[..., : part.shape[-2], : part.shape[-1]] = part
    return out


def relative(m: np.ndarray) -> np.ndarray:
    """log1p of magnitudes by their root mean square."""
    return np.log1p(m / np.maximum(np.sqrt(np.mean(m * m, axis=(-2, -1), keepdims=True)), 1e-12))


def _flat(channels: list[np.ndarray], kind: str = "f4") -> list[list[np.ndarray]]:
    """Channels, each signals x rows x columns, as a list of flat ones for each signal."""
    return [list(c) for c in np.stack([m.reshape(len(m), -1) for m in channels], axis=1).astype(kind)]


def stft(signal: Column, segment: int, overlap: int, rows: int, columns: int, scale: str = "absolute", representation: str = "single", kind: str = "float") -> Column:
    """array<array<float>> (or double, by kind), a flat array of rows x columns for each channel: the magnitudes (absolute or log1p); absolute_relative adds log1p of them by their root mean square. Null for an empty signal."""
    if scale not in ("absolute", "log1p") or representation not in ("single", "absolute_relative"):
        raise ValueError(f"unknown scale or representation: {scale}, {representation}")

    def work(x):
        m = boxed(magnitudes(_clean(x), segment, overlap), rows, columns)
        m = np.log1p(m) if scale == "log1p" else m
        return _flat([m] if representation == "single" else [m, relative(m)], "f4" if kind == "float" else "f8")

    return _made(f"array<array<{kind}>>", work)(signal)


def _stats(x: np.ndarray, rate: float, segment: int, overlap: int) -> np.ndarray:
    x = _clean(x)
    amp, freq = np.abs(np.fft.rfft(x)), np.fft.rfftfreq(x.shape[1], 1 / rate)
    peak, weight = np.argmax(np.round(amp, 9), axis=1), amp.sum(1)
    by = np.where(weight > 0, weight, 1)
    centroid = np.where(weight > 0, (freq * amp).sum(1) / by, 0)
    width = np.where(weight > 0, np.sqrt((((freq - centroid[:, None]) ** 2) * amp).sum(1) / by), 0)
    m = magnitudes(x, segment, overlap).reshape(len(x), -1)
    waves = [x.mean(1), x.std(1), np.sqrt((x * x).mean(1)), np.abs(x).max(1), np.ptp(x, axis=1), (x * x).sum(1)]
    return np.column_stack([*waves, (amp * amp).sum(1), freq[peak], amp[np.arange(len(x)), peak], centroid, width, m.mean(1), m.std(1), m.max(1), (m * m).sum(1)])


def spectral_stats(signal: Column, rate: float, segment: int, overlap: int) -> Column:
    """A struct of the 15 STATS; null for an empty signal."""

    @F.pandas_udf(", ".join(f"{k} double" for k in STATS))
    def made(s: pd.Series) -> pd.DataFrame:
        rows = by_length(s, lambda x: _stats(x, rate, segment, overlap))
        return pd.DataFrame([[None] * len(STATS) if r is None else r for r in rows], columns=list(STATS), dtype="float64")

    return made(signal)


#: The statistics by which domains are compared; energies are mean squares.
GAP = ("signal_mean", "signal_std", "signal_rms", "signal_p2p", "stft_mean", "stft_std", "stft_max", "stft_energy")


def gap_statistics(signal: Column, segment: int, overlap: int, rows: int, columns: int) -> Column:
    """A struct of the GAP statistics of a signal of fixed length: four of its values, four of the log spectrum of the standardized signal. Null for an empty signal; values that are not finite count as 0."""

    def work(x):
        x = _clean(x)
        centred, by = x - x.mean(1, keepdims=True), x.std(1, keepdims=True)
        m = np.log1p(boxed(magnitudes(centred / np.where(by < 1e-8, 1, by), segment, overlap), rows, columns)).reshape(len(x), -1)
        return np.column_stack([x.mean(1), x.std(1), np.sqrt((x * x).mean(1)), np.ptp(x, axis=1), m.mean(1), m.std(1), m.max(1), (m * m).mean(1)])

    @F.pandas_udf(", ".join(f"{k} double" for k in GAP))
    def made(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([[None] * len(GAP) if r is None else r for r in by_length(s, work)], columns=list(GAP), dtype="float64")

    return made(signal)


def _banded(x: np.ndarray, bins: int) -> np.ndarray:
    """The means of so many bands of each row; 0 for a band without places."""
    edges = np.linspace(0, x.shape[1], bins + 1).astype(int)
    return np.column_stack([x[:, a:b].mean(1) if b > a else np.zeros(len(x)) for a, b in zip(edges, edges[1:], strict=False)])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def _log_spectrum(x: np.ndarray) -> np.ndarray:
    return np.log1p(np.abs(np.fft.rfft(x - x.mean(1, keepdims=True))))


def shape_feature(signal: Column, bins: int = 128, kind: str = "float") -> Column:
    """The standardized trace in bands, then its log spectrum's start, each of unit length."""

    def work(x):
        sd = x.std(1, keepdims=True)
        x = (x - x.mean(1, keepdims=True)) / np.where(sd >= 1e-12, sd, 1)
        return np.hstack([_unit(_banded(x, bins)), _unit(_log_spectrum(x)[:, :bins])]).astype("f4" if kind == "float" else "f8")

    return _made(f"array<{kind}>", work)(signal)


def spectral_signature(signal: Column, bins: int = 128) -> Column:
    """The log spectrum of the centred signal, averaged in bands."""

    def work(x):
        s = _log_spectrum(x)
        return _banded(s, min(bins, s.shape[1]))

    return _made("array<double>", work)(signal)


def _resampled(x: np.ndarray, n: int) -> np.ndarray:
    """Each row at n even places, by linear interpolation."""
    at = np.linspace(0, x.shape[1] - 1, n)
    low = np.minimum(at.astype(int), max(x.shape[1] - 2, 0))
    return x[:, low] + (x[:, np.minimum(low + 1, x.shape[1] - 1)] - x[:, low]) * (at - low)


def resample(signal: Column, n: int) -> Column:
    """The signal at n even places, by linear interpolation; null for an empty one."""
    return _made("array<double>", lambda x: _resampled(x, n))(signal)


def audit_feature(signal: Column, kind: str = "float") -> Column:
    """616 numbers: level and shape at 256 places, the spectrum at 96, and 8 statistics."""

    def work(x):
        y = _resampled(x, 256)
        span = np.ptp(y, axis=1)
        stats = [y.mean(1), y.std(1), y.min(1), y.max(1), span, *np.percentile(y, [5, 50, 95], axis=1)]
        shape = (y - y.mean(1, keepdims=True)) / np.maximum(span, 1e-6)[:, None]
        return np.hstack([y, shape, _resampled(_log_spectrum(y), 96), np.column_stack(stats)]).astype("f4" if kind == "float" else "f8")

    return _made(f"array<{kind}>", work)(signal)


def db_trace_channels(signal: Column, segment: int, overlap: int, rows: int, columns: int, level: tuple[float, float] = (-110.0, -50.0), variation: float = 15.0, kind: str = "float") -> Column:
    """array<array<float>> (or double, by kind), four flat channels of rows x columns: magnitudes of the trace about its median, the same relative, and as constants
    the median's place in the range level and the deviation over variation, both clipped to 0 to 1. Values that aren't finite count as the
    median of the others; null for a trace without any."""
    if level[1] <= level[0] or variation <= 0:
        raise ValueError("level must rise and variation be positive")

    def work(x):
        sound = np.isfinite(x)
        has = sound.any(axis=1)
        median = np.array([np.median(r[ok]) if any_ else 0.0 for r, ok, any_ in zip(x, sound, has, strict=True)])
        x = np.where(sound, x, median[:, None]) - median[:, None]
        m = boxed(magnitudes(x, segment, overlap), rows, columns)
        constants = [(median - level[0]) / (level[1] - level[0]), x.std(1) / variation]
        made = _flat([m, relative(m), *(np.broadcast_to(np.clip(c, 0, 1)[:, None, None], m.shape) for c in constants)], "f4" if kind == "float" else "f8")
        return [c if any_ else None for c, any_ in zip(made, has, strict=True)]

    return _made(f"array<array<{kind}>>", work)(signal)


#: Ranges, largest shifts and masks of spectrum augmentation.
AUGMENT = {"gain": (0.7, 1.4), "snr_db": (25.0, 45.0), "frequency_shift": 2, "time_shift": 8, "frequency_mask": (0.3, 4), "time_mask": (0.3, 6)}


def augmented(key: Column, channels: Column, rows: int, columns: int, representation: str = "single", epoch: int = 0, seed: int = 42, settings: dict | None = None) -> Column:
    """Flat channels as from stft(), changed at random: gain, noise at a signal-to-noise ratio (no magnitude below 0), the relative channel
    anew, a shift of frequencies filled with zeros, a roll in time, and masks of frequencies and of times. Draws depend on seed, epoch
    and key alone, so a task that is run again draws the same. Null stays null."""
    if representation not in ("single", "absolute_relative"):
        raise ValueError(f"no augmentation of {representation}")
    s = AUGMENT | (settings or {})

    def masked(x: np.ndarray, rng, chance: float, width: int, axis: int) -> None:
        width = min(width, x.shape[axis])
        if width > 0 and rng.random() < chance:
            w = int(rng.integers(1, width + 1))
            at = int(rng.integers(0, x.shape[axis] - w + 1))
            np.moveaxis(x, axis, 0)[at : at + w] = 0

    def one(name, flat):
        if flat is None or not len(flat):
            return None
        rng = np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}|{epoch}|{name}".encode()).digest(), "big"))
        m = np.array(flat[0], np.float64).reshape(rows, columns) * rng.uniform(*s["gain"])
        if (power := np.mean(m * m)) > 1e-20:
            m = np.maximum(m + rng.normal(0, np.sqrt(power / 10 ** (rng.uniform(*s["snr_db"]) / 10)), m.shape), 0)
        x = np.stack([m] if representation == "single" else [m, relative(m)])
        by = int(rng.integers(-s["frequency_shift"], s["frequency_shift"] + 1))
        if by:
            x = np.roll(x, by, axis=1)
            x[:, slice(0, by) if by > 0 else slice(by, None)] = 0
        x = np.roll(x, int(rng.integers(-s["time_shift"], s["time_shift"] + 1)), axis=2)
        masked(x, rng, *s["frequency_mask"], 1)
        masked(x, rng, *s["time_mask"], 2)
        return [c.ravel().astype(np.float32) for c in x]

    @F.pandas_udf("array<array<float>>")
    def made(names: pd.Series, flats: pd.Series) -> pd.Series:
        return pd.Series([one(k, f) for k, f in zip(names, flats, strict=True)], dtype=object)

    return made(key.cast("string"), channels)
