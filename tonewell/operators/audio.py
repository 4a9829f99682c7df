"""Audio in the plan: PCM files decoded, brought to one rate and length, and log-mel frames, on Arrow batches.

Only uncompressed WAV is decoded here; what another decoder made of other files comes as samples in the same form.
"""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col


def pcm(content: bytes) -> tuple[np.ndarray, int] | None:
    """Samples in -1..1, channels averaged, and the rate of a WAV file; None if it cannot be read."""
    try:
        with wave.open(io.BytesIO(content)) as f:
            width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
            raw = f.readframes(f.getnframes())
    except (wave.Error, EOFError, ValueError):
        return None
    if width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) ^ 0x800000) - 0x800000
    elif width in (1, 2, 4):
        x = np.frombuffer(raw, {1: np.uint8, 2: np.int16, 4: np.int32}[width]).astype(np.float64)
        x = x - 128 if width == 1 else x
    else:
        return None
    x = np.asarray(x, np.float64)[: len(x) // channels * channels].reshape(-1, channels).mean(1)
    return x / float(1 << (8 * width - 1)), rate


#: Zero crossings of the windowed sinc on either side, for resampling.
CROSSINGS = 16


def resampled(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """At another rate, by a Hann-windowed sinc that cuts above the lower of both Nyquist frequencies."""
    if rate == target or not len(x):
        return x
    n = int(math.ceil(len(x) * target / rate))
    cut = min(1.0, target / rate)
    reach = int(math.ceil(CROSSINGS / cut))
    out = np.empty(n)
    steps = np.arange(-reach, reach + 1)
    padded = np.pad(x, (reach, reach + 1))
    for start in range(0, n, 65_536):
        at = np.arange(start, min(n, start + 65_536)) * (rate / target)
        base = np.floor(at).astype(np.int64)
        t = steps[None, :] - (at - base)[:, None]
        kernel = cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / (reach + 1), -1, 1)))
        out[start : start + len(at)] = (padded[base[:, None] + reach + steps[None, :]] * kernel).sum(1)
    return out


def decode(df: DataFrame, content: str = "content", rate: int = 16_000) -> DataFrame:
    """`df` with samples (ARRAY<FLOAT>, mono, at `rate`) in place of `content`; null for what is no PCM file."""
    fields = [f for f in df.schema.fields if f.name != content]
    schema = T.StructType([*fields, T.StructField("samples", T.ArrayType(T.FloatType()))])

    def one(data) -> np.ndarray | None:
        found = pcm(bytes(data)) if data is not None else None
        return None if found is None else resampled(*found, rate).astype(np.float32)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.iloc[start : start + 64]
                yield part.drop(columns=content).assign(samples=[one(x) for x in part[content]])

    return df.mapInPandas(make, schema)


def fitted(samples: Column | str, n: int, centre: bool = True) -> Column:
    """Exactly `n` samples: the middle of longer audio (or its start), shorter audio followed by silence."""
    x = col(samples)
    skip = F.when(F.size(x) > n, F.floor((F.size(x) - n) / 2) if centre else F.lit(0)).otherwise(F.lit(0)).cast("int")
    cut = F.slice(x, skip + 1, F.lit(n))
    return F.concat(cut, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(n) - F.size(cut), F.lit(0))))


def mel_filters(rate: int, n_fft: int, bands: int, low: float, high: float) -> np.ndarray:
    """Triangles of equal area on the mel scale that is linear up to 1 kHz and logarithmic above (bands x bins)."""
    # The scale has 3 mels for each 200 Hz up to 1 kHz, and 27 for each factor of 6.4 above.
    knee, slope, above = 1000.0, 3.0 / 200.0, 27.0 / math.log(6.4)

    def mel(f: np.ndarray) -> np.ndarray:
        return np.where(f < knee, f * slope, knee * slope + np.log(np.maximum(f, knee) / knee) * above)

    def hertz(m: np.ndarray) -> np.ndarray:
        return np.where(m < knee * slope, m / slope, knee * np.exp((m - knee * slope) / above))

    edges = hertz(np.linspace(*mel(np.array([low, high])), bands + 2))
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)[None, :]
    a, b, c = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((bins - a) / (b - a), (c - bins) / (c - b))) * (2.0 / (c - a))


def log_mel(df: DataFrame, samples: str = "samples", rate: int = 16_000, n_fft: int = 400, hop: int = 160, bands: int = 80, low: float = 50.0, high: float = 8_000.0, mean: float = 0.0, deviation: float = 1.0) -> DataFrame:
    """`df` with frames (ARRAY<ARRAY<FLOAT>>, one row a frame) in place of `samples`: log of the mel power, normalised.

    Frames are centred, with the audio mirrored at its ends; null or empty audio has null frames.
    """
    fields = [f for f in df.schema.fields if f.name != samples]
    schema = T.StructType([*fields, T.StructField("frames", T.ArrayType(T.ArrayType(T.FloatType())))])
    filters, window, least = mel_filters(rate, n_fft, bands, low, high), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft), float(np.finfo(np.float32).eps)

    def one(x) -> list | None:
        if x is None or not len(x):
            return None
        y = np.pad(np.asarray(x, np.float64), n_fft // 2, mode="reflect" if len(x) > n_fft // 2 else "edge")
        cut = np.lib.stride_tricks.sliding_window_view(y, n_fft)[::hop]
        power = np.abs(np.fft.rfft(cut * window, axis=1)) ** 2
        return list(((np.log(power @ filters.T + least) - mean) / deviation).astype(np.float32))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.iloc[start : start + 64]
                yield part.drop(columns=samples).assign(frames=[one(x) for x in part[samples]])

    return df.mapInPandas(make, schema)


def chunks(frames: Column | str, size: int, patch: int = 1) -> Column:
    """Frames in chunks of `size` for an encoder of fixed length; the last is filled with zeros up to a multiple of `patch`."""
    x = col(frames)
    short = F.pmod(F.lit(patch) - F.pmod(F.pmod(F.size(x), F.lit(size)), F.lit(patch)), F.lit(patch))
    zero = F.transform(F.element_at(x, 1), lambda v: v * 0)
    full = F.concat(x, F.array_repeat(zero, short.cast("int")))
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(full) - 1), lambda i: i % size == 0), lambda i: F.slice(full, i + 1, size))
