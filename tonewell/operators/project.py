"""Projection heads on vectors: dense layers whose weights are given, run on Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Layer:
    """x @ weight + bias, then layer normalisation (with what it learned, if given) and an activation, each if wanted.

    `residual` adds the input back where the widths agree. Dropout of training has no part in projecting.
    """

    weight: np.ndarray
    bias: np.ndarray | None = None
    norm: bool = False
    activation: str | None = None
    scale: np.ndarray | None = None
    shift: np.ndarray | None = None
    residual: bool = False

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.weight
        if self.bias is not None:
            y = y + self.bias
        if self.norm:
            y = (y - y.mean(1, keepdims=True)) / np.sqrt(y.var(1, keepdims=True) + 1e-5)
            y = y if self.scale is None else y * self.scale
            y = y if self.shift is None else y + self.shift
        if self.activation == "relu":
            y = np.maximum(y, 0.0)
        elif self.activation == "tanh":
            y = np.tanh(y)
        elif self.activation == "gelu":  # exact, by the error function
            y = 0.5 * y * (1.0 + np.vectorize(math.erf, otypes=[float])(y / math.sqrt(2.0)))
        elif self.activation == "silu":
            y = y / (1.0 + np.exp(-y))
        elif self.activation not in (None, "linear"):
            raise ValueError(self.activation)
        return y + x if self.residual and x.shape == y.shape else y


#: Weights above this many bytes are no head; they are refused, as they would be broadcast.
MOST_BYTES = 256 << 20


def project(df: DataFrame, vec: str, layers: Sequence[Layer], unit: bool = True, eps: float = 1e-6) -> DataFrame:
    """`df` with `vec` sent through the layers, made unit length if wanted.

    Null vectors and vectors of another length stay null. The weights are broadcast; their size is checked.
    """
    size = sum(x.weight.nbytes for x in layers)
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of weights")
    shared = df.sparkSession.sparkContext.broadcast(tuple(layers))
    fields = [T.StructField(vec, T.ArrayType(T.DoubleType())) if f.name == vec else f for f in df.schema.fields]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads = shared.value
        width = heads[0].weight.shape[0]
        for batch in batches:
            good = np.array([v is not None and len(v) == width for v in batch[vec]], bool)
            out: list = [None] * len(batch)
            if good.any():
                x = np.stack([np.asarray(v, np.float64) for v in batch[vec][good]])
                for layer in heads:
                    x = layer(x)
                if unit:
                    x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), eps)
                for i, v in zip(np.flatnonzero(good), x):
                    out[i] = v
            batch[vec] = out
            yield batch

    return df.mapInPandas(make, T.StructType(fields))


def mean_pool(df: DataFrame, key: str, tokens: str, mask: str, floor: float = 1e-6) -> DataFrame:
    """`key`, vec: the mean of the tokens weighted by their mask; a mask of zeros gives zeros."""
    rows = df.select(key, F.posexplode(F.arrays_zip(F.col(tokens).alias("t"), F.col(mask).alias("m"))).alias("_i", "p"))
    cells = rows.select(key, F.col("p.m").cast("double").alias("m"), F.posexplode("p.t").alias("d", "x"))
    sums = cells.groupBy(key, "d").agg((F.sum(F.col("x") * F.col("m")) / F.greatest(F.sum("m"), F.lit(floor))).alias("x"))
    return sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("vec"))
