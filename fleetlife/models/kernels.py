"""Random-kernel features of windows, computed in Arrow batches."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KERNEL_LENGTH = 9


def make_kernels(channels: int, window: int, count: int, seed: int) -> dict:
    """Kernels of nine weights, three of them 2 and six -1, each with a channel, a dilation that
    fits the window, and an offset; all fixed by the seed."""
    if window < KERNEL_LENGTH:
        raise ValueError(f"windows must have at least {KERNEL_LENGTH} rows")
    rng = np.random.default_rng(seed)
    spots = list(combinations(range(KERNEL_LENGTH), 3))
    weights = np.full((count, KERNEL_LENGTH), -1.0)
    for i, pick in enumerate(rng.choice(len(spots), size=count)):
        weights[i, list(spots[pick])] = 2.0
    largest = int(np.log2((window - 1) / (KERNEL_LENGTH - 1)))
    return {
        "weights": weights, "channel": rng.integers(0, channels, count),
        "dilation": 2 ** rng.integers(0, largest + 1, count), "offset": rng.normal(0.0, 2.0, count),
    }


def kernel_features(windows: DataFrame, channels: list[str], window: int, count: int = 84, seed: int = 0,
                    column: str = "win") -> DataFrame:
    """Share of positive values of each kernel's response per window: array column ``kernels``.
    Each channel is centred and scaled inside its window first."""
    kernels = make_kernels(len(channels), window, count, seed)
    names = [c for c in windows.columns if c != column]
    flat = windows.select(*names, F.flatten(F.transform(
        column, lambda s: F.array(*[s[c].cast("double") for c in channels]))).alias("_x"))
    schema = flat.select(*names, F.array().cast("array<double>").alias("kernels")).schema
    width, reach = len(channels), KERNEL_LENGTH

    def run(batches):
        for batch in batches:
            x = np.stack(batch["_x"].to_numpy()).reshape(len(batch), window, width)
            sd = x.std(axis=1, keepdims=True)
            x = (x - x.mean(axis=1, keepdims=True)) / np.where(sd < 1e-8, 1.0, sd)
            out = np.empty((len(batch), count))
            for i in range(count):
                step = int(kernels["dilation"][i])
                span = window - (reach - 1) * step
                series = x[:, :, kernels["channel"][i]]
                response = sum(w * series[:, j * step:j * step + span] for j, w in enumerate(kernels["weights"][i]))
                out[:, i] = (response > kernels["offset"][i]).mean(axis=1)
            yield batch[names].assign(kernels=list(out))

    return flat.mapInPandas(run, schema)
