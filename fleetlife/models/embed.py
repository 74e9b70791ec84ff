"""Embeddings of history contexts: a built-in random projection, and the plug-in job."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import KEYS
from ..operators.windows import loc_scale

LOCSCALE = "array<struct<loc:double,scale:double>>"


def weight(seed: int, channel: int, dim: int) -> float:
    """Projection weight in [-1, 1), fixed by its place and the seed."""
    text = hashlib.md5(f"{seed}|{channel}|{dim}".encode()).hexdigest()
    return 2.0 * int(text[:8], 16) / 4294967296.0 - 1.0


def projection_embedding(frame: DataFrame, channels: list[str], length: int, dims: int, seed: int,
                         scale: float = 1.0, min_cycle: int = 1, keep: tuple = ()) -> DataFrame:
    """Default embedder: tanh of a seeded projection of each channel's context mean, one patch
    vector per channel. Columns ``emb`` (variates x dims) and ``locscale``; no array of raw rows
    is built."""
    stats = loc_scale(frame, channels, length, min_cycle, keep)
    emb = F.array(*[
        F.array(*[F.tanh(F.col(f"{c}_loc") * (weight(seed, i, d) / scale)) for d in range(dims)])
        for i, c in enumerate(channels)])
    pairs = F.array(*[F.struct(F.col(f"{c}_loc").alias("loc"), F.col(f"{c}_scale").alias("scale"))
                      for c in channels])
    return stats.select(*KEYS, "end_cycle", *keep, emb.alias("emb"), pairs.alias("locscale"))


def embed_contexts(ctx: DataFrame, make: Callable[[], object], column: str = "ctx",
                   batch_size: int = 256) -> DataFrame:
    """Plug-in embedder. ``make()`` runs once per task and returns an object with
    ``embed_windows(list of (L, C) arrays) -> (embeddings (N, F), loc/scale (N, C, 2))``; rows are
    handed over ``batch_size`` at a time and stay in their partition. The context column becomes
    ``emb`` and ``locscale``."""
    names = [c for c in ctx.columns if c != column]
    kind = ctx.schema[column].dataType.elementType
    fields = [f.name for f in kind.fields] if isinstance(kind, T.StructType) else None
    values = F.transform(column, lambda s: F.array(*[s[f].cast("float") for f in fields])) if fields else F.col(column)
    flat = ctx.select(*names, F.flatten(values).alias(column), F.size(column).alias("_rows"))
    schema = ctx.select(
        *names, F.array().cast("array<float>").alias("emb"), F.array().cast(LOCSCALE).alias("locscale")).schema

    def run(batches):
        model = make()
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start:start + batch_size]
                series = [np.asarray(x, dtype=np.float32).reshape(n, -1) for x, n in zip(part[column], part["_rows"])]
                emb, ls = model.embed_windows(series)
                yield part[names].assign(
                    emb=pd.Series([e.astype(np.float32) for e in np.asarray(emb)], index=part.index, dtype=object),
                    locscale=pd.Series([[{"loc": float(a), "scale": float(b)} for a, b in w] for w in np.asarray(ls)],
                                       index=part.index, dtype=object))

    return flat.mapInPandas(run, schema)
