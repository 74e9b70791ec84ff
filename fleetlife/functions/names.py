"""Model classes, series labels and bin labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FLOOR_MODELS, FOIL_MODELS, NET_MODELS


def model_class(model: Column) -> Column:
    """``candidate`` (a model under test), ``floor`` (trivial) or ``competitor``."""
    return (F.when(model.rlike("(_mlp|_zeroshot)$"), "candidate")
            .when(model.isin(*FLOOR_MODELS), "floor")
            .otherwise("competitor"))


def roster_class(model: Column, foils=FOIL_MODELS, nets=NET_MODELS) -> Column:
    """Category in the reduced roster; NULL for models outside it."""
    return (F.when(model.rlike("(_mlp|_zeroshot)$"), "candidate")
            .when(model.isin(*foils), "foil")
            .when(model.isin(*nets), "net"))


def series_label(model: Column, loss: Column) -> Column:
    """``model``, or ``model[loss]`` when the loss is not the model's own."""
    return F.when(F.coalesce(loss, F.lit("")).isin("", "native"), model).otherwise(
        F.concat(model, F.lit("["), loss, F.lit("]")))


def bin_label(lo: Column, hi: Column) -> Column:
    """``all`` for missing edges, ``≥lo`` for an open bin, else ``lo–hi``."""
    whole_lo = lo.cast("bigint").cast("string")
    return (F.when(lo.isNull(), "all")
            .when(hi == F.lit(float("inf")), F.concat(F.lit("≥"), whole_lo))
            .otherwise(F.concat(whole_lo, F.lit("–"), hi.cast("bigint").cast("string"))))
