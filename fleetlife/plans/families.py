"""Loading a fleet by its name: raw files or raw tables of its family -> train, test and truth -> labelled frames.

``LOADERS`` maps a family to its file reader; ``FAMILY`` maps a dataset to its family. Each reader has a twin on
tables (``turbofan``, ``bearing``, ``flight``), which the files are scanned into: one scan for all files of a role, the dataset
or member taken from the path. A loaded ``Fleet`` has whole train lives, and test units that end before failure.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (
    BEARING_TEST_UNITS, CYCLE, DEFAULT_CHANNELS, FAMILIES, FLIGHT_SCENARIO, FLIGHT_SENSORS, KEYS, MULTI_CONDITION, UNION_MEMBERS, UNIT,
    content_hash,
)
from ..operators.conditions import normalize_conditions
from ..operators.labels import label_test, label_train, truncate_units, union_stride
from ..operators.numbering import number_rows
from ..operators.perturb import inject_split
from ..session import work_dir
from ..sources import files
from ..sources.store import materialize, source_key

FAMILY = {dataset: family for family, names in FAMILIES.items() for dataset in names}


@dataclass(frozen=True)
class Settings:
    """What a load depends on, beside the files: the cap of the labels, and how test units are cut."""

    max_rul: float = 125
    window: int = 30
    fraction: float = 0.6
    test_units: tuple[str, ...] = BEARING_TEST_UNITS
    members: tuple[str, ...] | None = None
    by_condition: bool | None = None
    noise: dict | None = field(default=None, hash=False)
    seed: int = 42


@dataclass(frozen=True)
class Fleet:
    """``test`` carries ``n_obs`` and ``rul_truth`` where its units were cut here, and ``truth`` says so too; where the
    truth was given, ``test`` does not have it."""

    family: str
    train: DataFrame
    test: DataFrame
    truth: DataFrame


def family_of(dataset: str) -> str:
    if dataset not in FAMILY:
        raise ValueError(f"unknown dataset {dataset!r}; known: {sorted(FAMILY)}")
    return FAMILY[dataset]


# ---- tables -------------------------------------------------------------------------------------
def turbofan(lines: DataFrame, truth_lines: DataFrame, order: list[str]) -> Fleet:
    """Cycle text (dataset, split, value) and truth text (dataset, value, and the columns of ``order``)."""
    train, test = (files.parse_cycle_lines(lines.where(F.col("split") == s), F.col("dataset")) for s in ("train", "test"))
    return Fleet("turbofan", train, test, files.parse_truth_lines(truth_lines, F.col("dataset"), order))


def bearing(frame: DataFrame, test_units: Sequence[str], fraction: float, window: int) -> Fleet:
    """Snapshots of whole lives with ``unit_name``. Named units are cut for testing; all others train. Units that are
    not there, or no unit left for either part, are an error."""
    names = sorted(set(test_units))
    named = F.col("unit_name").isin(names)
    facts = frame.agg(F.collect_set(F.when(named, F.col("unit_name"))).alias("there"), F.count_if(~named).alias("rest")).first()
    missing = sorted(set(names) - set(facts["there"]))
    if missing:
        raise ValueError(f"test units not in the data: {missing}")
    if not names or not facts["rest"]:
        raise ValueError("a fleet needs units to train on and units to test")
    test, truth = truncate_units(frame.where(named), fraction, window)
    return Fleet("bearing", frame.where(~named), test, truth)


def flight(cycles: DataFrame, fraction: float, window: int, union: str | None = None, stride: int = 1000,
           written: bool = False) -> Fleet:
    """Cycles of whole lives with ``split`` (dev or test); gaps in a unit's cycles are closed. With ``union`` the datasets become
    one of that name: unit ids are ``stride * position + unit``, by the sorted names of the members (as ``member``), where
    ``stride`` is above every unit id. Test units are cut, all members in one plan. The cycles are written once, unless
    they are a ``written`` table already, and again with their numbers: sizes, places, lengths and both parts are read
    from these tables, not made from the seconds or sorted each time."""
    base, key = work_dir(cycles.sparkSession), uuid.uuid4().hex
    if not written:
        cycles = materialize(cycles, base, f"cycles_{key}")
    rows = number_rows(cycles.withColumnRenamed(CYCLE, "source_cycle"), KEYS, ["source_cycle"], CYCLE)
    if union:
        names = rows.select("dataset").distinct()
        # One row per member.
        place = number_rows(names.withColumn("_all", F.lit(0)), ["_all"], ["dataset"], "_at").select("dataset", "_at")
        rows = (rows.join(F.broadcast(place), "dataset").withColumnRenamed("dataset", "member")
                .withColumns({"dataset": F.lit(union), UNIT: F.col(UNIT) + (F.col("_at") - 1) * stride}).drop("_at"))
    rows = materialize(rows, base, f"numbered_{key}")
    train, test = rows.where("split = 'dev'"), rows.where("split = 'test'")
    cut, truth = truncate_units(test, fraction, window)
    return Fleet("flight", train.drop("split"), cut.drop("split"), truth)


# ---- files --------------------------------------------------------------------------------------
def read_turbofan(spark: SparkSession, root: str, datasets: Sequence[str], settings: Settings) -> Fleet:
    """``train_<dataset>.txt``, ``test_<dataset>.txt`` and ``RUL_<dataset>.txt`` of all datasets, one scan per kind."""
    def scan(kind):
        paths = [f"{root}/{kind}_{d}.txt" for d in datasets]
        name = F.regexp_extract(F.col("_metadata.file_name"), r"_([^_.]+)\.txt$", 1)
        return spark.read.text(paths).select("value", name.alias("dataset"), F.col("_metadata.file_block_start").alias("_block"),
                                             F.monotonically_increasing_id().alias("_line"))

    lines = [scan(kind).select("value", "dataset", F.lit(kind).alias("split")) for kind in ("train", "test")]
    return turbofan(lines[0].union(lines[1]), scan("RUL"), ["_block", "_line"])


def read_bearing(spark: SparkSession, root: str, datasets: Sequence[str], settings: Settings) -> Fleet:
    """A tree of snapshots of one dataset."""
    (name,) = datasets
    return bearing(files.read_snapshot_tree(spark, root, name), settings.test_units, settings.fraction, settings.window)


def read_flight(spark: SparkSession, root: str, datasets: Sequence[str], settings: Settings,
                channels: Sequence[str] = (*FLIGHT_SCENARIO, *FLIGHT_SENSORS), store: str | None = None) -> Fleet:
    """``<member>_dev.parquet`` and ``<member>_test.parquet`` of all members in one scan. A dataset of ``UNION_MEMBERS`` is
    the union of its members, or of those of the settings (two at least). With ``store``, a shared folder, the
    cycles are written once there for the files as they are."""
    union = datasets[0] if len(datasets) == 1 and datasets[0] in UNION_MEMBERS else None
    members = list(datasets)
    if union:
        members = sorted(set(settings.members or UNION_MEMBERS[union]))
        odd = sorted(set(members) - set(UNION_MEMBERS[union]))
        if odd or len(members) < 2:
            raise ValueError(f"a union needs two of its members at least, got {members}; not among them: {odd}")
    paths = [f"{root}/{m}_{s}.parquet" for m in members for s in ("dev", "test")]
    path = F.col("_metadata.file_path")
    at = r"/([^/]+)_(dev|test)\.parquet(?:/|$)"
    seconds = spark.read.parquet(*paths).withColumns(
        {"dataset": F.regexp_extract(path, at, 1), "split": F.regexp_extract(path, at, 2)})
    cycles = files.high_rate_cycles(seconds, list(channels), ("split",))
    if store:
        key = "_".join(sorted(source_key(spark, p) for p in paths))
        cycles = materialize(cycles, store, f"cycles_{content_hash({'files': key, 'channels': list(channels)})}")
    stride = union_stride({"all": cycles if store else seconds}) if union else 1000
    return flight(cycles, settings.fraction, settings.window, union, stride, bool(store))


LOADERS: dict[str, Callable[..., Fleet]] = {"turbofan": read_turbofan, "bearing": read_bearing, "flight": read_flight}


def load(spark: SparkSession, root: str, datasets: str | Sequence[str], settings: Settings = Settings(), **options) -> Fleet:
    """The fleet of a dataset, or of several of one family, from the files under ``root``."""
    names = [datasets] if isinstance(datasets, str) else list(datasets)
    families = {family_of(d) for d in names}
    if len(families) != 1:
        raise ValueError(f"datasets of one family are loaded together, got {sorted(families)}")
    return LOADERS[families.pop()](spark, root, names, settings, **options)


# ---- the one loading path -----------------------------------------------------------------------
def prepared(fleet: Fleet, settings: Settings, channels: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels, then scaling by condition, then noise. Datasets with several conditions are scaled unless the settings say
    otherwise; in one plan also where only some of the datasets are."""
    names = list(channels or DEFAULT_CHANNELS[fleet.family])
    given = None if "rul_truth" in fleet.test.columns else fleet.truth
    frames = label_train(fleet.train, settings.max_rul), label_test(fleet.test, given, settings.max_rul)
    if settings.by_condition is not False:
        own = {f"_own_{c}": F.col(c) for c in names}
        scaled = normalize_conditions(*(f.withColumns(own) for f in frames), names)
        several = F.lit(True) if settings.by_condition else F.col("dataset").isin(*MULTI_CONDITION)
        frames = tuple(f.withColumns({c: F.when(several, F.col(c)).otherwise(F.col(f"_own_{c}")) for c in names}).drop(*own)
                       for f in scaled)
    return inject_split(*frames, names, settings.noise, settings.seed, fleet.family) if settings.noise else frames


def load_prepared(spark: SparkSession, root: str, datasets: str | Sequence[str], settings: Settings = Settings(),
                  channels: Sequence[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """``load`` and ``prepared``."""
    return prepared(load(spark, root, datasets, settings, **options), settings, channels)
