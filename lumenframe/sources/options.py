"""Typed options of the stages, bound from a configuration's sections, and what the engine says about itself."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession

from lumenframe.sources.tables import load_bank, save_bank


@dataclass(frozen=True)
class Detection:
    confidence: float = 0.35
    overlap: float = 0.45


@dataclass(frozen=True)
class Tracking:
    match_iou: float = 0.25
    displacement: float = 0.35
    missed: int = 10
    video_missed: int = 4
    timeout_s: float = 5.0


@dataclass(frozen=True)
class Aggregation:
    least: int = 5
    margin: float = 0.12
    consensus: float = 0.65
    window: int = 10


@dataclass(frozen=True)
class Brands:
    similarity: float = 0.40
    margin: float = 0.02
    person_height: int = 180
    region: int = 32
    logo: int = 24
    every: int = 12


@dataclass(frozen=True)
class Watch:
    confidence: float = 0.50
    stable: int = 3
    negative: int = 5


@dataclass(frozen=True)
class Sampling:
    fps: float = 3.0
    fallback_fps: float = 30.0


@dataclass(frozen=True)
class Options:
    """The defaults of all sections."""

    detection: Detection = field(default_factory=Detection)
    tracking: Tracking = field(default_factory=Tracking)
    aggregation: Aggregation = field(default_factory=Aggregation)
    brands: Brands = field(default_factory=Brands)
    watch: Watch = field(default_factory=Watch)
    sampling: Sampling = field(default_factory=Sampling)


def bind(kind: type, values: dict):
    """An instance with the values given, by name; names that it doesn't have are an error, missing ones keep their default."""
    known = {f.name: getattr(kind(), f.name) for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown options: {sorted(unknown)}")
    return kind(**{k: bind(type(known[k]), v) if is_dataclass(known[k]) else type(known[k])(v) for k, v in values.items()})


def read_options(path: str) -> Options:
    with open(path, encoding="utf-8") as f:
        return bind(Options, json.load(f))


def status(spark: SparkSession, options: Options = Options(), models: dict[str, bool] | None = None) -> DataFrame:
    """One row: whether all models are there, which are not, and the options as text."""
    models = models or {}
    missing = sorted(k for k, there in models.items() if not there)
    row = ("degraded" if missing else "healthy", spark.version, len(models), missing, json.dumps(asdict(options), sort_keys=True))
    return spark.createDataFrame([row], "status string, engine string, models int, missing array<string>, options string")


def cached_bank(spark: SparkSession, path: str, model_sha: str, content_sha: str, dim: int, compute: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """The cached vectors if they still match; else computed ones, written for the next time if that is possible. And which it was."""
    found, why = load_bank(spark, path, model_sha, content_sha, dim)
    if found is not None:
        return found, "cached"
    made = compute()
    try:
        save_bank(made, path, model_sha, content_sha)
    except Exception as e:  # a folder that can't be written costs the cache, not the result
        return made, f"computed, not kept: {type(e).__name__}"
    return load_bank(spark, path, model_sha, content_sha, dim)[0] or made, f"computed: {why}"
