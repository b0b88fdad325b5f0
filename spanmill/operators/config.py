"""Layered configuration: common values, those of the hardware over them, and what is left out by name."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import SparkSession

from spanmill.operators.runner import Config

try:
    import yaml
except ImportError:  # JSON files can be read without it
    yaml = None

HARDWARE = ("cuda", "cpu")


class ConfigError(ValueError):
    """A configuration that cannot be used."""


class ConfigMissing(FileNotFoundError, ConfigError):
    """There is no configuration."""


def read(path: str | Path) -> dict:
    """A JSON or YAML file as a dictionary."""
    path = Path(path)
    if not path.is_file():
        raise ConfigMissing(f"no configuration at {path}")
    try:
        if path.suffix in (".yaml", ".yml"):
            if yaml is None:
                raise ConfigError(f"{path}: no YAML parser is installed")
            held = yaml.safe_load(path.read_text())
        else:
            held = json.loads(path.read_text())
    except (ValueError, *((yaml.YAMLError,) if yaml else ())) as e:
        if isinstance(e, ConfigError):
            raise
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(held, dict):
        raise ConfigError(f"{path}: names and values are expected")
    return held


def merged(low: Mapping, high: Mapping) -> dict:
    """high over low; mappings are merged name by name at every depth, other values are replaced."""
    out = dict(low)
    for k, v in high.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def detected(spark: SparkSession | None = None) -> str:
    """cuda if executors ask for GPUs, else cpu."""
    spark = spark or SparkSession.getActiveSession()
    wanted = spark.conf.get("spark.executor.resource.gpu.amount", "0") if spark else "0"
    return "cuda" if float(wanted or 0) > 0 else "cpu"


def layered(data: Mapping, hardware: str, section: str = "harness") -> dict:
    """The section's common values with those of the hardware over them; hardware that has no values takes those of cuda."""
    held = data.get(section)
    if not isinstance(held, Mapping) or not isinstance(held.get("common"), Mapping):
        raise ConfigError(f"{section}.common is missing")
    over = held.get(hardware, held.get("cuda", {})) or {}
    if not isinstance(over, Mapping):
        raise ConfigError(f"{section}.{hardware}: names and values are expected")
    return merged(held["common"], over)


def known(values: Mapping) -> Config:
    """A Config of the names it knows; a value of another kind is an error."""
    kinds = {"models": (list, tuple), "templates": Mapping, "batch": int, "mode": str, "how": str}
    own = {k: v for k, v in values.items() if k in kinds}
    for k, v in own.items():
        if not isinstance(v, kinds[k]) or isinstance(v, bool):
            raise ConfigError(f"{k}: {type(v).__name__} is not expected")
    return Config(**{k: list(v) if k == "models" else v for k, v in own.items()})


def from_folder(folder: str | Path, hardware: str | None = None) -> Config:
    """config.yaml (or .json) with a layered section, in the folder or, for a folder named config, above it; else {hardware}.yaml or .json."""
    folder = Path(folder)
    hardware = hardware or detected()
    root = folder.parent if folder.name == "config" else folder
    for path in (root / "config.yaml", root / "config.json"):
        if path.is_file() and isinstance((data := read(path)).get("harness"), Mapping) and "common" in data["harness"]:
            return known(layered(data, hardware))
    for path in (folder / f"{hardware}.yaml", folder / f"{hardware}.json"):
        if path.is_file():
            return known(read(path))
    raise ConfigMissing(f"neither config.yaml with a harness section nor {hardware}.yaml in {folder}")
