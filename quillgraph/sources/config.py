"""Configuration files with dotted access, and settings from them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import fields
from typing import Any

from pyspark.sql import SparkSession


class Config:
    """SRC18: a mapping whose keys are attributes too; mappings inside are Configs, and `a.b` finds b in a."""

    def __init__(self, values: dict[str, Any]):
        self._values = {k: Config(v) if isinstance(v, dict) else v for k, v in values.items()}

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_") or name not in self._values:
            raise AttributeError(f"no setting {name}")
        return self._values[name]

    def __getitem__(self, key: str) -> Any:
        first, _, rest = key.partition(".")
        value = self._values[first]
        if rest and not isinstance(value, Config):
            raise KeyError(key)
        return value[rest] if rest else value

    def get(self, key: str, default: Any = None) -> Any:
        try:
            return self[key]
        except KeyError:
            return default

    def __contains__(self, key: str) -> bool:
        missing = object()
        return self.get(key, missing) is not missing

    def __iter__(self) -> Iterator[str]:
        return iter(self._values)

    def __repr__(self) -> str:
        return f"Config({self._values})"


def load_config(spark: SparkSession, path: str) -> Config:
    """SRC18: a YAML or JSON file, from any store that Spark reads; an empty file has no settings, a missing one raises."""
    rows = spark.read.text(path, wholetext=True).collect()  # one small file
    text = rows[0].value if rows else ""
    if path.endswith(".json"):
        return Config(json.loads(text or "{}"))
    try:
        import yaml
    except ImportError as e:
        raise ValueError("YAML files need the yaml package; JSON files don't") from e
    return Config(yaml.safe_load(text) or {})


def settings_from(config: Config, kind: type, section: str = "") -> Any:
    """An instance of a dataclass from a section of a configuration; what it doesn't name keeps its default."""
    values = config.get(section, Config({})) if section else config
    return kind(**{f.name: values.get(f.name) for f in fields(kind) if f.name in values})
