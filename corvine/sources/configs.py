"""YAML configurations, read and written on the driver; without PyYAML both raise ImportError."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from .sinks import write_text


def _yaml():
    try:
        import yaml
    except ImportError as error:
        raise ImportError("YAML files need PyYAML") from error
    return yaml


def parse_yaml(text: str) -> Any:
    """The values of a YAML text; an empty one is an empty mapping."""
    return _yaml().safe_load(text) or {}


def yaml_text(config: Any) -> str:
    """Keys in their own order."""
    return _yaml().safe_dump(config, sort_keys=False)


def read_yaml(spark: SparkSession, path: str) -> Any:
    """One file, or a folder of one file, from any store that Spark reads."""
    return parse_yaml(spark.read.text(path, wholetext=True).first().value)


def write_yaml(spark: SparkSession, config: Any, path: str) -> None:
    write_text(spark, yaml_text(config).removesuffix("\n"), path)
