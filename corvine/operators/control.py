"""Configuration on the driver: mappings and lists of defaults, in plain Python. Inputs are left alone; results share what didn't change."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any


def set_nested(config: Mapping[str, Any], keys: Sequence[str], value: Any) -> dict[str, Any]:
    """``config`` merged with a chain of one-key mappings that ends in the value; what isn't a mapping on the way is replaced."""
    chain = reduce(lambda inner, key: {key: inner}, reversed(keys), value)
    return merged(config, chain) if keys else value


def merged(config: Any, change: Any) -> Any:
    """``change`` laid over ``config``, level by level; a key that is new comes last."""
    if not isinstance(config, Mapping) or not isinstance(change, Mapping):
        return change
    return {**config, **{k: merged(config.get(k), v) for k, v in change.items()}}


def set_default(defaults: Sequence[Any], key: str, value: Any) -> list[Any]:
    """``defaults`` with the first entry that has the key replaced at that key, or with a new entry in front."""
    if not isinstance(defaults, list):
        raise TypeError("defaults must be a list")
    places = [i for i, entry in enumerate(defaults) if isinstance(entry, Mapping) and key in entry]
    if not places:
        return [{key: value}, *defaults]
    return [*defaults[: places[0]], {**defaults[places[0]], key: value}, *defaults[places[0] + 1 :]]
