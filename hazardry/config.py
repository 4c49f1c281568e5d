"""Configuration trees: YAML files, merged in order, with ``${NAME:default}`` filled from the environment."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

_VARIABLE = re.compile(r"\$\{(\w+)(?::([^}]*))?\}")


def merged(*trees: Mapping) -> dict:
    """Deep merge; of two values for a key the later wins, of two mappings each key."""
    out: dict = {}
    for tree in trees:
        for key, value in tree.items():
            both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
            out[key] = merged(out[key], value) if both else value
    return out


def expanded(value: Any, env: Mapping[str, str] | None = None) -> Any:
    """Every string of a tree with its variables filled in; a home directory mark is expanded as well."""
    env = os.environ if env is None else env
    if isinstance(value, Mapping):
        return {k: expanded(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v, env) for v in value]
    if isinstance(value, str) and _VARIABLE.search(value):
        return os.path.expanduser(_VARIABLE.sub(lambda m: env.get(m[1], m[2] or ""), value))
    return value


def load(*paths: str | Path) -> dict:
    """Merge YAML files, the last one winning."""
    import yaml

    return expanded(merged(*(yaml.safe_load(Path(p).read_text(encoding="utf-8")) or {} for p in paths)))


def choose(given: Any, configured: Any, default: Any = None) -> Any:
    """The first that is not None: a given 0 counts."""
    return next((x for x in (given, configured) if x is not None), default)
