"""Settings from a file with ${VARIABLE} places that the environment fills."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

_PLACE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")


def fill(value: Any, env: Mapping[str, str], missing: set[str]) -> Any:
    """`value` with every place filled; names without a value are collected in `missing`."""
    if isinstance(value, dict):
        return {k: fill(v, env, missing) for k, v in value.items()}
    if isinstance(value, list):
        return [fill(v, env, missing) for v in value]
    if not isinstance(value, str):
        return value
    missing.update(n for n in _PLACE.findall(value) if n not in env)
    return _PLACE.sub(lambda m: env.get(m[1], m[0]), value)


def load_config(path: str, env: Mapping[str, str] | None = None) -> dict[str, Any]:
    """The settings of a JSON or, where PyYAML is there, YAML file; raises with all variables that are missing."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        data = yaml.safe_load(text)
    except ImportError:
        data = json.loads(text)
    missing: set[str] = set()
    out = fill(data or {}, os.environ if env is None else env, missing)
    if missing:
        raise KeyError(f"missing environment variables: {', '.join(sorted(missing))}")
    return out


def check_version(stored: str | None, wanted: str) -> None:
    """Raises where a store's schema version is not the wanted one."""
    if stored != wanted:
        raise ValueError(f"schema version {stored!r} where {wanted!r} is wanted: build the store anew")
