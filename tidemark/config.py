"""Configuration from a file of `key: value` lines or JSON, with the environment above it."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from .plans.drift import Config

PREFIX = "TIDEMARK_"


def load(path: str | None = None, required: tuple[str, ...] = (), env: Mapping[str, str] = os.environ) -> dict[str, Any]:
    """Settings; an environment variable TIDEMARK_<KEY> wins over the file; a missing or empty required key is an error."""
    found: dict[str, Any] = {}
    if path:
        text = Path(path).read_text(encoding="utf-8")
        found = json.loads(text) if text.lstrip().startswith("{") else dict(
            (k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in text.splitlines() if ":" in x and not x.lstrip().startswith("#")))
    found |= {k[len(PREFIX):].lower(): v for k, v in env.items() if k.startswith(PREFIX) and v}
    lacking = [k for k in required if found.get(k) in (None, "")]
    if lacking:
        raise ValueError(f"settings {lacking} are required")
    return found


def drift_config(settings: Mapping[str, Any]) -> Config:
    """The drift thresholds among the settings, others at their defaults."""
    kinds = {n: type(d) for n, d in vars(Config()).items()}
    return Config(**{n: kind(settings[n]) for n, kind in kinds.items() if n in settings})
