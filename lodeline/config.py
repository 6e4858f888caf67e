"""Settings of a store: which sources are read, limits, and whether contradictions are looked for."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Source:
    enabled: bool = True
    most: int | None = None


@dataclass(frozen=True)
class Contradictions:
    auto_check: bool = False
    per_sync: int = 3


@dataclass(frozen=True)
class Limits:
    budget: int = 2000
    candidates: int = 30
    half_life_days: int = 30
    settle_minutes: int = 30
    sessions_per_sync: int = 10

    def __post_init__(self):
        for f in fields(self):
            if getattr(self, f.name) <= 0:
                raise ValueError(f"{f.name} must be above 0")


@dataclass(frozen=True)
class Settings:
    git: Source = Source()
    diff: Source = Source(most=200)
    shell: Source = Source()
    docs: Source = Source()
    conversation: Source = Source()
    sessions: Source = Source(enabled=False)
    structure: Source = Source()
    limits: Limits = field(default_factory=Limits)
    contradictions: Contradictions = Contradictions()


def _filled(kind, told, at: str):
    if not isinstance(told, dict):
        raise ValueError(f"{at} must be an object")
    known = {f.name: f for f in fields(kind)}
    if unknown := set(told) - set(known):
        raise ValueError(f"{at} has no setting {sorted(unknown)}")
    default = kind()
    values = {}
    for name, value in told.items():
        had = getattr(default, name)
        if is_dataclass(had):
            values[name] = _filled(type(had), value, f"{at}.{name}")
        elif isinstance(had, bool) != isinstance(value, bool) or not isinstance(value, (bool, int)) and value is not None:
            raise ValueError(f"{at}.{name} can't be {value!r}")
        else:
            values[name] = value
    return kind(**values)


def read_settings(text: str | None) -> Settings:
    """Settings from JSON, what isn't named as by default; null or blank text gives the defaults. Raises ValueError for anything else."""
    if text is None or not text.strip():
        return Settings()
    try:
        told = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"settings aren't JSON: {e}") from e
    return _filled(Settings, told, "settings")
