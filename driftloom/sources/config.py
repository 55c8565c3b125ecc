"""Layered settings: a base and a private overlay, merged object by object, checked strictly, with defaults."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields


def deep_merge(base: object, overlay: object) -> object:
    """Objects are merged key by key; lists and scalars of the overlay replace those of the base."""
    if isinstance(base, dict) and isinstance(overlay, dict):
        return base | {k: deep_merge(base[k], v) if k in base else v for k, v in overlay.items()}
    return overlay


@dataclass(frozen=True)
class Settings:
    include: tuple[str, ...] = ("**/*.ts", "**/*.js")
    ignore: tuple[str, ...] = ()
    languages: tuple[str, ...] = ("en",)
    min_score: float = 0.5
    max_sections: int = 8
    chars_per_token: int = 4
    concurrency: int = 50
    headings: dict = field(default_factory=dict)


def load_settings(*layers: str) -> Settings:
    """Settings from JSON texts, later ones on top; an unknown key is an error."""
    merged: dict = {}
    for text in layers:
        merged = deep_merge(merged, json.loads(text))
    known = {f.name for f in fields(Settings)}
    if unknown := sorted(set(merged) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in merged.items()})


def settings_fingerprint(s: Settings) -> str:
    """32 hexadecimal digits that do not depend on the order of keys."""
    return hashlib.sha256(json.dumps(asdict(s), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:32]
