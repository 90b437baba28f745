"""Configuration files that extend each other, and settings from the environment whose secrets are never shown."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from pathlib import Path


def merged(base: dict, over: dict) -> dict:
    """base with over's values; tables merge key by key, all else is replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def _parsed(path: Path) -> dict:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text) or {}
    import yaml  # only YAML files need it

    return yaml.safe_load(text) or {}


def load(path: str | Path, overrides: dict | None = None) -> dict:
    """The settings of a JSON or YAML file over those it `extends`, which may extend others; paths are relative to the file that names them. A chain that comes back to a file is an error."""

    def read(file: Path, seen: tuple[Path, ...]) -> dict:
        file = file.resolve()
        if file in seen:
            raise ValueError(f"configuration extends itself: {' -> '.join(p.name for p in (*seen, file))}")
        own = _parsed(file)
        base = own.pop("extends", None)
        return merged(read(file.parent / base, (*seen, file)), own) if base else own

    return merged(read(Path(path), ()), overrides or {})


@dataclass(frozen=True)
class Settings:
    """Endpoints and secrets of the environment."""

    values: dict[str, str]

    SECRET = ("key", "token", "password", "secret")

    @classmethod
    def from_environment(cls, prefix: str, environment: dict[str, str] | None = None) -> Settings:
        env = os.environ if environment is None else environment
        return cls({k[len(prefix) :].lower(): v for k, v in env.items() if k.startswith(prefix)})

    def shown(self) -> dict[str, str]:
        """The settings with secrets masked."""
        return {k: "***" if v and any(s in k for s in self.SECRET) else v for k, v in sorted(self.values.items())}

    def __repr__(self) -> str:
        return f"Settings({self.shown()})"
