"""Settings, read once per process from the environment and an optional ``.env`` file."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from functools import lru_cache
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Defaults are fixed values; an environment variable of the same name, in capitals, overrides each."""

    llm_api_key: str = ""
    llm_model: str = "template"
    llm_url: str = ""
    llm_timeout_seconds: int = 120
    fetch_timeout_seconds: int = 15
    fetch_max_redirects: int = 5
    reports_dir: str = "reports"
    app_title: str = "Siftwell page audits"
    app_version: str = "0.1.0"
    debug: bool = False


def _env_file(path: Path) -> dict[str, str]:
    if not path.is_file():
        return {}
    pairs = (line.split("=", 1) for line in path.read_text(encoding="utf-8").splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip().upper(): v.strip().strip("\"'") for k, v in pairs}


def read_settings(env_file: str | Path = ".env") -> Settings:
    """Unknown names are ignored; the environment wins over the file."""
    found = _env_file(Path(env_file)) | {k.upper(): v for k, v in os.environ.items()}
    kinds = {"int": int, "bool": lambda v: v.strip().lower() in ("1", "true", "yes", "on"), "str": str}
    return Settings(**{f.name: kinds[f.type](found[f.name.upper()]) for f in fields(Settings) if f.name.upper() in found})


@lru_cache(maxsize=1)
def get_settings() -> Settings:
    return read_settings()
