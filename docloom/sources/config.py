"""Settings: one table of names and defaults, a TOML file, tolerant values. Secrets come from the environment and are never in DataFrames."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import Column
from pyspark.sql import functions as F

# The settings that something reads, by section, and what holds where nothing is said. Times are seconds, sizes bytes.
DEFAULTS: dict[str, dict[str, object]] = {
    "chunking": {"hard_limit": 6500},
    "image_host": {"enabled": False, "base_url": "", "token": "", "category": "", "sub_category": ""},
    "output": {"zh_suffix": ".zh.md"},
    "parser": {"base_url": "", "token": "", "language": "en", "model_version": "vlm", "enable_formula": True, "poll_timeout": 3600.0, "poll_interval": 3.0, "read_timeout": 600.0, "write_timeout": 600.0, "connect_timeout": 5.0},
    "translation": {"target_lang": "简体中文", "request_interval": 3.0, "backoff_base": 2.0, "max_retries": 2, "concurrency": 1},
    "translator": {"base_url": "", "api_key": "", "model": "", "top_p": 0.9, "temperature": 0.7, "read_timeout": 600.0, "write_timeout": 300.0, "connect_timeout": 5.0},
}
#: What a section needs to be configured.
NEEDED = {"parser": ("token",), "translator": ("api_key",), "image_host": ("base_url", "token")}
#: Environment variables of the settings that are secret.
SECRETS = {("parser", "token"): "DOCLOOM_PARSER_TOKEN", ("translator", "api_key"): "DOCLOOM_TRANSLATOR_KEY", ("image_host", "token"): "DOCLOOM_IMAGE_HOST_TOKEN"}


class Section(SimpleNamespace):
    """The settings of a section as attributes."""

    def __init__(self, name: str = "chunking", said: dict[str, object] | None = None) -> None:
        super().__init__(**{key: typed((said or {}).get(key), default) for key, default in DEFAULTS[name].items()})
        self._name = name

    @property
    def configured(self) -> bool:
        return all(getattr(self, key) for key in NEEDED.get(self._name, ()))


class Config(SimpleNamespace):
    """A Section for each section, and config_dir, where they were read."""

    def __init__(self, said: dict[str, dict[str, object]] | None = None, config_dir: str = "") -> None:
        super().__init__(**{name: Section(name, (said or {}).get(name)) for name in DEFAULTS}, config_dir=config_dir)


def config_dirs(cwd: Path | None = None) -> list[Path]:
    """Where settings may be: DOCLOOM_CONFIG_DIR, the user's application data, config/ at the root of the project around cwd."""
    found = [Path(os.environ[v]) / tail for v, tail in (("DOCLOOM_CONFIG_DIR", ""), ("APPDATA", "docloom/config")) if os.environ.get(v)]
    start = (cwd or Path.cwd()).resolve()
    root = next((p for p in (start, *start.parents) if (p / "pyproject.toml").exists() or (p / ".git").exists()), None)
    return found + ([root / "config"] if root else [])


def locate(cwd: Path | None = None) -> Path | None:
    return next((p for p in config_dirs(cwd) if p.is_dir()), None)


def _toml(path: Path) -> dict:
    try:
        return tomllib.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}


def typed(value: object, default: object) -> object:
    """A value as the default's type; the default where that fails or nothing is given."""
    if value is None:
        return default
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).lower() in ("true", "1", "yes", "on")
    try:
        return type(default)(value)
    except (TypeError, ValueError):
        return default


def load(cwd: Path | None = None) -> Config:
    """Settings from the first of user.toml and user/user.toml that holds any; secrets from the environment only."""
    folder = locate(cwd)
    file = next((t for p in ("user.toml", "user/user.toml") if folder and (t := _toml(folder / p))), {})
    said = {name: dict(own) for name, own in file.items() if isinstance(own, dict)}
    for (section, key), variable in SECRETS.items():
        said.setdefault(section, {})[key] = os.environ.get(variable)
    return Config(said, str(folder) if folder else "")


def masked(secret: str) -> str:
    """Enough of a secret to tell it from another one."""
    return "(not set)" if not secret else "****" if len(secret) <= 8 else f"{secret[:4]}****{secret[-4:]}"


def masked_column(secret: Column) -> Column:
    """The same of a column."""
    ends = F.concat(F.left(secret, F.lit(4)), F.lit("****"), F.right(secret, F.lit(4)))
    return F.when(F.coalesce(secret, F.lit("")) == "", "(not set)").when(F.length(secret) <= 8, "****").otherwise(ends)
