"""Settings: defaults, then the user's file, the project's, the environment, options."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, fields, replace

UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "kib": 2**10, "mib": 2**20, "gib": 2**30}
FORMATS = ("terminal", "json", "html")
VERBOSITIES = ("quiet", "normal", "verbose")


#: Shell and tool files that are read as lines, and folders that env files are looked for in.
DOTFILES = ("~/.bashrc", "~/.zshrc", "~/.profile", "~/.bash_profile", "~/.zprofile", "~/.exports", "~/.gitconfig", "~/.config/fish/config.fish")
SEARCH_ROOTS = ("~/projects", "~/code", "~/dev", "~/repos", "~/src")


def in_home(path: str, home: str) -> str:
    """The path with a leading ``~`` or ``~/`` spelled out; others stay as they are."""
    return home if path == "~" else f"{home.rstrip('/')}/{path[2:]}" if path.startswith("~/") else path


#: Tables of a settings file, and what their keys are called here.
TABLES = {
    "scan": {
        "clipboard": "clipboard", "browser": "browser", "follow_symlinks": "follow_links", "max_file_size": "max_file_size", "max_depth": "max_depth", "dotfile_targets": "dotfiles",
        "env_search_roots": "search_roots", "extra_paths": "extra_paths", "exclude_paths": "exclude_paths", "exclude_patterns": "exclude_patterns",
    },
    "detection": {"min_confidence": "min_confidence", "entropy_enabled": "use_entropy"},
    "report": {"format": "format", "verbosity": "verbosity", "redact": "redact", "output_path": "output_path"},
}


class ConfigError(ValueError):
    """A setting that can't be read."""


def byte_size(text: str | int) -> int:
    """``10MB``, ``10MiB``, ``512B`` or a bare number of bytes."""
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]*)\s*", str(text))
    if not m or m[2].lower() not in UNITS:
        raise ConfigError(f"not a size: {text!r}")
    return int(m[1]) * UNITS[m[2].lower()]


@dataclass(frozen=True)
class Settings:
    max_file_size: int = 10 * 2**20
    max_depth: int = 10
    follow_links: bool = True
    dotfiles: tuple[str, ...] = DOTFILES
    search_roots: tuple[str, ...] = SEARCH_ROOTS
    exclude_paths: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    extra_paths: tuple[str, ...] = ()
    min_confidence: float = 0.3
    use_entropy: bool = True
    use_context: bool = True
    format: str = "terminal"
    verbosity: str = "normal"
    redact: bool = True
    incremental: bool = True
    output_path: str = ""
    #: Read from files for the sake of shared ones; there are no such sources here.
    clipboard: bool = False
    browser: bool = False

    def merged(self, values: dict) -> Settings:
        """With the values that are given; unknown names are an error."""
        known = {f.name for f in fields(self)}
        if unknown := set(values) - known:
            raise ConfigError(f"unknown settings: {sorted(unknown)}")
        own = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if v is not None}
        if "max_file_size" in own:
            own["max_file_size"] = byte_size(own["max_file_size"])
        if "min_confidence" in own:  # percent or share, never above 1
            c = float(own["min_confidence"])
            own["min_confidence"] = min(1.0, c / 100 if c > 1 else c)
        if own.get("format", FORMATS[0]) not in FORMATS or own.get("verbosity", "normal") not in VERBOSITIES:
            raise ConfigError("unknown format or verbosity")
        return replace(self, **own)

    def from_file(self, values: dict) -> Settings:
        """With the values of a settings file: flat ones, and those of the tables ``scan``, ``detection`` and
        ``report``. Unknown keys of tables are left alone, as are unknown tables; confidences in tables are per cent."""
        flat = {k: v for k, v in values.items() if not isinstance(v, dict)}
        for table, names in TABLES.items():
            own = values.get(table, {})
            if not isinstance(own, dict):
                raise ConfigError(f"{table} is not a table")
            for key, name in names.items():
                if key in own and not (key == "output_path" and own[key] == ""):
                    flat[name] = min(1.0, own[key] / 100) if key == "min_confidence" else own[key]
        return self.merged(flat)

    def at_home(self, home: str) -> Settings:
        """With ``~`` spelled out in all paths."""
        paths = ("dotfiles", "search_roots", "exclude_paths", "extra_paths")
        return replace(self, output_path=in_home(self.output_path, home), **{k: tuple(in_home(p, home) for p in getattr(self, k)) for k in paths})


@dataclass
class Layers:
    files: list[str] = field(default_factory=list)
    environment: dict[str, str] = field(default_factory=lambda: dict(os.environ))

    def load(self, options: dict | None = None) -> Settings:
        s = Settings()
        for path in self.files:
            if os.path.exists(path):
                try:
                    with open(path, "rb") as f:
                        s = s.from_file(tomllib.load(f))
                except tomllib.TOMLDecodeError as e:
                    raise ConfigError(f"{path}: {e}") from e
        for name in ("min_confidence", "format", "verbosity", "max_file_size"):
            if value := self.environment.get(f"LARKSPUR_{name.upper()}"):
                try:
                    s = s.merged({name: value})
                except ValueError:
                    continue  # bad values of the environment are ignored
        return s.merged(options or {})


def default_file(path: str, force: bool = False) -> None:
    """Write the defaults; an existing file stays unless ``force``."""
    if os.path.exists(path) and not force:
        raise ConfigError(f"{path} exists")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    say = lambda v: str(v).lower() if isinstance(v, bool) else str(list(v)) if isinstance(v, tuple) else f'"{v}"' if isinstance(v, str) else str(v)
    with open(path, "w") as f:
        f.writelines(f"{k.name} = {say(getattr(Settings(), k.name))}\n" for k in fields(Settings))
