"""Tunables, each overridden by an environment variable DREDGE_<NAME>, and the size parser."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields

UNITS = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30}


def parse_size(text: str) -> int:
    """Bytes of ``10``, ``10K``, ``2M`` or ``1G`` (either case, an optional trailing B)."""
    m = re.fullmatch(r"(\d+)([KMG]?)B?", text.strip().upper(), re.ASCII)
    if not m:
        raise ValueError(f"bad size {text!r}")
    return int(m[1]) * UNITS[m[2]]


@dataclass(frozen=True)
class EngineConf:
    """Limits of files and of the index, the pace of changes, and defaults of searches.

    engine: auto, disk or memory: whether a command reads an index; auto takes one from ``disk_engine_mb`` on.
    """

    max_filesize_mb: int = 2
    max_index_mb: int = 256
    debounce_ms: int = 200
    barrier_timeout_ms: int = 2000
    limit: int = 2000
    max_columns: int = 0
    rebuild_interval_ms: int = 20_000
    rebuild_threshold: int = 20
    shard_target_mb: int = 80
    shard_min_mb: int = 32
    overflow: int = 10_000
    engine: str = "auto"
    disk_engine_mb: int = 10
    exclude: tuple[str, ...] = field(default=())
    gitignore: bool = False

    def uses_index(self, total_bytes: int) -> bool:
        """Whether a corpus of so many bytes is worth an index."""
        return self.engine == "disk" or (self.engine == "auto" and total_bytes >= self.disk_engine_mb << 20)

    @classmethod
    def load(cls, env: dict[str, str] | None = None) -> EngineConf:
        """The defaults with what the environment sets; values that don't parse are left alone."""
        env = dict(os.environ) if env is None else env
        values = {}
        for f in fields(cls):
            raw = env.get(f"DREDGE_{f.name.upper()}")
            if raw is None:
                continue
            if f.name == "exclude":
                values[f.name] = tuple(x for x in raw.split(",") if x)
            elif f.name == "gitignore":
                values[f.name] = raw.lower() in ("1", "true", "yes", "on")
            elif f.name == "engine":
                if raw in ("auto", "disk", "memory"):
                    values[f.name] = raw
            elif raw.lstrip("-").isdigit():
                values[f.name] = int(raw)
        return cls(**values)

    def overrides(self) -> list[str]:
        """The settings that differ from the defaults, as name=value."""
        base = EngineConf()
        return [f"{f.name}={getattr(self, f.name)}" for f in fields(self) if getattr(self, f.name) != getattr(base, f.name)]
