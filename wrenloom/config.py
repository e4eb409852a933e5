"""Settings: a YAML file, durations in nanoseconds, and the stage table with its defaults."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from wrenloom import schemas

NS = {"ns": 1, "us": 10**3, "µs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
_TERM = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)")
SECOND, MINUTE = NS["s"], NS["m"]


def duration_ns(text: str | int | None) -> int:
    """Nanoseconds of "1h30m", "500ms", "-2s", "0". Numbers without a unit (but for 0) and anything else: ValueError. None: 0."""
    if text is None:
        return 0
    s = str(text).strip()
    sign, s = (-1, s[1:]) if s.startswith("-") else (1, s.removeprefix("+"))
    if s == "0":
        return 0
    terms = list(_TERM.finditer(s))
    if not terms or "".join(m.group(0) for m in terms) != s:
        raise ValueError(f"not a duration: {text!r}")
    total = 0
    for m in terms:
        whole, _, part = m.group(1).partition(".")
        unit = NS[m.group(2)]
        total += int(whole or 0) * unit + (int(part) * unit // 10 ** len(part) if part else 0)
    return sign * total


def load(path: str | Path) -> dict[str, Any]:
    """The settings in a YAML file; an empty file has none."""
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


@dataclass(frozen=True)
class Stage:
    """A stage's settings, checked, with defaults for those that aren't positive."""

    stage: str
    worker_count: int
    queue_size: int
    delay_ns: int = MINUTE
    max_attempts: int = 3
    backoff_ns: int = SECOND

    def __post_init__(self) -> None:
        if self.worker_count <= 0 or self.queue_size <= 0:
            raise ValueError(f"stage {self.stage}: worker_count and queue_size must be positive")
        for name, default in (("delay_ns", MINUTE), ("max_attempts", 3), ("backoff_ns", SECOND)):
            if getattr(self, name) <= 0:
                object.__setattr__(self, name, default)


def stages(settings: dict[str, Any]) -> list[Stage]:
    """The stages of the settings, in their order there."""
    out = []
    for name, s in ((settings.get("crawler") or {}).get("stages") or {}).items():
        retry = s.get("retry") or {}
        out.append(Stage(name, int(s.get("worker_count") or 0), int(s.get("queue_size") or 0), duration_ns(s.get("delay")), int(retry.get("max_attempts") or 0), duration_ns(retry.get("backoff"))))
    return out


def stage_table(spark: SparkSession, these: list[Stage]) -> DataFrame:
    return spark.createDataFrame([(s.stage, s.worker_count, s.queue_size, s.delay_ns, s.max_attempts, s.backoff_ns) for s in these], schemas.STAGES)


def job_table(spark: SparkSession, settings: dict[str, Any]) -> DataFrame:
    jobs = (settings.get("scheduler") or {}).get("jobs") or []
    return spark.createDataFrame([(j["name"], j["type"], j["schedule"], {k: str(v) for k, v in (j.get("args") or {}).items()}) for j in jobs], schemas.JOBS)
