"""Settings of the command line's verbs, from YAML.

``SETTINGS`` names all of them, each with its default and the values it takes.
A file gives some of them, by section; what it leaves out has its default, and
what no verb reads is kept in ``ignored``, so that a file written for more than
this engine can be used as it is.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

try:
    import yaml
except ImportError:  # settings can still be made from a mapping
    yaml = None


@dataclass(frozen=True)
class Setting:
    """A value of a kind, in the range [``low``, ``high``); ``above`` leaves out the low end."""

    kind: type
    default: Any
    low: float | None = None
    high: float | None = None
    above: bool = False

    def read(self, name: str, given: object) -> Any:
        """The value given, as the kind; ValueError if it is none or out of range."""
        number = self.kind in (int, float)
        if isinstance(given, bool) or (number and not isinstance(given, (int, float))) or (not number and not isinstance(given, self.kind)):
            raise ValueError(f"{name} must be of kind {self.kind.__name__}, not {given!r}")
        if number and not (given == given and abs(given) != float("inf")):
            raise ValueError(f"{name} must be finite")
        value = self.kind(given)
        if number and value != given:
            raise ValueError(f"{name} must be a whole number, not {given!r}")
        if self.low is not None and (value <= self.low if self.above else value < self.low):
            raise ValueError(f"{name} must be {'above' if self.above else 'at least'} {self.low}, not {given!r}")
        if self.high is not None and value >= self.high:
            raise ValueError(f"{name} must be below {self.high}, not {given!r}")
        return value


_COUNT = {"low": 1}
_SPAN = {"low": 0, "above": True}

SETTINGS: dict[str, Setting] = {
    # cutting recordings into windows
    "windows.seconds": Setting(float, 4.0, **_SPAN),
    "windows.stride": Setting(float, 4.0, **_SPAN),
    # how much a job reads, and how shards are laid out
    "publish.job_bytes": Setting(int, 64 << 30, **_COUNT),
    "publish.rows_per_batch": Setting(int, 256, **_COUNT),
    "publish.batches_per_shard": Setting(int, 16, **_COUNT),
    # The names of this section's keys, which existing files use.
    "training.epochs": Setting(int, 30, **_COUNT),
    "training.batch_size": Setting(int, 4096, **_COUNT),
    "training.lr": Setting(float, 0.05, **_SPAN),
    "training.weight_decay": Setting(float, 0.01, low=0),
    "training.label_smoothing": Setting(float, 0.0, low=0, high=1),
    "training.patience": Setting(int, 10, **_COUNT),
    "training.seed": Setting(int, 0),
}


@dataclass(frozen=True)
class Settings:
    """All settings by name, and the names given that no verb reads."""

    values: Mapping[str, Any]
    ignored: tuple[str, ...] = ()

    def __getitem__(self, name: str) -> Any:
        return self.values[name]

    def section(self, name: str) -> dict[str, Any]:
        """The settings of a section, by their own names."""
        return {k.split(".", 1)[1]: v for k, v in self.values.items() if k.startswith(f"{name}.")}


def from_mapping(given: object) -> Settings:
    """Settings of sections; ValueError where one is not a mapping or a value
    is not what its setting takes."""
    if not isinstance(given, Mapping):
        raise ValueError("settings are a mapping of sections")
    named: dict[str, Any] = {}
    for section, values in given.items():
        if not isinstance(values, Mapping):
            raise ValueError(f"section {section} is not a mapping")
        named |= {f"{section}.{k}": v for k, v in values.items()}
    read = {k: s.read(k, named[k]) if k in named else s.default for k, s in SETTINGS.items()}
    return Settings(read, tuple(sorted(named.keys() - SETTINGS.keys())))


def load(spark: SparkSession, path: str) -> Settings:
    """The settings of a YAML file in any store that Spark reads."""
    if yaml is None:
        raise RuntimeError("YAML needs the yaml package; use from_mapping")
    text = spark.read.text(path, wholetext=True).first()
    return from_mapping(yaml.safe_load(text.value if text else ""))
