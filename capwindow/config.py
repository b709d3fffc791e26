"""Engine settings with their defaults, checked when they are made."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields

_SIZES = {"GB": 30, "Gb": 30, "gb": 30, "MB": 20, "Mb": 20, "mb": 20, "KB": 10, "Kb": 10, "kb": 10, "B": 0, "b": 0, "": 0}
_UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}


def parse_size(text: str) -> int:
    found = re.fullmatch(r"([0-9]+)([A-Za-z]*)", text)
    if not found or found[2] not in _SIZES:
        raise ValueError(f"no size: {text!r}")
    return int(found[1]) << _SIZES[found[2]]


def parse_duration(text: str) -> float:
    """Seconds of a text such as 20ms, 1m or 1m30s."""
    parts = re.findall(r"([0-9]+(?:\.[0-9]+)?)(ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"no duration: {text!r}")
    return sum(float(a) * _UNITS[b] for a, b in parts)


@dataclass(frozen=True)
class Log:
    batch_length: int = 100
    batch_timeout: str = "10ms"
    max_segment_size: str = "10MB"


@dataclass(frozen=True)
class Network:
    address: str = "127.0.0.1:1945"
    max_connections: int = 100
    max_message_size: str = "4KB"
    idle_timeout: str = "5m"


@dataclass(frozen=True)
class Config:
    log: Log | None = field(default_factory=Log)
    network: Network = field(default_factory=Network)
    dump_interval: str = "1m"
    clean_interval: str = "5m"
    sync_interval: str = "1s"
    sync_commit: bool = True
    replica_of: str = ""

    def __post_init__(self):
        for text in (self.dump_interval, self.clean_interval, self.sync_interval, self.network.idle_timeout):
            parse_duration(text)
        parse_size(self.network.max_message_size)
        if self.log:
            parse_duration(self.log.batch_timeout)
            parse_size(self.log.max_segment_size)
            if self.log.batch_length < 1:
                raise ValueError("a batch holds at least one record")

    @property
    def max_message(self) -> int:
        return parse_size(self.network.max_message_size)

    @property
    def writable(self) -> bool:
        """Replicas are read-only."""
        return not self.replica_of


def config_from(values: dict) -> Config:
    """A configuration from nested dictionaries, as a YAML or JSON reader gives them. Unknown names are errors."""
    known = {f.name for f in fields(Config)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    made = dict(values)
    for name, kind in (("log", Log), ("network", Network)):
        if isinstance(made.get(name), dict):
            made[name] = kind(**made[name])
    return Config(**made)


def load(path: str) -> Config:
    """A configuration from a JSON file, or from a YAML file where a YAML reader is installed."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith((".yml", ".yaml")):
        import yaml

        return config_from(yaml.safe_load(text) or {})
    return config_from(json.loads(text))
