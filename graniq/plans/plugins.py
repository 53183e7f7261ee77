"""Plug-ins of a record pipeline: registered transforms of DataFrames with checked settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

KINDS = ["source", "enrich", "score", "match", "export"]
TYPES = ["text", "textarea", "number", "bool", "select", "secret", "collection", "folder"]


@dataclass(frozen=True)
class Setting:
    key: str
    type: str = "text"
    default: Any = None
    options: tuple = ()
    required: bool = False


@dataclass(frozen=True)
class Plugin:
    id: str
    kind: str
    name: str
    run: Callable[[DataFrame, dict[str, Any]], DataFrame]
    settings: tuple[Setting, ...] = ()


@dataclass
class Registry:
    plugins: dict[str, Plugin] = field(default_factory=dict)

    def register(self, plugin: Plugin) -> Plugin:
        if plugin.id in self.plugins:
            raise ValueError(f"plug-in {plugin.id} is there already")
        if plugin.kind not in KINDS or any(s.type not in TYPES for s in plugin.settings):
            raise ValueError(f"plug-in {plugin.id} has an unknown kind or setting type")
        self.plugins[plugin.id] = plugin
        return plugin

    def catalog(self) -> list[Plugin]:
        return sorted(self.plugins.values(), key=lambda p: (KINDS.index(p.kind), p.id))


def _number(value: Any) -> float | int:
    number = float(value)
    return int(number) if number.is_integer() else number


def _flag(value: Any) -> bool:
    return value if isinstance(value, bool) else str(value).strip().lower() in {"1", "true", "yes", "on"}


#: How a form's value becomes one of a type; other types are texts.
CONVERT: dict[str, Callable[[Any], Any]] = {"number": _number, "bool": _flag}


def _setting(s: Setting, given: Any) -> Any:
    value = next((v for v in (given, s.default) if v not in (None, "")), None)
    if value is None:
        if s.required:
            raise ValueError(f"{s.key} is required")
        return False if s.type == "bool" else None
    try:
        value = CONVERT.get(s.type, str)(value)
    except (TypeError, ValueError):
        raise ValueError(f"{s.key} must be a {s.type}") from None
    if s.options and s.type not in CONVERT and value not in s.options:
        raise ValueError(f"{s.key} must be one of {', '.join(map(str, s.options))}")
    return value


def coerce(plugin: Plugin, given: dict[str, Any]) -> dict[str, Any]:
    """Settings as their types ask, from what a form sends; missing required ones and bad numbers are errors."""
    return {s.key: _setting(s, given.get(s.key)) for s in plugin.settings}


@dataclass
class Run:
    """What a pipeline step did."""

    plugin: str
    status: str
    error: str = ""
    log: list[str] = field(default_factory=list)


def run_pipeline(registry: Registry, steps: list[tuple[str, dict[str, Any]]], df: DataFrame) -> tuple[DataFrame, list[Run]]:
    """Apply the steps in order, lazily. A step that can't be planned is recorded and passed over, not raised."""
    runs = []
    for name, given in steps:
        plugin = registry.plugins[name]
        try:
            df = plugin.run(df, coerce(plugin, given))
            runs.append(Run(name, "done"))
        except Exception as e:  # noqa: BLE001 a plug-in's own failure is a result here
            runs.append(Run(name, "failed", str(e)[:20000]))
    return df, runs
