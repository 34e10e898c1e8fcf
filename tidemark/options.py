"""Options that change results: command line over configuration over defaults, validated."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace

from .functions.durations import option_ms


class OptionError(ValueError):
    pass


@dataclass(frozen=True)
class FilterOptions:
    """A list of names to deny (or allow), as literals or patterns."""

    items: tuple[str, ...] = ()
    is_list_ignored: bool = True
    regex: bool = False
    case_sensitive: bool = False
    whole_word: bool = False


@dataclass(frozen=True)
class Options:
    # Defaults, in milliseconds where they are times.
    rate: int = 1_000
    retention: int = 600_000
    default_time_value: int = 60_000
    time_delta: int = 15_000
    temperature_type: str = "celsius"
    network_use_bytes: bool = False
    network_use_log: bool = False
    network_use_binary_prefix: bool = False
    show_packets: bool = False
    network_start_zeroed: bool = False
    include_unmounted: bool = False
    process_command: bool = False
    mem_as_value: bool = False
    grouped: bool = False
    tree: bool = False
    tree_collapse: bool = False
    hide_kernel_threads: bool = False
    get_threads: bool = False
    regex: bool = False
    case_sensitive: bool = False
    whole_word: bool = False
    current_usage: bool = False
    unnormalized_cpu: bool = False
    hide_avg_cpu: bool = False
    show_decimal: bool = False
    cache_memory: bool = False
    free_arc: bool = False
    history_window: int = 3_600_000
    history_bucket: int = 60_000
    include_subagents: bool = False
    filters: dict[str, FilterOptions] = field(default_factory=dict)

    def __post_init__(self) -> None:
        # Least values, in milliseconds.
        for name, least in (("rate", 250), ("retention", 1_000), ("default_time_value", 30_000), ("time_delta", 1_000)):
            if getattr(self, name) < least:
                raise OptionError(f"{name} must be at least {least} milliseconds")
        for name in ("default_time_value", "time_delta"):
            if getattr(self, name) > self.retention:
                raise OptionError(f"{name} must be at most the retention of {self.retention} milliseconds")
        if self.temperature_type not in ("celsius", "kelvin", "fahrenheit"):
            raise OptionError(f"{self.temperature_type!r} is no unit of temperature")

    def zoomed(self, window_ms: int, steps: int) -> int:
        """The window after so many steps out (or in, below 0), from the least window to the retention."""
        return min(max(window_ms + steps * self.time_delta, 30_000), self.retention)

    def default_sort(self, column: str | None = None) -> str:
        return column or ("pid" if self.tree else "cpu")


_SHORT = {"c": "celsius", "k": "kelvin", "f": "fahrenheit"}


def _value(name: str, value):
    known = {f.name: f for f in fields(Options)}
    if name not in known:
        raise OptionError(f"unknown option {name!r}")
    default = known[name].default
    if isinstance(default, bool):
        if not isinstance(value, bool):
            raise OptionError(f"{name} must be true or false")
        return value
    if isinstance(default, int):
        try:
            return value if isinstance(value, int) else option_ms(value)
        except ValueError as e:
            raise OptionError(f"{name}: {e}") from e
    if name == "temperature_type":
        return _SHORT.get(str(value).lower(), str(value).lower())
    if name == "filters":
        return {k: FilterOptions(**{"items": tuple(v.get("list", ()))} | {x: y for x, y in v.items() if x != "list"}) for k, v in value.items()}
    return value


def resolve(cli: dict | None = None, config: dict | str | None = None) -> Options:
    """Options from the command line, a configuration (a dict, or TOML with a table [flags]) and the defaults, in this order."""
    if isinstance(config, str):
        try:
            parsed = tomllib.loads(config)
        except tomllib.TOMLDecodeError as e:
            raise OptionError(str(e)) from e
        config = parsed.get("flags", {}) | ({"filters": parsed["filters"]} if "filters" in parsed else {})
    layered = (config or {}) | {k: v for k, v in (cli or {}).items() if v is not None}
    return replace(Options(), **{k: _value(k, v) for k, v in layered.items()})
