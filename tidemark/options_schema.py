"""The options as a JSON schema, and what is wrong with a configuration, place by place."""

from __future__ import annotations

import tomllib
from dataclasses import fields
from typing import Any

from .functions.durations import option_ms
from .options import FilterOptions, Options

DRAFT = "https://json-schema.org/draft/2020-12/schema"
# Least numbers of milliseconds, and the choices of options that have some.
LEAST = {"rate": 250, "retention": 1_000, "default_time_value": 30_000, "time_delta": 1_000}
CHOICES = {"temperature_type": ("celsius", "kelvin", "fahrenheit", "c", "k", "f")}
ABOUT = {
    "rate": "Time between two samples.", "retention": "Age beyond which samples go.", "default_time_value": "Time that a graph shows at first.",
    "time_delta": "By how much a graph's time changes at a step.", "temperature_type": "Unit of temperatures.", "network_use_bytes": "Network rates in bytes, not bits.",
    "network_use_log": "A logarithmic axis for network rates.", "network_use_binary_prefix": "Prefixes of network rates by 1024.", "show_packets": "Packet rates and average packet sizes.",
    "network_start_zeroed": "Network totals count from the first sample.", "include_unmounted": "Disks without a mount point, too.", "process_command": "Commands in place of names.",
    "mem_as_value": "Memory in bytes, not percent.", "grouped": "Processes of one name in a row.", "tree": "Processes as a tree.", "tree_collapse": "Trees begin collapsed.",
    "hide_kernel_threads": "Without kernel threads.", "get_threads": "Threads of processes, too.", "regex": "Searches are regular expressions.", "case_sensitive": "Searches tell upper from lower case.",
    "whole_word": "Searches match whole texts.", "current_usage": "CPU shares of what is in use, not of all there is.", "unnormalized_cpu": "CPU shares of one core.",
    "hide_avg_cpu": "Without the average of the cores.", "show_decimal": "CPU shares with a digit.", "cache_memory": "Cache as a kind of memory.", "free_arc": "Used memory without what the ZFS cache would give back.",
    "history_window": "Time that the token history covers.", "history_bucket": "Width of a bucket of the token history.", "include_subagents": "Logs of subagents in the token history, too.",
    "filters": "Lists of names, by what they are names of.",
}
FILTER_ABOUT = {
    "list": "Names, or patterns.", "is_list_ignored": "What matches is dropped; else all others are.", "regex": "Names are regular expressions.",
    "case_sensitive": "Names tell upper from lower case.", "whole_word": "Names match whole texts.",
}


def _filter_schema() -> dict:
    flags = {f.name: {"type": "boolean", "default": f.default} for f in fields(FilterOptions) if f.name != "items"}
    properties = {"list": {"type": "array", "items": {"type": "string"}, "default": []}} | flags
    return {"type": "object", "additionalProperties": False, "properties": {k: v | {"description": FILTER_ABOUT[k]} for k, v in properties.items()}}


def _option_schema(name: str, default: Any) -> dict:
    if isinstance(default, bool):
        out = {"type": "boolean", "default": default}
    elif isinstance(default, int):  # milliseconds, or a text such as 5m
        out = {"type": ["integer", "string"], "minimum": LEAST.get(name, 0), "default": default}
    else:
        out = {"type": "string", "enum": list(CHOICES[name]), "default": default}
    return out | {"description": ABOUT[name]}


def schema() -> dict:
    """The schema of a configuration: a table `flags` of the options and a table `filters` of lists."""
    flags = {f.name: _option_schema(f.name, f.default) for f in fields(Options) if f.name != "filters"}
    return {
        "$schema": DRAFT,
        "type": "object",
        "additionalProperties": False,
        "properties": {
            "flags": {"type": "object", "additionalProperties": False, "properties": flags},
            "filters": {"type": "object", "additionalProperties": _filter_schema(), "description": ABOUT["filters"]},
        },
    }


_KINDS = {"boolean": bool, "integer": int, "string": str, "array": list, "object": dict}


def _check(value: Any, rule: dict, path: str, out: list[str]) -> None:
    kinds = rule["type"] if isinstance(rule["type"], list) else [rule["type"]]
    if not any(isinstance(value, _KINDS[k]) and (k == "boolean" or not isinstance(value, bool)) for k in kinds):
        out.append(f"{path}: must be {' or '.join(kinds)}")
        return
    if "enum" in rule and value.lower() not in rule["enum"]:
        out.append(f"{path}: must be one of {', '.join(rule['enum'])}")
    if "minimum" in rule:
        try:
            if (value if isinstance(value, int) else option_ms(value)) < rule["minimum"]:
                out.append(f"{path}: must be at least {rule['minimum']} milliseconds")
        except ValueError as e:
            out.append(f"{path}: {e}")
    if isinstance(value, list):
        for i, x in enumerate(value):
            _check(x, rule["items"], f"{path}[{i}]", out)
    if isinstance(value, dict):
        known, others = rule.get("properties", {}), rule.get("additionalProperties", True)
        for k, x in value.items():
            inner = known.get(k, others)
            if inner is False:
                out.append(f"{path}.{k}: unknown".removeprefix("."))
            elif inner is not True:
                _check(x, inner, f"{path}.{k}".removeprefix("."), out)


def problems(config: dict | str) -> list[str]:
    """What is wrong with a configuration (a dict, or TOML), each with its path; nothing if it is valid."""
    if isinstance(config, str):
        try:
            config = tomllib.loads(config)
        except tomllib.TOMLDecodeError as e:
            return [f"not TOML: {e}"]
    out: list[str] = []
    _check(config, schema(), "", out)
    return out
