"""Strict JSON reading for Python stages: numbers keep their text, no NaN, the last of equal keys counts."""

from __future__ import annotations

import json


class Number(str):
    """A JSON number as it was written."""


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


_STRICT = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_refuse)


def parse(text: str | None):
    """The value of a JSON text, or None for what is no JSON (also for the JSON null)."""
    if text is None:
        return None
    try:
        return _STRICT.decode(text.strip())
    except (ValueError, RecursionError):
        return None


def dump(value) -> str:
    """Compact JSON text with the numbers as they were written."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dump, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def as_object(value):
    """The object that `value` is, or is the JSON text of; None for anything else."""
    if isinstance(value, dict):
        return value
    if isinstance(value, str) and not isinstance(value, Number):
        inner = parse(value) if value.lstrip().startswith("{") else None
        return inner if isinstance(inner, dict) else None
    return None
