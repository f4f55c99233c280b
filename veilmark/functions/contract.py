"""Strict JSON and a small schema language for configuration, failing at the first fault with its JSON pointer."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
_SCALARS = {"string", "integer", "number", "boolean", "null"}
#: For each key of a spec, the types it can stand with (None: any, or no type).
_APPLIES = {
    "required": None, "type": None, "validator": None, "enum": _SCALARS, "min": {"integer", "number"}, "max": {"integer", "number"},
    "min_len": {"string", "array"}, "max_len": {"string", "array"}, "item_type": {"array"}, "item_schema": {"array"}, "keys": {"object"}, "cross": {"object"},
}


class ContractError(ValueError):
    """What is wrong, and where: ``pointer`` is an RFC 6901 JSON pointer."""

    def __init__(self, pointer: str, said: str) -> None:
        super().__init__(f"{pointer or '(root)'}: {said}")
        self.pointer = pointer


def below(pointer: str, key: object) -> str:
    return f"{pointer}/{str(key).replace('~', '~0').replace('/', '~1')}"


def parse_strict(source: str | bytes, max_bytes: int = 1 << 20) -> Any:
    """JSON without a byte order mark, repeated keys, NaN or infinities, of at most ``max_bytes``."""
    raw = source.encode() if isinstance(source, str) else source
    if len(raw) > max_bytes:
        raise ContractError("", f"over {max_bytes} bytes")
    if raw.startswith(b"\xef\xbb\xbf"):
        raise ContractError("", "byte order mark")

    def unique(pairs: list[tuple[str, Any]]) -> dict:
        made = dict(pairs)
        if len(made) != len(pairs):
            raise ContractError("", "repeated key")
        return made

    def refuse(name: str) -> None:
        raise ContractError("", f"{name} is not JSON")

    try:
        return json.loads(raw.decode(), object_pairs_hook=unique, parse_constant=refuse)
    except ContractError:
        raise
    except (ValueError, RecursionError) as e:
        raise ContractError("", f"not JSON: {e}") from e


def is_kind(value: Any, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _KINDS[kind])


def _spec_faults(spec: Any) -> Iterator[str]:
    if not isinstance(spec, dict):
        yield "a spec must be an object"
        return
    if unknown := sorted(set(spec) - set(_APPLIES)):
        yield f"unknown spec keys {unknown}"
        return
    kind = spec.get("type")
    if "type" in spec and kind not in {*_KINDS, "integer", "number"}:
        yield f"unknown type {kind!r}"
    for key, kinds in _APPLIES.items():
        if key in spec and kinds is not None and kind not in kinds and not (key == "enum" and kind is None):
            yield f"{key} does not go with type {kind!r}"
    if "item_type" in spec and "item_schema" in spec:
        yield "item_type and item_schema exclude each other"
    for key in ("min", "max"):
        if key in spec and not is_kind(spec[key], "number"):
            yield f"{key} must be a number"
    for key in ("min_len", "max_len"):
        if key in spec and not (is_kind(spec[key], "integer") and spec[key] >= 0):
            yield f"{key} must be a whole number from 0"
    if spec.get("validator") is not None and not callable(spec["validator"]):
        yield "validator must be callable"
    if "cross" in spec:
        cross = spec["cross"]
        groups = cross.get("mutually_exclusive") if isinstance(cross, dict) and len(cross) == 1 else None
        if not isinstance(groups, list) or not groups or not all(isinstance(g, list) and len(g) > 1 and all(n in spec.get("keys", {}) for n in g) for g in groups):
            yield "cross must hold mutually_exclusive groups of declared keys"


def validate(value: Any, spec: dict, pointer: str = "") -> None:
    """Raise ContractError at the first fault, in the order of declaration; depth follows the schema, not the value."""
    for fault in _spec_faults(spec):
        raise ContractError(pointer, f"invalid schema: {fault}")
    kind = spec.get("type")
    if kind is not None and not is_kind(value, kind):
        raise ContractError(pointer, f"expected {kind}, found {type(value).__name__}")
    if kind == "object":
        keys = spec.get("keys", {})
        for extra in sorted(set(value) - set(keys)):
            raise ContractError(below(pointer, extra), "unknown key")
        for name, inner in keys.items():
            if name in value:
                validate(value[name], inner, below(pointer, name))
            elif not isinstance(inner, dict) or inner.get("required", True):
                raise ContractError(below(pointer, name), "required")
        for group in spec.get("cross", {}).get("mutually_exclusive", []):
            if len(both := [n for n in sorted(group) if n in value]) > 1:
                raise ContractError(pointer, f"exclude each other: {both}")
    elif kind == "array":
        for i, item in enumerate(value):
            if "item_type" in spec and not is_kind(item, spec["item_type"]):
                raise ContractError(below(pointer, i), f"expected {spec['item_type']}")
            if "item_schema" in spec:
                validate(item, spec["item_schema"], below(pointer, i))
    if "enum" in spec and not any(type(value) is type(e) and value == e for e in spec["enum"]):
        raise ContractError(pointer, "not in the enumeration")
    if "min" in spec and not spec["min"] <= value or "max" in spec and not value <= spec["max"]:
        raise ContractError(pointer, "out of range")  # also for NaN, which no comparison holds for
    if "min_len" in spec and len(value) < spec["min_len"] or "max_len" in spec and len(value) > spec["max_len"]:
        raise ContractError(pointer, "length out of range")
    if spec.get("validator"):
        try:
            spec["validator"](value)
        except ContractError:
            raise
        except Exception as e:
            raise ContractError(pointer, f"refused: {e}") from e
