"""Python values against declared fields: strict, closed, one finding a place."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

from loomwork.functions.rules import SHOWN, judged
from loomwork.functions.types import Field, Type


@dataclass(frozen=True)
class Misfit:
    """One place of a value that its declaration doesn't admit."""

    path: str
    rule: str  # required, keys_subset_of, enum, nullable, type, or the name of a rule
    expected: str
    value: Any
    said: str

    def entry(self) -> tuple:
        """As a row of ``rules.FAILURE``."""
        text = None if self.value is None else self.value if isinstance(self.value, str) else repr(self.value)
        text = text if text is None or len(text) <= SHOWN else f"{text[:SHOWN]}…(+{len(text) - SHOWN} chars)"
        return (self.path, self.rule, None, self.expected, text, False)


def misfits(value: Any, f: Field, path: str = "") -> Iterator[str]:
    """What is wrong with a value: nothing for one that the field admits."""
    return (x.said for x in found_misfits(value, f, path))


def found_misfits(value: Any, f: Field, path: str = "") -> Iterator[Misfit]:
    yield from shape_misfits(value, f.type, path)
    if value is None:
        return
    for keyword, parameter in f.rules:
        if not judged(value, keyword, parameter)[0]:
            yield Misfit(path, keyword, f.type.text(), value, f"{path or 'value'} fails {keyword}")
            return


_EXACT = {"str": str, "int": int, "bool": bool, "bytes": bytes, "secret_ref": str}


def shape_misfits(value: Any, t: Type, path: str, deep_rules: bool = True) -> Iterator[Misfit]:
    """What is wrong with a value's form; with deep_rules, the rules of nested members too."""

    def wrong(said: str, rule: str = "type", at: str = path, shown: Any = value, expected: str = t.text()) -> Misfit:
        return Misfit(at, rule, expected, shown, f"{at or 'value'} {said}")

    if value is None:
        if t.kind != "optional":
            yield wrong("is null", "nullable")
        return
    t = t.bare
    if t.kind in _EXACT:
        if type(value) is not _EXACT[t.kind]:
            yield wrong(f"is no {t.kind}")
        elif t.kind == "int" and not -(2**63) <= value < 2**63:
            yield wrong("is outside 64 bits")
    elif t.kind == "float":
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            yield wrong("is no float")
    elif t.kind == "literal":
        if not any(type(v) is type(value) and v == value for v in t.values):
            yield wrong(f"is no member of {t.text()}", "enum")
    elif t.kind == "list":
        if not isinstance(value, list):
            yield wrong("is no list")
        else:
            for i, v in enumerate(value):
                yield from shape_misfits(v, t.parts[0], f"{path}[{i}]", deep_rules)
    elif t.kind == "tuple":
        if not isinstance(value, tuple) or len(value) != len(t.parts):
            yield wrong(f"is no tuple of {len(t.parts)}")
        else:
            for i, (v, p) in enumerate(zip(value, t.parts, strict=True)):
                yield from shape_misfits(v, p, f"{path}[{i}]", deep_rules)
    elif t.kind in ("dict", "table"):
        if not isinstance(value, Mapping) or not all(isinstance(k, str) for k in value):
            yield wrong("is no table with text keys")
        elif t.kind == "dict":
            for k, v in value.items():
                yield from shape_misfits(v, t.parts[0], f"{path}.{k}".lstrip("."), deep_rules)
    else:
        if not isinstance(value, Mapping):
            yield wrong("is no object")
            return
        known = dict(t.fields)
        for k in value:
            if k not in known:
                yield wrong("is not declared", "keys_subset_of", f"{path}.{k}".lstrip("."), value[k], "(undeclared)")
        for k, f in known.items():
            at = f"{path}.{k}".lstrip(".")
            if k not in value:
                yield wrong("is missing", "required", at, None, f.type.text())
            elif deep_rules:
                yield from found_misfits(value[k], f, at)
            else:
                yield from shape_misfits(value[k], f.type, at, False)


def to_arrow(value: Any, t: Type) -> Any:
    """A Python value that fits its type, as Arrow takes it: tuples as structs, integers as floats where declared."""
    if value is None:
        return None
    t = t.bare
    match t.kind:
        case "float":
            return float(value)
        case "list":
            return [to_arrow(v, t.parts[0]) for v in value]
        case "dict":
            return [(k, to_arrow(v, t.parts[0])) for k, v in value.items()]
        case "tuple":
            return {f"_{i}": to_arrow(v, p) for i, (v, p) in enumerate(zip(value, t.parts, strict=True))}
        case "nested":
            return {k: to_arrow(value[k], f.type) for k, f in t.fields}
    return value


def from_arrow(value: Any, t: Type) -> Any:
    """What a body gets for a column's value: lists, dicts, tuples and plain scalars."""
    if value is None:
        return None
    t = t.bare
    match t.kind:
        case "list":
            return [from_arrow(v, t.parts[0]) for v in value]
        case "dict":
            return {k: from_arrow(v, t.parts[0]) for k, v in (value.items() if isinstance(value, Mapping) else value)}
        case "tuple":
            return tuple(from_arrow(value[f"_{i}"], p) for i, p in enumerate(t.parts))
        case "nested":
            return {k: from_arrow(value[k], f.type) for k, f in t.fields}
    return value


def from_json(value: Any, t: Type) -> Any:
    """JSON data with lists as tuples where the type has tuples, as JSON has none."""
    t = t.bare
    if t.kind == "tuple" and isinstance(value, list) and len(value) == len(t.parts):
        return tuple(from_json(v, p) for v, p in zip(value, t.parts, strict=True))
    if t.kind == "list" and isinstance(value, list):
        return [from_json(v, t.parts[0]) for v in value]
    if t.kind == "dict" and isinstance(value, dict):
        return {k: from_json(v, t.parts[0]) for k, v in value.items()}
    if t.kind == "nested" and isinstance(value, dict):
        known = dict(t.fields)
        return {k: from_json(v, known[k].type) if k in known else v for k, v in value.items()}
    return value


def takes(call: Callable, name: str) -> bool:
    """Whether a callable declares the keyword, by name."""
    try:
        return name in inspect.signature(call).parameters
    except (TypeError, ValueError):
        return False


def signature_misfit(call: Callable, given: list[str]) -> str | None:
    """Why a body can't be called with these names; None if it can."""
    try:
        parameters = inspect.signature(call).parameters.values()
    except (TypeError, ValueError):
        return None
    if any(p.kind is p.VAR_KEYWORD for p in parameters):
        names = {p.name for p in parameters}
        lacking = [p.name for p in parameters if p.default is p.empty and p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY) and p.name not in given]
        return f"needs {', '.join(lacking)}" if lacking and names else None
    names = {p.name for p in parameters if p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY)}
    extra = [n for n in given if n not in names]
    lacking = [p.name for p in parameters if p.default is p.empty and p.name not in given]
    if extra:
        return f"takes no {', '.join(extra)}"
    return f"needs {', '.join(lacking)}" if lacking else None
