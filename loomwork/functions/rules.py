"""Value rules as column predicates.

Fourteen keywords (fixed values of the declaration format).  All pass on null.  A NaN passes the
four bounds, as every comparison with it fails.  Patterns are searched for, unanchored, and mean
what Python's ``re`` means: a portable pattern runs in the JVM under flags that make classes
Unicode and ``$`` look at line feeds only; any other runs in a pandas UDF.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.types import Type
from loomwork.operators.folds import comparable, has_map

#: keyword -> its parameter's name
PARAMETERS = {
    "minimum": "limit", "maximum": "limit", "exclusiveMinimum": "limit", "exclusiveMaximum": "limit", "multipleOf": "multiple",
    "minLength": "limit", "maxLength": "limit", "pattern": "pattern", "minItems": "limit", "maxItems": "limit",
    "uniqueItems": "unique", "minProperties": "limit", "maxProperties": "limit", "enum": "values",
}
_NUMBER, _TEXT, _LIST, _DICT = ("int", "float"), ("str",), ("list",), ("dict",)
#: keyword -> the kinds of types it applies to; enum applies to all
APPLIES = {
    **dict.fromkeys(("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"), _NUMBER),
    **dict.fromkeys(("minLength", "maxLength", "pattern"), _TEXT),
    **dict.fromkeys(("minItems", "maxItems"), _LIST),
    "uniqueItems": ("list", "tuple"),
    **dict.fromkeys(("minProperties", "maxProperties"), _DICT),
}

#: Custom rules by name: a Python function of a value and parameters that gives None or a message.
CUSTOM: dict[str, Callable[..., str | None]] = {}


class RuleError(ValueError):
    """A rule that can't apply: unknown, of another type's family, or with a wrong parameter."""


def custom_rule(name: str) -> Callable:
    """Registers a function ``(value, **parameters) -> None | str`` as a rule."""

    def keep(f: Callable) -> Callable:
        CUSTOM[name] = f
        return f

    return keep


def base_kind(t: Type) -> str:
    """The kind that rules look at: of a literal its members', of an optional its inner type's."""
    t = t.bare
    if t.kind == "literal":
        names = {type(v).__name__ for v in t.values}
        return names.pop() if len(names) == 1 else "literal"
    return t.kind


def check_rule(keyword: str, parameter: Any, t: Type) -> None:
    """Raises RuleError unless the rule can apply to the type."""
    if keyword in CUSTOM:
        return
    if keyword not in PARAMETERS:
        raise RuleError(f"unknown rule {keyword!r}")
    kind = base_kind(t)
    if keyword != "enum" and kind not in APPLIES[keyword]:
        raise RuleError(f"{keyword} doesn't apply to {t.text()}")
    number = isinstance(parameter, (int, float)) and not isinstance(parameter, bool)
    if keyword in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"):
        if not number or not math.isfinite(parameter) or (keyword == "multipleOf" and parameter <= 0):
            raise RuleError(f"{keyword} takes a finite number" + ", over zero" * (keyword == "multipleOf"))
    elif keyword in ("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties"):
        if not isinstance(parameter, int) or isinstance(parameter, bool) or parameter < 0:
            raise RuleError(f"{keyword} takes a count")
    elif keyword == "pattern":
        try:
            re.compile(parameter)
        except (re.error, TypeError) as e:
            raise RuleError(f"pattern doesn't compile: {e}") from e
    elif keyword == "uniqueItems":
        if not isinstance(parameter, bool):
            raise RuleError("uniqueItems takes a boolean")
    elif not isinstance(parameter, (list, tuple)) or not parameter:
        raise RuleError("enum takes a list of one or more values")


def check_together(rules: Sequence[tuple[str, Any]], t: Type) -> None:
    """Raises RuleError for an enum with members that the type or the other rules never let pass."""
    bounds = dict(rules)
    for value in bounds.get("enum", ()):
        if t.bare.kind == "literal" and not any(same(value, m) for m in t.bare.values):
            raise RuleError(f"enum member {value!r} is no member of {t.text()}")
        kind = base_kind(t)
        fits = {"str": str, "int": (int, float), "float": (int, float), "bool": bool, "list": (list, tuple), "tuple": (list, tuple), "dict": dict}.get(kind)
        if fits and (not isinstance(value, fits) or (kind in _NUMBER and isinstance(value, bool))):
            raise RuleError(f"enum member {value!r} is no {kind}")
        if kind == "str" and not bounds.get("minLength", 0) <= len(value) <= bounds.get("maxLength", len(value)):
            raise RuleError(f"enum member {value!r} is outside the length bounds")


def same(a: Any, b: Any) -> bool:
    """JSON equality: 1 equals 1.0, true equals neither."""
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    return a == b


def _key(v: Any) -> Any:
    """A key that two values share if they are ``same``; one of its own for each NaN."""
    if isinstance(v, bool):
        return bool, v
    if isinstance(v, (list, tuple)):
        return list, tuple(map(_key, v))
    if isinstance(v, dict):
        return dict, frozenset((k, _key(x)) for k, x in v.items())
    return (object(),) if v != v else (None, v)


_NOT_PORTABLE = re.compile(r"\(\?(?:P[<=>]|[aLu]|\(|#)|\\[ZNbBgAG]|\\[1-9]|\(\?<[=!]|&&|\[\^?\]|\[[^\]]*\[|\\x(?![0-9a-fA-F]{2})|\\u|\\U|[*+?}]\+|\\p|\\h|\\R|\\X|\\Q|\\E|\(\?>")


def portable(pattern: str) -> bool:
    """Whether Java and Python read the pattern alike; in doubt, no."""
    return not _NOT_PORTABLE.search(pattern)


def searched(value: Column, pattern: str) -> Column:
    """Whether the pattern occurs in the value."""
    if portable(pattern):
        return value.rlike("(?Ud)" + pattern)
    compiled = re.compile(pattern)

    @F.pandas_udf("boolean")
    def search(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else compiled.search(t) is not None)

    return search(value)


def _double(c: Column) -> Column:
    return c.cast("double")


def _bounded(value: Column, kind: T.DataType, ok: Column) -> Column:
    return F.isnan(value) | ok if isinstance(kind, (T.DoubleType, T.FloatType)) else ok


def literal(value: Any, kind: T.DataType) -> Column | None:
    """The Python value as a column of the type; None if no value of the type equals it."""
    if isinstance(kind, T.BooleanType):
        return F.lit(value) if isinstance(value, bool) else None
    if isinstance(kind, (T.LongType, T.IntegerType, T.DoubleType, T.FloatType)):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return None
        if isinstance(kind, (T.LongType, T.IntegerType)) and (value != int(value) or not -(2**63) <= value < 2**63):
            return None
        return F.lit(int(value) if isinstance(kind, (T.LongType, T.IntegerType)) else float(value)).cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit(value) if isinstance(value, str) else None
    if isinstance(kind, T.ArrayType) and isinstance(value, (list, tuple)):
        items = [literal(v, kind.elementType) for v in value]
        return None if None in [x if x is None else 0 for x in items] else F.array(*items).cast(kind)
    if isinstance(kind, T.MapType) and isinstance(value, dict):
        items = {k: literal(v, kind.valueType) for k, v in value.items()}
        if any(x is None for x in items.values()):
            return None
        return F.create_map(*(c for k, x in items.items() for c in (F.lit(k), x))).cast(kind)
    if isinstance(kind, T.StructType):
        names = kind.fieldNames()
        found = value if isinstance(value, dict) else dict(zip(names, value, strict=False)) if isinstance(value, (list, tuple)) and len(value) == len(names) else {}
        if set(found) != set(names):
            return None
        items = [literal(found[f.name], f.dataType) for f in kind.fields]
        return None if any(x is None for x in items) else F.struct(*(x.alias(n) for n, x in zip(names, items, strict=True)))
    return None


def unique(value: Column, kind: T.DataType) -> Column:
    """Whether no two items are equal; NaN equals nothing, and the zeros equal each other."""
    if isinstance(kind, T.StructType):
        pairs = [(a, b) for i, a in enumerate(kind.fields) for b in kind.fields[i + 1 :]]
        clash = F.lit(False)
        for a, b in pairs:
            numbers = (T.LongType, T.IntegerType, T.DoubleType, T.FloatType)
            if a.dataType == b.dataType:
                equal = comparable(value[a.name], a.dataType) == comparable(value[b.name], b.dataType)
                if isinstance(a.dataType, (T.DoubleType, T.FloatType)):
                    equal = equal & ~F.isnan(value[a.name])
                clash = clash | F.coalesce(equal, value[a.name].isNull() & value[b.name].isNull())
            elif isinstance(a.dataType, numbers) and isinstance(b.dataType, numbers):
                clash = clash | F.coalesce(_double(value[a.name]) == _double(value[b.name]), F.lit(False))
        return ~clash
    item = kind.elementType
    if isinstance(item, (T.DoubleType, T.FloatType)):
        real = F.filter(value, lambda x: x.isNull() | ~F.isnan(x))
        real = F.transform(real, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
        return F.size(F.array_distinct(real)) == F.size(real)
    shown = F.transform(value, lambda x: comparable(x, item)) if has_map(item) else value
    return F.size(F.array_distinct(shown)) == F.size(value)


def passes(value: Column, kind: T.DataType, keyword: str, parameter: Any) -> Column:
    """The rule's predicate: true for null values and those that pass, else false."""
    match keyword:
        case "minimum":
            ok = _bounded(value, kind, value >= F.lit(parameter))
        case "maximum":
            ok = _bounded(value, kind, value <= F.lit(parameter))
        case "exclusiveMinimum":
            ok = _bounded(value, kind, value > F.lit(parameter))
        case "exclusiveMaximum":
            ok = _bounded(value, kind, value < F.lit(parameter))
        case "multipleOf":
            q = _double(value) / F.lit(float(parameter))
            ok = F.abs(q - F.rint(q)) <= 1e-9 * F.greatest(F.abs(q), F.abs(F.rint(q)))
        case "minLength":
            ok = F.length(value) >= parameter
        case "maxLength":
            ok = F.length(value) <= parameter
        case "pattern":
            ok = searched(value, parameter)
        case "minItems":
            ok = F.size(value) >= parameter
        case "maxItems":
            ok = F.size(value) <= parameter
        case "uniqueItems":
            ok = unique(value, kind) if parameter else F.lit(True)
        case "minProperties":
            ok = F.size(F.map_keys(value)) >= parameter
        case "maxProperties":
            ok = F.size(F.map_keys(value)) <= parameter
        case "enum":
            shown, ok = comparable(value, kind), F.lit(False)
            for member in parameter:
                lit = literal(member, kind)
                if lit is not None:
                    ok = ok | (shown == comparable(lit, kind))
        case _:
            return verdict(value, keyword, parameter)["ok"]
    return value.isNull() | F.coalesce(ok, F.lit(False))


_VERDICT = pa.struct([("ok", pa.bool_()), ("message", pa.string()), ("broke", pa.bool_())])


def verdict(value: Column, name: str, parameter: Any) -> Column:
    """(ok, message, broke) of a custom rule; broke: it raised, or answered neither None nor text."""
    f = CUSTOM[name]
    given = parameter if isinstance(parameter, dict) else {}

    @F.arrow_udf("ok boolean, message string, broke boolean")
    def run(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            try:
                said = None if v is None else f(v, **given)
            except Exception as e:  # the rule's own failure is a result
                out.append({"ok": False, "message": f"{type(e).__name__}: {e}", "broke": True})
                continue
            bad = said is not None and not isinstance(said, str)
            out.append({"ok": said is None, "message": None if said is None else str(said), "broke": bad})
        return pa.array(out, _VERDICT)

    return run(value)


def breaks(value: Column, kind: T.DataType, keyword: str, parameter: Any) -> Column:
    """Whether the rule itself fails on the value, which is no verdict on it."""
    if keyword == "multipleOf" and isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(False))
    return verdict(value, keyword, parameter)["broke"] if keyword in CUSTOM else F.lit(False)


FAILURE = "struct<path:string,rule:string,parameter:string,expected:string,value:string,broke:boolean>"
_ENTRY = pa.struct([*((n, pa.string()) for n in ("path", "rule", "parameter", "expected", "value")), ("broke", pa.bool_())])
SHOWN = 256


def shown_value(value: Column, kind: T.DataType) -> Column:
    """The value as text, at most ``SHOWN`` characters and how many more there are; null for null."""
    text = F.to_json(value) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else value.cast("string")
    more = F.concat(F.substring(text, 1, SHOWN), F.lit("…(+"), (F.length(text) - SHOWN).cast("string"), F.lit(" chars)"))
    return F.when(F.length(text) > SHOWN, more).otherwise(text)


def first_failure(path: Column, value: Column, t: Type, rules: Sequence[tuple[str, Any]]) -> Column:
    """The first rule in order that the value fails, as ``FAILURE``, or null.

    broke: the rule itself failed on the value, which is no verdict on it.
    """
    kind = t.bare.to_spark()
    expected, shown = F.lit(t.text()).alias("expected"), shown_value(value, kind).alias("value")

    def entry(keyword: str, parameter: Any, broke: Column) -> Column:
        said = json.dumps(parameter, sort_keys=True, ensure_ascii=False)
        return F.struct(path.alias("path"), F.lit(keyword).alias("rule"), F.lit(said).alias("parameter"), expected, shown, broke.alias("broke"))

    found = F.lit(None).cast(FAILURE)
    for keyword, parameter in reversed(list(rules)):
        if keyword in CUSTOM:  # called once a value: its verdict says both
            said = verdict(value, keyword, parameter)
            bad, broke = ~F.coalesce(said["ok"], F.lit(False)), F.coalesce(said["broke"], F.lit(False))
        else:
            broke = breaks(value, kind, keyword, parameter)
            bad = ~passes(value, kind, keyword, parameter) | broke
        found = F.when(bad, entry(keyword, parameter, broke)).otherwise(found)
    if t.kind != "optional":
        found = F.when(value.isNull(), entry("nullable", False, F.lit(False))).otherwise(found)
    return found


def _in_python(t: Type, rules: Sequence[tuple[str, Any]]) -> bool:
    """Whether a rule of the type or of anything in it needs Python, which can't run inside a lambda."""
    own = any(k in CUSTOM or (k == "pattern" and not portable(v)) for k, v in rules)
    return own or any(_in_python(p, ()) for p in t.parts) or any(_in_python(f.type, f.rules) for _, f in t.fields)


def _own_rules(t: Type, rules: Sequence[tuple[str, Any]]) -> list[tuple[str, Any]]:
    return [("enum", list(t.bare.values)), *rules] if t.bare.kind == "literal" else list(rules)


def _deep(path: Column, value: Column, t: Type, rules: Sequence[tuple[str, Any]]) -> list[Column]:
    """Arrays of failures: of a value, then of what it holds, in declaration and item order."""
    bare = t.bare
    out = [F.array(first_failure(path, value, t, _own_rules(t, rules)))]
    if bare.kind in ("list", "dict") and _in_python(bare.parts[0], ()):
        return [*out, _items_in_python(path, value, bare)]

    def inside(at: Column, x: Column, part: Type) -> Column:
        return F.filter(F.concat(*_deep(at, x, part, ())), lambda f: f.isNotNull())

    none = F.array().cast(f"array<{FAILURE}>")
    if bare.kind == "list":
        each = F.transform(value, lambda x, i: inside(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), x, bare.parts[0]))
        out.append(F.coalesce(F.flatten(each), none))
    elif bare.kind == "dict":
        entries = F.array_sort(F.map_keys(value))
        each = F.transform(entries, lambda k: inside(F.concat(path, F.lit("."), k), F.element_at(value, k), bare.parts[0]))
        out.append(F.coalesce(F.flatten(each), none))
    elif bare.kind == "tuple":
        parts = [x for i, p in enumerate(bare.parts) for x in _deep(F.concat(path, F.lit(f"[{i}]")), value[f"_{i}"], p, ())]
        out.append(F.when(value.isNotNull(), F.concat(*parts)).otherwise(none))
    elif bare.kind == "nested":
        parts = [x for name, f in bare.fields for x in _deep(F.concat(path, F.lit(f".{name}")), value[name], f.type, f.rules)]
        out.append(F.when(value.isNotNull(), F.concat(*parts)).otherwise(none))
    return out


def _items_in_python(path: Column, value: Column, t: Type) -> Column:
    """The failures of a list's or dict's items by Arrow batches, for rules that need Python."""
    custom = dict(CUSTOM)  # goes along: a worker has imported no more than this module

    # Arrow's own values keep integers beside nulls, which pandas would turn into floats
    @F.arrow_udf(f"array<{FAILURE}>")
    def run(paths: pa.Array, values: pa.Array) -> pa.Array:
        rows = zip(paths.to_pylist(), values.to_pylist(), strict=True)
        names = [f.name for f in _ENTRY]
        found = [[] if v is None else [dict(zip(names, x, strict=True)) for x in _walk(p, plain(v, t), t, custom)] for p, v in rows]
        return pa.array(found, pa.list_(_ENTRY))

    return run(path, value)


def plain(v: Any, t: Type) -> Any:
    """What Arrow gives for a value of the type, as Python lists and dicts."""
    if v is None:
        return None
    t = t.bare
    if t.kind == "list":
        return [plain(x, t.parts[0]) for x in v]
    if t.kind == "dict":
        return {k: plain(x, t.parts[0]) for k, x in (v.items() if isinstance(v, dict) else v)}
    if t.kind == "tuple":
        return {f"_{i}": plain(v[f"_{i}"], p) for i, p in enumerate(t.parts)}
    if t.kind == "nested":
        return {n: plain(v[n], f.type) for n, f in t.fields}
    return v.item() if hasattr(v, "item") else v


def _walk(path: str, v: Any, t: Type, custom: dict[str, Callable]) -> Any:
    """The failures of what a value holds, as tuples of ``FAILURE``'s fields."""
    if t.kind == "list":
        inner = [(f"{path}[{i}]", x, t.parts[0], ()) for i, x in enumerate(v)]
    elif t.kind == "dict":
        inner = [(f"{path}.{k}", v[k], t.parts[0], ()) for k in sorted(v)]
    elif t.kind == "tuple":
        inner = [(f"{path}[{i}]", v[f"_{i}"], p, ()) for i, p in enumerate(t.parts)]
    else:
        inner = [(f"{path}.{n}", v[n], f.type, f.rules) for n, f in t.fields]
    for at, x, part, rules in inner:
        if x is None:
            if part.kind != "optional":
                yield (at, "nullable", "false", part.text(), None, False)
            continue
        for keyword, parameter in _own_rules(part, rules):
            ok, broke = judged(x, keyword, parameter, custom)
            if not ok:
                text = x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, default=str)
                text = text if len(text) <= SHOWN else f"{text[:SHOWN]}…(+{len(text) - SHOWN} chars)"
                yield (at, keyword, json.dumps(parameter, sort_keys=True, ensure_ascii=False), part.text(), text, broke)
                break
        if part.bare.kind in ("list", "dict", "tuple", "nested"):
            yield from _walk(at, x, part.bare, custom)


def judged(v: Any, keyword: str, p: Any, custom: dict[str, Callable] = CUSTOM) -> tuple[bool, bool]:
    """Whether a Python value passes a rule, and whether the rule itself broke on it."""
    if v is None:
        return True, False
    if keyword in custom:
        try:
            said = custom[keyword](v, **(p if isinstance(p, dict) else {}))
        except Exception:  # the rule's own failure is a result
            return False, True
        return said is None, said is not None and not isinstance(said, str)
    match keyword:
        case "minimum":
            return not v < p, False
        case "maximum":
            return not v > p, False
        case "exclusiveMinimum":
            return not v <= p, False
        case "exclusiveMaximum":
            return not v >= p, False
        case "multipleOf":
            q = v / p
            if not math.isfinite(q):
                return False, True
            return math.isclose(q, round(q), rel_tol=1e-9, abs_tol=0), False
        case "minLength" | "minItems" | "minProperties":
            return len(v) >= p, False
        case "maxLength" | "maxItems" | "maxProperties":
            return len(v) <= p, False
        case "pattern":
            return re.search(p, v) is not None, False
        case "uniqueItems":
            return not p or len(set(map(_key, v))) == len(v), False
    return any(same(v, m) for m in p), False


Fields = dict[str, tuple[Column, Type, Sequence[tuple[str, Any]]]]


def in_python(fields: Fields) -> bool:
    """Whether a rule of the fields or of anything in them needs Python."""
    return any(_in_python(t, rules) for _, t, rules in fields.values())


def failed(fields: Fields) -> Column | None:
    """Whether ``failures`` has an entry, without making those of the fields' own values; None where none can fail."""
    found = []
    for name, (value, t, rules) in fields.items():
        kind = t.bare.to_spark()
        if t.kind != "optional":
            found.append(value.isNull())
        for keyword, parameter in _own_rules(t, rules):
            found.append(~passes(value, kind, keyword, parameter))
            if keyword == "multipleOf":
                found.append(breaks(value, kind, keyword, parameter))
        if t.bare.parts or t.bare.fields:
            found += [F.exists(x, lambda f: f.isNotNull()) for x in _deep(F.lit(name), value, t, rules)[1:]]
    return reduce(Column.__or__, found) if found else None


def failures(fields: Fields) -> Column:
    """One entry a failed field, in declaration order, items of lists and dicts included, as an array of ``FAILURE``."""
    entries = [x for name, (value, t, rules) in fields.items() for x in _deep(F.lit(name), value, t, rules)]
    if not entries:
        return F.array().cast(f"array<{FAILURE}>")
    return F.filter(F.concat(*entries), lambda x: x.isNotNull())
