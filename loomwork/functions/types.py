"""The closed set of wire types, their text form, and their Spark types.

Token grammar (fixed values of the declaration format): ``str int float bool``, ``list[T]``,
``dict[str, T]``, ``tuple[T, U, ...]``, ``T | None``, ``Literal[...]`` of strings, integers and
booleans, and for declarations only ``table`` (open JSON data) and ``secret_ref``.  Nested objects
come from field tables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T


class TypeTokenError(ValueError):
    """A type token that the grammar doesn't have."""


@dataclass(frozen=True)
class Type:
    """kind: one of the scalars, list, dict, tuple, optional, literal, nested, table, secret_ref."""

    kind: str
    parts: tuple[Type, ...] = ()
    values: tuple[Any, ...] = ()
    fields: tuple[tuple[str, Field], ...] = ()

    def text(self) -> str:
        """The canonical token; types are equal exactly if their texts are."""
        p = [x.text() for x in self.parts]
        match self.kind:
            case "list":
                return f"list[{p[0]}]"
            case "dict":
                return f"dict[str, {p[0]}]"
            case "tuple":
                return f"tuple[{', '.join(p)}]"
            case "optional":
                return f"{p[0]} | None"
            case "literal":
                return f"Literal[{', '.join(repr(v) for v in self.values)}]"
            case "nested":
                return "{" + ", ".join(f"{n}: {f.type.text()}" for n, f in sorted(self.fields)) + "}"
        return self.kind

    @property
    def bare(self) -> Type:
        """Without an outer None."""
        return self.parts[0] if self.kind == "optional" else self

    def to_spark(self) -> T.DataType:
        match self.kind:
            case "str":
                return T.StringType()
            case "int":
                return T.LongType()
            case "float":
                return T.DoubleType()
            case "bool":
                return T.BooleanType()
            case "bytes":
                return T.BinaryType()
            case "list":
                return T.ArrayType(self.parts[0].to_spark(), self.parts[0].kind == "optional")
            case "dict":
                return T.MapType(T.StringType(), self.parts[0].to_spark(), self.parts[0].kind == "optional")
            case "tuple":
                return T.StructType([T.StructField(f"_{i}", p.to_spark(), p.kind == "optional") for i, p in enumerate(self.parts)])
            case "optional":
                return self.parts[0].to_spark()
            case "literal":
                kinds = {type(v) for v in self.values}
                if len(kinds) != 1:
                    raise TypeTokenError(f"{self.text()} mixes types, for which there is no column type")
                return {str: T.StringType(), int: T.LongType(), bool: T.BooleanType()}[kinds.pop()]
            case "nested":
                return T.StructType([T.StructField(n, f.type.to_spark(), f.type.kind == "optional") for n, f in self.fields])
        raise TypeTokenError(f"{self.kind} is declaration data and never a column")


@dataclass(frozen=True)
class Field:
    """A declared field: its type, ordered (rule, parameter) pairs, and what only some places admit."""

    type: Type
    rules: tuple[tuple[str, Any], ...] = ()
    description: str | None = None
    default: Any = None
    has_default: bool = False
    extra: dict = field(default_factory=dict, compare=False, hash=False)


STR, INT, FLOAT, BOOL, BYTES = (Type(k) for k in ("str", "int", "float", "bool", "bytes"))
_SCALARS = {"str": STR, "int": INT, "float": FLOAT, "bool": BOOL}
_LEX = re.compile(r"""\s*(?:([A-Za-z_]+)|(-?\d+)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\.\.\.|[\[\],|]))""")


def list_of(t: Type) -> Type:
    return Type("list", (t,))


def dict_of(t: Type) -> Type:
    return Type("dict", (t,))


def optional(t: Type) -> Type:
    return t if t.kind == "optional" else Type("optional", (t,))


def nested(fields: dict[str, Field]) -> Type:
    if not fields:
        raise TypeTokenError("a nested object has at least one field")
    return Type("nested", fields=tuple(fields.items()))


class _Reader:
    def __init__(self, text: str):
        self.text, self.items, at = text, [], 0
        while text[at:].strip():
            m = _LEX.match(text, at)
            if not m:
                raise TypeTokenError(f"unexpected {text[at:].strip()[:10]!r} in type {text!r}")
            self.items.append((m.lastindex, m.group(m.lastindex)))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.items[self.at][1] if self.at < len(self.items) else None

    def take(self, want: str | None = None) -> tuple[int, str]:
        if self.at >= len(self.items) or (want is not None and self.items[self.at][1] != want):
            raise TypeTokenError(f"expected {want or 'a type'} in type {self.text!r}")
        self.at += 1
        return self.items[self.at - 1]

    def type(self) -> Type:
        found = self.one()
        while self.peek() == "|":
            self.take()
            if self.take()[1] != "None":
                raise TypeTokenError(f"only None can follow | in type {self.text!r}")
            if found.kind == "optional":
                raise TypeTokenError(f"repeated None in type {self.text!r}")
            found = optional(found)
        return found

    def one(self) -> Type:
        kind, word = self.take()
        if kind != 1:
            raise TypeTokenError(f"{word!r} is no type, in {self.text!r}")
        if word in _SCALARS:
            return _SCALARS[word]
        if word in ("table", "secret_ref"):
            return Type(word)
        if word not in ("list", "dict", "tuple", "Literal"):
            raise TypeTokenError(f"unknown type {word!r} in {self.text!r}")
        self.take("[")
        if word == "list":
            found = list_of(self.type())
        elif word == "dict":
            if self.take()[1] != "str":
                raise TypeTokenError(f"keys are str, in {self.text!r}")
            self.take(",")
            found = dict_of(self.type())
        elif word == "tuple":
            parts = [self.type()]
            while self.peek() == ",":
                self.take()
                parts.append(self.type())
            found = Type("tuple", tuple(parts))
        else:
            values = [self.member()]
            while self.peek() == ",":
                self.take()
                values.append(self.member())
            if len({(type(v), v) for v in values}) < len(values):
                raise TypeTokenError(f"repeated member in {self.text!r}")
            found = Type("literal", values=tuple(values))
        self.take("]")
        return found

    def member(self) -> Any:
        kind, word = self.take()
        if kind == 2:
            return int(word)
        if kind == 3:
            return re.sub(r"\\(.)", r"\1", word[1:-1])
        if word in ("True", "False"):
            return word == "True"
        raise TypeTokenError(f"a Literal holds strings, integers and booleans, not {word!r}")


def parse_type(text: str) -> Type:
    """The type that a token names."""
    if not isinstance(text, str):
        raise TypeTokenError(f"a type is text, not {text!r}")
    reader = _Reader(text)
    found = reader.type()
    if reader.peek() is not None:
        raise TypeTokenError(f"unexpected {reader.peek()!r} in type {text!r}")
    return found


def loose(kind: T.DataType) -> T.DataType:
    """The Spark type with nulls admitted everywhere, to which values of any origin can be cast."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(loose(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, loose(kind.valueType), True)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, loose(f.dataType), True) for f in kind.fields])
    return kind


def column_safe(t: Type) -> bool:
    """Whether the type may be a wire's: no declaration-only type at any depth."""
    return t.kind not in ("table", "secret_ref") and all(map(column_safe, t.parts)) and all(column_safe(f.type) for _, f in t.fields)
