"""Types rendered for model backends: strict JSON Schema, GBNF grammars, payload text; and compilers."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import types as T

from loomwork.functions.canonical import canonical_json, canonical_object
from loomwork.functions.types import Field, Type


class RenderError(ValueError):
    """A type or rule that a backend can't be held to."""


#: backend -> the rules that it enforces while it decodes; all others are checked afterwards
ENFORCED = {"json_schema": frozenset({"enum"}), "gbnf": frozenset({"enum", "minLength", "maxLength"})}
#: Keys of a request that the engine sets; a configuration's extras may not name them.
RESERVED = frozenset(("model", "messages", "response_format", "stream", "prompt", "grammar"))
_JSON = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}


def schema_of(t: Type, rules: tuple = (), backend: str = "json_schema") -> dict[str, Any]:
    """JSON Schema of values of the type, with the rules that the backend takes."""
    taken = {k: v for k, v in rules if k in ENFORCED[backend]}
    match t.kind:
        case "str" | "int" | "float" | "bool":
            return {"type": _JSON[t.kind]} | taken
        case "literal":
            return {"enum": list(t.values)}
        case "optional":
            return {"anyOf": [schema_of(t.parts[0], rules, backend), {"type": "null"}]}
        case "list":
            return {"type": "array", "items": schema_of(t.parts[0], (), backend)}
        case "dict":
            if backend == "json_schema":
                raise RenderError("a strict JSON schema has no open keys")
            return {"type": "object", "additionalProperties": schema_of(t.parts[0], (), backend)}
        case "nested":
            return object_schema(dict(t.fields), backend)
    raise RenderError(f"{t.text()} has no JSON form for a backend")


def object_schema(fields: Mapping[str, Field], backend: str = "json_schema") -> dict[str, Any]:
    """A closed object, members in declared order, all required."""
    members = {}
    for name, f in fields.items():
        members[name] = schema_of(f.type, f.rules, backend)
        if f.description:
            members[name] = {**members[name], "description": f.description}
    return {"type": "object", "properties": members, "required": list(fields), "additionalProperties": False}


def payload(reads: Mapping[str, tuple[Column, T.DataType]]) -> Column:
    """``payload_text`` over columns, within the JVM; a null text alone is null."""
    value, kind = next(iter(reads.values())) if len(reads) == 1 else (None, None)
    return value if isinstance(kind, T.StringType) else canonical_object(reads)


def payload_text(reads: Mapping[str, Any]) -> str:
    """A single text as it is, anything else as canonical JSON."""
    if len(reads) == 1 and isinstance(only := next(iter(reads.values())), str):
        return only
    return canonical_json(dict(reads))


_RULES = {
    "space": "[ \\t\\n]{0,20}",
    # an escaped pair of surrogates is one character
    "char": (
        '[^"\\\\\\x00-\\x1f] | "\\\\" (["\\\\/bfnrt] | "u" ([0-9a-cA-Ce-fE-F] [0-9a-fA-F]{3} | [dD] [0-7] [0-9a-fA-F]{2}'
        ' | [dD] [89abAB] [0-9a-fA-F]{2} "\\\\u" [dD] [c-fC-F] [0-9a-fA-F]{2}))'
    ),
    "string": '"\\"" char* "\\""',
    "integer": '"-"? ("0" | [1-9] [0-9]*)',
    "number": 'integer ("." [0-9]+)? ([eE] [+-]? [0-9]+)?',
    "boolean": '"true" | "false"',
    "null": '"null"',
}


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def grammar(schema: Mapping[str, Any]) -> str:
    """A GBNF grammar for the texts of values of a schema that ``object_schema`` made."""
    rules: dict[str, str] = {}

    def use(name: str) -> str:
        if name not in rules:
            rules[name] = _RULES[name]
            for other in re.findall(r"(?<![\[\\\w])(space|char|string|integer|number|boolean|null)(?!\w)", re.sub(r'"(?:[^"\\]|\\.)*"|\[(?:[^\]\\]|\\.)*\]', "", _RULES[name])):
                use(other)
        return name

    def of(node: Mapping[str, Any], name: str) -> str:
        if "enum" in node:
            body = " | ".join(_quoted(canonical_json(v)) for v in node["enum"])
        elif "anyOf" in node:
            body = " | ".join(of(x, f"{name}-{i}") for i, x in enumerate(node["anyOf"]))
        elif node["type"] == "string" and ("minLength" in node or "maxLength" in node):
            use("char")
            body = f'"\\"" char{{{node.get("minLength", 0)},{node.get("maxLength", "")}}} "\\""'
        elif node["type"] in ("string", "integer", "number", "boolean", "null"):
            return use(node["type"])
        elif node["type"] == "array":
            item, gap = of(node["items"], f"{name}-item"), use("space")
            body = f'"[" {gap} ({item} {gap} ("," {gap} {item} {gap})*)? "]"'
        elif "properties" in node:
            gap = use("space")
            members = [f"{_quoted(canonical_json(k))} {gap} \":\" {gap} {of(v, f'{name}-{i}')} {gap}" for i, (k, v) in enumerate(node["properties"].items())]
            body = '"{" ' + gap + " " + f' "," {gap} '.join(members) + ' "}"'
        else:
            value, gap, key = of(node["additionalProperties"], f"{name}-value"), use("space"), use("string")
            member = f'{key} {gap} ":" {gap} {value} {gap}'
            body = f'"{{" {gap} ({member} ("," {gap} {member})*)? "}}"'
        rules[name] = body
        return name

    top = of(schema, "root")
    if top != "root":
        rules["root"] = top
    return "\n".join(f"{k} ::= {v}" for k, v in sorted(rules.items(), key=lambda x: x[0] != "root"))


#: Compilers by name: parameters to an object that a step gets, once a plan.
COMPILERS: dict[str, Callable[..., Any]] = {}


def compiler(name: str) -> Callable:
    def keep(f: Callable) -> Callable:
        COMPILERS[name] = f
        return f

    return keep


@compiler("regex")
def compile_regex(pattern: str, flags: str = "") -> re.Pattern:
    """flags: letters of Python's inline flags."""
    return re.compile(f"(?{flags}){pattern}" if flags else pattern)


@compiler("jinja")
def compile_jinja(source: str) -> Any:
    try:
        import jinja2
    except ImportError as e:
        raise RenderError("the jinja compiler needs jinja2") from e
    return jinja2.Environment(undefined=jinja2.StrictUndefined).from_string(source)


@compiler("json_schema")
def compile_json_schema(schema: Any) -> Any:
    try:
        import jsonschema
    except ImportError as e:
        raise RenderError("the json_schema compiler needs jsonschema") from e
    kind = jsonschema.validators.validator_for(schema)
    kind.check_schema(schema)
    return kind(schema)
