"""Rules on edge values, against what Python says."""

import math
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions import rules
from loomwork.functions.types import loose, parse_type
from loomwork.plans import load

NAN, INF = float("nan"), float("inf")
PYTHON = {
    "minimum": lambda v, p: not v < p, "maximum": lambda v, p: not v > p, "exclusiveMinimum": lambda v, p: not v <= p, "exclusiveMaximum": lambda v, p: not v >= p,
    "multipleOf": lambda v, p: math.isclose(v / p, round(v / p), rel_tol=1e-9, abs_tol=0), "minLength": lambda v, p: len(v) >= p, "maxLength": lambda v, p: len(v) <= p,
    "pattern": lambda v, p: re.search(p, v) is not None, "minItems": lambda v, p: len(v) >= p, "maxItems": lambda v, p: len(v) <= p,
    "minProperties": lambda v, p: len(v) >= p, "maxProperties": lambda v, p: len(v) <= p, "enum": lambda v, p: any(rules.same(v, m) for m in p),
    "uniqueItems": lambda v, p: not p or not any(rules.same(a, b) for i, a in enumerate(v) for b in v[i + 1 :]),
}
FLOATS = [1.0, 0.0, -0.0, NAN, INF, -INF, 5.0, 5.5]
CASES = [
    *((k, "double", p, FLOATS) for k in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum") for p in (0, 5)),
    ("multipleOf", "double", 0.1, [0.3, 0.35, 0.0, 1e9]), ("multipleOf", "bigint", 3, [3, 4, 0, -9]),
    ("minLength", "string", 2, ["", "a😀", "é"]), ("maxLength", "string", 1, ["", "😀", "ab"]),
    ("pattern", "string", r"^\w+$", ["é", "a b", "a\n", "", "x\r"]), ("pattern", "string", r"\d", ["٣", "3", "x"]), ("pattern", "string", "(?P<n>a)b", ["xab", "b"]),
    ("minItems", "array<string>", 1, [[], ["a"]]), ("maxItems", "array<string>", 1, [[], ["a", "b"]]),
    ("uniqueItems", "array<double>", True, [[0.0, -0.0], [NAN, NAN], [1.0, 2.0], []]), ("uniqueItems", "array<string>", False, [["a", "a"]]),
    ("uniqueItems", "array<map<string,bigint>>", True, [[{"a": 1, "b": 2}, {"b": 2, "a": 1}], [{"a": 1}, {"a": 2}]]),
    ("minProperties", "map<string,bigint>", 1, [{}, {"a": 1}]), ("maxProperties", "map<string,bigint>", 0, [{}, {"a": 1}]),
    ("enum", "bigint", [1.0, True, "x"], [1, 0, 2]), ("enum", "boolean", [1, True], [True, False]), ("enum", "array<bigint>", [[1, 2]], [[1, 2], [2, 1]]),
    ("enum", "map<string,bigint>", [{"b": 2, "a": 1}], [{"a": 1, "b": 2}, {"a": 1}]), ("enum", "double", [1], [1.0, 1.5]),
]


@pytest.mark.parametrize("keyword,kind,parameter,values", CASES, ids=lambda x: str(x)[:30])
def test_rule_is_pythons(spark, keyword, kind, parameter, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([*values, None])], f"k int, v {kind}")
    got = {r.k: r.ok for r in df.select("k", rules.passes(F.col("v"), df.schema["v"].dataType, keyword, parameter).alias("ok")).collect()}
    assert got == {**{k: PYTHON[keyword](v, parameter) for k, v in enumerate(values)}, len(values): True}


def test_first_failing_rule_of_each_field(spark):
    df = spark.createDataFrame([(1, "ab", [1, None]), (2, "abcdef", [1]), (3, None, None)], "k int, t string, l array<long>")
    fields = {"t": (F.col("t"), parse_type("str"), [("minLength", 3), ("maxLength", 4)]), "l": (F.col("l"), parse_type("list[int] | None"), [("minItems", 1)])}
    out = {r.k: [(x.path, x.rule) for x in r.f] for r in df.select("k", rules.failures(fields).alias("f")).collect()}
    assert out == {1: [("t", "minLength"), ("l[1]", "nullable")], 2: [("t", "maxLength")], 3: [("t", "nullable")]}


def brute_failures(path, v, t, own=()):
    """Field by field and item by item, in Python."""
    if v is None:
        return [] if t.kind == "optional" else [(path, "nullable")]
    out = []
    for keyword, parameter in ([("enum", list(t.bare.values))] if t.bare.kind == "literal" else []) + list(own):
        if not (PYTHON[keyword](v, parameter) if keyword in PYTHON else rules.CUSTOM[keyword](v) is None):
            out.append((path, keyword))
            break
    t = t.bare
    if t.kind == "list":
        return out + [x for i, y in enumerate(v) for x in brute_failures(f"{path}[{i}]", y, t.parts[0])]
    if t.kind == "dict":
        return out + [x for k in sorted(v) for x in brute_failures(f"{path}.{k}", v[k], t.parts[0])]
    if t.kind == "tuple":
        return out + [x for i, p in enumerate(t.parts) for x in brute_failures(f"{path}[{i}]", v[i], p)]
    if t.kind == "nested":
        return out + [x for n, f in t.fields for x in brute_failures(f"{path}.{n}", v[n], f.type, f.rules)]
    return out


@pytest.mark.parametrize("word_rules", [{"maxLength": 2}, {"tests.short": {}}, {"pattern": r"\A\S{0,2}\Z"}, {"pattern": r"(?P<a>^\S{0,2}$)"}], ids=str)
def test_rules_inside_lists_and_dicts(spark, word_rules):
    @rules.custom_rule("tests.short")
    def short(value, **_):
        return None if len(value) < 3 else "long"

    inner = {"n": {"type": "int", "minimum": 3}, "w": {"type": "str", **word_rules}, "o": {"type": "int | None", "maximum": 5}}
    found = load.parse_fields(
        {
            "xs": {"item": {"fields": inner}, "minItems": 1}, "d": {"value": {"item": {"fields": inner}}},
            "pair": {"type": "tuple[int, list[Literal['a', 'b']]]"}, "plain": "dict[str, int]", "deep": {"fields": {"inner": {"item": {"fields": inner}}}},
        },
        "t",
    )
    good, bad, odd = {"n": 3, "w": "ab", "o": None}, {"n": 1, "w": "abcd", "o": 9}, {"n": None, "w": "abc", "o": 6}
    rows = [
        {"xs": [good], "d": {"k": [good]}, "pair": (1, ["a"]), "plain": {"a": 1}, "deep": {"inner": [good]}},
        {"xs": [good, bad, odd], "d": {"k": [], "j": [bad, good]}, "pair": (None, ["a", "c"]), "plain": {"a": None}, "deep": {"inner": [odd]}},
        {"xs": [], "d": {}, "pair": (1, []), "plain": {}, "deep": {"inner": []}},
        {"xs": [None], "d": {"k": None}, "pair": None, "plain": None, "deep": None},
    ]
    schema = T.StructType([T.StructField("k", T.IntegerType()), *(T.StructField(n, loose(f.type.to_spark())) for n, f in found.items())])
    df = spark.createDataFrame([(k, *(r[n] for n in found)) for k, r in enumerate(rows)], schema)
    got = df.select("k", rules.failures({n: (F.col(n), f.type, f.rules) for n, f in found.items()}).alias("f")).collect()
    for r in got:
        want = [x for n, f in found.items() for x in brute_failures(n, rows[r.k][n], f.type, f.rules)]
        assert [(x.path, x.rule) for x in r.f] == want
    said = {x.path: x for x in got[1].f}
    assert (said["xs[1].n"].value, said["xs[1].n"].expected, said["xs[1].n"].parameter, said["xs[1].n"].broke) == ("1", "int", "3", False)
    assert said["xs[2].n"].value is None and said["xs[1].w"].value == "abcd"


def test_long_values_are_cut_in_reports(spark):
    df = spark.createDataFrame([("x" * 300,)], "t string")
    x = df.select(rules.failures({"t": (F.col("t"), parse_type("str"), [("maxLength", 2)])}).alias("f")).first().f[0]
    assert x.value == "x" * 256 + "…(+44 chars)"


def test_a_broken_rule_is_told(spark):
    calls = spark.sparkContext.accumulator(0)

    @rules.custom_rule("tests.breaks")
    def breaks(value, **_):
        calls.add(1)
        if value == 2:
            raise KeyError("x")
        return None if value < 5 else "large"

    df = spark.createDataFrame([(1,), (2,), (7,)], "v long").coalesce(1)
    f = {"v": (F.col("v"), parse_type("int"), [("tests.breaks", {})])}
    got = [[(x.rule, x.broke) for x in r.f] for r in df.select(rules.failures(f).alias("f")).collect()]
    assert got == [[], [("tests.breaks", True)], [("tests.breaks", False)]]
    assert calls.value == 3  # once a value


def test_rules_that_cannot_apply():
    for keyword, parameter, token in [
        ("minimum", 1, "str"), ("minimum", NAN, "int"), ("multipleOf", 0, "int"), ("minLength", -1, "str"), ("pattern", "(", "str"),
        ("enum", [], "str"), ("uniqueItems", 1, "list[str]"), ("nothing", 1, "str"), ("maxItems", True, "list[int]"),
    ]:
        with pytest.raises(rules.RuleError):
            rules.check_rule(keyword, parameter, parse_type(token))
    with pytest.raises(rules.RuleError):
        rules.check_together([("enum", ["abc"]), ("maxLength", 2)], parse_type("str"))
    with pytest.raises(rules.RuleError):
        rules.check_together([("enum", ["c"])], parse_type("Literal['a', 'b']"))


def test_custom_rule(spark):
    @rules.custom_rule("tests.even")
    def even(value, **_):
        if value == 5:
            return 1
        return None if value % 2 == 0 else "odd"

    df = spark.createDataFrame(pd.DataFrame({"v": [2, 3, 5]}))
    got = [tuple(r) for r in df.select(rules.verdict(F.col("v"), "tests.even", {}).alias("x")).select("x.*").collect()]
    assert got == [(True, None, False), (False, "odd", False), (False, "1", True)]


def test_unique_items_of_long_lists_and_odd_values():
    nan = float("nan")
    odd = [(1, True, "1", [1], (1, 2), {"a": [1]}, None), (1, 1.0), ([1, 2], (1.0, 2)), ({"a": 1, "b": True}, {"b": True, "a": 1.0}), (nan, nan), ([nan], [nan]), (True, False, 0, 1.5)]
    for items in odd:
        want = not any(rules.same(a, b) for i, a in enumerate(items) for b in items[i + 1 :])
        assert rules.judged(list(items), "uniqueItems", True)[0] == want, items
    assert rules.judged(list(range(300_000)), "uniqueItems", True)[0] and not rules.judged([*range(300_000), 5.0], "uniqueItems", True)[0]
