import random

import pytest

from loomwork.functions.types import TypeTokenError, nested, Field, parse_type

GOOD = {
    "str": "string", "list[int]": "array<bigint>", "dict[str, list[float]]": "map<string,array<double>>", "tuple[str, int]": "struct<_0:string,_1:bigint>",
    "str | None": "string", "Literal['a', \"b\"]": "string", "Literal[1, 2]": "bigint", "Literal[True]": "boolean", "list[str | None]": "array<string>",
}


@pytest.mark.parametrize("text", GOOD)
def test_round_trip_and_spark_type(text):
    t = parse_type(text)
    assert parse_type(t.text()) == t and t.to_spark().simpleString() == GOOD[text]


@pytest.mark.parametrize("text", ["", "string", "list", "list[]", "dict[int, str]", "str |", "str | int", "str | None | None", "tuple[]", "Literal[]", "Literal[1, 1]", "Literal[1.5]", "list[int", "int]", "a-b"])
def test_no_types(text):
    with pytest.raises(TypeTokenError):
        parse_type(text)


def test_member_order_is_no_part_of_equality():
    a, b = (nested({k: Field(parse_type("str")) for k in x}) for x in ("pq", "qp"))
    assert a.text() == b.text()


def test_any_text_gives_a_type_or_the_one_error():
    rng = random.Random(5)
    parts = ["str", "int", "list", "dict", "tuple", "Literal", "[", "]", ",", "|", "None", "'a'", "3", " ", "x", "..."]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        try:
            parse_type(text)
        except TypeTokenError:
            continue
