"""Properties of the text form, hostile inputs, declarations."""

import random
import time

import pytest

from leafwork.functions import decoding, encoding, wire
from leafwork.functions.declarations import declaration_text, from_json_schema, from_tool, parse_declaration, spark_type
from leafwork.streaming.finalize import StreamingDecoder

STRINGS = ["", "a", " x ", "\t", "1", "-0", "1e5", "true", "null", "[]", "{}", "{a=1}", "{a=1,a=2}", "{a={b=1}}", "a,b", "<<<", ">>>", "<<<x>>>", "x>>>", "=[", "k=<<<", "k=<<<ff", "<", "<<", "[", "]", "a\nb", ">>>\n", "\n>>>", "l\r", "l\r\nm", "\x85", " ", "é", "😀", "a=b", "a:b", "::", "{", "}", "a}b", "{a=1e999}", "01", "1.", wire.FRAME_CLOSE, "```"]
KEYS = ["a", "b", "a.b", "x[0]", "", " k", "k ", "a=b", "a:b", "a,b", "{", "}", "{a}", "é", "😀", "__proto__", "0", "[", "]", "<<", ">>"]


def value(rng, depth):
    k = rng.random()
    if depth and k < 0.2:
        return {rng.choice(KEYS): value(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    if depth and k < 0.4:
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    if depth and k < 0.5:
        names = rng.sample(KEYS, 2)
        return [{n: rng.choice(STRINGS) for n in names} for _ in range(rng.randint(2, 4))]
    if k < 0.8:
        return rng.choice(STRINGS)
    return rng.choice([None, True, False, 0.0, -1.5, 1e21, 1e-7, 12345678901234567890.0, 3.0])


@pytest.mark.parametrize("seed", range(300))
def test_identity(seed):
    rng = random.Random(seed)
    v = {rng.choice(KEYS): value(rng, 3) for _ in range(rng.randint(0, 5))}
    text = encoding.encode_value(v)
    found = decoding.decode_text(text)
    assert (found.error, found.value, found.repairs) == (None, v, [])
    assert found.canonical == text and decoding.validate_text(text) == []
    lenient = decoding.decode_lenient_text(text)
    assert (lenient.value, lenient.errors) == (v, [])
    for markers in (False, True):
        again = decoding.decode_text(encoding.encode_value(v, "generation", markers))
        assert again.error is None and again.value == v
    cut = decoding.decode_lenient_text(text[: rng.randint(0, len(text))])
    assert isinstance(cut.value, dict)
    stream = StreamingDecoder()
    for at in range(0, len(text), 3):
        stream.push(text[at : at + 3])
    assert stream.finalize().value == v


@pytest.mark.parametrize("x, text", [(0.1, "0.1"), (-0.0, "0"), (100, "100"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"), (1e-6, "0.000001"), (2e23, "2e+23"), (5e-324, "5e-324"), (123456.789, "123456.789"), (2**53 + 1, "9007199254740992")])
def test_numbers(x, text):
    assert wire.number_text(x) == text


def test_refusals():
    for bad in ({"a<<<": 1}, {"a": float("nan")}, {"a": float("inf")}, {"a\nb": 1}, [1], "x", None, {1: 2}, {"a": object()}):
        with pytest.raises(wire.Unreadable):
            encoding.encode_value(bad)
    for text in ("a[01]=1", "a[1=1", "a..b=1", "a.=1", "a[0]b=1", "<<<a=1", "=1", "a=1\na[0]=2", "x::a\nx[0]=1,2", "n:n=x", "b:b=1"):
        assert decoding.decode_text(text).error is not None, text


def test_hostile_texts_take_no_quadratic_time():
    began = time.time()
    assert decoding.decode_text("a[999999999]=1").error
    assert decoding.decode_lenient_text("a[999999999]=1\nb=2").value == {"b": 2.0}
    decoding.decode_lenient_text("\n".join(f"k{i}=<<<{i:x}" for i in range(20_000)) + "\n>>>zz\n>>>0g")
    decoding.decode_lenient_text("\n".join(["a={"] * 20_000))
    decoding.decode_lenient_text("x=" + "{a=" * 400)
    decoding.decode_lenient_text("a" * 1_000_000)
    decoding.decode_lenient_text("\n".join(f"k{i}=<" for i in range(20_000)))
    assert time.time() - began < 20


def test_declarations_read_back():
    text = "cc[]:s?\nrows[].id:n\nto:s\nuser:o?\nuser.id:n\n<<<a.b>>>:b"
    place = parse_declaration(f"<schema>\n{text}\n</schema>")
    assert parse_declaration(declaration_text(place)) == place
    assert place.fields["a.b"].code == "b" and place.fields["cc"].optional and place.fields["cc"].element.code == "s"
    assert spark_type(parse_declaration("id:n\ntags[]:s\no.b:b")).simpleString() == "struct<id:double,tags:array<string>,o:struct<b:boolean>>"
    for bad in ("x", "x:q", ":s", "a..b:s", "a.:s", "<<<a:s", "a[:s", "a]b[x]:s"):
        with pytest.raises(wire.Unreadable):
            parse_declaration(bad)


def test_json_schemas():
    ref = {"$defs": {"p": {"type": "object", "properties": {"q": {"$ref": "#/$defs/p"}, "n": {"type": "number"}}, "required": ["n"]}}, "properties": {"p": {"$ref": "#/$defs/p"}}, "required": ["p"]}
    assert from_json_schema(ref) == ("p.n:n", ["p.q"])
    union = {"properties": {"u": {"anyOf": [{"type": "integer"}, {"type": "number"}]}, "w": {"oneOf": [{"type": "string"}, {"type": "null"}]}, "e": {"enum": ["a", "b"]}, "m": {"enum": ["a", 1]}}}
    assert from_json_schema(union) == ("u:n?\ne:s?", ["w", "m"])
    assert from_tool({"function": {"parameters": {"properties": {"a.b": {"type": "boolean"}}, "required": ["a.b"]}}}, quote=True) == ("<<<a.b>>>:b", [])
    assert from_tool({}) == ("", [])
