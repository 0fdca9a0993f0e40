"""The text form as Column functions: one Arrow-batched pass a document, and their SQL names."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.functions import decoding, encoding, native_decode
from leafwork.functions.declarations import as_declared, parse_declaration, spark_type
from leafwork.functions.inference import Declared, looks_like_inline_object
from leafwork.functions.wire import Unreadable, number_text

REPAIRS = "array<struct<kind:string,detail:string>>"
ERRORS = "array<struct<line:int,key:string,error:string>>"
ENCODED = "text string, error string"
DECODED = f"ok boolean, value string, canonical string, error string, repairs {REPAIRS}"
LENIENT = f"value string, errors {ERRORS}, repairs {REPAIRS}, truncated boolean"
CHECKED = "ok boolean, errors array<string>"

_repairs = pa.list_(pa.struct([("kind", pa.string()), ("detail", pa.string())]))
_errors = pa.list_(pa.struct([("line", pa.int32()), ("key", pa.string()), ("error", pa.string())]))
_encoded = pa.struct([("text", pa.string()), ("error", pa.string())])
_decoded = pa.struct([("ok", pa.bool_()), ("value", pa.string()), ("canonical", pa.string()), ("error", pa.string()), ("repairs", _repairs)])
_lenient = pa.struct([("value", pa.string()), ("errors", _errors), ("repairs", _repairs), ("truncated", pa.bool_())])
_checked = pa.struct([("ok", pa.bool_()), ("errors", pa.list_(pa.string()))])


def loads(text: str):
    """A JSON value whose numbers are all doubles; a repeated name keeps its last value."""

    def refuse(name: str):
        raise Unreadable(f"non-finite number: {name}")

    return json.loads(text, parse_int=float, parse_constant=refuse)


def dumps(value: object) -> str:
    """Minified JSON with doubles in shortest form and names in code point order."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dumps(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dumps, value)) + "]"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    return encoding.scalar_text(value)


def _notes(repairs: list[tuple[str, str | None]]) -> list[dict]:
    return [{"kind": k, "detail": d} for k, d in repairs]


def _over(one: Callable[[str], dict], kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else one(x) for x in texts.to_pylist()], kind)

    return run


def _udf(run: Callable[[pa.Array], pa.Array], returns: str) -> Callable[[Column], Column]:
    # annotations tell the kind of function to arrow_udf; deterministic, so equal calls are evaluated once
    def kernel(texts: pa.Array) -> pa.Array:
        return run(texts)

    kernel.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(kernel, returnType=returns)


def _key(schema: str | Declared | None) -> str | None:
    if schema is not None and not isinstance(schema, str):
        raise TypeError("a declaration is given as text")
    as_declared(schema)  # a bad declaration fails where it is written, not in a task
    return schema


@lru_cache(64)
def _encode(profile: str, markers: bool):
    def one(text: str) -> dict:
        try:
            return {"text": encoding.encode_value(loads(text), profile, markers)}
        except (Unreadable, ValueError, RecursionError) as e:
            return {"error": str(e) or "nested too deeply"}

    return _udf(_over(one, _encoded), ENCODED)


@lru_cache(64)
def _decode(schema: str | None):
    declared = as_declared(schema)

    def one(text: str) -> dict:
        found = decoding.read_strictly(text, declared)
        out = {"ok": found.error is None, "error": found.error, "canonical": found.canonical, "repairs": _notes(found.repairs)}
        return out | ({"value": dumps(found.value)} if found.error is None else {})

    return _udf(_over(one, _decoded), DECODED)


@lru_cache(64)
def _values(schema: str | None):
    declared = as_declared(schema)

    def run(texts: pa.Array) -> pa.Array:
        found = [None if x is None else decoding.read_strictly(x, declared, canonical=False) for x in texts.to_pylist()]
        return pa.array([None if f is None or f.error is not None else dumps(f.value) for f in found], pa.string())

    return _udf(run, "string")


@lru_cache(1024)
def _declared_once(schema: str | None) -> Declared | None:
    return as_declared(schema)


def _udf_by_row(one: Callable[[str, Declared], dict], kind: pa.DataType, returns: str):
    """A function of (text, declaration), both columns; declarations that repeat are read once a process."""

    def kernel(texts: pa.Array, schemas: pa.Array) -> pa.Array:
        return pa.array([None if x is None else one(x, _declared_once(d)) for x, d in zip(texts.to_pylist(), schemas.to_pylist(), strict=True)], kind)

    kernel.__annotations__ = {"texts": pa.Array, "schemas": pa.Array, "return": pa.Array}
    return F.arrow_udf(kernel, returnType=returns)


def _read_by(text: str, declared: Declared | None) -> dict:
    found = decoding.read_strictly(text, declared)
    out = {"ok": found.error is None, "error": found.error, "canonical": found.canonical, "repairs": _notes(found.repairs)}
    return out | ({"value": dumps(found.value)} if found.error is None else {})


def _check_by(text: str, declared: Declared | None) -> dict:
    errors = decoding.validate_text(text, declared)
    return {"ok": not errors, "errors": errors}


def _lenient_by(text: str, declared: Declared | None) -> dict:
    found = decoding.decode_lenient_text(text, declared)
    return {"value": dumps(found.value), "errors": found.errors, "repairs": _notes(found.repairs), "truncated": found.truncated}


def decode_by(text: Column | str, schema: Column | str) -> Column:
    """decode, each row by the declaration in a column of its own (null: none)."""
    return _udf_by_row(_read_by, _decoded, DECODED)(text, schema)


@lru_cache(1)
def _round_trip():
    def one(text: str) -> dict:
        try:
            made = encoding.encode_value(loads(text))
        except (Unreadable, ValueError, RecursionError):
            return {"same": False, "ok": False, "fixed": False}
        found = decoding.read_strictly(made, None)
        fixed = found.error is None and decoding.read_strictly(found.canonical, None).canonical == found.canonical
        return {"text": made, "ok": found.error is None, "same": found.canonical == made and not found.repairs, "fixed": fixed}

    return _udf(_over(one, pa.struct([("text", pa.string()), ("ok", pa.bool_()), ("same", pa.bool_()), ("fixed", pa.bool_())])), "text string, ok boolean, same boolean, fixed boolean")


def round_trip(json_text: Column | str) -> Column:
    """Struct (text, ok, same, fixed) of JSON text, in one pass: its text, whether that is read, gives the same text without a repair, and is a fixed point."""
    return _round_trip()(json_text)


@lru_cache(64)
def _lenient_udf(schema: str | None):
    declared = as_declared(schema)

    def one(text: str) -> dict:
        found = decoding.decode_lenient_text(text, declared)
        return {"value": dumps(found.value), "errors": found.errors, "repairs": _notes(found.repairs), "truncated": found.truncated}

    return _udf(_over(one, _lenient), LENIENT)


@lru_cache(64)
def _validate(schema: str | None):
    declared = as_declared(schema)

    def one(text: str) -> dict:
        errors = decoding.validate_text(text, declared)
        return {"ok": not errors, "errors": errors}

    return _udf(_over(one, _checked), CHECKED)


@lru_cache(1)
def _fixed():
    def one(text: str) -> dict:
        found = _read_by(text, None)
        return {k: found[k] for k in ("ok", "canonical", "error", "repairs")}

    return _udf(_over(one, pa.struct([_decoded.field(k) for k in ("ok", "canonical", "error", "repairs")])), f"ok boolean, canonical string, error string, repairs {REPAIRS}")


@lru_cache(1)
def _numbers():
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None or x != x or abs(x) == float("inf") else number_text(x) for x in values.to_pylist()], pa.string())

    return _udf(run, "string")


@lru_cache(1)
def _inline_like():
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else looks_like_inline_object(x) for x in texts.to_pylist()], pa.bool_())

    return _udf(run, "boolean")


def encode(json_text: Column | str, profile: str = "canonical", markers: bool = False) -> Column:
    """Struct (text, error) of JSON text; null stays null. A variant is given as to_json of it."""
    return _encode(profile, markers)(json_text)


def encode_column(c: Column, kind: T.DataType, profile: str = "canonical", markers: bool = False) -> Column:
    """Text of a struct column: by expressions if its type allows for it, else through the Arrow function.

    A map whose keys aren't strings is refused.
    """
    from leafwork.functions import native

    _check_keys(kind)
    try:
        return native.encode_struct(c, kind, profile, markers)
    except native.NotStatic:
        return encode(F.to_json(c, {"ignoreNullFields": "false"}), profile, markers)["text"]


def _check_keys(kind: T.DataType) -> None:
    if isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise Unreadable(f"a map's keys have to be strings, not {kind.keyType.simpleString()}")
        _check_keys(kind.valueType)
    elif isinstance(kind, T.ArrayType):
        _check_keys(kind.elementType)
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            _check_keys(f.dataType)


def decode(text: Column | str, schema: str | None = None) -> Column:
    """Struct (ok, value as JSON, canonical, error, repairs); with a declaration, its types hold."""
    return _decode(_key(schema))(text)


def decode_value(text: Column | str, schema: str | None = None) -> Column:
    """decode's value as JSON alone, null where reading fails: for queries that ask for nothing else."""
    return _values(_key(schema))(text)


def decode_typed(text: Column | str, schema: str, fields: list[str] | None = None) -> Column:
    """The declared fields as a struct of Spark types (some of them where fields is given); null where reading fails.

    Where the declaration holds scalars and objects of them alone, flat and undamaged texts are read by expressions, and
    the Arrow function gets nulls for them.
    """
    declared = parse_declaration(schema)
    kind = spark_type(declared)
    if fields is not None:
        kind = T.StructType([f for f in kind.fields if f.name in set(fields)])
    if not native_decode.is_flat(declared):
        return F.from_json(decode_value(text, schema), kind)
    text = F.col(text) if isinstance(text, str) else text
    flat, read = native_decode.flat_fields(text, declared, kind)
    return F.when(flat, read).otherwise(F.from_json(decode_value(F.when(~flat, text), schema), kind))


def decode_variant(text: Column | str, schema: str | None = None) -> Column:
    return F.try_parse_json(decode_value(text, schema))


def decode_lenient(text: Column | str, schema: str | None = None) -> Column:
    """Struct (value as JSON, errors, repairs, truncated): whatever leaves can be read."""
    return _lenient_udf(_key(schema))(text)


def fix(text: Column | str, schema: str | None = None) -> Column:
    """Struct (ok, canonical, error, repairs): decode's result without the value."""
    found = decode(text, schema)
    return F.struct(found["ok"].alias("ok"), found["canonical"].alias("canonical"), found["error"].alias("error"), found["repairs"].alias("repairs"))


def validate(text: Column | str, schema: str | None = None) -> Column:
    """Struct (ok, errors): whether a text is canonical, for filters and checks."""
    return _validate(_key(schema))(text)


def double_text(x: Column | str) -> Column:
    """Shortest text of any double; null for NaN and infinities."""
    return _numbers()(x)


def inline_like(x: Column | str) -> Column:
    return _inline_like()(x)


def register(spark: SparkSession, prefix: str = "leaf_") -> list[str]:
    """Name the functions for SQL: leaf_encode, leaf_encode_generation, leaf_decode, leaf_decode_lenient, leaf_validate, leaf_fix, leaf_number.

    leaf_decode_by, leaf_decode_lenient_by and leaf_validate_by take a declaration as second argument, and leaf_leaves is
    a table function: the leaves of a JSON text as rows.
    """
    found = {
        "encode": _encode("canonical", False),
        "encode_generation": _encode("generation", False),
        "decode": _decode(None),
        "decode_lenient": _lenient_udf(None),
        "validate": _validate(None),
        "fix": _fixed(),
        "number": _numbers(),
        "decode_by": _udf_by_row(_read_by, _decoded, DECODED),
        "decode_lenient_by": _udf_by_row(_lenient_by, _lenient, LENIENT),
        "validate_by": _udf_by_row(_check_by, _checked, CHECKED),
    }
    for name, f in found.items():
        spark.udf.register(prefix + name, f)
    from leafwork.operators.leaves import leaves_table

    spark.udtf.register(prefix + "leaves", leaves_table())
    return [prefix + name for name in [*found, "leaves"]]
