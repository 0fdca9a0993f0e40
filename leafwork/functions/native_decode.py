"""Flat, undamaged texts read by expressions: which they are, and their declared fields."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.functions.inference import Declared
from leafwork.functions.wire import SPACE

_name = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Values by declared type, such that they need no protection: strings open nothing, neither by their beginning nor by their end, and numbers can't be too large.
STRING = rf"(?![<\[{{])(?![^\n]*=(?:\[|\{{[{SPACE}]*|<{{1,3}}[0-9a-fA-F]*)(?:\n|\z))(?:[^\n\r]*[^\n\r{SPACE}])?"
NUMBER = r"-?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]{1,17})?(?:[eE][+-]?[0-9]{1,2})?"
VALUES = {"s": STRING, "t": STRING, "n": NUMBER, "b": "true|false"}


def _scalars(place: Declared, prefix: str = "") -> Iterator[tuple[str, Declared]]:
    for name, member in place.fields.items():
        path = f"{prefix}.{name}" if prefix else name
        yield path, member
        yield from _scalars(member, path)


def is_flat(schema: Declared) -> bool:
    """Whether a declaration holds but strings, numbers and booleans of plain names, and objects of those that aren't optional."""
    places = [m for _, m in _scalars(schema)]
    plain = all(_name.fullmatch(n) for p in [schema, *places] for n in p.fields)
    kinds = all(m.element is None and (m.code in ("s", "t", "n", "b") and not m.fields or m.code is None and bool(m.fields) and not m.optional) for m in places)
    return plain and kinds and bool(places)


def flat_pattern(schema: Declared) -> tuple[str, dict[str, int]]:
    """(pattern of the flat texts of a flat declaration, group of each field's line).

    They have one line name=value for each field that is there, in canonical order; each required field, and some
    field of each object; and values of the declared types.
    """
    leaves = sorted(((p, m) for p, m in _scalars(schema) if m.code is not None), key=lambda x: x[0].split("."))
    there = [rf"(?=(?:[^\n]*\n)*{re.escape(p)}\.)" for p, m in _scalars(schema) if m.code is None]
    lines, groups = [], {}
    for n, (path, m) in enumerate(leaves, 1):
        value = f"(?:{VALUES[m.code]}{'|null' if m.optional else ''})"
        lines.append(rf"(?:(?:\A|\n)({re.escape(path)}={value})(?=\n|\z))" + "?" * m.optional)
        groups[path] = n
    return rf"\A{''.join(there)}{''.join(lines)}\z", groups


def flat_fields(text: Column, schema: Declared, kind: T.StructType) -> tuple[Column, Column]:
    """(whether the text is flat, its declared fields as a struct of kind) for a flat declaration (see flat_pattern).

    Any other text is for the Arrow function; the struct stands for flat texts alone.
    """
    pattern, groups = flat_pattern(schema)
    # where all fields are there, lines are told by their places
    whole = not any(m.optional for _, m in _scalars(schema))

    def one(path: str, place: Declared, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            return F.struct(*[one(f"{path}.{f.name}" if path else f.name, place.fields[f.name], f.dataType).alias(f.name) for f in t.fields])
        line = F.get(F.split(text, "\n"), groups[path] - 1) if whole else F.regexp_extract(text, pattern, groups[path])
        value = F.substr(line, F.lit(len(path) + 2))
        if place.optional:
            value = F.when((line != "") & (value != "null"), value)
        return value.cast("double") if place.code == "n" else value == "true" if place.code == "b" else value

    return F.coalesce(text.rlike(pattern), F.lit(False)), one("", schema, kind)
