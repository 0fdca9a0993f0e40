"""The leaf table: objects and texts as rows, one per value, addressed by path."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.functions import native
from leafwork.functions.columns import loads
from leafwork.functions.decoding import Document
from leafwork.functions.wire import Unreadable, key_text

PATH = "array<struct<is_index:boolean,idx:int,name:string>>"
LEAF = f"ord int, path {PATH}, path_text string, vtype string, str string, num double, bool boolean"
LINE = "pos int, key string, kind string, tag string, raw string, cells array<string>"

_path = pa.list_(pa.struct([("is_index", pa.bool_()), ("idx", pa.int32()), ("name", pa.string())]))
_leaf = [("ord", pa.int32()), ("path", _path), ("path_text", pa.string()), ("vtype", pa.string()), ("str", pa.string()), ("num", pa.float64()), ("bool", pa.bool_())]
_line = [("pos", pa.int32()), ("key", pa.string()), ("kind", pa.string()), ("tag", pa.string()), ("raw", pa.string()), ("cells", pa.list_(pa.string()))]


def walk(value: object) -> Iterator[tuple[list, object]]:
    """(steps, value) of each scalar and each empty container, in canonical order, on a stack of its own."""
    todo = [([], value)]
    while todo:
        steps, v = todo.pop()
        if isinstance(v, dict) and v:
            todo += [([*steps, k], v[k]) for k in sorted(v, reverse=True)]
        elif isinstance(v, list) and v:
            todo += [([*steps, i], x) for i, x in reversed(list(enumerate(v)))]
        else:
            yield steps, v


def same_value(a: object, b: object) -> bool:
    """Whether two leaves are the same: of one type, and equal."""
    return type(a) is type(b) and a == b


def steps_text(steps: list) -> str:
    out = ""
    for s in steps:
        out += f"[{s}]" if isinstance(s, int) else ("." if out else "") + key_text(s)
    return out


def _leaf_row(n: int, steps: list, v: object) -> dict:
    kind = "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "empty_array" if v == [] else "empty_object" if v == {} else "number"
    return {
        "ord": n,
        "path": [{"is_index": isinstance(s, int), "idx": s if isinstance(s, int) else None, "name": None if isinstance(s, int) else s} for s in steps],
        "path_text": steps_text(steps),
        "vtype": kind,
        "str": v if kind == "string" else None,
        "num": float(v) if kind == "number" else None,
        "bool": v if kind == "boolean" else None,
    }


def _explode(df: DataFrame, column: str, keys: tuple[str, ...], rows_of, fields: list, ddl: str) -> DataFrame:
    n = len(keys)
    own = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, text in enumerate(b.column(n).to_pylist()):
                for row in rows_of(text) if text is not None else ():
                    at.append(i)
                    out.append(row)
            where = pa.array(at, pa.int32())
            made = [b.column(k).take(where) for k in range(n)] + [pa.array([r[name] for r in out], kind) for name, kind in fields]
            yield pa.RecordBatch.from_arrays(made, names=[*keys, *(name for name, _ in fields)])

    return df.select(*keys, column).mapInArrow(run, ", ".join(x for x in (own, ddl) if x))


def json_leaves(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """A row per leaf of the JSON text in column, beside the columns keys.

    A null text, and one that is no JSON, has no leaves.
    """

    def rows_of(text: str):
        try:
            return [_leaf_row(n, steps, v) for n, (steps, v) in enumerate(walk(loads(text)))]
        except (Unreadable, ValueError):
            return []

    return _explode(df, column, keys, rows_of, _leaf, LEAF)


def _one(path: Column, c: Column, kind: str, **values: Column) -> Column:
    """An array of one leaf, null where c is."""
    parts = {"str": F.lit(None).cast("string"), "num": F.lit(None).cast("double"), "bool": F.lit(None).cast("boolean")} | values
    return F.array(F.struct(path.alias("path_text"), F.when(c.isNull(), "null").otherwise(kind).alias("vtype"), *[v.alias(k) for k, v in parts.items()]))


def _static(path: Column, c: Column, t: T.DataType, root: bool = False) -> Column:
    if isinstance(t, T.StructType) and t.fields:
        member = lambda f: F.lit(key_text(f.name)) if root else F.concat(path, F.lit("." + key_text(f.name)))
        inner = F.flatten(F.array(*[_static(member(f), c[f.name], f.dataType) for f in sorted(t.fields, key=lambda f: f.name)]))
        return inner if root else F.when(c.isNull(), _one(path, c, "null")).otherwise(inner)
    if isinstance(t, T.StructType):
        return _one(path, c, "empty_object")
    if isinstance(t, T.ArrayType):
        rows = F.flatten(F.transform(c, lambda x, i: _static(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), x, t.elementType)))
        return F.when(c.isNull() | (F.size(c) == 0), _one(path, c, "empty_array")).otherwise(rows)
    if isinstance(t, T.BooleanType):
        return _one(path, c, "boolean", bool=c)
    if isinstance(t, T.NumericType):
        return _one(path, c, "number", num=c.cast("double"))
    s = F.lit(None).cast("string") if isinstance(t, T.NullType) else native.Compiler().as_string(c, t)
    if s is None:
        raise native.NotStatic(f"the leaves of a {t.simpleString()} are not known from its type")
    return _one(path, c, "string", str=s)


def struct_leaves(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """json_leaves of a struct column of static type, by expressions alone: keys, ord, path_text, vtype, str, num, bool. A null struct has none."""
    found = _static(F.lit(""), F.col(column), df.schema[column].dataType, root=True)
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.posexplode(found).alias("ord", "leaf"))
    return rows.select(*keys, "ord", "leaf.*")


def text_leaves(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """A row per leaf line of the text in column, as it is read leniently: key, kind and what stands there.

    kind: bare, tagged, block, header, row or literal; cells: of headers, rows and literals.
    """

    def rows_of(text: str):
        leaves = Document(text, lenient=True).leaves()
        return [
            {"pos": n, "key": x.key, "kind": x.kind, "tag": x.tag or None, "raw": x.body if isinstance(x.body, str) else None, "cells": None if isinstance(x.body, str) else x.body}
            for n, x in enumerate(leaves)
        ]

    return _explode(df, column, keys, rows_of, _line, LINE)


def leaf_counts(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, leaves) for every row of df; documents without leaves count 0."""
    found = json_leaves(df, column, *keys).groupBy(*keys).agg(F.count("*").alias("leaves"))
    return df.select(*keys).join(found, list(keys), "left").fillna(0, ["leaves"])


def leaf_profile(leaves: DataFrame) -> DataFrame:
    """Per path without indexes: documents' leaves by type."""
    path = F.regexp_replace("path_text", r"\[[0-9]+\]", "[]")
    return leaves.groupBy(path.alias("path_text"), "vtype").agg(F.count("*").alias("leaves"))


def leaves_table():
    """The table function behind leaf_leaves(json): ord, path_text, vtype, str, num, bool of each leaf."""

    class Leaves:
        def eval(self, text: str):
            try:
                found = [] if text is None else list(walk(loads(text)))
            except (Unreadable, ValueError):
                found = []
            for n, (steps, v) in enumerate(found):
                r = _leaf_row(n, steps, v)
                yield tuple(r[k] for k in ("ord", "path_text", "vtype", "str", "num", "bool"))

    return F.udtf(Leaves, returnType="ord int, path_text string, vtype string, str string, num double, bool boolean")
