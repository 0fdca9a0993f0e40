"""Columns of static types to text: a struct type compiled to one Column, without Python in the plan.

Modes, key order, key quoting and table columns are known from the type; what
depends on values (which strings need protection, which array form is the least) is
left to expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.functions import columns
from leafwork.functions.wire import CLOSE, FRAME_CLOSE, FRAME_OPEN, NUMBER, OPEN, SPACE, Unreadable, inline_key_text, key_text, split_cells

LINE, TABLE, LITERAL, BLOCK = range(4)
SCALARS = (T.StringType, T.BooleanType, T.IntegralType, T.FractionalType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType, T.NullType)

#: Types whose text is an ISO date or time.
PLAIN = (T.DateType, T.TimestampType, T.TimestampNTZType)


class NotStatic(ValueError):
    """The type has no static form."""


#: A line that would close a block, in a string of several lines; such a block takes a nonce.
CLOSER_LINE = r"(?:^|\n)>>>\r?\n|\n>>>\r?\z"
#: Longs beyond this are rounded, as all numbers are doubles.
EXACT = 1 << 53


def _let(value: Column, f) -> Column:
    """f of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), f), 0)


def _literal_like(s: Column) -> Column:
    return s.isin("true", "false", "null") | s.rlike(rf"^{NUMBER}\z")


def _edge_space(s: Column) -> Column:
    return F.btrim(s, F.lit(SPACE)) != s


def _opener_tail(s: Column) -> Column:
    return s.rlike(r"(?:^|=)(?:<{1,3}[0-9a-fA-F]*|\[)\z")


def _wrap(s: Column) -> Column:
    return F.concat(F.lit(OPEN), s, F.lit(CLOSE))


class Compiler:
    """Expressions for all values that aren't odd (see _odd): numbers of few digits, and no string that might read as an inline object or needs a nonce.

    No function of an element holds another one that reads it: Spark can't hand such expressions to Python functions.
    """

    # scalars

    def number(self, c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.IntegralType):
            return c.cast("string")
        if isinstance(t, T.DecimalType):
            return _plain_decimal(c.cast("string"))
        return _plain_decimal(_short(_as_double(c, t)).cast("string"))

    def as_string(self, c: Column, t: T.DataType) -> Column | None:
        """The string that a value of the type is written as; None for types with literals of their own."""
        if isinstance(t, T.StringType):
            return c
        if isinstance(t, T.DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        if isinstance(t, T.BinaryType):
            return F.base64(c)
        return None

    def literal(self, c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.NullType):
            return F.lit("null")
        return F.coalesce(c.cast("string") if isinstance(t, T.BooleanType) else self.number(c, t), F.lit("null"))

    def string_leaf(self, path: Column, s: Column) -> Column:
        edge, tail = _edge_space(s), _opener_tail(s)
        odd = (s == "") | edge | s.startswith(OPEN) | s.isin("[]", "{}") | s.contains(CLOSE) | tail | _literal_like(s)
        untaggable = edge | tail | (s.startswith(OPEN) & s.endswith(CLOSE))
        block = F.concat(path, F.lit("=" + OPEN + "\n"), s, F.lit("\n" + CLOSE))
        return (
            F.when(s.isNull(), F.concat(path, F.lit("=null")))
            .when(s.contains("\n"), block)
            .when(~odd, F.concat(path, F.lit("="), s))
            .when(untaggable, F.concat(path, F.lit("="), _wrap(s)))
            .otherwise(F.concat(path, F.lit(":s="), s))
        )

    def scalar_leaf(self, path: Column, c: Column, t: T.DataType) -> Column:
        s = self.as_string(c, t)
        if s is None:
            return F.concat(path, F.lit("="), self.literal(c, t))
        if isinstance(t, PLAIN):  # never in need of protection
            return F.concat(path, F.lit("="), F.coalesce(s, F.lit("null")))
        if isinstance(t, T.StringType):
            return self.string_leaf(path, s)
        return self.string_leaf(path, s)

    # cells

    def cell(self, c: Column, t: T.DataType, where: str) -> Column:
        s = self.as_string(c, t)
        if s is None:
            return self.literal(c, t)
        if isinstance(t, PLAIN):
            return F.coalesce(s, F.lit("null"))
        odd = (s == "") | _edge_space(s) | (s == "[]") | _literal_like(s)
        if where == "literal":
            odd = odd | s.isin("[", "]", "{}") | s.startswith(OPEN)
        else:
            odd = odd | s.contains(",") | s.contains("{") | s.contains(OPEN)
            odd = odd | (s.contains("}") if where == "inline" else _opener_tail(s))
        return F.when(s.isNull(), F.lit("null")).when(odd, _wrap(s)).otherwise(s)

    def fits_cell(self, c: Column, t: T.DataType, in_literal: bool = False) -> Column:
        if not isinstance(t, T.StringType):
            return F.lit(True)
        return F.coalesce(~c.rlike("[\\n\\r]" if in_literal else "[\\n\\r]|>>>"), F.lit(True))

    def inline(self, c: Column, t: T.StructType) -> Column:
        parts = [F.concat(F.lit(inline_key_text(f.name) + "="), self.cell(c[f.name], f.dataType, "inline")) for f in _sorted(t)]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    def fits_inline(self, c: Column, t: T.StructType) -> Column:
        out = c.isNotNull()
        for f in t.fields:
            out = out & self.fits_cell(c[f.name], f.dataType)
        return out

    # canonical form: the text of a node

    def canonical(self, path: Column, c: Column, t: T.DataType, root: bool = False) -> Column:
        if isinstance(t, T.StructType):
            fields = [self.canonical(_member(path, f.name, root), c[f.name], f.dataType) for f in _sorted(t)]
            if not fields:
                return F.lit(None).cast("string") if root else F.concat(path, F.lit("={}"))
            out = F.concat_ws("\n", *fields)
            if root:
                return out
            if _flat(t):
                inline = F.when(self.fits_inline(c, t), F.concat(path, F.lit("="), self.inline(c, t)))
                units = lambda p: F.octet_length(F.encode(p["inline"], "UTF-16BE")) / 2
                less = lambda p: F.when(units(p) < F.octet_length(p["lines"]), p["inline"]).otherwise(p["lines"])
                out = _let(F.struct(inline.alias("inline"), out.alias("lines")), less)
            return F.when(c.isNull(), F.concat(path, F.lit("=null"))).otherwise(out)
        if isinstance(t, T.ArrayType):
            forms = [self.by_path(path, c, t), self.table(path, c, t), self.inline_rows(path, c, t), self.literal_rows(path, c, t)]
            ranked = [F.struct(F.lit(k).alias("rank"), f.alias("text")) for k, f in enumerate(forms) if f is not None]
            there = F.filter(F.array(*ranked), lambda f: f["text"].isNotNull())
            best = F.array_min(F.transform(there, lambda f: F.struct(F.octet_length(f["text"]).alias("size"), f["rank"].alias("rank"), f["text"].alias("text"))))["text"]
            return F.when(c.isNull(), F.concat(path, F.lit("=null"))).when(F.size(c) == 0, F.concat(path, F.lit("=[]"))).otherwise(best)
        if not isinstance(t, SCALARS):
            raise NotStatic(f"a {t.simpleString()} has no static form")
        return self.scalar_leaf(path, c, t)

    def by_path(self, path: Column, c: Column, t: T.ArrayType) -> Column:
        return F.array_join(F.transform(c, lambda x, i: self.canonical(_at(path, i), x, t.elementType)), "\n")

    def table(self, path: Column, c: Column, t: T.ArrayType) -> Column | None:
        e = t.elementType
        if not (isinstance(e, T.StructType) and _flat(e)) or not _table_names(e):
            return None
        fits = (F.size(c) >= 2) & F.forall(c, lambda x: self.fits_inline(x, e))
        rows = F.transform(c, lambda x, i: F.concat(_at(path, i), F.lit("="), F.concat_ws(",", *[self.cell(x[f.name], f.dataType, "table") for f in _sorted(e)])))
        return F.when(fits, F.concat(path, F.lit("::" + ",".join(f.name for f in _sorted(e)) + "\n"), F.array_join(rows, "\n")))

    def inline_rows(self, path: Column, c: Column, t: T.ArrayType) -> Column | None:
        e = t.elementType
        if not (isinstance(e, T.StructType) and _flat(e)):
            return None
        rows = F.transform(c, lambda x, i: F.concat(_at(path, i), F.lit("="), self.inline(x, e)))
        return F.when(F.forall(c, lambda x: self.fits_inline(x, e)), F.array_join(rows, "\n"))

    def literal_rows(self, path: Column, c: Column, t: T.ArrayType) -> Column | None:
        e = t.elementType
        if isinstance(e, T.StructType) and _flat(e):
            fits = F.forall(c, lambda x: x.isNull() | self.fits_inline(x, e))
            rows = F.transform(c, lambda x: F.when(x.isNull(), F.lit("null")).otherwise(self.inline(x, e)))
        elif isinstance(e, SCALARS):
            fits = F.forall(c, lambda x: self.fits_cell(x, e, in_literal=True))
            rows = F.transform(c, lambda x: self.cell(x, e, "literal"))
        else:
            return None
        return F.when(fits, F.concat(path, F.lit("=[\n"), F.array_join(rows, "\n"), F.lit("\n]")))

    # generation profile: units that are then put in the order of their ranks

    def units(self, path: Column, c: Column, t: T.DataType, root: bool = False) -> Column:
        if isinstance(t, T.StructType) and t.fields:
            out = F.flatten(F.array(*[self.units(_member(path, f.name, root), c[f.name], f.dataType) for f in _sorted(t)]))
            return out if root else F.when(c.isNull(), F.array(_unit(LINE, F.concat(path, F.lit("=null"))))).otherwise(out)
        if isinstance(t, T.ArrayType):
            forms = [(TABLE, self.table(path, c, t)), (LITERAL, self.literal_rows(path, c, t))]
            out = F.flatten(F.transform(c, lambda x, i: self.units(_at(path, i), x, t.elementType)))
            for rank, form in reversed([f for f in forms if f[1] is not None]):
                out = F.when(form.isNotNull(), F.array(_unit(rank, form))).otherwise(out)
            return F.when(c.isNull(), F.array(_unit(LINE, F.concat(path, F.lit("=null"))))).when(F.size(c) == 0, F.array(_unit(LINE, F.concat(path, F.lit("=[]"))))).otherwise(out)
        return _let(self.canonical(path, c, t), lambda text: F.array(_unit(F.when(text.contains("\n"), F.lit(BLOCK)).otherwise(F.lit(LINE)), text)))


def _unit(rank: Column | int, text: Column) -> Column:
    return F.struct((F.lit(rank) if isinstance(rank, int) else rank).cast("int").alias("rank"), text.alias("text"))


def _as_double(c: Column, t: T.DataType) -> Column:
    """A float stands for the double of its digits."""
    return c.cast("string").cast("double") if isinstance(t, T.FloatType) else c.cast("double")


def _short(d: Column) -> Column:
    """A double below 1e9 as a decimal of 6 places."""
    return F.when(F.abs(d) >= 1e9, F.lit(0.0)).otherwise(d).cast("decimal(17,6)")


def _finite(d: Column) -> Column:
    return ~(F.isnan(d) | (F.abs(d) == float("inf")))


def _any(tests: list[Column | None]) -> Column | None:
    out = None
    for t in tests:
        out = t if out is None else out if t is None else out | t
    return out


def _odd(c: Column, t: T.DataType) -> Column | None:
    """Whether a value isn't for expressions: long numbers, strings in braces and those that need a nonce; None if no value of the type is."""
    if isinstance(t, T.StringType):
        braces = c.startswith("{") & c.endswith("}") & c.contains("=")
        return F.coalesce(braces | (c.contains(CLOSE) & c.rlike(CLOSER_LINE)), F.lit(False))
    if isinstance(t, T.LongType):
        return F.coalesce((c > EXACT) | (c < -EXACT), F.lit(False))
    if isinstance(t, T.DecimalType):
        if t.precision <= 15 and t.scale <= 6:
            return None
        few = F.when(F.abs(c) < 1_000_000_000, c).otherwise(F.lit(0)).cast("decimal(15,6)")
        return F.coalesce((F.abs(c) >= 1_000_000_000) | (few != c), F.lit(False))
    if isinstance(t, T.FractionalType):
        d = _as_double(c, t)
        return F.coalesce(~_finite(d) | (F.abs(d) >= 1e9) | (_short(d).cast("double") != d), F.lit(False))
    if isinstance(t, T.StructType):
        return _any([_odd(c[f.name], f.dataType) for f in t.fields])
    if isinstance(t, T.ArrayType):
        inner = _odd(F.lit(None).cast(t.elementType), t.elementType)
        return None if inner is None else F.coalesce(F.exists(c, lambda x: _odd(x, t.elementType)), F.lit(False))
    return None


def _as_json(c: Column, t: T.DataType) -> Column:
    """The value with what has no JSON form of its own as the strings it is written as; a number that isn't finite is an error."""
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_as_json(c[f.name], f.dataType).alias(f.name) for f in t.fields])) if t.fields else c
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _as_json(x, t.elementType))
    if isinstance(t, (T.FloatType, T.DoubleType)):
        d = _as_double(c, t)
        return F.when(c.isNull() | _finite(d), d).otherwise(F.raise_error(F.lit("non-finite number")).cast("double"))
    s = Compiler().as_string(c, t)
    return c if s is None else s


def _plain_decimal(s: Column) -> Column:
    trimmed = F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(trimmed == "-0", F.lit("0")).otherwise(trimmed)


def _sorted(t: T.StructType) -> list[T.StructField]:
    return sorted(t.fields, key=lambda f: f.name)


def _flat(t: T.StructType) -> bool:
    names_fit = all(f.name and not any(x in f.name for x in ("\n", "\r", OPEN, CLOSE)) for f in t.fields)
    return bool(t.fields) and names_fit and all(isinstance(f.dataType, SCALARS) for f in t.fields)


def _table_names(t: T.StructType) -> bool:
    names = [f.name for f in _sorted(t)]
    return not any(x in n for n in names for x in (",", OPEN, CLOSE, "=", ":")) and split_cells(",".join(names)) == names


def _member(path: Column, name: str, root: bool) -> Column:
    return F.lit(key_text(name)) if root else F.concat(path, F.lit("." + key_text(name)))


def _at(path: Column, i: Column) -> Column:
    return F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))


def encode_struct(c: Column, t: T.StructType, profile: str = "canonical", markers: bool = False) -> Column:
    """Text of a struct column of static type; null stays null.

    A field that is null is written as null. Dates, timestamps and binary become strings,
    maps are not of static type (see columns.encode). A name that can't be written is an
    error at once, a number that isn't finite one on use. Rows are written by expressions; one that holds
    a number of more than 6 places, from 1e9 (or a long beyond 2^53), a string in braces that might read as an
    object, or one that needs a nonce, goes through the Arrow function as a whole, and others send it a null. So the text is the same either way.
    """
    if profile not in ("canonical", "generation"):
        raise Unreadable(f"no such profile: {profile}")
    compiler = Compiler()
    if profile == "canonical":
        body = F.coalesce(compiler.canonical(F.lit(""), c, t, root=True), F.lit(""))
    else:
        units = F.transform(compiler.units(F.lit(""), c, t, root=True), lambda u, i: F.struct(u["rank"].alias("rank"), i.alias("i"), u["text"].alias("text")))
        body = F.array_join(F.transform(F.array_sort(units), lambda u: u["text"]), "\n")
    if markers:
        body = F.when(body == "", F.lit(f"{FRAME_OPEN}\n{FRAME_CLOSE}")).otherwise(F.concat(F.lit(FRAME_OPEN + "\n"), body, F.lit("\n" + FRAME_CLOSE)))
    odd = _odd(c, t)
    if odd is not None:
        json = F.when(odd, F.to_json(_as_json(c, t), {"ignoreNullFields": "false"}))
        body = F.when(odd, columns.encode(json, profile, markers)["text"]).otherwise(body)
    return F.when(c.isNotNull(), body)
