"""Objects of any shape to text: canonical, by least size, or the fixed generation profile."""

from __future__ import annotations

from dataclasses import dataclass

from leafwork.functions.inference import looks_like_inline_object
from leafwork.functions.wire import (
    CLOSE,
    FRAME_CLOSE,
    FRAME_OPEN,
    OPEN,
    Unreadable,
    has_edge_space,
    has_opener_tail,
    inline_key_text,
    is_literal,
    key_text,
    nonce_for,
    number_text,
    split_cells,
    utf8_size,
    utf16_size,
    without_cr,
)

#: Order of units in the generation profile: what a cut text should keep comes first.
LINE, TABLE, LITERAL, BLOCK = range(4)


@dataclass
class Unit:
    """Lines that stay together, and how they rank in the generation profile."""

    text: str
    rank: int = LINE

    @property
    def size(self) -> int:
        return utf8_size(self.text) + 1


def size(units: list[Unit]) -> int:
    return sum(u.size for u in units)


def is_scalar(v: object) -> bool:
    return v is None or isinstance(v, (bool, int, float, str))


def scalar_text(v: object) -> str | None:
    """Text of null, booleans and numbers; None for the rest."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return number_text(v)
    return None


def _finite(v: object) -> bool:
    return not isinstance(v, float) or (v == v and abs(v) != float("inf"))


def fits_cell(v: object) -> bool:
    return is_scalar(v) and _finite(v) and not (isinstance(v, str) and ("\n" in v or "\r" in v or CLOSE in v))


def fits_inline(v: object) -> bool:
    if not isinstance(v, dict) or not v:
        return False
    return all(k and not any(x in k for x in ("\n", "\r", OPEN, CLOSE)) and fits_cell(x) for k, x in v.items())


def fits_literal(v: object) -> bool:
    if isinstance(v, str):
        return "\n" not in v and "\r" not in v
    return (is_scalar(v) and _finite(v)) or fits_inline(v)


def _plain_in_any_cell(s: str) -> bool:
    return bool(s) and not has_edge_space(s) and s != "[]" and not is_literal(s)


def plain_in_inline(s: str) -> bool:
    return _plain_in_any_cell(s) and not any(x in s for x in (",", "{", "}", OPEN))


def plain_in_table(s: str) -> bool:
    return _plain_in_any_cell(s) and not any(x in s for x in (",", "{", OPEN)) and not has_opener_tail(s)


def plain_in_literal(s: str) -> bool:
    return _plain_in_any_cell(s) and s not in ("[", "]", "{}") and not s.startswith(OPEN) and not looks_like_inline_object(s)


def cell_text(v: object, plain) -> str:
    if isinstance(v, str):
        return v if plain(v) else f"{OPEN}{v}{CLOSE}"
    return scalar_text(v)


def inline_text(v: dict) -> str:
    cells = [f"{inline_key_text(k)}={cell_text(v[k], plain_in_inline)}" for k in sorted(v)]
    return "{" + ",".join(cells) + "}"


def string_unit(path: str, s: str) -> Unit:
    """A string as a leaf: bare, tagged, wrapped, or a block if it has line feeds."""
    if "\n" in s:
        nonce = nonce_for(s) if any(without_cr(x) == CLOSE for x in s.split("\n")) else ""
        return Unit(f"{path}={OPEN}{nonce}\n{s}\n{CLOSE}{nonce}", BLOCK)
    edge, tail = has_edge_space(s), has_opener_tail(s)
    odd = not s or edge or tail or s.startswith(OPEN) or CLOSE in s or s in ("[]", "{}") or is_literal(s) or looks_like_inline_object(s)
    if not odd:
        return Unit(f"{path}={s}")
    if edge or tail or (s.startswith(OPEN) and s.endswith(CLOSE)):
        return Unit(f"{path}={OPEN}{s}{CLOSE}")
    return Unit(f"{path}:s={s}")


class Encoder:
    def __init__(self, profile: str = "canonical") -> None:
        if profile not in ("canonical", "generation"):
            raise ValueError(f"no such profile: {profile}")
        self.canonical = profile == "canonical"

    def units(self, v: object, path: str) -> list[Unit]:
        if isinstance(v, dict):
            return self.object_units(v, path)
        if isinstance(v, (list, tuple)):
            return self.array_units(list(v), path) if v else [Unit(f"{path}=[]")]
        if isinstance(v, str):
            return [string_unit(path, v)]
        if not is_scalar(v):
            raise Unreadable(f"unexpected value at {path}: {type(v).__name__}")
        if not _finite(v):
            raise Unreadable(f"non-finite number at {path}: {v}")
        return [Unit(f"{path}={scalar_text(v)}")]

    def object_units(self, v: dict, path: str, inline: str | None = None) -> list[Unit]:
        """inline: the object's cells in braces, where they are known."""
        if any(not isinstance(k, str) for k in v):
            raise Unreadable(f"a key at '{path}' is not a string")
        if not v:
            return [Unit(f"{path}={{}}")] if path else []
        out = [u for k in sorted(v) for u in self.units(v[k], f"{path}.{key_text(k)}" if path else key_text(k))]
        if self.canonical and path:
            inline = inline or (inline_text(v) if fits_inline(v) else None)
            if inline is not None and utf16_size(f"{path}={inline}") + 1 < size(out):
                return [Unit(f"{path}={inline}")]
        return out

    def array_units(self, v: list, path: str) -> list[Unit]:
        """The least form; of forms of one size by path, then table, inline rows and literal."""
        inline = [inline_text(x) if fits_inline(x) else None for x in v]
        if not self.canonical:
            return self.table(v, path, inline) or self.literal(v, path, inline) or self.by_path(v, path, inline)
        forms = [self.by_path(v, path, inline), self.table(v, path, inline), self.inline_rows(path, inline), self.literal(v, path, inline)]
        return min((f for f in forms if f), key=size)

    def by_path(self, v: list, path: str, inline: list[str | None]) -> list[Unit]:
        return [u for i, x in enumerate(v) for u in (self.object_units(x, f"{path}[{i}]", inline[i]) if isinstance(x, dict) else self.units(x, f"{path}[{i}]"))]

    def table(self, v: list, path: str, inline: list[str | None]) -> list[Unit] | None:
        """A header of the columns and a line per row, where all rows have the same names and plain cells."""
        if len(v) < 2 or not all(isinstance(x, dict) and x for x in v):
            return None
        names = sorted(v[0])
        if any(x.keys() != v[0].keys() for x in v):
            return None
        if not all(row is not None or all(map(fits_cell, x.values())) for row, x in zip(inline, v, strict=True)):
            return None
        if any(mark in n for n in names for mark in (",", OPEN, CLOSE, "=", ":")):
            return None
        header = ",".join(names)
        if split_cells(header) != names or any("\n" in n or "\r" in n for n in names):
            return None
        rows = [f"{path}::{header}"]
        rows += [f"{path}[{i}]=" + ",".join(cell_text(x[n], plain_in_table) for n in names) for i, x in enumerate(v)]
        return [Unit("\n".join(rows), TABLE)]

    def inline_rows(self, path: str, inline: list[str | None]) -> list[Unit] | None:
        return None if None in inline else [Unit(f"{path}[{i}]={row}") for i, row in enumerate(inline)]

    def literal(self, v: list, path: str, inline: list[str | None]) -> list[Unit] | None:
        if not all(row is not None or fits_literal(x) for row, x in zip(inline, v, strict=True)):
            return None
        rows = [row or cell_text(x, plain_in_literal) for row, x in zip(inline, v, strict=True)]
        return [Unit("\n".join([f"{path}=[", *rows, "]"]), LITERAL)]


def check_encodable(v: object) -> None:
    """Raise Unreadable where encode_value would for a value that was read."""
    todo = [v]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            for k in x:
                key_text(k)
            todo += x.values()
        elif isinstance(x, list):
            todo += x
        elif not _finite(x):
            raise Unreadable(f"non-finite number: {x}")


def encode_value(v: object, profile: str = "canonical", markers: bool = False) -> str:
    """Text of an object. Raises Unreadable for any other root, non-finite numbers and names that can't be written."""
    if not isinstance(v, dict):
        raise Unreadable("an object is required at top level")
    units = Encoder(profile).object_units(v, "")
    if profile == "generation":
        units = sorted(units, key=lambda u: u.rank)
    body = "\n".join(u.text for u in units)
    if not markers:
        return body
    return "\n".join([FRAME_OPEN, *([body] if body else []), FRAME_CLOSE])
