"""The text form's fixed values, and small tests on strings that its rules are made of."""

from __future__ import annotations

import re
from decimal import Decimal

# Fixed values of the text form: they have to be what they are for texts to be read alike.
OPEN, CLOSE = "<<<", ">>>"
FRAME_OPEN, FRAME_CLOSE = "<raif>", "</raif>"
FRAME_OPENERS = ("<raif>", "<|raif_start|>")
FRAME_CLOSERS = ("</raif>", "<|raif_end|>")
SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
TYPES = "sntbo"
FNV_START, FNV_PRIME, FNV_AGAIN = 0x811C9DC5, 0x01000193, 0x9E3779B9
REPAIRS = (
    "markdown_stripped",
    "line_endings_normalized",
    "mode_markers_stripped",
    "missing_close_marker",
    "multiline_braces_flattened",
    "unterminated_array_closed_at_eof",
    "unterminated_block_closed_at_eof",
    "mismatched_nonce_recovered",
    "delimiter_count_repaired",
    "separator_coerced",
    "repeated_keys_indexed",
    "nested_inline_flattened",
    "pathological_key_resolved",
)
TRUNCATION = ("missing_close_marker", "unterminated_block_closed_at_eof", "unterminated_array_closed_at_eof")

#: A character of a line, as the rules' dot means it.
DOT = "[^\\n\\r\\u2028\\u2029]"
_number = re.compile(NUMBER)
_opener_tail = re.compile(r"(?:^|=)(?:<{1,3}[0-9a-fA-F]*|\[)\Z")
_quoted_key = re.compile(r"[.\[\]=:\n\r]")
_quoted_inline_key = re.compile(r"[.\[\]=:,{}]")
_commas = re.compile(r"<<<.*?>>>|<<<|[{},]", re.S)
_separators = re.compile(r"<<<.*?>>>|<<<|[=:]", re.S)


class Unreadable(ValueError):
    """A text or value that the rules refuse."""


def is_number(s: str) -> bool:
    return _number.fullmatch(s) is not None


def is_literal(s: str) -> bool:
    return s in ("true", "false", "null") or is_number(s)


def has_edge_space(s: str) -> bool:
    return s != s.strip(SPACE)


def has_opener_tail(s: str) -> bool:
    return _opener_tail.search(s) is not None


def is_wrapped(s: str) -> bool:
    return len(s) >= len(OPEN) + len(CLOSE) and s.startswith(OPEN) and s.endswith(CLOSE)


def unwrapped(s: str) -> str:
    return s[len(OPEN) : -len(CLOSE)] if is_wrapped(s) else s


def without_cr(line: str) -> str:
    return line.removesuffix("\r")


def first_separator(s: str, wanted: str) -> int:
    """Place of the first character of wanted outside <<<...>>>, or -1."""
    for m in _separators.finditer(s):
        if m[0] == OPEN:
            return -1
        if m[0] in wanted:
            return m.start()
    return -1


def split_cells(s: str) -> list[str]:
    """The parts between commas that stand outside <<<...>>> and {...}."""
    cuts, depth = [-1], 0
    for m in _commas.finditer(s):
        if m[0] == OPEN:
            break
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth = max(0, depth - 1)
        elif m[0] == "," and not depth:
            cuts.append(m.start())
    return [s[a + 1 : b] for a, b in zip(cuts, [*cuts[1:], len(s)], strict=True)]


def key_text(name: str) -> str:
    """A name as it stands in a path: quoted where it could be read otherwise.

    A line feed can't stand in a name, since lines are told apart before names are read.
    """
    if OPEN in name or CLOSE in name:
        raise Unreadable(f"key contains <<< or >>>: {name}")
    if "\n" in name:
        raise Unreadable(f"key contains a line feed: {name!r}")
    return f"{OPEN}{name}{CLOSE}" if not name or _quoted_key.search(name) or has_edge_space(name) else name


def inline_key_text(name: str) -> str:
    return f"{OPEN}{name}{CLOSE}" if _quoted_inline_key.search(name) or has_edge_space(name) else name


def utf8_size(s: str) -> int:
    return len(s.encode())


def utf16_size(s: str) -> int:
    return len(s.encode("utf-16-le")) // 2


def number_text(x: float) -> str:
    """Shortest digits that give the double back; no exponent from 1e-6 to below 1e21."""
    try:
        x = float(x)
    except OverflowError:
        raise Unreadable("non-finite number") from None
    if -1e15 < x < 1e15 and x == int(x):
        return str(int(x))
    if x != x or x in (float("inf"), float("-inf")):
        raise Unreadable(f"non-finite number: {x}")
    sign, figures, exponent = Decimal(repr(x)).as_tuple()
    digits = "".join(map(str, figures)).rstrip("0")
    point = len(figures) + exponent
    if 0 < point <= 21:
        body = digits.ljust(point, "0") if len(digits) <= point else f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + digits
    else:
        tail = f".{digits[1:]}" if len(digits) > 1 else ""
        body = f"{digits[0]}{tail}e{point - 1:+d}"
    return "-" * sign + body


def parse_number(s: str) -> float:
    x = float(s)
    if x in (float("inf"), float("-inf")):
        raise Unreadable(f"number out of double range: {s}")
    return x


def nonce_for(text: str) -> str:
    """Four hexadecimal digits of a hash over UTF-16 units, such that no >>>digits stands in the text."""
    units = text.encode("utf-16-le")
    h = FNV_START
    for at in range(0, len(units), 2):
        h = ((h ^ (units[at] | units[at + 1] << 8)) * FNV_PRIME) & 0xFFFFFFFF
    while f"{CLOSE}{h & 0xFFFF:04x}" in text:
        h = ((h ^ FNV_AGAIN) * FNV_PRIME) & 0xFFFFFFFF
    return f"{h & 0xFFFF:04x}"
