"""The object of a JSON text that was cut off: what it holds up to the cut."""

from __future__ import annotations

import json
import re

from leafwork.functions.wire import NUMBER

_token = re.compile(r'[ \t\r\n]*(?:("(?:[^"\\]|\\.)*")|([{}\[\],:])|([^ \t\r\n{}\[\],:"]+)|(".*))', re.S)
_half_escape = re.compile(r"(?<!\\)((?:\\\\)*)\\(?:u[0-9a-fA-F]{0,3})?\Z")
_number = re.compile(NUMBER)


def completed(text: str) -> str | None:
    """The longest beginning of the text that closing brackets make JSON; None if there is none.

    A string value that is cut keeps what is there of it, a number its digits; a name without a value goes.
    """
    closers, name_next, best, at = [], False, None, 0

    def safe(end: int, more: str = "") -> str:
        return text[:end] + more + "".join(reversed(closers))

    while m := _token.match(text, at):
        whole, mark, bare, cut = m.groups()
        at = m.end()
        if mark in ("{", "["):
            closers.append("}" if mark == "{" else "]")
            name_next, best = mark == "{", safe(at)
        elif mark in ("}", "]"):
            if not closers or closers.pop() != mark:
                return best
            name_next, best = False, safe(at)
        elif mark == ",":
            name_next = bool(closers) and closers[-1] == "}"
        elif mark == ":":
            name_next = False
        elif name_next:
            continue
        elif whole:
            best = safe(at)
        elif cut:
            best = safe(m.start(4), _half_escape.sub(r"\1", cut) + '"')
        elif bare in ("true", "false", "null"):
            best = safe(at)
        elif found := _number.match(bare):
            best = safe(m.start(3), found[0])
        else:
            return best
    return best


def partial_value(text: str, loads=json.loads) -> object:
    """The value of a cut JSON text; {} where nothing can be read."""
    made = completed(text)
    try:
        return {} if made is None else loads(made)
    except ValueError:
        return {}
