"""Text to objects: surface repairs, a scan of the lines, and assembly on a tree of places."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field

from leafwork.functions.declarations import as_declared
from leafwork.functions.encoding import check_encodable, encode_value
from leafwork.functions.inference import OPEN_PLACE, Declared, Reader
from leafwork.functions.wire import (
    CLOSE,
    DOT,
    FRAME_CLOSERS,
    FRAME_OPENERS,
    OPEN,
    SPACE,
    TRUNCATION,
    Unreadable,
    first_separator,
    is_number,
    parse_number,
    split_cells,
    unwrapped,
    without_cr,
)

_ws = f"[{SPACE}]*"
_fence = re.compile(rf"{_ws}```[a-zA-Z]*\n(.*?)\n```{_ws}", re.S)
_frame_open = re.compile(rf"{_ws}(?:{'|'.join(map(re.escape, FRAME_OPENERS))})(?:\n|\Z)")
_frame_close = re.compile(rf"(?:\A|\n)(?:{'|'.join(map(re.escape, FRAME_CLOSERS))}){_ws}\Z")
_brace_tail = re.compile(rf"=\{{{_ws}(?=[\n\r\u2028\u2029]|\Z)")
_opens_braces = re.compile(rf"({DOT}+)=\{{")
_opens_array = re.compile(rf"({DOT}+)=\[")
_opens_block = re.compile(rf"({DOT}*?)=<<<([0-9a-fA-F]*)")
_opens_loosely = re.compile(rf"({DOT}*?)=(<{{1,2}})([0-9a-fA-F]*)")
_closes = re.compile(r"(>{1,3})([0-9a-fA-F]*)")
_like_a_leaf = re.compile(r"[^=:]*(?:=|::|:[sntb]=)")
_tagged = re.compile(r"([sntb])=(.*)", re.S)
_indexed = re.compile(rf"({DOT}+)\[([0-9]+)\]")
_index = re.compile(r"0|[1-9][0-9]*")


@dataclass
class Result:
    """value: the object; canonical: its text, of strict reading; error: why strict reading failed."""

    value: dict | None = None
    canonical: str | None = None
    error: str | None = None
    errors: list[dict] = field(default_factory=list)
    repairs: list[tuple[str, str | None]] = field(default_factory=list)

    @property
    def truncated(self) -> bool:
        return any(kind in TRUNCATION for kind, _ in self.repairs)


@dataclass
class Leaf:
    key: str
    kind: str  # bare, tagged, block, header, row or literal
    body: object
    tag: str = ""


class Document:
    """One text on its way to an object. lenient: what can't be read is noted, not raised."""

    def __init__(self, text: str, lenient: bool) -> None:
        self.repairs: list[tuple[str, str | None]] = []
        self.errors: list[dict] = []
        self.lenient = lenient
        self.lines = self._prepared(text).split("\n")
        self.columns: dict[str, list[str]] = {}
        self.cr_noted = False
        # closers by line, so that no search runs over the lines again
        self.closers: list[tuple[int, int, str]] = []
        for at, line in enumerate(self.lines):
            if line.startswith(">") and (m := _closes.fullmatch(without_cr(line))):
                self.closers.append((at, len(m[1]), m[2]))
        self.closer_lines = [c[0] for c in self.closers]
        self.by_nonce: dict[tuple[str, bool], list[int]] = defaultdict(list)
        for k, (_, count, nonce) in enumerate(self.closers):
            self.by_nonce[nonce, False].append(k)
            if count == 3:
                self.by_nonce[nonce, True].append(k)
        self.full_closers = [k for k, c in enumerate(self.closers) if c[1] == 3]

    def note(self, kind: str, detail: str | None = None) -> None:
        self.repairs.append((kind, detail))

    def fail(self, error: Unreadable, line: int | None = None, key: str | None = None) -> None:
        if not self.lenient:
            raise error
        self.errors.append({"line": line, "key": key, "error": str(error)})

    # surface

    def _prepared(self, text: str) -> str:
        if (m := _fence.fullmatch(text)) is not None:
            self.note("markdown_stripped")
            text = m[1]
        lines = text.split("\n")
        if len(lines) > 1 and all(x.endswith("\r") for x in lines[:-1]):
            self.note("line_endings_normalized")
            text = "\n".join(map(without_cr, lines))
        opened, closed = _frame_open.match(text), _frame_close.search(text)
        if opened or closed:
            self.note("mode_markers_stripped")
            if not closed:
                self.note("missing_close_marker")
            text = _frame_close.sub("", text[opened.end() :] if opened else text)
        text = text.strip(SPACE)
        return self._without_braces(text) if _brace_tail.search(text) else text

    def _without_braces(self, text: str) -> str:
        """Lines k={ ... } as dotted paths. One pass matches the braces, a second writes the lines."""
        lines = text.split("\n")
        bare = [without_cr(x).strip(SPACE) for x in lines]
        closing: dict[str, list[int]] = defaultdict(list)
        for at, line in enumerate(lines):
            if line.startswith(CLOSE):
                closing[without_cr(line)].append(at)
        role, partner, waiting, depth, at = ["line"] * len(lines), {}, [], 0, 0
        while at < len(lines):
            s = bare[at]
            if depth:
                role[at] = "content"
                depth += 1 if _opens_array.fullmatch(s) else -1 if s == "]" else 0
            elif m := _opens_block.fullmatch(s):
                ends = closing[CLOSE + m[2]]
                k = bisect_right(ends, at)
                stop = ends[k] if k < len(ends) else len(lines) - 1
                role[at + 1 : stop + 1] = ["content"] * (stop - at)
                at = stop
            elif _opens_braces.fullmatch(s):
                waiting.append(at)
            elif _opens_array.fullmatch(s):
                depth = 1
            elif s == "}" and waiting:
                partner[waiting.pop()] = at
                role[at] = "close"
            at += 1
        if not partner:
            return text
        self.note("multiline_braces_flattened")
        out, path = [], [""]
        for at, line in enumerate(lines):
            if role[at] == "close":
                path.pop()
            elif at in partner:
                name = _opens_braces.fullmatch(bare[at])[1].strip(SPACE)
                path.append(f"{path[-1]}.{name}" if path[-1] else name)
            elif role[at] == "content" or not path[-1] or not bare[at]:
                out.append(line)
            else:
                out.append(f"{path[-1]}.{bare[at]}")
        return "\n".join(out)

    # lines to leaves

    def structural(self, at: int) -> str:
        line = self.lines[at]
        if line.endswith("\r") and not self.cr_noted:
            self.cr_noted = True
            self.note("line_endings_normalized")
        return without_cr(line)

    def leaves(self) -> list[Leaf]:
        out: list[Leaf] = []
        at = 0
        while at < len(self.lines):
            line = self.structural(at)
            if not line.strip(SPACE):
                at += 1
            elif m := _opens_array.fullmatch(line):
                at = self._literal(m[1], at, out)
            elif m := _opens_block.fullmatch(line):
                at = self._block(m[1], m[2], at, out)
            elif (m := _opens_loosely.fullmatch(line)) and (after := self._loose_block(m, at, out)):
                at = after
            else:
                try:
                    out.append(self._single(line, at + 1))
                except Unreadable as e:
                    self.fail(e, line=at + 1)
                at += 1
        return out

    def _literal(self, key: str, at: int, out: list[Leaf]) -> int:
        rows = []
        for j in range(at + 1, len(self.lines)):
            row = self.structural(j)
            if row == "]":
                out.append(Leaf(key, "literal", rows))
                return j + 1
            if row.strip(SPACE):
                rows.append(row)
        self.note("unterminated_array_closed_at_eof", f"key '{key}'")
        out.append(Leaf(key, "literal", rows))
        return len(self.lines)

    def _next(self, ranks: list[int], at: int) -> int | None:
        """Of closers given by rank, the first after line at."""
        k = bisect_right(ranks, bisect_right(self.closer_lines, at) - 1)
        return ranks[k] if k < len(ranks) else None

    def _content(self, key: str, at: int, end: int, out: list[Leaf]) -> int:
        out.append(Leaf(key, "block", "\n".join(self.lines[at + 1 : end])))
        return end + 1

    def _block(self, key: str, nonce: str, at: int, out: list[Leaf]) -> int:
        exact = self._next(self.by_nonce[nonce, True], at)
        if exact is not None:
            end = self.closer_lines[exact]
            self.structural(end)
            return self._content(key, at, end, out)
        rest = self.full_closers[bisect_right(self.full_closers, bisect_right(self.closer_lines, at) - 1) :]
        same = [k for k in rest if len(self.closers[k][2]) == len(nonce)] if nonce else []
        near = rest if len(rest) == 1 else same
        if len(near) == 1:
            self.note("mismatched_nonce_recovered", f"nonce {nonce}")
            return self._content(key, at, self.closer_lines[near[0]], out)
        short = self._next(self.by_nonce[nonce, False], at)
        if short is not None:
            self.note("delimiter_count_repaired", f"opener=<×3 closer=>×{self.closers[short][1]}")
            return self._content(key, at, self.closer_lines[short], out)
        if not rest:
            self.note("unterminated_block_closed_at_eof", f"key '{key}'")
            return self._content(key, at, len(self.lines), out)
        self.fail(Unreadable(f"line {at + 1}: any of {len(rest)} lines could close this block"), at + 1, key)
        return at + 1

    def _loose_block(self, m: re.Match, at: int, out: list[Leaf]) -> int | None:
        found = self._next(self.by_nonce[m[3], False], at)
        if found is None:
            return None
        end = self.closer_lines[found]
        between = self.lines[at + 1 : end]
        if between and all(_like_a_leaf.match(x) for x in between):
            return None
        self.note("delimiter_count_repaired", f"opener=<×{len(m[2])} closer=>×{self.closers[found][1]}")
        return self._content(m[1], at, end, out)

    def _single(self, line: str, number: int) -> Leaf:
        at = first_separator(line, "=:")
        if at < 0:
            raise Unreadable(f"line {number} has no = or : behind a name: {line}")
        key, rest = line[:at], line[at + 1 :]
        if line[at] == ":":
            if rest.startswith(":"):
                self.columns[key] = split_cells(rest[1:])
                return Leaf(key, "header", self.columns[key])
            if m := _tagged.fullmatch(rest):
                return Leaf(key, "tagged", m[2], m[1])
            self.note("separator_coerced", f"':' → '=' at line {number}")
        m = _indexed.fullmatch(key)
        if m and m[1] in self.columns:
            return Leaf(key, "row", split_cells(rest))
        return Leaf(key, "bare", rest)

    # leaves to places

    def with_indexes(self, leaves: list[Leaf]) -> list[Leaf]:
        """Keys that repeat get indexes, unless they stand indexed or as a header too."""
        plain = [x.key for x in leaves if x.kind != "header"]
        taken = {m[1] for k in plain if (m := _indexed.fullmatch(k))} | {x.key for x in leaves if x.kind == "header"}
        repeated = {k for k, n in Counter(plain).items() if n > 1} - taken
        if not repeated:
            return leaves
        self.note("repeated_keys_indexed", ",".join(sorted(repeated, key=lambda k: k.encode("utf-16-be", "surrogatepass"))))
        seen: Counter = Counter()
        out = []
        for x in leaves:
            if x.key in repeated:
                x, n = Leaf(f"{x.key}[{seen[x.key]}]", x.kind, x.body, x.tag), x.key
                seen[n] += 1
            out.append(x)
        return out

    def located(self, key: str, schema: Declared | None) -> tuple[list[str | int], Declared | None]:
        steps = path_steps(key)
        if schema is None:
            return steps, None
        place: Declared | None = schema
        for step in steps:
            place = place and (place.at_index() if isinstance(step, int) else place.below(step))
        if place is not None:
            return steps, place
        if len(steps) > 1 and key in schema.fields:
            self.note("pathological_key_resolved", key)
            return [key], schema.fields[key]
        raise Unreadable(f"'{key}' is not declared")

    def read(self, leaf: Leaf, schema: Declared | None, headers: dict[str, list[str]]) -> tuple[list[str | int], object]:
        reader = Reader(self.repairs)
        if leaf.kind == "row":
            prefix = _indexed.fullmatch(leaf.key)[1]
            if prefix not in headers:
                raise Unreadable(f"a row of {prefix}, whose columns are not named")
            names, cells = headers[prefix], leaf.body
            if len(names) != len(cells):
                raise Unreadable(f"{leaf.key}: {len(cells)} cells for {len(names)} columns")
        steps, place = self.located(leaf.key, schema)
        known = place is not None and place is not OPEN_PLACE
        if leaf.kind == "literal":
            if known and not place.element and place.code != "o":
                raise Unreadable(f"'{leaf.key}' holds rows but is declared as {place.kind}")
            inner = None if place is None else OPEN_PLACE if place is OPEN_PLACE or place.code == "o" else place.element
            return steps, [reader.value(row, inner) for row in leaf.body]
        if leaf.kind == "row":
            row = {}
            for name, cell in zip(names, cells, strict=True):
                inner = None if place is None else place.below(name)
                if known and inner is None:
                    raise Unreadable(f"'{leaf.key}': column {name} is not declared")
                row[name] = reader.value(cell, inner)
            return steps, row
        if leaf.kind == "block":
            if known and place.code not in ("s", "t", "o"):
                raise Unreadable(f"'{leaf.key}' holds lines of text but is declared as {place.kind}")
            return steps, leaf.body
        if leaf.kind == "bare":
            return steps, reader.value(leaf.body, place)
        if known:
            return steps, reader.declared(leaf.body, place)
        return steps, _by_tag(leaf.tag, leaf.body)

    def assembled(self, schema: Declared | None) -> dict:
        root, headers = Place("object"), {}
        for leaf in self.with_indexes(self.leaves()):
            if leaf.kind == "header":
                headers[leaf.key] = leaf.body
                continue
            try:
                steps, value = self.read(leaf, schema, headers)
                root.put(steps, value)
            except Unreadable as e:
                self.fail(e, key=leaf.key)
        root.settle_gaps(self)
        value = root.value()
        if schema is not None:
            missing = list(missing_fields(schema, value))
            if missing and not self.lenient:
                raise Unreadable(f"declared, but not there: {' '.join(missing)}")
            self.errors += [{"line": None, "key": k, "error": "declared, but not there"} for k in missing]
        return value


def _by_tag(tag: str, raw: str):
    if tag == "n":
        if not is_number(raw):
            raise Unreadable(f"tagged as a number: {raw}")
        return parse_number(raw)
    if tag == "b":
        if raw not in ("true", "false"):
            raise Unreadable(f"tagged as a boolean: {raw}")
        return raw == "true"
    return unwrapped(raw)


class Place:
    """A container while it is filled: members by name, or by index in any order."""

    __slots__ = ("kind", "members")

    def __init__(self, kind: str) -> None:
        self.kind, self.members = kind, {}

    @staticmethod
    def of(value: object):
        """Containers of a value as places, so that later leaves can add to them."""
        if isinstance(value, dict):
            out = Place("object")
            out.members = {k: Place.of(v) for k, v in value.items()}
            return out
        if isinstance(value, list):
            out = Place("array")
            out.members = {i: Place.of(v) for i, v in enumerate(value)}
            return out
        return value

    def put(self, steps: list[str | int], value: object) -> None:
        here = self
        for n, step in enumerate(steps):
            if (here.kind == "array") != isinstance(step, int):
                raise Unreadable(f"{step!r} can't be a member of an {here.kind}")
            named = f"index {step}" if isinstance(step, int) else f"'{step}'"
            if n + 1 == len(steps):
                if step in here.members:
                    raise Unreadable(f"{named} has a value already")
                here.members[step] = Place.of(value)
                return
            wanted = "array" if isinstance(steps[n + 1], int) else "object"
            below = here.members.setdefault(step, Place(wanted))
            if not isinstance(below, Place) or below.kind != wanted:
                raise Unreadable(f"{named} is no {wanted}")
            here = below

    def first_gap(self) -> int | None:
        """The least index that is missing, found from the count alone where none is."""
        if self.kind == "object" or not self.members or max(self.members) + 1 == len(self.members):
            return None
        return next(i for i in range(len(self.members) + 1) if i not in self.members)

    def below(self):
        """(path text, place) of this place and all containers under it, outermost first."""
        todo = [("", self)]
        while todo:
            path, place = todo.pop()
            yield path, place
            for k, v in place.members.items():
                if isinstance(v, Place):
                    todo.append((f"{path}[{k}]" if place.kind == "array" else f"{path}.{k}" if path else k, v))

    def settle_gaps(self, document: Document) -> None:
        """A gap in an array fails a strict reading; a lenient one drops the array below the nearest object."""
        todo = [("", self)]
        while todo:
            path, place = todo.pop()
            for name, member in list(place.members.items()):
                if not isinstance(member, Place):
                    continue
                at = f"{path}.{name}" if path else name
                if member.kind == "object":
                    todo.append((at, member))
                    continue
                for inner, p in member.below():
                    if (gap := p.first_gap()) is not None:
                        if not document.lenient:
                            raise Unreadable(f"{at}{inner} has no element {gap}")
                        del place.members[name]
                        document.fail(Unreadable(f"'{at}' lacks elements and is left out"), key=at)
                        break

    def value(self):
        inner = {k: v.value() if isinstance(v, Place) else v for k, v in self.members.items()}
        return inner if self.kind == "object" else [inner[i] for i in range(len(inner))]


def path_steps(key: str) -> list[str | int]:
    """Names and indexes of a path: a.b[0].<<<c.d>>>."""
    steps: list[str | int] = []
    at = 0
    while at < len(key):
        if key.startswith(OPEN, at):
            end = key.find(CLOSE, at + len(OPEN))
            if end < 0:
                raise Unreadable(f"{OPEN} without {CLOSE}: {key}")
            steps.append(key[at + len(OPEN) : end])
            at = end + len(CLOSE)
        elif key[at] == "[":
            end = key.find("]", at)
            if end < 0:
                raise Unreadable(f"[ without ]: {key}")
            if not _index.fullmatch(key, at + 1, end):
                raise Unreadable(f"[{key[at + 1 : end]}] is no index: {key}")
            steps.append(int(key[at + 1 : end]) if end - at < 20 else 10**18)
            at = end + 1
        else:
            end = min((p for p in (key.find(".", at), key.find("[", at)) if p >= 0), default=len(key))
            if end == at:
                raise Unreadable(f"a name is empty: {key}")
            steps.append(key[at:end])
            at = end
        if key.startswith(".", at):
            at += 1
            if at == len(key):
                raise Unreadable(f"nothing behind the last dot: {key}")
        elif at < len(key) and key[at] != "[":
            raise Unreadable(f"a dot or an index is wanted at {at}: {key}")
    if not steps:
        raise Unreadable("no name at all")
    return steps


def missing_fields(place: Declared, value: object, path: str = ""):
    """Paths of declared fields that aren't optional and aren't there; nothing is asked below null."""
    if value is None or place is OPEN_PLACE:
        return
    if isinstance(value, dict):
        for name, member in place.fields.items():
            at = f"{path}.{name}" if path else name
            if name in value:
                yield from missing_fields(member, value[name], at)
            elif not member.optional:
                yield at
    elif isinstance(value, list) and place.element:
        for i, v in enumerate(value):
            yield from missing_fields(place.element, v, f"{path}[{i}]")


def decode_text(text: str, schema: str | Declared | None = None) -> Result:
    """Strict reading: the object and its canonical text, or an error; the repairs either way."""
    return read_strictly(text, as_declared(schema))


def read_strictly(text: str, declared: Declared | None, canonical: bool = True) -> Result:
    """decode_text by a parsed declaration. canonical: False leaves the canonical text out; what it would refuse is refused."""
    document = None
    try:
        document = Document(text, lenient=False)
        value = document.assembled(declared)
        if not canonical:
            check_encodable(value)
        return Result(value, encode_value(value) if canonical else None, repairs=document.repairs)
    except (Unreadable, RecursionError) as e:
        return Result(error=str(e) or "nested too deeply", repairs=document.repairs if document else [])


def decode_lenient_text(text: str, schema: str | Declared | None = None) -> Result:
    """Lenient reading: whatever leaves can be read, and an error for each that can't."""
    declared = as_declared(schema)
    document = Document(text, lenient=True)
    try:
        value = document.assembled(declared)
    except RecursionError:
        return Result({}, errors=[{"line": None, "key": None, "error": "nested too deeply"}], repairs=document.repairs)
    return Result(value, errors=document.errors, repairs=document.repairs)


def validate_text(text: str, schema: str | Declared | None = None) -> list[str]:
    """Why a text isn't canonical; empty if it is."""
    found = decode_text(text, schema)
    if found.error is not None:
        return [found.error]
    if found.repairs:
        return [f"{len(found.repairs)} repairs were made"]
    return [] if found.canonical == text else ["the canonical text is another one"]
