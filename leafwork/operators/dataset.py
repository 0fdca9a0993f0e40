"""Preparing training rows: deduplication, selection, deterministic order, splits, prompts, declarations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions import columns
from leafwork.functions.declarations import declaration_text
from leafwork.functions.inference import Declared
from leafwork.functions.wire import Unreadable, key_text
from leafwork.operators.leaves import json_leaves, steps_text, walk
from leafwork.operators.ranges import rank_in_group


def with_canonical_key(df: DataFrame, json: str, name: str = "canonical") -> DataFrame:
    """df with the canonical text of an object: equal for equal objects, whatever their key order."""
    return df.withColumn(name, columns.encode(F.col(json))["text"])


def deduplicated(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row by order of each key; rows without a key are dropped. Of rows that share both one stays.

    One aggregation picks whole rows, so that a key of many rows is combined before it is shuffled.
    """
    first = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*[f"`{c}`" for c in df.columns]), order).alias("__row"))
    return first.select("__row.*")


def _leaf_count(json: Column) -> Column:
    """Leaves of an object, empty containers counted; 0 for what is no JSON."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append(0 if t is None else sum(1 for _ in walk(columns.loads(t))))
            except (Unreadable, ValueError):
                out.append(0)
        return pa.array(out, pa.int64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType="bigint")(json)


def selected(df: DataFrame, json: str, order: str, least_leaves: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one row of counters): empty objects, small ones and copies are dropped, and counted apart.

    Leaves are counted row by row, so rows may repeat an order.
    """
    rows = with_canonical_key(df, json).withColumn("leaves", _leaf_count(F.col(json)))
    empty = F.coalesce(F.col("canonical") == "", F.lit(True))
    small = ~empty & (F.col("leaves") < least_leaves)
    good = ~empty & ~small
    kept = deduplicated(rows.where(good), "canonical", order)
    # counted by canonical text first, so that no group of all distinct texts is made
    each = rows.select(empty.alias("empty"), small.alias("small"), F.when(good, F.xxhash64("canonical")).alias("h1"), F.when(good, F.xxhash64(F.lit(1), "canonical")).alias("h2"))
    each = each.groupBy("empty", "small", "h1", "h2").agg(F.count("*").alias("n"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    counted = each.agg(total(F.col("n")).alias("rows"), total(F.when(F.col("empty"), F.col("n"))).alias("empty"), total(F.when(F.col("small"), F.col("n"))).alias("small"), F.count_if(F.col("h1").isNotNull()).alias("kept"))
    return kept, counted.withColumn("copies", F.col("rows") - F.col("empty") - F.col("small") - F.col("kept"))


def round_tripping(df: DataFrame, json: str, *order: str, limit: int | None = None) -> DataFrame:
    """Rows whose object is read back from its text as it was, without a repair; with limit, the first so many by order."""
    found = df.where(columns.round_trip(F.col(json))["same"])
    return found if limit is None else found.orderBy(*order).limit(limit)


def hash_order(*keys: str, seed: int = 0) -> Column:
    """Sort key of a shuffle that is the same for the same keys and seed, on any cluster."""
    return F.xxhash64(F.lit(seed), *keys)


def shuffled(df: DataFrame, *keys: str, seed: int = 0, limit: int | None = None) -> DataFrame:
    rows = df.orderBy(hash_order(*keys, seed=seed), *keys)
    return rows if limit is None else rows.limit(limit)


def sampled(df: DataFrame, share: float, *keys: str, seed: int = 0) -> DataFrame:
    """The rows whose hash falls into the share; a row's fate hangs on its keys alone."""
    return df.where(F.pmod(hash_order(*keys, seed=seed), F.lit(1_000_000)) < int(share * 1_000_000))


def picked(options: list[str], *keys: str, seed: int = 0) -> Column:
    """One of a few options by the hash of keys."""
    values = F.array(*[F.lit(x) for x in options])
    return F.get(values, F.pmod(hash_order(*keys, seed=seed), F.lit(len(options))).cast("int"))


def whole_number(low: int, high: int, *keys: str, seed: int = 0) -> Column:
    """A whole number from low to high by the hash of keys."""
    return (F.pmod(hash_order(*keys, seed=seed), F.lit(high - low + 1)) + low).cast("long")


def picked_many(options: list[str], n: int, *keys: str, seed: int = 0) -> Column:
    """n different ones of a few options by the hash of keys, in an order of its own."""
    ranked = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(i), *keys).alias("h"), F.lit(x).alias("x")) for i, x in enumerate(options)])
    return F.transform(F.slice(F.array_sort(ranked), 1, n), lambda r: r["x"])


def union_of_splits(*splits: DataFrame) -> DataFrame:
    """Rows of all splits, columns by name; one that a split lacks is null there."""
    out = splits[0]
    for s in splits[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def stratified_split(df: DataFrame, stratum: str, order: str, share: float, isolated: list[str] = ()) -> DataFrame:
    """df with split: of n rows of a stratum ceil(share n) evenly spaced ones are eval, the rest train.

    Strata in isolated are holdout as a whole. The j-th of c eval rows is row
    floor(j n / c), so row r is one of them if floor((r + 1) c / n) stands
    before ceil(r c / n), which each row finds from its own rank.
    """
    counts = df.groupBy(stratum).agg(F.count("*").alias("__n")).withColumnRenamed(stratum, "__stratum")
    rows = rank_in_group(df, stratum, order, "__r")
    rows = rows.join(counts, F.col(stratum).eqNullSafe(F.col("__stratum")))
    c = F.ceil(F.lit(share) * F.col("__n")).cast("long")
    j = F.ceil(F.col("__r") * c / F.col("__n")).cast("long")
    chosen = (j < c) & (F.floor(j * F.col("__n") / c) == F.col("__r"))
    split = F.when(F.col(stratum).isin(list(isolated)), "holdout").when(chosen, "eval").otherwise("train")
    return rows.withColumn("split", split).drop("__n", "__r", "__stratum")


def render_prompt(task: Column, text: Column, schema: Column | None = None) -> Column:
    """Task, declaration block where there is one, and source, as the prompt of an example."""
    block = F.lit(None).cast("string") if schema is None else F.concat(F.lit("<schema>\n"), schema, F.lit("\n</schema>"))
    return F.concat_ws("\n\n", task, block, text)


def trial_prompt(json: Column, form: Column | str, example: str | None = None) -> Column:
    """The prompt that asks a model to write an object again in a form, with an example where one is given."""
    form = F.lit(form) if isinstance(form, str) else form
    shown = F.lit(None).cast("string") if example is None else F.lit(f"For example:\n{example}")
    return F.concat_ws("\n\n", F.concat(F.lit("Write this object as "), form, F.lit(".")), shown, json)


def _listed(text: str) -> str:
    lines = []
    for steps, v in walk(columns.loads(text)):
        shown = v if isinstance(v, str) else columns.dumps(v)
        lines.append(f"- {steps_text(steps)} is {shown}")
    return "\n".join(lines)


def instructions(json: Column | str) -> Column:
    """The leaves of an object, listed in plain words, as a task of its own to write it from; null for what is no JSON."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append(None if t is None else _listed(t))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType="string")(json)


def training_rows(df: DataFrame, json: str, key: str, tasks: list[str], seed: int = 0, instruct: float = 0.0, schema: Column | None = None, with_schema: float = 0.0) -> DataFrame:
    """(key, messages, meta): a user message, and the object's text in the generation profile as answer.

    By hash of the key a share of rows (instruct) is asked in plain words and the
    rest by a task picked of tasks; a share (with_schema) shows the declaration too.
    """
    share = lambda x, salt: F.pmod(hash_order(key, seed=seed + salt), F.lit(1_000_000)) < int(x * 1_000_000)
    plain, shown = share(instruct, 1), share(with_schema, 2) & F.lit(schema is not None)
    task = F.when(plain, F.lit("Write an object from this:")).otherwise(picked(tasks, key, seed=seed))
    source = F.when(plain, instructions(json)).otherwise(F.col(json)) if instruct else F.col(json)
    prompt = render_prompt(task, source, F.when(shown, schema) if schema is not None else None)
    answer = columns.encode(F.col(json), "generation")["text"]
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    meta = F.struct(F.when(plain, "instruct").otherwise("translate").alias("task"), shown.alias("has_schema"))
    return df.select(key, F.array(message("user", prompt), message("assistant", answer)).alias("messages"), meta.alias("meta"))


def shape_stats(df: DataFrame, *groups: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.count("*").alias("rows"))


SCALAR_CODES = {"string": "s", "text": "t", "number": "n", "boolean": "b"}
FIELD = "path string, code string, optional boolean"


def _tag(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, str):
        return "text" if "\n" in v else "string"
    if isinstance(v, (dict, list)):
        return "object" if isinstance(v, dict) else "array" if v else "empty"
    return "number"


def _profile(value: object, counts: Counter) -> None:
    """Count the values of each tag at each path, whose elements all read as []."""
    todo = [("", value)]
    while todo:
        path, v = todo.pop()
        counts[path, _tag(v)] += 1
        if isinstance(v, dict):
            todo += [(f"{path}.{key_text(k)}" if path else key_text(k), x) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(f"{path}[]", x) for x in v]


class _Seen:
    """A place of the profile: how often each tag stands there, and what is below."""

    def __init__(self) -> None:
        self.tags: Counter = Counter()
        self.members: dict[str, _Seen] = {}
        self.element: _Seen | None = None

    @property
    def kinds(self) -> set[str]:
        return set(self.tags) - {"null"}

    @property
    def total(self) -> int:
        return sum(self.tags.values())

    @property
    def torn(self) -> bool:
        """Strings beside values of other types: only the texts' own tags tell them apart, and those hold below open places."""
        return bool(self.kinds & {"string", "text"}) and bool(self.kinds - {"string", "text"})

    def code(self) -> str:
        codes = {SCALAR_CODES.get(k, "o") for k in self.kinds}
        return "s" if not codes else codes.pop() if len(codes) == 1 else "t" if codes == {"s", "t"} else "o"

    def fields(self, path: str, parents: int) -> list[tuple[str, str, bool]]:
        """What is declared for a member of parents objects."""
        optional = self.total < parents or bool(self.tags["null"])
        if optional or not self.kinds <= {"object"} and not self.kinds <= {"array", "empty"}:
            return [(path, self.code(), optional)]
        if self.kinds <= {"object"}:
            return self.inside(path) or [(path, "o", False)]
        e = self.element
        if e is None:
            return [(f"{path}[]", "s", True)]
        if e.tags["null"] or e.torn or e.kinds & {"array", "empty"}:
            return [(path, "o", False)]
        return [(f"{path}[]", e.code(), False), *(e.inside(f"{path}[]") if e.kinds == {"object"} else [])]

    def inside(self, path: str) -> list[tuple[str, str, bool]]:
        """What is declared for the members of this place's objects; nothing if the place has to stay open."""
        if path and any(m.torn for m in self.members.values()):
            return []
        return [f for k in sorted(self.members) for f in self.members[k].fields(f"{path}.{k}" if path else k, self.tags["object"])]


def declared_fields(profile: list[tuple[str, str, int]]) -> list[tuple[str, str, bool]]:
    """(path, code, optional) of a declaration for values of a profile (path, tag, n).

    A field is optional if it is missing from some object it could stand in, or is null somewhere; an optional
    container is open, and so is a place of values of several types. Where strings stand beside
    other types the object or array around is open, so that the texts' own tags hold; a field of
    the document itself has nothing around it, and strings there that read as something else don't stay strings.
    """
    root = _Seen()
    for path, tag, n in profile:
        place = root
        for step in re.findall(r"<<<.*?>>>|\[\]|[^.\[\]]+", path, re.S):
            if step == "[]":
                place.element = place.element or _Seen()
                place = place.element
            else:
                place = place.members.setdefault(step, _Seen())
        place.tags[tag] += n
    return root.inside("")


def _profiles(df: DataFrame, json: str, groups: list[str]) -> DataFrame:
    """(groups, path, tag, n): each batch is counted before it is shuffled."""
    kinds = "".join(f"`{g}` {df.schema[g].dataType.simpleString()}, " for g in groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[tuple, Counter] = {}
            for i, text in enumerate(b.column(len(groups)).to_pylist()):
                try:
                    value = None if text is None else columns.loads(text)
                except (Unreadable, ValueError):
                    continue
                if isinstance(value, dict):
                    own = tuple(b.column(k)[i].as_py() for k in range(len(groups)))
                    counts = by.get(own)
                    if counts is None:
                        counts = by[own] = Counter()
                    _profile(value, counts)
            rows = [(*own, *key, n) for own, counts in by.items() for key, n in counts.items()]
            types = [*(b.schema.field(k).type for k in range(len(groups))), pa.string(), pa.string(), pa.int64()]
            names = [*groups, "path", "tag", "n"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    found = df.select(*groups, json).mapInArrow(run, f"{kinds}path string, tag string, n long")
    return found.groupBy(*groups, "path", "tag").agg(F.sum("n").alias("n"))


def inferred_fields(df: DataFrame, json: str, *groups: str) -> DataFrame:
    """(groups, fields array of (path, code, optional)): a declaration that all objects of a group are read back by.

    See declared_fields. What is no JSON object is passed over; an empty table gives no row. A group's
    distinct paths and types meet in one row, not its documents.
    """
    profile = _profiles(df, json, list(groups)).groupBy(*groups).agg(F.collect_list(F.struct("path", "tag", "n")).alias("profile"))
    kind = pa.list_(pa.struct([("path", pa.string()), ("code", pa.string()), ("optional", pa.bool_())]))

    def run(profiles: pa.Array) -> pa.Array:
        out = []
        for rows in profiles.to_pylist():
            found = declared_fields([(r["path"], r["tag"], r["n"]) for r in rows])
            out.append([dict(zip(("path", "code", "optional"), f, strict=True)) for f in found])
        return pa.array(out, kind)

    run.__annotations__ = {"profiles": pa.Array, "return": pa.Array}
    return profile.select(*groups, F.arrow_udf(run, returnType=f"array<struct<{FIELD.replace(' string', ':string').replace(' boolean', ':boolean')}>>")("profile").alias("fields"))


def declarations(df: DataFrame, json: str, *groups: str) -> DataFrame:
    """(groups, declaration): inferred_fields as the text that decode takes."""
    line = lambda f: F.concat(f["path"], F.lit(":"), f["code"], F.when(f["optional"], F.lit("?")).otherwise(F.lit("")))
    return inferred_fields(df, json, *groups).select(*groups, F.array_join(F.transform("fields", line), "\n").alias("declaration"))


def infer_declaration(df: DataFrame, json: str) -> str:
    """The declaration text of all rows."""
    row = declarations(df, json).first()
    return row["declaration"] if row else ""


def declared_text(place: Declared) -> str:
    return declaration_text(place)
