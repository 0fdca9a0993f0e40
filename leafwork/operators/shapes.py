"""Generated objects of named shapes, for tests and training rows: one seed always gives one object."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions.columns import dumps

WORDS = "amber basin cedar delta ember flint grove harbor island juniper kettle lantern meadow north orchard pebble quarry river summit thistle".split()
ODD = ["true", "null", "007", "1e5", "[]", "{}", " padded ", "<<<", ">>>", "a=[", "{k=v}", "é😀", "", "x,y", "k:v", "=", "<<<w>>>", "1.50"]
KEYS = ["id", "name", "state", "count", "owner", "kind", "note", "score"]
ODD_KEYS = ["a.b", "x[0]", " lead", "k=v", "p:q", "", "d,e", "{z}"]


class Draw:
    """Values drawn for one object. odd: strings and keys that need protection turn up."""

    def __init__(self, seed: int, odd: bool) -> None:
        self.rng, self.odd = random.Random(seed), odd

    def word(self) -> str:
        return self.rng.choice(ODD) if self.odd and self.rng.random() < 0.3 else self.rng.choice(WORDS)

    def phrase(self, n: int = 6) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(2, n)))

    def text(self) -> str:
        return "\n".join([self.phrase(9) for _ in range(self.rng.randint(2, 5))] + ([">>>"] if self.odd else []))

    def number(self) -> float:
        return float(self.rng.choice([self.rng.randint(-9, 10**6), round(self.rng.random() * 1000, 2), 1e21, 1e-7]) if self.odd else self.rng.randint(0, 9999))

    def scalar(self):
        return self.rng.choice([self.word, self.number, lambda: self.rng.random() < 0.5, lambda: None])()

    def keys(self, n: int) -> list[str]:
        pool = KEYS + (ODD_KEYS if self.odd else [])
        return self.rng.sample(pool, min(n, len(pool)))

    def flat(self, n: int = 4) -> dict:
        return {k: self.scalar() for k in self.keys(n)}

    def rows(self, n: int, width: int = 3) -> list[dict]:
        names = self.keys(width)
        return [{k: self.scalar() for k in names} for _ in range(n)]

    def nested(self, depth: int) -> dict:
        return {self.keys(1)[0]: self.nested(depth - 1)} if depth else self.flat(1)


SHAPES: dict[str, Callable[[Draw], dict]] = {
    "short_tool_call": lambda d: {"to": d.word(), "subject": d.phrase(), "body": d.phrase(10)},
    "scalars_mixed": lambda d: {k: d.scalar() for k in KEYS},
    "nested_object": lambda d: {"user": d.flat(3), "tracking": d.word()},
    "array_of_objects": lambda d: {"items": d.rows(3)},
    "text_with_specials": lambda d: {"title": f'"{d.word()}", {{x=1', "query": f"a=b & c={d.word()}", "slug": f"{d.word()}:{d.word()}", "mark": "é😀"},
    "multiline_body": lambda d: {"to": d.word(), "body": d.text()},
    "null_and_empties": lambda d: {"at": None, "list": [], "meta": {}, "tags": [d.word()]},
    "pathological_keys": lambda d: {k: d.scalar() for k in d.rng.sample(ODD_KEYS, 4)},
    "numeric_string_ambiguity": lambda d: {"zip": f"0{d.rng.randint(0, 9999)}", "version": "1.0", "number": d.number(), "flag": True, "text": "true"},
    "deep_nesting": lambda d: {"a": d.nested(d.rng.randint(3, 6))},
    "json_heavy": lambda d: {"status": d.word(), "data": {"user": d.flat(3), "posts": d.rows(2), "meta": {"tags": [d.word(), d.word()]}}},
    "large_table": lambda d: {"orders": d.rows(d.rng.randint(8, 14), 4)},
    "heterogeneous_array": lambda d: {"mixed": [d.scalar() for _ in range(4)] + [d.flat(2)]},
    "literal_strings": lambda d: {f"s{i}": s for i, s in enumerate(ODD[:8])},
    "wide_heterogeneous_array": lambda d: {"events": [d.flat(d.rng.randint(1, 5)) for _ in range(5)]},
    "flat_inline_object": lambda d: {"response": d.flat(5)},
    "deep_array_literal": lambda d: {"data": {"session": {"actions": [d.scalar() for _ in range(6)]}}},
    "long_primitive_array": lambda d: {"stamps": [float(1_700_000_000 + d.rng.randint(0, 10**6)) for _ in range(10)]},
    "record_with_note": lambda d: d.flat(4) | {"note": d.text()},
    "dotted_paths": lambda d: {"a.b": d.word(), "a": {"b": d.word(), "c.d": d.scalar()}},
    "nested_event_log": lambda d: {"log": [{"at": d.number(), "event": d.flat(2)} for _ in range(3)]},
    "tabular_report": lambda d: {"title": d.phrase(), "rows": d.rows(5, 4), "total": d.number()},
}


def variation(shape: str, seed: int, odd: bool = False) -> dict:
    return SHAPES[shape](Draw(seed, odd))


def generate(spark: SparkSession, seeds: int, shapes: list[str] | None = None) -> DataFrame:
    """(shape, seed, mode, json): every shape for each seed, plain and odd, made in tasks."""
    names = list(shapes or SHAPES)
    grid = spark.range(seeds).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("shape"), F.col("id").alias("seed"), F.explode(F.array(F.lit("normal"), F.lit("adversarial"))).alias("mode"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [dumps(variation(*row[:2], row[2] == "adversarial")) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts)], names=["shape", "seed", "mode", "json"])

    return grid.mapInArrow(run, "shape string, seed long, mode string, json string")
