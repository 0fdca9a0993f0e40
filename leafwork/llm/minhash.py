"""MinHash fingerprints of documents and of their edited texts."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm import textnum
from leafwork.llm.common import bounded_batches, lean, part_of, partitions, splits, written
from leafwork.llm.graph import components

WIDTH = 5
PERMUTATIONS = 128
_random = np.random.default_rng(0x5EED)
#: Multiply-add-shift hashing of 64 to 32 bits, a universal family.
_A = _random.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2)
EMPTY = np.uint32(0xFFFFFFFF)
#: Bands of ROWS permutations each. Texts of likeness 0.8 share none of them once in 20,000 times.
BANDS, ROWS = 25, 5
SIMILARITY, BLOCK = 0.8, 256


def signatures(texts: pa.Array, width: int = WIDTH) -> np.ndarray:
    """uint32 array (texts, PERMUTATIONS): the least hash of the shingles of width
    words under each permutation. A text of fewer words has one shingle of all;
    an empty or null text has none, and EMPTY everywhere.
    """
    out = np.full((len(texts), PERMUTATIONS), EMPTY, np.uint32)
    for at, data, offsets in textnum.chunks(texts, 1 << 18):
        shingles, starts = textnum.shingle_hashes(*textnum.word_hashes(data, offsets), width)
        if not len(shingles):
            continue
        full = np.flatnonzero(np.diff(starts))
        h, least = np.empty_like(shingles), np.empty((PERMUTATIONS, len(full)), np.uint64)
        for k in range(PERMUTATIONS):
            np.multiply(shingles, _A[k], out=h)
            h += _B[k]
            np.minimum.reduceat(h, starts[full], out=least[k])
        out[at + full] = (least.T >> np.uint64(32)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of permutations under which the signatures agree: estimates Jaccard."""
    return (a == b).mean(axis=1)


def as_text(signature: np.ndarray) -> str:
    return base64.b64encode(signature.astype("<u4").tobytes()).decode()


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by as much of the head of following."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compare_with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprint every document and compare it with its edited text and its successor.

    The successor is the next document by descending doc_id; the last is
    followed by the first. Rows of equal doc_id follow each other by the hash of
    their text; a null doc_id comes last. A null text is empty. A single row
    follows itself. Other columns of docs are not read; an empty table gives none.

    Documents are dealt out by ranges of doc_id, once; the first of each range is
    dealt to the range before it too, so every task meets all successors it
    needs while it streams over its sorted rows. The driver holds one number
    a range.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bounded_batches(docs.sparkSession)
    cuts = splits(docs, "doc_id", 4 * partitions(docs.sparkSession))
    docs = docs.withColumn("part", part_of(F.col("doc_id"), cuts))
    tops = sorted(docs.groupBy("part").agg(F.max("doc_id").alias("top")).collect())
    if not tops:
        parts = F.array(F.col("part"))
    else:
        #: The range that a range's first row follows: the next higher one that has rows, or from the highest the lowest.
        above = {r["part"]: tops[(i + 1) % len(tops)]["part"] for i, r in enumerate(tops)}
        known = {r["part"]: r["top"] for r in tops}
        n = max(known) + 1
        top = F.element_at(F.array(*[F.lit(known.get(i)).cast("long") for i in range(n)]), F.col("part") + 1)
        before = F.element_at(F.array(*[F.lit(above.get(i, 0)) for i in range(n)]), F.col("part") + 1)
        parts = F.when(F.col("doc_id").eqNullSafe(top), F.array(F.col("part"), before)).otherwise(F.array(F.col("part")))
    rows = docs.select("doc_id", "text", F.posexplode(parts).alias("halo", "part"))
    rows = rows.repartition(partitions(docs.sparkSession), "part")
    rows = rows.sortWithinPartitions("part", "halo", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "halo").mapInArrow(lean(_compare), schema)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None  # the last row seen, if its successor is still to come
    for batch in batches:
        step = max(1, min(batch.num_rows, int(batch.num_rows * (4 << 20) / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            texts, own = part.column(1).to_pylist(), signatures(part.column(1))
            ids, halo = part.column(0).to_pylist(), part.column(2).to_pylist()
            rows = [*([held] if held else []), *zip(ids, texts, own, halo, strict=True)]
            pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[3]]
            held = rows[-1] if not rows[-1][3] else None
            if not pairs:
                continue
            texts = [edited(x[1], y[1]) for x, y in pairs]
            a, b, c = np.stack([x[2] for x, _ in pairs]), signatures(pa.array(texts, pa.large_string())), np.stack([y[2] for _, y in pairs])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x, _ in pairs], pa.int64()),
                    pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
                    pa.array([as_text(x) for x in a]),
                    pa.array([as_text(x) for x in b]),
                    pa.array(likeness(a, b)),
                    pa.array(likeness(a, c)),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, least, signature, shingles): the distinct shingles' hashes in order, as bytes."""
    for b in batches:
        step = max(1, min(b.num_rows, int(b.num_rows * (4 << 20) / max(1, b.nbytes))))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            texts, sets = part.column(3), []
            for _, data, offsets in textnum.chunks(texts, 1 << 18):
                shingles, starts = textnum.shingle_hashes(*textnum.word_hashes(data, offsets), WIDTH)
                sets += [np.unique(shingles[x:y]).tobytes() for x, y in zip(starts, starts[1:], strict=False)]
            marks = [x.tobytes() for x in signatures(texts)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(marks, pa.binary()), pa.array(sets, pa.binary())], names=["h1", "h2", "least", "signature", "shingles"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct hashes; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """A spanning forest (a, b) of the verified links of each sorted group (band, key, i, j)."""
    held: list[tuple] = []
    last = None

    def links() -> pa.RecordBatch:
        marks = np.stack([np.frombuffer(r[2], np.uint32) for r in held])
        sets = [np.frombuffer(r[3], np.uint64) for r in held]
        left = np.array([k for k, r in enumerate(held) if r[0] == 0], np.int64)
        right = np.array([k for k, r in enumerate(held) if r[0] == 1], np.int64)
        pairs = [(x, y) for n, x in enumerate(left) for y in left[n + 1 :]] if not len(right) and last[2] == last[3] else [(x, y) for x in left for y in right]
        label, a, b = list(range(len(held))), [], []

        def find(x: int) -> int:
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        if pairs:
            x, y = np.array(pairs).T
            alike = np.concatenate([likeness(marks[x[k : k + 4096]], marks[y[k : k + 4096]]) for k in range(0, len(x), 4096)])
            # the likeliest first, so that most pairs are in one tree before they are verified
            for k in np.argsort(-alike, kind="stable").tolist():
                p, q = find(int(x[k])), find(int(y[k]))
                if p != q and jaccard(sets[x[k]], sets[y[k]]) >= similarity:
                    label[q] = p
                    a.append(held[x[k]][1])
                    b.append(held[y[k]][1])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for band, key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (band, key, i, j) != last and held:
                yield links()
                held = []
            last = (band, key, i, j)
            held.append(tuple(row))
    if held:
        yield links()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, component_id (smallest doc_id within reach of links).

    Texts are linked if the Jaccard likeness of their shingles is at least similarity. All pairs that share a band of
    their signatures are verified on the shingles; a pair of likeness 0.8 shares none once in 20,000 times. Equal
    texts stand for each other. A bucket of many texts is compared block by
    block, each pair of blocks in a group of its own, and gives a
    spanning forest, not the pairs. Null text is empty; texts without words are alike. A
    null doc_id is never the smallest. Rows may repeat; other columns are not read; an empty table gives
    none.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    texts = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.first("text").alias("text"))
    made = texts.mapInArrow(lean(_fingerprinted), f"h1 long, h2 long, least {docs.schema['doc_id'].dataType.simpleString()}, signature binary, shingles binary")
    made = written(made.select(F.monotonically_increasing_id().alias("node"), "*"), "signatures")
    size = 4 * ROWS
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.xxhash64(F.substring("signature", F.lit(k * size + 1), F.lit(size))).alias("key")) for k in range(BANDS)])
    buckets = made.select("node", F.inline(bands))
    sizes = written(buckets.groupBy("band", "key").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = buckets.join(sizes.drop("n"), ["band", "key"]).withColumn("number", F.pmod(F.xxhash64("node"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    tasks = F.transform(every, lambda x: F.struct(F.least("number", x).alias("i"), F.greatest("number", x).alias("j"), (F.col("number") > x).cast("int").alias("role")))
    keys = ["band", "key", "i", "j"]
    shared = shared.select("node", "band", "key", F.inline(tasks)).join(made.select("node", "signature", "shingles"), "node")
    shared = shared.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "role", "node", "signature", "shingles")
    roots = components(shared.mapInArrow(lean(lambda b: _verified(b, similarity)), "a long, b long"))
    known = written(made.select("node", "h1", "h2", "least").join(roots, "node", "left").select("h1", "h2", "least", F.coalesce("root", "node").alias("root")), "rooted")
    groups = written(known.groupBy("root").agg(F.min("least").alias("component_id")), "groups")
    named = written(known.join(groups, "root").select("h1", "h2", "component_id"), "named")
    return rows.select("doc_id", "h1", "h2").join(named, ["h1", "h2"], "left").select("doc_id", "component_id")
