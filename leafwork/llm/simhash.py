"""SimHash fingerprints and their exact near-duplicate groups by covering hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.llm import textnum
from leafwork.llm.common import lean, written
from leafwork.llm.graph import components

#: Codes of bit positions: all non-zero vectors of RADIUS + 1 bits.
RADIUS = 3
CODES = (1 << (RADIUS + 1)) - 1


def covering_masks(positions: list[int]) -> list[int]:
    """One bit mask of the positions for each non-zero vector v of RADIUS + 1 bits.

    Position number i gets the code 1 + i mod CODES; v's mask has the positions
    whose code has an odd inner product with v. The codes of RADIUS positions
    span at most RADIUS dimensions, so some v is orthogonal to all of them: its
    mask has none of these positions, and two numbers that differ in only
    these agree under it.
    """
    return [sum(1 << p for i, p in enumerate(positions) if ((1 + i % CODES) & v).bit_count() % 2) for v in range(1, CODES + 1)]


MASKS = covering_masks(list(range(64)))
#: For each mask, masks of the positions that it leaves out: both together leave 16 bits at most.
INNER = [covering_masks([p for p in range(64) if not m >> p & 1]) for m in MASKS]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints_of(texts: pa.Array, width: int = 3) -> np.ndarray:
    """uint64 SimHash of each text (null: empty) over its shingles of width words."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for at, data, offsets in textnum.chunks(texts, 1 << 18):
        starts, ends, first = textnum.words(data, offsets)
        if not len(starts):
            continue
        kept = ~textnum._SPACE[data]
        joints = ends[ends < len(data)]
        kept[joints] = True
        plain = np.where(textnum._SPACE[data], np.uint8(32), textnum._LOWER[data])[kept].tobytes()
        moved = np.cumsum(kept) - kept
        lengths, starts = ends - starts, moved[starts]
        counts = np.diff(first)
        n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        begin = np.concatenate(([0], np.cumsum(n)))
        word = np.repeat(first[:-1] - begin[:-1], n) + np.arange(begin[-1])
        last = np.minimum(word + width, np.repeat(first[1:], n)) - 1
        spans = zip(starts[word].tolist(), (starts[last] + lengths[last]).tolist(), strict=True)
        h = np.fromiter((digest(plain[s:e], 42) for s, e in spans), np.uint64, begin[-1])
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        full = np.flatnonzero(n)
        ones = np.add.reduceat(bits, begin[full], axis=0, dtype=np.int32)
        made = np.packbits(2 * ones > n[full, None], axis=1).view(">u8").ravel()
        out[at + full] = made.astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, *keep: str, text: str = "text", width: int = 3) -> DataFrame:
    """The columns keep of docs and fp, the fingerprint as a signed long."""
    names = list(keep)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints_of(b.column(len(names)), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(fp)], names=[*names, "fp"])

    return docs.select(*names, text).mapInArrow(lean(run), schema)


def forest_in_buckets(bucket: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span, within each run of equal bucket, all pairs within radius.

    All pairs of a bucket are compared, but no more links than a forest has are
    given back.
    """
    n = len(fp)
    if n < 2:
        return fp[:0], fp[:0]
    changes = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.repeat(np.r_[changes[1:], n], np.diff(np.r_[changes, n]))
    label, found, active, d = np.arange(n), [], np.arange(n), 0
    while True:
        d += 1
        active = active[ends[active] - active > d]
        if not len(active):
            break
        near = active[np.bitwise_count(fp[active] ^ fp[active + d]) <= radius]
        near = near[label[near] != label[near + d]]
        if not len(near):
            continue
        for i in near.tolist():
            x, y = i, i + d
            while label[x] != x:
                x = label[x]
            while label[y] != y:
                y = label[y]
            if x != y:
                label[max(x, y)] = min(x, y)
                found.append((i, i + d))
        while (label != label[label]).any():
            label = label[label]
    ij = np.array(found, np.int64).reshape(-1, 2)
    return fp[ij[:, 0]], fp[ij[:, 1]]


def _bucket_links(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links (a, b) of rows (keys, fp), by streaming over buckets in sorted order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        last: tuple | None = None
        number = 0

        def made(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = forest_in_buckets(bucket, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            key, fp = np.stack([c.astype(np.int64) for c in columns[:-1]], 1), columns[-1]
            new = np.r_[last is not None and tuple(key[0].tolist()) != last, (key[1:] != key[:-1]).any(1)]
            bucket = number + np.cumsum(new)
            last, number = tuple(key[-1].tolist()), int(bucket[-1])
            bucket, fp = np.r_[held_key, bucket], np.r_[held_fp, fp]
            done = int(np.searchsorted(bucket, number))
            if done:
                yield made(bucket[:done], fp[:done])
            held_key, held_fp = bucket[done:], fp[done:]
        if len(held_fp):
            yield made(held_key, held_fp)

    rows = rows.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(lean(run), "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, hot: int = 1024) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect exactly
    those which differ in radius bits or fewer, at most RADIUS.

    Every such pair shares a bucket of one of the 15 tables. A bucket of more
    than hot fingerprints is dealt out again by a second covering of the bits
    that its mask leaves out, which again every near pair in it survives; what
    then shares a bucket differs in 16 bits at most, so none has over 65,536
    fingerprints. Within a bucket pairs are compared but only a spanning
    forest is given out.
    """
    if radius > RADIUS:
        raise ValueError(f"radius is at most {RADIUS}")
    fps = fps.select("fp").where("fp is not null")
    tables = F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(MASKS)])
    rows = fps.select("fp", F.inline(tables))
    sizes = written(rows.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = written(rows.join(sizes, ["v", "key"]), "shared")
    cold = _bucket_links(shared.where(F.col("n") <= hot), ["v", "key"], radius)

    def inner(v: int) -> Column:
        both = [MASKS[v] | m for m in INNER[v]]
        return F.array(*[F.struct(F.lit(w).alias("w"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key2")) for w, m in enumerate(both)])

    again = F.element_at(F.array(*[inner(v) for v in range(CODES)]), F.col("v") + 1)
    warm = shared.where(F.col("n") > hot).select("v", "fp", F.inline(again))
    return cold.union(_bucket_links(warm, ["v", "w", "key2"], radius))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp long, component_id (smallest doc_id reachable).

    A null or empty text has fingerprint 0 and links like any other. Rows that
    repeat a doc_id stay, each with its component. A null doc_id is never the
    smallest; a component of nulls alone has component_id null. Other columns
    of docs are not read. An empty table gives none.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    made = written(fingerprints(docs, "doc_id"), "fingerprints")
    named = _least(made, F.col("doc_id"), radius).withColumnRenamed("least", "component_id")
    return made.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def _least(made: DataFrame, value: Column, radius: int) -> DataFrame:
    """Written rows (fp, least): the smallest value of all rows in the fingerprint's component."""
    fps = written(made.groupBy("fp").agg(F.min(value).alias("least")), "distinct")
    roots = components(links(fps, radius)).select(F.col("node").alias("fp"), "root")
    known = fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = written(known, "rooted")
    groups = written(known.groupBy("root").agg(F.min("least").alias("least")), "groups")
    return written(known.drop("least").join(groups, "root").select("fp", "least"), "named")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each near-duplicate group: that of the smallest doc_id.

    Of a group's rows that repeat this doc_id the one whose text has the least hash stays; rows of other
    groups that repeat it stand for theirs. Of rows that repeat both one stays, that of the least hash over all
    columns that can be hashed. A document without a doc_id can't stand for a group, nor be
    told from others, and stays. An empty table gives none.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    made = written(fingerprints(hashed, "doc_id", "hash"), "fingerprints")
    named = _least(made, F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "hash")), radius)
    kept = named.where("least is not null").select(F.col("least.doc_id").alias("__id"), F.col("least.hash").alias("__hash")).distinct()
    # rows that repeat are combined before they are shuffled
    names = [f"`{c}`" for c in docs.columns]
    plain = [n for n, f in zip(names, docs.schema.fields, strict=True) if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash"))
    rows = rows.agg(F.min_by(F.struct(*names), F.xxhash64(*plain)).alias("__row")).join(written(kept, "kept"), ["__id", "__hash"], "left_semi")
    return rows.select("__row.*").union(docs.where("doc_id is null"))
