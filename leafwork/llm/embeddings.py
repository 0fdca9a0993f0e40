"""Near-duplicate embeddings: spherical k-means cells, blocked cosines, one vector kept a group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import lean, written
from leafwork.llm.graph import components

COSINE = 0.98
#: Vectors that the centroids are fitted on for each of them, vectors a block, rounds of fitting.
SAMPLE, BLOCK, ROUNDS = 16, 1024, 8
#: Cells are so many times fewer than the root of the number of vectors; at most as many centroids are broadcast, a few MB.
ROOTS, CELLS = 4, 8192


def cells_for(vectors: int, roots: int = ROOTS, most: int = CELLS) -> int:
    """Cells for so many vectors of a dimension: in proportion to their root, so that cells and their sizes grow alike."""
    return min(most, math.isqrt(vectors) // roots)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """k unit centroids (or fewer) of unit vectors: the mean directions of their cells."""
    k = min(k, len(vectors))
    centroids = vectors[np.random.default_rng(seed).choice(len(vectors), k, replace=False)]
    for _ in range(rounds):
        cell = (vectors @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, vectors)
        size = np.sqrt((sums * sums).sum(1))
        centroids = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centroids)
    return np.unique(centroids, axis=0)


def cells_of(v: np.ndarray, centroids: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home cell of each unit vector, rows and cells of their visits).

    Two vectors of at least the cosine are at most sqrt(2 - 2 cosine) apart; if
    their homes differ, each is at most so far from the plane halfway between
    the centroids. So the one of the higher cell visits the lower cell, and no
    pair is missed.
    """
    at = v @ centroids.T
    home = at.argmax(1)
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
    near = at[np.arange(len(v)), home][:, None] - at <= reach * apart[home]
    near &= np.arange(len(centroids))[None] < home[:, None]
    return home, *np.nonzero(near)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK, roots: int = ROOTS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null label and equal dimension are linked if their cosine, in
    double precision, is at least the threshold; n_links counts the
    other rows so linked, component_id is the smallest vec_id within reach, and
    the row with that vec_id is kept. A vector that is null, empty or zero, or holds
    null, NaN or an infinity, or whose label is null, is linked with nothing. Equal vectors stand for
    each other, so copies make no pairs. Rows may repeat a vec_id; a null vec_id is never the smallest.
    Other columns are not read; an empty table gives none.

    Centroids, one cell's for each (see cells_for), are fitted on sample times as many vectors, those of the least
    hashes; all vectors are assigned and compared. A cell of many vectors is compared block by block, each pair of
    blocks in a group of its own; a group gives the links' counts and a
    spanning forest, not the pairs.
    """
    kind = vectors.schema["label"].dataType.simpleString()
    raw = vectors.select("vec_id", F.col("embedding").alias("v"), "label")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.col("label").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = raw.select("vec_id", "v", "label", good.alias("good"), F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(1), "label", "v").alias("h2"))
    distinct = rows.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    distinct = written(distinct.select(F.monotonically_increasing_id().alias("node"), F.size("v").alias("dim"), "*"), "vectors")
    centroids = {}
    for r in distinct.groupBy("dim").count().collect():
        k = cells_for(r["count"], roots)
        if k > 1:
            some = distinct.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("h1")).limit(sample * k).select("v").toArrow()
            flat = some.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            centroids[r["dim"]] = spherical_kmeans(unit(flat.reshape(-1, r["dim"])), k)
    shared = distinct.sparkSession.sparkContext.broadcast(centroids)  # at most CELLS centroids a dimension

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, lists = b.column(1).to_numpy(), b.column(2)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(dims)]
            rows, cells, home = [], [], []
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                own = np.zeros(len(at), np.int64)
                if dim in shared.value:
                    v = unit(flat[(offsets[at][:, None] + np.arange(dim)[None])])
                    own, visits, to = cells_of(v, shared.value[dim], cosine)
                    rows.append(at[visits])
                    cells.append(to)
                    home.append(np.zeros(len(visits), bool))
                rows.append(at)
                cells.append(own)
                home.append(np.ones(len(at), bool))
            rows, cells, home = np.concatenate(rows), np.concatenate(cells), np.concatenate(home)
            own = [b.column(k).take(pa.array(rows)) for k in (0, 1, 3, 4)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(cells.astype(np.int64)), pa.array(home)], names=["node", "dim", "label", "copies", "cell", "home"])

    placed = distinct.select("node", "dim", "v", "label", "copies").mapInArrow(lean(assign), f"node long, dim int, label {kind}, copies long, cell long, home boolean")
    placed = written(placed, "placed")
    sizes = placed.groupBy("label", "dim", "cell").agg(F.count_if("home").alias("own"), F.count_if(~F.col("home")).alias("visits"))
    sizes = written(sizes.withColumn("blocks", F.ceil(F.col("own") / block)).withColumn("others", F.ceil(F.col("visits") / block)).where("blocks > 0"), "sizes")
    grouped = placed.join(sizes.drop("own", "visits"), ["label", "dim", "cell"])
    number = F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("blocks")).otherwise(F.col("others")))
    grouped = grouped.withColumn("number", number)
    zero, blocks = F.lit(0).cast("long"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)

    def part(left, right, role):
        return F.struct(left.cast("long").alias("i"), right.cast("long").alias("j"), F.lit(role).alias("role"))

    # a pair of home blocks (i, j), i <= j, or of home block i and visitors' block -1 - j
    as_left = F.transform(F.filter(blocks, lambda x: x >= F.col("number")), lambda x: part(F.col("number"), x, 0))
    as_right = F.transform(F.filter(blocks, lambda x: x < F.col("number")), lambda x: part(x, F.col("number"), 1))
    with_visits = F.when(F.col("others") > 0, F.transform(F.sequence(zero, F.greatest(zero, F.col("others") - 1)), lambda x: part(F.col("number"), -1 - x, 0))).otherwise(F.array())
    as_visit = F.transform(blocks, lambda x: part(x, -1 - F.col("number"), 1))
    tasks = F.when(F.col("home"), F.concat(as_left, as_right, with_visits)).otherwise(as_visit)
    keys = ["label", "dim", "cell", "i", "j"]
    # vectors join what they are compared in once that is known
    grouped = grouped.select("label", "dim", "cell", "node", "copies", F.inline(tasks)).join(distinct.select("node", "v"), "node").repartition(*keys).sortWithinPartitions(*keys)
    found = grouped.select(F.xxhash64(*keys).alias("h"), *keys[3:], "role", "node", "copies", "v").mapInArrow(lean(lambda b: _compare(b, cosine)), "a long, b long, n long")
    found = written(found, "found")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null")).select(F.col("node").alias("a"), "root")
    known = distinct.select(F.col("node").alias("a"), "h1", "h2", "least", "copies").join(roots, "a", "left").join(counts, "a", "left")
    known = written(known.select("h1", "h2", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "a").alias("root")), "rooted")
    groups = written(known.groupBy("root").agg(F.min("least").alias("component_id")), "groups")
    named = written(known.join(groups, "root").select("h1", "h2", "n_links", "component_id", F.lit(True).alias("good")), "named")
    out = rows.select("vec_id", "h1", "h2", "good").join(named, ["h1", "h2", "good"], "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def _compare(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows (node, null, copies linked) and links (a, b, null) of each sorted group (h, i, j)."""
    held: list[pa.RecordBatch] = []

    def groups() -> Iterator[pa.Table]:
        nonlocal held
        last = None
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in range(3)], 1)
            cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y > x:
                    now = tuple(key[x].tolist())
                    if last is not None and now != last and held:
                        yield pa.Table.from_batches(held)
                        held = []
                    last = now
                    held.append(b.slice(x, y - x))
        if held:
            yield pa.Table.from_batches(held)

    for t in groups():
        role, node, copies = (t.column(c).to_numpy() for c in ("role", "node", "copies"))
        lists = t.column("v").combine_chunks()
        v = unit(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1))
        left = np.flatnonzero(role == 0)
        right = np.flatnonzero(role == 1)
        alone = not len(right)
        if not len(left) or (alone and t.column("i")[0] != t.column("j")[0]):
            continue
        right = left if alone else right
        near = v[left] @ v[right].T >= cosine
        if alone:
            np.fill_diagonal(near, False)
        if not near.any():
            continue
        n_left = near @ copies[right]
        nodes, counts = node[left], n_left
        if not alone:
            nodes, counts = np.r_[nodes, node[right]], np.r_[counts, copies[left] @ near]
        some = counts > 0
        i, j = _forest(near, alone)
        a = np.r_[nodes[some], node[left][i]]
        b = pa.array(np.r_[np.zeros(some.sum(), np.int64), node[right][j]], mask=np.r_[np.ones(some.sum(), bool), np.zeros(len(i), bool)])
        n = pa.array(np.r_[counts[some], np.zeros(len(i), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(a), b, n], names=["a", "b", "n"])


def _forest(near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of links that span the components of a matrix of links."""
    rows, columns = near.shape
    label = np.arange(rows if same else rows + columns)
    shift, out_i, out_j = 0 if same else rows, [], []
    for i in np.flatnonzero(near.any(1)).tolist():
        to = np.flatnonzero(near[i])
        labels = label[to + shift]
        fresh, at = np.unique(labels, return_index=True)
        keep = fresh != label[i]
        if keep.any():
            out_i += [i] * int(keep.sum())
            out_j += to[at[keep]].tolist()
            label[np.isin(label, fresh[keep])] = label[i]
    return np.array(out_i, np.int64), np.array(out_j, np.int64)


def near_duplicates_sql(cosine: float = COSINE) -> str:
    """DuckDB SQL of near_duplicates over embeddings, by all pairs of a label."""
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e, list_transform(e, lambda x: coalesce(x, 0)) AS f FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(f, f)) AS norm FROM v WHERE label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM n a JOIN n b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_dot_product(a.f, b.f) / (a.norm * b.norm) >= {cosine}),
reach AS (SELECT r, r AS at FROM v UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.at),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.at GROUP BY reach.r),
links AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(links.n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least USING (r) LEFT JOIN links USING (r)"""
