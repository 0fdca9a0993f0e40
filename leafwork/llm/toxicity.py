"""Convolutional toxicity classifier: hashed word embeddings, filters of several widths, max pooling."""

from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm import textnum
from leafwork.llm.common import drop_path, fresh_path, give_back, lean, written

BUCKETS = 1 << 18
DIMENSIONS = 12
#: A word's vector is the sum of those of the word and of its first 3 to 6 bytes, so that forms of one stem share.
PREFIXES = (3, 4, 5, 6)
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Labelled ids that make a shard of their own, shards at most.
SHARD_TEXTS, SHARDS = 2048, 64
#: Words that fitting looks at at a time, and after which a batch of texts ends.
RUN, BATCH_WORDS = 1 << 14, 1 << 20
#: Places of the bitmap of labelled ids; steps to 1 of the whole numbers that models are summed up in.
ID_BITS, FINE = 1 << 26, 1 << 30
#: Words after its own that a filter reaches into.
REACH = max(WIDTHS) - 1
EPOCHS, RATE, DROPPED = 8, 0.02, 0.3


@dataclass
class Model:
    """Parameters; thresholds: by language, None for all others."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    thresholds: dict[str | None, float] = field(default_factory=lambda: {None: 0.5})

    def responses(self) -> np.ndarray:
        """Every bucket's share in the sums of all filters, by width and place in it."""
        return np.concatenate([(self.embedding @ f[k]).astype(np.float32) for f in self.filters for k in range(len(f))], 1)


def word_ids(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, buckets (words, features), first word of each text) of runs of texts."""
    for at, data, offsets in textnum.chunks(texts, 1 << 17):
        hashes, first = textnum.prefix_hashes(data, offsets, PREFIXES)
        yield at, (hashes >> np.uint64(46)).astype(np.int64), first


def _summed(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = table[ids[:, 0]]
    for j in range(1, ids.shape[1]):
        out += table[ids[:, j]]
    return out


def _shifted(x: np.ndarray, k: int, left: np.ndarray) -> np.ndarray:
    """Row i + k in row i; 0 where a text ends before (left: words left in the text)."""
    if not k:
        return x
    out = np.zeros_like(x)
    out[:-k] = x[k:]
    out[left <= k] = 0
    return out


def _left(first: np.ndarray) -> np.ndarray:
    return np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])


def _pooled(table: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Most response of each filter in each text; no text is empty."""
    own, left, at, most = _summed(table, ids), _left(first), 0, []
    for width in WIDTHS:
        sums = 0
        for k in range(width):
            sums = sums + _shifted(own[:, at : at + FILTERS], k, left)
            at += FILTERS
        most.append(np.maximum.reduceat(sums, first[:-1], axis=0))
    return np.concatenate(most, 1)


def _logits(model: Model, table: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = np.diff(first)
    full = np.flatnonzero(n)
    pooled = np.zeros((len(n), len(model.bias)))
    if len(full):
        pooled[full] = _pooled(table, ids, np.r_[first[:-1][full], first[-1]])
    return np.maximum(pooled + model.bias, 0) @ model.weights + model.offset


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scores(model: Model, texts: pa.Array, table: np.ndarray | None = None) -> np.ndarray:
    """Score of each whole text, 0 to 1. An empty or null text has its responses at 0."""
    table = model.responses() if table is None else table
    out = np.zeros(len(texts))
    for at, ids, first in word_ids(texts):
        out[at : at + len(first) - 1] = _sigmoid(_logits(model, table, ids, first))
    return out


class _Adam:
    def __init__(self, part: np.ndarray) -> None:
        self.part, self.m, self.v = part, np.zeros_like(part), np.zeros_like(part)

    def step(self, grad: np.ndarray, t: int, rows=slice(None)) -> None:
        self.m[rows] = m = 0.9 * self.m[rows] + 0.1 * grad
        self.v[rows] = v = 0.999 * self.v[rows] + 0.001 * grad * grad
        self.part[rows] -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def _runs(texts: Sequence, rng: np.random.Generator) -> Iterator[list[tuple[int, np.ndarray, int]]]:
    """Runs of pieces (text, buckets, words of its own) of whole texts, words dropped at random.

    After its own words a piece has those of its text that a filter reaches into from there. A run has
    no two pieces of a text.
    """
    run, words = [], 0
    for i, x in enumerate(texts):
        kept = np.flatnonzero(rng.random(len(x)) >= DROPPED) if len(x) > 1 else np.arange(1)
        kept = kept if len(kept) else np.arange(len(x))
        for at in range(0, len(kept), RUN):
            piece = x[kept[at : at + RUN + REACH]]
            run.append((i, piece, min(RUN, len(kept) - at)))
            words += len(piece)
            if words >= RUN:
                yield run
                run, words = [], 0
    if run:
        yield run


def _won(model: Model, texts: Sequence, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(most response, buckets of the words that give it, which of these words there are) by text, filter and place in it."""
    units = len(WIDTHS) * FILTERS
    most = np.full((len(texts), units), -np.inf)
    won = np.zeros((len(texts), units, REACH + 1, 1 + len(PREFIXES)), np.int64)
    inside = np.zeros(won.shape[:3], bool)
    for run in _runs(texts, rng):
        of, own = np.array([i for i, _, _ in run]), np.array([n for _, _, n in run])
        ids, first = np.concatenate([x for _, x, _ in run]), np.r_[0, np.cumsum([len(x) for _, x, _ in run])]
        left, vectors = _left(first), _summed(model.embedding, ids)
        foreign = np.arange(len(ids)) >= np.repeat(first[:-1] + own, np.diff(first))
        for j, f in enumerate(model.filters):
            sums = sum(_shifted(vectors @ f[k], k, left) for k in range(len(f)))
            sums[foreign] = -np.inf
            places = np.stack([sums[a:b].argmax(0) + a for a, b in zip(first, first[1:], strict=False)])
            found, unit = np.take_along_axis(sums, places, 0), np.arange(j * FILTERS, (j + 1) * FILTERS)
            d, u = np.nonzero(found > most[of[:, None], unit])
            text, at, place = of[d], unit[u], places[d, u]
            most[text, at] = found[d, u]
            for k in range(len(f)):
                inside[text, at, k] = some = left[place] > k
                won[text, at, k] = ids[np.where(some, place + k, 0)]
    return most, won, inside


def _start(seed: int) -> Model:
    rng = np.random.default_rng(seed)
    units = len(WIDTHS) * FILTERS
    return Model(
        rng.normal(0, 0.01, (BUCKETS, DIMENSIONS)).astype(np.float32),
        [rng.normal(0, 0.5, (w, DIMENSIONS, FILTERS)) for w in WIDTHS],
        np.zeros(units),
        np.abs(rng.normal(0, 0.5, units)),
        -2.0,
    )


def _weights(clean: int, toxic: int) -> np.ndarray | None:
    """Weight of a text of either label; None without both."""
    return 0.5 * (clean + toxic) / np.array([clean, toxic]) if clean and toxic else None


def _constant(model: Model, clean: int, toxic: int) -> Model:
    rate = (toxic + 0.5) / (clean + toxic + 1) if clean + toxic else 0.25
    model.weights[:] = 0
    model.offset = float(np.log(rate / (1 - rate)))
    return model


def _batches(examples: Iterable[tuple[np.ndarray, int]]) -> Iterator[list[tuple[np.ndarray, int]]]:
    """Batches of whole texts that have words: 32, or fewer once they have BATCH_WORDS."""
    batch, words = [], 0
    for ids, y in examples:
        if len(ids):
            batch.append((ids, y))
            words += len(ids)
            if len(batch) == 32 or words >= BATCH_WORDS:
                yield batch
                batch, words = [], 0
    if batch:
        yield batch


def _learn(model: Model, examples: Iterable[tuple[np.ndarray, int]], weight: np.ndarray, rng: np.random.Generator) -> tuple[int, np.ndarray]:
    """One pass of Adam over whole texts, into the model; (texts, steps that moved each bucket)."""
    offset = np.full(1, model.offset)
    words, filters, bias, out, base = _Adam(model.embedding), [_Adam(f) for f in model.filters], _Adam(model.bias), _Adam(model.weights), _Adam(offset)
    t, texts, moved = 0, 0, np.zeros(BUCKETS, np.int64)
    for batch in _batches(examples):
        labels = np.array([y for _, y in batch])
        most, won, inside = _won(model, [x for x, _ in batch], rng)
        z = most + model.bias
        hidden = np.maximum(z, 0)
        d = weight[labels] * (_sigmoid(hidden @ model.weights + offset[0]) - labels) / len(batch)
        dz = d[:, None] * model.weights * (z > 0)
        touched, pushed, filter_grads = [], [], []
        for j, f in enumerate(model.filters):
            own, grad = slice(j * FILTERS, (j + 1) * FILTERS), np.zeros_like(f)
            for k in range(len(f)):
                gk, ids = dz[:, own] * inside[:, own, k], won[:, own, k].reshape(-1, won.shape[3])
                grad[k] = np.einsum("dfe,df->ef", _summed(model.embedding, ids).reshape(*gk.shape, DIMENSIONS), gk)
                some = gk.ravel() != 0
                touched.append(ids[some])
                pushed.append((gk[:, :, None] * f[k].T[None]).reshape(-1, DIMENSIONS)[some])
            filter_grads.append(grad)
        t += 1
        texts += len(batch)
        at_words, grads = np.concatenate(touched), np.concatenate(pushed)
        if len(at_words):
            rows, inverse = np.unique(at_words.T.ravel(), return_inverse=True)
            total = np.zeros((len(rows), DIMENSIONS))
            np.add.at(total, inverse, np.tile(grads, (at_words.shape[1], 1)))
            words.step(total, t, rows)
            moved[rows] += 1
        for adam, grad in zip(filters, filter_grads, strict=True):
            adam.step(grad, t)
        bias.step(dz.sum(0), t)
        out.step(hidden.T @ d + 1e-4 * model.weights, t)
        np.maximum(model.weights, 0, out=model.weights)
        base.step(np.array([d.sum()]), t)
    model.offset = float(offset[0])
    return texts, moved


def fit(examples: Sequence[tuple[np.ndarray, int]], seed: int = 7) -> Model:
    """Fit by Adam on batches of whole texts given as buckets. Without both labels all scores are equal.

    Texts are pooled piece by piece: pooling needs but the words that win.

    The pooled filters' weights stay at 0 or more: a text is toxic for what it
    holds, and no other words make up for that, however long it is.
    Words are dropped at random while fitting, so that no single one decides.
    """
    model, rng = _start(seed), np.random.default_rng(seed)
    toxic = sum(int(y) for _, y in examples)
    weight = _weights(len(examples) - toxic, toxic)
    if weight is None:
        return _constant(model, len(examples) - toxic, toxic)
    for _ in range(EPOCHS):
        _learn(model, (examples[i] for i in rng.permutation(len(examples))), weight, rng)
    return model


def train(docs: DataFrame, labels: DataFrame, seed: int = 7) -> Model:
    """Fit on all labelled documents whose crc32(doc_id as text) mod 5 is not 0.

    Those are all rows with a label (doc_id and toxic not null; toxic if any row of the id is), each text
    whole. A quarter of them, by the hash of the text, is not fitted on: they move the scores so that 0.5
    has the best F1 over all, and set the thresholds by language; one
    with fewer than 20 such texts, or 5 of either label, takes 0.5.

    Texts are dealt by doc_id to shards, one for each SHARD_TEXTS labelled ids up to SHARDS of them. Every round
    each shard goes over its texts once, from the same model, and the mean of what the shards come to is the next one:
    of filters and weights by texts, of a bucket by the steps that moved it. Shards hang on the rows
    and not on the cluster. The driver holds a model and the sum of models. What it used goes back to the system.
    """
    rows, shards = _labelled(docs, labels)
    rows = rows.persist(StorageLevel.DISK_ONLY)
    try:
        found = {r.toxic: r["count"] for r in rows.where("not held").groupBy("toxic").count().collect()}
        clean, toxic = found.get(0, 0), found.get(1, 0)
        model, weight = _start(seed), _weights(clean, toxic)
        if weight is None:
            model = _constant(model, clean, toxic)
        else:
            texts = rows.where("not held").select("text", "toxic").coalesce(shards)
            for k in range(EPOCHS):
                model = _round(texts, model, weight, (seed, k))
        _calibrate(model, _held_logits(rows.where("held").select("text", "lang", "toxic"), model))
    finally:
        rows.unpersist(blocking=True)
    give_back()
    return model


def _labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """(rows (text, lang, toxic, held) of all labelled documents that are learned from, one partition a shard; shards).

    Documents are held against a bitmap of the labelled ids' hashes first, so that few others are shuffled.
    """
    learned = "doc_id is not null and crc32(cast(doc_id as string)) % 5 != 0"
    known = labels.where(learned).where("toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    shards = min(SHARDS, max(1, -(-known.count() // SHARD_TEXTS)))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(ID_BITS))
    maps = known.groupBy(F.bitmap_bucket_number(place).alias("__map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__bits"))
    rows = docs.where(learned).select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.bitmap_bucket_number(place).alias("__map"), F.bitmap_bit_position(place).alias("__bit"))
    rows = rows.join(F.broadcast(maps), "__map")  # of fixed size
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__bit div 8 + 1 as int), 1)")), 16, 10).cast("int")
    rows = rows.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(__bit % 8 as int))")) != 0)
    # a label goes where its documents go, by the one shuffle that makes the shards
    both = rows.selectExpr("doc_id", "text", "lang", "null toxic", "true document").union(known.selectExpr("doc_id", "null", "null", "toxic", "false")).repartition(shards, "doc_id")
    rows = both.withColumn("toxic", F.max("toxic").over(Window.partitionBy("doc_id"))).where("document and toxic is not null")
    text = F.coalesce("text", F.lit(""))
    held = F.pmod(F.xxhash64(text, F.lit("held")), F.lit(4)) == 0
    order = [F.xxhash64(F.col("doc_id").cast("string"), text), "doc_id", "text", "lang"]
    return rows.sortWithinPartitions(*order).select(text.alias("text"), "lang", "toxic", held.alias("held")), shards


def _round(texts: DataFrame, model: Model, weight: np.ndarray, seed: tuple[int, ...]) -> Model:
    """The mean of the models that the shards come to from this one, each by a pass over its texts."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = copy.deepcopy(shared.value)
        n, moved = _learn(own, _examples(batches), weight, np.random.default_rng((*seed, TaskContext.get().partitionId())))
        at = np.flatnonzero(moved)
        if n:
            parts = [at.astype("<u4"), moved[at].astype("<u4"), own.embedding[at].astype("<f4"), _flat(own).astype("<f8")]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["n", "at", "moved", "vectors", "others"])

    path = fresh_path(spark, "toxicity-round")
    schema = "n long, at binary, moved binary, vectors binary, others binary"
    texts.mapInArrow(lean(run), schema).write.parquet(path)
    shared.destroy()
    # sums of whole numbers don't hang on their order
    vectors, moved, others, n = np.zeros((BUCKETS, DIMENSIONS), np.int64), np.zeros(BUCKETS, np.int64), 0, 0
    files = sorted(spark.read.schema(schema).parquet(path).inputFiles())
    for k in range(0, len(files), 4):
        for r in spark.read.schema(schema).parquet(*files[k : k + 4]).collect():
            at, steps = np.frombuffer(r.at, "<u4"), np.frombuffer(r.moved, "<u4").astype(np.int64)
            vectors[at] += _whole(np.frombuffer(r.vectors, "<f4").reshape(-1, DIMENSIONS)) * steps[:, None]
            moved[at] += steps
            others, n = others + _whole(np.frombuffer(r.others, "<f8")) * r.n, n + r.n
    drop_path(spark, path)
    if not n:
        return model
    mean, some = others / (n * FINE), np.flatnonzero(moved)
    model.embedding[some] = vectors[some] / (moved[some, None] * FINE)
    for part in (*model.filters, model.bias, model.weights):
        part[...], mean = mean[: part.size].reshape(part.shape), mean[part.size :]
    model.offset = float(mean[0])
    return model


def _flat(model: Model) -> np.ndarray:
    """All parameters but the embedding."""
    return np.concatenate([*(f.ravel() for f in model.filters), model.bias, model.weights, [model.offset]])


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x.astype(float) * FINE).astype(np.int64)


def _examples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    for b in batches:
        for at, ids, first in word_ids(b.column(0)):
            for i, (x, y) in enumerate(zip(first, first[1:], strict=False), at):
                yield ids[x:y], b.column(1)[i].as_py()


def _held_logits(rows: DataFrame, model: Model) -> DataFrame:
    """Written rows (lang, toxic, logit): the logit of each row's whole text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.responses()
        for b in batches:
            found = np.zeros(len(b))
            for at, ids, first in word_ids(b.column(0)):
                found[at : at + len(first) - 1] = _logits(shared.value, table, ids, first)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, pa.float64())], names=["lang", "toxic", "logit"])

    return written(rows.mapInArrow(lean(run), "lang string, toxic int, logit double"), "held-logits")


def best_thresholds(rows: DataFrame) -> DataFrame:
    """(lang, n, hits, threshold) of rows (lang, toxic, logit): the logit at the middle of the gap with the best F1, the highest of equals.

    The empty lang stands for all rows; null is no language. Logits are summed up in bins of 1/16 and the bins apart.
    """
    groups = F.when(F.col("lang") != "", F.array(F.lit(""), "lang")).otherwise(F.array(F.lit("")))
    steps = rows.select(F.explode(groups).alias("lang"), "toxic", "logit").groupBy("lang", F.floor(F.col("logit") * -16).alias("bin"), "logit").agg(F.count("*").alias("own"), F.sum("toxic").alias("toxic"))
    sums = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0))
    all_bins = Window.partitionBy("lang")
    upto = all_bins.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = steps.groupBy("lang", "bin").agg(F.sum("own").alias("own"), F.sum("toxic").alias("toxic"), F.max("logit").alias("top"))
    bins = bins.select(
        "lang", "bin", sums("own", upto).alias("own_before"), sums("toxic", upto).alias("toxic_before"), F.lead("top").over(all_bins.orderBy("bin")).alias("below"),
        F.sum("own").over(all_bins).alias("n"), F.sum("toxic").over(all_bins).alias("hits"),
    )
    order = Window.partitionBy("lang", "bin").orderBy(F.desc("logit"))
    inner = order.rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("lang", "bin", "logit", sums("own", inner).alias("own"), sums("toxic", inner).alias("toxic"), F.lead("logit").over(order).alias("next")).join(bins, ["lang", "bin"])
    f1 = 2 * (F.col("toxic_before") + F.col("toxic")) / (F.col("own_before") + F.col("own") + F.col("hits"))
    best = steps.groupBy("lang", "n", "hits").agg(F.max(F.struct(f1.alias("f1"), "logit", F.coalesce("next", "below", "logit").alias("next"))).alias("best"))
    return best.select("lang", "n", "hits", ((F.col("best.logit") + F.col("best.next")) / 2).alias("threshold"))


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Move the scores so that 0.5 has the best F1 over all rows (lang, toxic, logit), and set the thresholds by language."""
    enough = "if(lang = '', hits > 0 and hits < n, n >= 20 and least(hits, n - hits) >= 5)"
    found = {r.lang: r.threshold for r in best_thresholds(rows).where(enough).collect()}
    overall = found.pop("", 0.0)
    model.offset -= overall
    model.thresholds = {None: 0.5} | {lang: float(_sigmoid(found[lang] - overall)) for lang in sorted(found)}


def classify(docs: DataFrame, model: Model, *keep: str, text: str = "text", name: str = "score") -> DataFrame:
    """The columns keep of docs and the score, under a name: of the whole text, from nothing else."""
    names = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + f", `{name}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.responses()
        for b in batches:
            found = scores(shared.value, b.column(place), table)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(found)], names=[*names, name])

    place = names.index(text) if text in names else len(names)
    return docs.select(*names, *([text] if place == len(names) else [])).mapInArrow(lean(run), schema)


def rejected(score, lang, model: Model):
    """Whether the language's threshold is reached; a null or unknown language takes that of all."""
    known = [F.lit(x) for k, v in sorted((k, v) for k, v in model.thresholds.items() if k is not None) for x in (k, v)]
    own = F.try_element_at(F.create_map(*known), lang.cast("string")) if known else F.lit(None)
    return score >= F.coalesce(own, F.lit(model.thresholds[None]))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, rejected.

    held_out: crc32(doc_id as text) mod 5 is 0 (a null doc_id is held out); predicted: score at
    least 0.5; rejected: score at least the threshold of the document's language. A null text
    is empty and gets a score too. Rows may repeat; other columns are not
    read; without labels every score is the same. An empty table gives none.
    """
    model = train(docs, labels)
    found = classify(docs, model, "doc_id", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), rejected(F.col("score"), F.col("lang"), model).alias("rejected"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that reach the threshold of their language. Cases as in score_documents."""
    model = train(docs, labels)
    found = classify(docs, model, *docs.columns, name="__score")
    return found.where(~rejected(F.col("__score"), F.col("lang"), model)).select(*docs.columns)
