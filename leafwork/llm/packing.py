"""Pack documents into token sequences by cutting-stock patterns."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm import cutting_stock
from leafwork.llm.common import lean, running, written
from leafwork.llm.tokens import default_vocabulary, word_tokens

LENGTH, END = 4096, 2
#: Lengths of rests are counted in units of so many tokens.
UNIT = 16


def tokenized(docs: DataFrame, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Written rows (row, doc_id, tokens, ids): the ids of each whole text, then end, little-endian, 2 or 4 bytes each."""
    path = vocabulary or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(path)
        last = np.array([end], words.dtype).tobytes()
        for b in batches:
            step = max(1, int(b.num_rows * (4 << 20) / max(1, b.nbytes)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                ids = [x + last for x in words.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // words.width for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "tokens", "ids"])
        words.shrink()

    made = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, tokens long, ids binary")
    return written(made.select(F.monotonically_increasing_id().alias("row"), "*"), "tokens")


def _times(x: Column, n: int | Column) -> Column:
    """x div n, for longs of 0 or more."""
    n = F.lit(n) if isinstance(n, int) else n
    return ((x - F.pmod(x, n)) / n).cast("long")


#: How a piece got its place.
FULL, PATTERN, FILL, LAID = "full", "pattern", "fill", "laid"


def plan(lengths: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """Written pieces (row, start, size, sequence_id, offset, placed_by) of documents (row, tokens).

    1. Each document's full lengths are sequences of their own ("full").
    2. The rests, counted by length in units rounded down, are packed by
       cutting-stock patterns, and the ranked rests of a length are dealt to the
       places of the patterns ("pattern"). A sequence's rests, the longest last, reach past
       its end by the rounding; what does is cut off. Where they don't reach
       the end, a gap is left.
    3. What was cut off, and rests of less than a unit, fill the gaps ("fill"). If there
       is too little of that, the patterns that waste most are given up, until their rests and the
       others are enough.
    4. What is left then is laid end to end and cut at every length, the last
       stretch to powers of two ("laid").
    So no sequence needs padding. The driver holds the histogram, of
    length / unit numbers, and a few times as many patterns.
    """
    n, spark = length // unit, lengths.sparkSession
    zero = F.lit(0).cast("long")
    lengths = lengths.select("row", "tokens")
    full, rest = _times(F.col("tokens"), length), F.pmod("tokens", F.lit(length)).cast("long")
    whole = running(lengths.where(F.col("tokens") >= length), F.lit(0), full, "row")
    whole = whole.select("row", "before", F.explode(F.sequence(zero, full - 1)).alias("i"))
    whole = whole.select("row", (F.col("i") * length).alias("start"), F.lit(length).cast("long").alias("size"), ((F.col("before") + F.col("i")) * 3).alias("sequence_id"), zero.alias("offset"), F.lit(FULL).alias("placed_by"))
    rests = lengths.select("row", (F.col("tokens") - rest).alias("start"), rest.alias("size")).where("size > 0")
    rests = rests.withColumn("kind", _times(F.col("size"), unit).cast("int"))
    demand = np.zeros(n, np.int64)
    for r in rests.groupBy("kind").count().collect():
        if r["kind"]:
            demand[r["kind"] - 1] = r["count"]
    places, base, used = [[] for _ in range(n + 1)], 0, np.zeros(n, np.int64)
    for p, (times, counts) in enumerate(cutting_stock.solve(demand, n)):
        for k in np.flatnonzero(counts).tolist():
            places[k + 1].append((int(used[k]), int(used[k] + times * counts[k]), int(counts[k]), base, p))
            used[k] += times * counts[k]
        base += times
    spots = spark.createDataFrame(list(enumerate(places)), "kind int, spots array<struct<low:long,high:long,each:long,base:long,pattern:int>>")
    dealt = running(rests, F.col("kind"), F.lit(1), "row").join(F.broadcast(spots), "kind")
    spot = F.get(F.filter("spots", lambda s: (s["low"] <= F.col("before")) & (F.col("before") < s["high"])), 0)
    dealt = written(dealt.select("row", "start", "size", "before", spot.alias("spot")), "dealt")
    placed = dealt.where("spot is not null").select("row", "start", "size", "spot.pattern", (F.col("spot.base") + _times(F.col("before") - F.col("spot.low"), F.col("spot.each"))).alias("sequence"))
    own = Window.partitionBy("sequence")
    ends = F.sum("size").over(own.orderBy("size", "row").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.select("*", (ends - F.col("size")).alias("offset"), F.greatest(zero, length - F.sum("size").over(own)).alias("gap"))
    placed = written(placed.withColumn("kept", F.greatest(zero, F.least("size", length - F.col("offset")))), "placed")
    loose = dealt.where("spot is null").select("row", "start", "size")
    given_up = _given_up(placed, loose)
    up = F.col("pattern").isin(given_up) if given_up else F.lit(False)
    kept = placed.where(~up & (F.col("kept") > 0))
    over = placed.where(~up & (F.col("kept") < F.col("size"))).select("row", (F.col("start") + F.col("kept")).alias("start"), (F.col("size") - F.col("kept")).alias("size"))
    residue = over.union(placed.where(up).select("row", "start", "size")).union(loose)
    residue = written(running(residue, F.lit(0), F.col("size"), "row"), "residue")
    gaps = kept.where("offset = 0 and gap > 0").select("sequence", "gap")
    gaps = written(running(gaps, F.lit(0), F.col("gap"), "sequence"), "gaps")
    kept = kept.select("row", "start", F.col("kept").alias("size"), (F.col("sequence") * 3 + 1).alias("sequence_id"), "offset", F.lit(PATTERN).alias("placed_by"))
    filled = gaps.agg(F.sum("gap")).first()[0] or 0
    return written(whole.union(kept).union(_filling(residue, gaps, length)).union(_laid(residue, filled, length)), "pieces")


def _given_up(placed: DataFrame, loose: DataFrame) -> list[int]:
    """Patterns whose rests are needed to fill the gaps of the others: those of most gap a token."""
    first = F.when(F.col("offset") == 0, F.col("gap")).otherwise(0)
    sums = placed.groupBy("pattern").agg(F.sum("size").alias("tokens"), F.sum(F.col("size") - F.col("kept")).alias("over"), F.sum(first).alias("gap")).collect()
    there = (loose.agg(F.sum("size")).first()[0] or 0) + sum(r["over"] for r in sums)
    missing, out = sum(r["gap"] for r in sums) - there, []
    for r in sorted(sums, key=lambda r: (-r["gap"] / r["tokens"], r["pattern"])):
        if missing <= 0:
            break
        missing -= r["gap"] + r["tokens"] - r["over"]
        out.append(r["pattern"])
    return out


def _filling(residue: DataFrame, gaps: DataFrame, length: int) -> DataFrame:
    """Pieces of the residue, end to end, in the gaps, end to end: an overlap join by stretches of length."""
    a, b = F.col("before"), F.col("before") + F.col("size")
    spans = lambda x, y: F.explode(F.sequence(_times(x, length), _times(y - 1, length))).alias("stretch")
    pieces = residue.select("row", "start", a.alias("a"), b.alias("b"), spans(a, b))
    gaps = gaps.select("sequence", "gap", a.alias("x"), (a + F.col("gap")).alias("y"), spans(a, a + F.col("gap")))
    low, high = F.greatest("a", "x"), F.least("b", "y")
    found = pieces.join(gaps, "stretch").where((low < high) & (_times(low, length) == F.col("stretch")))
    at = F.lit(length) - F.col("gap") + low - F.col("x")
    return found.select("row", (F.col("start") + low - F.col("a")).alias("start"), (high - low).alias("size"), (F.col("sequence") * 3 + 1).alias("sequence_id"), at.alias("offset"), F.lit(FILL).alias("placed_by"))


def _laid(residue: DataFrame, filled: int, length: int) -> DataFrame:
    """Pieces of the residue after the tokens that have filled gaps, laid end to end and cut at every length, the last stretch to powers of two."""
    total, edges = (residue.agg(F.sum("size")).first()[0] or 0) - filled, []
    at = tail = total - total % length
    while at < total:
        edges.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    residue = residue.where(F.col("before") + F.col("size") > filled)
    residue = residue.select("row", (F.col("start") + F.greatest(F.lit(0), filled - F.col("before"))).alias("start"), F.greatest(F.lit(0), F.col("before") - filled).alias("before"), (F.col("before") + F.col("size") - filled).alias("end"))
    begin, end = F.col("before"), F.col("end")
    regular = F.filter(F.sequence(_times(begin, length) * length, end - 1, F.lit(length).cast("long")), lambda e: e < tail)
    late = F.filter(F.array(*[F.struct(F.lit(e).cast("long").alias("e"), F.lit(s).cast("long").alias("s")) for e, s in zip(edges, [*edges[1:], total], strict=False)]), lambda p: (p["e"] < end) & (p["s"] > begin)) if edges else None
    cuts = F.transform(regular, lambda e: F.struct(e.alias("e"), (e + length).alias("s")))
    cuts = F.concat(cuts, late) if late is not None else cuts
    out = residue.select("row", "start", "before", "end", F.inline(cuts))
    low, high = F.greatest("before", "e"), F.least(end, F.col("s"))
    out = out.select("row", (F.col("start") + low - F.col("before")).alias("start"), (high - low).alias("size"), (F.col("e") * 3 + 2).alias("sequence_id"), (low - F.col("e")).alias("offset"), F.lit(LAID).alias("placed_by"))
    return out.where("size > 0")


def packed(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, unit: int = UNIT, end: int = END, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, placed_by, and ids where asked (uint32).

    A document is its text's token ids, without special tokens added, and then
    end; null text is empty, so it is end alone. Every id is in exactly one
    piece, and a sequence holds length ids or a power of two. placed_by tells how (see plan). Rows that repeat
    a document are packed each; a null doc_id stays null. Other columns are not
    read. An empty table gives none.
    """
    texts = tokenized(docs, vocabulary, end)
    pieces = plan(texts, length, unit).groupBy("row").agg(F.collect_list(F.struct("start", "size", "sequence_id", "offset", "placed_by")).alias("pieces"))
    rows = texts.join(pieces, "row").select("doc_id", "tokens", "ids", "pieces")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, placed_by string" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, tokens, data, cuts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = np.frombuffer(data, f"<u{len(data) // tokens}")
                for c in cuts:
                    own = data[c["start"] : c["start"] + c["size"]].astype("<u4").tobytes()
                    out.append((doc_id, c["start"], c["size"], zlib.crc32(own), tokens, c["sequence_id"], c["offset"], c["placed_by"], *([own] if ids else [])))
            types = [b.schema.field(0).type, *[pa.int64()] * 6, pa.string(), *[pa.binary()] * ids]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "placed_by", *["ids"] * ids]
            columns = zip(*out, strict=True) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return rows.mapInArrow(lean(run), schema)
