"""Texts that arrive as deltas: put together by sequence number and read when they end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafwork.functions import columns
from leafwork.functions.decoding import decode_lenient_text

#: deltas: doc_id, seq, delta, last (whether the document ends here).
OPEN, DONE = -1, -2
FINAL = "doc_id string, text string, value string, errors int, repairs array<string>, truncated boolean, timed_out boolean"


class StreamingDecoder:
    """One document in a process: push deltas, then finalize; chunk borders make no difference."""

    def __init__(self, schema: str | None = None) -> None:
        self.schema, self.deltas = schema, []

    def push(self, delta: str) -> None:
        self.deltas.append(delta)

    def finalize(self):
        return decode_lenient_text("".join(self.deltas), self.schema)


def finalize_batch(deltas: DataFrame, schema: str | None = None) -> DataFrame:
    """The batch twin: (doc_id, text, read) of each document, its deltas in order of seq; a null delta is empty.

    A seq that repeats counts once, as in the stream: by its least delta, should they differ.
    """
    once = deltas.groupBy("doc_id", "seq").agg(F.min(F.coalesce("delta", F.lit(""))).alias("delta"))
    parts = F.sort_array(F.collect_list(F.struct("seq", "delta")))
    texts = once.groupBy("doc_id").agg(parts.alias("parts")).select("doc_id", F.array_join(F.transform("parts", lambda p: p["delta"]), "").alias("text"))
    return texts.withColumn("read", columns.decode_lenient(F.col("text"), schema))


def finalize_stream(deltas: DataFrame, schema: str | None = None, timeout: str = "10 minutes", event_time: str | None = None) -> DataFrame:
    """A row per document once all deltas up to its last one are there, or once it has timed out.

    The state holds a document's deltas by seq, so they may come in any order,
    or twice; once it is read an empty mark stays until the timeout, so that a late copy
    of a delta starts nothing. With event_time (a column that has a watermark) the timeout
    counts event time, else processing time; what has come by then is
    read as a text that was cut off.
    """
    seconds = int(pd.Timedelta(timeout).total_seconds())
    kind = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.ProcessingTimeTimeout

    def result(doc_id: str, parts: dict[int, str], timed_out: bool) -> pd.DataFrame:
        text = "".join(parts[k] for k in sorted(parts))
        found = decode_lenient_text(text, schema)
        row = (doc_id, text, columns.dumps(found.value), len(found.errors), [k for k, _ in found.repairs], found.truncated or timed_out, timed_out)
        return pd.DataFrame([row], columns=["doc_id", "text", "value", "errors", "repairs", "truncated", "timed_out"])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, texts, end = state.get if state.exists else ([], [], OPEN)
        parts = dict(zip(seqs, texts, strict=True))
        if state.hasTimedOut:
            state.remove()
            if end != DONE:
                yield result(key[0], parts, True)
            return
        latest, rows = 0, []
        for b in batches:
            rows += list(zip(b["seq"], b["delta"], b["last"], strict=True))
            if event_time and len(b):
                latest = max(latest, int(b[event_time].max().timestamp() * 1000))
        if end != DONE:
            for seq, delta, last in rows:
                parts.setdefault(int(seq), delta or "")
                end = int(seq) if last else end
            if end >= 0 and all(k in parts for k in range(end + 1)):
                yield result(key[0], {k: parts[k] for k in range(end + 1)}, False)
                parts, end = {}, DONE
        state.update((list(parts), list(parts.values()), end))
        if event_time:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + seconds * 1000)
        else:
            state.setTimeoutDuration(seconds * 1000)

    wanted = ["doc_id", "seq", "delta", "last", *([event_time] if event_time else [])]
    keyed = deltas.select(F.col("doc_id").cast("string").alias("doc_id"), *wanted[1:])
    return keyed.groupBy("doc_id").applyInPandasWithState(run, FINAL, "seqs array<bigint>, texts array<string>, last bigint", "append", kind)
