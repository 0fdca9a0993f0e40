"""Deltas of documents, in a stream and in a batch."""

import random
import uuid

from pyspark.sql import functions as F

from leafwork.functions.decoding import decode_lenient_text
from leafwork.functions.wire import FRAME_OPEN
from leafwork.streaming.finalize import finalize_batch, finalize_stream

TEXTS = {"a": "id=1\nname=x\ntags=[\n1\n2\n]", "b": FRAME_OPEN + "\nid=2\nbody=<<<\nl1\nl2", "c": "", "d": "```\nid=3\n```"}
KIND = "doc_id string, seq long, delta string, last boolean"


def deltas(seed):
    rng, out = random.Random(seed), []
    for doc_id, text in TEXTS.items():
        cuts = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(4))})
        parts = [text[x:y] for x, y in zip(cuts, cuts[1:], strict=False)] or [""]
        out += [(doc_id, i, p, i + 1 == len(parts)) for i, p in enumerate(parts)]
    rng.shuffle(out)
    return out


def test_batch_puts_deltas_in_order(spark):
    rows = deltas(1)
    df = spark.createDataFrame([*rows, *rows[::2], ("n", 0, None, True)], KIND).repartition(5)
    got = {r.doc_id: r for r in finalize_batch(df).collect()}
    assert {k: r.text for k, r in got.items()} == {**TEXTS, "n": ""}
    for k, text in TEXTS.items():
        want = decode_lenient_text(text)
        assert got[k].read.truncated == want.truncated and len(got[k].read.errors) == len(want.errors)


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = deltas(2)
    for k in range(3):
        part = rows[k::3] + rows[:1]
        spark.createDataFrame(part, KIND).withColumn("ts", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(KIND + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    name = "s" + uuid.uuid4().hex
    query = finalize_stream(source, event_time="ts").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    got = {r.doc_id: r for r in spark.table(name).collect()}
    assert {k: r.text for k, r in got.items()} == TEXTS
    batch = {r.doc_id: r.read for r in finalize_batch(spark.createDataFrame(rows, KIND)).collect()}
    for k, r in got.items():
        assert (r.value, r.truncated, r.errors, r.timed_out) == (batch[k].value, batch[k].truncated, len(batch[k].errors), False)
