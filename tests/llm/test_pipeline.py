
import corpus_pipeline
from leafwork.llm import queries
from leafwork.llm.common import drop_written, part_of, running, shared_dir, splits, written
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "lang", "n_chars", "source", "text"]


def test_stages(spark, tmp_path):
    base = "the quick brown fox jumps over the lazy dog near the old river bank today"
    rows = [(i, " ".join([base, f"document number {i * 7919}", *(f"w{i}v{k}" for k in range(60))]) + f"\nshared line that all of the documents have in common\nown line {i} {i * i} {i * 31}", "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, rows[5][1], "en", "s0", 0), (101, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    now, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(f"{sf}/{k}")
        now = spark.read.parquet(f"{sf}/{k}")
        seen.append(now.count())
        assert k == 4 or sorted(now.columns) == COLUMNS
    assert seen[:3] == [62, 62, 61]
    lines = spark.read.parquet(f"{sf}/1").where("text like '%shared line%'").count()
    assert lines == 1
    assert corpus_pipeline.run(spark, sf).count() == seen[4]


def test_registered():
    assert [q for q in queries.QUERIES if q.startswith("op")] == sorted((q for q in queries.QUERIES if q.startswith("op")), key=lambda q: int(q[2:].split("_")[0]))
    assert {q.split("_")[0] for q in queries.QUERIES if q.startswith("op")} == {f"op{n}" for n in range(1, 11)}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_splits_and_running_sums(spark):
    df = spark.createDataFrame([(i * i, i % 3, i) for i in range(500)] + [(None, 0, 7)], "k long, g int, v long")
    cuts = splits(df, "k", 9)
    parts = df.select("k", part_of(F.col("k"), cuts).alias("p")).collect()
    assert all(r.p == (0 if r.k is None else sum(c <= r.k for c in cuts)) for r in parts)
    got = running(df.where("k is not null"), F.col("g"), F.col("v"), "k").collect()
    for g in range(3):
        spans = sorted((r.before, r.before + r.v) for r in got if r.g == g)
        assert spans[0][0] == 0
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_written_tables_can_be_dropped(spark):
    before = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark) == before.rstrip("/")
    df = written(spark.range(5), "five")
    assert df.count() == 5
    drop_written(spark)
    assert written(spark.range(3), "three").count() == 3
