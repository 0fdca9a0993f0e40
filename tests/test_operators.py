"""Leaf tables, preparation of rows, sources."""

import json

import pytest
from pyspark.sql import functions as F

from leafwork.functions import columns, tokenizers
from leafwork.functions.partial_json import partial_value
from leafwork.functions.wire import Unreadable
from leafwork.operators import dataset, joins, leaves, metrics, ranges, shapes
from leafwork.sources import files
from leafwork.sources.rows_api import PagedRowsReader


def test_leaves_of_odd_objects(spark):
    texts = [(1, '{"b":[1,{"x":null}],"a.c":"s","e":{},"f":[]}'), (2, None), (3, "no json"), (4, "{}"), (5, "7")]
    got = leaves.json_leaves(spark.createDataFrame(texts, "id long, j string"), "j", "id").collect()
    assert [(r.id, r.ord, r.path_text, r.vtype) for r in got if r.id == 1] == [(1, 0, "<<<a.c>>>", "string"), (1, 1, "b[0]", "number"), (1, 2, "b[1].x", "null"), (1, 3, "e", "empty_object"), (1, 4, "f", "empty_array")]
    assert {r.id for r in got} == {1, 4, 5}
    counted = leaves.leaf_counts(spark.createDataFrame(texts, "id long, j string"), "j", "id").collect()
    assert {r.id: r.leaves for r in counted} == {1: 5, 2: 0, 3: 0, 4: 1, 5: 1}


def test_partitions_make_no_difference(spark):
    df = spark.range(200).select("id", F.to_json(F.struct(F.col("id"), (F.col("id") % 3).alias("m"))).alias("j"))
    one, many = (leaves.json_leaves(df.repartition(n), "j", "id").orderBy("id", "ord").collect() for n in (1, 64))
    assert one == many


def test_split_is_even_and_isolated(spark):
    df = spark.range(103).select("id", F.when(F.col("id") < 100, "s").when(F.col("id") < 102, "t").otherwise("h").alias("shape"))
    got = dataset.stratified_split(df, "shape", "id", 0.1, ["h"]).collect()
    assert sorted(r.id for r in got if r.shape == "s" and r.split == "eval") == list(range(0, 100, 10))
    assert [r.split for r in got if r.shape == "h"] == ["holdout"]
    assert sum(r.split == "eval" for r in got if r.shape == "t") == 1


def test_shuffle_and_sample_hang_on_keys_alone(spark):
    df = spark.range(1000)
    a = [r.id for r in dataset.shuffled(df, "id", seed=3).collect()]
    assert a == [r.id for r in dataset.shuffled(df.repartition(9), "id", seed=3).collect()] and a != sorted(a)
    assert a != [r.id for r in dataset.shuffled(df, "id", seed=4).collect()]
    assert 200 < dataset.sampled(df, 0.3, "id").count() < 400


def test_declaration_of_rows(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":[{"c":"x"}],"d":null}'), (2, '{"a":2,"b":[],"d":true,"e":"only"}')], "id long, j string")
    assert dataset.infer_declaration(df, "j") == "a:n\nb[]:o\nb[].c:s\nd:b?\ne:s?"


@pytest.mark.parametrize(
    "objects, want",
    [
        (['{"a":[{"x":1},{"y":2}]}'], "a[]:o\na[].x:n?\na[].y:n?"),
        (['{"m":null}', '{"m":{"p":1}}', '{"m":[]}'], "m:o?"),
        (['{"m":[]}'], "m[]:s?"),
        (['{"a":[1,null]}'], "a:o"),
        (['{"a":["5",5]}', '{"a":[true]}'], "a:o"),
        (['{"r":[{"v":"5","w":1}]}', '{"r":[{"v":5,"w":1}]}'], "r[]:o"),
        (['{"t":"x\\ny","o":{},"z":{"q":{"d.e":1}}}'], "o:o\nt:t\nz.q.<<<d.e>>>:n"),
        (['{"a":[[1]],"b":null,"c":[{}]}'], "a:o\nb:s?\nc[]:o"),
        (['{"x":1}', '{"x":true}', "[1]", "none"], "x:o"),
    ],
)
def test_declarations_hold(spark, objects, want):
    df = spark.createDataFrame([(o,) for o in objects], "j string")
    assert dataset.infer_declaration(df, "j") == want
    text = columns.encode("j")["text"]
    got = df.select(text.alias("t"), columns.decode(text, want).alias("d")).where("t is not null").collect()
    assert all(r.d.ok and r.d.canonical == r.t for r in got), got


def test_selection_keys_rows_apart(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (1, '{"b":1,"c":2}'), (2, '{"c":2,"b":1}'), (3, "{}"), (4, None), (5, "no")], "id long, j string")
    kept, counts = dataset.selected(df, "j", "id", 2)
    assert [(r.id, r.j, r.leaves) for r in kept.collect()] == [(1, '{"b":1,"c":2}', 2)]
    assert counts.first().asDict() == {"rows": 6, "empty": 3, "small": 1, "kept": 1, "copies": 1}


def test_draws_and_unions(spark):
    df = spark.range(300).select("id", dataset.whole_number(3, 7, "id").alias("n"), dataset.picked_many(["a", "b", "c", "d"], 2, "id").alias("two"))
    got = df.collect()
    assert {r.n for r in got} == set(range(3, 8))
    assert all(len(set(r.two)) == 2 for r in got) and len({tuple(r.two) for r in got}) == 12
    both = dataset.union_of_splits(spark.range(2).withColumn("x", F.lit(1)), spark.range(1)).collect()
    assert sorted((r.id, r.x or 0) for r in both) == [(0, 0), (0, 1), (1, 1)]
    rows = spark.createDataFrame([(i, '{"a":1}') for i in range(9)], "id long, j string")
    assert [r.id for r in dataset.round_tripping(rows, "j", "id", limit=3).collect()] == [0, 1, 2]
    cases = spark.createDataFrame([("a", 10, 5), ("b", 10, 2), ("c", 0, 1)], "name string, json_size long, text_size long")
    assert [r.name for r in metrics.by_saving(cases, "name").collect()] == ["b", "a", "c"]


def test_rates_and_orders(spark):
    assert joins.trial_grid(spark, a=[1, 2], b=["x"]).count() == 2
    df = spark.createDataFrame([("z", 1), ("a", 2), ("m", 3)], "k string, n int")
    assert [r.k for r in joins.ranked_order(df, {"k": ["m", "z"]}).collect()] == ["m", "z", "a"]
    cases = spark.createDataFrame([("g", 0, 5), ("g", 10, 5), ("g", 10, 20)], "g string, json_size long, text_size long")
    r = metrics.savings(cases, "g").first()
    assert (r.cases, r["mean"], r.best, r.worst, r.share_worse) == (3, -0.25, 0.5, -1.0, 0.5)


def test_files(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps([{"name": "a", "group": "g", "value": {"x": [1, None]}}, {"name": "b", "group": "g", "value": {}}]))
    got = {r.name: r.value for r in files.read_cases(spark, str(tmp_path / "cases.json")).collect()}
    assert got == {"a": '{"x":[1,null]}', "b": "{}"}
    (tmp_path / "twice.json").write_text(json.dumps([{"name": "a", "group": "g", "value": {}}] * 2))
    with pytest.raises(Exception, match="named twice"):
        files.read_cases(spark, str(tmp_path / "twice.json")).collect()
    (tmp_path / "holdout.jsonl").write_text("\n".join(json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": t}], "meta": {"shape": "s"}}) for t in ("a=1", "broken", "b: x")))
    good, counts = files.read_holdout(spark, str(tmp_path / "holdout.jsonl"))
    assert sorted(r.value for r in good.collect()) == ['{"a":1}', '{"b":" x"}']
    assert counts.first().asDict() == {"rows": 3, "unreadable": 1}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "x.txt").write_text("a=1\nb=2")
    assert [r.text for r in files.read_documents(spark, str(tmp_path / "docs")).collect()] == ["a=1\nb=2"]
    first = files.write_checkpointed(spark.range(3), str(tmp_path / "run"), "id")
    assert first.count() == 3
    assert files.write_checkpointed(spark.range(5), str(tmp_path / "run"), "id").count() == 5
    files.write_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "lines"))
    assert "".join(f.read_text() for f in (tmp_path / "lines").glob("*.json")).strip() == '{"a":1,"b":null}'


def test_pages_of_a_rows_service():
    reader = PagedRowsReader({"url": "http://localhost/{offset}/{length}", "total": "250", "length": "100", "pages": "2"})
    assert [p.value for p in reader.partitions()] == [(0, 200), (200, 250)]


def test_ranks_of_hot_groups(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 5).alias("g"))
    got = ranges.rank_in_group(df, "g", "k").collect()
    for g in {r.g for r in got}:
        own = sorted((r.k, r["rank"]) for r in got if r.g == g)
        assert [n for _, n in own] == list(range(len(own)))


def test_shapes_are_read_back(spark):
    rows = shapes.generate(spark, 15)
    assert rows.count() == 15 * 2 * 22
    assert [r for r in dataset.round_tripping(rows, "json").groupBy("shape").count().collect() if r["count"] != 30] == []
    assert shapes.variation("large_table", 3) == shapes.variation("large_table", 3) != shapes.variation("large_table", 4)


def test_training_rows(spark):
    df = spark.createDataFrame([(i, json.dumps({"a": {"b": i}, "c": ["x"]})) for i in range(200)], "id long, j string")
    got = dataset.training_rows(df, "j", "id", ["T1", "T2"], instruct=0.5, schema=F.lit("a.b:n\nc[]:s"), with_schema=0.3).collect()
    assert all(r.messages[1].content == f"a.b={r.id}\nc=[\nx\n]" for r in got)
    asked = [r for r in got if r.meta.task == "instruct"]
    assert 60 < len(asked) < 140 and all(f"- a.b is {r.id}\n- c[0] is x" in r.messages[0].content for r in asked)
    assert all(("<schema>\na.b:n" in r.messages[0].content) == r.meta.has_schema for r in got)
    assert 30 < sum(r.meta.has_schema for r in got) < 90
    prompt = spark.range(1).select(dataset.trial_prompt(F.lit("{}"), "leaves", "a=1")).first()[0]
    assert prompt == "Write this object as leaves.\n\nFor example:\na=1\n\n{}"


@pytest.mark.skipif(not tokenizers.installed(), reason="no vocabularies")
def test_token_counts(spark):
    df = spark.createDataFrame([("g", '{"id":1,"name":"some words"}', "id=1\nname=some words"), ("g", None, None)], "g string, j string, t string")
    got = metrics.token_savings(df, "j", "t", tokenizers.installed(), "g").collect()
    assert len({r.tokenizer for r in got}) == len(tokenizers.installed()) >= 3
    assert all(r.cases == 2 and 0 < r.aggregate < 1 for r in got)
    totals = {r.form: (r.documents, r.total) for r in metrics.format_totals(df, "j", "t").collect()}
    assert totals == {"j": (1, 28), "t": (1, 20)}


def test_maps_and_variants(spark):
    df = spark.sql("select struct(map('b', 1.5D, 'a', null) m, parse_json('{\"z\":[1,{}]}') v) s")
    assert df.select(columns.encode_column(F.col("s"), df.schema["s"].dataType)).first()[0] == "m.a=null\nm.b=1.5\nv.z[0]=1\nv.z[1]={}"
    wrong = spark.sql("select struct(map(1, 2) m) s")
    with pytest.raises(Unreadable):
        columns.encode_column(F.col("s"), wrong.schema["s"].dataType)


def test_cut_json():
    text = '{"a":"x\\u00e9\\"y","b":[1,{"c":true,"d":-2.5e3}],"e":null}'
    assert partial_value(text) == json.loads(text)
    assert partial_value("") == partial_value("no") == {}
    wants = {1: {}, 4: {}, 6: {"a": ""}, 8: {"a": "x"}, 13: {"a": "x\u00e9"}, 15: {"a": 'x\u00e9"'}, 24: {"a": 'x\u00e9"y', "b": [1]}, 27: {"a": 'x\u00e9"y', "b": [1, {}]}}
    assert {n: partial_value(text[:n]) for n in wants} == wants
    for n in range(len(text)):
        assert isinstance(partial_value(text[:n]), dict)


def test_shares_at_equal_budgets():
    """By hand: the JSON has 26 bytes, so the cuts leave 2, 5, 7, ... bytes of each form."""
    text = '{"a":1,"b":2,"c":"three"}'
    got = {(form, c): share for form, c, share in metrics.cut_shares(text)}
    forms = {"canonical": "a=1\nb=2\nc=three", "generation": "a=1\nb=2\nc=three", "json": text}
    for (form, c), share in got.items():
        part = forms[form][: len(text) * c // 10]
        seen = {"json": ('"a":1', '"b":2', '"c":"three'), "canonical": ("a=1", "b=2", "c=three"), "generation": ("a=1", "b=2", "c=three")}[form]
        assert share == pytest.approx(sum(x in part for x in seen) / 3)
    assert metrics.cut_shares("{}")[0][2] == 0.0 or metrics.cut_shares("{}")[0][2] == 1.0


@pytest.mark.skipif(not tokenizers.installed(), reason="no vocabularies")
def test_budgets_in_tokens():
    path = next(p for p in tokenizers.installed() if p.endswith(".json"))
    size, beginning = tokenizers.cutter(path)
    text = "some words, and more"
    assert beginning(text, size(text)) == text and text.startswith(beginning(text, 3)) and beginning(text, 0) == ""
