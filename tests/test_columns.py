"""Column functions, and the compiler from struct types against them."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.functions import columns, native, native_decode
from leafwork.functions.declarations import parse_declaration, spark_type
from leafwork.functions.wire import Unreadable
from leafwork.operators import leaves

POOL = ["", "a", " b", "c,d", "{x=1}", "{x=1", "<<<y>>>", "<<<", "[]", "{}", "true", "1e5", "01", "x=[", "[", "]", ">>>", "p\nq", "a\n>>>\nb", "e\rf", "z=<<<ab", "né😀", "null", "}", ":", "1.50"]
NUMBERS = [0.0, -0.0, 1.5, -2.25, 1e21, 1e-7, 123456789.125, 2e23, None, 5e-324, 1e6, 1.7976931348623157e308]
FIELD = T.StructField
STRUCT = T.StructType(
    [
        FIELD("a", T.StringType()),
        FIELD("b.c", T.StringType()),
        FIELD("n", T.LongType()),
        FIELD("d", T.DoubleType()),
        FIELD("o", T.StructType([FIELD("k", T.StringType()), FIELD("m", T.DoubleType())])),
        FIELD("arr", T.ArrayType(T.StringType())),
        FIELD("rows", T.ArrayType(T.StructType([FIELD("x", T.StringType()), FIELD("y", T.LongType())]))),
        FIELD("deep", T.StructType([FIELD("l", T.ArrayType(T.ArrayType(T.LongType()))), FIELD("t", T.BooleanType())])),
    ]
)


def rows(n):
    rng = random.Random(3)
    text = lambda: rng.choice([*POOL, None])
    pair = lambda: rng.choice([(text(), rng.choice([1, 2, None])), None]) if rng.random() < 0.1 else (text(), 1)
    out = []
    for i in range(n):
        arr, table = (rng.choice([None, [f() for _ in range(rng.randint(0, 4))]]) for f in (text, pair))
        deep = rng.choice([None, ([[1, 2], [], None][: rng.randint(0, 3)], rng.choice([True, False, None]))])
        out.append((i, (text(), text(), rng.choice([1, -5, 10**12, None]), rng.choice(NUMBERS), rng.choice([None, (text(), rng.choice(NUMBERS))]), arr, table, deep)))
    return out


@pytest.fixture(scope="module")
def structs(spark):
    return spark.createDataFrame(rows(600), T.StructType([FIELD("i", T.LongType()), FIELD("s", STRUCT)]))


def as_json():
    return F.to_json("s", {"ignoreNullFields": "false"})


@pytest.mark.parametrize("profile", ["canonical", "generation"])
@pytest.mark.parametrize("markers", [False, True])
def test_compiler_against_kernel(structs, profile, markers):
    both = structs.select(native.encode_struct(F.col("s"), STRUCT, profile, markers).alias("a"), columns.encode(as_json(), profile, markers)["text"].alias("b"))
    assert [(r.a, r.b) for r in both.collect() if r.a != r.b] == []


def test_round_trip_and_validation(structs):
    text = columns.encode(as_json())["text"]
    for r in structs.select(text.alias("text"), columns.decode(text).alias("d"), columns.validate(text).alias("v"), columns.fix(text).alias("f")).collect():
        assert r.d.ok and r.d.repairs == [] and r.d.canonical == r.text
        assert r.v.ok and r.f.canonical == r.text


def test_values_that_expressions_leave_to_the_kernel(spark):
    big = [2**53 + 1, -(2**53) - 1, 2**63 - 1, 10**18 + 1, 2**53, 999]
    doubles = [1e-7, 0.1 + 0.2, 1e9, 123456789.1234567, 5e-324, 1e300, 2.5]
    decimals = ["1e24", "0.0000001", "12345678901234567890.5", "1.50", "-0.000001", "99999999999999999999999999999999999999", "7"]
    texts = ["{a=1}", "{a}", "{a=1,a=2}", "{a={b=1}}", "x"]
    n = 35
    rows = [(big[i % 6], doubles[i % 7], texts[i % 5], [big[i % 6], 1], [{"x": doubles[i % 7], "y": texts[i % 5]}] * 2, [texts[i % 5], "b"]) for i in range(n)]
    df = spark.createDataFrame(rows, "l long, d double, s string, ls array<long>, rows array<struct<x:double,y:string>>, ss array<string>")
    df = df.select(F.struct("*").alias("s"))
    dec = spark.createDataFrame([(d,) for d in decimals], "d string").select(F.struct(F.col("d").cast("decimal(38,7)").alias("d"), F.col("d").cast("float").alias("f")).alias("s")).where("s.d is not null")
    for frame in (df, dec):
        kind = frame.schema["s"].dataType
        for profile in ("canonical", "generation"):
            both = frame.select(native.encode_struct(F.col("s"), kind, profile).alias("a"), columns.encode(as_json(), profile)["text"].alias("b"), columns.validate(native.encode_struct(F.col("s"), kind)).alias("v"))
            found = both.collect()
            assert [(r.a, r.b) for r in found if r.a != r.b] == []
            assert all(r.v.ok for r in found)
    kind = T.StructType([FIELD("x", T.ArrayType(T.DoubleType()))])
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="non-finite"):
            spark.range(1).select(native.encode_struct(F.struct(F.array(F.lit(bad)).alias("x")), kind)).collect()
    with pytest.raises(native.NotStatic):
        native.encode_struct(F.lit(None), T.StructType([FIELD("m", T.MapType(T.StringType(), T.LongType()))]))


def test_static_refusals():
    with pytest.raises(Unreadable):
        native.encode_struct(F.struct(F.lit(1).alias("a>>>")), T.StructType([FIELD("a>>>", T.IntegerType())]))
    with pytest.raises(Unreadable):
        columns.decode("x", "id:q")


def test_types_without_a_literal(spark):
    df = spark.sql("select timestamp_ntz'2024-01-02 03:04:05.6' ts, date'2024-01-02' d, cast('hi' as binary) b, cast(1.50 as decimal(5,2)) m, true t, cast(null as void) v, cast(null as array<bigint>) l")
    df = df.select(F.struct("*").alias("s"))
    got = df.select(native.encode_struct(F.col("s"), df.schema["s"].dataType)).first()[0]
    assert got == "b=aGk=\nd=2024-01-02\nl=null\nm=1.5\nt=true\nts=2024-01-02T03:04:05.600000\nv=null"


def test_nulls_and_errors(spark):
    df = spark.createDataFrame([(None,), ("",), ("not json",), ("[1]",), ('{"a":1,"a":2}',)], "j string")
    got = df.select(columns.encode("j").alias("e"), columns.decode("j").alias("d"), columns.decode_lenient("j").alias("l")).collect()
    assert got[0].e is None and got[0].d is None and got[0].l is None
    assert got[1].e.error and got[1].d.value == "{}"
    assert got[2].e.error and got[2].d.error and len(got[2].l.errors) == 1
    assert got[3].e.error and got[4].e.text == "a=2"


def test_typed_decoding_and_sql_names(spark):
    text = F.lit("id=7\nname=x\ntags=[\n1\n]\no.k=true")
    got = spark.range(1).select(columns.decode_typed(text, "id:n\nname:s\ntags[]:s\no.k:b").alias("t"), columns.decode_typed(text, "id:n\nname:s\ntags[]:s\no.k:b", ["id"]).alias("u"), columns.decode_variant(text).alias("v"))
    r = got.select("t", "u", F.variant_get("v", "$.name", "string").alias("name")).first()
    assert r.t.asDict(True) == {"id": 7.0, "name": "x", "tags": ["1"], "o": {"k": True}}
    assert r.u.asDict() == {"id": 7.0} and r.name == "x"
    columns.register(spark)
    assert spark.sql("select leaf_decode('a: 1').canonical c, leaf_encode('{\"b\":[]}').text t, leaf_number(1e21D) n").first().asDict() == {"c": "a=<<< 1>>>", "t": "b=[]", "n": "1e+21"}
    rows = spark.sql("select leaf_fix('a: 1').canonical f, leaf_decode_by('a=5', 'a:s').value d, leaf_validate_by('a=5', 'b:n').ok v, leaf_decode_lenient_by('a=5', 'a:s').value l").first()
    assert rows.asDict() == {"f": "a=<<< 1>>>", "d": '{"a":"5"}', "v": False, "l": '{"a":"5"}'}
    found = spark.sql("select t.id, l.path_text, l.num from values (1, '{\"a\":[1,2]}'), (2, null) t(id, j), lateral leaf_leaves(t.j) l order by l.ord").collect()
    assert [tuple(r) for r in found] == [(1, "a[0]", 1.0), (1, "a[1]", 2.0)]


SCHEMA = "id:n\nname:s\no.flag:b?\no.note:t?\nx:n?"


def test_flat_texts_by_expressions_and_by_the_kernel(spark):
    """Whatever the text, the struct is the one that the kernel's value gives."""
    rng, texts = random.Random(7), []
    values = ["1", "-2.5", "1e999", "01", "true", "false", "null", "", "x", "a=b", "a=[", "q={ ", "z=<<", "<<<y>>>", "[]", "{}", "{a=1}", " pad", "pad ", "é😀", "a\u2028b", "1e5", "<", "k=<<<ab", "x\r", "-0", "1.", "Infinity", "NaN", "a:b", "5e-324", "<<<", ">>>"]
    for _ in range(3000):
        names = rng.sample(["id", "name", "o.flag", "o.note", "x"], rng.randint(3, 5))
        names = sorted(names) if rng.random() < 0.8 else names
        good = {"id": ["1", "-2.5", "1e5"], "x": ["7", "null"], "o.flag": ["true", "false", "null"], "name": ["x", "a=b", "null", "5"], "o.note": ["x y", "null"]}
        lines = [f"{n}{rng.choice(['=', '=', '=', '=', '=', '=', '=', ':s=', ': '])}{rng.choice(values) if rng.random() < 0.15 else rng.choice(good[n])}" for n in names]
        if rng.random() < 0.2:
            lines.insert(rng.randint(0, len(lines)), rng.choice(["", "id=3", "more=1", "o={", "}", "```", "id[0]=1", ">>>", "x::a,b", " id=1", "o=5", "]"]))
        texts.append("\n".join(lines))
    texts += [None, "", "id=1", "id=1\nname=x", "```\nid=1\nname=x\n```", "\nid=1\nname=x\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(2)
    declared = parse_declaration(SCHEMA)
    assert native_decode.is_flat(declared) and not any(native_decode.is_flat(parse_declaration(d)) for d in ("a[]:s", "a:o", "<<<a.b>>>:s", "u:o?\nu.a:s"))
    flat, _ = native_decode.flat_fields(F.col("t"), declared, spark_type(declared))
    got = df.select("t", columns.decode_typed("t", SCHEMA).alias("a"), F.from_json(columns.decode_value("t", SCHEMA), spark_type(declared)).alias("b"), flat.alias("flat")).collect()
    assert [(r.t, r.a, r.b) for r in got if r.a != r.b] == []
    assert 200 < sum(r.flat for r in got) < 2800


def test_leaves_of_structs_are_those_of_their_json(structs):
    names = ["i", "ord", "path_text", "vtype", "str", "num", "bool"]
    a = leaves.struct_leaves(structs, "s", "i").select(*names).collect()
    b = leaves.json_leaves(structs.withColumn("j", as_json()), "j", "i").select(*names).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
