"""Registered queries (name -> callable) and the SQL that checks them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.functions import columns, native, tokenizers
from leafwork.functions.declarations import from_json_schema
from leafwork.functions.wire import FRAME_CLOSE, FRAME_OPEN
from leafwork.operators import dataset, joins, leaves, metrics, shapes
from leafwork.plans import repairs
from leafwork.sources.files import function_calls
from leafwork.sources.scratch import fresh_path
from leafwork.streaming.finalize import FINAL, finalize_batch, finalize_stream

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encoded(df: DataFrame, fields: dict, *keep: str, name: str = "text", **options) -> DataFrame:
    """keep and the text of a struct of the given fields, compiled from its static type."""
    rows = df.select(*keep, F.struct(*[v.alias(k) for k, v in fields.items()]).alias("__s"))
    kind = rows.schema["__s"].dataType
    return rows.select(*keep, native.encode_struct(F.col("__s"), kind, **options).alias(name))


def as_json(df: DataFrame, fields: dict, *keep: str, name: str = "json") -> DataFrame:
    return df.select(*keep, F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"}).alias(name))


def number_sql(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN {x}::BIGINT::VARCHAR ELSE {x}::VARCHAR END"


def c(*names: str) -> dict:
    return {n: F.col(n) for n in names}


# encoding

EVENT_SQL = f"""'event_id=' || event_id || chr(10) || 'event_type=' || event_type || chr(10) || 'props.k=' || (props->>'$.k') || chr(10)
  || 'ts=' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || chr(10) || 'user_id=' || user_id || chr(10) || 'value=' || {number_sql("value")}"""


def events_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    props = F.from_json("props", "struct<k:bigint>")
    return encoded(events, c("event_id", "event_type", "ts", "user_id", "value") | {"props": props}, "event_id")


@query(f"SELECT event_id, {EVENT_SQL} AS text FROM events")
def encode_flat_events(spark, sf_dir):
    return events_text(spark, sf_dir)


@query(
    f"""SELECT c_custkey, '<<< lead>>>=' || c_mktsegment || chr(10) || 'as_text:s=' || c_custkey || chr(10) || '<<<c.key>>>=' || c_custkey || chr(10)
  || 'empty:s=' || chr(10) || '<<<items[0]>>>=' || c_name || chr(10) || 'neg=' || {number_sql("c_acctbal")} || chr(10) || 'nil=null' AS text FROM customer"""
)
def encode_customer_quoting(spark, sf_dir):
    fields = {"c.key": F.col("c_custkey"), "items[0]": F.col("c_name"), " lead": F.col("c_mktsegment"), "as_text": F.col("c_custkey").cast("string")}
    fields |= {"empty": F.lit(""), "neg": F.col("c_acctbal"), "nil": F.lit(None).cast("string")}
    return encoded(table(spark, sf_dir, "customer"), fields, "c_custkey")


@query("SELECT r_regionkey, 'A=1' || chr(10) || '<<<a.b>>>=' || r_name || chr(10) || 'a0=2' || chr(10) || 'b=3' || chr(10) || 'é=4' AS text FROM region")
def utf8_key_order(spark, sf_dir):
    fields = {"é": F.lit(4), "b": F.lit(3), "a0": F.lit(2), "a.b": F.col("r_name"), "A": F.lit(1)}
    return encoded(table(spark, sf_dir, "region"), fields, "r_regionkey")


FORMS_SQL = """
i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, l_partkey, l_quantity) - 1 AS i,
    l_returnflag AS flag, l_linenumber AS n, l_partkey AS part, l_quantity::BIGINT AS qty FROM lineitem),
r AS (SELECT *, '{flag=' || flag || ',n=' || n || ',part=' || part || ',qty=' || qty || '}' AS cells FROM i),
f AS (SELECT l_orderkey, count(*) AS rows, string_agg('items[' || i || ']=' || cells, chr(10) ORDER BY i) AS inline,
    'items::flag,n,part,qty' || chr(10) || string_agg('items[' || i || ']=' || flag || ',' || n || ',' || part || ',' || qty, chr(10) ORDER BY i) AS tab,
    'items=[' || chr(10) || string_agg(cells, chr(10) ORDER BY i) || chr(10) || ']' AS lit FROM r GROUP BY l_orderkey),
b AS (SELECT *, CASE WHEN rows >= 2 AND strlen(tab) < strlen(inline) AND strlen(tab) <= strlen(lit) THEN 'table'
    WHEN strlen(lit) < strlen(inline) THEN 'literal' ELSE 'path' END AS form FROM f)"""
ITEM = {"flag": "l_returnflag", "n": "l_linenumber", "part": "l_partkey", "qty": "l_quantity"}


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, items): an order's lines are its own group, of bounded size."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*[(F.col(v).cast("long") if k == "qty" else F.col(v)).alias(k) for k, v in ITEM.items()]).alias("item"))
    return rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("item")).alias("items"))


@query(f"WITH {FORMS_SQL} SELECT l_orderkey, CASE form WHEN 'table' THEN tab WHEN 'literal' THEN lit ELSE inline END || chr(10) || 'order=' || l_orderkey AS text FROM b")
def encode_orders_table_mode(spark, sf_dir):
    return encoded(order_items(spark, sf_dir), {"order": F.col("l_orderkey"), "items": F.col("items")}, "l_orderkey")


@query(
    f"""WITH {FORMS_SQL} SELECT l_orderkey, strlen(inline) + 1 AS path_bytes, CASE WHEN rows >= 2 THEN strlen(tab) + 1 END AS table_bytes,
  strlen(inline) + 1 AS inline_bytes, strlen(lit) + 1 AS literal_bytes, form FROM b"""
)
def array_mode_costs(spark, sf_dir):
    rows = order_items(spark, sf_dir)
    kind, compiler, path = rows.schema["items"].dataType, native.Compiler(), F.lit("items")
    forms = {"path": compiler.by_path, "table": compiler.table, "inline": compiler.inline_rows, "literal": compiler.literal_rows}
    sizes = rows.select("l_orderkey", *[(F.octet_length(f(path, F.col("items"), kind)) + 1).cast("long").alias(f"{k}_bytes") for k, f in forms.items()])
    ranked = F.filter(F.array(*[F.struct(F.col(f"{k}_bytes").alias("size"), F.lit(i).alias("i"), F.lit(k).alias("form")) for i, k in enumerate(forms)]), lambda x: x["size"].isNotNull())
    return sizes.withColumn("form", F.array_min(ranked)["form"])


@query(
    """WITH i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS i, l_partkey AS p FROM lineitem),
f AS (SELECT l_orderkey, string_agg('parts[' || i || ']=' || p, chr(10) ORDER BY i) AS path, 'parts=[' || chr(10) || string_agg(p, chr(10) ORDER BY i) || chr(10) || ']' AS lit FROM i GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN strlen(lit) < strlen(path) THEN lit ELSE path END AS text FROM f"""
)
def encode_orders_literal(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("parts"))
    return encoded(rows, c("parts"), "l_orderkey")


@query(
    """WITH t AS (SELECT n_nationkey, n_name, 'region={r_name=' || r_name || ',r_regionkey=' || r_regionkey || '}' AS a, 'region.r_name=' || r_name || chr(10) || 'region.r_regionkey=' || r_regionkey AS b
  FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, 'name=' || n_name || chr(10) || CASE WHEN strlen(a) < strlen(b) THEN a ELSE b END AS text FROM t"""
)
def encode_nation_region_inline(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return encoded(rows, {"name": F.col("n_name"), "region": F.struct("r_name", "r_regionkey")}, "n_nationkey")


BODY_SQL = "CASE WHEN contains(text, chr(10)) THEN 'body=<<<' || chr(10) || text || chr(10) || '>>>' WHEN trim(text, ' ' || chr(9)) <> text THEN 'body=<<<' || text || '>>>' WHEN text = '' THEN 'body:s=' ELSE 'body=' || text END"


@query(
    f"""SELECT doc_id, '{FRAME_OPEN}' || chr(10) || CASE WHEN contains(text, chr(10)) THEN 'id=' || doc_id || chr(10) || 'lang=' || lang || chr(10) || {BODY_SQL}
  ELSE {BODY_SQL} || chr(10) || 'id=' || doc_id || chr(10) || 'lang=' || lang END || chr(10) || '{FRAME_CLOSE}' AS text FROM documents"""
)
def encode_generation_profile(spark, sf_dir):
    fields = {"body": F.col("text"), "id": F.col("doc_id"), "lang": F.col("lang")}
    return encoded(table(spark, sf_dir, "documents"), fields, "doc_id", profile="generation", markers=True)


@query(f"SELECT doc_id, {BODY_SQL} || chr(10) || 'id=' || doc_id AS text, true AS same FROM documents")
def multiline_documents(spark, sf_dir):
    rows = encoded(table(spark, sf_dir, "documents"), {"body": F.col("text"), "id": F.col("doc_id")}, "doc_id")
    read = columns.decode(F.col("text"))
    return rows.select("doc_id", "text", (read["canonical"] == F.col("text")).alias("same"))


@query("SELECT event_id, CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END AS text FROM events")
def number_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", columns.double_text("value").alias("text"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'an object is required at top level' WHEN 1 THEN 'non-finite number' END AS error FROM nation")
def encode_refusals(spark, sf_dir):
    m = F.col("n_nationkey") % 3
    text = F.when(m == 0, F.lit("[1]")).when(m == 1, F.lit('{"a": 1e999}')).otherwise(F.lit('{"a": 1}'))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", columns.encode(text)["error"].alias("error"))
    return rows.withColumn("error", F.when(F.col("error").startswith("non-finite number"), F.lit("non-finite number")).otherwise(F.col("error")))


# decoding

EVENT_SCHEMA = "event_id:n\nevent_type:s\nprops.k:n\nts:s\nuser_id:n\nvalue:n"


@query("SELECT event_id, event_type, (props->>'$.k')::BIGINT AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, user_id, value FROM events")
def decode_flat_events(spark, sf_dir):
    rows = events_text(spark, sf_dir).select(columns.decode_typed("text", EVENT_SCHEMA).alias("e"))
    return rows.select(F.col("e.event_id").cast("long").alias("event_id"), "e.event_type", F.col("e.props.k").cast("long").alias("k"), "e.ts", F.col("e.user_id").cast("long").alias("user_id"), "e.value")


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name, c_acctbal AS balance, true AS open, NULL::VARCHAR AS note FROM customer")
def decode_typed_schema(spark, sf_dir):
    fields = {"id": F.col("c_custkey"), "name": F.col("c_name"), "balance": F.col("c_acctbal"), "open": F.lit(True), "note": F.lit(None).cast("string")}
    rows = encoded(table(spark, sf_dir, "customer"), fields)
    return rows.select(columns.decode_typed("text", "id:s\nname:s\nbalance:n\nopen:b\nnote:s?").alias("c")).select("c.*")


@query(f"WITH {FORMS_SQL} SELECT l_orderkey, i, flag, n::DOUBLE AS n, part::DOUBLE AS part, qty::DOUBLE AS qty FROM i")
def decode_table_rows(spark, sf_dir):
    rows = encode_orders_table_mode(spark, sf_dir)
    items = columns.decode_typed("text", "order:n\nitems[].flag:s\nitems[].n:n\nitems[].part:n\nitems[].qty:n", ["items"])
    rows = rows.select("l_orderkey", F.posexplode(items["items"]).alias("i", "x"))
    return rows.select("l_orderkey", F.col("i").cast("long").alias("i"), "x.flag", "x.n", "x.part", "x.qty")


def _case(case: repairs.Case, spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs.decode_case(table(spark, sf_dir, "nation"), case)


for _name, _found in repairs.CASES.items():
    QUERIES[f"decode_{_name}"] = partial(_case, _found)
    ORACLES[f"decode_{_name}"] = repairs.case_sql(_found)


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS ok FROM nation")
def validate_canonical(spark, sf_dir):
    text = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("a=1\nb="), "n_name")).otherwise(F.concat(F.lit("b="), "n_name", F.lit("\na=1")))
    return table(spark, sf_dir, "nation").select("n_nationkey", columns.validate(text)["ok"].alias("ok"))


@query("SELECT c_custkey, 'balance=' || " + number_sql("c_acctbal") + " || chr(10) || 'name=' || c_name AS canonical, true AS idempotent FROM customer")
def fix_idempotent(spark, sf_dir):
    text = F.concat(F.lit("```\nname="), "c_name", F.lit("\nbalance="), F.format_string("%.2f", "c_acctbal"), F.lit("\n```"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", columns.fix(text)["canonical"].alias("canonical"))
    again = columns.fix(F.col("canonical"))
    return rows.select("c_custkey", "canonical", ((again["canonical"] == F.col("canonical")) & (F.size(again["repairs"]) == 0)).alias("idempotent"))


# leaves

@query(
    """SELECT n_nationkey, key, kind, raw FROM nation, LATERAL (VALUES ('id', 'bare', n_nationkey::VARCHAR), ('name', 'tagged', n_name), ('t', 'header', NULL), ('t[0]', 'row', NULL), ('xs', 'literal', NULL), ('b', 'block', 'l1' || chr(10) || n_name)) v(key, kind, raw)"""
)
def text_leaves(spark, sf_dir):
    text = F.concat(F.lit("id="), "n_nationkey", F.lit("\nname:s="), "n_name", F.lit("\nt::a,b\nt[0]=1,2\nxs=[\n1\n]\nb=<<<\nl1\n"), "n_name", F.lit("\n>>>"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", text.alias("text"))
    return leaves.text_leaves(rows, "text", "n_nationkey").select("n_nationkey", "key", "kind", "raw")


def event_fields() -> dict:
    tags = F.array(F.col("event_type"), F.lit("x"))
    return {"id": F.col("event_id"), "props": F.from_json("props", "struct<k:bigint>"), "tags": tags, "value": F.col("value"), "none": F.lit(None).cast("string"), "list": F.array().cast("array<string>")}


def events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(table(spark, sf_dir, "events"), event_fields(), "event_id", "event_type")


EVENT_LEAVES_SQL = """SELECT event_id, path_text, vtype, str, num FROM events, LATERAL (VALUES ('id', 'number', NULL, event_id::DOUBLE), ('list', 'empty_array', NULL, NULL), ('none', 'null', NULL, NULL), ('props.k', 'number', NULL, (props->>'$.k')::DOUBLE),
  ('tags[0]', 'string', event_type, NULL), ('tags[1]', 'string', 'x', NULL), ('value', 'number', NULL, value)) v(path_text, vtype, str, num)"""


@query(EVENT_LEAVES_SQL)
def struct_leaves_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.struct(*[v.alias(k) for k, v in event_fields().items()]).alias("event"))
    return leaves.struct_leaves(rows, "event", "event_id").select("event_id", "path_text", "vtype", "str", "num")


@query(EVENT_LEAVES_SQL)
def json_leaves_events(spark, sf_dir):
    return leaves.json_leaves(events_json(spark, sf_dir), "json", "event_id").select("event_id", "path_text", "vtype", "str", "num")


@query("SELECT event_type, count(*) * 7 AS leaves FROM events GROUP BY event_type")
def leaf_counts(spark, sf_dir):
    found = leaves.leaf_counts(events_json(spark, sf_dir), "json", "event_id", "event_type")
    return found.groupBy("event_type").agg(F.sum("leaves").alias("leaves"))


@query("SELECT path_text, vtype, count(*) * n AS leaves FROM events, (VALUES ('id', 'number', 1), ('list', 'empty_array', 1), ('none', 'null', 1), ('props.k', 'number', 1), ('tags[]', 'string', 2), ('value', 'number', 1)) v(path_text, vtype, n) GROUP BY path_text, vtype, n")
def leaf_profile(spark, sf_dir):
    return leaves.leaf_profile(leaves.json_leaves(events_json(spark, sf_dir), "json", "event_id"))


@query("SELECT n_nationkey, k, columns FROM nation, LATERAL (VALUES ('t[0]', 'a,b'), ('t[1]', 'a,c')) v(k, columns)")
def headers_as_of(spark, sf_dir):
    text = F.concat(F.lit("t::a,b\nt[0]=1,2\nt::a,c\nt[1]=3,"), "n_nationkey")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", text.alias("text"))
    found = joins.headers_as_of(leaves.text_leaves(rows, "text", "n_nationkey"), "n_nationkey")
    return found.select("n_nationkey", F.col("key").alias("k"), F.array_join("columns", ",").alias("columns"))


# measures

def event_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their JSON and canonical text and the sizes of both."""
    events = table(spark, sf_dir, "events")
    fields = {"event_id": F.col("event_id"), "event_type": F.col("event_type"), "user_id": F.col("user_id")}
    both = encoded(events, fields, "event_id", "event_type", "user_id")
    both = both.select("*", F.to_json(F.struct("event_id", "event_type", "user_id")).alias("json"))
    return metrics.case_sizes(both, "json", "text")


SIZES_SQL = """s AS (SELECT event_type, event_id, strlen('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS j,
  strlen('event_id=' || event_id || chr(10) || 'event_type=' || event_type || chr(10) || 'user_id=' || user_id) AS t FROM events)"""


@query(
    f"""WITH {SIZES_SQL} SELECT event_type, count(*) AS cases, round((sum(j) - sum(t)) / sum(j), 9) AS aggregate, round(avg((j - t) / j), 9) AS mean, round(median((j - t) / j), 9) AS median,
  round(max((j - t) / j), 9) AS best, round(min((j - t) / j), 9) AS worst, avg(CASE WHEN t > j THEN 1.0 ELSE 0.0 END)::DOUBLE AS share_worse FROM s GROUP BY event_type"""
)
def savings_by_group(spark, sf_dir):
    found = metrics.savings(event_cases(spark, sf_dir), "event_type")
    return found.select("event_type", "cases", *[F.round(x, 9).alias(x) for x in ("aggregate", "mean", "median", "best", "worst")], "share_worse")


@query(f"WITH {SIZES_SQL} SELECT event_type, round(median((j - t) / j) FILTER (event_id % 2 = 0), 9) AS even, round(median((j - t) / j) FILTER (event_id % 2 = 1), 9) AS odd FROM s GROUP BY event_type")
def savings_pivot(spark, sf_dir):
    cases = event_cases(spark, sf_dir).withColumn("parity", F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd"))
    found = metrics.savings_pivot(cases, "event_type", "parity", ["even", "odd"])
    return found.select("event_type", F.round("even", 9).alias("even"), F.round("odd", 9).alias("odd"))


@query(f"WITH {SIZES_SQL}, f AS (SELECT 'json' AS form, j AS n FROM s UNION ALL SELECT 'text', t FROM s) SELECT form, count(*) AS documents, sum(n)::BIGINT AS total FROM f GROUP BY form")
def format_totals(spark, sf_dir):
    return metrics.format_totals(event_cases(spark, sf_dir), "json", "text")


@query()
def token_savings(spark, sf_dir):
    """Share of tokens saved against JSON, by group and tokenizer, never blended."""
    return metrics.token_savings(event_cases(spark, sf_dir), "json", "text", tokenizers.installed(), "event_type")


SHAPES_SQL = ", ".join(f"('{name}')" for name in shapes.SHAPES)


@query(f"SELECT shape, seed, mode, true AS same FROM (VALUES {SHAPES_SQL}) s(shape), range(20) r(seed), (VALUES ('normal'), ('adversarial')) m(mode)")
def generated_shapes(spark, sf_dir):
    """Generated objects of every shape: whether their texts are read back as they were."""
    return shapes.generate(spark, 20).select("shape", "seed", "mode", columns.round_trip(F.col("json"))["same"].alias("same"))


@query("SELECT count(*) AS documents, 1.0::DOUBLE AS parse, 1.0::DOUBLE AS fidelity, 1.0::DOUBLE AS idempotent FROM events")
def roundtrip_rate(spark, sf_dir):
    return metrics.fidelity(events_json(spark, sf_dir), "json")


@query("SELECT * FROM (SELECT 'markdown_stripped' AS kind, count(*) AS uses FROM nation UNION ALL SELECT 'repeated_keys_indexed', count(*) FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'separator_coerced', count(*) FROM nation WHERE n_nationkey % 2 = 1) WHERE uses > 0")
def repair_usage(spark, sf_dir):
    inner = F.when(F.col("n_nationkey") % 2 == 0, F.lit("a=1\na=2")).otherwise(F.lit("a: 1"))
    text = F.concat(F.lit("```\n"), inner, F.lit("\n```"))
    return metrics.repair_usage(table(spark, sf_dir, "nation").select(columns.decode(text)["repairs"].alias("repairs")))


@query("SELECT event_id, 7 AS leaves, 6 AS found, 6 / 7 AS recovery FROM events")
def leaf_recovery(spark, sf_dir):
    rows = events_json(spark, sf_dir)
    damaged = rows.select("event_id", F.regexp_replace("json", r'"value":[^,]*', '"value":"lost"').alias("json"))
    return metrics.recovery(leaves.json_leaves(rows, "json", "event_id"), leaves.json_leaves(damaged, "json", "event_id"), "event_id")


@query()
def recovery_curve(spark, sf_dir):
    """Generated objects of every shape, cut at equal budgets: what is read of each profile and of the JSON."""
    return metrics.truncation_curve(shapes.generate(spark, 3), "json", "mode")


@query()
def shape_savings(spark, sf_dir):
    """Tokens saved against JSON by shape and tokenizer, over generated objects."""
    rows = shapes.generate(spark, 5).where("mode = 'normal'")
    return metrics.token_savings(rows.withColumn("text", columns.encode(F.col("json"))["text"]), "json", "text", tokenizers.installed(), "shape")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as if they were trials: user as model, type as shape, text sizes as tokens."""
    m = F.col("event_id") % 5
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", (m != 0).alias("parsed"), (m > 1).alias("faithful"), F.when(m == 2, F.array(F.lit("x"))).otherwise(F.array()).alias("repairs"))
    return rows.withColumn("tokens", (F.col("event_id") % 7).cast("double"))


@query(
    """SELECT event_type, count(*) AS trials, avg(CASE WHEN event_id % 5 <> 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS parse_rate, avg(CASE WHEN event_id % 5 > 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS fidelity_rate,
  avg(CASE WHEN event_id % 5 = 2 THEN 1.0 ELSE 0.0 END)::DOUBLE AS repair_rate, avg((event_id % 7)::DOUBLE) AS mean_tokens FROM events GROUP BY event_type"""
)
def trial_rates(spark, sf_dir):
    return metrics.trial_rates(trials(spark, sf_dir), "event_type")


@query("SELECT event_id, event_type FROM events WHERE event_id % 5 <= 1 ORDER BY event_id LIMIT 8")
def top_failures(spark, sf_dir):
    return metrics.top_failures(trials(spark, sf_dir), 8, "event_id").select("event_id", "event_type")


# joins, orders and preparation

@query("SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def unknown_keys(spark, sf_dir):
    known = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"))
    return joins.unknown(table(spark, sf_dir, "customer").select("c_nationkey").distinct(), known, "c_nationkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def chosen_keys(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.chosen(table(spark, sf_dir, "orders"), wanted, "o_custkey").select("o_orderkey")


@query("SELECT model, format, trial::INTEGER AS trial FROM (VALUES ('a'), ('b')) m(model), (VALUES ('json'), ('leaf')) f(format), (VALUES (1), (2), (3)) t(trial)")
def trial_grid(spark, sf_dir):
    return joins.trial_grid(spark, model=["a", "b"], format=["json", "leaf"], trial=[1, 2, 3])


@query("SELECT n_nationkey, n_name FROM nation")
def ranked_order(spark, sf_dir):
    return joins.ranked_order(table(spark, sf_dir, "nation"), {"n_regionkey": [3, 1, 2]}, "n_name").select("n_nationkey", "n_name")


@query("SELECT event_type, min(event_id) AS first_position FROM events GROUP BY event_type")
def first_seen(spark, sf_dir):
    return joins.first_seen(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS occurrence FROM events")
def key_occurrence(spark, sf_dir):
    return joins.occurrence(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", order="event_id")


@query("SELECT event_type, (props->>'$.k')::BIGINT AS k, min(event_id) AS event_id FROM events GROUP BY ALL")
def dedup_canonical(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "struct<k:bigint>")["k"])
    rows = as_json(rows, c("event_type", "k"), "event_id", "event_type", "k")
    return dataset.deduplicated(dataset.with_canonical_key(rows, "json"), "canonical", "event_id").select("event_type", "k", "event_id")


@query(
    """WITH e AS (SELECT event_type, (props->>'$.k')::BIGINT AS k, event_id % 4 AS m FROM events)
SELECT count(*) AS rows, count(*) FILTER (m = 0) AS empty, count(*) FILTER (m = 1) AS small, count(DISTINCT CASE WHEN m > 1 THEN event_type || k END) AS kept,
  count(*) FILTER (m > 1) - count(DISTINCT CASE WHEN m > 1 THEN event_type || k END) AS copies FROM e"""
)
def selection_counts(spark, sf_dir):
    m, k = F.col("event_id") % 4, F.from_json("props", "struct<k:bigint>")["k"]
    text = F.when(m == 0, F.lit("{}")).when(m == 1, F.lit('{"a":1}')).otherwise(F.to_json(F.struct("event_type", k.alias("k"))))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("json"))
    return dataset.selected(rows, "json", "event_id", 2)[1]


@query("SELECT event_id FROM events WHERE event_id % 2 = 0")
def round_trip_filter(spark, sf_dir):
    text = F.when(F.col("event_id") % 2 == 0, F.lit('{"a":"x"}')).otherwise(F.lit('{"a>>>":1}'))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("json"))
    return dataset.round_tripping(rows, "json").select("event_id")


@query(
    """WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n, max(event_type) OVER () AS last FROM events),
c AS (SELECT *, ceil(0.1 * n)::BIGINT AS c FROM r),
p AS (SELECT DISTINCT event_type, floor(j * n / c) AS p FROM c, LATERAL (SELECT unnest(range(c)) AS j))
SELECT event_id, CASE WHEN c.event_type = last THEN 'holdout' WHEN p.p IS NULL THEN 'train' ELSE 'eval' END AS split FROM c LEFT JOIN p ON c.event_type = p.event_type AND c.r = p.p"""
)
def stratified_split(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("event_type")).first()[0]
    return dataset.stratified_split(events, "event_type", "event_id", 0.1, [last]).select("event_id", "split")


@query(
    """SELECT * FROM (VALUES ('event_id', 'n', false), ('event_type', 's', true), ('props.k', 'n', false), ('rows[]', 'o', false), ('rows[].even', 'n', true), ('rows[].id', 'n', false),
  ('rows[].odd', 'n', true), ('some', 'o', true), ('tags[]', 's', false), ('none[]', 's', true)) v(path, code, optional)"""
)
def infer_declaration(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    even = F.map_filter(F.create_map(F.lit("id"), F.col("event_id"), F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd"), F.col("user_id")), lambda k, v: k != "")
    fields = {"event_id": F.col("event_id"), "event_type": kind, "props": F.from_json("props", "struct<k:bigint>"), "tags": F.array(F.lit("a"), F.lit("b"))}
    fields |= {"rows": F.array(even), "some": F.when(F.col("event_id") % 5 == 0, F.struct(F.lit(1).alias("x"))), "none": F.array().cast("array<string>")}
    return dataset.inferred_fields(as_json(table(spark, sf_dir, "events"), fields, "event_id"), "json").select(F.inline("fields"))


@query(f"SELECT shape, 40 AS objects, 40 AS declared, 40 AS found FROM (VALUES {SHAPES_SQL}) v(shape)")
def declared_shapes(spark, sf_dir):
    """Generated objects of every shape, read back by declarations inferred from each: all come back as they were."""
    rows = shapes.generate(spark, 20).withColumn("text", columns.encode(F.col("json"))["text"])
    rows = rows.join(dataset.declarations(rows, "json", "shape", "seed", "mode"), ["shape", "seed", "mode"])
    read = columns.decode_by(F.col("text"), F.col("declaration"))
    rows = rows.select("shape", "declaration", (read["ok"] & (read["canonical"] == F.col("text"))).alias("same"))
    return rows.groupBy("shape").agg(F.count("*").alias("objects"), F.count_if(F.col("declaration").isNotNull()).alias("declared"), F.count_if("same").alias("found"))


@query()
def training_rows(spark, sf_dir):
    rows = as_json(table(spark, sf_dir, "customer"), c("c_custkey", "c_name"), "c_custkey")
    return dataset.training_rows(rows, "json", "c_custkey", ["Write this as leaves:", "Encode:", "Translate:"])


@query()
def shuffled_sample(spark, sf_dir):
    return dataset.shuffled(dataset.sampled(table(spark, sf_dir, "customer"), 0.5, "c_custkey"), "c_custkey").select("c_custkey")


@query("SELECT event_type, event_id % 2 AS mode, count(*) AS rows FROM events GROUP BY ALL")
def shape_stats(spark, sf_dir):
    return dataset.shape_stats(table(spark, sf_dir, "events").withColumn("mode", F.col("event_id") % 2), "event_type", "mode")


@query("SELECT n_nationkey, 0 AS n, 'look_up' AS name, '{\"id\":' || n_nationkey || '}' AS arguments FROM nation")
def transcript_calls(spark, sf_dir):
    call = F.concat(F.lit('USER: x\nASSISTANT: <functioncall> {"name": "look_up", "arguments": \'{"id":'), "n_nationkey", F.lit("}'} <|endoftext|>\nUSER: <functioncall> broken <|endoftext|>"))
    return function_calls(table(spark, sf_dir, "nation").select("n_nationkey", call.alias("chat")), "chat", "n_nationkey")


TURNS_SQL = """t AS (SELECT conv_id::VARCHAR AS doc_id, turn, 't' || turn || '.role=' || role || chr(10) || 't' || turn || '.text=<<<' || chr(10) || text || chr(10) || '>>>' || chr(10) AS lines,
  't' || turn AS name, '{"role":' || to_json(role) || ',"text":' || to_json(text) || '}' AS value FROM conversations)"""
CONVERSATION_SQL = """string_agg(lines, '' ORDER BY turn) AS text, '{' || string_agg(to_json(name) || ':' || value, ',' ORDER BY name) || '}' AS value, 0 AS errors"""


def conversation_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seq, delta, last): each turn's role and text as two pieces of the conversation's document, some of them sent twice."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), "turn", "role", "text")
    turns = turns.join(turns.groupBy("doc_id").agg(F.max("turn").alias("end")), "doc_id")
    name = F.concat(F.lit("t"), F.col("turn").cast("string"))
    parts = F.array(F.concat(name, F.lit(".role="), "role", F.lit("\n")), F.concat(name, F.lit(".text=<<<\n"), "text", F.lit("\n>>>\n")))
    rows = turns.select("doc_id", "turn", "end", F.posexplode(parts).alias("half", "delta"))
    rows = rows.select("doc_id", (F.col("turn") * 2 + F.col("half")).cast("long").alias("seq"), "delta", ((F.col("turn") == F.col("end")) & (F.col("half") == 1)).alias("last"))
    return rows.union(rows.where("seq % 3 = 0"))


@query(f"WITH {TURNS_SQL} SELECT doc_id, {CONVERSATION_SQL}, false AS truncated FROM t GROUP BY doc_id")
def conversation_finalize(spark, sf_dir):
    found = finalize_batch(conversation_deltas(spark, sf_dir))
    return found.select("doc_id", "text", "read.value", F.size("read.errors").alias("errors"), "read.truncated")


@query(f"WITH {TURNS_SQL} SELECT doc_id, {CONVERSATION_SQL}, false AS truncated FROM t GROUP BY doc_id")
def conversation_stream(spark, sf_dir):
    """The same through a stream, to its end; what it gives is written to a table and read back."""
    source, out, state = (fresh_path(spark, k) for k in ("deltas", "finished", "progress"))
    conversation_deltas(spark, sf_dir).write.parquet(source)
    # event time, of which there is one moment, so that the stream has an end
    stream = spark.readStream.schema("doc_id string, seq long, delta string, last boolean").parquet(source).withColumn("at", F.lit("2024-01-01").cast("timestamp")).withWatermark("at", "1 minute")
    started = finalize_stream(stream, event_time="at").writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
    if not started.awaitTermination(3600):
        started.stop()
        raise TimeoutError("the stream has not come to its end")
    return spark.read.schema(FINAL).parquet(out).select("doc_id", "text", "value", "errors", "truncated")


@query("SELECT 'to:s' || chr(10) || 'cc[]:s?' || chr(10) || 'user:o?' || chr(10) || 'user.id:n' || chr(10) || 'rows[]:o' AS declaration, 'pair' AS degraded")
def schema_bridge(spark, sf_dir):
    schema = {
        "properties": {
            "to": {"type": "string"},
            "cc": {"type": "array", "items": {"type": "string"}},
            "user": {"type": "object", "properties": {"id": {"type": "integer"}}, "required": ["id"]},
            "rows": {"type": "array", "items": {"type": "object"}},
            "pair": {"type": "array", "items": [{"type": "string"}, {"type": "number"}]},
        },
        "required": ["to", "rows", "pair"],
    }
    text, degraded = from_json_schema(schema)
    return spark.createDataFrame([(text, ",".join(degraded))], T.StructType([T.StructField("declaration", T.StringType()), T.StructField("degraded", T.StringType())]))
