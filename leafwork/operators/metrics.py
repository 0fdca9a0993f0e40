"""Measures over encoded documents: size against JSON, fidelity, repairs, recovery."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions import columns, tokenizers
from leafwork.functions.decoding import decode_lenient_text
from leafwork.functions.encoding import encode_value
from leafwork.functions.partial_json import partial_value
from leafwork.functions.wire import Unreadable
from leafwork.operators.leaves import same_value, steps_text, walk


def byte_size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def case_sizes(df: DataFrame, json: str, text: str, size=byte_size) -> DataFrame:
    """df with json_size and text_size by any size function of a text column (tokens, bytes)."""
    return df.withColumns({"json_size": size(F.col(json)), "text_size": size(F.col(text))})


def saving(json_size: Column, text_size: Column) -> Column:
    """Share saved against JSON; null where JSON has size 0, so that such cases are left out."""
    return F.when(json_size != 0, (json_size - text_size) / json_size)


def savings(cases: DataFrame, *groups: str) -> DataFrame:
    """Per group: cases, total share saved, mean, median, best and worst case, and share of cases that are larger than JSON."""
    cases = cases.withColumn("__saved", saving(F.col("json_size"), F.col("text_size")))
    total = (F.sum("json_size") - F.sum("text_size")) / F.nullif(F.sum("json_size"), F.lit(0))
    return cases.groupBy(*groups).agg(
        F.count("*").alias("cases"),
        total.alias("aggregate"),
        F.avg("__saved").alias("mean"),
        F.median("__saved").alias("median"),
        F.max("__saved").alias("best"),
        F.min("__saved").alias("worst"),
        F.avg((F.col("__saved") < 0).cast("double")).alias("share_worse"),
    )


def token_savings(df: DataFrame, json: str, text: str, vocabularies: list[str], *groups: str) -> DataFrame:
    """savings by group and tokenizer (the file name of its vocabulary), each counted on its own."""
    sizes = F.array(
        *[F.struct(F.lit(tokenizers.name_of(p)).alias("tokenizer"), tokenizers.token_count(json, p).alias("json_size"), tokenizers.token_count(text, p).alias("text_size")) for p in vocabularies]
    )
    return savings(df.select(*groups, F.inline(sizes)), *groups, "tokenizer")


def format_totals(df: DataFrame, *forms: str, size=byte_size) -> DataFrame:
    """(form, documents, total): the size of all documents in each of some forms, given as text columns."""
    sizes = F.array(*[F.struct(F.lit(f).alias("form"), size(F.col(f)).alias("n")) for f in forms])
    return df.select(F.inline(sizes)).groupBy("form").agg(F.count("n").alias("documents"), F.sum("n").alias("total"))


def savings_pivot(cases: DataFrame, rows: str, measure: str, measures: list[str]) -> DataFrame:
    """Median share saved, a row per rows and a column per measure (a bounded, given list)."""
    cases = cases.withColumn("__saved", saving(F.col("json_size"), F.col("text_size")))
    return cases.groupBy(rows).pivot(measure, measures).agg(F.median("__saved"))


def fidelity(df: DataFrame, json: str) -> DataFrame:
    """One row: documents, and the shares whose text is read, equals the object, and is a fixed point. One pass over each document."""
    rows = df.select(columns.round_trip(F.col(json)).alias("r"))
    share = lambda x: F.avg(F.coalesce(F.col(x), F.lit(False)).cast("double"))
    return rows.agg(F.count("*").alias("documents"), share("r.ok").alias("parse"), share("r.same").alias("fidelity"), share("r.fixed").alias("idempotent"))


def by_saving(cases: DataFrame, *then: str) -> DataFrame:
    """Cases with the share each saves, the best first; those without a size last."""
    return cases.withColumn("saved", saving(F.col("json_size"), F.col("text_size"))).orderBy(F.desc_nulls_last("saved"), *then)


def trial_rates(trials: DataFrame, *groups: str) -> DataFrame:
    """Per group of trials (parsed, faithful, repairs, tokens): rates and mean tokens."""
    return trials.groupBy(*groups).agg(
        F.count("*").alias("trials"),
        F.avg(F.col("parsed").cast("double")).alias("parse_rate"),
        F.avg(F.col("faithful").cast("double")).alias("fidelity_rate"),
        F.avg((F.size("repairs") > 0).cast("double")).alias("repair_rate"),
        F.avg("tokens").alias("mean_tokens"),
    )


def repair_usage(df: DataFrame, repairs: str = "repairs") -> DataFrame:
    """Uses of each kind of repair, most used first."""
    found = df.select(F.explode(repairs).alias("r")).groupBy(F.col("r.kind").alias("kind")).agg(F.count("*").alias("uses"))
    return found.orderBy(F.desc("uses"), "kind")


def top_failures(trials: DataFrame, n: int = 8, *order: str) -> DataFrame:
    """The first n trials that failed, in the given order."""
    return trials.where("not parsed or not faithful").orderBy(*order).limit(n)


def recovery(original: DataFrame, recovered: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, leaves, found, recovery): of each document's leaves, the share that recovered has with the same value.

    Both are leaf tables with key, path_text, vtype and the values. A document with nothing recovered has 0.
    """
    value = F.struct("vtype", "str", "num", "bool")
    left = original.select(key, "path_text", value.alias("v"))
    right = recovered.select(key, "path_text", value.alias("w"))
    rows = left.join(right, [key, "path_text"], "left").groupBy(key)
    return rows.agg(F.count("*").alias("leaves"), F.count_if(F.col("v").eqNullSafe(F.col("w"))).alias("found")).withColumn("recovery", F.col("found") / F.col("leaves"))


FORMS = ("canonical", "generation", "json")


def _share_found(wanted: dict, got: object) -> float:
    found = {steps_text(steps): v for steps, v in walk(got)}
    return sum(k in found and same_value(found[k], v) for k, v in wanted.items()) / len(wanted)


def cut_shares(text: str, cuts: int = 9, vocabulary: str | None = None) -> list[tuple[str, int, float]]:
    """(form, cut, share) of a JSON object: the share of its leaves that is read from each form's beginning.

    Cut c of cuts leaves every form the same: c / (cuts + 1) of the size of the minified JSON, in tokens of a
    vocabulary or in bytes. Both profiles are read leniently; the JSON is read as far as it goes.
    """
    value = columns.loads(text)
    size, beginning = tokenizers.cutter(vocabulary)
    wanted = {steps_text(steps): v for steps, v in walk(value)}
    made = {"canonical": encode_value(value), "generation": encode_value(value, "generation"), "json": columns.dumps(value)}
    budget, out = size(made["json"]), []
    for form in FORMS:
        for c in range(1, cuts + 1):
            part = beginning(made[form], budget * c // (cuts + 1))
            got = partial_value(part, columns.loads) if form == "json" else decode_lenient_text(part).value
            out.append((form, c, _share_found(wanted, got)))
    return out


def truncation_curve(df: DataFrame, json: str, *groups: str, cuts: int = 9, vocabulary: str | None = None) -> DataFrame:
    """(groups, form, cut, documents, recovery): mean share of leaves read from forms cut at equal budgets.

    See cut_shares. Each document is read in one pass and its shares are summed in its batch; what is no JSON object is passed over.
    """
    kinds = "".join(f"`{g}` {df.schema[g].dataType.simpleString()}, " for g in groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple, list] = {}
            for i, text in enumerate(b.column(len(groups)).to_pylist()):
                try:
                    found = [] if text is None else cut_shares(text, cuts, vocabulary)
                except (Unreadable, ValueError):
                    continue
                own = tuple(b.column(k)[i].as_py() for k in range(len(groups)))
                for form, cut, share in found:
                    one = sums.setdefault((*own, form, cut), [0, 0.0])
                    one[0] += 1
                    one[1] += share
            rows = [(*k, *v) for k, v in sums.items()]
            types = [*(b.schema.field(k).type for k in range(len(groups))), pa.string(), pa.int32(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[*groups, "form", "cut", "documents", "share"])

    found = df.select(*groups, json).mapInArrow(run, f"{kinds}form string, cut int, documents long, share double")
    return found.groupBy(*groups, "form", "cut").agg(F.sum("documents").alias("documents"), (F.sum("share") / F.sum("documents")).alias("recovery"))
