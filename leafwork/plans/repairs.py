"""Queries that read damaged and declared texts, built from nation, and what they have to give.

Each case: the text (SQL that both engines read), the declaration, how it is read, and SQL for the expected
value as JSON (None where reading is refused), repairs, errors and canonical text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.functions import columns
from leafwork.functions.wire import FRAME_CLOSE, FRAME_OPEN

NL = "chr(10)"


@dataclass
class Case:
    text: str
    value: str | None
    repairs: str = ""
    schema: str | None = None
    lenient: bool = False
    errors: int = 0
    truncated: bool = False
    canonical: str | None = None


def lines(*parts: str) -> str:
    return f" || {NL} || ".join(parts)


ID, NAME = "n_nationkey", "n_name"
CASES: dict[str, Case] = {
    "repeated_keys": Case(lines(f"'id=' || {ID}", f"'tag=' || {NAME}", "'tag=x'"), f"""'{{"id":' || {ID} || ',"tag":["' || {NAME} || '","x"]}}'""", "repeated_keys_indexed"),
    "separator_coerced": Case(f"'name: ' || {NAME}", f"""'{{"name":" ' || {NAME} || '"}}'""", "separator_coerced", canonical=f"'name=<<< ' || {NAME} || '>>>'"),
    "fence": Case(lines("'```text'", f"'id=' || {ID}", "'```'"), f"""'{{"id":' || {ID} || '}}'""", "markdown_stripped", canonical=f"'id=' || {ID}"),
    "crlf": Case(f"'id=' || {ID} || chr(13) || {NL} || 'name=' || {NAME} || chr(13) || {NL}", f"""'{{"id":' || {ID} || ',"name":"' || {NAME} || '"}}'""", "line_endings_normalized"),
    "stray_cr": Case(f"'id=' || {ID} || {NL} || 'name=' || {NAME} || chr(13) || {NL} || 'z=1'", f"""'{{"id":' || {ID} || ',"name":"' || {NAME} || '","z":1}}'""", "line_endings_normalized"),
    "markers": Case(lines(f"'{FRAME_OPEN}'", f"'id=' || {ID}", f"'{FRAME_CLOSE}'"), f"""'{{"id":' || {ID} || '}}'""", "mode_markers_stripped"),
    "truncated": Case(lines(f"'{FRAME_OPEN}'", f"'id=' || {ID}", "'na'"), f"""'{{"id":' || {ID} || '}}'""", "missing_close_marker,mode_markers_stripped", lenient=True, errors=1, truncated=True),
    "braces": Case(lines("'a={'", f"'  id=' || {ID}", "'  b={'", f"'    name=' || {NAME}", "'  }'", "'}'"), f"""'{{"a":{{"b":{{"name":"' || {NAME} || '"}},"id":' || {ID} || '}}}}'""", "multiline_braces_flattened"),
    "braces_in_block": Case(lines("'t=<<<'", "'a={'", f"{NAME}", "'}'", "'>>>'"), f"""'{{"t":"a={{\\n' || {NAME} || '\\n}}"}}'"""),
    "open_array": Case(lines(f"'id=' || {ID}", "'xs=['", "'1'", "'2'"), f"""'{{"id":' || {ID} || ',"xs":[1,2]}}'""", "unterminated_array_closed_at_eof"),
    "open_block": Case(lines("'body=<<<'", f"'of ' || {NAME}", "'more'"), f"""'{{"body":"of ' || {NAME} || '\\nmore"}}'""", "unterminated_block_closed_at_eof"),
    "wrong_nonce": Case(lines("'body=<<<7f2a'", NAME, "'>>>7f2b'"), f"""'{{"body":"' || {NAME} || '"}}'""", "mismatched_nonce_recovered", canonical=f"'body=' || {NAME}"),
    "short_delimiters": Case(lines("'body=<<'", f"'plain words of ' || {NAME}", "'>>'"), f"""'{{"body":"plain words of ' || {NAME} || '"}}'""", "delimiter_count_repaired"),
    "ambiguous_closers": Case(lines("'body=<<<aa'", NAME, "'>>>b'", "'x'", "'>>>c'"), None),
    "nested_inline": Case(f"'a={{id=' || {ID} || ',b={{name=' || {NAME} || '}}}}'", f"""'{{"a":{{"b":{{"name":"' || {NAME} || '"}},"id":' || {ID} || '}}}}'""", "nested_inline_flattened"),
    "pathological_key": Case(lines(f"'id=' || {ID}", f"'user.name=' || {NAME}"), f"""'{{"id":' || {ID} || ',"user.name":"' || {NAME} || '"}}'""", "pathological_key_resolved", schema="id:n\n<<<user.name>>>:s"),
    "quoted_key": Case(f"'<<<a.b>>>=' || {ID}", f"""'{{"a.b":' || {ID} || '}}'"""),
    "sparse_array": Case(lines(f"'a[0]=' || {ID}", "'a[2]=1'"), None),
    "sparse_dropped": Case(lines("'z=1'", f"'a[0]=' || {ID}", "'a[2]=1'"), """'{"z":1}'""", lenient=True, errors=1),
    "collision": Case(lines(f"'a=' || {ID}", "'a.b=1'"), None),
    "collision_first_wins": Case(lines(f"'a=' || {ID}", "'a.b=1'"), f"""'{{"a":' || {ID} || '}}'""", lenient=True, errors=1),
    "required_missing": Case(f"'id=' || {ID}", f"""'{{"id":' || {ID} || '}}'""", schema="id:n\nname:s", lenient=True, errors=1),
    "unknown_field": Case(lines(f"'id=' || {ID}", "'more=1'"), None, schema="id:n"),
    "leading_zero": Case(f"'zip=0' || {ID}", f"""'{{"zip":"0' || {ID} || '"}}'""", canonical=f"'zip=0' || {ID}"),
    "optional_null": Case(lines(f"'id=' || {ID}", "'note=null'"), f"""'{{"id":' || {ID} || ',"note":null}}'""", schema="id:n\nnote:s?"),
    "required_null_text": Case("'note=null'", """'{"note":"null"}'""", schema="note:s", canonical="'note:s=null'"),
    "declared_over_tag": Case(f"'id:n=' || {ID}", f"""'{{"id":"' || {ID} || '"}}'""", schema="id:s"),
    "bad_number": Case(f"'id=' || {NAME}", None, schema="id:n"),
    "bad_boolean": Case("'b=1'", None, schema="b:b"),
    "open_object": Case(lines(f"'meta.a=' || {ID}", f"'meta.b=' || {NAME}"), f"""'{{"meta":{{"a":' || {ID} || ',"b":"' || {NAME} || '"}}}}'""", schema="meta:o"),
    "table": Case(lines("'t::a,b'", f"'t[0]=' || {ID} || ',' || {NAME}", "'t[1]=1,null'"), f"""'{{"t":[{{"a":' || {ID} || ',"b":"' || {NAME} || '"}},{{"a":1,"b":null}}]}}'"""),
    "bad_table_row": Case(lines("'k=1'", "'t::a,b'", f"'t[0]=' || {ID} || ',x'", "'t[1]=2'", "'t[2]=3,y'"), """'{"k":1}'""", lenient=True, errors=2),
    "row_before_header": Case(lines(f"'t[0]=' || {ID} || ',x'", "'t::a,b'"), f"""'{{"t":["' || {ID} || ',x"]}}'"""),
    "array_literal": Case(lines("'xs=['", ID, f"{NAME}", "'{a=1,b=true}'", "']'"), f"""'{{"xs":[' || {ID} || ',"' || {NAME} || '",{{"a":1,"b":true}}]}}'"""),
    "literal_declared": Case(lines("'xs=['", ID, "'true'", "'null'", "']'"), f"""'{{"xs":["' || {ID} || '","true","null"]}}'""", schema="xs[]:s"),
    "inline_object": Case(f"'o={{id=' || {ID} || ',name=<<<a,b>>>}}'", f"""'{{"o":{{"id":' || {ID} || ',"name":"a,b"}}}}'"""),
    "garbage_line": Case(lines(f"'id=' || {ID}", "'@@@'", "'z=2'"), f"""'{{"id":' || {ID} || ',"z":2}}'""", lenient=True, errors=1),
    "empty": Case("''", "'{}'", canonical="''"),
    "number_overflow": Case("'x=1e999'", None),
    "double_rounding": Case("'x=9007199254740993'", """'{"x":9007199254740992}'"""),
}


def decode_case(nation: DataFrame, case: Case) -> DataFrame:
    rows = nation.select("n_nationkey", F.expr(f"concat({case.text}, '')").alias("text"))
    read = columns.decode_lenient(F.col("text"), case.schema) if case.lenient else columns.decode(F.col("text"), case.schema)
    rows = rows.select("n_nationkey", read.alias("r"))
    kinds = F.array_join(F.array_sort(F.transform("r.repairs", lambda x: x["kind"])), ",")
    out = [F.col("n_nationkey"), F.col("r.value").alias("value"), kinds.alias("repairs")]
    if case.lenient:
        out += [F.size("r.errors").alias("errors"), F.col("r.truncated").alias("truncated")]
    else:
        out.append(F.col("r.ok").alias("ok"))
    if case.canonical:
        out.append(F.col("r.canonical").alias("canonical"))
    return rows.select(*out)


def case_sql(case: Case) -> str:
    out = ["n_nationkey", f"{case.value or 'NULL::VARCHAR'} AS value", f"'{case.repairs}' AS repairs"]
    if case.lenient:
        out += [f"{case.errors}::INTEGER AS errors", f"{str(case.truncated).lower()} AS truncated"]
    else:
        out.append(f"{str(case.value is not None).lower()} AS ok")
    if case.canonical:
        out.append(f"{case.canonical} AS canonical")
    return f"SELECT {', '.join(out)} FROM nation"
