import random

import pytest
from pyspark.sql import functions as F

from leafwork.llm import linededup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, n, letters="abcdé"):
    s = list(s)
    for _ in range(n):
        k, i = rng.random(), rng.randint(0, len(s))
        if k < 0.4:
            s.insert(i, rng.choice(letters))
        elif s and k < 0.7:
            s.pop(min(i, len(s) - 1))
        elif s:
            s[min(i, len(s) - 1)] = rng.choice(letters)
    return "".join(s)


def test_verification_against_full_table(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 12)))
        rows.append((a, edited(rng, a, rng.randint(0, 4))))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", linededup.within_edits(F.col("a"), F.col("b")).alias("near")).collect()
    assert all(r.near == (distance(r.a, r.b) <= 2) for r in got)
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", linededup.within_edits(F.col("a"), F.col("b"), 2, 4).alias("near")).collect()
    assert all(r.near == (distance(r.a, r.b) <= min(2, min(len(r.a), len(r.b)) // 4)) for r in got)
    assert {min(2, min(len(r.a), len(r.b)) // 4) for r in got if r.near} == {0, 1, 2}


def near(a, b, edits=2, span=10):
    """Whether two lines are linked, by the full table."""
    most = min(edits, min(len(a), len(b)) // span)
    return a == b or (most > 0 and abs(len(a) - len(b)) <= most and distance(a, b) <= most)


def test_letter_counts_never_refuse_a_near_pair(spark):
    rng, rows = random.Random(5), []
    for _ in range(300):
        a = "".join(rng.choice(linededup.LETTERS + "xé") for _ in range(rng.randint(10, 400)))
        rows.append((a, edited(rng, a, rng.randint(0, 2))))
    df = spark.createDataFrame(rows, "a string, b string").select(*[linededup.letter_counts(F.col(k)).alias(k) for k in "ab"])
    assert df.where(~linededup.letters_near(F.col("a"), F.col("b"))).count() == 0


@pytest.mark.parametrize("edits, span", [(2, 10), (1, 5), (3, 6)])
def test_classes_against_brute_force(spark, edits, span):
    rng = random.Random(2)
    lines = []
    for _ in range(40):
        base = "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(4, 44)))
        lines += [edited(rng, base, rng.randint(0, 3)) for _ in range(5)]
    rng.shuffle(lines)
    lines[:4] = ["", "  ", "Of.", "Of."]
    docs = [(i, "\n".join(lines[i * 4 : i * 4 + 4]), "clash", 0) for i in range(50)]
    label = list(range(len(lines)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(lines):
        for j in range(i):
            b = lines[j]
            if a.strip() and b.strip() and near(a, b, edits, span):
                label[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame(docs, "doc_id long, text string, line string, n_chars long")
    got = {(r.doc_id, r.line_no): r for r in linededup.deduplicate(df, edits, span).collect()}
    for k, line in enumerate(lines):
        r = got[k // 4, k % 4]
        if line.strip():
            assert (r.rep_doc_id, r.rep_line_no) == (find(k) // 4, find(k) % 4)
        assert r.kept == (not line.strip() or find(k) == k)
    left = {r.doc_id: r for r in linededup.without_repeats(df, edits, span).collect()}
    for i, text, line, _ in docs:
        want = "\n".join(x for n, x in enumerate(text.split("\n")) if got[i, n].kept)
        assert left[i].text == want
        assert left[i].line == line
        assert left[i].n_chars in (0, len(want))


def test_nulls_ties_and_empty_tables(spark):
    kind = "doc_id long, text string"
    assert linededup.deduplicate(spark.createDataFrame([], kind)).count() == 0
    long = "a line that is long enough to be compared"
    rows = [(None, long), (2, None), (3, ""), (4, long + "!"), (4, long + "!"), (5, long + "\n" + "x" * 50_000)]
    df = spark.createDataFrame(rows, kind)
    got = sorted(((r.doc_id, r.line_no, r.rep_doc_id, r.kept) for r in linededup.deduplicate(df).collect()), key=str)
    assert got == sorted([(None, 0, 4, False), (3, 0, None, True), (4, 0, 4, True), (4, 0, 4, True), (5, 0, 4, False), (5, 1, 5, True)], key=str)
    texts = sorted(((str(r.doc_id), r.text) for r in linededup.without_repeats(df).collect()), key=str)
    assert texts == sorted([("None", ""), ("2", None), ("3", ""), ("4", long + "!"), ("4", long + "!"), ("5", "x" * 50_000)], key=str)
