"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import written
from leafwork.llm.graph import components

#: Edits that two lines of a class may differ by, at most, and code points of the shorter one for each of them.
EDITS, SPAN = 2, 10
#: Letters that are counted for the filter on candidates, two bits each.
LETTERS = "etaoinshrdlucmgp"
LOW, HIGH = 0x5555555555555555, 0xAAAAAAAAAAAAAAAA - (1 << 64)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), f), 0)


def allowed(n: Column, edits: int = EDITS, span: int = SPAN) -> Column:
    """Edits that a line of n code points and one that isn't shorter may differ by."""
    return F.least(F.lit(edits), F.floor(n / span)).cast("int")


def _cut(n: Column, i: Column, parts: Column) -> Column:
    """Place from 0 of cut i of a line of n code points into parts segments."""
    return (n * i / parts).cast("int")


def _key(n: Column, i: Column, begin: Column, size: Column) -> Column:
    """Hash of a segment's UTF-8 bytes. In a line of ASCII alone code points are bytes, so none is looked for."""
    plain = F.substring(F.col("bytes"), begin + 1, size)
    return F.xxhash64(n, i, F.when(F.col("ascii"), plain).otherwise(F.substring(F.col("text"), begin + 1, size).cast("binary")))


def _ready(lines: DataFrame, span: int) -> DataFrame:
    lines = lines.where(F.col("n") >= span).withColumn("ascii", F.octet_length("text") == F.col("n"))
    return lines.withColumn("bytes", F.when(F.col("ascii"), F.col("text").cast("binary")))


def index_rows(lines: DataFrame, edits: int = EDITS, span: int = SPAN) -> DataFrame:
    """(key, line): each of the segments of each line, one more than its edits, with its number and the line's length."""
    n = F.col("n")
    rows = _ready(lines, span).withColumn("parts", allowed(n, edits, span) + 1)
    # a row a segment before the keys are made, so that they are made in a compiled loop
    rows = rows.select("line", "n", "text", "ascii", "bytes", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    begin, end = _cut(n, F.col("i"), F.col("parts")), _cut(n, F.col("i") + 1, F.col("parts"))
    return rows.select("line", _key(n, F.col("i"), begin, end - begin).alias("key"))


def probe_steps(edits: int) -> list[tuple[int, int, int, int]]:
    """(allowed edits, code points less, segment, shift) of the substrings that are probed for lines of so many allowed edits."""
    out = []
    for most in range(1, edits + 1):
        for less in range(most + 1):
            out += [(most, less, i, shift) for i in range(most + 1) for shift in range(-i, i + 1) if abs(less - shift) <= most - i]
    return out


def probe_rows(lines: DataFrame, edits: int = EDITS, span: int = SPAN) -> DataFrame:
    """(key, probe): the substrings of a line that a line no longer than it can have as segments.

    If two lines are within the edits that the shorter allows, some segment i of that stands in the
    longer with i edits before it and the edits less i after it at most. So it is
    shifted by at most i, and by at most as many as are left against the end; only such
    substrings are probed, for each length from the line's own down to as many less as there are edits.
    """
    names, n = ("most", "less", "i", "shift"), F.col("n")
    steps = probe_steps(edits)
    table = lambda some: F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, w, strict=True)]) for w in some])
    fitting = F.filter(table(steps), lambda p: allowed(n - p["less"], edits, span) == p["most"])
    long = n >= edits * span + edits
    rows = _ready(lines, span).select("line", "n", "text", "ascii", "bytes", F.explode(F.when(long, table([w for w in steps if w[0] == edits])).otherwise(fitting)).alias("p"))
    rows = rows.select("line", "n", "text", "ascii", "bytes", *[F.col(f"p.{k}").alias(k) for k in names])
    size = n - F.col("less")
    begin, end = (_cut(size, F.col("i") + k, F.col("most") + 1) + F.col("shift") for k in (0, 1))
    rows = rows.select("line", "n", "text", "ascii", "bytes", "i", size.alias("size"), begin.alias("begin"), end.alias("end")).where("begin >= 0 and end <= n")
    return rows.select(F.col("line").alias("probe"), _key(F.col("size"), F.col("i"), F.col("begin"), F.col("end") - F.col("begin")).alias("key"))


def letter_counts(text: Column) -> Column:
    """Counts of LETTERS mod 4, in two bits each of a long.

    An edit changes at most two counts by one each, so those of texts within e edits
    differ by at most 2 e over all letters.
    """
    whole = F.octet_length(text)

    def counted(bits: Column, letter: Column) -> Column:
        # a loop, since an expression of all letters makes a method too large to be compiled
        return F.shiftleft(bits, 2).bitwiseOR((whole - F.octet_length(F.replace(text, letter, F.lit("")))).cast("long").bitwiseAND(F.lit(3)))

    return F.aggregate(F.array(*[F.lit(c) for c in LETTERS]), F.lit(0).cast("long"), counted)


def letters_near(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether the letter counts allow for so few edits: the differences mod 4 of all letters at once."""
    high, low = F.lit(HIGH).cast("long"), F.lit(LOW).cast("long")
    odd = a.bitwiseXOR(b).bitwiseAND(low)
    # a count differs by 2 where its low bits agree and its high bits don't
    two = F.shiftrightunsigned(a.bitwiseXOR(b).bitwiseAND(high), 1).bitwiseAND(F.bitwise_not(odd))
    return F.bit_count(odd) + 2 * F.bit_count(two) <= 2 * edits


def within_edits(a: Column, b: Column, edits: int = EDITS, span: int = 0) -> Column:
    """Whether a and b differ by at most edits insertions, deletions or substitutions of code points,
    and by at most one for each span code points of the shorter.

    Banded and bit-parallel: word e has a bit for each diagonal of the band that
    is reached with e edits. Each code point of b moves all diagonals of a
    word at once, by a mask of the matches and by shifts. Once no bit is
    left, the rest of b is passed over.
    """
    full = (1 << 2 * edits + 1) - 1

    def words(values: list[Column]) -> Column:
        return F.struct(*[v.cast("int").alias(f"r{e}") for e, v in enumerate(values)])

    def moved(state: Column, mask: Column) -> Column:
        new: list[Column] = []
        for e in range(edits + 1):
            word = state[f"r{e}"].bitwiseAND(mask)
            if e:
                fewer = state[f"r{e - 1}"]
                ahead = F.shiftleft(new[e - 1], 1).bitwiseAND(F.lit(full))
                word = word.bitwiseOR(fewer).bitwiseOR(F.shiftright(fewer, 1)).bitwiseOR(ahead)
            new.append(word)
        return words(new)

    def step(p: Column) -> Callable[[Column, Column], Column]:
        def run(state: Column, j: Column) -> Column:
            c = F.get(p["y"], j)
            bits = [F.when(F.get(p["x"], j + d) == c, F.lit(1 << (d + edits))).otherwise(F.lit(0)) for d in range(-edits, edits + 1)]
            alive = _let(reduce(lambda u, v: u.bitwiseOR(v), bits), lambda m: moved(state, m))
            return F.when(state[f"r{edits}"] == 0, state).otherwise(alive)

        return run

    start = words([F.lit(((1 << e + 1) - 1) << edits) for e in range(edits + 1)])
    places = F.when(F.length(b) > 0, F.sequence(F.lit(0), F.length(b) - 1)).otherwise(F.array().cast("array<int>"))
    pair = F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    most = allowed(F.least(F.length(a), F.length(b)), edits, span) if span else F.lit(edits)
    last = _let(pair, lambda p: F.aggregate(places, start, step(p), lambda s: F.get(F.array(*[s[f"r{e}"] for e in range(edits + 1)]), most)))
    gap = F.length(a) - F.length(b)
    return F.when(F.abs(gap) <= edits, F.getbit(last, gap + edits) == 1).otherwise(F.lit(False))


def near_pairs(lines: DataFrame, edits: int = EDITS, span: int = SPAN) -> DataFrame:
    """(a, b): pairs of lines (line, text, n), none equal, within their edits of each other.

    Few substrings of lines are another line's segment. Those that are are found first, at
    most a row each; texts and letter counts are gathered for their lines alone, and only
    pairs whose letter counts allow for it leave the join of the two.
    """
    index = index_rows(lines, edits, span)
    probes = written(probe_rows(lines, edits, span).join(index.withColumnRenamed("key", "own"), (F.col("key") == F.col("own")) & (F.col("probe") != F.col("line")), "left_semi"), "probes")
    index = written(index.join(probes.select("key").distinct().hint("merge"), "key", "left_semi"), "segments")
    named = probes.select(F.col("probe").alias("line")).union(index.select("line")).distinct()
    texts = written(lines.select("line", "text").join(named.hint("merge"), "line").withColumn("letters", letter_counts(F.col("text"))), "texts")
    letters = texts.select("line", "letters")
    index = written(index.join(letters, "line"), "segments")
    probes = written(probes.join(letters.toDF("probe", "probe_letters"), "probe"), "probes")
    found = index.join(probes, "key").where((F.col("line") != F.col("probe")) & letters_near(F.col("letters"), F.col("probe_letters"), edits))
    found = written(found.select(F.least("line", "probe").alias("a"), F.greatest("line", "probe").alias("b")).distinct(), "candidates")
    found = found.join(texts.select("line", "text").toDF("a", "x"), "a").join(texts.select("line", "text").toDF("b", "y"), "b")
    return found.where(within_edits(F.col("x"), F.col("y"), edits, span)).select("a", "b")


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, line_no, text, h1, h2) of each line; a null text has none."""
    whole = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    rows = whole.select("doc_id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return rows.select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))


BLANK = r"^[\x20\x09-\x0D]*\z"


def line_classes(docs: DataFrame, edits: int = EDITS, span: int = SPAN) -> DataFrame:
    """Written (h1, h2, rep_doc_id, rep_line_no): the class of each line that isn't blank, by its hashes.

    A class's representative is its first line by doc_id (nulls last) and line number.
    """
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "line_no")
    lines = occurrences(docs.select("doc_id", "text")).where(~F.col("text").rlike(BLANK)).groupBy("h1", "h2").agg(F.min(place).alias("first"), F.first("text").alias("text"))
    lines = written(lines.select(F.monotonically_increasing_id().alias("line"), "*", F.length("text").alias("n")), "lines", "snappy")
    roots = components(near_pairs(lines, edits, span)).select(F.col("node").alias("line"), "root")
    known = lines.select("line", "h1", "h2", "first").join(roots, "line", "left")
    known = written(known.select("h1", "h2", "first", F.coalesce("root", "line").alias("root")), "rooted")
    groups = written(known.groupBy("root").agg(F.min("first").alias("rep")), "classes")
    return written(known.join(groups, "root").select("h1", "h2", F.col("rep.doc_id").alias("rep_doc_id"), F.col("rep.line_no").alias("rep_line_no")), "named")


def deduplicate(docs: DataFrame, edits: int = EDITS, span: int = SPAN) -> DataFrame:
    """One row per line: doc_id, line_no, rep_doc_id, rep_line_no, kept.

    Lines are what stands between line feeds. Two lines are linked if they differ by at most edits edits and
    by at most one edit for each span code points of the shorter (so lines of fewer than span have to be equal); a
    class is all that links reach, and of a class the first line stays, by
    doc_id (null last) and line_no. Blank lines are no part of it and stay, with a null
    representative. A null text has no lines; an empty one has one blank
    line. Rows that repeat a doc_id count as one document: the same line
    of each stays. Other columns are not read. An empty table gives none.
    """
    rows = occurrences(docs.select("doc_id", "text")).select("doc_id", "line_no", "h1", "h2")
    out = rows.join(line_classes(docs, edits, span), ["h1", "h2"], "left")
    return out.select("doc_id", "line_no", "rep_doc_id", "rep_line_no", _kept().alias("kept"))


def _kept() -> Column:
    here = F.col("doc_id").eqNullSafe(F.col("rep_doc_id")) & F.col("line_no").eqNullSafe(F.col("rep_line_no"))
    return here | F.col("rep_line_no").isNull()


def without_repeats(docs: DataFrame, edits: int = EDITS, span: int = SPAN) -> DataFrame:
    """docs, with only the kept lines left in each text; n_chars, where there is one, follows.

    All rows stay, if with an empty text. Cases as in deduplicate.
    """
    rows = occurrences(docs.select("doc_id", "text")).drop("text")
    rows = rows.join(line_classes(docs, edits, span), ["h1", "h2"], "left").select("doc_id", "t1", "t2", "line_no", _kept().alias("kept"))
    flags = rows.groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set(F.struct("line_no", "kept"))).alias("__flags"))
    flags = flags.where(F.exists("__flags", lambda f: ~f["kept"])).toDF("__id", "__t1", "__t2", "__flags")
    key = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__t1")) & (F.xxhash64(F.lit(1), "text") == F.col("__t2"))
    lines = F.filter(F.split("text", "\n"), lambda _, i: F.get("__flags", i)["kept"])
    out = docs.join(flags, key, "left").withColumn("text", F.when(F.col("__flags").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__flags").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
