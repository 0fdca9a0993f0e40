import random
from collections import Counter

from leafwork.llm import tokencounts
from leafwork.llm.tokens import default_vocabulary, word_tokens

KIND = "doc_id long, text string, length string, documents string, lang string"


def length(text):
    return len(word_tokens(default_vocabulary()).tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_histogram_and_what_it_answers(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "Beta,", "ñu!", "12"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += [None, "", texts[0], texts[0], "word " * 9000]
    docs = spark.createDataFrame([(i, t, "clash", None, [None, "en"][i % 2]) for i, t in enumerate(texts)], KIND)
    lengths = [length(t) for t in texts]
    sums = tokencounts.with_suffix_sums(tokencounts.histogram(docs))
    rows = {r.length: r for r in sums.collect()}
    assert {n: r.documents for n, r in rows.items()} == Counter(lengths)
    for n, r in rows.items():
        assert r.tokens == n * r.documents
        assert r.documents_at_least == sum(x >= n for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= n)
        assert r.truncated_total == sum(min(x, n) for x in lengths)
    limits = [0, 7, 64, 5000, 10**6]
    got = {r.limit: (r.kept, r.cut, r.documents_cut) for r in tokencounts.truncated_totals(sums, limits).collect()}
    assert got == {m: (sum(min(x, m) for x in lengths), sum(max(0, x - m) for x in lengths), sum(x > m for x in lengths)) for m in limits}
    ordered = sorted(lengths)
    got = {r.share: r.length for r in tokencounts.quantile(sums, [0.25, 0.5, 0.99, 1.0]).collect()}
    assert got == {s: ordered[max(0, -int(-s * len(ordered) // 1) - 1)] for s in got}
    by = tokencounts.with_suffix_sums(tokencounts.histogram(docs, "lang"), "lang").collect()
    for r in by:
        own = [n for i, n in enumerate(lengths) if [None, "en"][i % 2] == r.lang]
        assert (r.documents, r.truncated_total) == (own.count(r.length), sum(min(x, r.length) for x in own))


def test_empty_table(spark):
    assert tokencounts.with_suffix_sums(tokencounts.histogram(spark.createDataFrame([], KIND))).count() == 0
