import random
import zlib

import numpy as np
import pyarrow as pa

from leafwork.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(spark):
    rng = random.Random(0)
    rows, labels = [], []
    bad = {"en": ["awfulword", "nastyterm", "vileness"], "de": ["grobxheit", "grobxlich", "grobxung"]}
    for i in range(1600):
        lang = rng.choice(["en", "de"])
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(bad[lang]))
        rows.append((i, " ".join(words), lang, "s", 0, "clash"))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    truth = {r[0]: any(w in r[1].split() for ws in bad.values() for w in ws) for r in rows}
    rows += [(9001, None, None, None, None, None), (9002, "", None, None, None, None), (None, "w1 w2", "en", "s", 0, None), (9003, "w3 " * 60_000 + "awfulword nastyterm", "en", "s", 0, None)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], LABELS), truth


def test_held_out_accuracy_and_cases(spark):
    docs, labels, truth = corpus(spark)
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == 1604
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[9001].score == by[9002].score and by[9001].predicted == 0
    assert by[9003].predicted == 1
    kept = toxicity.without_toxic(docs, labels).collect()
    ids = {r.doc_id for r in kept}
    clean = [i for i, t in truth.items() if not t]
    assert sum(i in ids for i in clean) >= 0.98 * len(clean)
    assert sum(i in ids for i, t in truth.items() if t) <= 0.05 * len(truth)
    assert {9001, 9002, None} <= ids and 9003 not in ids
    assert {r.score for r in kept if r.doc_id in truth} == {"clash"}


def test_without_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3, None)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [(r.doc_id, r.predicted) for r in toxicity.score_documents(docs, none).collect()] == [(1, 0)]
    assert toxicity.score_documents(spark.createDataFrame([], DOCS), none).count() == 0


def test_a_score_does_not_hang_on_its_batch():
    rng = random.Random(1)
    model = toxicity.fit([(ids, i % 2) for i in range(40) for _, ids, _ in toxicity.word_ids(pa.array([" ".join(f"w{rng.randint(0, 20)}" for _ in range(10)) + (" bad" if i % 2 else "")]))])
    texts = ["w1 bad", None, "w2 w3", "", "w4 " * 500 + "bad"]
    whole = toxicity.scores(model, pa.array(texts))
    assert whole.tolist() == [toxicity.scores(model, pa.array([t], pa.string()))[0] for t in texts]


def test_toxic_passages_anywhere_in_long_labelled_texts(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1900):
        toxic = i < 200 and i % 2 == 0
        words = [f"w{rng.randint(0, 400)}" for _ in range(20_000 if i < 200 else 50)]
        if toxic:  # anywhere, thus mostly not among the first, last or some evenly spread words
            at = rng.randint(0, 19_980)
            words[at : at + 8] = rng.choices(["awfulword", "nastyterm", "vileness"], k=8)
        rows.append((i, " ".join(words), "en", "s", 0, None))
        labels.append((i, 1, int(toxic)))
    truth = {i: int(toxic) for i, _, toxic in labels}
    got = toxicity.score_documents(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert [r.doc_id for r in got if r.predicted != truth[r.doc_id]] == []
    assert [r.doc_id for r in got if r.rejected != truth[r.doc_id]] == []


def test_fitting_by_pieces_is_fitting_on_whole_texts(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join([f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 90))] + ["bad thing"] * (i % 2) + [f"w{rng.randint(0, 50)}" for _ in range(30)]) for i in range(60)]
    examples = [(ids, i % 2) for i, t in enumerate(texts) for _, ids, _ in toxicity.word_ids(pa.array([t]))]
    whole = toxicity.scores(toxicity.fit(examples), pa.array(texts))
    monkeypatch.setattr(toxicity, "RUN", 7)
    assert abs(toxicity.scores(toxicity.fit(examples), pa.array(texts)) - whole).max() < 1e-3


def test_scores_against_loops():
    """Forward pass by loops over words, filters and places, without the tables and shifts of the operator."""
    rng = np.random.default_rng(4)
    units = len(toxicity.WIDTHS) * toxicity.FILTERS
    model = toxicity.Model(
        rng.normal(0, 1, (toxicity.BUCKETS, toxicity.DIMENSIONS)).astype(np.float32), [rng.normal(0, 1, (w, toxicity.DIMENSIONS, toxicity.FILTERS)) for w in toxicity.WIDTHS],
        rng.normal(0, 1, units), np.abs(rng.normal(0, 1, units)), 0.3,
    )
    texts = ["one", "two words", "a few more words than a filter is wide", "", None, "x " * 300]
    got = toxicity.scores(model, pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        z = 0.3
        ids = [x for _, ids, _ in toxicity.word_ids(pa.array([text or ""])) for x in ids]
        vectors = [sum(model.embedding[j].astype(float) for j in word) for word in ids]
        for j, f in enumerate(model.filters):
            for e in range(toxicity.FILTERS):
                most = max((sum(float(vectors[i + k] @ f[k][:, e]) for k in range(len(f)) if i + k < len(vectors)) for i in range(len(vectors))), default=0.0)
                unit = j * toxicity.FILTERS + e
                z += max(most + model.bias[unit], 0) * model.weights[unit]
        assert abs(score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-4


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.without_toxic(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", None, None, 1), (None, None, None, None, None)], docs.schema)
    assert toxicity.without_toxic(one, labels).columns == docs.columns


def best_by_loops(rows):
    """Threshold of the best F1 by trying every gap; None without both labels."""
    cuts = sorted({x for _, x in rows}, reverse=True)
    f1 = [2 * sum(y for y, x in rows if x >= c) / (sum(x >= c for _, x in rows) + sum(y for y, _ in rows)) for c in cuts]
    k = f1.index(max(f1))
    return (cuts[k] + cuts[min(k + 1, len(cuts) - 1)]) / 2


def test_thresholds_against_loops(spark):
    rng = random.Random(5)
    rows = []
    for lang, n in (("en", 300), ("de", 90), ("", 20), (None, 20), ("one", 1), ("clean", 30)):
        for _ in range(n):
            toxic = int(lang != "clean" and rng.random() < 0.3)
            rows.append((lang, toxic, round(rng.gauss(3 if toxic else -2, 2.5), 1)))
    got = {r.lang: r for r in toxicity.best_thresholds(spark.createDataFrame(rows, "lang string, toxic int, logit double")).collect()}
    assert set(got) == {"", "en", "de", "one", "clean"}
    for lang in ("", "en", "de"):
        own = [(y, x) for g, y, x in rows if lang in ("", g)]
        assert (got[lang].n, got[lang].hits) == (len(own), sum(y for y, _ in own))
        assert got[lang].threshold == best_by_loops(own)


def test_all_labelled_texts_are_learned_from(spark, monkeypatch):
    """A kind of toxic word that only few documents have, of the greatest hashes among thousands of labelled ones."""
    rng = random.Random(6)
    ids = spark.range(9_000).selectExpr("id", "crc32(cast(id as string)) % 5 = 0 held", "xxhash64(id, 'toxicity') h")
    ids = [(r.id, r.held) for r in ids.orderBy("h").collect()]
    rare = {i for i, _ in ids[-300:]}
    rows, labels, truth = [], [], {}
    for i, _ in ids:
        words = [f"w{rng.randint(0, 400)}" for _ in range(8)]
        toxic = i in rare or rng.random() < 0.5
        if toxic:
            words.insert(rng.randint(0, 8), "rareslur" if i in rare else rng.choice(["awfulword", "nastyterm"]))
        rows.append((i, " ".join(words), "en", "s", 0, None))
        labels.append((i, 1, int(toxic)))
        truth[i] = int(toxic)
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    labelled, shards = toxicity._labelled(docs, known)
    assert labelled.count() == sum(not held for _, held in ids) and shards == labelled.rdd.getNumPartitions() == 4
    first = {r.doc_id: r for r in toxicity.score_documents(docs, known).collect()}
    assert [i for i, held in ids if held and first[i].predicted != truth[i]] == []
    # neither the rows' order nor their partitions matter
    again = toxicity.score_documents(docs.orderBy("text").repartition(3), known.repartition(5)).collect()
    assert all(r.score == first[r.doc_id].score for r in again)
    monkeypatch.setattr(toxicity, "SHARD_TEXTS", 600)
    many = toxicity.score_documents(docs, known).collect()
    assert sum(r.predicted != truth[r.doc_id] for r in many if r.held_out) <= 5
