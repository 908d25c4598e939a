"""Language and quality models: held-out accuracy, flattened trees against a plain walk, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegraph.llm import language
from sitegraph.llm.common import documents, hash_bound
from sitegraph.llm.language import Model, Scorer, fit, grams_of, identify, predict_languages, training_part, words_of
from sitegraph.llm.quality_model import FEATURES, fit_trees, probabilities, quality_scores, statistics

DOC = "doc_id long, text string, lang string, source string, score string, held_out string, features string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", "a", "b", "c") for i, t, x in rows], DOC)


@pytest.fixture(scope="module")
def predicted(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    return docs.join(identify(docs), "doc_id").cache()


def test_language_of_held_out_documents(predicted):
    rows = predicted.select("doc_id", "lang", "lang_pred", "held_out", "score").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert 250 < len(held) < 420
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def _one_by_one(model: Model, text: str) -> np.ndarray:
    total = np.zeros(len(model.languages))
    for w in words_of(text):
        if w in model.words:
            total += model.word_logs[model.words[w]]
            continue
        for n in range(5, 0, -1):
            known = [model.gram_logs[model.grams[g]] for g in grams_of(w, n) if g in model.grams]
            if known:
                total += np.mean(known, axis=0)
                break
    return total


def test_scores_are_those_of_a_plain_walk(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    model = fit(docs, training_part(), sample_docs=20, words=200, grams=50)
    assert len(model.languages) == 4 and len(model.words) <= 4 * 200 and len(model.grams) <= 4 * 50 * 5
    texts = [r.text for r in docs.select("text").take(60)] + ["", "12 ++", "qqq zzz", "the. The, THE"]
    scorer = Scorer(model, limit=500)
    for text, (lang, score) in zip(texts, [f for t in texts for f in scorer.predict([t])]):
        if not words_of(text):
            assert (lang, score) == ("und", 0.0)
            continue
        total = _one_by_one(model, text)
        assert total[model.languages.index(lang)] == pytest.approx(total.max())
        assert score == pytest.approx(1 / sum(10 ** np.maximum(total - total.max(), -300)), rel=1e-6)


def test_odd_rows_and_labels(spark):
    rows = [(k, "das ist ein haus" if k % 2 else "this is a house", "de" if k % 2 else "en") for k in range(30)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 ...", "en"), (None, "this house", "en"), (1, rows[1][1], "de")]
    found = {(r.doc_id, r.lang_pred) for r in identify(_docs(spark, rows)).collect()}
    assert {(100, "und"), (101, "und"), (102, "und"), (None, "en"), (0, "en"), (1, "de")} <= found
    assert identify(_docs(spark, rows)).count() == len(rows)
    none = _docs(spark, rows).limit(0)
    assert identify(none).count() == 0
    unlabelled = _docs(spark, [(1, "some text", None)])
    assert [(r.lang_pred, r.score) for r in identify(unlabelled).collect()] == [("und", 0.0)]
    model = fit(_docs(spark, rows), F.lit(False))
    assert predict_languages(unlabelled, model).first().lang_pred == "und"


def test_sample_is_bounded_per_language(spark, monkeypatch):
    rows = [(k, f"word{'abcdefghij'[k % 10]}", "en" if k % 4 else "de") for k in range(200)]
    model = fit(_docs(spark, rows), F.lit(True), sample_docs=5)
    assert len(model.words) <= 10
    monkeypatch.setattr(language, "MAX_LANGUAGES", 1)
    assert fit(_docs(spark, rows), F.lit(True)).languages == ["en"]


def test_trees_learn_and_walk():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, len(FEATURES))).astype(np.float32)
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] > 0)).astype(float)
    model = fit_trees(x[:2000], y[:2000], trees=40)
    scores = probabilities(model, x[2000:])
    assert ((scores > 0.5) == (y[2000:] == 1)).mean() > 0.95
    for k in range(0, 1000, 97):
        total, row = model.base, x[2000 + k]
        for feature, limit, leaf in zip(model.feature, model.limit, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > limit[node] else 1)
            total += leaf[node - len(feature)]
        assert scores[k] == pytest.approx(1 / (1 + np.exp(-total)))
    assert set(probabilities(fit_trees(x, np.ones(3000)), x).round(6)) == {0.999}
    assert len(probabilities(fit_trees(x[:0], y[:0]), x)) == 3000 and len(probabilities(model, x[:0])) == 0


def test_statistics_of_any_text():
    for text in ["", " ", "one", "a\n\nb\n", "é" * 5, "x " * 9999, "#$% | & <a>"]:
        values = statistics(text.encode())
        assert len(values) == len(FEATURES) and np.isfinite(values).all()


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_scores(documents(spark, sf), labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)


def test_quality_of_odd_rows(spark):
    docs = _docs(spark, [(1, None, None), (1, None, None), (None, "x", None), (2, "", None)])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == 4 and len({r.score for r in rows}) == 1
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert quality_scores(docs, labels.limit(0)).count() == 4 and quality_scores(docs.limit(0), labels).count() == 0


def test_hash_bound(spark):
    docs = spark.range(100_000).select(F.xxhash64("id").alias("h"))
    below = docs.where(F.col("h") <= hash_bound(100_000, 1000)).count()
    assert 1800 < below < 2500
    assert hash_bound(10, 1000) == 2**63 - 1 and hash_bound(0, 5) == 2**63 - 1
