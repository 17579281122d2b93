from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import toxicity as X
from millrace.llm.common import laid_out

from .conftest import WORDS


def labelled(spark, n=900):
    rnd = random.Random(8)
    rows = []
    for k in range(n):
        w = rnd.choices(WORDS, k=rnd.randint(5, 80))
        toxic = k % 5 == 0
        for _ in range(rnd.randint(1, 3) if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(["Awful", "rotten,", "vile" + rnd.choice(["sten", "r", "ment"])]))
        rows.append((k, " ".join(w), "en" if k % 3 else "de", int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


@pytest.fixture(scope="module")
def trained(spark):
    df = labelled(spark).cache()
    return df, X.fit(df.drop("toxic"), df.select("doc_id", "toxic"))


def test_held_out_accuracy(trained):
    df, model = trained
    got = X.score(df.drop("toxic"), model).join(df.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert 100 < len(held) < 260
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.95
    assert np.mean([r["flagged"] == bool(r["toxic"]) for r in held]) > 0.95
    assert set(model.thresholds) == {"en", "de"}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_held_out_labels_are_not_used(spark, trained):
    from pyspark.sql import functions as F

    df, model = trained
    turned = df.select("doc_id", F.when(X.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    again = X.fit(df.drop("toxic"), turned)
    assert (again.network.embedding == model.network.embedding).all() and again.thresholds == model.thresholds


def test_score_depends_on_the_text_alone(spark, trained):
    _, model = trained
    rows = [(k, "ab rotten thera", lang) for k, lang in ((1, "en"), (2, None), (None, "xx"), (5, "de"))]
    got = X.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert len({r["score"] for r in got}) == 1
    without = X.score(spark.createDataFrame([(1, "ab rotten thera")], "doc_id long, text string"), model).collect()
    assert without[0]["score"] == got[0]["score"] and without[0]["threshold"] == model.threshold


def test_all_rows_come_back(docs, no_docs, corpus, trained):
    _, model = trained
    got = X.score(docs, model).collect()
    assert sorted(map(repr, (r["doc_id"] for r in got))) == sorted(repr(i) for i, _, _ in corpus)
    assert all(r["score"] is not None for r in got)
    kept = X.without_toxic(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(not r["flagged"] for r in got)
    assert X.score(no_docs, model).collect() == [] and X.without_toxic(no_docs, model).collect() == []


def test_no_labels(spark, docs):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = X.fit(docs, none)
    assert model.network is None
    assert {r["score"] for r in X.score(docs, model).collect()} == {0.0}


def test_blocks_give_the_whole_text(trained):
    _, model = trained
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices(WORDS, k=n)) for n in (0, 1, 2, 3, 50, 7, 200, 0)]
    ids, bounds = X.features(*laid_out(pa.array(texts)))
    whole = model.network.pooled(ids, bounds)
    for block in (1, 2, 5, 64):
        assert np.allclose(model.network.pooled(ids, bounds, block), whole, atol=1e-6)
    for k in range(len(texts)):
        one, b = X.features(*laid_out(pa.array([texts[k]])))
        assert np.allclose(model.network.pooled(one, b), whole[k], atol=1e-6)


def test_thresholds():
    assert X.best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.55)
    assert X.best_threshold(np.array([0.9]), np.array([0])) == 0.5
    assert X.best_threshold(np.array([0.5, 0.5, 0.1]), np.array([1, 0, 0])) == pytest.approx(0.3)


def test_all_calibrating_labels_count(spark):
    """``max_rows`` bounds the rows that train, not those that give thresholds."""
    from pyspark.sql import functions as F

    df = labelled(spark).withColumn("lang", F.when(F.col("doc_id") % 16 == 0, "xx").otherwise(F.col("lang"))).cache()
    model = X.fit(df.drop("toxic"), df.select("doc_id", "toxic"), max_rows=60)
    assert set(model.thresholds) == {"en", "de", "xx"}
    got = X.score(df.drop("toxic"), model).join(df.select("doc_id", "lang", "toxic"), "doc_id").where(X.fold("doc_id") == 1).collect()

    def f1(rows, threshold):
        flagged = [r["toxic"] for r in rows if r["score"] >= threshold]
        return 2 * sum(flagged) / (len(flagged) + sum(r["toxic"] for r in rows))

    for lang, threshold in model.thresholds.items():
        mine = [r for r in got if r["lang"] == lang]
        assert f1(mine, threshold) >= max(f1(mine, r["score"]) for r in mine) - 0.02


def test_training_words_are_bounded(spark, monkeypatch):
    """The driver gets as many whole texts, in the order of their ids' hashes, as the words allow."""
    df = labelled(spark, 300)
    seen = []
    start = X.TextCnn.start.__func__
    monkeypatch.setattr(X.TextCnn, "start", classmethod(lambda cls, docs, labels, **how: seen.append([len(d) for d in docs]) or start(cls, docs, labels, **how)))
    for words in (1 << 40, 4000, 1000):
        X.fit(df.drop("toxic"), df.select("doc_id", "toxic"), max_words=words)
    whole, some, few = seen
    assert sum(whole) > 4000 >= sum(some) > 3800 and 1000 >= sum(few) > 800
    assert set(few) <= set(some) <= set(whole)


def test_a_first_text_longer_than_the_bound(spark):
    df = labelled(spark, 300)
    assert X.fit(df.drop("toxic"), df.select("doc_id", "toxic"), max_words=1).network is None


def test_held_out_figures_of_the_test_tables(spark):
    """What the README states: labelled rows of fold 0 of sf0.1, which nothing learns from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = X.score(docs, X.fit(docs, labels)).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hits = sum(r["predicted"] and r["toxic"] for r in held)
    recall, precision = hits / sum(r["toxic"] for r in held), hits / sum(r["predicted"] for r in held)
    print("held out:", hits, sum(r["toxic"] for r in held), sum(r["predicted"] for r in held))
    assert recall > 0.85 and precision > 0.85
