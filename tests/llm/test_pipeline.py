from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import decontaminate, packing, simhash_dedup, toxicity
from millrace.llm.queries import ORACLE_SQL, QUERIES

from .test_decontaminate import brute as contaminated
from .test_repeats import brute_bytes


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Each stage's input, by name, and the last stage's result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = stage(spark, docs, sf_dir).cache()
    return seen | {"result": docs}


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_contract(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_dedup", "suffix_dedup", "decontaminate", "packing"]
    for n in names:
        assert stages[n].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go(spark, sf_dir, stages):
    model = toxicity.fit(stages["toxicity"], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    flagged = {r["doc_id"] for r in toxicity.score(stages["toxicity"], model).collect() if r["flagged"]}
    assert set(rows(stages["simhash_dedup"])) == set(rows(stages["toxicity"])) - flagged


def test_one_document_of_each_group_stays(stages):
    texts = rows(stages["simhash_dedup"])
    prints = {i: simhash_dedup.fingerprint(t) for i, t in texts.items()}
    label = dict(zip(texts, texts, strict=True))
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert rows(stages["suffix_dedup"]) == {i: texts[i] for i in set(label.values())}


def test_repeats_are_cut(stages):
    texts = sorted(rows(stages["suffix_dedup"]).items())
    want = {}
    for (i, _), (data, gone) in zip(texts, brute_bytes([t for _, t in texts], 100), strict=True):
        want[i] = np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    assert rows(stages["decontaminate"]) == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages["decontaminate"].collect())


def test_contaminated_documents_go(spark, sf_dir, stages):
    texts = rows(stages["decontaminate"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    known = set().union(*(decontaminate.Benchmark([t]).known.tolist() for _, t in items))
    # brute force only over texts that share a shingle with an item; others can match none
    some = {i: t for i, t in texts.items() if known & set(decontaminate.Benchmark([t]).known.tolist())}
    bad = {i for i, _, _ in contaminated(some.items(), items)}
    assert rows(stages["packing"]) == {i: t for i, t in texts.items() if i not in bad}


def test_all_that_is_left_is_packed(stages):
    lengths = Counter()
    for r in stages["result"].collect():
        lengths[r["doc_id"]] += r["length"]
    enc = packing.tokenizer.encoder(packing.tokenizer.default_path())
    assert lengths == {i: len(enc.ids(t)) + 1 for i, t in rows(stages["packing"]).items()}


def test_run(spark, sf_dir, stages):
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(stages["result"])


def test_registered_queries(spark, sf_dir):
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
    import __spark_entry__

    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_queries_run(spark, sf_dir, duck, same_rows, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        same_rows(df, duck.sql(ORACLE_SQL[name]))
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_empty_and_wider_tables(spark, sf_dir, stages, name):
    """No documents give no rows; other columns, whatever their names, change nothing and travel along."""
    from pyspark.sql import functions as F

    from .conftest import CLASHING

    stage = dict(corpus_pipeline.STAGES)[name]
    docs = stages[name].limit(0)
    assert stage(spark, docs, sf_dir).collect() == []
    if name == "toxicity":  # its model is of these documents, so it needs them all
        some = stages[name]
    else:
        some = stages[name].where("doc_id % 7 < 3")
    wide = some.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])
    plain, found = stage(spark, some, sf_dir), stage(spark, wide, sf_dir)
    key = ["doc_id", "piece", "length"] if name == "packing" else ["doc_id", "text"]
    rows = lambda df: sorted((tuple(r) for r in df.select(*key).collect()), key=repr)
    assert rows(found) == rows(plain)
    if name != "packing":
        assert found.columns == wide.columns
