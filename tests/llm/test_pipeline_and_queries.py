"""The pipeline stage by stage against brute force, and each query against its SQL."""

from __future__ import annotations

import json

import brute
import pytest
from compare import difference
from test_text_operators import CASES, clashing, whole_viterbi

import __spark_entry__ as entry
import corpus_pipeline
from wrenloom.llm import bestfit, crf, decontaminate, langid, ngramjoin
from wrenloom.llm import queries as llm
from wrenloom.llm.common import table


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    assert difference(llm.queries()[name](spark, small), small, llm.oracle_sql()[name]) == ""


def test_registered():
    names = sorted(llm.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert {*names, "pipeline"} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "pii", "best_fit_packing"]


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """The rows that go into each stage, and come out of the last."""
    docs, out = table(spark, small, "documents"), [table(spark, small, "documents")]
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        f(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_language_stage(stages):
    sample = langid.training_sample(stages[0])
    plain, model = brute.Ppm(sample, langid.ORDER, langid.ALPHABET, langid.NODES), langid.train(sample)
    some = [r for r in stages[0].collect() if len(r["text"]) < 250][:25]
    got = {r["doc_id"]: r for r in langid.identify(stages[0], model).collect()}
    for r in some:
        bits = {lang: plain.bits(lang, r["text"].encode()) for lang in plain.languages}
        assert got[r["doc_id"]]["pred_lang"] == min(bits, key=bits.get)
        assert got[r["doc_id"]]["bits_per_byte"] == pytest.approx(min(bits.values()) / len(r["text"].encode()), abs=2e-4)
    assert rows(stages[1]) == sorted((tuple(r) for r in stages[0].collect() if got[r["doc_id"]]["accepted"]), key=repr)


def test_near_copies_stage(stages):
    docs = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    kept = brute.kept_of_near(docs, ngramjoin.N, ngramjoin.THRESHOLD)
    assert rows(stages[2]) == sorted((tuple(r) for r in stages[1].collect() if r["doc_id"] in kept), key=repr)
    assert len(kept) < len(docs)


def test_decontamination_stage(spark, small, stages):
    before = stages[2].collect()
    items = [tuple(r) for r in table(spark, small, "benchmark").select("item_id", "text").collect()]
    short = [(r["doc_id"], r["text"]) for r in before if len(r["text"]) < 4000]
    bad = {d for d, _ in brute.leaks(short, items, decontaminate.WIDTH, decontaminate.COVER, set(decontaminate.UNITS))}
    kept = {r["doc_id"] for r in stages[3].collect()}
    assert {i for i, _ in short} - kept == bad


def test_personal_data_stage(stages):
    field = crf.trained()
    before, changed = {r["doc_id"]: r for r in stages[3].collect()}, 0
    after = {r["doc_id"]: r for r in stages[4].collect()}
    assert set(before) == set(after)
    for i, r in before.items():
        text = crf.mask(r["text"], whole_viterbi(field, r["text"])) if len(r["text"]) < 6000 else after[i]["text"]
        assert after[i]["text"] == text and after[i]["n_chars"] == len(text)
        changed += text != r["text"]
    assert changed


def test_packing_stage(stages):
    docs = [(r["doc_id"], r["text"]) for r in stages[4].collect()]
    bins = brute.check_packing(stages[5].collect(), docs, bestfit.CAPACITY)
    sizes = [x for _, t in docs for n in [len(brute.words(t))] for x in [bestfit.CAPACITY] * (n // bestfit.CAPACITY) + [n % bestfit.CAPACITY]]
    assert bins <= brute.best_fit_bins(sizes, bestfit.CAPACITY) * 1.05 + 2


def test_run_is_the_stages(spark, small, stages):
    got = corpus_pipeline.run(spark, small).collect()
    place = lambda rs: sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rs)
    assert place(got) == place(stages[5].collect())
    brute.check_packing(got, [(r["doc_id"], r["text"]) for r in stages[4].collect()], bestfit.CAPACITY)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, small, stage):
    name, f = corpus_pipeline.STAGES[stage]
    df = clashing(spark, CASES)
    out = f(spark, df, small)
    assert out.count() > 0
    if stage < 4:
        assert out.columns == df.columns
        assert json.dumps(sorted(out.dtypes)) == json.dumps(sorted(df.dtypes))
    assert f(spark, df.limit(0), small).count() == 0
    documents = table(spark, small, "documents")
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2, documents.schema)
    kept = f(spark, nulls, small).count()
    assert kept == (0 if name == "language_id" else 2)
