import itertools
import zlib

import numpy as np
import pytest

from brisa.llm import language as op8
from brisa.llm.common import table

SF = "/root/testdata/sf0.01"


def best_path(scores, penalty):
    m = scores.shape[1]
    total = lambda p: sum(scores[i, k] for i, k in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
    return max(map(total, itertools.product(range(m), repeat=len(scores)))), total


def test_viterbi_equals_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    text = np.repeat([0, 2, 3, 7], [4, 1, 6, 5])
    for _ in range(30):
        scores = rng.normal(size=(len(text), 3)) * 3
        label = op8.viterbi(scores, text, 2.0)
        for t in set(text):
            best, total = best_path(scores[text == t], 2.0)
            assert total(label[text == t]) == pytest.approx(best)


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    rows = op8.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = [r.lang_pred == r.lang for r in rows if r.held_out and r.lang_pred != "und"]
    assert len(right) > 200 and sum(right) / len(right) > 0.97


@pytest.fixture(scope="module")
def model(spark):
    words = {"aa": "lorem dolor amet", "bb": "zyx wvut qpq", "ru": "слово дело мир", "zh": "漢字文書"}
    rows = [(i, words[k], k) for i in range(400) for k in words]
    return op8.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_spans_of_mixed_texts_and_scripts(model):
    text = "Lorem dolor amet lorem dolor! zyx wvut qpq zyx wvut qpq слово дело 12 漢字文書"
    row = op8.labelled(model, [text, "", "123 !?", "ελληνικά", "lorem"]).to_pylist()
    found = [(text[s["start"]:s["end"]], s["lang"]) for s in row[0]["spans"]]
    assert found == [("Lorem dolor amet lorem dolor", "aa"), ("zyx wvut qpq zyx wvut qpq", "bb"), ("слово дело", "ru"), ("漢字文書", "zh")]
    assert row[0]["lang_pred"] == "aa" and 0.3 < row[0]["score"] < 0.6
    assert [(r["lang_pred"], r["score"], r["spans"]) for r in row[1:3]] == [("und", 0.0, [])] * 2
    assert row[3]["lang_pred"] in model.languages and row[4]["score"] == 1.0


def test_results_do_not_depend_on_the_block(model, monkeypatch):
    texts = ["lorem zyx " * k for k in range(40)] + ["слово " * 5000]
    whole = op8.labelled(model, texts).to_pylist()
    monkeypatch.setattr(op8, "BLOCK", 10)
    assert [r for b in op8.blocks(texts) for r in op8.labelled(model, b).to_pylist()] == whole


def test_edge_rows(spark, model):
    rows = [(None, None, None, 1), (1, "", "aa", 1), (2, "lorem", None, 1), (2, "lorem", None, 1), (3, "zyx wvut " * 30_000, "bb", 2), (4, "!", "aa", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = op8.identify(df, model).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in out) == [("1", "und"), ("2", "aa"), ("2", "aa"), ("3", "bb"), ("4", "und"), ("None", "und")]
    assert op8.identify(df.limit(0), model).count() == 0
    nothing = op8.identify(df.filter("lang is null")).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and op8.identify(df.limit(0)).count() == 0
    keep = op8.kept(df, model)
    assert keep.columns == df.columns and sorted(r.doc_id for r in keep.collect()) == [2, 2, 3]
