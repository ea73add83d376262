from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from brisa.llm import language
from brisa.llm.common import staged, table
from tests.llm import test_line_dedup, test_mixing, test_ngram_join

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(staged(stage(spark, docs[-1], SF), "test"))
    return docs


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_stay(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_language_stage(stages):
    model = language.learn(stages[0])
    before = rows(stages[0])
    found = language.labelled(model, [t or "" for _, t in before]).to_pylist()
    want = [i for (i, _), f in zip(before, found) if f["lang_pred"] != "und" and (f["score"] >= 0.5 or any(s["end"] - s["start"] >= 40 for s in f["spans"]))]
    assert sorted(i for i, _ in rows(stages[1])) == sorted(want) and len(want) > 150


def test_line_stage(stages):
    want = [(i, t) for i, t, n in test_line_dedup.brute(rows(stages[1]), 80, 100, 1) if not (n and not t.strip())]
    assert sorted((str(i), t) for i, t in rows(stages[2])) == sorted(want)


def test_document_stage(stages):
    found = test_ngram_join.brute(rows(stages[2]), 5, 80, 100)
    assert sorted(str(i) for i, _ in rows(stages[3])) == sorted(i for i, _, c in found if i == c)


def test_mixing_stage(stages):
    before = stages[3].collect()
    size = Counter(r.source for r in before)
    share = {s: n ** 0.5 for s, n in size.items()}
    want = Counter()
    for r in before:
        n = test_mixing.count(share[r.source] / sum(share.values()) * len(before) / size[r.source], "mix", r.doc_id)
        if n:
            want[r.doc_id, r.text] += n
    assert Counter(rows(stages[4])) == want


def test_token_stage(spark, stages):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, library.encode(t)) for i, t in rows(stages[4]))
    assert sorted((r.doc_id, r.ids) for r in stages[5].collect()) == want
    assert sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, SF).collect()) == want
