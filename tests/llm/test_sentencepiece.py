import itertools
import math
import random

import public_tokenizers
import pytest
import sentencepiece

from brisa.llm import sentencepiece_fst as op1

PATH = public_tokenizers.path("piece_bpe_32k.model")
EDGES = ["", " ", "  ", "a", " a", "a ", "a  b\n\tc", "\n", "é 𝔘 <s> </s>", "▁x ▁", " " * 100 + "x" + " " * 40, "x" * 3000, "thethethe" * 400, "0123 456", "漢字かな", "🤗🤗",
         "\x00\x01", "íé", "﻿b", "don't -- stop...", "http://a.b/c?d=e&f=%20"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(fst, text):
    return [int.from_bytes(r, "little") for r in (lambda b: [b[i:i + 4] for i in range(0, len(b), 4)])(fst.encode(text))]


def test_bpe_equals_the_library(library):
    rng = random.Random(3)
    fst = op1.transducer(PATH)
    syllables = "the th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    texts = EDGES + ["".join(rng.choice(syllables + [" ", " ", ".", "\n", "é", "1"]) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice("abet  .,▁é漢🤗<>0\n") for _ in range(rng.randint(1, 50))) for _ in range(1500)]
    for t in texts:
        want = library.encode(t)
        assert ids(fst, t) == want, t
        assert fst.decode(want) == library.decode(want), t


def test_decoding_any_ids_equals_the_library(library):
    rng, fst = random.Random(9), op1.transducer(PATH)
    for _ in range(2000):
        row = [rng.choice((rng.randrange(3, 259), rng.randrange(259, 32000), rng.randrange(1, 3))) for _ in range(rng.randint(1, 8))]
        assert fst.decode(row) == library.decode(row), row


def segmentations(text):
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        yield [text[a:b] for a, b in zip(at, at[1:])]


def test_paths_equal_the_best_of_all_segmentations():
    rng = random.Random(1)
    for _ in range(40):
        lexicon = {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))): -float(rng.randint(1, 30)) for _ in range(12)}
        pieces = [("<unk>", 0.0, op1.UNKNOWN)] + [(p, s, op1.NORMAL) for p, s in lexicon.items()]
        unigram, bpe = op1.Transducer(pieces, op1.UNIGRAM), op1.Transducer(pieces, op1.BPE)
        for _ in range(20):
            text = "".join(rng.choice("abc▁") for _ in range(rng.randint(1, 8)))
            weight = lambda s: sum(-lexicon[p] if p in lexicon else unigram.unknown_weight if len(p) == 1 else math.inf for p in s)
            assert weight(unigram.path(text)) == min(map(weight, segmentations(text)))
            assert bpe.path(text) == bpe.merge(list(text))


def test_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a b", 1), (3, "a b", 1), (None, "▁", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = {(r.doc_id, r.n_tokens, r.round_trip) for r in op1.encode_documents(df, PATH).collect()}
    assert out == {(1, 0, True), (2, 0, True), (3, 2, True), (None, 1, False)}
    assert op1.encode_documents(df, PATH).count() == 5 and op1.encode_documents(df.limit(0), PATH).count() == 0
    again = df.select(op1.encoded("text", PATH).alias("ids")).select(op1.decoded("ids", PATH).alias("t")).collect()
    assert sorted(r.t for r in again) == ["", "", " ", "a b", "a b"]
