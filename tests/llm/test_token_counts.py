import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brisa.llm import token_counts as op10

PATH = public_tokenizers.path("byte_bpe_50k.json")
EDGES = ["", " ", "  a", "a  ", "\n\n x", "it's we'll I'd", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "<|endoftext", "\x1c\x1d a\x85b c　",
         "x" * 5000, "ab" * 3000, "Ⅷ²½ 123", "漢字かな交じり文", "é 🤗🤗🤗", " ​﻿", " \t \r\n", "1234567890" * 50, "!?" * 200, "ﬁ ǅ ß ſ"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(library):
    rng = random.Random(5)
    alphabet = "ab cdeinorst  .,'\n\t12é漢ß🤗´`<|>&#  _-"
    texts = EDGES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 0xD800), rng.randrange(32, 0x250), rng.randrange(0xE000, 0x11000)))) for _ in range(30)) for _ in range(500)]
    counts = op10.counts_of(PATH)
    wrong = [t for t, n in zip(texts, library(texts)) if op10.count_text(counts, t) != n]
    assert not wrong


def test_every_proved_string_is_one_token(library):
    whole = list(op10.counts_of(PATH).model.whole)
    assert len(whole) > 45_000 and set(library(whole)) == {1}


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "it's", "y"), (3, "it's", "y"), (None, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = sorted(op10.token_counts(df, PATH, limit=1).collect(), key=str)
    assert [tuple(r) for r in out] == sorted([(1, 0, 0, False), (2, 0, 0, False), (3, 4, 2, True), (3, 4, 2, True), (None, 3, 2, True)], key=lambda r: str(op10_row(r)))
    assert op10.token_counts(df.limit(0), PATH).count() == 0


def op10_row(r):
    from pyspark.sql import Row
    return Row(doc_id=r[0], n_bytes=r[1], n_tokens=r[2], over_limit=r[3])
