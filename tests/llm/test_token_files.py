import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brisa.llm import pretokens, queries, token_files as op11

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def texts_of_all_kinds(n):
    rng = random.Random(3)
    strange = [chr(c) for c in pretokens.agreed(PATH)[1]] or ["a"]
    pool = [lambda: rng.choice("ab cde 's12é漢ß🤗<|>\n\t"), lambda: rng.choice(strange), lambda: chr(rng.randrange(32, 0xD800)), lambda: "<|endoftext|>", lambda: chr(rng.randrange(0xE000, 0x20000))]
    return ["".join(rng.choice(pool)() for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_are_those_of_the_library(library):
    texts = texts_of_all_kinds(3000) + ["", " ", "x" * 5000, "ab " * 3000, "'s 'll<|endoftext|><|endoftext|> a", "a  b", "a \n b\n c", " a ", "a\u00a0 b\u2003 c", "x\t y", "it 's 'sa 'ab"]
    ids = op11.Ids(PATH, pretokens.agreed(PATH), 2)
    for text, want in zip(texts, library(texts)):
        assert np.frombuffer(ids.of(text), "<u2").tolist() == want


def test_perfect_hash_has_every_slot_once():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(-1 << 62, 1 << 62, n))
        id_ = np.concatenate([keys, keys[:n // 2], np.zeros(n // 4, np.int64)])
        copy = np.concatenate([np.zeros(len(keys), np.int64), np.ones(len(keys[:n // 2]), np.int64), np.arange(n // 4)])
        missing = np.arange(len(id_)) >= len(id_) - n // 4
        perfect = op11.PerfectHash.build(id_, missing, copy)
        assert np.sort(perfect.slots(id_, missing, copy)).tolist() == list(range(len(id_)))


def expected(rows, library):
    """Rows of one id are in the order of their hashes, so they are compared as a set with their sizes."""
    out, at = [], 0
    for key, text in rows:
        raw = np.array(library([text or ""])[0] + [2], "<u4").tobytes()
        out.append((key, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    return out


def result(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[1])


def test_query_on_a_table(spark, tmp_path, library):
    texts = texts_of_all_kinds(300)
    rows = [(7 * i - 500, t, "x") for i, t in enumerate(texts)] + [(9000, None, "y"), (9001, "", "y"), (9002, "long " * 40_000, "y")]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = result(queries.QUERIES["op11_token_files"](spark, str(tmp_path)))
    assert got == expected(sorted((r[0], r[1]) for r in rows), library)


def test_repeated_and_null_ids(spark, library):
    rows = [(None, "a b"), (None, "c"), (None, None)] + [(5, f"text {i}") for i in range(400)] + [(5, "same")] * 50 + [(6, "z")]
    files, keys = op11.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH, end_id=2)
    got = files.documents(keys).collect()
    assert len(got) == len(rows) and len({(r.doc_id, r.copy) for r in got}) == len(rows)
    assert sorted(r.copy for r in got if r.doc_id == 5) == list(range(450)) and sorted(r.copy for r in got if r.doc_id is None) == [0, 1, 2]
    want = [(k, np.array(i + [2], "<u4").tobytes()) for (k, _), i in zip(rows, library([t or "" for _, t in rows]))]
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=str) == sorted(want, key=str)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.cumsum([0] + [r.n_tokens for r in by_start])[:-1].tolist()
    assert [r.doc_id for r in by_start] == [None] * 3 + [5] * 450 + [6]
    assert [r.copy for r in by_start if r.doc_id == 5] == list(range(450))


def test_keys_that_are_not_stored(spark):
    files, _ = op11.write_tokens(spark.createDataFrame([(i, f"t {i}") for i in range(100)], "doc_id long, text string"), PATH)
    asked = spark.createDataFrame([(3, 0), (3, 0), (3, 1), (100, 0), (None, 0), (-1, 0), (99, 0)], "doc_id long, copy long")
    assert sorted((r.doc_id, r.copy) for r in files.lookup(asked).collect()) == [(3, 0), (99, 0)]


def test_rolled_shards(spark, library, monkeypatch, tmp_path):
    rows = [(i, f"some words of text {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(op11, "SHARD_BYTES", 40)
    shards = op11.Shards(str(tmp_path), 1, 2)
    places = [shards.add(np.arange(7, dtype="<u2").tobytes()) for _ in range(10)]
    shards.close()
    assert places == [(op11.ROLL + i // 3, i % 3 * 7) for i in range(10)]
    files, keys = op11.write_tokens(df, PATH, end_id=2)
    assert [r[1:3] for r in result(files.documents(keys).select("doc_id", "start", "n_tokens"))] == [r[1:3] for r in expected(rows, library)]


def test_empty_table(spark):
    files, keys = op11.write_tokens(spark.createDataFrame([], "doc_id long, text string, n string"), PATH, end_id=2)
    assert files.documents(keys).count() == 0 and files.lookup(spark.createDataFrame([(1, 0)], "doc_id long, copy long")).count() == 0
