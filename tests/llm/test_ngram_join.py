import random
import re

import numpy as np
import pytest

from brisa.llm import ngram_join as op7, wordhash
from brisa.llm.common import table

SF = "/root/testdata/sf0.01"


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    pairs = set()
    for v in index.values():
        pairs |= {(a, b) for a in v for b in v if a < b}
    for a, b in pairs:
        i = len(sets[a] & sets[b])
        if rows[a][0] is not None and rows[b][0] is not None and den * i >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(rows[a][0]), find(rows[b][0])))
            root[y] = x
    return sorted((str(i), len(s), str(None if i is None else find(i))) for (i, _), s in zip(rows, sets))


def got(df, k, num, den, **plan):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in op7.ngram_components(df, k, num, den, **plan).collect())


def corpus(rng):
    vocabulary = ["w%d" % i for i in range(60)]
    rows = []
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 3, 4, 6, 9, 14, 25, 60, 200, 400)))]
        for _ in range(rng.randint(1, 12)):
            w = list(words)
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                at = rng.randrange(len(w))
                w[at:at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2) or ["x"]
            rows.append(" ".join(w))
    rows += ["", None, " \n", rows[0], rows[0].upper(), rows[-1]]
    ids = rng.sample(range(-1000, 10 ** 12), len(rows))
    out = list(zip(ids, rows))
    return out + [out[3], (None, out[3][1]), (None, None), (out[4][0], "another text of the same id"), (out[4][0], out[9][1])]


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100), (1, 1, 2)])
def test_components_equal_all_pairs(spark, k, num, den):
    rng = random.Random(k)
    rows = corpus(rng)
    df = spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "doc_id long, text string, n long, lo string").repartition(3)
    want = brute(rows, k, num, den)
    if k != 1:
        assert got(df, k, num, den) == want
        return
    # plans with one-deletion neighbourhoods must find the same
    longest = max(len(shingles(t, k)) for _, t in rows)
    loose = []
    for b in op7.bands(longest, num, den):
        h = b[3]
        loose.append(op7.Band(*b[:3], (h + 1) % 2, (h + 1) // 2, 0) if h else op7.Band(*b[:3], 1, 0, 0))
    assert got(df, k, num, den, plan=loose) == want


def test_pigeonhole_holds_for_every_linked_pair():
    rng = np.random.default_rng(7)
    for num, den in ((90, 100), (80, 100), (1, 2)):
        limits = op7.bands(600, num, den)
        for plan in ([op7.planned(b, n) for b in limits] for n in (2, 10 ** 4, 10 ** 8, 10 ** 11)):
            assert all(b.exact + 2 * b.loose == l[3] + 1 + b.spare for b, l in zip(plan, limits))
            signatures = op7.Signatures(plan)
            for _ in range(150):
                n = int(rng.integers(1, 400))
                s = np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64))
                cut = int(rng.integers(0, 1 + n * (den - num) // den))
                extra = rng.integers(0, 2 ** 64, int(rng.integers(0, 1 + n * (den - num) // den)), dtype=np.uint64)
                t = np.unique(np.concatenate([rng.permutation(s)[cut:], extra]))
                common = len(np.intersect1d(s, t))
                if common and den * common >= num * (len(s) + len(t) - common):
                    assert len(np.intersect1d(signatures.of(s), signatures.of(t))), (len(s), len(t), common)


def test_components_of_the_documents_table(spark):
    df = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(df, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_one_document_of_each_component_stays(spark):
    text = " ".join("w%d" % i for i in range(80))
    rows = [(9, text, "a"), (4, text + " x", "b"), (5, text.replace("w40 ", ""), "c"), (7, "other", None), (8, "", "d"), (3, None, "e"), (None, text, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    assert sorted((str(r.doc_id), r.component_id) for r in op7.one_of_each(df).collect()) == [("3", "e"), ("4", "b"), ("7", None), ("8", "d"), ("None", "f")]
    empty = df.limit(0)
    assert op7.one_of_each(empty).count() == 0 and op7.ngram_components(empty).count() == 0
    assert wordhash.BLOCK > 0


def test_only_signatures_that_meet_travel_as_rows(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(rng.choice((3, 20, 90, 300)))) for _ in range(60)]
    texts += [texts[0], texts[5] + " y", texts[6] + " y", texts[6] + " z", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    plan = [op7.planned(b, 100) for b in op7.bands(400, 80, 100)]
    signatures, want = op7.Signatures(plan), {}
    for text in texts:
        for s in wordhash.shingle_sets(op7.pa.array([text], op7.pa.string()), 5):
            for key in signatures.of(s).view(np.int64).tolist():
                want.setdefault(key, []).append(op7.described_lo(s))
    repeated = {k: sorted(v) for k, v in want.items() if len(v) > 1}
    got, often = {}, set()
    for r in op7.signature_rows(df, 5, plan).collect():
        got.setdefault(r.key, []).append(r.lo)
        often |= {r.key} if r.often else set()
    assert repeated and {k: sorted(got.get(k, [])) for k in repeated} == repeated
    assert {k for k, v in repeated.items() if len(v) > 2} <= often
    assert sum(map(len, got.values())) < 1.1 * sum(map(len, repeated.values())) < 0.5 * sum(map(len, want.values()))


def test_a_full_map_of_marks_loses_no_signature(spark, monkeypatch):
    monkeypatch.setattr(op7, "MOST_MARKS", 8 << op7.BUCKET_BITS)        # most places are marked, few keys are ruled out
    df = table(spark, SF, "documents").limit(300)
    assert got(df, 3, 90, 100) == brute([(r.doc_id, r.text) for r in df.collect()], 3, 90, 100)


def test_no_signature_is_repeated(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "f g h i j k l")], "doc_id long, text string")
    assert got(df, 3, 90, 100) == [("1", 3, "1"), ("2", 5, "2")]
