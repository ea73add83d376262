import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from brisa.llm import periodic_runs as op12, queries


def brute(words, least=6):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def with_repeats(rng, letters, longest):
    words = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
    for _ in range(rng.randint(0, 4)):
        period = [rng.choice(letters) for _ in range(rng.randint(1, longest))]
        size = rng.randint(len(period), 7 * len(period))
        words += [period[i % len(period)] for i in range(size)] + [rng.choice(letters) for _ in range(rng.randint(0, 30))]
    return words


def test_all_runs_of_a_block_are_those_of_brute_force():
    rng = random.Random(4)
    for _ in range(12):
        texts = [with_repeats(rng, *rng.choice([("ab", 6), ("abc", 30), ([f"w{i}" for i in range(500)], 90), (["x"], 3)])) for _ in range(30)]
        count, runs, left = op12.block_rows([[w.encode() for w in t] for t in texts], 6)
        at = np.concatenate([[0], np.cumsum(count)])
        for k, t in enumerate(texts):
            want = brute(t)
            assert [tuple(r) for r in runs[at[k]:at[k + 1]].tolist()] == want
            assert left[k] == " ".join(collapsed(t, want)).encode()


def test_strings_full_of_runs():
    fib = ["a", "ab"]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    for text in (fib[-1][:1500], "a" * 900, "ab" * 300 + "a" * 300, ("a" * 20 + "b") * 40, "".join("ab"[bin(i).count("1") % 2] for i in range(800)) * 5):
        _, runs, _ = op12.block_rows([[c.encode() for c in text]], 6)
        assert [tuple(r) for r in runs.tolist()] == brute(text)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(collapsed(words, runs))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(kept)


def test_query_on_a_table(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(with_repeats(rng, [f"é{k}" for k in range(rng.choice((2, 5, 300)))], rng.choice((4, 40)))) + rng.choice(("", " ", "\t\n", "\x1c x\x85y"))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (-5, "a " * 6), (1003, "A a " * 9), (1003, "A a " * 9), (zlib.crc32(b"x"), "w " * 3000), (1004, " ".join(f"w{i % 2500}" for i in range(11_000)))]
    spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, runs string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(*r) for r in rows), key=str)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a a a a a a"), (None, None)], "doc_id long, text string")
    planted = op12.with_planted_runs(df)
    assert sorted((r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in op12.periodic_runs(planted).collect()) == [(0, [], ""), (6, [(0, 6, 1)], "a")]
    assert op12.periodic_runs(df.limit(0)).count() == 0
