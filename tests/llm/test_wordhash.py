import random
import re

import numpy as np
import pyarrow as pa

from brisa.llm import wordhash

TEXTS = ["", None, " ", "a", "a b", "A  b\tc\n", "\x0b\x0cx", "é É ß漢 🤗", "a b c", "x" * 5000, " lead trail ", "b a", "ab c", "a bc"]


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x20\x09-\x0d]+", low)


def test_equal_hashes_are_equal_words(monkeypatch):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab AB\n\té") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    seen = {}
    for size in (1, 64, 4 << 20):
        monkeypatch.setattr(wordhash, "BLOCK", size)
        k = 0
        for data, at in wordhash.blocks(pa.array(texts)):
            h, first = wordhash.word_hashes(data, at)
            for a, b in zip(first[:-1], first[1:]):
                want = words(texts[k])
                assert b - a == len(want)
                for w, x in zip(want, h[a:b]):
                    assert seen.setdefault(w, x) == x
                k += 1
        assert k == len(texts)
    assert len(set(seen.values())) == len(seen)
    sliced = [len(f) - 1 for _, f in map(lambda b: wordhash.word_hashes(*b), wordhash.blocks(pa.array(texts)[5:9]))]
    assert sum(sliced) == 4


def test_shingle_sets():
    texts = ["a b c d", "a b c d a b c", "a b", "b a", "a", "", "a b \n c"]
    got = [set(s.tolist()) for s in wordhash.shingle_sets(pa.array(texts), 3)]
    assert [len(s) for s in got] == [2, 4, 1, 1, 1, 0, 1]
    assert got[0] < got[1] and got[6] < got[0] and len(got[2] | got[3] | got[4]) == 3
    assert all(np.all(np.diff(s.astype(object)) > 0) for s in wordhash.shingle_sets(pa.array(texts), 3) if len(s) > 1)
