import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from brisa.llm import merkle as op5


def prints(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.fingerprint for r in op5.fingerprints(df).orderBy("doc_id").collect()]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def by_hand(text, ends):
    """The tree written plainly; `ends` are the words after which a piece ends."""
    sections, now = [], []
    for p in text.split("\n"):
        got, piece = [], []
        for w in p.replace("\x01", "\x01\x01").split(" "):
            piece.append(w + "\x01" if w in ends else w)
            if w in ends or w.endswith("\x01"):      # a mark of the text itself ends a piece too
                got, piece = got + [piece], []
        got.append(piece) if piece else None
        cut, first = [], True
        for piece in got:
            cut.append(("" if first else " ") + " ".join(piece))
            first = False
        hashes = [f"{sha(c)}-{len(c)}" for c in cut]
        full = sha(",".join(hashes))
        now.append((full, [h[:op5.SHORT] + h[65:] for h in hashes]))
        if full < "4":
            sections, now = sections + [now], []
    sections += [now] if now else []
    named = [(sha(" ".join(f for f, _ in s)), s) for s in sections]
    root = sha(f"{len(text)}:" + ",".join(h for h, _ in named))
    return root + ":" + ";".join(h[:op5.SHORT] + "=" + " ".join(f[:op5.SHORT] + "/" + ",".join(x) for f, x in s) for h, s in named)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = ["w%d" % i for i in range(400)] + ["é", "漢字", "", "\x01", "a\x01"]
    return ["", " ", "\n", "\n\n", "x", "x ", " x", "\x01", "a\x01 b"] + [
        "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 30))) for _ in range(40)]


def test_tree_equals_the_plain_one(spark, texts):
    words = {w for t in texts for p in t.split("\n") for w in p.replace("\x01", "\x01\x01").split(" ")}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    ends = {r.w for r in df.filter(F.pmod(F.xxhash64("w"), F.lit(op5.PIECE)) == 0).collect()}
    assert prints(spark, texts) == [by_hand(t, ends) for t in texts]


def test_equal_texts_and_only_they_have_equal_fingerprints(spark, texts):
    other = texts + ["a b", "a\x01 b", "a b\x01", "b a", "a  b", "a\nb", "a b\n"]
    found = prints(spark, other)
    assert len(set(found)) == len(set(other)) and prints(spark, [None]) == prints(spark, [""])
    assert len({f[:64] for f in found}) == len(set(other))


def leaf_sets(p):
    return set(re.split("[,; ]", re.sub("[0-9a-f]+[=/]", "", p[65:])))


def test_likeness_and_differing_branches(spark):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(3000)]
    a = "\n".join(" ".join(rng.choice(words) for _ in range(80)) for _ in range(20))
    at = len(a) // 2
    b = a[:at] + "inserted words here" + a[at:]
    c = " ".join("v%d" % i for i in range(500))
    p = prints(spark, [a, b, c])
    df = spark.createDataFrame([(p[0], p[1], p[2])], "a string, b string, c string").select(
        op5.likeness(F.col("a"), F.col("b")).alias("ab"), op5.likeness(F.col("a"), F.col("c")).alias("ac"), op5.likeness(F.col("a"), F.col("a")).alias("aa"),
        op5.differing(F.col("a"), F.col("b")).alias("where"), op5.differing(F.col("a"), F.col("a")).alias("nowhere")).first()
    weigh = lambda s: sum(int(x[op5.SHORT:]) + 1 for x in s)
    x, y = leaf_sets(p[0]), leaf_sets(p[1])
    assert df.ab == pytest.approx(weigh(x & y) / weigh(x | y)) and df.ab > 0.9 and df.ac == 0 and df.aa == 1
    assert 1 <= len(df.where) <= 3 and df.nowhere == [] and all(abs(r.start - at) < 0.1 * len(a) for r in df.where)


@pytest.mark.parametrize("rows_of_range", [2, 500])
def test_edited_texts(spark, monkeypatch, rows_of_range):
    monkeypatch.setattr(op5, "ROWS_OF_RANGE", rows_of_range)
    rng = random.Random(4)
    ids = rng.sample(range(-50, 10 ** 12), 18) + [2 ** 62, 2 ** 62 + 1, 7, 7, 7]
    rows = [(i, rng.choice(["", None, "é漢🤗", "short", "word " * rng.randint(1, 40), "x" * 70_000]) if k < 20 else t, "c", "d")
            for k, (i, t) in enumerate(zip(ids, [None] * 20 + ["one", "two", None]))]
    rows += [(None, "no id", "", ""), (None, None, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, next_text string").repartition(5)
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want.append((str(i), len(t), sha(t[:len(t) - half] + following[:half])))
    out = op5.edited_fingerprints(df).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in out) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert op5.edited_fingerprints(df.limit(0)).count() == 0
    lone = op5.edited_fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert lone.edited_sha256 == sha("abab") and lone.near_next == 1
