import random
import re

import pyarrow as pa
import pytest

from brisa.llm import line_dedup as op3, queries, wordhash
from brisa.llm.common import table


def words(line):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return frozenset(re.findall("[^\x20\x09-\x0d]+", low))


def brute(rows, num, den, least):
    places = []
    for i, t in rows:
        if i is not None and t is not None:
            places += [(i, k, words(x)) for k, x in enumerate(t.split("\n"))]
    first = {}
    for i, k, s in places:
        if len(s) >= least:
            first[s] = min(first.get(s, (i, k)), (i, k))
    sets = list(first)
    by_word = {}
    for s in sets:
        for w in s:
            by_word.setdefault(w, []).append(s)
    best = dict(first)
    for s in sets:
        for o in {o for w in s for o in by_word[w]}:
            if den * len(s & o) >= num * len(s | o):
                best[s] = min(best[s], first[o])
    out = []
    for i, t in rows:
        if i is None or t is None:
            out.append((str(i), str(t), 0))
            continue
        lines = t.split("\n")
        keep = [x for k, x in enumerate(lines) if not (len(words(x)) >= least and best[words(x)] < (i, k))]
        out.append((str(i), "\n".join(keep), len(lines) - len(keep)))
    return sorted(out)


def got(df, num, den, least):
    return sorted((str(r.doc_id), str(r.text), r.n_removed) for r in op3.without_repeated_lines(df, num, den, least).collect())


def corpus(rng):
    common, rare = ["the", "of", "a", "to"], ["w%d" % i for i in range(150)]
    base = [[rng.choice(common + rare) for _ in range(rng.choice((1, 3, 5, 6, 8, 12, 20, 45, 120)))] for _ in range(25)]
    rows = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 8)):
            w = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 2, len(w) // 6))):
                w[rng.randrange(len(w))] = rng.choice(rare + ["X", "é"])
            rng.shuffle(w) if rng.random() < 0.1 else None
            lines.append(rng.choice(("", " ")) + " ".join(w).replace("w1", rng.choice(("w1", "W1"))))
        rows.append("\n".join(lines))
    rows += ["", None, "\n\n", "\r\n x", rows[0], rows[1]]
    ids = rng.sample(range(-500, 10 ** 10), len(rows))
    out = list(zip(ids, rows))
    return out + [out[5], (None, out[5][1]), (None, None), (out[6][0], out[7][1])]


@pytest.mark.parametrize("num,den,least,hot,first", [(80, 100, 5, 1 << 18, 2), (1, 2, 1, 7, 1)])
def test_equals_all_pairs(spark, monkeypatch, num, den, least, hot, first):
    monkeypatch.setattr(op3, "HOT", hot)
    monkeypatch.setattr(op3, "FIRST", first)
    monkeypatch.setattr(op3, "CHUNK", 50)
    rows = corpus(random.Random(least))
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, n_lines string, set int").repartition(4)
    assert got(df, num, den, least) == brute(rows, num, den, least)


def test_equals_all_pairs_on_the_documents_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    assert got(df, 80, 100, 5) == brute([(r.doc_id, r.text) for r in df.collect()], 80, 100, 5)


def test_columns_emptied_rows_and_empty_table(spark):
    line = "one two three four five six"
    rows = [(1, line + "\nx", "a"), (2, line, "b"), (3, "", "c"), (4, None, "d"), (5, "tiny", "e"), (6, line + "\n\n", "f"), (None, line, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    out = op3.without_repeated_lines(df, marks=False, drop_emptied=True)
    assert out.columns == df.columns
    assert sorted((r.gone, r.text) for r in out.collect()) == [("a", line + "\nx"), ("c", ""), ("d", None), ("e", "tiny"), ("g", line)]
    assert op3.without_repeated_lines(df.limit(0)).count() == 0


def test_the_query_removes_short_lines_and_lines_without_spaces(spark, monkeypatch):
    han, thai = "春眠不覚暁処処聞啼鳥夜来風雨声花落知多少国破山河在城春草木深", "ภาษาไทยเขียนติดกันโดยไม่เว้นวรรคระหว่างคำ"
    rows = [(1, f"Home\none two three four\n{han}\n{thai}\n人\n日本語 text"), (2, f"home\none two three four five\n{han[:-1]}心\n{thai}\n人\n本日語 text"), (3, "a a b\nb a\n" + thai[::-1] + "\n\n \n"),
            (4, han[::-1] + "\nhome alone\n" + han + " x")]
    monkeypatch.setattr(queries, "table", lambda *_: spark.createDataFrame(rows, "doc_id long, text string"))
    out = {r.doc_id: (r.text, r.n_removed) for r in queries.op3_line_dedup(spark, "").collect()}
    assert out == {1: (rows[0][1], 0), 2: ("本日語 text", 5), 3: ("a a b\n" + thai[::-1] + "\n\n \n", 1), 4: (han[::-1] + "\nhome alone", 1)}


def test_runs_of_characters_are_those_of_plain_python():
    texts = ["", "日本", "日本語の文 is x日本語", "春", "𠀀𠀁𠀂𠀃 A", "ไทย", "é 한국어 말"]
    want = []
    for t in texts:
        tokens = [w for part in re.split("[\x20\x09-\x0d]+", t) for run in re.findall("[฀-๿぀-ヿ㐀-鿿\U00020000-\U00033fff]+|[^฀-๿぀-ヿ㐀-鿿\U00020000-\U00033fff]+", part)
                  for w in ([run[i:i + 3] for i in range(max(1, len(run) - 2))] if ord(run[0]) >= 0xE00 and not "가" <= run[0] <= "힣" else [run])]
        want.append(sorted({int(wordhash.word_hashes(*next(wordhash.blocks(pa.array([w]))))[0][0]) for w in tokens}))
    data, at = next(wordhash.blocks(pa.array(texts)))
    h, first = wordhash.word_hashes(data, at, runs=True)
    assert [sorted({int(x) for x in h[a:b]}) for a, b in zip(first[:-1], first[1:])] == want
    data, at = next(wordhash.blocks(pa.array(["no such letters"])))
    assert len(wordhash.word_hashes(data, at, runs=True)[0]) == 3
