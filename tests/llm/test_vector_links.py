import math

import numpy as np
import pytest

from brisa.llm import vector_links as op9
from brisa.llm.common import table


def brute(rows, least=0.98):
    def fine(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ok = [fine(v, lab) for _, v, lab in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for (_, v, _), k in zip(rows, ok)]
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and (rows[a][1] == rows[b][1] or unit[a] @ unit[b] >= least):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        r = find(k)
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    return sorted((str(i), links[k], str(low[find(k)]), i is not None and i == low[find(k)]) for k, (i, _, _) in enumerate(rows))


def corpus(spread):
    rng = np.random.default_rng(11)
    rows, k = [], 0
    for label in (0, 1, 2):
        for _ in range(12):
            base = rng.normal(size=24)
            for _ in range(int(rng.integers(1, 9))):
                rows.append((1000 - k, [float(x) for x in base + rng.normal(size=24) * spread], label))
                k += 1
    rows += [(2000, rows[0][1], 0), (2001, rows[0][1], 1), (2002, rows[0][1], None), (2003, None, 0), (2004, [0.0] * 24, 0), (2005, [float("nan")] + [1.0] * 23, 0),
             (2006, [float("inf")] + [1.0] * 23, 0), (2007, [None] + [1.0] * 23, 0), (2008, [], 0), (2009, [1.0, 2.0], 0), (2010, [2.0, 4.0], 0), (None, rows[0][1], 0),
             (None, [5.0] * 3, 2), (2000, rows[0][1], 0), (2000, [9.0, -1.0], 0), (2011, [x * 1e30 for x in rows[5][1]], rows[5][2])]
    return rows


def got(spark, rows):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, weight int").repartition(5)
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in op9.vector_links(df).collect())


@pytest.mark.parametrize("block", [512, 3])
def test_close_groups_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(op9, "BLOCK", block)
    rows = corpus(0.02)                     # groups far inside the threshold: every pair meets
    assert got(spark, rows) == brute(rows)


def test_recall_and_no_wrong_link(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    rng = np.random.default_rng(5)
    for k, (i, v, label) in enumerate(rows[:200]):      # pairs all around the threshold
        v = np.array(v, float)
        noise = rng.normal(size=len(v))
        noise -= v * (noise @ v) / (v @ v)
        cosine = rng.uniform(0.975, 0.999)
        w = cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine ** 2) * noise / np.linalg.norm(noise)
        rows.append((10_000 + k, [float(x) for x in w], label))
    want = {r[0]: r[1] for r in brute(rows)}
    found = {r[0]: r[1] for r in got(spark, rows)}
    assert all(found[i] <= want[i] for i in want)
    assert sum(found.values()) >= 0.95 * sum(want.values()) > 300


def test_empty_table(spark):
    assert op9.vector_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
