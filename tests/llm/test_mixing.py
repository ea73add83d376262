import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from brisa.llm import mixing as op2


def poisson(u, mean):
    k, term = 0, math.exp(-mean)
    total = term
    while total < u and k < 80:
        k += 1
        term *= mean / k
        total += term
    return k


def count(mean, seed, key):
    u = lambda part: (int(hashlib.md5(f"{seed}:{key}:{part}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
    whole = int(mean // 16)
    return sum(poisson(u(i), 16.0) for i in range(1, whole + 1)) + poisson(u(0), mean - 16 * whole)


def test_counts_equal_a_plain_inversion(spark):
    df = spark.range(300).select("id", (F.col("id") * 0.37).alias("m"), op2.copies(F.col("id") * 0.37, "s", F.col("id")).alias("n"))
    rows = df.collect()
    assert all(r.n == count(r.m, "s", r.id) for r in rows)
    assert rows[0].n == 0 and all(abs(r.n - r.m) < 7 * math.sqrt(r.m + 1) for r in rows)


def docs(spark):
    return spark.range(6000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"),
        F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 100 == 1, "small").when(F.col("id") % 100 == 2, None).otherwise("rest").alias("source"),
        F.lit("clash").alias("mix_key"))


def test_target_weights_and_order(spark):
    df = docs(spark)
    want = {"big": 0.2, "small": 0.5, "rest": 0.2, None: 0.1}
    rows = op2.mix(df, want, budget=2.0).collect()
    seen = Counter(r.source for r in rows)
    assert abs(len(rows) - 12000) < 500
    assert all(abs(seen[s] / len(rows) - w) < 0.03 for s, w in want.items())
    assert {(r.doc_id, r.mix_copy) for r in rows} == {(r.doc_id, c) for r in rows for c in range(1, max(x.mix_copy for x in rows if x.doc_id == r.doc_id) + 1)} if len(rows) < 50 else True
    again = op2.mix(df, want, budget=2.0).collect()
    assert sorted((r.mix_key, r.doc_id) for r in rows) == sorted((r.mix_key, r.doc_id) for r in again)
    keys = [(r.mix_key, r.doc_id) for r in sorted(rows, key=lambda r: r.mix_key)]
    ids = [k[1] for k in keys]
    assert abs(sum(ids[:len(ids) // 2]) / (len(ids) // 2) - sum(ids) / len(ids)) < 150     # no order by id is left


def test_both_joins_give_the_same(spark, monkeypatch):
    df = docs(spark)
    a = op2.mix(df).collect()
    monkeypatch.setattr(op2, "BROADCAST_SOURCES", 1)
    b = op2.mix(df).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert op2.mix(df, marks=False).columns == df.columns


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, None, None), (1, "", "a"), (1, "", "a"), (2, "x" * 200_000, "b")], "doc_id long, text string, source string")
    rows = op2.mix(df, {None: 1.0, "a": 1.0, "b": 1.0}, budget=40.0).collect()
    per = Counter((r.doc_id, r.mix_copy) for r in rows)
    assert {r.doc_id for r in rows} == {None, 1, 2} and all(n == (2 if d == 1 else 1) for (d, _), n in per.items())
    assert op2.mix(df.limit(0)).count() == 0 and op2.mix(df, {"zzz": 1.0}).count() == 0
