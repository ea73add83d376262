"""Near duplicates among embeddings by p-stable hashing.

Vectors are scaled to length one; cosine c is then the distance sqrt(2 - 2c). A table quantises
HASHES random Gaussian projections in steps of WIDTH, and vectors whose quantised projections all
agree share a bucket. Two vectors at the threshold 0.98 (distance 0.2) agree in one projection with
probability 0.80, so in one of TABLES tables with 0.988; nearer ones meet more often. Unrelated
vectors share a bucket of a table with about 5e-6. Whatever meets is compared exactly.

Equal vectors count as one with a weight. A bucket is cut in blocks of about BLOCK members, and each
pair of blocks is compared by a matrix product in one task, which gives sums and a spanning star for
each member, never the pairs. A pair that meets in several tables counts in the first."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brisa.llm.common import components, groups, staged
from brisa.llm.wordhash import mixed

TABLES, HASHES, WIDTH, SEED = 24, 8, 0.8, 20240501
BLOCK = 512


@lru_cache(maxsize=8)
def projections(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions and offsets of all tables for vectors of one size."""
    rng = np.random.default_rng([SEED, size])
    return rng.normal(size=(size, TABLES * HASHES)), rng.uniform(0, WIDTH, TABLES * HASHES)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by their largest component first, so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_keys(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Bucket of every vector in every table, for unit rows of one size with hashed labels."""
    a, b = projections(x.shape[1])
    q = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), TABLES, HASHES)
    h = mixed(label.astype(np.int64).view(np.uint64) + np.uint64(x.shape[1]))[:, None] + np.arange(TABLES, dtype=np.uint64)[None, :]
    for k in range(HASHES):
        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + q[:, :, k])
    return h.view(np.int64)


def matrices(vectors: pa.Array):
    """(row numbers, matrix) for each size of vector in a list column."""
    size = np.asarray(vectors.value_lengths())
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    at = np.concatenate([[0], np.cumsum(size)])
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, flat[at[rows][:, None] + np.arange(n)[None, :]]


def usable(vector: Column, label: Column) -> Column:
    """Has a label, and a vector with finite components that are not all zero."""
    whole = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(label.isNotNull() & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def bucket_rows(sets: DataFrame) -> DataFrame:
    """(bucket, tab, node): where each distinct vector falls."""
    def emit(batches):
        for batch in batches:
            node, label = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for rows, x in matrices(batch.column(2)):
                keys = bucket_keys(unit(x), label[rows])
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.ravel()), pa.array(np.tile(np.arange(TABLES, dtype=np.int32), len(rows))), pa.array(np.repeat(node[rows], TABLES))],
                    ["bucket", "tab", "node"])
    return sets.select("node", "label", "vector").mapInArrow(emit, "bucket long, tab int, node long")


def compared(x: np.ndarray, label: np.ndarray, part: np.ndarray, weight: np.ndarray, tab: int, least: float, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """For the members of one pair of blocks: the smallest member (by position) each is connected
    with, and the weight of the partners that it meets here first. Members are of one size;
    `across` two blocks only members of different parts are compared."""
    u = unit(x)
    near = u @ u.T >= least
    if across:
        near &= part[:, None] != part[None, :]
    near &= label[:, None] == label[None, :]
    np.fill_diagonal(near, False)
    star = np.arange(len(x))
    if not near.any():
        return star, np.zeros(len(x), np.int64)
    while True:
        reached = np.minimum(star, np.where(near, star[None, :], len(x)).min(axis=1))
        reached = np.minimum(reached, reached[reached])
        if (reached == star).all():
            break
        star = reached
    i, j = np.nonzero(near)
    keys = bucket_keys(u, label)
    links = np.zeros(len(x), np.int64)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
        mine = (keys[a] == keys[b]).argmax(axis=1) == tab
        np.add.at(links, a[mine], weight[b[mine]])
    return star, links


def met(rows: DataFrame, least: float) -> DataFrame:
    """(node, root, links) of every member of every pair of blocks in `rows` (bucket, tab, i, j,
    part, node, label, weight, vector), which is dealt and sorted by (bucket, i, j)."""
    def work(batches):
        for g in groups(batches, ("bucket", "i", "j")):
            if len(g) < 2:
                continue
            col = lambda c: np.asarray(g.column(c).combine_chunks())  # noqa: B023, E731
            node, part, label, weight = (col(c) for c in ("node", "part", "label", "weight"))
            tab, across = g.column("tab")[0].as_py(), g.column("i")[0].as_py() != g.column("j")[0].as_py()
            for at, x in matrices(g.column("vector").combine_chunks()):
                if len(at) > 1:
                    star, links = compared(x, label[at], part[at], weight[at], tab, least, across)
                    hit = (links > 0) | (star != np.arange(len(at)))
                    if hit.any():
                        yield pa.RecordBatch.from_arrays([pa.array(node[at][hit]), pa.array(node[at][star][hit]), pa.array(links[hit])], ["node", "root", "links"])
    return rows.mapInArrow(work, "node long, root long, links long")


def vector_links(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links (other rows of the same label whose cosine in
    double precision is `least` or more and that met in a table), component_id (the smallest id that
    links reach, itself included) and kept (it is that smallest one).

    A row whose label or vector is null, whose vector is empty, zero or holds null or non-finite
    components, links with nothing. Vectors of different sizes never link. Rows with the same id
    are vectors of their own. A null id counts as a link of others and is never a component unless
    all of its component are null; it is not kept. An empty table gives no rows; other columns are not looked at."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", usable(F.col("vector"), F.col("label")))
    rows = rows.withColumn("node", F.when(F.col("ok"), F.xxhash64("label", "vector")))
    sets = staged(rows.filter("ok").groupBy("node").agg(
        F.xxhash64(F.first("label")).alias("label"), F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("vec_id").alias("first")), "vectors")
    fallen = bucket_rows(sets)
    shared = staged(fallen.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    blocks = F.ceil(F.col("n") / BLOCK)
    members = fallen.join(shared, "bucket").withColumn("part", F.pmod(F.xxhash64("node", "tab"), blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    members = members.select("bucket", "tab", "node", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    rows_of_blocks = members.join(sets.drop("first"), "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = staged(met(rows_of_blocks, least), "met")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reach = components(found.filter("node <> root").select("node", "root"), "node", "root")
    named = sets.join(reach, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    known = named.join(smallest, "component").join(links, "node", "left").select(
        "node", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
