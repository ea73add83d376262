"""N-gram Jaccard join by partitioning the universe of shingles.

Two sets with Jaccard similarity of num/den or more differ in at most H elements, where H follows
from their sizes. Sizes are cut in bands so that partners lie in the same or in neighbouring bands.
For each band the hash range is cut into segments: `exact` segments, whose subset of a set is
indexed by one hash, and `loose` ones, whose subset is indexed with all its one-deletion
neighbours. Sets that differ in every exact segment and by two or more in every loose one differ in
exact + 2 * loose elements, so with exact + 2 * loose = H + 1 + spare every linked pair shares a
signature (pigeonhole). The `spare` ones allow a set to leave out the signatures of empty subsets,
which many sets share; only the rare sets with more than `spare` of them index those too. Exact,
loose and spare are chosen for each band by the cost of signatures and of expected chance meetings.

Few signatures are met by another. Which are is found first, from a few bytes of each; only those
travel as rows, with their set.

Sets are compared once for each distinct set, not for each copy. Members of a signature are first
compared with its smallest member only; a second round compares members that these links leave in
different components. What is left out are pairs whose ends are already connected, so components
are those of all links, and no group is ever expanded into all its pairs."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from brisa.llm import wordhash
from brisa.llm.common import bounded_batches, components, given_back, groups, small, staged

#: A chance meeting of two sets costs as much as so many signatures.
MEETING = 30.0
#: 64-bit words of the parity sketch of a set. Sets that differ in d elements have sketches that
#: differ in at most d bits, so a sketch only rules out pairs that are not linked.
SKETCH = 16
#: Members of a signature that one task compares with as many others.
BLOCK = 2048
CLASS = "doc_id long, n long, lo long, hi long, sketch array<long>"
SIGNED = "key long, lo long, often boolean"
#: First bits of a signature by which all signatures are dealt when the repeated ones are looked for.
BUCKET_BITS = 12
#: Most bits of a map of repeated signatures (64 MB). With more signatures than it holds well, more
#: rows pass it that no other row meets; they cost room and change nothing.
MOST_MARKS = 1 << 29


@dataclass(frozen=True)
class Band:
    """Sizes low .. high of the smaller set of a pair, the reach of its partners, and the plan."""
    low: int
    high: int
    reach: int
    exact: int
    loose: int
    spare: int


def bands(largest: int, num: int, den: int) -> list[tuple[int, int, int, int]]:
    """(low, high, reach, differences at most) of each band up to the largest set. Partners of
    sets of one band are at most as large as the end of the next."""
    found, low = [], 1
    while low <= largest:
        high = low * den // num
        found.append((low, high, high * den // num, high * (den - num) // num))
        low = high + 1
    return found


def planned(band: tuple[int, int, int, int], sets: int) -> Band:
    """The cheapest of the allocations tried for a band that `sets` sets index."""
    low, high, reach, differences = band
    size, best = (low + high) / 2, None
    loose = 0
    while True:
        for spare in [*range(0, 4), *(int(differences * f) + 4 for f in (0.0, 0.05, 0.1, 0.2, 0.4, 0.8))]:
            exact = differences + 1 + spare - 2 * loose
            if exact < 0:
                continue
            each = size / (exact + loose)
            empty, single = math.exp(-each), each * math.exp(-each)
            lost = exact * empty + 2 * loose * (empty + single)
            over = 1.0 - sum(math.exp(-lost) * lost ** k / math.factorial(k) for k in range(min(spare, 60) + 1)) if lost < 200 else 1.0
            share = min(1.0, max(over, 0.0)) * sets
            cost = sets * (exact + loose * (1 + each)) + MEETING * share * share / 2 * (exact * empty + loose * (empty + single))
            if best is None or cost < best[0]:
                best = (cost, exact, loose, spare)
        loose = max(1, loose * 2)
        if 2 * loose > differences + 1:
            break
    return Band(low, high, reach, *best[1:])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def described(s: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Two hashes of a set and its parity sketch."""
    a, b = wordhash.mixed(s + np.uint64(0x1234567)), wordhash.mixed(s ^ np.uint64(0xABCDEF987654321))
    bit = (a >> np.uint64(64 - 10)).astype(np.int64) % (64 * SKETCH)
    odd = np.bincount(bit, minlength=64 * SKETCH) & 1
    sketch = np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")
    return int(a.sum(dtype=np.uint64).view(np.int64)), int(b.sum(dtype=np.uint64).view(np.int64)), sketch


class Signatures:
    """Signatures of sets under a plan."""

    def __init__(self, plan: list[Band]):
        self.plan, self.low = plan, np.array([b.low for b in plan])
        self.cuts = [np.array([(k << 64) // (b.exact + b.loose) for k in range(1, b.exact + b.loose)], dtype=np.uint64) for b in plan]
        self.salt = [wordhash.mixed(np.arange(b.exact + b.loose, dtype=np.uint64) + np.uint64((k + 1) << 40)) for k, b in enumerate(plan)]

    def of(self, s: np.ndarray) -> np.ndarray:
        """Keys of a sorted set: of its own band, and of the band before if that reaches it."""
        if not len(s):
            return s
        k = int(np.searchsorted(self.low, len(s), "right")) - 1
        value = wordhash.mixed(s + np.uint64(0x7654321))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        found = [self._of_band(s, value, total, k)]
        if k and len(s) <= self.plan[k - 1].reach:
            found.append(self._of_band(s, value, total, k - 1))
        return np.concatenate(found)

    def _of_band(self, s: np.ndarray, value: np.ndarray, total: np.ndarray, k: int) -> np.ndarray:
        b, salt = self.plan[k], self.salt[k]
        cut = np.concatenate([[0], np.searchsorted(s, self.cuts[k]), [len(s)]])
        size = np.diff(cut)
        full = total[cut[1:]] - total[cut[:-1]]
        lost = int((size[b.loose:] == 0).sum()) + 2 * int((size[:b.loose] <= 1).sum())
        every = lost > b.spare
        keys = [wordhash.mixed(full ^ salt)[(size > 0) | every]]
        if b.loose:
            n = cut[b.loose]
            of = np.repeat(np.arange(b.loose), size[:b.loose])
            keys.append(wordhash.mixed((full[of] - value[:n]) ^ salt[of])[(size[of] > 1) | every])
        return np.concatenate(keys)


def classes(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, lo, hi, sketch) of the set of each row; staged, as everything reads it."""
    def describe(batches):
        for batch in batches:
            rows = [(len(s), *described(s)) for s in wordhash.shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.int64)), SKETCH).cast(pa.list_(pa.int64()))],
                ["doc_id", "n", "lo", "hi", "sketch"])
    bounded_batches(docs.sparkSession)
    return staged(docs.mapInArrow(given_back(describe), CLASS), "sets")


def _signed_sets(batches, words: int, plan: list[Band], most: int):
    """(keys, first hash of the set of each key) of the sets of all texts, about `most` keys at once."""
    signatures = Signatures(plan)
    for batch in batches:
        keys, lo, held = [], [], 0
        for s in wordhash.shingle_sets(batch.column(1), words):
            if len(s):
                keys.append(signatures.of(s))
                lo.append(np.full(len(keys[-1]), described_lo(s), np.int64))
                held += len(keys[-1])
            if held > most:
                yield np.concatenate(keys), np.concatenate(lo)
                keys, lo, held = [], [], 0
        if keys:
            yield np.concatenate(keys), np.concatenate(lo)


def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each key, and the 32 bits of it that follow."""
    return (keys >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), (keys >> np.uint64(32 - BUCKET_BITS)).astype(np.uint32)


def repeated_keys(docs: DataFrame, words: int, plan: list[Band]) -> DataFrame:
    """(bucket, twice, thrice): of each bucket the 32-bit remainders that two or more, and that three or
    more signatures have. Nearly all signatures are met by no other: this finds those that are for four
    bytes each in the shuffle, without the row that a key and its set would be. Staged."""
    def pack(batches):
        for found in _runs(_signed_sets(batches, words, plan, 1 << 17), 1 << 20):
            keys = np.sort(found)
            keys = keys[np.concatenate([np.ones(min(3, len(keys)), bool), keys[3:] != keys[:-3]])]      # a fourth tells nothing new
            bucket, rest = _split(keys)
            at = np.searchsorted(bucket, np.arange((1 << BUCKET_BITS) + 1))
            some = np.flatnonzero(np.diff(at))
            offsets = np.append(at[some], len(keys)).astype(np.int32) * 4
            packed = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(rest.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), packed], ["bucket", "packed"])

    def repeated(batches):
        for g in groups(batches, ("bucket",)):
            rest = np.sort(np.frombuffer(b"".join(g.column("packed").to_pylist()), "<u4"))
            often = [np.unique(rest[k:][rest[k:] == rest[:-k]]).tobytes() for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array([g.column("bucket")[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in often)],
                                             ["bucket", "twice", "thrice"])
    dealt = docs.mapInArrow(given_back(pack), "bucket int, packed binary").repartition("bucket").sortWithinPartitions("bucket")
    return staged(dealt.mapInArrow(given_back(repeated), "bucket int, twice binary, thrice binary"), "repeated")


def _runs(signed, most: int):
    """Keys of a stream of (keys, sets), `most` or more at once."""
    held, n = [], 0
    for keys, _ in signed:
        held.append(keys)
        n += len(keys)
        if n >= most:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


class Marks:
    """Which keys may be repeated: two bits per key in a map of bounded size, which rules out most others."""

    def __init__(self, repeated: DataFrame, column: str):
        n = repeated.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0] // 4
        most = min(MOST_MARKS, max(8 << BUCKET_BITS, 1 << (16 * n).bit_length()))
        bits = self.bits = most.bit_length() - 1 - BUCKET_BITS             # of the place in a bucket
        self.n = n

        def slices(batches):
            for batch in batches:
                for bucket, rest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    on, rest = np.zeros(1 << bits, np.uint8), np.frombuffer(rest, "<u4")
                    for place in Marks.places(rest, bits):
                        on[place] = 1
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], ["bucket", "bits"])
        self.map = np.zeros((1 << BUCKET_BITS, (1 << bits) // 8), np.uint8)
        told = repeated.filter(F.octet_length(column) > 0).select("bucket", column).mapInArrow(given_back(slices), "bucket int, bits binary")
        for r in told.toLocalIterator():                                  # MOST_MARKS bits at most
            self.map[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
        self.map = self.map.reshape(-1)

    @staticmethod
    def places(rest: np.ndarray, bits: int):
        yield (rest >> np.uint32(32 - bits)).astype(np.int64)
        yield ((rest * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Is each key marked?"""
        bucket, rest = _split(keys)
        found = np.arange(len(keys))
        for probe in (0, 1):
            place = (bucket[found] << self.bits) + [*Marks.places(rest[found], self.bits)][probe]
            found = found[(self.map[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0]
        out = np.zeros(len(keys), bool)
        out[found] = True
        return out


def signature_rows(docs: DataFrame, words: int, plan: list[Band]) -> DataFrame:
    """(key, lo, often): the signatures that several rows have, and a few more, with the first hash of
    the set of the row. Those that three or more rows have, and a few more, are marked `often`. Staged."""
    repeated = repeated_keys(docs, words, plan)
    twice, thrice = Marks(repeated, "twice"), Marks(repeated, "thrice")
    if not twice.n:
        return docs.sparkSession.createDataFrame([], SIGNED)
    marks = docs.sparkSession.sparkContext.broadcast((twice, thrice))

    def emit(batches):
        twice, thrice = marks.value
        for keys, lo in _signed_sets(batches, words, plan, 200_000):
            kept = np.flatnonzero(twice.of(keys))
            if len(kept):
                yield pa.RecordBatch.from_arrays([pa.array(_signed(keys[kept])), pa.array(lo[kept]), pa.array(thrice.of(keys[kept]))], ["key", "lo", "often"])
    return staged(docs.mapInArrow(given_back(emit), SIGNED), "signatures")


def described_lo(s: np.ndarray) -> int:
    return int(wordhash.mixed(s + np.uint64(0x1234567)).sum(dtype=np.uint64).view(np.int64))


def linked(docs: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Those of `pairs` (a, b) whose whole texts have den * common >= num * all shingles."""
    needed = staged(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = staged(docs.join(small(needed), "doc_id", "left_semi"), "texts")
    both = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y"))

    def check(batches):
        for batch in batches:
            sets = []
            for column in (2, 3):                       # a text that many pairs share is cut once
                once = batch.column(column).dictionary_encode()
                all_ = list(wordhash.shingle_sets(once.dictionary, words))
                sets.append([all_[i] for i in once.indices.to_pylist()])
            keep = []
            for p, q in zip(*sets):
                small_, large = (p, q) if len(p) <= len(q) else (q, p)
                at = np.searchsorted(large, small_)
                common = int((large[np.minimum(at, len(large) - 1)] == small_).sum()) if len(small_) else 0
                keep.append(common > 0 and den * common >= num * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return both.mapInArrow(given_back(check), "a long, b long").distinct()


def plausible(n_a: Column, n_b: Column, sketch_a: Column, sketch_b: Column, num: int, den: int) -> Column:
    """Can sets of these sizes and sketches be linked? Sizes must be near enough, and the sketches
    must not differ in more bits than linked sets differ in elements."""
    bits = F.aggregate(F.zip_with(sketch_a, sketch_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = F.least(n_a, n_b) * den >= F.greatest(n_a, n_b) * num
    return sizes & (bits * (den + num) <= (n_a + n_b) * (den - num))


def ngram_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, plan: list[Band] | None = None,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles and component_id, the smallest id that links
    reach. Sets are the distinct runs of `words` words of whole texts (the whole sequence if it is
    shorter); two documents link when den * intersection >= num * union.

    Texts that are null or without words have an empty set, link with nothing and are their own
    component. Rows with the same id are one document: what links with one links with all. Rows
    with a null id take no part; their component is null. An empty table gives no rows; other
    columns are not looked at."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = classes(docs, words)
    named = rows.filter("n > 0 and doc_id is not null")
    sets = staged(named.groupBy("lo", "hi").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    if plan is None:
        plan = cost_based(sets, num, den)
    if plan:
        sets = _joined(docs, rows, sets, words, num, den, plan)
    else:
        sets = sets.withColumn("component", F.col("doc"))
    out = rows.join(sets.select("lo", "hi", "component"), ["lo", "hi"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))).alias("component_id"))


def cost_based(sets: DataFrame, num: int, den: int) -> list[Band]:
    """Plans for all bands, from the number of distinct sets in each."""
    largest = sets.agg(F.max("n")).first()[0] or 0
    limits = bands(largest, num, den)
    if not limits:
        return []
    splits = [-math.inf, *(float(low) for low, *_ in limits[1:]), math.inf] if len(limits) > 1 else [-math.inf, 0.5, math.inf]
    counted = Bucketizer(splits=splits, inputCol="m", outputCol="k").transform(sets.select(F.col("n").cast("double").alias("m"))).groupBy("k").count()
    n = {int(r["k"]): r["count"] for r in counted.collect()}
    if len(limits) == 1:
        n = {0: sum(n.values())}
    return [planned(band, n.get(k, 0) + n.get(k + 1, 0)) for k, band in enumerate(limits)]


def _joined(docs: DataFrame, rows: DataFrame, sets: DataFrame, words: int, num: int, den: int, plan: list[Band]) -> DataFrame:
    """`sets` with the component of each."""
    # copies of a set bring nothing new: leave out documents that have only such
    own = rows.filter("n > 0").join(sets.select("lo", "hi", "doc"), ["lo", "hi"]).select("doc_id", "doc")
    by_id = own.groupBy("doc_id").agg(F.min(F.col("doc") != F.col("doc_id")).alias("copy"), F.min("doc").alias("least"), F.max("doc").alias("most"))
    by_id = staged(by_id.filter("copy or least <> most"), "copies")
    copies = by_id.filter("copy").select("doc_id")
    texts = docs.filter("doc_id is not null").join(small(copies), "doc_id", "left_anti")
    # an id with several texts links what they are copies of
    several = by_id.filter("least <> most").select("doc_id", F.col("least").alias("a"))
    same_id = own.join(several, "doc_id").select("a", F.col("doc").alias("b")).filter("a <> b").distinct()
    signed = signature_rows(texts, words, plan)

    met = signed.groupBy("key").agg(F.min("lo").alias("first"), F.bit_xor("lo").alias("both"), F.count("*").alias("n"))
    met = met.filter("n > 2 or n = 2 and both <> 0").select(F.when(F.col("n") > 2, F.col("key")).alias("key"), "first",
                                                           F.when(F.col("n") == 2, F.col("first").bitwiseXOR(F.col("both"))).alias("other"))
    met = staged(met, "met")
    two = met.filter("other is not null").select("first", "other")
    many = staged(met.filter("key is not null").select("key", "first"), "many")
    members = staged(signed.filter("often").join(small(many), "key").select("key", "lo", "first"), "members")
    candidates = two.unionAll(members.select("first", F.col("lo").alias("other"))).filter("first <> other").distinct()
    first = linked(docs, _plausible_pairs(candidates, sets, num, den), words, num, den)
    first = staged(first.unionAll(same_id), "links")

    found = staged(components(first), "components")
    placed = sets.join(found, sets["doc"] == found["node"], "left").select("lo", "doc", "n", "sketch", F.coalesce("component", "doc").alias("component"))
    placed = staged(placed, "placed")
    here = members.filter("lo <> first").select("key", "lo").join(placed, "lo").drop("lo")
    mixed = here.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("members")).filter("least <> most")
    here = staged(here.join(mixed.drop("most"), "key"), "mixed")
    apart = staged(apart_pairs(here, num, den).distinct(), "pairs")
    second = staged(linked(docs, apart, words, num, den), "links")
    links = first.unionAll(second)
    found = components(links) if not second.isEmpty() else found
    return sets.join(found, sets["doc"] == found["node"], "left").select("lo", "hi", F.coalesce("component", "doc").alias("component"))


def apart_pairs(here: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b), a < b, of members of one signature that are in different components and that
    sizes and sketches allow. `here` has key, doc, n, sketch, component, and of each signature its
    least component and number of members; a signature with many is split into pairs of blocks."""
    blocks = F.ceil(F.col("members") / BLOCK)
    rows = here.withColumn("part", F.pmod(F.xxhash64("doc"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "doc", "n", "component", "least", "sketch")

    def compare(batches):
        for g in groups(batches, ("key", "i", "j")):
            doc, n, component = (np.asarray(g.column(c).combine_chunks()) for c in ("doc", "n", "component"))
            sketch = np.asarray(g.column("sketch").combine_chunks().flatten()).view(np.uint64).reshape(len(doc), SKETCH)
            # of two members in different components one at least is not in the least
            rest = np.flatnonzero(component != g.column("least")[0].as_py())
            step = max(1, (1 << 20) // len(doc))
            for at in range(0, len(rest), step):
                x = rest[at:at + step]
                small_, large = np.minimum(n[x][:, None], n[None, :]), np.maximum(n[x][:, None], n[None, :])
                fits = (component[x][:, None] != component[None, :]) & (small_ * den >= large * num)
                i, j = np.nonzero(fits)
                i = x[i]
                for k in range(0, len(i), 1 << 17):
                    p, q = i[k:k + (1 << 17)], j[k:k + (1 << 17)]
                    bits = np.bitwise_count(sketch[p] ^ sketch[q]).sum(axis=1, dtype=np.int64)
                    ok = bits * (den + num) <= (n[p] + n[q]) * (den - num)
                    pairs = np.unique(np.sort(np.stack([doc[p[ok]], doc[q[ok]]], axis=1), axis=1), axis=0)
                    if len(pairs):
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(given_back(compare), "a long, b long").filter("a <> b")


def _plausible_pairs(candidates: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Documents (a, b), a < b, of pairs of sets (first, other) that may be linked; staged."""
    side = lambda k: sets.select(F.col("lo").alias(k), F.col("doc").alias(f"{k}_doc"), F.col("n").alias(f"{k}_n"), F.col("sketch").alias(f"{k}_sketch"))
    pairs = candidates.join(side("first"), "first").join(side("other"), "other").filter(
        plausible(F.col("first_n"), F.col("other_n"), F.col("first_sketch"), F.col("other_sketch"), num, den))
    return staged(pairs.select(F.least("first_doc", "other_doc").alias("a"), F.greatest("first_doc", "other_doc").alias("b")).filter("a <> b").distinct(), "pairs")


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each component: the one with the smallest id. All columns stay;
    rows with a null id stay; of rows with the same id all stay or none."""
    found = ngram_components(docs, words, num, den, id_col=id_col, text_col=text_col)
    gone = staged(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "near-copies")
    return docs.join(small(gone), F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
