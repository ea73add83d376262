"""Removal of lines that repeat an earlier line, exactly or nearly, by a set-similarity join.

A line is the set of its words (letters A-Z as a-z); with `runs`, text in scripts written without
spaces is cut into runs of three characters, each a word. Two lines match if the Jaccard similarity of
their sets is num/den or more; of two matching lines the later one by (document id, line number)
goes. The join is exact:

* words are ordered from rare to common by how often the corpus has them;
* two matching sets share a word among the first n - ceil(t n) + 1 of each (prefix filter);
* sizes differ by the factor t at most (length filter), and what can still be common after the
  places of the shared word must reach the overlap that t asks for (positional filter);
* parities of the words in 128 slots differ in no more places than the sets differ in words;
* what passes is verified on the whole lines.

Equal sets are one entry with the place of the first. Entries travel packed, one binary row for
each task and part of the word space; a word that many lines hold is split into pairs of blocks, so
that no part grows with a common word. For every line the earliest plausible lines are verified
first; where none of these matches and there are others, a further round takes more of them from
the entries of the words in question, which the round before has kept."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brisa.llm import wordhash
from brisa.llm.common import bounded_batches, given_back, release, small, staged

#: Slots of the word counts that give the order of rarity (a broadcast of as many bytes).
SLOTS = 1 << 20
#: Entries of one part; a word that occurs more often than HOT times is split into blocks of so many.
PART, HOT = 500_000, 1 << 16
#: Plausible earlier lines of a part that are verified in the first round; every round takes MORE times
#: as many. Pairs of entries looked at in one go.
FIRST, MORE, CHUNK = 3, 32, 250_000
#: Sets still open after a round that are broadcast; with more they are joined.
OPEN = 1_000_000
#: Places of lines a task remembers in order not to send a set twice.
SEEN = 100_000
#: Sets of more lines than these are looked up apart from the others.
COMMON = 10_000
ENTRY = np.dtype([("word", "<u4"), ("n", "<u4"), ("place", "<u4"), ("line", "<i4"), ("set", "<i8"), ("low", "<u8"), ("high", "<u8"), ("doc", "<i8")])
#: The counts of all slots travel in this many slices, summed by at most FAN tasks each at first.
SLICES, FAN = 64, 256


LOW, HALF = np.uint64(0xFFFFFFFF), np.uint64(32)


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which numbers are in the sorted array `known`."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def slot_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


class Lines:
    """The lines of a block that have words: text and number of each, its set as hashed words from
    rare to common (`words`, those of line k from `at[k]` to `at[k + 1]`), size, hash and sketch."""

    def __init__(self, data: np.ndarray, at: np.ndarray, rarity: np.ndarray | None = None, runs: bool = False):
        h, start = wordhash.placed_words(data, at, runs)
        breaks = np.flatnonzero(data == 10)
        text = np.searchsorted(at, start, "right") - 1
        row = np.searchsorted(breaks, start) + text
        rank = rarity[slot_of(h)].astype(np.int64) if rarity is not None else np.zeros(len(h), np.int64)
        order = line_order(row, rank, h)
        h, row, text = h[order], row[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        self.words, row, text = h[new], row[new], text[new]
        head = np.ones(len(row), bool)
        head[1:] = row[1:] != row[:-1]
        head = np.flatnonzero(head)
        self.at = np.append(head, len(row))
        self.n = np.diff(self.at)
        self.text = text[head]
        self.number = row[head] - self.text - np.searchsorted(breaks, at[:-1])[self.text] if len(head) else head
        if len(head):
            spread = wordhash.mixed(self.words + np.uint64(0x51ED270B))
            self.set = wordhash.mixed(np.add.reduceat(spread, head) + self.n.astype(np.uint64)).view(np.int64)
            one, upper = np.uint64(1) << ((spread >> np.uint64(57)) & np.uint64(63)), (spread >> np.uint64(63)).astype(bool)
            self.low = np.bitwise_xor.reduceat(np.where(upper, np.uint64(0), one), head)
            self.high = np.bitwise_xor.reduceat(np.where(upper, one, np.uint64(0)), head)
        else:
            self.set, self.low, self.high = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def line_order(row: np.ndarray, rank: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Order of the words of a block by line, rarity and hash. One sort of packed numbers does it
    unless two words of a line agree in the packed part of their hashes; then three sorts do."""
    if len(row) and row[-1] < 1 << 22:
        order = np.argsort((row.astype(np.uint64) << np.uint64(42)) | (rank.astype(np.uint64) << np.uint64(34)) | (h >> np.uint64(30)))
        r, k, x = row[order], rank[order], h[order]
        if not np.any((r[1:] == r[:-1]) & (k[1:] == k[:-1]) & (x[1:] < x[:-1])):
            return order
    return np.lexsort((h, rank, row))


def lines_and_counts(docs: DataFrame, least_words: int, runs: bool) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, body, line, set) of every line with `least_words` different words, and how often
    the words of each slot occur in all texts; from one pass over the texts, which is staged. The
    driver gets SLOTS numbers."""
    def work(batches):
        total, tables = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            ids, bodies, first = np.asarray(batch.column(0)), np.asarray(batch.column(2)), 0
            for data, at in wordhash.blocks(batch.column(1)):
                x = Lines(data, at, runs=runs)
                total += np.bincount(slot_of(x.words), minlength=SLOTS)
                keep = x.n >= least_words
                of = x.text[keep] + first
                n, tables = int(keep.sum()), tables + len(of)
                yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(bodies[of]), pa.array(x.number[keep].astype(np.int32)), pa.array(x.set[keep]), pa.nulls(n, pa.binary())],
                                                 ["doc_id", "body", "line", "set", "counts"])
                first += len(at) - 1
        if total.any():                     # line: the slice; set: spreads the slices of a task over FAN
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(range(SLICES), pa.int32()), pa.array([int(total.sum()) % FAN] * SLICES, pa.int64()),
                                              pa.array([c.tobytes() for c in np.split(total, SLICES)], pa.binary())], ["doc_id", "body", "line", "set", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        whole = np.zeros(SLOTS // SLICES, np.int64)
        for c in table.column("counts"):
            whole += np.frombuffer(c.as_py(), np.int64)
        return pa.table([table.column("line").slice(0, 1), pa.array([whole.tobytes()], pa.binary())], names=["line", "counts"])

    schema = "doc_id long, body long, line int, set long, counts binary"
    both = staged(docs.select("doc_id", "text", "body").mapInArrow(given_back(work), schema), "lines")
    counts = both.filter("counts is not null").select("line", "set", "counts")
    counts = counts.groupBy("line", "set").applyInArrow(summed, "line int, counts binary").groupBy("line").applyInArrow(summed, "line int, counts binary").toArrow()
    out = np.zeros(SLOTS, np.int64)
    for k, c in zip(counts.column("line").to_pylist(), counts.column("counts")):
        out[k * (SLOTS // SLICES):(k + 1) * (SLOTS // SLICES)] = np.frombuffer(c.as_py(), np.int64)
    return both.filter("counts is null").drop("counts"), out


def entry_rows(docs: DataFrame, counts: np.ndarray, parts: int, least_words: int, num: int, den: int, runs: bool) -> DataFrame:
    """(part, entries): prefix words of every line, packed by part of the word space. A task sends
    a set again only if it meets it at an earlier place (or has forgotten it), and none that only equal
    sets can match."""
    rarity = np.minimum(255, np.round(np.log2(counts + 1.0) * 6)).astype(np.int64)
    blocks = np.ceil(counts / HOT).astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((rarity.astype(np.uint8), np.maximum(blocks, 1).astype(np.int32)))

    def emit(batches):
        rare, cut = shared.value
        seen: dict[int, tuple[int, int]] = {}
        held, size = [], 0
        for batch in batches:
            ids, first = np.asarray(batch.column(0)), 0
            for data, at in wordhash.blocks(batch.column(1)):
                x = Lines(data, at, rare, runs)
                keep, joined = [], (x.n >= least_words) & (x.n * den >= num * (x.n + 1))
                if len(seen) > SEEN:
                    seen.clear()
                for k, (s, d, line) in enumerate(zip(x.set.tolist(), ids[x.text + first].tolist(), x.number.tolist())):
                    if joined[k] and (s not in seen or (d, line) < seen[s]):
                        seen[s] = (d, line)
                        keep.append(k)
                held.append(packed(x, np.array(keep, np.int64), ids[x.text + first] if len(x.text) else ids[:0], cut))
                size += len(held[-1][0])
                first += len(at) - 1
                if size > 200_000:
                    yield from flushed(held)
                    held, size = [], 0
        if held:
            yield from flushed(held)

    def packed(x, keep, doc, cut):
        n = x.n[keep]
        length = n - (n * num + den - 1) // den + 1
        of = np.repeat(keep, length)
        place = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
        word = x.words[x.at[of] + place]
        b = cut[slot_of(word)].astype(np.int64)
        mine = np.abs(x.set[of]) % b
        # a word cut in b blocks: to the pairs (mine, 0) .. (mine, b - 1)
        again = np.repeat(np.arange(len(of)), b)
        other = np.arange(len(again)) - np.repeat(np.cumsum(b) - b, b)
        low, high = np.minimum(mine[again], other), np.maximum(mine[again], other)
        key = wordhash.mixed(word[again] + ((low << 20) + high).astype(np.uint64))
        out = np.empty(len(again), ENTRY)
        at = of[again]
        out["word"], out["n"], out["place"], out["line"] = key >> HALF, x.n[at], place[again], x.number[at]
        out["set"], out["low"], out["high"], out["doc"] = x.set[at], x.low[at], x.high[at], doc[at]
        return ((key & LOW) % np.uint64(parts)).astype(np.int64), out

    def flushed(held):
        part, entry = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        order = np.argsort(part, kind="stable")
        part, entry = part[order], entry[order]
        cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
        if len(part):
            heads = np.concatenate([[0], cuts])
            yield pa.RecordBatch.from_arrays([pa.array(part[heads].astype(np.int32)), pa.array([e.tobytes() for e in np.split(entry, cuts)], pa.binary())], ["part", "entries"])
    return docs.select("doc_id", "text").mapInArrow(given_back(emit), "part int, entries binary")


def plausible_pairs(entries: np.ndarray, num: int, den: int):
    """Runs of (later, earlier) entries of one part that pass all filters."""
    n_of_word = np.unique(entries["word"], return_inverse=True, return_counts=True)
    entries = entries[n_of_word[2][n_of_word[1]] > 1]           # most words stand alone
    e = entries[np.lexsort((entries["line"], entries["doc"], entries["set"], entries["word"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["set"][1:] != e["set"][:-1]) | (e["word"][1:] != e["word"][:-1])
    e = e[new]
    e = e[np.lexsort((e["n"], e["word"]))]
    word, n = e["word"].astype(np.uint64) << np.uint64(32), e["n"].astype(np.int64)
    last = np.searchsorted(word | e["n"].astype(np.uint64), word | (n * den // num).astype(np.uint64), "right")
    size = last - np.arange(len(e)) - 1
    total = np.concatenate([[0], np.cumsum(size)])
    first = 0
    while first < len(e):
        end = max(first + 1, int(np.searchsorted(total, total[first] + CHUNK, "right")) - 1)
        # one entry may have very many partners: they too are looked at in runs
        for begin in range(int(total[first]), int(total[end]), CHUNK):
            pair = np.arange(begin, min(begin + CHUNK, int(total[end])))
            a = np.searchsorted(total, pair, "right") - 1
            b = a + 1 + pair - total[a]
            both = n[a] + n[b]
            need = (num * both + num + den - 1) // (num + den)
            rest = np.minimum(n[a] - e["place"][a], n[b] - e["place"][b])
            fits = rest >= need
            a, b, most = a[fits], b[fits], (both - 2 * need)[fits]
            fits = np.bitwise_count(e["low"][a] ^ e["low"][b]) + np.bitwise_count(e["high"][a] ^ e["high"][b]) <= most
            a, b = a[fits], b[fits]
            after = (e["doc"][a] > e["doc"][b]) | ((e["doc"][a] == e["doc"][b]) & (e["line"][a] > e["line"][b]))
            before = (e["doc"][a] < e["doc"][b]) | ((e["doc"][a] == e["doc"][b]) & (e["line"][a] < e["line"][b]))
            x, y = np.concatenate([a[after], b[before]]), np.concatenate([b[after], a[before]])
            yield e[["set", "doc", "line"]][x], e[["set", "doc", "line"]][y]
        first = end


def candidates(rows: DataFrame, num: int, den: int, first: int, only=None) -> DataFrame:
    """(later, earlier, part, entries): plausible pairs of sets, the `first` earliest ones of each part. A set
    that has others there is given again without an earlier one, and all entries that share a word with such sets
    in a row of their own. `only` is a broadcast of the sorted sets to look for, all if it is not given."""
    schema = "later long, earlier long, part int, entries binary"

    def work(table: pa.Table) -> pa.Table:
        entries = np.frombuffer(b"".join(b for b in table.column("entries").to_pylist()), ENTRY)
        later, earlier, doc, line = (np.zeros(0, np.int64) for _ in range(4))
        cut, held, size = np.zeros(0, np.int64), [], 0

        def settled():
            nonlocal later, earlier, doc, line, cut
            later, earlier = np.concatenate([later, *(x["set"] for x, _ in held)]), np.concatenate([earlier, *(y["set"] for _, y in held)])
            doc, line = np.concatenate([doc, *(y["doc"] for _, y in held)]), np.concatenate([line, *(y["line"].astype(np.int64) for _, y in held)])
            order = np.lexsort((earlier, line, doc, later))
            later, earlier, doc, line = later[order], earlier[order], doc[order], line[order]
            new = np.ones(len(later), bool)
            new[1:] = (later[1:] != later[:-1]) | (earlier[1:] != earlier[:-1])
            later, earlier, doc, line = later[new], earlier[new], doc[new], line[new]
            head = np.ones(len(later), bool)
            head[1:] = later[1:] != later[:-1]
            rank = np.arange(len(later)) - np.maximum.accumulate(np.where(head, np.arange(len(later)), 0))
            cut = np.union1d(cut, later[rank >= first])
            keep = rank < first
            later, earlier, doc, line = later[keep], earlier[keep], doc[keep], line[keep]
            held.clear()

        for x, y in plausible_pairs(entries, num, den):
            if only is not None:
                wanted = among(x["set"], only.value)
                x, y = x[wanted], y[wanted]
            if len(x):
                held.append((x, y))
                size += len(x)
            if size > CHUNK:
                settled()
                size = 0
        settled()
        words = np.unique(entries["word"][among(entries["set"], cut)])
        kept, n = entries[among(entries["word"], words)].tobytes(), len(later) + len(cut)
        del entries
        release()
        nothing = pa.nulls(1 if len(kept) else 0, pa.int64())
        return pa.table([pa.concat_arrays([pa.array(later), pa.array(cut), nothing]), pa.concat_arrays([pa.array(earlier), pa.nulls(len(cut), pa.int64()), nothing]),
                         pa.concat_arrays([pa.nulls(n, pa.int32()), table.column("part").combine_chunks().slice(0, len(nothing))]),
                         pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([kept] * len(nothing), pa.binary())])], names=["later", "earlier", "part", "entries"])
    return rows.groupBy("part").applyInArrow(work, schema)


def matching(docs: DataFrame, firsts: DataFrame, pairs: DataFrame, num: int, den: int, runs: bool) -> DataFrame:
    """The sets `later` of those pairs whose whole lines match. Lines are read at the first place
    of their set."""
    needed = pairs.select(F.explode(F.array("later", "earlier")).alias("set")).distinct()
    places = staged(needed.join(firsts, "set").groupBy("doc_id", "body").agg(F.collect_list(F.struct("line", "set")).alias("places")), "places")
    places = small(places.withColumnRenamed("body", "of"), values="places")
    there = docs.select("doc_id", "text").join(places, "doc_id").filter(F.xxhash64("text") == F.col("of")).select(F.split("text", "\n", -1).alias("all"), F.explode("places").alias("place"))
    lines = staged(there.select(F.col("place.set").alias("set"), F.get("all", F.col("place.line")).alias("line")).dropDuplicates(["set"]), "line-texts")
    both = (pairs.select("later", "earlier").join(lines.select(F.col("set").alias("later"), F.col("line").alias("x")), "later")
            .join(lines.select(F.col("set").alias("earlier"), F.col("line").alias("y")), "earlier").select("later", "x", "y"))

    def check(batches):
        for batch in batches:
            keep = []
            for p, q in zip(wordhash.shingle_sets(batch.column(1), 1, runs), wordhash.shingle_sets(batch.column(2), 1, runs)):
                both = int(among(p, q).sum())
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield batch.select(["later"]).filter(pa.array(keep, pa.bool_()))
    return both.mapInArrow(given_back(check), "later long").distinct()


def repeated_lines(docs: DataFrame, num: int, den: int, least_words: int, runs: bool = False) -> DataFrame:
    """(doc_id, body, gone): numbers, from 0, of the lines to remove from each text; `docs` has
    doc_id, text and body, the hash of the text."""
    bounded_batches(docs.sparkSession)
    docs = docs.filter("doc_id is not null and text is not null")
    lines, counts = lines_and_counts(docs, least_words, runs)
    firsts = staged(lines.groupBy("set").agg(F.min(F.struct("doc_id", "line", "body")).alias("f"), F.count("*").alias("copies"))
                    .select("set", "f.doc_id", "f.line", "f.body", "copies"), "first-lines")
    wanted = math.ceil(float(counts.sum()) * (den - num) / den / PART)
    spark = docs.sparkSession
    parts = max(1, wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))
    near, checked, first, only, open_ = None, None, FIRST, None, None
    rows = entry_rows(docs, counts, parts, least_words, num, den, runs)
    while True:
        found = staged(candidates(rows, num, den, first, only), "line-candidates")
        pairs = found.filter("earlier is not null").select("later", "earlier").distinct()
        if checked is not None:
            pairs = pairs.join(open_, "later", "left_semi").join(checked, ["later", "earlier"], "left_anti")
        pairs = staged(pairs, "line-pairs")
        matched = staged(matching(docs, firsts, pairs, num, den, runs), "near-lines")
        near = matched if near is None else near.unionAll(matched)
        checked = pairs if checked is None else checked.unionAll(pairs)
        more = found.filter("later is not null and earlier is null").select("later").distinct()
        open_ = staged((more if open_ is None else more.join(open_, "later", "left_semi")).join(near, "later", "left_anti"), "open-lines")
        n_open = open_.count()
        if n_open == 0:
            break
        only = spark.sparkContext.broadcast(np.sort(np.asarray(open_.toArrow().column("later")))) if n_open <= OPEN else None
        rows = found.filter("entries is not null").select("part", "entries")
        first *= MORE
    judged = firsts.join(near.select(F.col("later").alias("set"), F.lit(True).alias("near")), "set", "left").filter("near or copies > 1")
    judged = staged(judged.select("set", F.col("doc_id").alias("d"), F.col("line").alias("l"), "near", "copies"), "judged-sets")
    # a set of very many lines is no key of a shuffle
    common = small(staged(judged.filter(F.col("copies") > COMMON), "common-sets"))
    others = lines.join(common.select("set"), "set", "left_anti").join(judged.filter(F.col("copies") <= COMMON), "set")
    gone = others.unionByName(lines.join(common, "set")).filter("near or doc_id > d or (doc_id = d and line > l)")
    return staged(gone.groupBy("doc_id", "body").agg(F.collect_set("line").alias("gone")), "gone-lines")


def without_repeated_lines(docs: DataFrame, num: int = 80, den: int = 100, least_words: int = 5, id_col: str = "doc_id", text_col: str = "text",
                           marks: bool = True, drop_emptied: bool = False, runs: bool = False) -> DataFrame:
    """`docs` with the lines removed that match an earlier line (by id and line number).

    All columns stay; with `marks`, `n_lines` and `n_removed` follow (columns of these names are
    replaced). Lines with fewer than `least_words` different words are too short to judge: they stay
    and remove nothing; with 1 all lines that have a word are judged. A line goes if any earlier line matches it, whether or not that one goes
    too. Lines at the same place in rows of the same id are none earlier than the other, so repeated
    rows lose the same lines. Null texts stay null, empty ones empty; rows with a null id are left as
    they are. What remains of a text is its other lines, joined as before; with `drop_emptied` rows
    go of which only white space remains. An empty table gives no rows."""
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    plain = docs.select(key.cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("body"))
    gone = repeated_lines(plain, num, den, least_words, runs).select(F.col("doc_id").alias("__id"), F.col("body").alias("__body"), F.col("gone").alias("__gone"))
    kept = [F.col(f"`{c}`") for c in docs.columns if not (marks and c in ("n_lines", "n_removed"))]
    # the small side is counted; a text is looked up by its id and its hash
    joined = docs.select(*kept).join(small(gone, values="__gone"), (key == F.col("__id")) & (F.xxhash64(text) == F.col("__body")), "left")
    joined = joined.withColumn("__parts", F.when(F.col("__gone").isNotNull(), F.split(text, "\n", -1)))
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    left = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), F.col("__gone"))
    cleaned = F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(F.transform(F.sort_array(left), lambda i: F.get("__parts", i)), "\n"))
    out = joined.select(*[cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if not (marks and c in ("n_lines", "n_removed"))],
                        *([F.coalesce(n_lines, F.lit(0)).alias("__lines")] if marks else []),
                        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).alias("__removed"))
    if drop_emptied:
        out = out.filter(~((F.col("__removed") > 0) & (F.trim(F.translate(F.col(f"`{text_col}`"), "\t\r\n", "   ")) == "")))
    return out.withColumnsRenamed({"__lines": "n_lines", "__removed": "n_removed"}) if marks else out.drop("__removed")
