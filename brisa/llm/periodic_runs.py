"""Stretches of words that repeat with a period, found by minimizers at several scales.

A run is a stretch of words with smallest period q (words q apart are equal) and a length of at least
max(least, 4 q) that no neighbouring word extends with the same period. Periods up to SHORT are found by
comparing the words with themselves at each lag. Longer ones belong to scales K = 16, 32, ..: a run of
period q, K/2 < q <= K, is at least 4 q long, so windows of K/2 sequences of K words (short of 2 q words
each) begin at some place and q words later inside it, with the same content, and their smallest
hashes stand q words apart. K words are a period or more, so the same sequence does not come again
in between: the two are neighbours among the selected places of equal hash, at a distance of q.
Every such pair is extended to both sides with its lag, on the words themselves; a stretch found
with several lags has the smallest as its period, the others being its multiples.

Words are numbered, texts of a block follow each other with a number of its own between any two,
so that no run goes from one text into the next, and all steps look at a whole block at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from brisa.llm.wordhash import mixed

#: Periods found by direct comparison; the first scale is twice as large.
SHORT = 8
#: Words of a block (one text at least).
BLOCK = 200_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where maximal stretches of True begin and end."""
    edge = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def sliding(x: np.ndarray, width: int, choose) -> np.ndarray:
    """`choose` over all windows of `width`, a power of two."""
    step = 1
    while step < width:
        x = choose(x[:-step], x[step:])
        step *= 2
    return x


def extended(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The maximal stretch of places j around `at` where words j and j + lag are equal."""
    end, size = at, 64
    while end < len(words) - lag:
        differ = words[end:end + size][:len(words) - lag - end] != words[end + lag:end + lag + size]
        if differ.any():
            end += int(differ.argmax())
            break
        end, size = end + len(differ), 2 * size
    first, size = at, 64
    while first > 0:
        low = max(0, first - size)
        differ = (words[low:first] != words[low + lag:first + lag])[::-1]
        if differ.any():
            first -= int(differ.argmax())
            break
        first, size = low, 2 * size
    return first, end


def scale_pairs(hashes: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of neighbouring selected places of equal hash, K/2 < lag <= K; sorted by lag."""
    width = scale // 2
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = sliding(hashes, width, np.minimum)
    ends = np.zeros(width - 1, np.uint64)
    place = np.flatnonzero(hashes == sliding(np.concatenate([ends, least, ends]), width, np.maximum))
    place = place[np.argsort(hashes[place], kind="stable")]
    lag = np.diff(place)
    near = (hashes[place[1:]] == hashes[place[:-1]]) & (lag > width) & (lag <= scale)
    place, lag = place[:-1][near], lag[near]
    order = np.lexsort((place, lag))
    return place[order], lag[order]


def runs_of(words: np.ndarray, longest: int, least: int = 6) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period; `words` are numbers, and no
    text in them has more than `longest` words."""
    found = []
    for lag in range(1, min(SHORT, longest // 4) + 1):
        first, end = stretches(words[:-lag] == words[lag:])
        length = end - first + lag
        long = length >= max(least, 4 * lag)
        found.append(np.stack([first[long], length[long], np.full(int(long.sum()), lag)], axis=1))
    hashes, scale = mixed(words.astype(np.int64).view(np.uint64)), 1
    while 4 * (scale // 2 + 1) <= longest and len(hashes) > scale // 2:
        if scale > SHORT:
            rows, last, end = [], 0, 0
            for place, lag in zip(*(x.tolist() for x in scale_pairs(hashes, scale))):
                if lag == last and place < end:
                    continue                            # inside the stretch just found
                first, end = extended(words, place, lag)
                last = lag
                if end - first + lag >= max(least, 4 * lag):
                    rows.append((first, end - first + lag, lag))
            found.append(np.array(rows, np.int64).reshape(-1, 3))
        hashes = mixed(hashes[:-scale] * np.uint64(0xD6E8FEB86659FD93) + hashes[scale:])
        scale *= 2
    runs = np.concatenate([*found, np.zeros((0, 3), np.int64)]).astype(np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])
    runs = runs[first]                                  # the smallest lag of each stretch
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def block_rows(texts: list[list[bytes]], least: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """For texts given as words: number of runs of each, all runs, and what is kept of each text."""
    numbers: dict[bytes, int] = {}
    size = np.array([len(t) for t in texts], np.int64)
    at = np.concatenate([[0], np.cumsum(size + 1)])     # one place more after each text
    words = np.empty(int(at[-1]), np.int64)
    for first, text in zip(at.tolist(), texts):
        words[first:first + len(text)] = [numbers.setdefault(w, len(numbers)) for w in text]
    words[at[1:] - 1] = -1 - np.arange(len(texts))
    runs = runs_of(words, int(size.max(initial=0)), least)
    text = np.searchsorted(at, runs[:, 0], "right") - 1
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change) == 0
    runs[:, 0] -= at[text]
    count = np.bincount(text, minlength=len(texts))
    left = [b" ".join(t) if not n else b" ".join([w for w, k in zip(t, kept[first:first + len(t)].tolist()) if k])
            for t, n, first in zip(texts, count.tolist(), at.tolist())]
    return count, runs, left


def periodic_runs(docs: DataFrame, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, `runs` (start and length in words from 0, smallest
    period; by start, then period) and `collapsed`, the text without the words that repeat: a word goes
    if any run contains it after the first period of that run. Words are runs of characters other than
    space and 0x09-0x0D, compared as they stand, and are joined by one space.

    Null and empty texts have no words, no runs and an empty `collapsed`. Rows are looked at one by one, so
    ids may be null or repeated; an empty table gives no rows. Other columns are not looked at,
    whatever their names. Texts are read whole: a period may be as long as a quarter of its text."""
    def work(batches):
        for batch in batches:
            ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            counts, runs, kept, sizes, held, size = [], [], [], [], [], 0
            for i, text in enumerate(texts):
                words = text.as_buffer().to_pybytes().split() if text.as_buffer() else []
                held.append(words)
                sizes.append(len(words))
                size += len(words) + 1
                if size >= BLOCK or i + 1 == len(texts):
                    for out, part in zip((counts, runs, kept), block_rows(held, least)):
                        out.append(part)
                    held, size = [], 0
            if not sizes:
                continue
            each = np.concatenate(runs)
            rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(each[:, k])) for k in range(3)], ["start", "length", "period"])
            ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), rows),
                                              pa.array([k for part in kept for k in part], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    plain = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return plain.mapInArrow(work, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")


def most_repeated(runs: Column) -> Column:
    """The run with the greatest length / period, exactly; of equal ones the first. Null without runs."""
    none = F.lit(None).cast(RUNS[len("array<"):-1])
    more = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | more(r, best), r).otherwise(best))


def written(runs: Column) -> Column:
    """All runs as text, a line each."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in every tenth document by a hash h of its id, the words from place a = g % n on
    become repetitions of the p words that follow it, where g = h / 10 and p = 1 + (n - a) / (3 + g % 8);
    all others, also those with a null id, keep their texts."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+", -1), "")
    cut = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    cut = cut.withColumn("a", F.expr("cast(g % nullif(n, 0) as int)"))
    cut = cut.withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    again = F.expr("concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a))")
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
