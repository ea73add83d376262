"""Token counts of byte-level BPE without encoding: whole-token shortcut.

A pre-token that is a vocabulary string which the merges rebuild as one token counts as one.
Which strings do is proved once, before any text is read; only the rest is merged."""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from brisa.llm import pretokens

#: Pre-tokens whose counts a Python worker remembers before it starts afresh.
REMEMBERED = 400_000


class Model:
    """Merge ranks, added strings and the proved whole tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if (model["type"], pre["type"], spec["normalizer"]) != ("BPE", "ByteLevel", None) \
                or pre["add_prefix_space"] or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        letters = pretokens.byte_of_character()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        added = {t["content"] for t in spec["added_tokens"]}
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.whole = self.prove(raw(s) for s in model["vocab"] if s not in added)

    def prove(self, strings) -> dict[str, int]:
        """The vocabulary strings that the merges rebuild as one token from their bytes."""
        proved = {}
        for s in strings:
            if self.merged(s) == 1:
                try:
                    proved[s.decode("utf-8")] = 1
                except UnicodeDecodeError:      # part of a character: never a pre-token
                    pass
        return proved

    def merged(self, raw: bytes) -> int:
        """Number of tokens after all merges: always the best-ranked pair, the leftmost first."""
        part = [raw[i:i + 1] for i in range(len(raw))]
        rank = self.rank
        if len(part) > 48:
            return self._merged_long(part)
        while len(part) > 1:
            found = [rank.get(p, 1 << 30) for p in zip(part, part[1:])]
            best = min(found)
            if best == 1 << 30:
                break
            i = found.index(best)
            part[i:i + 2] = [part[i] + part[i + 1]]
        return len(part)

    def _merged_long(self, part: list[bytes]) -> int:
        """The same with a heap of pairs, for pre-tokens of any length."""
        n, rank = len(part), self.rank
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i] if part[i] == x else n
            if j >= n or part[j] != y:
                continue                        # one of the two has been merged meanwhile
            part[i], part[j], after[i] = x + y, b"", after[j]
            if after[j] < n:
                ahead[after[j]] = i
            left -= 1
            for k in (ahead[i], i):
                if 0 <= k and after[k] < n and (r := rank.get((part[k], part[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, part[k], part[after[k]]))
        return left


class Counts(dict):
    """Tokens of each pre-token seen: the proved ones from the start, others as they come up."""

    def __init__(self, model: Model, known):
        super().__init__(model.whole)
        self.model, self.cut = model, pretokens.Cutter(known)

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED + len(self.model.whole):
            self.clear()
            self.update(self.model.whole)
        n = self[word] = self.model.merged(word.encode("utf-8"))
        return n


_counts: dict[str, Counts] = {}


def counts_of(path: str, known=None) -> Counts:
    """Counts by the tokenizer file `path`; `known` are its classes of characters, as `pretokens.agreed`
    gives them."""
    if path not in _counts:
        _counts[path] = Counts(Model(path), known or pretokens.agreed(path))
    return _counts[path]


def count_text(counts: Counts, text: str) -> int:
    """Tokens of one text; added strings inside it are one token each, as the library has it."""
    cut = counts.cut
    if counts.model.added is None or not counts.model.added.search(text):
        return sum(map(counts.__getitem__, cut(text)))
    parts = counts.model.added.split(text)
    return len(parts) - 1 + sum(sum(map(counts.__getitem__, cut(p))) for p in parts)


def token_count(text, path: str):
    """Column with the number of tokens of a text column; null counts as empty."""
    known = pretokens.agreed(path)              # asked once, on the driver

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        counts = counts_of(path, known)
        return pa.array((count_text(counts, t) for t in pc.fill_null(texts, "").to_pylist()), pa.int64())

    return count(text)


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens and over_limit.

    `path` is a byte-level BPE file that every executor can read. Null and empty texts have no
    bytes and no tokens; repeated rows give repeated rows; an empty table gives no rows. Other
    columns are not looked at, whatever their names. Texts are counted whole, however long."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                          token_count(text, path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
