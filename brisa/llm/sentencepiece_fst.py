"""SentencePiece encoding and decoding as a shortest path through a weighted transducer.

The transducer has three parts. The normaliser turns spaces into U+2581 and puts one before the
text. The piece lexicon has an arc for every piece that matches at a position. Byte fallback has
an arc of up to four byte pieces for a character outside the lexicon. Composed with a text they
give a lattice; its path of least weight in the tropical semiring (sums along a path, minimum
between paths) is the encoding:

* unigram models: an arc weighs minus the score of its piece;
* BPE models: a pair of arcs (p, q) weighs 0 if merging the characters of p+q gives p, q again,
  else infinity. A segmentation is the one that merging gives exactly if each neighbouring pair
  is (no merge can cross a border that none crosses within the pair around it), so exactly one
  path through the lattice has finite weight.

No piece crosses the borders the vocabulary never spans (before U+2581 after another character,
between characters that stand side by side in no chain of pieces, such as letters and stops), so a
text is composed chunk by chunk, and the paths of frequent chunks are remembered within a bound."""

from __future__ import annotations

import math
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from brisa.llm.common import remembers

SPACE = "▁"
#: Chunks and pairs of pieces that a Python worker remembers before it starts afresh.
REMEMBERED_CHUNKS, REMEMBERED_PAIRS, LONGEST_REMEMBERED = 400_000, 1_000_000, 48
#: Fixed values of the model file: kinds of pieces, kinds of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
IDS_AND_TEXT = "struct<ids:array<int>,decoded:string>"


def _fields(raw: bytes):
    """(number, value) of each field of a protobuf message."""
    def number(i):
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if raw[i - 1] < 128:
                return value, i
    i = 0
    while i < len(raw):
        tag, i = number(i)
        kind = tag & 7
        if kind == 0:
            value, i = number(i)
        else:
            size, i = number(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = raw[i:i + size], i + size
        yield tag >> 3, value


class Transducer:
    """Normaliser, lexicon and byte fallback of one model."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int = BPE, dummy_prefix: bool = True, extra_spaces: bool = True):
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have a shortest path")
        self.kind, self.dummy_prefix, self.extra_spaces = kind, dummy_prefix, extra_spaces
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER_DEFINED)}
        if any(k == USER_DEFINED for _, _, k in pieces):
            raise ValueError("user-defined pieces are not part of this transducer")
        self.score = {p: s for p, s, k in pieces if k == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = next(i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN)
        self.unknown_weight = 10 - min(self.score.values(), default=0)
        self.longest = max(map(len, self.ids), default=1)
        self.out = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN
                    else p.replace(SPACE, " ").encode() for p, _, k in pieces]
        self.is_byte = [k == BYTE for _, _, k in pieces]
        self.control = {i for i, (_, _, k) in enumerate(pieces) if k == CONTROL}
        self.last_control = max(self.control, default=-1)
        #: Every end of a piece: its number if it is itself a piece, else -1.
        self.ends = {p[k:]: -1 for p in self.ids for k in range(len(p))} | self.ids
        self.chunks = regex.compile(self._chunk_pattern()).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.paths: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _chunk_pattern(self) -> str:
        """Runs of characters that pieces can join: the connected parts of the graph of
        neighbours inside pieces, each with the spaces before it."""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return "(?s).+"
        part: dict[str, str] = {}

        def root(c: str) -> str:
            while part.setdefault(c, c) != c:
                part[c] = c = part[part[c]]
            return c
        for piece in self.ids:
            letters = piece.lstrip(SPACE)
            for x, y in zip(letters, letters[1:] or (letters if len(piece) > 1 else "")):
                part[root(x)] = root(y)
        runs: dict[str, list[str]] = {}
        for c in part:
            runs.setdefault(root(c), []).append(regex.escape(c, special_only=False))
        sets = sorted(("[" + "".join(sorted(r)) + "]+" for r in runs.values()), key=len, reverse=True)
        return f"(?s){SPACE}*(?:{'|'.join(sets)})|{SPACE}+|." if sets else f"(?s){SPACE}+|."

    # --- normaliser -------------------------------------------------------------------------
    def normalise(self, text: str) -> str:
        if not self.extra_spaces:
            text = regex.sub(" +", " ", text.strip(" "))
        if text and self.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE)

    # --- weights ----------------------------------------------------------------------------
    def merge(self, symbols: list[str]) -> list[str]:
        """Merging by score, the leftmost of equal ones first: what defines a BPE encoding."""
        score = self.score
        while len(symbols) > 1:
            found = [score.get(a + b, -math.inf) for a, b in zip(symbols, symbols[1:])]
            best = max(found)
            if best == -math.inf:
                break
            i = found.index(best)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def pair_weight(self, p: str, q: str) -> float:
        """0 if q may follow p (p empty: begin the chunk), else infinity."""
        return 0.0 if self.merge([*p, *q]) == ([p, q] if p else [q]) else math.inf

    # --- shortest path ----------------------------------------------------------------------
    def path(self, chunk: str) -> list[str]:
        return self._bpe_path(chunk) if self.kind == BPE else self._unigram_path(chunk)

    def _bpe_path(self, chunk: str) -> list[str]:
        """States are (position, last piece). One state a position has finite weight, so the
        first found ends the search at that position."""
        ends, fits, n = self.ends, self.fits, len(chunk)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        if len(fits) >= REMEMBERED_PAIRS:
            fits.clear()
        for j in range(1, n + 1):
            i = j
            while i:
                i -= 1
                number = known = ends.get(chunk[i:j])
                if number is None or number < 0:
                    if i == j - 1:
                        number = -2 - ord(chunk[i])         # outside the lexicon: byte fallback
                    elif known is None:
                        break                               # no longer piece ends here
                    else:
                        continue
                fit = fits.get((last[i], number))
                if fit is None:
                    fit = fits[last[i], number] = self.pair_weight(chunk[start[i]:i], chunk[i:j]) == 0.0
                if fit or known is None:
                    last[j], start[j] = number, i
                    break
        return self._back(chunk, start)

    def _unigram_path(self, chunk: str) -> list[str]:
        """States are positions. Of paths of equal weight the one found first stays."""
        n, ids, score = len(chunk), self.ids, self.score
        weight, start = [0.0] + [math.inf] * n, [0] * (n + 1)
        for i in range(n):
            single = False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                piece = chunk[i:j]
                if piece in ids:
                    single |= j == i + 1
                    if weight[i] - score[piece] < weight[j]:
                        weight[j], start[j] = weight[i] - score[piece], i
            if not single and weight[i] + self.unknown_weight < weight[i + 1]:
                weight[i + 1], start[i + 1] = weight[i] + self.unknown_weight, i
        return self._back(chunk, start)

    @staticmethod
    def _back(chunk: str, start: list[int]) -> list[str]:
        found, j = [], len(chunk)
        while j:
            found.append(chunk[start[j]:j])
            j = start[j]
        return found[::-1]

    def output(self, path: list[str]) -> list[int]:
        """Ids of a path; pieces outside the lexicon as bytes, or unknown without byte pieces."""
        ids: list[int] = []
        for p in path:
            i = self.ids.get(p)
            if i is not None:
                ids.append(i)
            elif self.byte:
                ids += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                ids.append(self.unknown)
        return ids

    # --- texts ------------------------------------------------------------------------------
    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        return b"".join(map(self._chunk, self.chunks(self.normalise(text))))

    def _chunk(self, chunk: str) -> bytes:
        known = self.paths.get(chunk)
        if known is None:
            known = self.older.get(chunk)
            if known is None:
                known = np.array(self.output(self.path(chunk)), dtype="<i4").tobytes()
            if len(chunk) <= LONGEST_REMEMBERED:
                if len(self.paths) >= REMEMBERED_CHUNKS // 2:       # what was not met lately goes
                    self.older, self.paths = self.paths, {}
                self.paths[chunk] = known
        return known

    def decode(self, ids) -> str:
        """Text of ids: the output side of the transducer read backwards. Bytes that are no
        UTF-8 give U+FFFD each."""
        raw = b"".join(map(self.out.__getitem__, ids))
        try:
            text = self._decode_runs(ids) if self._has_control(ids) else raw.decode("utf-8")
        except UnicodeDecodeError:
            text = self._decode_runs(ids)
        first = next((i for i in ids if i not in self.control), None)
        drop = first is not None and (self.dummy_prefix or not self.extra_spaces) and not self.is_byte[first] and text[:1] == " "
        return text[drop:]

    def _has_control(self, ids) -> bool:
        return len(ids) > 0 and min(ids) <= self.last_control and not self.control.isdisjoint(ids)

    def _decode_runs(self, ids) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.out[i]
                continue
            while run:
                size = next((k for k in (4, 3, 2, 1) if k <= len(run) and len(run[:k].decode("utf-8", "ignore")) == 1
                             and run[:k].decode("utf-8", "ignore").encode() == bytes(run[:k])), 0)
                out.append(run[:size].decode() if size else "�")
                del run[:size or 1]
            if i is not None:
                out.append(self.out[i].decode())
        return "".join(out)


def read_model(path: str) -> Transducer:
    with open(path, "rb") as file:
        raw = file.read()
    pieces, trainer, normaliser = [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    if normaliser.get(2) or not normaliser.get(5, 1) or trainer.get(24, 0):
        raise ValueError(f"{path}: only models that keep characters as they are and put spaces first")
    return Transducer(pieces, trainer.get(3, UNIGRAM), bool(normaliser.get(3, 1)), not normaliser.get(4, 1))


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    return read_model(path)


remembers(transducer.cache_clear)


def _lists(rows: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(r) // 4 for r in rows], dtype=np.int64)
    if ends[-1] > 2 ** 31 - 1:
        raise ValueError("a batch has over 2^31 tokens; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), dtype="<i4")))


def encoded(text: str, path: str) -> Column:
    """Ids of a text column; null counts as empty."""
    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        fst = transducer(path)
        return _lists([fst.encode(t) for t in pc.fill_null(texts, "").to_pylist()])
    return encode(text)


def decoded(ids: str, path: str) -> Column:
    """Text of a column of ids; null gives an empty text."""
    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        fst = transducer(path)
        return pa.array([fst.decode(r or ()) for r in rows.to_pylist()], pa.string())
    return decode(ids)


def encoded_and_decoded(text: str, path: str) -> Column:
    """Both in one pass: struct of ids and the text decoded from them again."""
    @F.arrow_udf(IDS_AND_TEXT)
    def both(texts: pa.Array) -> pa.Array:
        fst = transducer(path)
        rows = [fst.encode(t) for t in pc.fill_null(texts, "").to_pylist()]
        back = [fst.decode(np.frombuffer(r, dtype="<i4").tolist()) for r in rows]
        return pa.StructArray.from_arrays([_lists(rows), pa.array(back, pa.string())], ["ids", "decoded"])
    return both(text)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids, n_tokens, and round_trip: the ids decode to the text again
    (false only where the text itself has U+2581, which decodes to a space).

    Null and empty texts have no ids and round trip to the empty text. Repeated rows are encoded
    each, an empty table gives no rows, other columns are not looked at, texts of any length are
    encoded whole."""
    pair = F.col("__pair")
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), encoded_and_decoded(text_col, path).alias("__pair"))
            .select("doc_id", pair["ids"].alias("ids"), F.size(pair["ids"]).alias("n_tokens"),
                    (pair["decoded"] == F.coalesce("__text", F.lit(""))).alias("round_trip")))
