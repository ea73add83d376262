"""Token ids of documents in binary shards, found by key through a minimal perfect hash.

Documents are dealt by ranges of their id and sorted, so that shards follow each other in ascending
order. A shard holds a short header and the raw ids of its documents, one after the other, two bytes
each if the vocabulary allows and four if not. A task writes its shards as it goes and begins a new one
beyond SHARD_BYTES; a file appears under its name only when it is whole, and a second attempt
writes the same bytes.

The index is cut into parts by a hash of the key. For each part a perfect hash is built from levels
of bits: on every level the remaining keys are hashed into SPREAD times as many places, keys alone
at theirs set the bit, the others go on. The number of bits set before a key's own is its slot, so
n keys have the slots 0 to n - 1. A slot stores a 64-bit fingerprint of its key and where its ids are: shard,
offset and number. A key costs a few bit probes and one comparison, then one read of the shard; a key
that was never stored is taken for another with probability 2^-64.

Equal ids are told apart by `copy`, their number among the documents of the id in the order of the
files; a key is (doc_id, copy). Rows of one id may fall into several ranges."""

from __future__ import annotations

import re
import sys
import uuid
from array import array
from dataclasses import dataclass
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from brisa.llm import pretokens
from brisa.llm.common import small, staged
from brisa.llm.wordhash import mixed
from brisa.session import shared_folder

MAGIC, HEADER = b"IDSHARD1", 16
#: A shard is closed when it has so many bytes; a task counts its shards from ROLL * its number.
SHARD_BYTES, ROLL = 128 << 20, 1 << 20
#: Keys of one part of the index, at most and on average.
PART_KEYS = 1 << 18
#: Places of a level for each remaining key.
SPREAD = 2
#: Bytes read from a shard in one go (one document at least).
READ_BYTES = 8 << 20
#: Pre-tokens in a generation of those whose ids a Python worker remembers, and their longest length.
REMEMBERED, LONG = 500_000, 64
ID = attrgetter("id")
SLOT = np.dtype([("print", "<u8"), ("shard", "<i8"), ("offset", "<i8"), ("n", "<i8")])


def place(url: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder named as Spark names it."""
    if re.match(r"file:/(?!/)", url):
        url = "file://" + url[5:]
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", url))


def write_whole(files: fs.FileSystem, path: str, chunks) -> None:
    """A file that appears under its name when all chunks are written."""
    trial = f"{path}.{uuid.uuid4().hex[:12]}"
    with files.open_output_stream(trial) as out:
        for c in chunks:
            out.write(c)
    files.move(trial, path)


# ---- ids of a text

class Ids(dict):
    """The ids of pre-tokens as bytes: the library is asked once for each, and for long ones each time.
    When REMEMBERED are there they grow old and a new generation begins; what is used again joins it."""

    def __init__(self, path: str, known, width: int):
        super().__init__()
        self.tokenize, self.kind, self.old = Tokenizer.from_file(path).model.tokenize, "H" if width == 2 else "I", {}
        self.letters = {b: c for c, b in pretokens.byte_of_character().items()}
        self.cut, self.added = pretokens.Cutter(known), pretokens.added_tokens(pretokens.specification(path))
        self.found = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def packed(self, ids) -> bytes:
        out = array(self.kind, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            spelled = piece.encode("utf-8").decode("latin-1").translate(self.letters)
            found = self.packed(map(ID, self.tokenize(spelled)))
        if len(piece) <= LONG:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.cut(text)))

    def of(self, text: str) -> bytes:
        """The ids of a text, without added ones at its ends."""
        if not any(map(text.__contains__, self.added)):
            return self.plain(text)
        out, at = [], 0
        for m in self.found.finditer(text):
            out += [self.plain(text[at:m.start()]), self.packed([self.added[m[0]]])]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


_ids: dict[tuple, Ids] = {}


def ids_of(path: str, known, width: int) -> Ids:
    if (path, width) not in _ids:
        _ids[path, width] = Ids(path, known, width)
    return _ids[path, width]


# ---- shards

class Shards:
    """Writes the shards of one task, one after the other."""

    def __init__(self, folder: str, task: int, width: int):
        (self.files, self.path), self.number, self.width = place(folder), task * ROLL, width
        self.out, self.offset = None, 0

    def add(self, ids: bytes) -> tuple[int, int]:
        """Append the ids of a document: (shard, offset in ids)."""
        if self.out is not None and self.offset * self.width >= SHARD_BYTES:
            self.close()
            self.number, self.offset = self.number + 1, 0
        if self.out is None:
            self.trial = f"{self.path}/ids-{self.number:015d}.{uuid.uuid4().hex[:12]}"
            self.out = self.files.open_output_stream(self.trial, buffer_size=1 << 20)
            self.out.write(MAGIC + np.array([self.width, 0], "<u4").tobytes())
        at = self.offset
        self.out.write(ids)
        self.offset += len(ids) // self.width
        return self.number, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.move(self.trial, f"{self.path}/ids-{self.number:015d}.bin")
            self.out = None


def shard_rows(docs: DataFrame, folder: str, path: str, end_id: int | None, width: int) -> DataFrame:
    """Write `docs` (doc_id, text) as shards: (task, doc_id, seen, shard, offset, n) of every row,
    where `seen` counts the rows of the id before it in the same task."""
    known = pretokens.agreed(path)
    end = b"" if end_id is None else np.array([end_id], f"<u{width}").tobytes()

    def write(batches):
        task, ids = TaskContext.get().partitionId(), ids_of(path, known, width)
        shards, before, seen = Shards(folder, task, width), object(), 0
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), []
            for key, text in zip(keys, batch.column(1)):
                seen = seen + 1 if key == before else 0
                before, raw = key, ids.of(text.as_py()) + end
                rows.append((seen, *shards.add(raw), len(raw) // width))
            columns = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(keys), pa.int32()), batch.column(0), *map(pa.array, columns)],
                                             ["task", "doc_id", "seen", "shard", "offset", "n"])
        shards.close()

    order = docs.withColumn("mark", F.xxhash64("text"))
    order = order.repartitionByRange(F.asc_nulls_first("doc_id"), F.asc("mark")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "mark")
    return order.select("doc_id", "text").mapInArrow(write, "task int, doc_id long, seen long, shard long, offset long, n long")


def with_copy(rows: DataFrame) -> DataFrame:
    """`rows` with `copy`: `seen`, and the rows of the id in earlier tasks. Only the first and the
    last id of a task can be in others too."""
    ends = rows.groupBy("task").agg(F.min(F.struct("doc_id")).alias("a"), F.max(F.struct("doc_id")).alias("b"))
    ends = ends.select("task", F.explode(F.array_distinct(F.array("a", "b"))).alias("e")).select("task", F.col("e.doc_id").alias("id"))
    same = (F.col("task") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("id"))
    held = rows.join(F.broadcast(ends.withColumnRenamed("task", "t")), same).groupBy("t", "id").agg(F.count("*").alias("held"))
    earlier = F.sum("held").over(Window.partitionBy("id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("earlier", earlier).filter("earlier > 0").drop("held")
    return rows.join(F.broadcast(held), same, "left").withColumn("copy", F.col("seen") + F.coalesce("earlier", F.lit(0))).drop("t", "id", "earlier", "seen")


# ---- perfect hash

def key_hash(doc_id: np.ndarray, missing: np.ndarray, copy: np.ndarray, level: int) -> np.ndarray:
    """64 bits of a key for a level; level 0 is the fingerprint."""
    seed = mixed(np.array([level + 1], np.uint64))
    id_ = np.where(missing, 0, doc_id).astype(np.int64).view(np.uint64)
    h = mixed(id_ + seed) + mixed((copy.astype(np.uint64) << np.uint64(1)) + missing.astype(np.uint64) + (seed ^ np.uint64(0x9E3779B97F4A7C15)))
    return mixed(h)


def raw_keys(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    id_, copy = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column("doc_id"), table.column("copy")))
    return np.asarray(pc.fill_null(id_, 0)), np.asarray(id_.is_null()), np.asarray(copy)


@dataclass
class PerfectHash:
    """Bits of all levels, one after the other; level k has `places[k]` of them."""
    places: np.ndarray
    bits: np.ndarray

    def __post_init__(self):
        self.first = np.concatenate([[0], np.cumsum(self.places)]).astype(np.int64)
        self.words = np.packbits(np.concatenate([self.bits, np.zeros(-len(self.bits) % 64, np.uint8)]), bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    @classmethod
    def build(cls, id_, missing, copy) -> "PerfectHash":
        """Of different keys: with the right to go on, each finds a place of its own."""
        places, bits, left = [], [], np.arange(len(id_))
        while len(left):
            m = SPREAD * len(left) + 1
            at = (key_hash(id_[left], missing[left], copy[left], len(places) + 1) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            places.append(m)
            bits.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        return cls(np.array(places, np.int64), np.concatenate(bits) if bits else np.zeros(0, np.uint8))

    def slots(self, id_, missing, copy) -> np.ndarray:
        """Slot of each key; -1 if no level has its bit."""
        out, left = np.full(len(id_), -1, np.int64), np.arange(len(id_))
        for level, m in enumerate(self.places.tolist()):
            at = self.first[level] + (key_hash(id_[left], missing[left], copy[left], level + 1) % np.uint64(m)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = ((word >> bit) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[at >> 6] + below)[hit]
            left = left[~hit]
        return out


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(parts)).cast("int")


def build_index(rows: DataFrame, folder: str, parts: int) -> DataFrame:
    """Write the parts of the index over `rows` (doc_id, copy, shard, offset, n): (part, keys)."""
    def build(table: pa.Table) -> pa.Table:
        keys, part = raw_keys(table), table.column("part")[0].as_py()
        perfect = PerfectHash.build(*keys)
        slot = perfect.slots(*keys)
        entries = np.zeros(len(slot), SLOT)
        entries["print"][slot] = key_hash(*keys, 0)
        for c in ("shard", "offset", "n"):
            entries[c][slot] = np.asarray(table.column(c))
        head = np.array([len(slot), len(perfect.places), len(perfect.words)], "<i8")
        files, path = place(folder)
        write_whole(files, f"{path}/part-{part:06d}.mph", (head.tobytes(), perfect.places.astype("<i8").tobytes(), perfect.words.tobytes(), entries.tobytes()))
        return pa.table([table.column("part").slice(0, 1), pa.array([len(slot)], pa.int64())], names=["part", "keys"])

    return rows.select("doc_id", "copy", "shard", "offset", "n", part_of(parts).alias("part")).groupBy("part").applyInArrow(build, "part int, keys long")


def load_part(folder: str, part: int) -> tuple[PerfectHash, np.ndarray] | None:
    files, path = place(folder)
    path = f"{path}/part-{part:06d}.mph"
    if files.get_file_info(path).type == fs.FileType.NotFound:
        return None                                             # no key fell into it
    with files.open_input_stream(path) as file:
        n, levels, words = np.frombuffer(file.read(24), "<i8").tolist()
        places = np.frombuffer(file.read(8 * levels), "<i8")
        bits = np.unpackbits(np.frombuffer(file.read(8 * words), np.uint8), bitorder="little")
        return PerfectHash(places, bits), np.frombuffer(file.read(n * SLOT.itemsize), SLOT)


# ---- the whole

@dataclass
class TokenFiles:
    """Written shards and their index. `shards` has a row for each shard: its number, its documents
    and ids, and `first`, the ids of all shards before it."""
    folder: str
    parts: int
    shards: DataFrame

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(doc_id, copy, shard, offset, n) of the different keys in `keys` (doc_id, copy) that are
        stored; others give no row. `offset` and `n` count ids."""
        folder = self.folder

        def find(table: pa.Table) -> pa.Table:
            raw, out = raw_keys(table), table.select(["doc_id", "copy"])
            loaded = load_part(folder, table.column("part")[0].as_py())
            slot = loaded[0].slots(*raw) if loaded else np.full(len(out), -1)
            entries = loaded[1] if loaded else np.zeros(0, SLOT)
            known = slot >= 0
            known[known] = entries["print"][slot[known]] == key_hash(*(k[known] for k in raw), 0)
            there = entries[slot[known]]
            out = out.filter(pa.array(known))
            for c in ("shard", "offset", "n"):
                out = out.append_column(c, pa.array(there[c]))
            return out

        wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("copy").cast("long").alias("copy")).distinct()
        return wanted.withColumn("part", part_of(self.parts)).groupBy("part").applyInArrow(find, "doc_id long, copy long, shard long, offset long, n long")

    def read(self, places: DataFrame) -> DataFrame:
        """`places`, as `lookup` gives them, with `ids`: little-endian unsigned 32-bit integers."""
        folder = self.folder

        def work(batches):
            files, path = place(folder)
            file = number = width = None
            for batch in batches:
                shard, offset, n = (np.asarray(batch.column(c)) for c in ("shard", "offset", "n"))
                out, i = [], 0
                while i < len(shard):
                    if shard[i] != number:
                        number = shard[i]
                        file = files.open_input_file(f"{path}/ids-{number:015d}.bin")
                        head = file.read(HEADER)
                        if head[:8] != MAGIC:
                            raise ValueError(f"shard {number} has no header")
                        width = int(np.frombuffer(head[8:12], "<u4")[0])
                    j = i + 1
                    while j < len(shard) and shard[j] == number and (offset[j] + n[j] - offset[i]) * width <= READ_BYTES:
                        j += 1
                    raw = file.read_at(int(offset[j - 1] + n[j - 1] - offset[i]) * width, int(offset[i]) * width + HEADER)
                    ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                    out += [ids[a:a + k].tobytes() for a, k in zip((offset[i:j] - offset[i]).tolist(), n[i:j].tolist())]
                    i = j
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.large_binary()).cast(pa.binary())], [*batch.schema.names, "ids"])

        rows = places.select("doc_id", "copy", "shard", "offset", "n").repartition("shard").sortWithinPartitions("shard", "offset")
        return rows.mapInArrow(work, "doc_id long, copy long, shard long, offset long, n long, ids binary")

    def documents(self, keys: DataFrame) -> DataFrame:
        """(doc_id, copy, start, n_tokens, ids) of stored keys, read from the files through the index;
        `start` counts the ids of all documents before."""
        read = self.read(self.lookup(keys))
        base = small(self.shards.select(F.col("shard").alias("s"), "first"))
        return read.join(base, read.shard == F.col("s")).select(
            "doc_id", "copy", (F.col("first") + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"), "ids")


def write_tokens(docs: DataFrame, path: str, end_id: int | None = None, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[TokenFiles, DataFrame]:
    """Encode every text of `docs` with the byte-level BPE file `path`, append `end_id` to each and write
    the ids in ascending order of `id_col`, then the index. Gives the files and the keys (doc_id, copy) written.

    `folder` is one that all executors share; by default a new one under spark.checkpoint.dir. Null and
    empty texts have no ids but the appended one. Null ids come first; rows with the same id are kept
    as copies 0, 1, .. in the order of a hash of their text (equal rows in any order). An empty table
    gives no shard, and an index without keys. Other columns are not looked at, whatever their names.
    Texts are encoded whole; a document is never cut over two shards."""
    spark: SparkSession = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex[:12]}"
    files, at = place(folder)
    files.create_dir(at)
    vocabulary = max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())
    width = 2 if max(vocabulary, end_id or 0) < 1 << 16 else 4
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = staged(shard_rows(plain, folder, path, end_id, width), "token-rows")
    keyed = with_copy(rows)
    first = F.sum("n_ids").over(Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = rows.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_ids")).withColumn("first", F.coalesce(first, F.lit(0)))
    shards = staged(shards, "token-shards")
    parts = max(-(-rows.count() // PART_KEYS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    staged(build_index(keyed, folder, parts), "token-index")
    return TokenFiles(folder, parts, shards), keyed.select("doc_id", "copy")
