"""Language of documents and of spans inside them.

A model holds, for every learned language, log probabilities of letter trigrams (hashed to
FEATURES slots, word borders included) and the scripts it is written in. A word is a run of letters
of one script. Its script narrows the candidates to the languages that use it, its score under each
is the sum over its letters, and a Viterbi pass over the words of the whole text, which pays PENALTY
for each change of language, labels spans. The language of a text is the one with most letters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from brisa.llm.common import bounded_batches, given_back

FEATURES = 1 << 16
#: What a change of language costs, and by how much a language not written in the script of a word
#: stays below all others.
PENALTY, FOREIGN = 10.0, 60.0
#: Probability, as a share, spread evenly over all slots: the same for every language, so that a
#: trigram that none has seen favours none.
UNSEEN = 0.05
#: Letters a language needs in a script, as a share of its letters, to count as written in it.
SCRIPT_SHARE = 0.01
#: Code points of texts that a Python worker looks at in one go (one text at least).
BLOCK = 1_500_000
UNKNOWN = "und"
#: Ranges of code points that belong to one script.
SCRIPTS = [(0x41, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x530, 0x58F), (0x590, 0x5FF), (0x600, 0x6FF), (0x700, 0x74F), (0x750, 0x77F), (0x900, 0x97F), (0x980, 0x9FF),
           (0xA00, 0xA7F), (0xA80, 0xAFF), (0xB00, 0xB7F), (0xB80, 0xBFF), (0xC00, 0xC7F), (0xC80, 0xCFF), (0xD00, 0xD7F), (0xD80, 0xDFF), (0xE00, 0xE7F),
           (0xE80, 0xEFF), (0xF00, 0xFFF), (0x1000, 0x109F), (0x10A0, 0x10FF), (0x1100, 0x11FF), (0x1200, 0x139F), (0x1780, 0x17FF), (0x3040, 0x30FF),
           (0x3400, 0x9FFF), (0xAC00, 0xD7AF), (0x20000, 0x3FFFF)]
RESULT = "struct<lang_pred:string,score:double,spans:array<struct<start:int,end:int,lang:string>>>"


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its small letter (0 if it is no letter), and its script."""
    fold, script = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        if unicodedata.category(chr(i))[0] == "L":
            small = chr(i).lower()
            fold[i] = ord(small) if len(small) == 1 else i
    for k, (a, b) in enumerate(SCRIPTS):
        script[a:b + 1] = k + 1
    script[0x1E00:0x1F00], script[0x20000:0x40000] = 1, script[0x3400]
    return fold, script


@dataclass
class Words:
    """Words of a block of texts: where each starts and ends (positions in the block), its script,
    its text, and the trigram slot of every letter, word after word (`at` is where each begins)."""
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    text: np.ndarray
    slot: np.ndarray
    at: np.ndarray


def words_of(texts: list[str]) -> tuple[Words, np.ndarray]:
    """Words, and where each text begins in the block. Texts are kept apart by a zero."""
    fold, script = letters()
    code = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    c = fold[code]
    s = script[code]
    letter = c > 0
    before, after = np.zeros_like(letter), np.zeros_like(letter)
    before[1:] = letter[:-1] & (s[:-1] == s[1:])
    after[:-1] = letter[1:] & (s[:-1] == s[1:])
    start, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    where = np.flatnonzero(letter)
    mid = c[where].astype(np.uint64)
    left = np.where(before[where], c[where - 1], 0).astype(np.uint64)
    right = np.where(after[where], c[np.minimum(where + 1, len(c) - 1)], 0).astype(np.uint64)
    h = (left * np.uint64(0x9E3779B97F4A7C15) + mid) * np.uint64(0xC2B2AE3D27D4EB4F) + right
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    slot = (h >> np.uint64(48)).astype(np.int64) % FEATURES
    at = np.cumsum(np.concatenate([[0], end - start]))[:-1].astype(np.int64)
    text = np.searchsorted(begin, start, "right") - 1
    return Words(start, end, s[start] if len(start) else np.zeros(0, np.uint8), text, slot, at), begin


@dataclass
class Model:
    languages: list[str]
    weight: np.ndarray          # FEATURES x languages: log probabilities
    written: np.ndarray         # scripts x languages: is it written so?

    def scores(self, words: Words) -> np.ndarray:
        """Score of every word under every language."""
        out = np.empty((len(words.start), len(self.languages)), np.float64)
        if not out.size:
            return out
        for k in range(len(self.languages)):
            out[:, k] = np.add.reduceat(self.weight[:, k][words.slot], words.at)
        allowed = self.written[words.script]
        allowed |= ~allowed.any(axis=1, keepdims=True)      # a script of no learned language
        return np.where(allowed, out, out.min(axis=1, keepdims=True) - FOREIGN)


def viterbi(scores: np.ndarray, text: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Label of every word: the sequence of greatest total score less `penalty` for each change,
    for each text by itself. All texts of a block go forward together, the longest the longest.
    Ties go to staying, then to the first language."""
    n, m = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    alive = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), "right")    # texts with over t words
    stay, best = np.empty((n, m), bool), np.empty(n, np.int64)
    v = scores[first].copy()
    for t in range(1, size[0]):
        k = alive[t]
        old = v[:k]
        at = first[:k] + t
        top = old.argmax(axis=1)
        change = old[np.arange(k), top][:, None] - penalty
        keep = old >= change
        stay[at], best[at] = keep, top
        v[:k] = np.where(keep, old, change) + scores[at]
    label = np.empty(n, np.int64)
    now = v.argmax(axis=1)
    label[first + size - 1] = now
    for t in range(size[0] - 1, 0, -1):
        k = alive[t]
        at = first[:k] + t
        now[:k] = label[at]
        label[at - 1] = np.where(stay[at, now[:k]], now[:k], best[at])
    return label


def blocks(texts: list[str]):
    """Runs of texts of about BLOCK code points."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > BLOCK:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def labelled(model: Model, texts: list[str]) -> pa.StructArray:
    """Language, score and spans of each text of a block."""
    n, m = len(texts), len(model.languages)
    words, begin = words_of(texts)
    if not m:
        words = Words(*[x[:0] for x in (words.start, words.end, words.script, words.text, words.slot, words.at)])
    label = viterbi(model.scores(words), words.text)
    size = words.end - words.start
    share = np.bincount(words.text * m + label, weights=size, minlength=n * m).reshape(n, m) if m else np.zeros((n, 1))
    whole, top = share.sum(axis=1), share.argmax(axis=1)
    found = whole > 0
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    pred = names[np.where(found, top, m)]
    score = np.where(found, share[np.arange(n), top] / np.maximum(whole, 1), 0.0)
    cut = np.concatenate([[True], (label[1:] != label[:-1]) | (words.text[1:] != words.text[:-1])]) if len(label) else np.zeros(0, bool)
    head = np.flatnonzero(cut)
    tail = np.concatenate([head[1:] - 1, [len(label) - 1]]).astype(np.int64) if len(head) else head
    of = words.text[head]
    spans = pa.StructArray.from_arrays([
        pa.array((words.start[head] - begin[of]).astype(np.int32)), pa.array((words.end[tail] - begin[of]).astype(np.int32)),
        pa.array(names[label[head]], pa.string())], ["start", "end", "lang"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
    return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(ends), spans)],
                                      ["lang_pred", "score", "spans"])


def held_out(id_col: Column) -> Column:
    """Documents never learned from: CRC-32 of the id as text is 2 modulo 4; a null id too."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(True))


def learn(docs: DataFrame, per_language: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model of the languages of labelled documents that are not held out.

    It is fitted on a sample of at most about `per_language` whole documents of each language,
    those whose id hashes lowest; documents are counted over all rows. The driver gets counts for
    at most FEATURES slots and the scripts of each language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    counted = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counted)
    if not languages:
        return Model([], np.zeros((FEATURES, 0)), np.zeros((len(SCRIPTS) + 1, 0), bool))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / counted[k])))])
    place = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.filter(place < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches):
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            texts = batch.column(1).to_pylist()
            for lang in set(names):
                for run in blocks([t for t, one in zip(texts, names == lang) if one]):
                    w, _ = words_of(run)
                    slots = np.bincount(w.slot, minlength=FEATURES)
                    scripts = np.bincount(w.script, weights=w.end - w.start, minlength=len(SCRIPTS) + 1).astype(np.int64)
                    all_ = np.concatenate([slots, scripts])
                    hit = np.flatnonzero(all_)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit)), pa.array(hit.astype(np.int32)), pa.array(all_[hit].astype(np.int64))], ["lang", "slot", "n"])

    sums = sample.mapInArrow(given_back(count), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((FEATURES + len(SCRIPTS) + 1, len(languages)))
    n[sums["slot"].to_numpy(), np.searchsorted(np.array(languages, dtype=object), sums["lang"].to_numpy())] = sums["n"].to_numpy()
    slots, scripts = n[:FEATURES], n[FEATURES:]
    total = np.maximum(slots.sum(axis=0), 1)
    weight = np.log((slots / total + UNSEEN / FEATURES) / (1 + UNSEEN))
    return Model(languages, weight, scripts >= np.maximum(SCRIPT_SHARE * scripts.sum(axis=0), 1))


def language(text: str, model: Model, docs: DataFrame) -> Column:
    """Struct of lang_pred, score and spans for a text column of `docs`; null counts as empty."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)        # FEATURES x languages numbers

    def results(batches):
        for texts in batches:
            done = [labelled(shared.value, run) for run in blocks(pc.fill_null(texts, "").to_pylist())]
            yield pa.concat_arrays(done) if done else pa.array([], labelled(shared.value, [""]).type)

    @F.arrow_udf(RESULT)
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return given_back(results)(batches)
    return label(text)


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (share of the letters that lie in
    spans of that language) and spans (start, end in code points, lang).

    Without a `model` one is learned from the labelled rows of `docs` that are not held out. A text
    that is null or has no letter is `und` with score 0 and no spans, and so is every text if
    nothing could be learned. Ties go to the language first in order of names. Repeated rows get
    equal results; an empty table gives no rows. The label, source and id of a row are no input
    to its prediction; other columns are not looked at. Texts are read whole."""
    model = model or learn(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), language(text_col, model, docs).alias("__found"))
    return rows.select("doc_id", "held_out", F.col("__found.lang_pred").alias("lang_pred"), F.col("__found.score").alias("score"), F.col("__found.spans").alias("spans"))


def kept(docs: DataFrame, model: Model | None = None, least: float = 0.5, long_span: int = 40, text_col: str = "text") -> DataFrame:
    """`docs` without the documents that language identification rejects: those without a letter, and
    those where no language has `least` of the letters and no span has `long_span` characters. A text in several
    languages stays if any of them goes on that long. All columns and the other rows stay as they are."""
    model = model or learn(docs)
    found = language(text_col, model, docs)
    lasting = F.exists(found["spans"], lambda s: s["end"] - s["start"] >= long_span)
    return docs.filter((found["lang_pred"] != UNKNOWN) & ((found["score"] >= least) | lasting))
