"""Pre-tokens of byte-level BPE as the tokenizers library cuts them.

The published pattern names letters, digits and white space by Unicode class, and the library's tables
of these need not be of the same age as those of the `regex` module. `differences` asks the library
about every character, a class at a time. Texts of characters below 65,536 are cut by a pattern that spells
the library's classes; in others, characters on which the two disagree are looked at as others of
the right class."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import regex
from tokenizers import Tokenizer

#: Fixed value: how the published pre-tokenizer cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A character of each class on which all agree; none of them is part of a contraction.
HEADS = {r"\p{L}": "a", r"\p{N}": "1", r"\s": "\n", r"[^\s\p{L}\p{N}]": "!"}


def byte_of_character() -> dict[str, int]:
    """The published alphabet of byte-level BPE: printable bytes stand for themselves, the
    others for the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def differences(pre) -> dict[str, str]:
    """The class in the library of every character that the `regex` module counts to another."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    theirs = {}
    for name, head in HEADS.items():
        run = head + "".join(regex.findall(name, every))
        for _, (first, end) in pre.pre_tokenize_str(run)[1:]:          # a piece is of one class
            of = next(n for n, h in HEADS.items() if len(pre.pre_tokenize_str(h + run[first])) == 1)
            theirs.update((c, of) for c in run[first:end] if of != name)
    return theirs


@lru_cache(maxsize=4)
def agreed(path: str) -> tuple[tuple[str, str, str], dict[int, str]]:
    """What the library of the tokenizer file `path` takes for letters, digits and white space among
    the characters below 65,536, as ranges; and a character of the right class for every one on which
    the two disagree. Made once, on the driver, and sent to the tasks."""
    theirs = differences(Tokenizer.from_file(path).pre_tokenizer)
    low = "".join(chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000)
    ranges = []
    for name in list(HEADS)[:3]:
        codes = sorted({ord(c) for c in regex.findall(name, low) if c not in theirs} | {ord(c) for c, n in theirs.items() if n == name and ord(c) < 1 << 16})
        first = [c for i, c in enumerate(codes) if i == 0 or codes[i - 1] != c - 1]
        last = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
        ranges.append("".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(first, last)))
    return tuple(ranges), {ord(c): HEADS[n] for c, n in theirs.items()}


class Cutter:
    """Cuts texts into pre-tokens as the library does."""

    def __init__(self, known: tuple[tuple[str, str, str], dict[int, str]]):
        (letter, digit, self.space), self.stand_in = known
        self.low = re.compile(rf" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{digit}]+| ?[^{self.space}{letter}{digit}]+|[{self.space}]+(?![^{self.space}])|[{self.space}]+")
        self.high, self.whole = re.compile("[\U00010000-\U0010ffff]"), regex.compile(PATTERN)

    def __call__(self, text: str) -> list[str]:
        if not self.high.search(text):
            return self.low.findall(text)
        return [text[m.start():m.end()] for m in self.whole.finditer(text.translate(self.stand_in))]


def specification(path: str) -> dict:
    """The tokenizer file, if it is a plain byte-level BPE."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if (model["type"], pre["type"], spec["normalizer"]) != ("BPE", "ByteLevel", None) or pre["add_prefix_space"] or model.get("ignore_merges"):
        raise ValueError(f"{path} is not a plain byte-level BPE file")
    return spec


def added_tokens(spec: dict) -> dict[str, int]:
    """Ids of the strings that are tokens wherever they stand in a text."""
    return {t["content"]: t["id"] for t in spec["added_tokens"]}
