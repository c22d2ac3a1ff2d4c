"""Texts as pieces between spaces, whose tokens can be remembered.

The pre-token pattern takes a space into the token that follows it and looks at
no context beyond white space, so a text falls apart at every single space
between two other characters: its tokens are those of the first piece, then
those of ' ' + piece for each further one. Where white space meets white space
the pieces stay together.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space before white space or the end; texts without one fall apart at every space.
TOGETHER = re.compile(r" (?=\s|\Z)")
APART = re.compile(r"(?<=\S) (?=\S)")
#: Marks that are one pre-token where they end a word of letters.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Holds wherever TOGETHER does, in Arrow's regular expressions.
MAYBE_TOGETHER = r" (?:[\s\v\x1c-\x1f\x{85}\p{Z}]|$)"


def pieces(text: str) -> list[str]:
    """The text's pieces, without the space before each but the first."""
    return APART.split(text) if TOGETHER.search(text) else text.split(" ")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


_TO_CHARS = {b: c for b, c in enumerate(byte_chars())}
_CHARS = np.array([ord(c) for c in byte_chars()], "<u2")


def mapped(piece: str) -> str:
    """A piece's UTF-8 bytes as their characters."""
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_TO_CHARS)


def byte_strings(words: list[str]) -> list[str]:
    """`mapped` of every word; no word holds a space."""
    data = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), np.uint8)
    return _CHARS[data].tobytes().decode("utf-16-le").split(_TO_CHARS[32])


def _strings(words: pa.Array) -> list[str]:
    """The words, none of which holds a space, as Python strings."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), " ")[0].as_py().split(" ")


class Memory:
    """What `make` gives for words, for the words met of late.

    Two generations of at most `most` entries bound the memory: when the young
    one is full it becomes the old one, whose entries return as they are met.
    """

    def __init__(self, make: Callable[[list[str]], list], most: int = 300_000, longest: int = 64):
        self.make, self.most, self.longest = make, most, longest
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def get(self, word: str) -> object:
        """What is remembered of a word, if anything."""
        found = self.young.get(word)
        return self.old.get(word) if found is None else found

    def __call__(self, words: list[str]) -> list:
        """What belongs to different words."""
        found = list(map(self.young.get, words))
        absent = [at for at, x in enumerate(found) if x is None]
        if not absent:
            return found
        for at in absent:
            found[at] = self.old.get(words[at])
        absent_too = [at for at in absent if found[at] is None]
        for at, x in zip(absent_too, self.make([words[at] for at in absent_too])):
            found[at] = x
        for at in absent:
            if len(words[at]) <= self.longest:
                if len(self.young) >= self.most:
                    self.old, self.young = self.young, {}
                self.young[words[at]] = found[at]
        return found


class BatchEncoder:
    """Ids of many texts at once; each different piece of a batch is looked up once.

    All give ids as the bytes of 32-bit numbers: piece those of a text, letters
    those of before + word for words of letters, which are one pre-token each,
    alone those of a text that has to be encoded for itself (None: there is none).
    """

    def __init__(self, piece: Callable[[str], bytes], letters: Callable[[list[str], str], list[bytes]], alone: Callable[[str], bytes | None] = lambda text: None, most: int = 300_000):
        self.piece, self.letters, self.alone = piece, letters, alone
        self.memories = {before: Memory(partial(self.words, before=before), n) for before, n in ((" ", most), ("", most // 4))}
        self.tails = Memory(lambda tails: list(map(piece, tails)), 10_000, 16)
        self.line = piece("\n")

    def words(self, words: list[str], before: str) -> list[bytes]:
        """The ids of before + word.

        Marks behind letters are a pre-token of their own, and so is a line end
        between other characters; what follows it begins without a space.
        """
        found: list[bytes | None] = [None] * len(words)
        plain = [at for at, word in enumerate(words) if word.isalpha()]
        new = {}
        for at, ids in zip(plain, self.letters([words[at] for at in plain], before)):
            found[at] = new[words[at]] = ids
        rest = [at for at, ids in enumerate(found) if ids is None]
        stems = {at: word for at in rest if (word := words[at].rstrip(MARKS)).isalpha()}
        memory = self.memories[before]
        known = {stem: new.get(stem) or memory.get(stem) for stem in set(stems.values())}
        absent = [stem for stem, ids in known.items() if ids is None]
        known.update(zip(absent, self.letters(absent, before)))
        tails = list({words[at][len(stem) :] for at, stem in stems.items()})
        marks = dict(zip(tails, self.tails(tails)))
        for at, stem in stems.items():
            found[at] = known[stem] + marks[words[at][len(stem) :]]
        lines = {at: parts for at in rest if "\n" in words[at] and (parts := words[at].split("\n")) == words[at].split()}
        first, later = list({p[0] for p in lines.values()}), list({x for p in lines.values() for x in p[1:]})
        begin, go_on = dict(zip(first, memory(first))), dict(zip(later, self.memories[""](later)))
        for at, (part, *more) in lines.items():
            found[at] = self.line.join([begin[part], *map(go_on.__getitem__, more)])
        for at in rest:
            if found[at] is None:
                found[at] = self.piece(before + words[at])
        return found

    def head(self, text: str) -> bytes:
        """The ids of a text that doesn't fall apart at every space."""
        first, *rest = pieces(text)
        return self.piece(first) + b"".join([self.piece(" " + word) for word in rest])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has; null is ''."""
        n = len(texts)
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        alone = {at: ids for at, text in enumerate(texts.to_pylist()) if (ids := self.alone(text)) is not None}
        whole = pc.match_substring_regex(texts, MAYBE_TOGETHER).to_numpy(zero_copy_only=False)
        whole[list(alone)] = True
        lists = pc.split_pattern(pc.if_else(pa.array(~whole), texts, ""), " ")
        words, starts = lists.flatten(), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        heads = [alone[at] if at in alone else self.head(texts[at].as_py()) if w else self.piece(first) for at, (w, first) in enumerate(zip(whole.tolist(), words.take(pa.array(starts)).to_pylist()))]
        later = np.ones(len(words), bool)
        later[starts] = False
        coded = words.filter(pa.array(later)).dictionary_encode()
        table = self.memories[" "](_strings(coded.dictionary))
        known = len(table)
        table += heads
        ids, lengths = np.frombuffer(b"".join(table), np.uint32), np.fromiter(map(len, table), np.int64, len(table)) // 4
        places = np.cumsum(lengths) - lengths
        order = np.insert(coded.indices.to_numpy().astype(np.int64), starts - np.arange(n), known + np.arange(n))
        taken = lengths[order]
        ends = np.cumsum(taken)
        at = np.repeat(places[order] - (ends - taken), taken) + np.arange(ends[-1])
        return ids[at], np.add.reduceat(taken, starts)
