"""Token ids of whole texts by the ``tokenizers`` library, one encoding per distinct word.

A byte-level BPE vocabulary never merges across the boundaries of its word pattern, and that
pattern never lets a word cross white space except for one leading space.  So a text whose only
white space is single spaces and line ends is cut there, each distinct piece is encoded once by the
library's own pre-tokenizer and model, and the ids of the text are those of its pieces in order;
pieces are told apart by 64-bit hashes within a bounded cache.  Every other text is cut where a character is followed by a single space, and its pieces likewise.

A text that holds the string of an added token (such as an end mark) is left to the library whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from .common import span_hashes

#: Always a word boundary: between a solid character and a single space before another one.
_GAP = re.compile(r"(?<=\S) (?=\S)")
#: Below it, ``str.isalpha`` and the pattern's letters agree in every Unicode version.
_LATIN_END = "\u0250"
#: White space that isn't one space or line end between solid characters.
_UNEVEN = re.compile("[ \n][ \n]|[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Distinct pieces kept by one Python worker before it starts afresh.
CACHE_PIECES = 500_000


def _is_even(text: str) -> bool:
    """Whether all white space of a text is single spaces and line ends between solid characters."""
    if not text or text[0] in " \n" or text[-1] in " \n":
        return False
    if text.replace("\n", "").isprintable():  # then its only white space is the space
        return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text)
    return not _UNEVEN.search(text)


class Encoder:
    """Encodes texts with the vocabulary file at ``path``; ``end_id`` is appended to each text."""

    def __init__(self, path: str, end_id: int = 0):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.cutter = self.tokenizer.model, self.tokenizer.pre_tokenizer
        # how the vocabulary writes each byte, as the library's pre-tokenizer shows it
        self.bytes: dict[int, str] = {}
        for c in map(chr, range(0x250)):
            self.bytes |= zip(c.encode(), "".join(w for w, _ in self.cutter.pre_tokenize_str(c)))
        self.line, self.marks = self._ids("\n"), {m: self._ids(m) for m in ".,"}
        self.end = np.array([end_id], np.uint32)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes of known pieces, in order, and where they are kept
        self.loose: dict[str, list[int]] = {}
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._keep([self.marks[","], self.marks["."]])

    def _ids(self, text: str) -> list[int]:
        return [t.id for word, _ in self.cutter.pre_tokenize_str(text) for t in self.model.tokenize(word)]

    def _word(self, word: str) -> list[int]:
        """Ids of a run of Latin letters, after a space if it starts with one."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.bytes)
        elif word[0] == " ":
            word = self.bytes[32] + word[1:]
        return [t.id for t in self.model.tokenize(word)]

    def _of(self, piece: str) -> list[int]:
        """Ids of a piece: after a line end it starts with that, else it follows a space."""
        if piece.isascii() or max(piece) < _LATIN_END:
            if piece.isalpha():
                return self._word(" " + piece)
            if piece[0] == "\n" and piece[1:].isalpha():
                return self.line + self._word(piece[1:])
        return self._ids(piece if piece[0] == "\n" else " " + piece)

    def _keep(self, ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(sizes) - sizes])
        self.count = np.concatenate([self.count, sizes])
        self.used += total

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts, each first piece taken as after a line end; and pieces per text."""
        data = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
        solid = np.zeros(len(data) + 2, np.int8)
        solid[1:-1] = (data != 32) & (data != 10)
        edge = np.diff(solid)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        spaced = np.zeros(len(starts), bool)
        spaced[1:] = data[starts[1:] - 1] == 32
        # a full stop or comma that ends a piece after an ASCII letter has an id of its own
        last = data[ends - 1]
        before = data[np.maximum(ends - 2, 0)] | 32
        marked = ((last == 46) | (last == 44)) & (ends - starts > 1) & (before >= 97) & (before <= 122)
        ends = ends - marked
        keys = span_hashes(data, starts, ends) ^ np.where(spaced, np.uint64(0x6A09E667F3BCC909), np.uint64(0))
        distinct, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == distinct[at < len(self.keys)]
        numbers = np.full(len(distinct), -1)
        numbers[known] = self.numbers[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            edges = starts[where[new]].tolist(), ends[where[new]].tolist(), spaced[where[new]].tolist()
            numbers[new] = len(self.begin) + np.arange(len(new))
            self._keep([self._of(raw[x:y].decode() if z else "\n" + raw[x:y].decode()) for x, y, z in zip(*edges)])
            self.keys, self.numbers = np.insert(self.keys, at[new], distinct[new]), np.insert(self.numbers, at[new], numbers[new])
        bounds = np.concatenate([[0], np.flatnonzero(data == 10) + 1]) if len(texts) else np.zeros(1, np.int64)
        lines = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
        bounds = bounds[np.concatenate([[0], np.cumsum(lines)])]
        upto = np.concatenate([[0], np.cumsum(1 + marked)])
        index = np.empty(upto[-1], np.int64)
        index[upto[:-1]] = numbers[inverse]
        index[upto[1:][marked] - 1] = last[marked] == 46  # the two marks are the first pieces learnt: 0 and 1
        return index, np.diff(upto[np.searchsorted(starts, bounds)])

    def _loose(self, text: str) -> np.ndarray:
        """Ids of a text with any white space."""
        out: list[int] = []
        for i, piece in enumerate(_GAP.split(text)):
            key = " " + piece if i else piece
            if (ids := self.loose.get(key)) is None:
                ids = self.loose[key] = self._ids(key)
            out += ids
        return np.array(out, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in order, each text followed by the end id; and the bounds of the texts in them."""
        if len(self.keys) > CACHE_PIECES or len(self.loose) > CACHE_PIECES // 10:
            self._clear()
        whole = [any(a in t for a in self.added) for t in texts]
        even = [not w and _is_even(t) for t, w in zip(texts, whole)]
        index, sizes = self._pieces([t for t, e in zip(texts, even) if e])
        counts = self.count[index]
        ends = np.concatenate([[0], np.cumsum(counts)])
        flat = self.pool[np.repeat(self.begin[index] - ends[:-1], counts) + np.arange(ends[-1])]
        edges = iter(ends[np.concatenate([[0], np.cumsum(sizes)])].tolist())
        at = next(edges)
        parts: list[np.ndarray] = []
        for t, e, w in zip(texts, even, whole):
            if w:
                parts.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32))
            elif e:
                at, before = next(edges), at
                parts.append(flat[before + len(self.line) : at])
            else:
                parts.append(self._loose(t))
            parts.append(self.end)
        bounds = np.cumsum([0, *(len(a) + 1 for a in parts[::2])], dtype=np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), bounds


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int = 0) -> Encoder:
    """The encoder of this Python worker; its cache lasts as long as the worker."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]
