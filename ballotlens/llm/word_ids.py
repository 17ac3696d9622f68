"""Ids of many Latin-1 texts at once: words are found and looked up as arrays.

The tokenizer's pattern (``pretokens.BYTE_LEVEL``) looks only at the classes of
neighbouring characters, and at apostrophes, so array operations find where words start.  A word of
at most ``SHORT`` characters is two 64-bit numbers that tell it apart exactly,
and a table by two hashes of them holds the ids of words seen before; the
library is asked for the rest.  The table's places are overwritten, and its ids
start anew beyond ``KEPT_IDS``, so a worker's memory stays bounded.

A word alone has the ids that it has in its text: whichever part of the pattern
matched it there matches it whole where nothing follows.
"""

from __future__ import annotations

import numpy as np

from ballotlens.llm import pretokens

SHORT = 15                    # characters of a word that the table holds
PLACES = 20                   # bits of a place in the table
KEPT_IDS = 1 << 22
LONG_TEXT = 1 << 22           # longer texts go to the library whole

_LETTER, _NUMBER, _SPACE, _OTHER, _END = range(5)
_U = np.uint64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def _classes() -> np.ndarray:
    text = "".join(map(chr, range(256)))
    out = np.full(256, _OTHER, np.uint8)
    for cls, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        out[[ord(c) for c in pretokens.regex.findall(pattern, text)]] = cls
    return out


def word_starts(x: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where words start in texts of Latin-1 bytes, each followed by a byte at
    ``ends``, which is a word of its own."""
    cls = classes[x]
    cls[ends] = _END
    start = np.ones(len(x), bool)
    start[1:] = cls[1:] != cls[:-1]
    start[ends] = True
    # of blanks before another word the last goes apart, or with the word if it's a space
    at = np.flatnonzero((cls[1:] < _END) & (cls[1:] != _SPACE) & (cls[:-1] == _SPACE)) + 1
    start[at - 1] = True
    start[at] = x[at - 1] != 32
    # 's 't 'm 'd 're 've 'll
    at = np.flatnonzero((x[:-1] == 39) & start[:-1] & (cls[:-1] == _OTHER) & (cls[1:] == _LETTER))
    if len(at):
        one, two = x[at + 1], x[np.minimum(at + 2, len(x) - 1)]
        long = (one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)
        for size, held in ((1, np.isin(one, list(b"stmd"))), (2, long)):
            start[at[held] + 1] = False
            start[at[held] + 1 + size] = True
    return np.flatnonzero(start)


class WordIds:
    """``library``: a function from a text to its list of ids."""

    def __init__(self, library):
        self.library, self.classes = library, _classes()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros((2, 1 << PLACES), _U)              # a word's two numbers; the second is never 0
        self.first, self.size = np.zeros((2, 1 << PLACES), np.int32)
        self.used = 0

    def _put(self, words: list[list[int]], at: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the words' ids begin, written from ``at`` on, and how many they are."""
        sizes = np.fromiter(map(len, words), np.int32, len(words))
        first = at + np.cumsum(sizes, dtype=np.int32) - sizes
        flat = np.fromiter((i for w in words for i in w), np.uint32)
        if at + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(at + len(flat), np.uint32)))
        self.ids[at:at + len(flat)] = flat
        return first, sizes

    def _of(self, raw: bytes, starts, stops, at) -> tuple[list[list[int]], np.ndarray]:
        """The ids of the words numbered ``at``, each word once, and which is whose."""
        number, found, which = {}, [], np.empty(len(at), np.int64)
        for k, (s, e) in enumerate(zip(starts[at].tolist(), stops[at].tolist())):
            w = raw[s:e]
            j = number.get(w)
            if j is None:
                j = number[w] = len(found)
                found.append(self.library(w.decode("latin-1")))
            which[k] = j
        return found, which

    def encode(self, texts: list[bytes], end_id: int) -> list[np.ndarray]:
        """Ids of each text in Latin-1, with the end id."""
        if self.used > KEPT_IDS:
            self.forget()
        raw = b"\0".join(texts) + b"\0"
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        x = np.frombuffer(raw + bytes(16), np.uint8)
        starts = word_starts(x[:len(raw)], ends, self.classes)
        stops = np.append(starts[1:], len(raw))
        sizes = stops - starts
        # eight characters from everywhere, of which those of words are taken
        eight = np.ndarray((len(raw) + 8,), "<u8", x, strides=(1,))
        a = eight[starts] & _MASKS[np.minimum(sizes, 8)]
        b = eight[starts + 8] & _MASKS[np.minimum(np.maximum(sizes - 8, 0), 7)] | sizes.astype(_U) << _U(56)
        mixed = a * _U(0x9E3779B97F4A7C15) + b * _U(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ mixed >> _U(29)) * _U(0xBF58476D1CE4E5B9)
        place = (mixed >> _U(64 - PLACES)).astype(np.intp)
        found = (self.keys[0].take(place) == a) & (self.keys[1].take(place) == b)
        rest = np.flatnonzero(~found)
        second = (mixed[rest] >> _U(64 - 2 * PLACES) & _U((1 << PLACES) - 1)).astype(np.intp)
        here = (self.keys[0].take(second) == a[rest]) & (self.keys[1].take(second) == b[rest])
        place[rest[here]] = second[here]
        found[rest[here]] = True
        is_end = np.zeros(len(starts), bool)
        is_end[np.searchsorted(starts, ends)] = True
        first, n = self.first.take(place), self.size.take(place)
        # new words, for the table
        new = ~found[rest] & (sizes[rest] <= SHORT) & ~is_end[rest]
        at, second = rest[new], second[new]
        words, which = self._of(raw, starts, stops, at)
        begin, count = self._put(words, self.used)
        self.used += int(count.sum())
        first[at], n[at] = begin[which], count[which]
        # long words, and the ends, for this time
        long = np.flatnonzero((sizes > SHORT) & ~is_end)
        words, which = self._of(raw, starts, stops, long)
        begin, count = self._put([*words, [end_id]], self.used)
        first[long], n[long] = begin[which], count[which]
        first[is_end], n[is_end] = begin[-1], 1
        place = np.where(self.keys[1].take(place[at]) == 0, place[at], second)
        self.keys[0][place], self.keys[1][place], self.first[place], self.size[place] = a[at], b[at], first[at], n[at]
        upto = np.cumsum(n, dtype=np.int64)
        ids = self.ids.take(np.repeat(first - (upto - n), n) + np.arange(upto[-1]))
        return np.split(ids, upto[is_end][:-1])
