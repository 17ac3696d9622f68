"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols lie in a doubly linked list, its mergeable neighbours in a
heap by (rank, place).  Popping the lowest rank merges one pair and pushes the
two pairs it makes.  A word's count is its symbols less its merges; no
identifiers are written.

The vocabulary file (BPE with an end-of-word mark, lower case, white space
dropped) is a parameter.  Words recur, so a worker remembers the counts of a
bounded number of them.

Defined results: null counts as the empty text (0 bytes, 0 tokens); the
vocabulary's special strings inside a text count as one token each, as the
library does by default; texts of any length are counted whole; repeated rows
each give their row; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlens.llm import pretokens
from ballotlens.llm.bpe import BITS, MASK, _Remembered, byte_characters, regex_of
from ballotlens.llm.common import arrays_to_batch, id_and_text, small_batches


class WordCounter:
    """A vocabulary file as merge ranks between symbol numbers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        chars = {b: c for c, b in byte_characters().items()}
        self.inner = [vocab[chars[b]] for b in range(256)]
        self.last = [vocab[chars[b] + end] for b in range(256)]
        self.pairs = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[a] << BITS | vocab[b]] = rank << BITS | vocab[a + b]
        self.split_special = regex_of([t["content"] for t in spec["added_tokens"]])
        self.words = pretokens.Words(pretokens.WORD_LEVEL, path)
        self.spaces = regex.compile(r"\s+")
        self.kept = _Remembered(self.count_word)

    def count_word(self, word: str) -> int:
        raw = word.encode()
        s = [self.inner[b] for b in raw[:-1]]
        s.append(self.last[raw[-1]])
        return len(s) - self.merges(s)

    def merges(self, s: list[int]) -> int:
        """How many merges the symbols take."""
        n, get, done = len(s), self.pairs.get, 0
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := get(s[i] << BITS | s[i + 1])) is not None]
        if not heap:
            return 0
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        s.append(-1)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or s[j] != b or j >= n:
                continue            # one of the two has been merged meanwhile
            done += 1
            s[i], s[j] = r & MASK, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := get(s[i] << BITS | s[k])) is not None:
                    heapq.heappush(heap, (q, i, s[i], s[k]))
            h = before[i]
            if h >= 0 and (q := get(s[h] << BITS | s[i])) is not None:
                heapq.heappush(heap, (q, h, s[h], s[i]))
        return done

    def normalized(self, text: str) -> str:
        """NFC, white space runs to one space, lower case letter by letter."""
        if text.isascii():
            return text.lower()
        if pretokens.unknown_in(text):
            return self.words.library.normalizer.normalize_str(text)
        return self.spaces.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()

    def count(self, text: str) -> int:
        parts = self.split_special.split(text)
        return len(parts) // 2 + sum(sum(map(self.kept.__getitem__, self.words.find(self.normalized(p)))) for p in parts[::2])


@lru_cache(maxsize=2)
def load(path: str) -> WordCounter:
    return WordCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""
    small_batches(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        counter = load(path)
        out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
        for b in batches:
            yield arrays_to_batch(out, [b.column(0), pc.binary_length(b.column(1)).cast(pa.int64()), [counter.count(t) for t in b.column(1).to_pylist()]])

    return (rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
