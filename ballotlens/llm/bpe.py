"""Byte-pair encoding and decoding of whole texts by tree concatenation.

A byte-pair encoding is fixed by local agreement: a sequence of tokens is the
encoding of its bytes if every two neighbours are the encoding of theirs.  So
two halves can be encoded apart, and then only a window round the join has to
be encoded anew; the window grows until its outermost tokens equal those of
the halves, from where on the halves' tokens stand as they are.

That is used twice:

* inside a word (what the tokenizer's pattern doesn't split) of more than
  ``LEAF`` bytes: halves of halves, joined pairwise up the tree.  Words, leaves
  and small windows recur, so a worker remembers a bounded number of each;
* across a document of more than ``leaf_chars`` characters: Spark cuts it into
  leaves wherever the count falls, tasks encode the leaves in parallel, and a
  grouped step joins a document's leaves.  At a join the text is scanned anew
  from the last word that the cut can't have touched, until a word ends where
  one of the right leaf's words ends; growing windows again.

``encode_documents`` gives ids, ``round_trip`` ids and the decoded text.
Short and long documents take the same functions; nothing is cut off.

Defined results: null text counts as empty (no ids, empty decoded text); the
special string ``<|endoftext|>`` inside a text is its own id, as the library
does by default; repeated rows each give their row; null doc_id is kept; extra
columns go no further; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlens.llm import pretokens
from ballotlens.llm.common import arrays_to_batch, id_and_text, release_memory, small_batches

LEAF = 6                   # bytes of a word that are merged without cutting it
KEPT = 150_000             # words, leaves and windows that a worker remembers of each; then it starts anew
KEPT_LENGTH = 48           # longer words are not remembered
SEAM = 48                  # characters from which a word across a cut is joined from the leaves' halves
LEAF_CHARS = 32_768        # characters of a leaf of a long document
BITS = 20                  # an id takes fewer bits than that
MASK = (1 << BITS) - 1
NONE = 1 << 62


class _Remembered(dict):
    """Results by key, filled as keys turn up.  At most ``KEPT`` (over ``less``)
    stay, and as many of the generation before, from which those still asked
    for move over."""

    def __init__(self, make, less: int = 1):
        super().__init__()
        self.make, self.before, self.most = make, {}, max(1, KEPT // less)

    def __missing__(self, key):
        made = self.before.get(key)
        if made is None:
            made = self.make(key)
        if type(key) is not str or len(key) <= KEPT_LENGTH:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[key] = made
        return made


class ByteBpe:
    """A byte-level vocabulary file: symbols, merge ranks, tokens' bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        to_byte = byte_characters()
        self.bytes_of = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items()}
        self.byte_id = [0] * 256
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.byte_id[b[0]] = i
        # pair of ids -> rank and merged id in one number, so that the least is the next merge
        self.pairs = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[a] << BITS | vocab[b]] = rank << BITS | vocab[a + b]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.split_special = regex_of(self.special)
        self.words = pretokens.Words(pretokens.BYTE_LEVEL, path)
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.table))]
        self.kept = _Remembered(lambda w: self.pack(self.encode_word(w.encode())))
        self.leaves = _Remembered(lambda w: tuple(self.merge([self.byte_id[b] for b in w])))
        self.seams = _Remembered(self.meet)
        self.windows = _Remembered(self.window, 3)

    def pack(self, ids) -> bytes:
        return b"".join([self.packed[i] for i in ids])

    # words

    def merge(self, ids: list[int]) -> list[int]:
        """The encoding of a short run of symbols: least rank first, leftmost first."""
        get, s = self.pairs.get, ids
        ranks = [get(a << BITS | b, NONE) for a, b in zip(s, s[1:])]
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            s[i:i + 2] = [best & MASK]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(s[i] << BITS | s[i + 1], NONE)
            if i:
                ranks[i - 1] = get(s[i - 1] << BITS | s[i], NONE)
        return s

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for windows of any length."""
        n, get = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << BITS | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        s = [*ids, -1]
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or s[i] != a or s[j] != b:
                continue
            s[i], s[j], after[i] = r & MASK, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := get(s[x] << BITS | s[y], NONE)) != NONE:
                    heapq.heappush(heap, (q, x, s[x], s[y]))
        return [x for x in s[:n] if x >= 0]

    def encode_bytes(self, word: bytes) -> list[int]:
        ids = [self.byte_id[b] for b in word]
        return self.merge(ids) if len(ids) <= 64 else self.merge_long(ids)

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The two halves' encodings, joined; leaves are merged at once."""
        n = len(word)
        if n <= LEAF:
            return self.leaves[word]
        return self.join(self.encode_word(word[:n // 2]), self.encode_word(word[n // 2:]))

    def window(self, key: tuple) -> tuple[int, ...]:
        left, right = key
        return tuple(self.encode_bytes(b"".join([self.bytes_of[x] for x in left + right])))

    def meet(self, key: int) -> tuple[int, ...]:
        """The encoding of two tokens together; empty if it's the two themselves."""
        pair = key >> BITS, key & MASK
        found = tuple(self.encode_bytes(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]))
        return () if found == pair else found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of both together: a window of the last ``i`` tokens of
        the left and the first ``j`` of the right is encoded anew, and grows on
        the side where its outermost token isn't the half's own."""
        window = self.seams[left[-1] << BITS | right[0]]
        if not window:
            return left + right
        i = j = 1
        while True:
            tail, head = left[-i:], right[:j]
            if i + j > 2:
                window = self.windows[tail, head] if i + j <= 4 else self.window((tail, head))
            left_ok = i >= len(left) or window[0] == tail[0]
            right_ok = j >= len(right) or window[-1] == head[-1]
            if left_ok and right_ok:
                return left[:-i] + window + right[j:]
            i, j = i if left_ok else 2 * i, j if right_ok else 2 * j

    # texts

    def encode(self, text: str) -> bytes:
        """Packed ids (little-endian unsigned 32 bits) of a text, special strings included."""
        if not any(s in text for s in self.special):
            return b"".join(map(self.kept.__getitem__, self.words.find(text)))
        return b"".join(self.packed[self.special[p]] if k % 2 else
                        b"".join(map(self.kept.__getitem__, self.words.find(p)))
                        for k, p in enumerate(self.split_special.split(text)))

    def decode(self, packed: bytes) -> bytes:
        """UTF-8 of the decoded text; what isn't UTF-8 becomes U+FFFD, as the library does."""
        out = b"".join(map(self.table.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        try:
            out.decode()
            return out
        except UnicodeDecodeError:
            return out.decode(errors="replace").encode()

    def encode_leaf(self, text: str) -> "Leaf":
        words = self.words.find(text)
        return Leaf(words, [self.kept[w] for w in words])

    def join_leaves(self, a: "Leaf", b: "Leaf") -> "Leaf":
        """Joins two neighbouring leaves of one document.

        A word depends on no more than the three characters after its end
        (contractions and the look-ahead after white space), so the words of
        ``a`` that end earlier stand.  From there the text is scanned anew
        over a window that grows until one of its words ends, away from the
        window's own end, where a word of ``b`` ends.
        """
        first, spare = len(a.words), 0
        while first and spare < 4:
            first -= 1
            spare += len(a.words[first])
        if first and a.words[first].isspace():   # white space before it belongs to one run
            while first and a.words[first - 1].isspace():
                first -= 1
        head, take = "".join(a.words[first:]), 8
        while True:
            whole = take >= len(b.words)
            window = self.words.find(head + "".join(b.words[:take]))
            ends, at = {}, len(head)
            for k, w in enumerate(b.words[:take]):
                at += len(w)
                ends[at] = k + 1
            length, at = at, 0
            for k, w in enumerate(window):
                at += len(w)
                if at > len(head) and at in ends and (whole or at + 4 <= length) and (whole or not w.isspace()):
                    seam = [self.seam(w, a, b, first, k) if len(w) > SEAM else self.kept[w] for k, w in enumerate(window[:k + 1])]
                    return Leaf(a.words[:first] + window[:k + 1] + b.words[ends[at]:], a.ids[:first] + seam + b.ids[ends[at]:])
            if whole:
                return Leaf(a.words[:first] + window, a.ids[:first] + [self.kept[w] for w in window])
            take *= 2

    def seam(self, word: str, a: "Leaf", b: "Leaf", first: int, k: int) -> bytes:
        """A long word across the cut: the halves that the leaves already hold are joined."""
        if k == 0 and first == len(a.words) - 1 and b.words and word == a.words[-1] + b.words[0]:
            return self.pack(self.join(*(tuple(np.frombuffer(x, "<u4").tolist()) for x in (a.ids[-1], b.ids[0]))))
        return self.kept[word]


class Leaf:
    """Words of a piece of a document and their packed ids."""

    def __init__(self, words: list[str], ids: list[bytes]):
        self.words, self.ids = words, ids


def byte_characters() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable Latin-1 stands
    for itself, the other bytes in order for U+0100 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def regex_of(special):
    import re

    return re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One vocabulary for each worker process."""
    release_memory()
    return ByteBpe(path)


_OUT = "doc_id long, n_tokens long, ids binary, decoded string"


def _schema(decode: bool):
    import pyarrow as pa

    return pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
                     + [("decoded", pa.string())] * decode)


def _emit(bpe: ByteBpe, doc_ids, packed, decode):
    cols = [doc_ids, [len(x) // 4 for x in packed], packed]
    if decode:
        import pyarrow as pa
        cols.append(pa.array([bpe.decode(x) for x in packed], pa.binary()).cast(pa.string()))
    return arrays_to_batch(_schema(decode), cols)


def _encode(docs: DataFrame, path: str, id_col: str, text_col: str, leaf_chars: int, decode: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    schema = _OUT if decode else _OUT.rpartition(",")[0]
    rows = id_and_text(docs, id_col, text_col)
    is_long = F.length("text") > leaf_chars

    def short(batches):
        bpe = load(path)
        for b in batches:
            yield _emit(bpe, b.column(0), [bpe.encode(t) for t in b.column(1).to_pylist()], decode)

    def cut(batches):
        """Leaves of long documents; a special string is a leaf of its own."""
        import pyarrow as pa
        bpe = load(path)
        out = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("part", pa.int64()), ("leaf", pa.int64()), ("text", pa.string())])
        for b in batches:
            for d, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = [(p, k, s[k:k + leaf_chars] if p % 2 == 0 else s) for p, s in enumerate(bpe.split_special.split(t))
                      for k in range(0, max(1, len(s)) if p % 2 == 0 else 1, leaf_chars)]
                yield arrays_to_batch(out, [[d] * len(at), [h] * len(at), *([x[i] for x in at] for i in range(3))])

    def leaves(batches):
        import pyarrow as pa
        bpe = load(path)
        out = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("part", pa.int64()), ("leaf", pa.int64()),
                         ("text", pa.string()), ("ends", pa.list_(pa.int32())), ("n_ids", pa.list_(pa.int32())), ("ids", pa.binary())])
        for b in batches:
            found = [bpe.encode_leaf(t) if p % 2 == 0 else None for p, t in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield arrays_to_batch(out, [*b.columns,
                                        [[] if f is None else np.cumsum([len(w) for w in f.words], dtype=np.int32) for f in found],
                                        [[] if f is None else [len(x) // 4 for x in f.ids] for f in found],
                                        [b"" if f is None else b"".join(f.ids) for f in found]])

    def joined(table):
        """All leaves of one document (and of its repeated rows, which are alike)."""
        bpe = load(path)
        parts: dict = {}
        times: dict = {}
        for r in sorted(table.to_pylist(), key=lambda r: (r["part"], r["leaf"])):
            key = (r["part"], r["leaf"])
            times[key] = times.get(key, 0) + 1
            if times[key] > 1:
                continue
            if r["part"] % 2:
                parts[r["part"]] = bpe.packed[bpe.special[r["text"]]]
                continue
            cuts = [0, *np.cumsum(r["n_ids"], dtype=np.int64).tolist()]
            ends = [0, *r["ends"]]
            parts.setdefault(r["part"], []).append(Leaf([r["text"][a:b] for a, b in zip(ends, ends[1:])], [r["ids"][4 * a:4 * b] for a, b in zip(cuts, cuts[1:])]))
        packed = b""
        for p in sorted(parts):
            level = parts[p]
            if isinstance(level, bytes):
                packed += level
                continue
            while len(level) > 1:   # up the tree
                level = [bpe.join_leaves(*level[i:i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            packed += b"".join(level[0].ids)
        n, doc = max(times.values()), table.column("doc_id")[0].as_py()
        import pyarrow as pa
        return pa.Table.from_batches([_emit(bpe, [doc] * n, [packed] * n, decode)])

    in_one = rows.filter(~is_long).mapInArrow(short, schema)
    leaf = (rows.filter(is_long).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
            .mapInArrow(cut, "doc_id long, text_hash long, part long, leaf long, text string")
            .repartition("doc_id", "text_hash", "part", "leaf")
            .mapInArrow(leaves, "doc_id long, text_hash long, part long, leaf long, text string, ends array<int>, n_ids array<int>, ids binary"))
    return in_one.unionByName(leaf.groupBy("doc_id", "text_hash").applyInArrow(joined, schema))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids): ids packed as little-endian unsigned 32 bits."""
    return _encode(docs, path, id_col, text_col, leaf_chars, decode=False)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
               leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): encoded, and decoded from the ids."""
    return _encode(docs, path, id_col, text_col, leaf_chars, decode=True)


def decode_documents(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of packed ids; null ids give the empty text."""
    small_batches(ids.sparkSession)
    rows = ids.select(ids[id_col].cast("long").alias("doc_id"), F.coalesce(ids[ids_col], F.lit(b"")).alias("ids"))

    def decode(batches):
        import pyarrow as pa
        bpe, out = load(path), pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])
        for b in batches:
            yield arrays_to_batch(out, [b.column(0), pa.array([bpe.decode(x) for x in b.column(1).to_pylist()], pa.binary()).cast(pa.string())])

    return rows.mapInArrow(decode, "doc_id long, decoded string")
