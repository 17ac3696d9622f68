"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may occur in a document with up to
``floor(error_rate * n)`` edits.  Cut into one piece more than that, at least
one piece of it must occur unchanged.  All pieces of a block of items form one
automaton (Aho-Corasick), which each document streams through once; where a
piece is hit, the item is laid against the text round it and Myers'
bit-parallel algorithm gives the least edit distance of the whole item to any
part of that window.

Items go in blocks of ``block_items`` and BLOCK_BYTES, so what a task holds is
bounded however long the benchmark is; each block passes over all documents,
and a filter writes what one block leaves before the next one's pass.

Texts and items are compared in lower case with white space runs as one blank.

Defined results: one row for each document and item that match, with the least
distance; null and empty items match nothing, nor do null or empty texts; items
shorter than ``min_chars`` match only as they are and between word bounds (a
few letters inside a word are no evidence); repeated rows of a
document or item give one row; very long texts are searched whole; an empty
table on either side gives an empty result; extra columns go no further.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlens.llm.common import arrays_to_batch, discard, forget_vocabularies, lasting, small_batches, stored, temporary, text_of

ERROR_RATE = 0.05
MIN_CHARS = 12
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20     # of items in a block


def canonical(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(n: int, budget: int) -> list[tuple[int, int]]:
    """Start and end of budget + 1 pieces of nearly equal length."""
    cut = [n * k // (budget + 1) for k in range(budget + 2)]
    return list(zip(cut, cut[1:]))


def myers(item: str, window: str, masks: dict[str, int] | None = None) -> int:
    """Least edit distance of ``item`` to any part of ``window``."""
    m = len(item)
    if not m:
        return 0
    if masks is None:
        masks = char_masks(item)
    top, full = 1 << (m - 1), (1 << m) - 1
    pv, mv, score = full, 0, m
    best = m
    for c in window:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full     # 0 above the first row: a match may begin anywhere
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best = score
            if not best:
                break
    return best


def char_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether the part begins and ends at word bounds."""
    return not (start > 0 and text[start - 1].isalnum() and text[start].isalnum()) and not (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


class Matcher:
    """The automaton of a block of (item_id, canonical text)."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_chars: int = MIN_CHARS):
        import ahocorasick

        self.items, self.masks, self.min_chars = items, {}, min_chars
        self.budget = [int(error_rate * len(t)) if len(t) >= min_chars else 0 for _, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(items):
            for a, b in pieces(len(t), self.budget[k]):
                where.setdefault(t[a:b], []).append((k, b))
        self.automaton = ahocorasick.Automaton()
        for p, places in where.items():
            self.automaton.add_word(p, places)
        if where:
            self.automaton.make_automaton()

    def match(self, text: str) -> dict[int, int]:
        """Item number -> least distance within its budget."""
        found: dict[int, int] = {}
        seen: dict[int, int] = {}
        if not text or not self.items:
            return found
        for end, places in self.automaton.iter(text):
            for k, b in places:
                start = end + 1 - b                      # where the item would begin
                if found.get(k) == 0 or seen.get(k) == start:
                    continue
                seen[k] = start
                item, budget = self.items[k][1], self.budget[k]
                if len(item) < self.min_chars and not whole_words(text, start, start + len(item)):
                    continue
                if text.startswith(item, start) and start >= 0:
                    found[k] = 0
                    continue
                if not budget:
                    continue
                if k not in self.masks:
                    self.masks[k] = char_masks(item)
                d = myers(item, text[max(0, start - budget):start + len(item) + budget], self.masks[k])
                if d <= budget and d < found.get(k, budget + 1):
                    found[k] = d
        return found


def item_blocks(benchmark: DataFrame, block_items: int, item_col: str, item_text_col: str):
    """The benchmark's canonical items, a block at a time, and whether it is the last."""
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), text_of(benchmark, item_text_col).alias("item"))
    items = items.filter(F.length(F.btrim("item")) > 0).distinct()
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("item"))).first()
    n_blocks = max(1, -(-n // block_items), -(-(size or 0) // BLOCK_BYTES))
    keyed = items.withColumn("block", F.pmod(F.xxhash64("item_id", "item"), F.lit(n_blocks)))
    for k in range(n_blocks):
        rows = keyed.filter(F.col("block") == k).select("item_id", "item").collect()
        yield [(r.item_id, c) for r in rows if (c := canonical(r.item))], k + 1 == n_blocks


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS,
            block_items: int = BLOCK_ITEMS, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, budget) of every document and item that match;
    a written table."""
    small_batches(docs.sparkSession)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    out = None
    with temporary(docs.sparkSession):
        for items, _ in item_blocks(benchmark, block_items, item_col, item_text_col):
            found = stored(_one_block(texts, items, error_rate, min_chars), "matches")
            out = found if out is None else out.unionByName(found)
        return lasting(out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("budget").alias("budget")), "found")


def _one_block(texts: DataFrame, items: list[tuple[int, str]], error_rate: float, min_chars: int) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(items)

    def search(batches):
        import pyarrow as pa
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "distance", "budget")])
        m = Matcher(sent.value, error_rate, min_chars)
        for b in batches:
            rows = [(d, m.items[k][0], e, m.budget[k]) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                    for k, e in m.match(canonical(t)).items()]
            yield arrays_to_batch(schema, [[r[i] for r in rows] for i in range(4)])

    return texts.mapInArrow(search, "doc_id long, item_id long, distance long, budget long")


def without_matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS,
                    block_items: int = BLOCK_ITEMS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no test item: a filter, without a
    shuffle.  What a block leaves is written for the next one's pass, so a task
    holds one block's automaton."""
    small_batches(docs.sparkSession)
    written = None
    for items, last in item_blocks(benchmark, block_items, item_col, item_text_col):
        left = docs.filter(~_holds(docs, items, error_rate, min_chars)(text_of(docs, text_col)))
        docs = left if last else stored(left, "left")
        if written is not None and not last:
            discard(written)
        written = docs if not last else written
    return docs


def _holds(docs: DataFrame, items: list[tuple[int, str]], error_rate: float, min_chars: int):
    sent, made = docs.sparkSession.sparkContext.broadcast(items), []

    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        if not made:                # once a task
            forget_vocabularies()
            made.append(Matcher(sent.value, error_rate, min_chars))
        return pa.array([bool(made[0].match(canonical(t))) for t in texts.to_pylist()], pa.bool_())

    return holds
